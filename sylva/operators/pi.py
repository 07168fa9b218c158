"""Structural entropy under a node distribution, and personalised PageRank.

``pi(graph_id, id, p)`` is a distribution, ``trans(graph_id, src, dst, p)`` a sparse
row-stochastic matrix. The teleport of PageRank is kept implicit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratio, xlog
from .checkpoints import cut, stored
from .graph import GID, MOST_GRAPHS, degrees, few, volume


def transitions(edges: DataFrame) -> DataFrame:
    """Steps of the random walk: weight over the row sum, a self-loop once."""
    one = edges.select(GID, "src", "dst", "w").union(edges.where("src <> dst").select(GID, F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    total = one.groupBy(GID, "src").agg(F.sum("w").alias("t"))
    return one.join(total, [GID, "src"]).select(GID, "src", "dst", ratio(F.col("w"), F.col("t")).alias("p"))


def degree_pi(edges: DataFrame) -> DataFrame:
    degree = degrees(edges)
    return degree.join(few(volume(degree)), GID).select(GID, "id", ratio(F.col("d"), F.col("m2")).alias("p"))


def ppr_step(pi: DataFrame, trans: DataFrame, query: DataFrame, alpha: float) -> DataFrame:
    """One power iteration: alpha at the query vertices, the rest along the walk."""
    moved = trans.join(pi.select(GID, F.col("id").alias("src"), F.col("p").alias("at")), [GID, "src"])
    moved = moved.select(GID, F.col("dst").alias("id"), ((1 - alpha) * F.col("at") * F.col("p")).alias("p"))
    return moved.union(query.select(GID, "id", (alpha * F.col("q")).alias("p"))).groupBy(GID, "id").agg(F.sum("p").alias("p"))


def ppr(edges: DataFrame, query: DataFrame, alpha: float = 0.15, iters: int = 200, tol: float = 1e-12, every: int = 5) -> DataFrame:
    """Personalised PageRank of ``query(graph_id, id, q)``; stops when the largest change in L1 is below ``tol``.

    Written to the checkpoint folder, and tested, after every ``every`` steps. The walk's transitions are stored, not made anew in each.
    """
    trans = cut(transitions(edges))
    pi = query.select(GID, "id", F.col("q").alias("p"))
    before = pi
    for i in range(1, iters + 1):
        pi = ppr_step(pi, trans, query, alpha)
        if tol > 0 and i % every == 0:
            pi = cut(pi)
            both = pi.join(before.withColumnRenamed("p", "old"), [GID, "id"], "full")
            change = both.groupBy(GID).agg(F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("x")).agg(F.max("x")).first()[0]
            if change is not None and change < tol:
                break
            before = pi
    return pi


def stationary(edges: DataFrame, query: DataFrame, alpha: float = 0.15, iters: int = 200, tol: float = 1e-12) -> DataFrame:
    """What ``ppr`` comes to, for vertices that mass reaches: steps end when one more of the walk's would change less than ``tol`` in L1.

    Solves p = alpha q + (1 - alpha) p P by conjugate gradients: P is symmetric where a vertex counts by one over its weight. On a two-sided graph
    the walk itself loses only a share of alpha of its error in a step, and takes some 170 of them. A step joins the transitions once, as the walk's does.
    """
    trans = cut(transitions(edges))
    both = edges.select(GID, "src", "w").union(edges.where("src <> dst").select(GID, F.col("dst").alias("src"), "w"))
    weight = both.groupBy(GID, F.col("src").alias("id")).agg(F.sum("w").alias("t"))
    d, zero = F.when(F.col("t") != 0, F.col("t")).otherwise(1.0), F.lit(0.0)
    state = weight.join(query.select(GID, "id", "q"), [GID, "id"], "full").select(GID, "id", d.alias("d"), zero.alias("p"), (alpha * F.coalesce("q", zero)).alias("r"))
    state = stored(state.withColumn("z", F.col("r")))
    size = lambda rows: stored(rows.groupBy(GID).agg(F.sum(F.col("r") * F.col("r") / F.col("d")).alias("rr"), F.sum(F.abs("r")).alias("left")))
    now = size(state)
    for _ in range(iters):
        most = now.agg(F.max("left").alias("left"), F.count(F.lit(1)).alias("graphs")).first()
        if not most["graphs"] or most["left"] < tol:
            break
        small = F.broadcast if most["graphs"] <= MOST_GRAPHS else lambda x: x
        moved = trans.join(state.where("z <> 0").select(GID, F.col("id").alias("src"), "z"), [GID, "src"])
        moved = moved.groupBy(GID, F.col("dst").alias("id")).agg(F.sum(F.col("z") * F.col("p")).alias("come"))
        rows = stored(state.join(moved, [GID, "id"], "left").select(*state.columns, (F.col("z") - (1 - alpha) * F.coalesce("come", zero)).alias("b")))
        along = rows.groupBy(GID).agg(F.sum(F.col("z") * F.col("b") / F.col("d")).alias("zb"))
        step = small(along.join(small(now), GID).select(GID, ratio(F.col("rr"), F.col("zb")).alias("step"), F.col("rr").alias("old")))
        rows = rows.join(step, GID).select(GID, "id", "d", (F.col("p") + F.col("step") * F.col("z")).alias("p"), (F.col("r") - F.col("step") * F.col("b")).alias("r"), "z", "old")
        now = size(rows)
        state = rows.join(small(now.select(GID, "rr")), GID).select(GID, "id", "d", "p", "r", (F.col("r") + ratio(F.col("rr"), F.col("old")) * F.col("z")).alias("z"))
    return state.where("p > 0").select(GID, "id", "p")


def pi_entropy(pi: DataFrame, trans: DataFrame, labels: DataFrame) -> DataFrame:
    """(graph_id, h_pi): entropy of a partition under ``pi``; modules without volume don't count."""
    own = labels.join(pi, [GID, "id"])
    vol = own.groupBy(GID, "c").agg(F.sum("p").alias("vol"), F.sum(xlog(F.col("p"), F.col("p"))).alias("s"))
    src = labels.select(GID, F.col("id").alias("src"), F.col("c").alias("cu"))
    dst = labels.select(GID, F.col("id").alias("dst"), F.col("c").alias("cv"))
    at = pi.select(GID, F.col("id").alias("src"), F.col("p").alias("at"))
    out = trans.join(src, [GID, "src"]).join(dst, [GID, "dst"]).where("cu <> cv").join(at, [GID, "src"])
    phi = out.groupBy(GID, F.col("cu").alias("c")).agg(F.sum(F.col("at") * F.col("p")).alias("phi"))
    rows = vol.where("vol > 0").join(phi, [GID, "c"], "left").withColumn("phi", F.coalesce("phi", F.lit(0.0)))
    # sum of pi log2(pi / vol) over a module is s - vol log2 vol
    part = xlog(F.col("phi"), F.col("vol")) + F.col("s") - xlog(F.col("vol"), F.col("vol"))
    return rows.groupBy(GID).agg((-F.sum(part)).alias("h_pi"))


def ppr_pi_entropy(pi: DataFrame, edges: DataFrame, labels: DataFrame, query: DataFrame, alpha: float = 0.15) -> DataFrame:
    """``pi_entropy`` for PageRank's own transition, teleport included: a module X leaves by
    (1 - alpha) times its outflow along the walk, plus alpha times its volume where it lacks query mass."""
    trans = transitions(edges)
    own = labels.join(pi, [GID, "id"])
    vol = own.groupBy(GID, "c").agg(F.sum("p").alias("vol"), F.sum(xlog(F.col("p"), F.col("p"))).alias("s"))
    mass = labels.join(query, [GID, "id"]).groupBy(GID, "c").agg(F.sum("q").alias("qx"))
    src = labels.select(GID, F.col("id").alias("src"), F.col("c").alias("cu"))
    dst = labels.select(GID, F.col("id").alias("dst"), F.col("c").alias("cv"))
    at = pi.select(GID, F.col("id").alias("src"), F.col("p").alias("at"))
    out = trans.join(src, [GID, "src"]).join(dst, [GID, "dst"]).where("cu <> cv").join(at, [GID, "src"])
    flow = out.groupBy(GID, F.col("cu").alias("c")).agg(F.sum(F.col("at") * F.col("p")).alias("flow"))
    rows = vol.where("vol > 0").join(flow, [GID, "c"], "left").join(mass, [GID, "c"], "left")
    phi = (1 - alpha) * F.coalesce("flow", F.lit(0.0)) + alpha * F.col("vol") * (1 - F.coalesce("qx", F.lit(0.0)))
    part = xlog(phi, F.col("vol")) + F.col("s") - xlog(F.col("vol"), F.col("vol"))
    return rows.groupBy(GID).agg((-F.sum(part)).alias("h_pi"))


def push(edges: DataFrame, query: DataFrame, alpha: float = 0.15, eps: float = 1e-6) -> DataFrame:
    """(graph_id, id, p, r): PageRank by forward push, and the residuals that are left.

    Each round, all vertices whose residual exceeds ``eps`` times their weight push it: a share of ``alpha``
    stays, the rest goes to the neighbours. Only vertices that mass has reached have rows, so work is
    local to the query. Where the walk can't go on, the rest is lost, as in ``ppr``.
    """
    trans = transitions(edges)
    weight = edges.select(GID, "src", "w").union(edges.where("src <> dst").select(GID, F.col("dst").alias("src"), "w")).groupBy(GID, F.col("src").alias("id")).agg(F.sum("w").alias("t"))
    trans, weight = stored(trans), stored(weight)
    state = stored(query.select(GID, "id", F.lit(0.0).alias("p"), F.col("q").alias("r")))
    while True:
        rows = state.join(weight, [GID, "id"], "left").withColumn("active", F.col("r") > eps * F.coalesce("t", F.lit(0.0)))
        rows = stored(rows.select(GID, "id", "p", "r", "active"))
        pushed = rows.where("active")
        if pushed.isEmpty():
            return state
        come = pushed.select(GID, F.col("id").alias("src"), F.col("r").alias("at")).join(trans, [GID, "src"])
        come = come.groupBy(GID, F.col("dst").alias("id")).agg(((1 - alpha) * F.sum(F.col("at") * F.col("p"))).alias("come"))
        kept, rest = F.when(F.col("active"), alpha * F.col("r")).otherwise(0.0), F.when(F.col("active"), 0.0).otherwise(F.col("r"))
        own = rows.select(GID, "id", (F.col("p") + kept).alias("p"), rest.alias("r"))
        zero = F.lit(0.0)
        state = stored(own.join(come, [GID, "id"], "full").select(GID, "id", F.coalesce("p", zero).alias("p"), (F.coalesce("r", zero) + F.coalesce("come", zero)).alias("r")))


def pi_moves(pi: DataFrame, trans: DataFrame, labels: DataFrame) -> DataFrame:
    """(graph_id, id, a, b, delta): the change of ``pi_entropy`` if a vertex of module a goes to one it has flow to or from.

    In closed form: without v, module a lets out what it sent to v and no longer what v sent elsewhere; b the other way round.
    """
    at = pi.select(GID, F.col("id").alias("src"), F.col("p").alias("at"))
    flow = trans.where("src <> dst").join(at, [GID, "src"]).select(GID, "src", "dst", (F.col("at") * F.col("p")).alias("f"))
    of = lambda name, c: labels.select(GID, F.col("id").alias(name), F.col("c").alias(c))
    flow = stored(flow.join(of("src", "cu"), [GID, "src"]).join(of("dst", "cv"), [GID, "dst"]))
    out = flow.groupBy(GID, F.col("src").alias("id")).agg(F.sum("f").alias("out"))
    both = flow.select(GID, F.col("src").alias("id"), F.col("cv").alias("b"), "f").union(flow.select(GID, F.col("dst").alias("id"), F.col("cu").alias("b"), "f"))
    both = stored(both.groupBy(GID, "id", "b").agg(F.sum("f").alias("both")))
    phi = flow.where("cu <> cv").groupBy(GID, F.col("cu").alias("c")).agg(F.sum("f").alias("phi"))
    zero = F.lit(0.0)
    vol = labels.join(pi, [GID, "id"]).groupBy(GID, "c").agg(F.sum("p").alias("vol"), F.count(F.lit(1)).alias("n"))
    modules = stored(vol.join(phi, [GID, "c"], "left").select(GID, "c", "vol", "n", F.coalesce("phi", zero).alias("phi")))
    side = lambda x: modules.select(GID, F.col("c").alias(x), F.col("vol").alias(f"v{x}"), F.col("phi").alias(f"f{x}"), F.col("n").alias(f"n{x}"))
    own = labels.withColumnRenamed("c", "a").join(pi, [GID, "id"]).join(out, [GID, "id"], "left")
    own = own.join(both.withColumnRenamed("b", "a").withColumnRenamed("both", "own"), [GID, "id", "a"], "left")
    rows = own.join(both, [GID, "id"]).where("a <> b").join(side("a"), [GID, "a"]).join(side("b"), [GID, "b"])
    out, ours = F.coalesce("out", zero), F.coalesce("own", zero)
    part = lambda f, v: xlog(f, v) - xlog(v, v)
    less = F.when(F.col("na") == 1, zero).otherwise(part(F.col("fa") - out + ours, F.col("va") - F.col("p")))
    more = part(F.col("fb") + out - F.col("both"), F.col("vb") + F.col("p"))
    delta = part(F.col("fa"), F.col("va")) + part(F.col("fb"), F.col("vb")) - less - more
    return rows.select(GID, "id", "a", "b", delta.alias("delta"))


def pi_search(pi: DataFrame, trans: DataFrame, labels: DataFrame, tolerance: float = 1e-3, rounds: int | None = None) -> DataFrame:
    """(graph_id, id, c): labels of lower ``pi_entropy`` by synchronous rounds from given ones, each vertex with its best move.

    Ends after two rounds in a row that lower no graph's entropy by over ``tolerance`` bits, or after ``rounds``.
    """
    from .search import _round

    pi, trans, labels = stored(pi), stored(trans), stored(labels)

    def best(_, now, __, of):
        key = F.struct(F.round("delta", 9).alias("delta"), "a", "b")
        moves = pi_moves(pi, trans, now).where(of & (F.col("delta") < -1e-9))
        return moves.groupBy(GID, "id").agg(F.min(key).alias("m")).select(GID, "id", "m.a", "m.b", "m.delta")

    value = lambda _, now, __: pi_entropy(pi, trans, now).withColumnRenamed("h_pi", "h2")
    before, idle, done = stored(value(None, labels, None)), 0, 0
    while idle < 2 and done != rounds:
        labels, now = _round(None, labels, None, done, before, 3, best, value)
        fall = before.withColumnRenamed("h2", "old").join(now, GID).agg(F.max(F.col("old") - F.col("h2"))).first()[0]
        idle = idle + 1 if fall is None or fall <= tolerance else 0
        before, done = now, done + 1
    return labels
