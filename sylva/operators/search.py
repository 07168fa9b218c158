"""Partition and tree search on DataFrames.

Two tiers. A graph of up to ``KERNEL_EDGES`` edges goes to one task, which runs a
sequential kernel, and a larger one given to a kernel is refused; many graphs, seeds and starts run side by side, each a group. A larger
graph is searched in synchronous rounds: all vertices' best moves in one query, of which those from
one half of the communities to the other are made, so that two neighbours can't swap.
A round counts for a graph only if its H2, computed anew, falls; else half of its movers try again.
Contracted graphs that are small end in a kernel.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import moves
from .checkpoints import cut, stored
from .graph import GID, canonical, contracted, degrees, dense_ids, first_seen, sent
from .kernels import partition as P
from .kernels import trees as K
from .scores import two_dimensional

KERNEL_EDGES = 2_000_000
#: Edges of a contracted graph that a large graph's search may end with in one task.
FINISH_EDGES = 200_000


def renewed(df: DataFrame) -> DataFrame:
    """``df`` with columns of its own, so that it can be grouped beside one it comes from."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def net_of(edges: pd.DataFrame, vertices: pd.DataFrame) -> tuple[P.Net, list]:
    """A kernel's graph and the ids of its vertices in order."""
    ids = sorted(set(vertices["id"]) | set(edges["src"]) | set(edges["dst"])) if len(vertices) == 0 or "ord" not in vertices else vertices.sort_values("ord")["id"].tolist()
    at = {v: i for i, v in enumerate(ids)}
    return P.Net(len(ids), zip(map(at.get, edges["src"]), map(at.get, edges["dst"]), edges["w"])), ids


def vertices_of(edges: DataFrame) -> DataFrame:
    """(graph_id, id) of all ends of edges."""
    return edges.select(GID, F.explode(F.array("src", "dst")).alias("id")).distinct()


def checked(edges: DataFrame) -> DataFrame:
    """``edges``, if each graph is small enough for one task; else a ValueError that names one that isn't."""
    large = edges.groupBy(GID).count().where(F.col("count") > KERNEL_EDGES).first()
    if large is not None:
        raise ValueError(f"graph {large[GID]!r} has {large['count']} edges, over {KERNEL_EDGES} for one task; distributed_search takes it")
    return edges


def per_graph(edges: DataFrame, fn: Callable[[P.Net, int], list[int]], vertices: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """(graph_id, id, c): ``fn(net, seed)`` on each graph, a task for each."""
    vertices = vertices_of(edges) if vertices is None else vertices
    kind = edges.schema["src"].dataType.simpleString()

    def run(key, e: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        net, ids = net_of(e, v)
        return pd.DataFrame({GID: key[0], "id": ids, "c": fn(net, seed)})

    return checked(edges).groupBy(GID).cogroup(renewed(vertices).groupBy(GID)).applyInPandas(run, f"{GID} string, id {kind}, c long")


def multistart(edges: DataFrame, fn: Callable[[P.Net, int], tuple[list[int], float]], vertices: DataFrame | None = None, seed: int = 0, starts: int = 8) -> DataFrame:
    """(graph_id, id, c, value): the labels of least value over ``starts`` runs, each a task of its own."""
    vertices = vertices_of(edges) if vertices is None else vertices
    numbers = F.explode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("start")
    # A number of partitions keeps adaptive execution from putting small graphs' runs back into one task.
    dealt = max(8 * starts, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    e, v = (x.select("*", numbers).repartition(dealt, GID, "start") for x in (checked(edges), renewed(vertices)))
    kind = edges.schema["src"].dataType.simpleString()

    def run(key, e: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        net, ids = net_of(e, v)
        labels, value = fn(net, seed * 1000 + int(key[1]))
        return pd.DataFrame({GID: key[0], "start": key[1], "value": value, "id": ids, "c": labels})

    rows = cut(e.groupBy(GID, "start").cogroup(v.groupBy(GID, "start")).applyInPandas(run, f"{GID} string, start int, value double, id {kind}, c long"))
    best = rows.groupBy(GID).agg(F.min(F.struct(F.round("value", 12).alias("value"), "start")).alias("b")).select(GID, "b.start")
    return rows.join(best, [GID, "start"]).select(GID, "id", "c", "value")


def se_louvain(edges: DataFrame, vertices: DataFrame | None = None, k: int | None = None, seed: int = 0, starts: int = 8) -> DataFrame:
    """(graph_id, id, c): the partition of least H2 found; merged down if it has more than k modules."""

    def one(net: P.Net, s: int) -> tuple[list[int], float]:
        labels = P.polished(net, P.multilevel(net, "entropy", s), seed=s)
        return labels, P.Partition(net, labels).value()

    best = multistart(edges, one, vertices, seed, starts).select(GID, "id", "c")
    if not k:
        return best
    kind = edges.schema["src"].dataType.simpleString()

    def merge(key, e: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("id").reset_index(drop=True)
        net, ids = net_of(e, v.assign(ord=v.index))
        return pd.DataFrame({GID: key[0], "id": ids, "c": P.merged_down(net, v["c"].tolist(), k)})

    return edges.groupBy(GID).cogroup(renewed(best).groupBy(GID)).applyInPandas(merge, f"{GID} string, id {kind}, c long")


def se_fixed_k(edges: DataFrame, k: int, vertices: DataFrame | None = None, seed: int = 0, starts: int = 8) -> DataFrame:
    """(graph_id, id, c): the best partition found into exactly k modules."""

    def one(net: P.Net, s: int) -> tuple[list[int], float]:
        labels = P.fixed_k(net, k, starts=1, seed=s, use_spectral=s % 1000 == 0)
        return labels, P.Partition(net, labels).value()

    return multistart(edges, one, vertices, seed, starts).select(GID, "id", "c")


def dendrogram(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(graph_id, step, left, right, height, size): agglomerative merges; clusters are numbered in order of id."""
    vertices = vertices_of(edges) if vertices is None else vertices

    def run(key, e: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        merges = P.agglomerated(net_of(e, v)[0])
        out = pd.DataFrame(merges, columns=["left", "right", "height", "size"])
        return out.assign(**{GID: key[0], "step": range(len(out))})[[GID, "step", "left", "right", "height", "size"]]

    return checked(edges).groupBy(GID).cogroup(renewed(vertices).groupBy(GID)).applyInPandas(run, f"{GID} string, step int, left long, right long, height double, size long")


def tree_rows(tree: K.Tree, ids: list, gid: str) -> pd.DataFrame:
    depth, rows = {tree.root: 0}, []
    for x in reversed(tree.order()):
        for y in tree.kids[x]:
            depth[y] = depth[x] + 1
    for x, d in depth.items():
        leaf = x not in tree.kids
        rows.append((gid, f"v{ids[x]}" if leaf else f"t{x}", f"t{tree.parent[x]}" if x in tree.parent else None, d, ids[x] if leaf else None))
    return pd.DataFrame(rows, columns=[GID, "node", "parent", "depth", "vertex"]).astype({"vertex": "Int64"})


def encoding_trees(edges: DataFrame, vertices: DataFrame | None = None, seed: int = 0, starts: int = 4, fn: Callable[[P.Net], K.Tree] | None = None) -> DataFrame:
    """(graph_id, node, parent, depth, vertex): the encoding tree of least entropy found for each graph with long ids."""
    vertices = vertices_of(edges) if vertices is None else vertices
    build = fn or (lambda net: K.encoding_tree(net, seed, starts))

    def run(key, e: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        net, ids = net_of(e, v)
        return tree_rows(build(net), ids, key[0])

    return checked(edges).groupBy(GID).cogroup(renewed(vertices).groupBy(GID)).applyInPandas(run, f"{GID} string, node string, parent string, depth int, vertex long")


# --- large graphs ---


def _entropy(edges: DataFrame, labels: DataFrame, degree: DataFrame) -> DataFrame:
    return two_dimensional(edges, labels, degree=degree).select(GID, "h2")


def _round(
    edges: DataFrame, labels: DataFrame, degree: DataFrame, number: int, before: DataFrame, tries: int = 7,
    best: Callable[..., DataFrame] = moves.best_moves, value: Callable[..., DataFrame] = _entropy, less: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """One synchronous round: labels and (graph_id, h2) after it; a graph that no half of its movers helps stays as it was.

    ``best`` gives moves as ``moves.best_moves`` does, of the communities that movers may leave this time, ``value`` what is to fall, under the name h2. Each try
    takes one of ``less`` of the movers of the one before.
    """
    side = lambda c, salt: F.pmod(F.xxhash64(F.lit(number), F.lit(salt), c), F.lit(2))
    found = best(edges, labels, degree, side(F.col("a"), "c") == 0)
    fresh = F.col("b") == moves.FRESH
    ok = fresh | (side(F.col("b"), "c") == 1)
    to = F.when(fresh, F.xxhash64(F.lit(number), "id")).otherwise(F.col("b"))
    movers = stored(found.where(ok).select(GID, "id", to.alias("to")))
    for t in range(tries):
        if movers.isEmpty():
            break
        made = movers if not t else movers.where(F.pmod(F.xxhash64(F.lit(number), F.lit("half"), "id"), F.lit(less**t)) == 0)
        after = stored(labels.join(made, [GID, "id"], "left").select(GID, "id", "c", F.coalesce("to", "c").alias("to")))
        now = value(edges, after.select(GID, "id", F.col("to").alias("c")), degree).select(GID, F.col("h2").alias("now"))
        both = stored(now.join(before, GID).select(GID, "now", "h2"))
        fell = F.col("now") < F.col("h2") - 1e-12
        gained = sent(both.where(fell).select(GID, F.lit(True).alias("gained")))
        before = both.select(GID, F.when(fell, F.col("now")).otherwise(F.col("h2")).alias("h2"))
        labels = stored(after.join(gained, GID, "left").select(GID, "id", F.when(F.col("gained"), F.col("to")).otherwise(F.col("c")).alias("c")))
        movers = movers.join(gained, GID, "left_anti")
    return labels, before


def distributed_search(edges: DataFrame, labels: DataFrame | None = None, vertices: DataFrame | None = None, rounds: int | None = None, levels: int | None = None, tolerance: float = 1e-2, finish: int = FINISH_EDGES) -> DataFrame:
    """(graph_id, id, c) by synchronous rounds and contraction, for graphs of any size.

    A level ends after two rounds in a row that lower no graph's H2 by over ``tolerance`` bits (or after
    ``rounds``), the search when contraction makes nothing smaller (or after ``levels``). Once the contracted
    graphs have ``finish`` edges at most, each ends in one task, by the kernel's multilevel search from its vertices.
    Ids may be of any type. Vertices that only ``vertices`` lists are communities of their own.
    """
    if vertices is not None:
        found = distributed_search(edges, labels, None, rounds, levels, tolerance, finish)
        alone = vertices.select(GID, "id").distinct().join(renewed(found.select(GID, "id")), [GID, "id"], "left_anti")
        more = dense_ids(alone).select(GID, "id", (F.col("n") - (1 << 62)).alias("c"))  # communities of others have numbers from 0 or hashes
        return stored(found.union(more))
    edges = stored(edges)
    labels = dense_ids(vertices_of(edges)).select(GID, "id", F.col("n").alias("c")) if labels is None else labels
    labels = stored(labels)
    level, upper, number = labels, edges, 0
    for depth in count():
        if depth == levels:
            break
        degree = stored(degrees(upper, level))
        h2 = stored(two_dimensional(upper, level, degree=degree).select(GID, "h2"))
        idle = done = 0
        while idle < 2 and done != rounds:
            level, now = _round(upper, level, degree, number, h2)
            fall = h2.withColumnRenamed("h2", "old").join(now, GID).agg(F.max(F.col("old") - F.col("h2"))).first()[0]
            idle = idle + 1 if fall is None or fall <= tolerance else 0
            h2, done, number = now, done + 1, number + 1
        labels = _followed(labels, level) if depth else level
        smaller = stored(contracted(upper, level))
        sizes = smaller.groupBy(GID).count().agg(F.sum("count").alias("all"), F.max("count").alias("most")).first()
        if not sizes["all"] or sizes["all"] == upper.count():
            break
        if sizes["most"] <= min(finish, KERNEL_EDGES):
            ends = stored(per_graph(smaller, lambda net, s: P.polished(net, P.multilevel(net, "entropy", s), seed=s)))
            names = ends.groupBy(GID, "c").agg(F.min("id").alias("name"))
            return _followed(labels, ends.join(names, [GID, "c"]).select(GID, "id", F.col("name").alias("c")))
        upper = smaller
        level = stored(vertices_of(upper).select(GID, "id", F.col("id").alias("c")))
    return labels


def _followed(labels: DataFrame, level: DataFrame) -> DataFrame:
    """Labels by the communities that ``level`` gives to those of ``labels``; one without edges keeps its own."""
    above = level.select(GID, F.col("id").alias("old"), F.col("c").alias("new"))
    return stored(labels.withColumnRenamed("c", "old").join(above, [GID, "old"], "left").select(GID, "id", F.coalesce("new", "old").alias("c")))


def optimise(edges: DataFrame, vertices: DataFrame | None = None, seed: int = 0, starts: int = 8) -> DataFrame:
    """``se_louvain`` for graphs of up to ``KERNEL_EDGES`` edges, ``distributed_search`` for larger ones."""
    sizes = edges.groupBy(GID).count()
    large = sizes.where(F.col("count") > KERNEL_EDGES).select(GID)
    if large.isEmpty():
        return se_louvain(edges, vertices, seed=seed, starts=starts)
    small = edges.join(large, GID, "left_anti")
    few = vertices.join(large, GID, "left_anti") if vertices is not None else None
    return se_louvain(small, few, seed=seed, starts=starts).union(distributed_search(edges.join(large, GID, "left_semi"), vertices=vertices.join(large, GID, "left_semi") if vertices is not None else None))


def connected(edges: DataFrame) -> DataFrame:
    """(graph_id, id, c): the smallest id of each vertex's connected component.

    Each round hooks every label to its smallest neighbour label and follows the hooks to their
    ends by doubling, until no edge joins two labels. A label that isn't hooked has taken in a
    neighbour, or is hooked in the next round, so labels halve at least every two rounds.
    """
    edges = cut(edges.where("src <> dst"))
    labels = cut(vertices_of(edges).select(GID, "id", F.col("id").alias("c")))
    while True:
        pair = edges.join(labels.select(GID, F.col("id").alias("src"), F.col("c").alias("cu")), [GID, "src"]).join(labels.select(GID, F.col("id").alias("dst"), F.col("c").alias("cv")), [GID, "dst"])
        hook = stored(pair.where("cu <> cv").groupBy(GID, F.greatest("cu", "cv").alias("c")).agg(F.min(F.least("cu", "cv")).alias("to")))
        if hook.isEmpty():
            return labels
        moved = True
        while moved:
            jump = stored(hook.join(hook.select(GID, F.col("c").alias("to"), F.col("to").alias("far")), [GID, "to"], "left").select(GID, "c", "to", "far"))
            moved = not jump.where("far IS NOT NULL").isEmpty()
            hook = jump.select(GID, "c", F.coalesce("far", "to").alias("to"))
        labels = stored(labels.join(hook, [GID, "c"], "left").select(GID, "id", F.coalesce("to", "c").alias("c")))


def hop_distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(graph_id, source, id, hops) from each of ``sources(graph_id, id)``, by frontier joins until no front is left; unreachable vertices are left out."""
    from .graph import incidence

    steps = cut(incidence(edges.where("src <> dst")).select(GID, "id", "nbr").distinct())
    seen = front = sources.select(GID, F.col("id").alias("source"), "id", F.lit(0).alias("hops"))
    hop = 0
    while True:
        hop += 1
        ahead = front.join(steps, [GID, "id"]).select(GID, "source", F.col("nbr").alias("id")).distinct()
        front = cut(ahead.join(seen.select(GID, "source", "id"), [GID, "source", "id"], "left_anti").withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            return seen
        seen = cut(seen.union(front.select(GID, "source", "id", "hops")).repartition(GID, "source", "id"))  # a union adds partitions


def relabelled(labels: DataFrame) -> DataFrame:
    return first_seen(labels)


def super_graph(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The community graph without weights: 1 for each pair of communities that adjoin."""
    pairs = contracted(edges, labels).where("src <> dst")
    return canonical(pairs.select(GID, "src", "dst"))
