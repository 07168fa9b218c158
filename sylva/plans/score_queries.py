"""Queries that score graphs and partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import rounded
from ..operators import graph, pi, scores, soft
from ..operators.checkpoints import cut, stored
from ..operators.graph import GID
from ..sources import tables as T
from .register import COMM, CS, CS_ALL, DEG, EV, H1, NATIONS, query, r6, term_sql

H2_SQL = f"((SELECT sum({term_sql('v', 'g')}) FROM comm, tot) - (SELECT sum(d * log2(d)) / any_value(m2) FROM deg, tot WHERE d > 0))"
MOD_SQL = "(SELECT sum((v - g) / m2 - (v / m2) * (v / m2)) FROM comm, tot)"
PLOGP = "CASE WHEN {0} > 0 THEN ({0}) * log2({0}) ELSE 0 END"
MAP_SQL = f"""(SELECT {PLOGP.format('any_value(q)')} - 2 * sum({PLOGP.format('g / m2')}) - any_value(s) + sum({PLOGP.format('(g + v) / m2')})
  FROM comm, tot, (SELECT sum(g / m2) AS q FROM comm, tot) x, (SELECT sum(d / m2 * log2(d / m2)) AS s FROM deg, tot WHERE d > 0) y)"""


def _cs(spark, sf_dir):
    return cut(T.customer_supplier(spark, sf_dir)), T.nation_labels(spark, sf_dir)


@query("degree", f"WITH {CS}, {DEG} SELECT id, d FROM deg")
def degree(spark, sf_dir):
    return graph.degrees(T.customer_supplier(spark, sf_dir)).select("id", "d")


@query("degree_self_loops", f"WITH {EV}, {DEG} SELECT id, d FROM deg")
def degree_self_loops(spark, sf_dir):
    return graph.degrees(T.event_transitions(spark, sf_dir)).select("id", "d")


@query("h1", f"WITH {CS}, {DEG} SELECT {r6(H1)} AS h1")
def h1(spark, sf_dir):
    return scores.one_dimensional(T.customer_supplier(spark, sf_dir)).select(rounded(F.col("h1")).alias("h1"))


@query("h2", f"{CS_ALL}, s AS (SELECT {H1} AS h1, {H2_SQL} AS h2) SELECT {r6('h1')} AS h1, {r6('h2')} AS h2, round((h1 - h2) / h1, 4) + 0.0 AS compression, CAST((SELECT count(*) FROM comm) AS BIGINT) AS num_communities FROM s")
def h2(spark, sf_dir):
    found = scores.two_dimensional(*_cs(spark, sf_dir))
    return found.select(rounded(F.col("h1")).alias("h1"), rounded(F.col("h2")).alias("h2"), rounded((F.col("h1") - F.col("h2")) / F.col("h1"), 4).alias("compression"), F.col("k").alias("num_communities"))


COP = """e AS (SELECT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey),
e1 AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM e GROUP BY 1, 2), lab AS (SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS c FROM part)"""


@query("h2_copurchase", f"WITH {COP}, {DEG}, {COMM}, s AS (SELECT {H1} AS h1, {H2_SQL} AS h2) SELECT {r6('h1')} AS h1, {r6('h2')} AS h2 FROM s")
def h2_copurchase(spark, sf_dir):
    found = scores.two_dimensional(cut(T.copurchase(spark, sf_dir)), T.size_labels(spark, sf_dir))
    return found.select(rounded(F.col("h1")).alias("h1"), rounded(F.col("h2")).alias("h2"))


@query("h2_breakdown", f"""{CS_ALL}, ins AS (SELECT c, sum(CASE WHEN d > 0 THEN d * log2(d) ELSE 0 END) AS s FROM lab JOIN deg USING (id) GROUP BY c)
SELECT c, n, v, g, round(CASE WHEN g > 0 THEN -g / m2 * log2(v / m2) ELSE 0 END, 6) + 0.0 AS module, round((v * log2(v) - s) / m2, 6) + 0.0 AS within FROM comm JOIN ins USING (c), tot""")
def h2_breakdown(spark, sf_dir):
    return scores.breakdown(*_cs(spark, sf_dir)).select("c", "n", "v", "g", rounded(F.col("module")).alias("module"), rounded(F.col("within")).alias("within"))


@query("term_const_identity", f"""{CS_ALL}, s AS (SELECT (SELECT -sum(d * log2(d)) / any_value(m2) FROM deg, tot WHERE d > 0) AS const, (SELECT sum({term_sql('v', 'g')}) FROM comm, tot) AS terms,
(SELECT sum(CASE WHEN d > 0 THEN -d / m2 * log2(d / v) ELSE 0 END) FROM lab JOIN deg USING (id) JOIN comm USING (c), tot) + (SELECT sum(CASE WHEN g > 0 THEN -g / m2 * log2(v / m2) ELSE 0 END) FROM comm, tot) AS direct)
SELECT {r6('const')} AS const, {r6('terms')} AS terms, {r6('direct')} AS direct, {r6('const + terms - direct')} AS difference FROM s""")
def term_const_identity(spark, sf_dir):
    edges, labels = _cs(spark, sf_dir)
    degree = graph.degrees(edges, labels)
    comm = graph.communities(edges, labels, degree)
    terms = comm.join(graph.volume(degree), GID).groupBy(GID).agg(F.sum(scores.term(F.col("v"), F.col("g"), F.col("m2"))).alias("terms"))
    direct = scores.breakdown(edges, labels).groupBy(GID).agg(F.sum(F.col("module") + F.col("within")).alias("direct"))
    rows = scores.constant(degree).join(terms, GID).join(direct, GID)
    return rows.select(*[rounded(x).alias(n) for n, x in (("const", F.col("const")), ("terms", F.col("terms")), ("direct", F.col("direct")), ("difference", F.col("const") + F.col("terms") - F.col("direct")))])


@query("modularity", f"{CS_ALL} SELECT {r6(MOD_SQL)} AS modularity")
def modularity(spark, sf_dir):
    edges, labels = _cs(spark, sf_dir)
    degree = graph.degrees(edges, labels)
    return scores.modularity(graph.communities(edges, labels, degree), degree).select(rounded(F.col("modularity")).alias("modularity"))


@query("map_equation", f"{CS_ALL} SELECT {r6(MAP_SQL)} AS map_equation")
def map_equation(spark, sf_dir):
    edges, labels = _cs(spark, sf_dir)
    degree = graph.degrees(edges, labels)
    return scores.map_equation(graph.communities(edges, labels, degree), degree).select(rounded(F.col("map_equation")).alias("map_equation"))


@query("cross_objective", f"{CS_ALL} SELECT {r6(MOD_SQL)} AS modularity, {r6(MAP_SQL)} AS map_equation, {r6(H2_SQL)} AS structural_entropy_2d, (SELECT count(*) FROM comm) AS num_communities")
def cross_objective(spark, sf_dir):
    found = scores.cross_objective(*_cs(spark, sf_dir))
    return found.select(*[rounded(F.col(c)).alias(c) for c in ("modularity", "map_equation", "structural_entropy_2d")], "num_communities")


EV_LABELS = "lab AS (SELECT DISTINCT event_type AS id, CAST(length(event_type) % 2 AS BIGINT) AS c FROM events)"


@query("cross_objective_self_loops", f"WITH {EV}, {EV_LABELS}, {DEG}, {COMM} SELECT {r6(MOD_SQL)} AS modularity, {r6(MAP_SQL)} AS map_equation, {r6(H2_SQL)} AS structural_entropy_2d, (SELECT count(*) FROM comm) AS num_communities")
def cross_objective_self_loops(spark, sf_dir):
    labels = T.table(spark, sf_dir, "events").select(F.lit("ev").alias(GID), F.col("event_type").alias("id"), (F.length("event_type") % 2).cast("long").alias("c")).distinct()
    found = scores.cross_objective(T.event_transitions(spark, sf_dir), labels)
    return found.select(*[rounded(F.col(c)).alias(c) for c in ("modularity", "map_equation", "structural_entropy_2d")], "num_communities")


@query("num_communities", f"WITH {NATIONS} SELECT count(DISTINCT c) AS num_communities FROM lab")
def num_communities(spark, sf_dir):
    return T.nation_labels(spark, sf_dir).agg(F.count_distinct("c").alias("num_communities"))


def _coarse(labels):
    return labels.select(GID, "id", (F.col("c") % 5).alias("c"))


TABLE = f"WITH {NATIONS}, ct AS (SELECT c AS t, c % 5 AS p, count(*) AS n FROM lab GROUP BY 1, 2)"
SUMS = """, a AS (SELECT sum(n) AS a FROM ct GROUP BY t), b AS (SELECT sum(n) AS b FROM ct GROUP BY p), s AS (
  SELECT (SELECT CAST(sum(n) AS DOUBLE) FROM ct) AS total, (SELECT sum(n * (n - 1) / 2.0) FROM ct) AS x, (SELECT sum(a * (a - 1) / 2.0) FROM a) AS y, (SELECT sum(b * (b - 1) / 2.0) FROM b) AS z)"""


@query("contingency", f"{TABLE} SELECT t, p, n FROM ct")
def contingency(spark, sf_dir):
    labels = T.nation_labels(spark, sf_dir)
    return scores.contingency(labels, _coarse(labels)).select("t", "p", "n")


@query("ari", f"{TABLE}{SUMS} SELECT round((x - y * z / (total * (total - 1) / 2)) / ((y + z) / 2 - y * z / (total * (total - 1) / 2)), 6) + 0.0 AS ari FROM s")
def ari(spark, sf_dir):
    labels = T.nation_labels(spark, sf_dir)
    return scores.agreement(scores.contingency(labels, _coarse(labels))).select(rounded(F.col("ari")).alias("ari"))


@query("nmi", f"""{TABLE}{SUMS}, h AS (SELECT (SELECT -sum(a / total * ln(a / total)) FROM a, s) AS ht, (SELECT -sum(b / total * ln(b / total)) FROM b, s) AS hp,
(SELECT sum(n / total * ln(n * total / (x.a * y.b))) FROM ct JOIN (SELECT t, sum(n) AS a FROM ct GROUP BY t) x USING (t) JOIN (SELECT p, sum(n) AS b FROM ct GROUP BY p) y USING (p), s) AS mi)
SELECT round(mi / ((ht + hp) / 2), 6) + 0.0 AS nmi FROM h""")
def nmi(spark, sf_dir):
    labels = T.nation_labels(spark, sf_dir)
    return scores.agreement(scores.contingency(labels, _coarse(labels))).select(rounded(F.col("nmi")).alias("nmi"))


@query("acc_hungarian")
def acc_hungarian(spark, sf_dir):
    labels = T.nation_labels(spark, sf_dir)
    return scores.matched_accuracy(scores.contingency(labels, _coarse(labels))).select(rounded(F.col("acc")).alias("acc"))


@query("f1_block", f"""WITH {NATIONS}, x AS (SELECT id, c, CASE WHEN c IN (3, 8, 11) THEN 1 ELSE 0 END AS t, CASE WHEN c % 5 = 3 THEN 1 ELSE 0 END AS p FROM lab)
SELECT round(2.0 * sum(t * p) / (sum(t) + sum(p)), 6) + 0.0 AS f1 FROM x""")
def f1_block(spark, sf_dir):
    labels = T.nation_labels(spark, sf_dir)
    block = labels.where(F.col("c").isin(3, 8, 11)).select(GID, "id")
    query_vertex = labels.where("c = 3").groupBy(GID).agg(F.min("id").alias("id"))
    return scores.block_f1(_coarse(labels), block, query_vertex).select(rounded(F.col("f1")).alias("f1"))


@query("auroc_rank", """WITH x AS (SELECT n_chars AS s, quality AS y FROM labels JOIN documents USING (doc_id)), v AS (SELECT s, count(*) AS n, sum(y) AS p FROM x GROUP BY s),
r AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS k FROM v)
SELECT round((sum(p * k) - sum(p) * (sum(p) + 1) / 2.0) / (sum(p) * (sum(n) - sum(p))), 6) + 0.0 AS auroc FROM r""")
def auroc_rank(spark, sf_dir):
    scored = T.table(spark, sf_dir, "labels").join(T.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return scores.auroc(scored.select(F.col("n_chars").alias("score"), F.col("quality").alias("positive"))).select(rounded(F.col("auroc")).alias("auroc"))


@query("cut_volume", f"{CS_ALL} SELECT c, v, g, n FROM comm")
def cut_volume(spark, sf_dir):
    return graph.communities(*_cs(spark, sf_dir)).select("c", "v", "g", "n")


@query("community_graph", f"{CS_ALL} SELECT least(a.c, b.c) AS src, greatest(a.c, b.c) AS dst, sum(w) AS w FROM e1 JOIN lab a ON a.id = src JOIN lab b ON b.id = dst GROUP BY 1, 2")
def community_graph(spark, sf_dir):
    return graph.contracted(*_cs(spark, sf_dir)).select("src", "dst", "w")


@query("subgraph_semi", f"WITH {CS}, {NATIONS}, m AS (SELECT id FROM lab JOIN nation ON c = n_nationkey WHERE n_regionkey = 0) SELECT src, dst, w FROM e1 WHERE src IN (SELECT id FROM m) AND dst IN (SELECT id FROM m)")
def subgraph_semi(spark, sf_dir):
    edges, labels = _cs(spark, sf_dir)
    nations = T.table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").cast("long").alias("c"))
    return graph.induced(edges, labels.join(nations, "c", "left_semi")).select("src", "dst", "w")


@query("first_seen_relabel", f"WITH {NATIONS}, f AS (SELECT c, row_number() OVER (ORDER BY min(id)) - 1 AS k FROM lab GROUP BY c) SELECT id, k AS c FROM lab JOIN f USING (c)")
def first_seen_relabel(spark, sf_dir):
    return graph.first_seen(T.nation_labels(spark, sf_dir)).select("id", "c")


@query("sorted_relabel", f"WITH {NATIONS}, x AS (SELECT id, c * 7 % 25 AS c FROM lab) SELECT id, dense_rank() OVER (ORDER BY c) - 1 AS c FROM x")
def sorted_relabel(spark, sf_dir):
    labels = T.nation_labels(spark, sf_dir)
    return graph.dense_labels(labels.select(GID, "id", (F.col("c") * 7 % 25).alias("c"))).select("id", "c")


@query("dense_ids", f"WITH {NATIONS} SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM lab")
def dense_ids(spark, sf_dir):
    return graph.dense_ids(T.nation_labels(spark, sf_dir)).select("id", "n")


@query("degree_pi", f"WITH {CS}, {DEG} SELECT id, round(d / m2, 12) AS p FROM deg, tot")
def degree_pi(spark, sf_dir):
    return pi.degree_pi(T.customer_supplier(spark, sf_dir)).select("id", F.round("p", 12).alias("p"))


TRANS = "one AS (SELECT src, dst, w FROM e1 UNION ALL SELECT dst, src, w FROM e1 WHERE src <> dst), rs AS (SELECT src, sum(w) AS t FROM one GROUP BY src), tr AS (SELECT src, dst, w / t AS p FROM one JOIN rs USING (src))"


def _unrolled(rounds: int, alpha: float) -> str:
    parts = ["p0 AS (SELECT q AS id, 1.0 AS p FROM (SELECT min(src) AS q FROM e1))"]
    for i in range(rounds):
        parts.append(f"p{i + 1} AS (SELECT id, sum(p) AS p FROM (SELECT dst AS id, {1 - alpha} * sum(p{i}.p * tr.p) AS p FROM tr JOIN p{i} ON p{i}.id = tr.src GROUP BY dst UNION ALL SELECT id, {alpha} FROM p0) GROUP BY id)")
    return ", ".join(parts)


def _settled(alpha: float, iters: int = 200) -> str:
    """``px``: the walk with restarts after as many steps as the operator takes at most, when it no longer changes."""
    return f"""q AS (SELECT min(src) AS q FROM e1), step AS (SELECT src, dst, {1 - alpha} * p AS p FROM tr UNION ALL SELECT src, q, CAST({alpha} AS DOUBLE) FROM rs, q),
walk AS (SELECT 0 AS i, q AS id, CAST(1 AS DOUBLE) AS p FROM q UNION ALL SELECT i + 1, dst, sum(walk.p * step.p) FROM walk JOIN step ON step.src = walk.id WHERE i < {iters} GROUP BY i, dst), px AS (SELECT id, p FROM walk WHERE i = {iters})"""


def _query_vertex(edges):
    return edges.groupBy(GID).agg(F.min("src").alias("id")).select(GID, "id", F.lit(1.0).alias("q"))


@query("ppr_iter10", f"WITH {CS}, {TRANS}, {_unrolled(10, 0.15)} SELECT id, round(p, 9) + 0.0 AS p FROM p10")
def ppr_iter10(spark, sf_dir):
    edges = cut(T.customer_supplier(spark, sf_dir))
    return pi.ppr(edges, _query_vertex(edges), iters=10, tol=0.0).select("id", F.round("p", 9).alias("p"))


@query("ppr_push", "SELECT 'cs' AS graph_id, CAST(0 AS BIGINT) AS above, CAST(0 AS BIGINT) AS broken, 1.0 AS mass")
def ppr_push(spark, sf_dir):
    """Forward push on the customer-supplier graph, checked: residuals above their bound, vertices where mass isn't balanced, and all mass."""
    edges, alpha, eps = cut(T.customer_supplier(spark, sf_dir)), 0.15, 1e-6
    start = _query_vertex(edges)
    found = stored(pi.push(edges, start, alpha, eps))
    # What a vertex pushed is p / alpha, so r = q + (1 - alpha) * inflow - p / alpha.
    came = pi.transitions(edges).withColumnRenamed("p", "step").join(found.select(GID, F.col("id").alias("src"), "p"), [GID, "src"])
    came = came.groupBy(GID, F.col("dst").alias("id")).agg(F.sum((1 - alpha) / alpha * F.col("p") * F.col("step")).alias("come"))
    zero = F.lit(0.0)
    rows = graph.degrees(edges).join(found, [GID, "id"], "left").join(came, [GID, "id"], "left").join(start, [GID, "id"], "left")
    p, r = F.coalesce("p", zero), F.coalesce("r", zero)
    broken = F.abs(F.coalesce("q", zero) + F.coalesce("come", zero) - p / alpha - r) > 1e-9
    count = lambda x: F.sum(x.cast("long"))
    return rows.groupBy(GID).agg(count(r > eps * F.col("d")).alias("above"), count(broken).alias("broken"), rounded(F.sum(p + r), 9).alias("mass"))


FLOW = "pi AS (SELECT id, d / m2 AS p FROM deg, tot), fl AS (SELECT tr.src, tr.dst, pi.p * tr.p AS f FROM tr JOIN pi ON pi.id = tr.src)"


@query("pi_moves", f"""WITH {CS}, {NATIONS}, {DEG}, {TRANS}, {FLOW}, l2 AS (SELECT lab.id, c, p FROM lab JOIN pi USING (id)),
w AS (SELECT v.id, v.c AS a, v.p, x.c AS b, sum(fl.f) AS f FROM l2 v JOIN fl ON fl.src = v.id JOIN l2 x ON x.id = fl.dst GROUP BY ALL),
m AS (SELECT l2.c, sum(p) AS vol, count(*) AS n, any_value(coalesce(phi, 0)) AS phi FROM l2 LEFT JOIN (SELECT a AS c, sum(f) AS phi FROM w WHERE a <> b GROUP BY a) USING (c) GROUP BY l2.c),
o AS (SELECT id, sum(f) AS tot, sum(CASE WHEN a = b THEN f ELSE 0 END) AS own FROM w GROUP BY id),
t AS (SELECT w.id, w.a, w.b, x.vol - p AS va, x.phi - (o.tot - o.own) + o.own AS fa, x.n, y.vol + p AS vb, y.phi + o.tot - 2 * f AS fb, x.phi * log2(x.vol) - x.vol * log2(x.vol) + y.phi * log2(y.vol) - y.vol * log2(y.vol) AS old
  FROM w JOIN o USING (id) JOIN m x ON x.c = a JOIN m y ON y.c = b WHERE a <> b)
SELECT id, a, b, round(old - CASE WHEN n = 1 THEN 0 ELSE fa * log2(va) - va * log2(va) END - (fb * log2(vb) - vb * log2(vb)), 6) + 0.0 AS delta FROM t""")
def pi_moves(spark, sf_dir):
    """Changes of the entropy under the degree distribution by all moves of a vertex from its nation to one it trades with.

    The graph is undirected, so flows are symmetric there, which the SQL uses and the operator doesn't.
    """
    edges, labels = _cs(spark, sf_dir)
    found = pi.pi_moves(pi.degree_pi(edges), pi.transitions(edges), labels)
    return found.select("id", "a", "b", rounded(F.col("delta")).alias("delta"))


H_PI = "-sum(CASE WHEN phi > 0 THEN phi * log2(vol) ELSE 0 END + s - vol * log2(vol))"


@query("h_pi", f"""WITH {CS}, {NATIONS}, {DEG}, {TRANS}, pi AS (SELECT id, d / m2 AS p FROM deg, tot), x AS (SELECT c, sum(p) AS vol, sum(p * log2(p)) AS s FROM lab JOIN pi USING (id) WHERE p > 0 GROUP BY c),
o AS (SELECT a.c, sum(pi.p * tr.p) AS phi FROM tr JOIN lab a ON a.id = tr.src JOIN lab b ON b.id = tr.dst JOIN pi ON pi.id = tr.src WHERE a.c <> b.c GROUP BY a.c)
SELECT {r6(H_PI)} AS h_pi FROM x LEFT JOIN (SELECT c, phi FROM o) o USING (c)""")
def h_pi(spark, sf_dir):
    edges, labels = _cs(spark, sf_dir)
    return pi.pi_entropy(pi.degree_pi(edges), pi.transitions(edges), labels).select(rounded(F.col("h_pi")).alias("h_pi"))


@query("h_pi_ppr", f"""WITH RECURSIVE {CS}, {NATIONS}, {TRANS}, {_settled(0.15)}, x AS (SELECT c, sum(p) AS vol, sum(p * log2(p)) AS s, sum(CASE WHEN id = (SELECT q FROM q) THEN 1.0 ELSE 0.0 END) AS qx FROM lab JOIN px USING (id) WHERE p > 0 GROUP BY c),
o AS (SELECT a.c, sum(px.p * tr.p) AS flow FROM tr JOIN lab a ON a.id = tr.src JOIN lab b ON b.id = tr.dst JOIN px ON px.id = tr.src WHERE a.c <> b.c GROUP BY a.c),
y AS (SELECT vol, s, 0.85 * coalesce(flow, 0) + 0.15 * vol * (1 - qx) AS phi FROM x LEFT JOIN o USING (c)) SELECT {r6(H_PI)} AS h_pi FROM y""")
def h_pi_ppr(spark, sf_dir):
    edges, labels = _cs(spark, sf_dir)
    query_vertex = _query_vertex(edges)
    p = pi.stationary(edges, query_vertex)
    return pi.ppr_pi_entropy(p, edges, labels, query_vertex).select(rounded(F.col("h_pi")).alias("h_pi"))


REGION_SOFT = "sft AS (SELECT id, k, CASE WHEN n_regionkey = k THEN 0.6 ELSE 0.1 END AS s FROM lab JOIN nation ON c = n_nationkey, range(5) t(k))"


@query("soft_h2", f"""WITH {CS}, {NATIONS}, {DEG}, {REGION_SOFT}, v AS (SELECT k, sum(d * s) AS v FROM sft JOIN deg USING (id) GROUP BY k),
i AS (SELECT a.k, sum(w * a.s * b.s) AS i FROM inc JOIN sft a ON a.id = inc.id JOIN sft b ON b.id = inc.nbr AND a.k = b.k GROUP BY a.k)
SELECT round((SELECT sum(v / m2 * log2(least(greatest(v / m2, 1e-9), 1)) - (v - i) / m2 * log2(least(greatest(v / m2, 1e-9), 1))) FROM v JOIN i USING (k), tot) + {H1}, 6) + 0.0 AS soft_h2""")
def soft_h2(spark, sf_dir):
    edges, labels = _cs(spark, sf_dir)
    nations = T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("c"), "n_regionkey")
    shares = F.array(*[F.when(F.col("n_regionkey") == k, 0.6).otherwise(0.1) for k in range(5)])
    assigned = labels.join(nations, "c").select(GID, "id", shares.alias("s"))
    return soft.soft_entropy(edges, assigned).select(rounded(F.col("soft_h2")).alias("soft_h2"))


@query("gcn_norm", f"""WITH {CS}, v AS (SELECT DISTINCT src AS id FROM e1 UNION SELECT DISTINCT dst FROM e1), a AS (SELECT src, dst, w FROM e1 UNION ALL SELECT id, id, 1.0 FROM v),
t AS (SELECT id, sum(w) AS t FROM (SELECT src AS id, w FROM a UNION ALL SELECT dst, w FROM a WHERE src <> dst) GROUP BY id) SELECT a.src, a.dst, round(w / sqrt(x.t * y.t), 9) AS a FROM a JOIN t x ON x.id = a.src JOIN t y ON y.id = a.dst""")
def gcn_norm(spark, sf_dir):
    return soft.normalised_adjacency(T.customer_supplier(spark, sf_dir)).select("src", "dst", F.round("a", 9).alias("a"))


def _sinkhorn_sql(rounds: int) -> str:
    parts = ["x0 AS (SELECT vec_id AS id, k, exp(CAST(embedding[k + 1] AS DOUBLE) - list_max(embedding)) AS v FROM embeddings, range(64) t(k) WHERE k < len(embedding))", "n AS (SELECT count(*) AS n FROM embeddings)"]
    for i in range(rounds):
        parts.append(f"r{i} AS (SELECT id, k, v / sum(v) OVER (PARTITION BY id) AS v FROM x{i})")
        parts.append(f"x{i + 1} AS (SELECT id, k, v * n / ((SELECT max(len(embedding)) FROM embeddings) * sum(v) OVER (PARTITION BY k)) AS v FROM r{i}, n)")
    return f"WITH {', '.join(parts)} SELECT id, k, round(v / sum(v) OVER (PARTITION BY id), 6) + 0.0 AS s FROM x{rounds}"


@query("sinkhorn_head", _sinkhorn_sql(15))
def sinkhorn_head(spark, sf_dir):
    logits = T.table(spark, sf_dir, "embeddings").select(F.lit("knn").alias(GID), F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return soft.sinkhorn(logits).select("id", F.posexplode("s").alias("k", "s")).select("id", F.col("k").cast("long").alias("k"), rounded(F.col("s")).alias("s"))
