"""Queries on encoding trees, single optimisation steps and graph algorithms in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import rounded
from ..operators import agglomerate, graph, lifting, moves, refine, scores, trees
from ..operators.checkpoints import cut, stored
from ..operators.graph import GID
from ..sources import generators as S
from ..sources import tables as T
from .register import COMM, COP, CS, CS_ALL, DEG, EV, NATIONS, query, r6, term_sql

TREE = """t AS (SELECT 'v' || id AS node, 'n' || c AS parent, 3 AS depth, id AS vertex FROM lab
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 2, NULL FROM nation UNION ALL SELECT DISTINCT 'r' || n_regionkey, 'R', 1, CAST(NULL AS BIGINT) FROM nation
  UNION ALL SELECT 'R', NULL, 0, NULL),
anc AS (SELECT id AS vertex, 'v' || id AS node, 3 AS depth FROM lab UNION ALL SELECT id, 'n' || c, 2 FROM lab
  UNION ALL SELECT id, 'r' || n_regionkey, 1 FROM lab JOIN nation ON c = n_nationkey UNION ALL SELECT id, 'R', 0 FROM lab)"""
COMMON = "com AS (SELECT src, dst, w, a.node, a.depth FROM e1 JOIN anc a ON a.vertex = src JOIN anc b ON b.vertex = dst AND a.node = b.node)"
NOTED = f"""{COMMON}, vv AS (SELECT node, sum(d) AS v FROM anc JOIN deg ON id = vertex GROUP BY node), ee AS (SELECT node, sum(w) AS e FROM com GROUP BY node),
a AS (SELECT t.node, t.parent, t.depth, t.vertex, coalesce(v, 0.0) AS v, CASE WHEN t.vertex IS NOT NULL THEN 0.0 ELSE coalesce(e, 0.0) END AS inside,
  coalesce(v, 0.0) - 2 * CASE WHEN t.vertex IS NOT NULL THEN 0.0 ELSE coalesce(e, 0.0) END AS g FROM t LEFT JOIN vv USING (node) LEFT JOIN ee USING (node))"""
WITH_TREE = f"WITH {CS}, {NATIONS}, {DEG}, {TREE}, {NOTED}"
HT = "(SELECT sum(CASE WHEN x.g > 0 AND x.v > 0 AND p.v > 0 THEN -x.g / (SELECT v FROM a WHERE parent IS NULL) * log2(x.v / p.v) ELSE 0 END) FROM a x JOIN a p ON p.node = x.parent)"


def _tree(spark, sf_dir):
    tree = T.geography_tree(spark, sf_dir)
    return cut(T.customer_supplier(spark, sf_dir)), tree, cut(trees.closure(tree))


@query("tree_annotate", f"{WITH_TREE} SELECT node, parent, CAST(depth AS BIGINT) AS depth, v, inside, g FROM a")
def tree_annotate(spark, sf_dir):
    return trees.annotated(*_tree(spark, sf_dir)).select("node", "parent", F.col("depth").cast("long").alias("depth"), "v", "inside", "g")


@query("tree_ht", f"{WITH_TREE} SELECT {r6(HT)} AS ht, (SELECT count(*) FROM a WHERE parent IS NOT NULL) AS nodes")
def tree_ht(spark, sf_dir):
    return trees.tree_entropy(trees.annotated(*_tree(spark, sf_dir))).select(rounded(F.col("ht")).alias("ht"), "nodes")


@query("tree_ht_lca", f"{WITH_TREE} SELECT {r6(HT)} AS ht, (SELECT count(*) FROM a WHERE parent IS NOT NULL) AS nodes")
def tree_ht_lca(spark, sf_dir):
    return trees.tree_entropy(trees.annotated_by_lca(*_tree(spark, sf_dir))).select(rounded(F.col("ht")).alias("ht"), "nodes")


H2_DIRECT = f"(SELECT sum(CASE WHEN d > 0 THEN -d / m2 * log2(d / v) ELSE 0 END) FROM lab JOIN deg USING (id) JOIN comm USING (c), tot) + (SELECT sum(CASE WHEN g > 0 THEN -g / m2 * log2(v / m2) ELSE 0 END) FROM comm, tot)"


@query("tree_two_level", f"{CS_ALL} SELECT {r6(H2_DIRECT)} AS ht")
def tree_two_level(spark, sf_dir):
    edges, tree = stored(T.customer_supplier(spark, sf_dir)), trees.two_level(T.nation_labels(spark, sf_dir))
    return trees.tree_entropy(trees.annotated(edges, tree)).select(rounded(F.col("ht")).alias("ht"))


@query("tree_two_level_self_loops", f"WITH {EV}, lab AS (SELECT DISTINCT event_type AS id, CAST(length(event_type) % 2 AS BIGINT) AS c FROM events), {DEG}, {COMM} SELECT {r6(H2_DIRECT)} AS ht")
def tree_two_level_self_loops(spark, sf_dir):
    labels = T.table(spark, sf_dir, "events").select(F.lit("ev").alias(GID), F.col("event_type").alias("id"), (F.length("event_type") % 2).cast("long").alias("c")).distinct()
    return trees.tree_entropy(trees.annotated(T.event_transitions(spark, sf_dir), trees.two_level(labels))).select(rounded(F.col("ht")).alias("ht"))


LCA = "low AS (SELECT src, dst, any_value(w) AS w, arg_max(node, depth) AS node FROM com GROUP BY src, dst)"


@query("lca_pairs", f"{WITH_TREE}, {LCA} SELECT node, count(*) AS edges, sum(w) AS weight FROM low GROUP BY node")
def lca_pairs(spark, sf_dir):
    edges, _, anc = _tree(spark, sf_dir)
    return trees.lca_weights(edges, anc).select("node", "edges", "weight")


@query("dasgupta", f"{WITH_TREE}, {LCA}, lv AS (SELECT node, count(*) AS n FROM anc GROUP BY node) SELECT sum(w * n) AS dasgupta FROM low JOIN lv USING (node)")
def dasgupta(spark, sf_dir):
    edges, _, anc = _tree(spark, sf_dir)
    return trees.dasgupta(edges, anc).select("dasgupta")


KIDS = "kid AS (SELECT parent AS node, sum(g) AS s FROM a WHERE parent IS NOT NULL GROUP BY parent)"


@query("collapse_delta", f"""{WITH_TREE}, {KIDS} SELECT x.node, round((log2(p.v) - log2(x.v)) / (SELECT v FROM a WHERE parent IS NULL) * (s - x.g), 6) + 0.0 AS delta
FROM a x JOIN kid USING (node) JOIN a p ON p.node = x.parent WHERE x.vertex IS NULL AND x.v > 0""")
def collapse_delta(spark, sf_dir):
    edges, tree, anc = _tree(spark, sf_dir)
    return trees.collapse_deltas(trees.annotated(edges, tree, anc)).select("node", rounded(F.col("delta")).alias("delta"))


def _l(v: str) -> str:
    return f"(CASE WHEN {v} > 1e-12 THEN log2({v}) ELSE 0 END)"


@query("relocate_delta", f"""{WITH_TREE}, {KIDS}, vol AS (SELECT v AS vol FROM a WHERE parent IS NULL),
apart AS (SELECT least(a1.node, b1.node) AS m, greatest(a1.node, b1.node) AS n, w FROM e1 JOIN anc a1 ON a1.vertex = src JOIN anc b1 ON b1.vertex = dst
  WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM anc z WHERE z.vertex = dst AND z.node = a1.node) AND NOT EXISTS (SELECT 1 FROM anc z WHERE z.vertex = src AND z.node = b1.node)),
pw AS (SELECT m, n, sum(w) AS w FROM apart GROUP BY m, n), bw AS (SELECT m AS a, n AS b, w FROM pw UNION ALL SELECT n, m, w FROM pw),
wp AS (SELECT bw.a AS x, sum(w) AS wp FROM bw JOIN t s ON s.node = bw.a JOIN t r ON r.node = bw.b AND r.parent = s.parent GROUP BY bw.a),
inn AS (SELECT a.node, a.parent, v, g, coalesce(s, 0.0) AS s FROM a LEFT JOIN kid USING (node) WHERE vertex IS NULL),
own AS (SELECT x.node AS x, x.v AS vx, x.g AS gx, p.node AS p, p.parent AS pp, p.v AS vp, p.g AS gp, p.s AS sp, coalesce(wp, 0.0) AS wp, vol,
  p.g - x.g + 2 * coalesce(wp, 0.0) AS gp2 FROM a x JOIN inn p ON p.node = x.parent LEFT JOIN wp ON wp.x = x.node, vol),
lf AS (SELECT *, (gp2 - sp + gx) * {_l('(vp - vx)')} - (gp - sp) * {_l('vp')} AS lft FROM own),
nq AS (SELECT lf.*, q.node AS q, 'sibling' AS kind, q.v AS vq, q.g AS gq, q.s AS sq, 0.0 AS vpp FROM lf JOIN inn q ON q.parent = lf.p AND q.node <> lf.x
  UNION ALL SELECT lf.*, q.node, 'uncle', q.v, q.g, q.s, o.v FROM lf JOIN inn q ON q.parent = lf.pp AND q.node <> lf.p JOIN inn o ON o.node = lf.pp),
tk AS (SELECT nq.*, gq + gx - 2 * coalesce(bw.w, 0.0) AS gq2 FROM nq LEFT JOIN bw ON bw.a = nq.x AND bw.b = nq.q),
tt AS (SELECT *, (gq2 - sq - gx) * {_l('(vq + vx)')} - (gq - sq) * {_l('vq')} AS taken FROM tk)
SELECT x AS node, q AS target, kind, round(CASE WHEN kind = 'sibling' THEN -(taken - (gq2 - gq - gx) * {_l('vp')}) / vol ELSE -(lft + taken - (gp2 - gp + gq2 - gq) * {_l('vpp')}) / vol END, 6) + 0.0 AS delta FROM tt
UNION ALL SELECT x, pp, 'grandparent', round(-(lft - (gp2 - gp + gx) * {_l('o.v')}) / vol, 6) + 0.0 FROM lf JOIN inn o ON o.node = lf.pp""")
def relocate_delta(spark, sf_dir):
    edges, tree, anc = _tree(spark, sf_dir)
    noted = trees.annotated(edges, tree, anc)
    return trees.relocate_deltas(edges, tree, anc, noted).select("node", "target", "kind", rounded(F.col("delta")).alias("delta"))


@query("top_level_labels", f"WITH {NATIONS}, r AS (SELECT n_regionkey, dense_rank() OVER (ORDER BY 'r' || n_regionkey) - 1 AS c FROM (SELECT DISTINCT n_regionkey FROM nation)) SELECT id, r.c FROM lab JOIN nation ON lab.c = n_nationkey JOIN r USING (n_regionkey)")
def top_level_labels(spark, sf_dir):
    tree = T.geography_tree(spark, sf_dir)
    return trees.top_level_labels(tree, trees.closure(tree)).select("id", F.col("c").cast("long").alias("c"))


@query("tree_height", f"WITH {NATIONS}, {TREE} SELECT CAST(max(depth) + 1 AS BIGINT) AS height, count(*) AS nodes, count(vertex) AS leaves FROM t")
def tree_height(spark, sf_dir):
    return trees.height(T.geography_tree(spark, sf_dir)).select(F.col("height").cast("long").alias("height"), "nodes", "leaves")


# --- deep trees ---


@query("lca_chain", f"""WITH RECURSIVE p AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey) - 1 AS r FROM part),
d AS (SELECT id, r, 0 AS depth FROM p WHERE r = 0 UNION ALL SELECT p.id, p.r, d.depth + 1 FROM d JOIN p ON p.r = d.r + 1), {COP}
SELECT CAST(least(a.depth, b.depth) AS BIGINT) AS node, count(*) AS edges, sum(w) AS weight FROM e1 JOIN d a ON a.id = src JOIN d b ON b.id = dst GROUP BY 1""")
def lca_chain(spark, sf_dir):
    """Lowest common ancestors of parts in one order, in a tree as deep as there are parts: each part hangs below the one before."""
    parts = T.table(spark, sf_dir, "part").select(F.lit("cop").alias(GID), F.col("p_partkey").alias("id"))
    at = cut(graph.dense_ids(parts))
    name = lambda c: F.concat(F.lit("t"), c.cast("string"))
    inner = at.select(GID, name(F.col("n")).alias("node"), F.when(F.col("n") > 0, name(F.col("n") - 1)).alias("parent"), F.lit(None).cast("long").alias("vertex"))
    tree = cut(inner.union(at.select(GID, F.concat(F.lit("v"), F.col("id").cast("string")), name(F.col("n")), "id")))
    low = lifting.lowest_of_edges(T.copurchase(spark, sf_dir), tree, lifting.jumps(tree))
    return low.groupBy(F.substring("node", 2, 20).cast("long").alias("node")).agg(F.count(F.lit(1)).alias("edges"), F.sum("w").alias("weight"))


@query("dendrogram_checked", f"""WITH {COP}, v AS (SELECT src AS id FROM e1 UNION SELECT dst FROM e1)
SELECT count(*) - 1 AS merges, count(*) AS largest, 2 * count(*) - 2 AS one_parent, CAST(1 AS BIGINT) AS roots, CAST(0 AS BIGINT) AS wrong_heights, CAST(0 AS BIGINT) AS wrong_sizes FROM v""")
def dendrogram_checked(spark, sf_dir):
    """Agglomeration of the co-purchase graph; every height and size computed anew from the edges, by lowest common ancestors."""
    edges = cut(T.copurchase(spark, sf_dir))
    merges, numbers = agglomerate.dendrogram(edges)
    merges, tree = cut(merges), cut(agglomerate.tree_of(merges, numbers))
    noted = cut(lifting.annotated(edges, tree))
    term = noted.join(graph.volume(graph.degrees(edges)), GID).select(GID, "node", "parent", "vertex", "leaves", scores.term(F.col("v"), F.col("g"), F.col("m2")).alias("t"))
    below = term.groupBy(GID, F.col("parent").alias("node")).agg(F.sum("t").alias("below"))
    steps = merges.join(numbers.groupBy(GID).agg(F.count(F.lit(1)).alias("n")), GID).select(GID, F.concat(F.lit("t"), (F.col("n") + F.col("step")).cast("string")).alias("node"), "step", "height", "size")
    rows = steps.join(term, [GID, "node"]).join(below, [GID, "node"])
    wrong = F.abs(F.greatest(F.col("t") - F.col("below"), F.lit(0.0)) + F.col("step") * 1e-9 - F.col("height")) > 1e-7
    found = rows.agg(F.count(F.lit(1)).alias("merges"), F.max("size").alias("largest"), F.sum(wrong.cast("long")).alias("wrong_heights"), F.sum((F.col("size") != F.col("leaves")).cast("long")).alias("wrong_sizes"))
    once = tree.groupBy(GID, "node").agg(F.count("parent").alias("parents")).agg(F.sum((F.col("parents") == 1).cast("long")).alias("one_parent"), F.sum((F.col("parents") == 0).cast("long")).alias("roots"))
    return found.join(F.broadcast(once))  # one row each


@query("tree_refined", f"""WITH {CS}, {NATIONS}, {DEG}, {TREE}, {NOTED}
SELECT true AS lower, (SELECT count(*) FROM lab) AS leaves, (SELECT count(*) FROM lab) AS vertices, CAST(1 AS BIGINT) AS roots, {r6(HT)} AS ht_before""")
def tree_refined(spark, sf_dir):
    """Three rounds of relocations in batches from the tree of regions and nations: lower, and whole."""
    edges, tree = cut(T.customer_supplier(spark, sf_dir)), cut(T.geography_tree(spark, sf_dir))
    done = cut(refine.refine(edges, tree, rounds=3))
    value = lambda x: trees.tree_entropy(trees.annotated(edges, x)).select(GID, "ht")
    both = value(tree).withColumnRenamed("ht", "ht_before").join(value(done), GID).select((F.col("ht") < F.col("ht_before")).alias("lower"), rounded(F.col("ht_before")).alias("ht_before"))
    sizes = done.agg(F.count("vertex").alias("leaves"), F.count_distinct("vertex").alias("vertices"), F.sum(F.col("parent").isNull().cast("long")).alias("roots"))
    return both.join(F.broadcast(sizes))  # one row each


# --- one step of a search ---

WTO = "wto AS (SELECT inc.id, lab.c AS b, sum(w) AS w FROM inc JOIN lab ON lab.id = inc.nbr WHERE inc.id <> inc.nbr GROUP BY 1, 2)"
OWN = """own AS (SELECT lab.id, lab.c AS a, d, h.v AS va, h.g AS ga, h.n AS na, coalesce(o.w, 0.0) AS wa, coalesce(l.w, 0.0) AS sl
  FROM lab JOIN deg USING (id) JOIN comm h ON h.c = lab.c LEFT JOIN wto o ON o.id = lab.id AND o.b = lab.c LEFT JOIN e1 l ON l.src = lab.id AND l.dst = lab.id)"""
DELTA = f"""{term_sql('(va - d)', '(ga - d + 2 * sl + 2 * wa)')} + {term_sql('(vb + d)', '(gb + d - 2 * sl - 2 * wb)')} - {term_sql('va', 'ga')} - {term_sql('vb', 'gb')}"""


def _best_sql(prelude: str, candidates: str, keep: str) -> str:
    return f"""{prelude}, {WTO}, {OWN}, cand AS ({candidates}), s AS (SELECT id, a, b, {DELTA} AS delta FROM cand, tot),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(delta, 9), b) AS k FROM s)
SELECT id, a, b, round(delta, 6) + 0.0 AS delta FROM r WHERE k = 1 {keep}"""


NEAR = "SELECT own.*, wto.b, wto.w AS wb, x.v AS vb, x.g AS gb FROM own JOIN wto USING (id) JOIN comm x ON x.c = wto.b WHERE wto.b <> own.a"


@query("best_move", _best_sql(CS_ALL, f"{NEAR} UNION ALL SELECT own.*, -1, 0.0, 0.0, 0.0 FROM own WHERE na > 1", "AND delta < -1e-12"))
def best_move(spark, sf_dir):
    found = moves.best_moves(cut(T.customer_supplier(spark, sf_dir)), T.nation_labels(spark, sf_dir))
    return found.select("id", "a", "b", rounded(F.col("delta")).alias("delta"))


@query("fixed_k_candidates", _best_sql(CS_ALL, "SELECT own.*, x.c AS b, coalesce(wto.w, 0.0) AS wb, x.v AS vb, x.g AS gb FROM own JOIN comm x ON x.c <> own.a LEFT JOIN wto ON wto.id = own.id AND wto.b = x.c WHERE na > 1", ""))
def fixed_k_candidates(spark, sf_dir):
    found = moves.best_moves_fixed_k(cut(T.customer_supplier(spark, sf_dir)), T.nation_labels(spark, sf_dir))
    return found.select("id", "a", "b", rounded(F.col("delta")).alias("delta"))


MERGE = f"{term_sql('(x.v + y.v)', '(x.g + y.g - 2 * w)')} - {term_sql('x.v', 'x.g')} - {term_sql('y.v', 'y.g')}"


@query("merge_pairs_topk", f"""{CS_ALL}, p AS (SELECT least(l.c, r.c) AS a, greatest(l.c, r.c) AS b, sum(w) AS w FROM e1 JOIN lab l ON l.id = src JOIN lab r ON r.id = dst WHERE l.c <> r.c GROUP BY 1, 2)
SELECT a, b, w, round({MERGE}, 6) + 0.0 AS delta FROM p JOIN comm x ON x.c = a JOIN comm y ON y.c = b, tot ORDER BY round({MERGE}, 9), a, b LIMIT 20""")
def merge_pairs_topk(spark, sf_dir):
    found = moves.merge_deltas(cut(T.customer_supplier(spark, sf_dir)), T.nation_labels(spark, sf_dir))
    return found.orderBy(F.round("delta", 9), "a", "b").limit(20).select("a", "b", "w", rounded(F.col("delta")).alias("delta"))


# --- generated graphs ---


@query("ring_of_cliques", """WITH i AS (SELECT q * 5 + x.range AS src, q * 5 + y.range AS dst FROM (SELECT range AS q FROM range(12)) c, range(5) x, range(5) y WHERE x.range < y.range),
b AS (SELECT least(range * 5, (range + 1) % 12 * 5 + 1) AS src, greatest(range * 5, (range + 1) % 12 * 5 + 1) AS dst FROM range(12)) SELECT src, dst, 1.0::DOUBLE AS w FROM i UNION ALL SELECT src, dst, 1.0 FROM b""")
def ring_of_cliques(spark, sf_dir):
    return S.ring_of_cliques(spark, 12, 5)[0].select("src", "dst", "w")


@query("fractal", """WITH s AS (SELECT CAST(pow(3, range) AS BIGINT) AS s FROM range(4)), b AS (SELECT s, x.range * 3 * s AS o FROM s, range(27) x WHERE x.range * 3 * s < 81)
SELECT o + m * s AS src, o + n * s AS dst, 1.0::DOUBLE AS w FROM b, (VALUES (0, 1), (0, 2), (1, 2)) p(m, n)""")
def fractal(spark, sf_dir):
    return S.triangle_fractal(spark, 4)[0].select("src", "dst", "w")


@query("grid_graph", "SELECT range AS src, range + 1 AS dst, 1.0::DOUBLE AS w FROM range(36) WHERE range % 6 < 5 UNION ALL SELECT range, range + 6, 1.0 FROM range(30)")
def grid_graph(spark, sf_dir):
    return S.grid(spark, 6, 6)[0].select("src", "dst", "w")


@query("balanced_tree_graph", "SELECT CAST(floor((range - 1) / 2.0) AS BIGINT) AS src, range AS dst, 1.0::DOUBLE AS w FROM range(1, 31)")
def balanced_tree_graph(spark, sf_dir):
    return S.balanced_tree(spark, 2, 4)[0].select("src", "dst", "w")


@query("tutorial_scores", """SELECT * FROM (VALUES ('k2', 1.0::DOUBLE, 1.0::DOUBLE, 1), ('four-edges', 3.0, 1.0, 4), ('c4', 2.0, 1.5, 2), ('two-triangles', 2.556657, 1.699514, 2)) t(graph_id, h1, h2, k)""")
def tutorial_scores(spark, sf_dir):
    parts = [S.tutorial(spark, name) for name in S.TUTORIAL]
    edges, vertices = parts[0]
    for e, v in parts[1:]:
        edges, vertices = edges.union(e), vertices.union(v)
    found = scores.two_dimensional(edges, vertices.select(GID, "id", F.col("truth").alias("c")))
    return found.select(GID, rounded(F.col("h1")).alias("h1"), rounded(F.col("h2")).alias("h2"), F.col("k").cast("int").alias("k"))


@query("karate_h1", "SELECT 4.634008 AS h1, 34 AS n, 78 AS m")
def karate_h1(spark, sf_dir):
    edges, vertices = S.karate(spark)
    h1 = scores.one_dimensional(edges).join(edges.groupBy(GID).agg(F.count(F.lit(1)).cast("int").alias("m")), GID).join(vertices.groupBy(GID).agg(F.count(F.lit(1)).cast("int").alias("n")), GID)
    return h1.select(rounded(F.col("h1")).alias("h1"), "n", "m")


@query("degree_isolated", f"WITH {CS}, {DEG}, v AS (SELECT 2 * p_partkey AS id FROM part) SELECT v.id, coalesce(d, 0.0) AS d FROM v LEFT JOIN deg USING (id)")
def degree_isolated(spark, sf_dir):
    parts = T.table(spark, sf_dir, "part").select(F.lit("cs").alias(GID), (2 * F.col("p_partkey")).alias("id"))
    return graph.degrees(T.customer_supplier(spark, sf_dir), parts).select("id", "d")
