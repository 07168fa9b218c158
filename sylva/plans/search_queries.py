"""Queries that search for partitions and trees, and the benchmark; SQL can't express these."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import rounded
from ..operators import pi as pi_ops
from ..operators import graph, hops, leiden, scores, search, trees
from ..operators.graph import GID
from ..operators.kernels import partition as P
from ..operators.kernels import pi as pi_kernel
from ..sources import generators as S
from ..sources import tables as T
from . import benchmark, facade, registry
from .register import CS, EV, query


def _scored(edges, labels):
    labels = search.cut(labels)
    found = scores.cross_objective(edges, labels)
    return found.select(GID, *[rounded(F.col(c)).alias(c) for c in ("modularity", "map_equation", "structural_entropy_2d")], "num_communities")


def _method(name: str, k: int | None = None):
    @query(name)
    def run(spark, sf_dir):
        edges = search.cut(T.knn_graph(spark, sf_dir))
        return _scored(edges, registry.get(name).fit_predict(edges, k=k))

    run.__doc__ = f"Scores of {name} on the nearest-neighbour graph."
    return run


for _name, _k in (("louvain", None), ("leiden", None), ("infomap", None), ("spectral", 10), ("se_agglomerative", 10), ("se_gnn", 10), ("se_hier", None)):
    _method(_name, _k)


@query("se_louvain")
def se_louvain(spark, sf_dir):
    """Best of eight starts, each a task, on the customer-supplier graph; synchronous rounds where that is too large for one."""
    edges = search.cut(T.customer_supplier(spark, sf_dir))
    return _scored(edges, search.optimise(edges))


@query("se_louvain_k")
def se_louvain_k(spark, sf_dir):
    edges = search.cut(T.knn_graph(spark, sf_dir))
    return _scored(edges, search.se_louvain(edges, k=10))


@query("se_fixed_k")
def se_fixed_k(spark, sf_dir):
    edges = search.cut(T.knn_graph(spark, sf_dir))
    return _scored(edges, search.se_fixed_k(edges, 10))


@query("se_distributed")
def se_distributed(spark, sf_dir):
    """Synchronous rounds and contraction on the co-purchase graph."""
    edges = search.cut(T.copurchase(spark, sf_dir))
    return _scored(edges, search.distributed_search(edges))


@query("leiden_distributed", f"""WITH {CS}, v AS (SELECT src AS id FROM e1 UNION SELECT dst FROM e1)
SELECT count(*) AS vertices, count(*) AS labelled, CAST(0 AS BIGINT) AS split_modules, true AS at_least_the_start, true AS at_least_nations FROM v""")
def leiden_distributed(spark, sf_dir):
    """Modules of the customer-supplier graph: all connected, and modularity above that of single vertices and not below that of nations."""
    edges = search.cut(T.customer_supplier(spark, sf_dir))
    labels = search.cut(leiden.leiden(edges))
    parts = leiden.connected_parts(edges, labels)
    split = parts.join(labels.withColumnRenamed("c", "module"), [GID, "id"]).groupBy(GID, "module").agg(F.count_distinct("c").alias("parts"))
    everyone = search.vertices_of(edges)
    score = lambda x: scores.modularity(graph.communities(edges, x), graph.degrees(edges)).first()["modularity"]
    found = score(labels)
    start, nations = score(everyone.withColumn("c", F.col("id"))), score(T.nation_labels(spark, sf_dir).join(everyone, [GID, "id"], "left_semi"))
    counts = everyone.join(labels, [GID, "id"], "left").agg(F.count(F.lit(1)).alias("vertices"), F.count("c").alias("labelled"))
    wrong = split.agg(F.sum((F.col("parts") > 1).cast("long")).alias("split_modules"))
    return counts.join(F.broadcast(wrong)).select("vertices", "labelled", "split_modules", F.lit(found >= start).alias("at_least_the_start"), F.lit(found >= nations).alias("at_least_nations"))  # one row each


@query("se_dendrogram")
def se_dendrogram(spark, sf_dir):
    return search.dendrogram(search.cut(T.knn_graph(spark, sf_dir))).select("step", "left", "right", rounded(F.col("height"), 9).alias("height"), "size")


@query("se_tree")
def se_tree(spark, sf_dir):
    """Entropy of the encoding tree found for the karate club, by the relational score."""
    edges, vertices = S.karate(spark)
    tree = search.cut(search.encoding_trees(edges, vertices))
    return trees.tree_entropy(trees.annotated(edges, tree)).select(GID, rounded(F.col("ht")).alias("ht"), "nodes")


def _set_partitions(n: int) -> str:
    grow = "".join(f", s{i} AS (SELECT list_append(l, k) AS l, greatest(m, k) AS m FROM s{i - 1}, range({n}) t(k) WHERE k <= m + 1)" for i in range(1, n))
    return f"s0 AS (SELECT [CAST(0 AS BIGINT)] AS l, CAST(0 AS BIGINT) AS m){grow}"


@query("exhaustive_minimum", f"""WITH {EV}, {_set_partitions(5)}, ids AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM (SELECT DISTINCT src AS id FROM e1 UNION SELECT DISTINCT dst FROM e1)),
inc AS (SELECT src AS id, dst AS nbr, w FROM e1 UNION ALL SELECT dst, src, w FROM e1), deg AS (SELECT id, sum(w) AS d FROM inc GROUP BY id), tot AS (SELECT sum(d) AS m2 FROM deg),
p AS (SELECT row_number() OVER () AS p, l FROM s4), lab AS (SELECT p, id, l[k] AS c FROM p, ids), vol AS (SELECT p, c, sum(d) AS v FROM lab JOIN deg USING (id) GROUP BY p, c),
cut AS (SELECT a.p, a.c, sum(w) AS g FROM inc JOIN lab a ON a.id = inc.id JOIN lab b ON b.id = inc.nbr AND b.p = a.p WHERE a.c <> b.c GROUP BY a.p, a.c),
h AS (SELECT p, (SELECT -sum(d * log2(d)) / any_value(m2) FROM deg, tot) + sum((v * log2(v) - CASE WHEN g > 0 THEN g * log2(v / m2) ELSE 0 END) / m2) AS h FROM vol LEFT JOIN cut USING (p, c), tot GROUP BY p)
SELECT round(min(h), 6) + 0.0 AS h2 FROM h""")
def exhaustive_minimum(spark, sf_dir):
    """The least H2 of the event graph over all partitions."""
    edges = search.cut(T.event_transitions(spark, sf_dir))
    labels = search.cut(search.per_graph(edges, lambda net, s: P.exhaustive(net)[1]))
    return scores.two_dimensional(edges, labels).select(rounded(F.col("h2")).alias("h2"))


@query("pi_search")
def pi_search(spark, sf_dir):
    """Modules around one vertex of a block model by PageRank, and how well they find its block."""
    edges, vertices = S.sbm(spark, 160, 8, 0.25, 0.02, seed=3)
    edges, vertices = search.cut(edges), search.cut(vertices)

    def run(net, seed):
        return pi_kernel.search(net, pi_kernel.ppr(net, 0), pi_kernel.ppr_transition(net, 0), seed=seed)

    labels = search.cut(search.per_graph(edges, run, vertices))
    start = vertices.where("id = 0").select(GID, "id", F.lit(1.0).alias("q"))
    value = pi_ops.ppr_pi_entropy(pi_ops.ppr(edges, start, iters=40), edges, labels, start)
    return scores.block_f1(labels, vertices.where("truth = 0"), start.select(GID, "id")).join(value, GID).select(rounded(F.col("f1")).alias("f1"), rounded(F.col("h_pi")).alias("h_pi"))


@query("random_matched")
def random_matched(spark, sf_dir):
    edges = search.cut(T.knn_graph(spark, sf_dir))
    return _scored(edges, registry.clusters("random_matched", edges))


@query("benchmark_records")
def benchmark_records(spark, sf_dir):
    found = benchmark.benchmark(spark, ["louvain", "leiden", "infomap", "spectral", "se_louvain", "se_agglomerative", "dedoc"], seeds=range(2))
    return found.select("method", "is_se", "dataset", "seed", *[rounded(F.col(c)).alias(c) for c in ("ari", "nmi", "modularity", "map_equation", "structural_entropy_2d")], "num_communities", "n", "m", "k_true")


@query("resolution")
def resolution(spark, sf_dir):
    """Methods on rings of cliques: communities found and agreement with the cliques."""
    rings = [(f"ring-{r}", *S.ring_of_cliques(spark, r, 5)) for r in (8, 16, 24, 32)]
    found = benchmark.run_grid(spark, rings, ["louvain", "leiden", "se_louvain"], [0])
    return found.select("dataset", "method", rounded(F.col("ari")).alias("ari"), rounded(F.col("structural_entropy_2d")).alias("h2"), "num_communities")


@query("se_report")
def se_report(spark, sf_dir):
    return facade.report(S.karate(spark)[0])


@query("connected_components", """WITH RECURSIVE e AS (SELECT DISTINCT a.l_suppkey AS u, b.l_suppkey AS v FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_suppkey <> b.l_suppkey),
r AS (SELECT u AS id, u AS c FROM e UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.id) SELECT id, min(c) AS c FROM r GROUP BY id""")
def connected_components(spark, sf_dir):
    """Suppliers linked by shared orders."""
    return search.connected(T.shared_orders(spark, sf_dir)).select("id", "c")


@query("hop_sums", f"""WITH RECURSIVE {CS}, inc AS (SELECT src AS id, dst AS nbr FROM e1 UNION ALL SELECT dst, src FROM e1), n AS (SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n),
r AS (SELECT 2 * s_suppkey + 1 AS source, 2 * s_suppkey + 1 AS id, 0 AS hops FROM supplier UNION SELECT r.source, inc.nbr, r.hops + 1 FROM r JOIN inc USING (id) WHERE r.hops < 6),
d AS (SELECT source, id, min(hops) AS hops FROM r GROUP BY 1, 2)
SELECT source, count(*) AS reached, CAST(sum(hops) + (n - count(*)) * n AS BIGINT) AS total, CAST(max(hops) AS BIGINT) AS eccentricity FROM d, n GROUP BY source, n""")
def hop_sums(spark, sf_dir):
    """Hops from each supplier to all customers and suppliers along orders."""
    vertices = T.nation_labels(spark, sf_dir).select(GID, "id")
    found = hops.hop_sums(T.customer_supplier(spark, sf_dir), vertices, vertices.where("id % 2 = 1"))
    return found.select("source", "reached", "total", "eccentricity")


@query("diameter", f"""WITH RECURSIVE {CS}, inc AS (SELECT src AS id, dst AS nbr FROM e1 UNION ALL SELECT dst, src FROM e1),
two AS (SELECT DISTINCT x.id, y.nbr FROM inc x JOIN inc y ON x.nbr = y.id WHERE x.id % 2 = 1),
r AS (SELECT DISTINCT id AS source, id, 0 AS hops FROM two UNION SELECT r.source, two.nbr, r.hops + 2 FROM r JOIN two USING (id) WHERE r.hops < 12),
d AS (SELECT source, id, min(hops) AS hops FROM r GROUP BY 1, 2),
near AS (SELECT d.source, inc.id, min(d.hops) + 1 AS hops FROM inc JOIN d ON d.id = inc.nbr WHERE inc.id % 2 = 0 GROUP BY 1, 2),
far AS (SELECT inc.id AS customer, near.id, min(near.hops) + 1 AS hops FROM inc JOIN near ON near.source = inc.nbr WHERE inc.id % 2 = 0 AND inc.id <> near.id GROUP BY 1, 2)
SELECT CAST(greatest((SELECT max(hops) FROM d), (SELECT max(hops) FROM near), (SELECT max(hops) FROM far)) AS BIGINT) AS diameter""")
def diameter(spark, sf_dir):
    """The most hops between two customers or suppliers along orders."""
    return hops.diameter(T.customer_supplier(spark, sf_dir)).select("diameter")


@query("hop_distance", """WITH RECURSIVE b AS (SELECT range AS id, range % 6 AS x, range // 6 AS y FROM range(36)) SELECT s.id AS source, b.id, CAST(abs(b.x - s.x) + abs(b.y - s.y) AS BIGINT) AS hops FROM b, b s WHERE s.id IN (0, 14)""")
def hop_distance(spark, sf_dir):
    edges, vertices = S.grid(spark, 6, 6)
    return search.hop_distances(edges, vertices.where("id in (0, 14)")).select("source", "id", F.col("hops").cast("long").alias("hops"))
