"""Experiments composed of the operators: each is a grid of runs in one job."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions.scalar import rounded
from ..operators import search, trees
from ..operators.checkpoints import cut
from ..operators.graph import GID
from ..operators.kernels import partition as P
from ..operators.kernels import rooms, soft
from ..operators.kernels import trees as K
from ..sources import generators as S
from ..sources import tables as T
from . import benchmark
from .register import CS, DEG, NATIONS, query
from .tree_queries import NOTED, TREE

HIERARCHIES = {
    "average": lambda net: K.from_merges(net, P.linkage(P.hops(net), "average")),
    "complete": lambda net: K.from_merges(net, P.linkage(P.hops(net), "complete")),
    "ward": lambda net: K.from_merges(net, P.linkage(P.hops(net), "ward")),
    "paris": lambda net: K.from_merges(net, P.paris(net)),
    "louvain_two_level": lambda net: K.from_labels(net, P.multilevel(net, "modularity", 0)),
    "se_agglomerative": lambda net: K.from_merges(net, P.agglomerated(net)),
    "se_hier": lambda net: K.encoding_tree(net),
}


@query("hierarchy")
def hierarchy(spark, sf_dir):
    """Tree entropy and Dasgupta cost of hierarchies on three graphs, the best of each graph flagged."""
    graphs = [S.karate(spark), S.caveman(spark, 4, 6), S.sbm(spark, 120, 4, 0.3, 0.03, seed=2)]
    edges, vertices = graphs[0]
    for e, v in graphs[1:]:
        edges, vertices = edges.union(e), vertices.union(v)
    names = F.explode(F.array(*map(F.lit, HIERARCHIES))).alias("method")

    def run(key, e, v):
        net, _ = search.net_of(e, v)
        tree = HIERARCHIES[key[1]](net)
        return pd.DataFrame({"dataset": [key[0]], "method": [key[1]], "ht": [tree.entropy()], "dasgupta": [tree.dasgupta()], "height": [tree.height()]})

    found = edges.select("*", names).groupBy(GID, "method").cogroup(search.renewed(vertices.select("*", names)).groupBy(GID, "method"))
    rows = cut(found.applyInPandas(run, "dataset string, method string, ht double, dasgupta double, height int"))
    best = benchmark.flagged_best(rows, "ht", tolerance=1e-6)
    return best.select("dataset", "method", rounded(F.col("ht")).alias("ht"), rounded(F.col("dasgupta")).alias("dasgupta"), "height", "best")


@query("robustness")
def robustness(spark, sf_dir):
    """Mean and half range of the agreement over three draws of each graph."""
    draws = [(f"{name}:{g}", *make(g)) for g in range(3) for name, make in (("sbm", lambda g: S.sbm(spark, 120, 3, 0.2, 0.05, seed=g)), ("lfr", lambda g: S.lfr(spark, 150, 0.3, g, 12, 30, 2.5, 1.5, 20, 50)))]
    records = benchmark.run_grid(spark, draws, ["louvain", "leiden", "infomap", "se_louvain"], [0])
    rows = records.withColumn("dataset", F.split("dataset", ":")[0])
    found = benchmark.spread(rows, "ari")
    return found.select("dataset", "method", *[rounded(F.col(c)).alias(c) for c in ("mean", "half_range", "std")], "n")


@query("gnn_heads")
def gnn_heads(spark, sf_dir):
    """Final loss and H2 of the graph convolution by head and seed on the karate club."""
    edges, vertices = S.karate(spark)
    grid = [f"{head}:{seed}" for head in soft.HEADS for seed in range(3)]
    runs = F.explode(F.array(*map(F.lit, grid))).alias("run")

    def run(key, e, v):
        net, _ = search.net_of(e, v)
        head, seed = key[0].split(":")
        labels, loss = soft.fit(net, None, 4, int(seed), head=head)
        return pd.DataFrame({"head": [head], "seed": [int(seed)], "loss": [loss], "h2": [P.entropy(net, labels)]})

    found = edges.select("*", runs).groupBy("run").cogroup(search.renewed(vertices.select("*", runs)).groupBy("run")).applyInPandas(run, "head string, seed int, loss double, h2 double")
    return found.select("head", "seed", rounded(F.col("loss"), 4).alias("loss"), rounded(F.col("h2"), 4).alias("h2"))


@query("exploration")
def exploration(spark, sf_dir):
    """Four rooms: first solved episode, solved episodes and cells seen, by bonus and seed."""
    grid = spark.createDataFrame([(b, s) for b in ("none", "count", "se") for s in range(2)], "bonus string, seed int")

    def run(key, rows):
        first, solved, seen = rooms.explore(key[0], seed=int(key[1]))
        return pd.DataFrame({"bonus": [key[0]], "seed": [key[1]], "first": [first], "solved": [solved], "seen": [seen]})

    return grid.groupBy("bonus", "seed").applyInPandas(run, "bonus string, seed int, first int, solved int, seen int")


@query("crosscheck_tree", f"""WITH {CS}, {NATIONS}, {DEG}, {TREE}, {NOTED},
x AS (SELECT p.node, w FROM e1 JOIN anc p ON p.vertex = src WHERE NOT EXISTS (SELECT 1 FROM anc q WHERE q.vertex = dst AND q.node = p.node)
  UNION ALL SELECT p.node, w FROM e1 JOIN anc p ON p.vertex = dst WHERE NOT EXISTS (SELECT 1 FROM anc q WHERE q.vertex = src AND q.node = p.node)), g2 AS (SELECT node, sum(w) AS g2 FROM x GROUP BY node)
SELECT round(max(abs(a.g - coalesce(g2, 0.0))), 9) + 0.0 AS difference, count(*) AS nodes FROM a LEFT JOIN g2 USING (node)""")
def crosscheck_tree(spark, sf_dir):
    """Largest difference of cuts between the two ways of annotating a tree."""
    tree, edges = T.geography_tree(spark, sf_dir), cut(T.customer_supplier(spark, sf_dir))
    anc = cut(trees.closure(tree))
    one = trees.annotated(edges, tree, anc).select(GID, "node", F.col("g").alias("g1"))
    two = trees.annotated_by_lca(edges, tree, anc).select(GID, "node", F.col("g").alias("g2"))
    both = one.join(two, [GID, "node"])
    return both.agg(rounded(F.max(F.abs(F.col("g1") - F.col("g2"))), 9).alias("difference"), F.count(F.lit(1)).alias("nodes"))
