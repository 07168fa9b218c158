"""Steps whose rows, partitions or passes must not grow faster than the tables."""

import re

from pyspark.sql import functions as F

from sylva.operators import graph, moves, pi, search
from sylva.sources import tables as T


def test_suppliers_of_an_order_have_an_edge_each_not_one_a_pair(spark, tmp_path):
    rows = [(1, s) for s in range(200)] + [(2, 199), (2, 300), (3, 400), (3, 400), (4, 500), (4, 501)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = T.shared_orders(spark, str(tmp_path))
    assert edges.count() == 199 + 1 + 1
    found = {r.id: r.c for r in search.connected(edges).collect()}
    assert found == {**{s: 0 for s in range(200)}, 300: 0, 500: 500, 501: 500}


def test_partitions_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(graph, "PART_ROWS", 100)
    rows = spark.range(5000).withColumn("k", F.col("id") % 977)
    assert graph.dealt(rows, 5000, "k").rdd.getNumPartitions() == max(51, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _plan(df, part, capsys):
    capsys.readouterr()
    df.explain(True)
    return capsys.readouterr().out.split(f"== {part} ==")[1].split("\n== ")[0]


def test_a_step_of_pagerank_takes_one_aggregation_and_no_transitions(spark, capsys):
    edges = spark.createDataFrame([("g", 0, 1, 1.0), ("g", 1, 2, 2.0), ("g", 2, 2, 1.0)], "graph_id string, src long, dst long, w double")
    start = spark.createDataFrame([("g", 0, 1.0)], "graph_id string, id long, q double")
    steps = [_plan(pi.ppr(edges, start, iters=k, tol=0.0), "Optimized Logical Plan", capsys).count("Aggregate [") for k in (1, 3)]
    assert steps == [1, 3]


def test_candidates_of_k_communities_are_not_shuffled(spark, capsys):
    edges = spark.createDataFrame([("g", i, j, 1.0) for i in range(9) for j in range(i + 1, 9) if (i + j) % 3], "graph_id string, src long, dst long, w double")
    labels = spark.range(9).select(F.lit("g").alias("graph_id"), "id", (F.col("id") % 3).alias("c"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(moves.best_moves_fixed_k(edges, labels), "Physical Plan", capsys)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plan[plan.index("partial_min") : re.search("Broadcast(HashJoin|NestedLoopJoin)", plan).start()]  # a vertex's best of them is
