"""Graphs from the relational test tables. Ids: customer k is 2k, supplier k is 2k + 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import dot, norm
from ..operators.graph import GID, canonical, dealt
from ..operators.neighbours import nearest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who bought from whom; weight is the number of order lines."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    pairs = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return canonical(pairs.select((2 * F.col("o_custkey")).alias("src"), (2 * F.col("l_suppkey") + 1).alias("dst")), graph_id="cs")


def _parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select((2 * F.col("c_custkey")).alias("id"), F.col("c_nationkey").alias("nation"))
    suppliers = table(spark, sf_dir, "supplier").select((2 * F.col("s_suppkey") + 1).alias("id"), F.col("s_nationkey").alias("nation"))
    return customers.union(suppliers)


def nation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parties(spark, sf_dir).select(F.lit("cs").alias(GID), "id", F.col("nation").cast("long").alias("c"))


def geography_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, regions, nations, customers and suppliers."""
    gid, none = F.lit("cs").alias(GID), F.lit(None).cast("long").alias("vertex")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    leaves = _parties(spark, sf_dir).select(gid, name("v", "id").alias("node"), name("n", "nation").alias("parent"), F.lit(3).alias("depth"), F.col("id").alias("vertex"))
    middle = nations.select(gid, name("n", "n_nationkey").alias("node"), name("r", "n_regionkey").alias("parent"), F.lit(2).alias("depth"), none)
    upper = nations.select("n_regionkey").distinct().select(gid, name("r", "n_regionkey").alias("node"), F.lit("R").alias("parent"), F.lit(1).alias("depth"), none)
    root = nations.limit(1).select(gid, F.lit("R").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), none)
    return leaves.union(middle).union(upper).union(root)


def copurchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in one order; weight is the number of line pairs. An order has few lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    a, b = lines.withColumnRenamed("l_partkey", "src"), lines.withColumnRenamed("l_partkey", "dst")
    return canonical(a.join(b, "l_orderkey").where("src < dst"), graph_id="cop")


def shared_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of one order, each linked to the order's first: no more edges than lines, with the components of all pairs."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("dst"))
    lines = dealt(lines, lines.count(), "l_orderkey").withColumn("src", F.min("dst").over(Window.partitionBy("l_orderkey")))
    pairs = lines.where("src < dst").select("src", "dst")
    return pairs.distinct().select(F.lit("s").alias(GID), "src", "dst", F.lit(1.0).alias("w"))


def size_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.lit("cop").alias(GID), F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("c"))


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, src, dst): each event type with the user's next."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select("user_id", F.col("event_type").alias("src"), F.lead("event_type").over(order).alias("dst")).where("dst is not null")


def event_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(event_steps(spark, sf_dir), graph_id="ev")


def similar_pairs(vectors: DataFrame, block: str, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(graph_id, u, v, block, sim), u <> v: cosine of vectors in one block, to nine places."""
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(block).alias("block"), F.col(embedding).alias("x"), norm(F.col(embedding)).alias("n"))
    a = rows.select(F.col("id").alias("u"), "block", F.col("x").alias("xu"), F.col("n").alias("nu"))
    b = rows.select(F.col("id").alias("v"), "block", F.col("x").alias("xv"), F.col("n").alias("nv"))
    sim = F.round(dot(F.col("xu"), F.col("xv")) / F.greatest(F.col("nu") * F.col("nv"), F.lit(1e-12)), 9)
    return a.join(b, "block").where("u <> v").select(F.lit("knn").alias(GID), "u", "v", "block", sim.alias("sim"))


def nearest_pairs(vectors: DataFrame, block: str, k: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Of the rows of ``similar_pairs`` the ``k`` of largest cosine for each u; vectors of length zero have none."""
    near = nearest(vectors, k, vec_id, embedding, within=block)
    blocks = vectors.select(F.col(vec_id).alias("u"), F.col(block).alias("block")).distinct()
    return near.join(blocks, "u").select(F.lit("knn").alias(GID), "u", "v", "block", "sim")


def knn_graph(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """Vectors linked to their ``k`` nearest of all; weight 1 or, if mutual, 2."""
    near = nearest(table(spark, sf_dir, "embeddings"), k)
    return canonical(near.select(F.col("u").alias("src"), F.col("v").alias("dst")), graph_id="knn")


def vector_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.lit("knn").alias(GID), F.col("vec_id").alias("id"), F.col("label").cast("long").alias("c"))
