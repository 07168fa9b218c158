"""Soft assignments: entropy, Sinkhorn balancing, normalised adjacency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import stored
from .graph import GID, degrees, few, incidence
from .scores import one_dimensional

EPS = 1e-9


def soft_entropy(edges: DataFrame, soft: DataFrame, eps: float = EPS) -> DataFrame:
    """(graph_id, soft_h2) for ``soft(graph_id, id, s)``, an array of shares for each vertex.

    Volumes and cuts are sums of products of shares; logarithms are clipped to [eps, 1].
    """
    degree = degrees(edges)
    long = soft.select(GID, "id", F.posexplode("s").alias("k", "s"))
    vol = long.join(degree, [GID, "id"]).groupBy(GID, "k").agg(F.sum(F.col("d") * F.col("s")).alias("v"))
    there = long.select(GID, F.col("id").alias("nbr"), "k", F.col("s").alias("t"))
    inner = incidence(edges).join(long, [GID, "id"]).join(there, [GID, "nbr", "k"]).groupBy(GID, "k").agg(F.sum(F.col("w") * F.col("s") * F.col("t")).alias("inner"))
    total = degree.groupBy(GID).agg(F.sum("d").alias("m2"))
    rows = vol.join(inner, [GID, "k"], "left").join(total, GID)
    pv, pc = F.col("v") / F.col("m2"), (F.col("v") - F.coalesce("inner", F.lit(0.0))) / F.col("m2")
    log = F.log2(F.least(F.greatest(pv, F.lit(eps)), F.lit(1.0)))
    sums = rows.groupBy(GID).agg(F.sum(pv * log - pc * log).alias("x"))
    return sums.join(one_dimensional(edges, degree), GID).select(GID, (F.col("x") + F.col("h1")).alias("soft_h2"))


def sinkhorn(logits: DataFrame, rounds: int = 15, tau: float = 1.0) -> DataFrame:
    """``logits(graph_id, id, x)`` balanced: rows sum to 1, columns to n / K; (graph_id, id, s).

    Rows are scaled by their sums wherever they are read, so what a round changes is one factor for each column: it is
    an aggregation over the columns of the stored logits, and its result a row for each graph.
    """
    top = F.array_max("x")
    base = stored(logits.select(GID, "id", F.transform("x", lambda v: F.exp((v - top) / tau)).alias("s")))
    times = few(base.groupBy(GID).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("s")).alias("k")).select(GID, "n", F.array_repeat(F.lit(1.0), F.col("k")).alias("c")))

    def shares(times: DataFrame) -> DataFrame:
        rows = base.join(times, GID).select(GID, "id", "n", "c", F.zip_with("s", "c", lambda v, c: v * c).alias("s"))
        total = F.aggregate("s", F.lit(0.0), lambda a, v: a + v)
        return rows.select(GID, "id", "n", "c", F.transform("s", lambda v: v / total).alias("s"))

    for _ in range(rounds):
        cells = shares(times).select(GID, "n", F.size("s").alias("size"), F.posexplode(F.arrays_zip("s", "c")).alias("k", "x"))
        sums = cells.groupBy(GID, "k").agg(F.sum("x.s").alias("v"), F.first("x.c").alias("c"), F.first("n").alias("n"), F.first("size").alias("size"))
        column = F.struct("k", (F.col("c") * F.col("n") / (F.col("v") * F.col("size"))).alias("c"))
        times = few(sums.groupBy(GID).agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(column)), lambda e: e["c"]).alias("c")))
    return shares(times).select(GID, "id", "s")


def normalised_adjacency(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(graph_id, src, dst, a), src <= dst: D^-1/2 (A + I) D^-1/2, D being the row sums of A + I."""
    vertices = degrees(edges).select(GID, "id") if vertices is None else vertices
    with_self = edges.select(GID, "src", "dst", "w").union(vertices.select(GID, F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w")))
    with_self = with_self.groupBy(GID, "src", "dst").agg(F.sum("w").alias("w"))
    ends = F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst"))
    sums = with_self.select(GID, F.explode(ends).alias("id"), "w").groupBy(GID, "id").agg(F.sum("w").alias("t"))
    u, v = sums.select(GID, F.col("id").alias("src"), F.col("t").alias("tu")), sums.select(GID, F.col("id").alias("dst"), F.col("t").alias("tv"))
    return with_self.join(u, [GID, "src"]).join(v, [GID, "dst"]).select(GID, "src", "dst", (F.col("w") / F.sqrt(F.col("tu") * F.col("tv"))).alias("a"))
