"""One entry for computing structural entropy of one or many graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lifting, scores, search, trees
from ..operators.graph import GID


def structural_entropy(edges: DataFrame, partition: DataFrame | None = None, *, dim: int = 2, tree: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """(graph_id, entropy). A tree counts before ``dim``; without a partition the best found is scored."""
    if tree is not None:
        return trees.tree_entropy(trees.annotated(edges, tree)).select(GID, F.col("ht").alias("entropy"))
    if dim == 1:
        return scores.one_dimensional(edges).select(GID, F.col("h1").alias("entropy"))
    if dim == 2:
        labels = partition if partition is not None else search.cut(search.se_louvain(edges, k=k) if k else search.optimise(edges))
        return scores.two_dimensional(edges, labels).select(GID, F.col("h2").alias("entropy"))
    raise ValueError("dim is 1 or 2, or a tree is given")


def report(edges: DataFrame, k: int | None = None, seed: int = 0) -> DataFrame:
    """One row for each graph: n, m, se_1d, se_2d_optimal, num_communities, se_tree_optimal, compression_2d.

    A graph of over ``search.KERNEL_EDGES`` edges, which no task takes whole, has its partition for a tree.
    """
    edges = search.cut(edges)
    labels = search.cut(search.se_louvain(edges, k=k, seed=seed) if k else search.optimise(edges, seed=seed))
    large = edges.groupBy(GID).count().where(F.col("count") > search.KERNEL_EDGES).select(GID)
    flat = scores.two_dimensional(edges, labels)
    deep = _tree_entropy(edges.join(large, GID, "left_anti"), seed).union(trees.tree_entropy(trees.annotated(edges.join(large, GID, "left_semi"), trees.two_level(labels.join(large, GID, "left_semi")))))
    sizes = edges.groupBy(GID).agg(F.count(F.lit(1)).alias("m")).join(labels.groupBy(GID).agg(F.count(F.lit(1)).alias("n")), GID)
    h1, h2 = F.col("h1"), F.col("h2")
    return sizes.join(flat, GID).join(deep, GID).select(
        GID, "n", "m", F.round(h1, 6).alias("se_1d"), F.round(h2, 6).alias("se_2d_optimal"), F.col("k").alias("num_communities"),
        F.round("ht", 6).alias("se_tree_optimal"), F.when(h1 > 0, F.round((h1 - h2) / h1, 4)).otherwise(F.lit(0.0)).alias("compression_2d"),
    )


def _tree_entropy(edges: DataFrame, seed: int) -> DataFrame:
    """(graph_id, ht, nodes) of the encoding trees found, which may be deep."""
    tree = search.cut(search.encoding_trees(edges, seed=seed))
    return trees.tree_entropy(lifting.annotated(edges, tree))
