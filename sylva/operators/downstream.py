"""Uses of partitions: rewiring, views, pooling, exploration bonus, uncertainty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from .graph import GID, few, canonical, contracted, labelled
from .ranking import running

# --- rewiring ---


def dropped_edges(edges: DataFrame, labels: DataFrame, sim: DataFrame, fraction: float = 0.05) -> DataFrame:
    """(graph_id, src, dst, sim): of the edges between communities the ``fraction`` with the least similarity.

    ``sim(graph_id, src, dst, sim)`` covers them; equal similarities go by src, dst. The
    cut is found from counts by similarity, so that only edges at its very value are ranked.
    """
    cross = labelled(edges, labels).where("cu <> cv").select(GID, "src", "dst").join(sim, [GID, "src", "dst"])
    values = cross.groupBy(GID, "sim").agg(F.count(F.lit(1)).alias("n"))
    upto = running(values, [GID], "sim", ["n"]).withColumn("upto", F.col("before_n") + F.col("n"))
    total = values.groupBy(GID).agg(F.floor(F.sum("n") * fraction).alias("most"))
    cutoff = upto.join(total, GID).withColumn("room", F.col("most") - F.col("upto") + F.col("n")).where("room > 0").select(GID, "sim", "n", "room")
    rows = cross.join(cutoff, [GID, "sim"])
    place = F.row_number().over(Window.partitionBy(GID, "sim").orderBy("src", "dst"))
    some = rows.where("n > room").withColumn("place", place).where("place <= room").drop("place")
    return rows.where("n <= room").unionByName(some).select(GID, "src", "dst", "sim")


def added_edges(edges: DataFrame, pairs: DataFrame, add: int = 2, least: int = 3) -> DataFrame:
    """(graph_id, src, dst): the ``add`` most similar of each vertex within its community that aren't edges yet.

    ``pairs(graph_id, u, v, block, sim)`` has both directions; blocks of fewer than ``least`` vertices get none.
    """
    sizes = pairs.groupBy(GID, "block").agg(F.count_distinct("u").alias("size")).where(F.col("size") >= least).select(GID, "block")
    order = Window.partitionBy(GID, "u").orderBy(F.col("sim").desc(), "v")
    near = pairs.join(sizes, [GID, "block"], "left_semi").withColumn("place", F.row_number().over(order)).where(F.col("place") <= add)
    both = near.select(GID, F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).distinct()
    return both.join(edges.select(GID, "src", "dst"), [GID, "src", "dst"], "left_anti")


def rewired(edges: DataFrame, labels: DataFrame, pairs: DataFrame, sim: DataFrame, add: int = 2, fraction: float = 0.05) -> DataFrame:
    """Edges without the dropped and with the added ones, weight 1."""
    drop = dropped_edges(edges, labels, sim, fraction)
    kept = edges.select(GID, "src", "dst").join(drop, [GID, "src", "dst"], "left_anti")
    return canonical(kept.union(added_edges(edges, pairs, add)).distinct())


def symmetric(edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst): both directions of each edge, self-loops once."""
    return edges.select(GID, "src", "dst").union(edges.where("src <> dst").select(GID, F.col("dst").alias("src"), F.col("src").alias("dst")))


# --- views ---


def drop_probabilities(edges: DataFrame, labels: DataFrame, intra: float = 0.6, inter: float = 0.1) -> DataFrame:
    """(graph_id, src, dst, p, uniform): chance to be dropped by kind of edge, and the mean over the graph's edges."""
    kinds = labelled(edges, labels).select(GID, "src", "dst", F.when(F.col("cu") == F.col("cv"), intra).otherwise(inter).alias("p"))
    mean = kinds.groupBy(GID).agg(F.avg("p").alias("uniform"))
    return kinds.join(few(mean), GID)


def view(probabilities: DataFrame, seed: int, column: str = "p") -> DataFrame:
    """A random view of the edges, the same for one seed on any cluster."""
    draw = F.pmod(F.xxhash64(F.lit(seed), GID, "src", "dst"), F.lit(1 << 40)) / float(1 << 40)
    return probabilities.where(draw >= F.col(column)).select(GID, "src", "dst")


def masked_features(vectors: DataFrame, seed: int, share: float = 0.2, column: str = "x") -> DataFrame:
    """``vectors`` with the same random features set to zero in every row."""
    draw = lambda i: F.pmod(F.xxhash64(F.lit(seed), i), F.lit(1 << 40)) / float(1 << 40)
    return vectors.withColumn(column, F.transform(column, lambda v, i: F.when(draw(i) < share, F.lit(0.0)).otherwise(v.cast("double"))))


# --- pooling ---


def mean_pooled(labels: DataFrame, vectors: DataFrame, column: str = "x") -> DataFrame:
    """(graph_id, c, k, mean): mean of each feature over each community."""
    long = labels.join(vectors, [GID, "id"]).select(GID, "c", F.posexplode(column).alias("k", "v"))
    return long.groupBy(GID, "c", "k").agg(F.avg(F.col("v").cast("double")).alias("mean"))


def pooled_adjacency(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(graph_id, src, dst, a): weight between communities, both directions within one counted, over the row's sum."""
    both = contracted(edges, labels)
    rows = both.select(GID, "src", "dst", F.when(F.col("src") == F.col("dst"), 2 * F.col("w")).otherwise(F.col("w")).alias("w"))
    rows = rows.union(rows.where("src <> dst").select(GID, F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    total = rows.groupBy(GID, "src").agg(F.sum("w").alias("t"))
    return rows.join(total, [GID, "src"]).select(GID, "src", "dst", ratio(F.col("w"), F.col("t")).alias("a"))


# --- exploration ---


def visit_counts(steps: DataFrame, actor: str, state: str, order: list[str]) -> DataFrame:
    """``steps`` with ``visits``: how often the actor has been in the state up to now."""
    before = Window.partitionBy(actor, state).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("visits", F.count(F.lit(1)).over(before))


def bonus(visits: Column, cluster_visits: Column | None = None, beta: float = 0.05) -> Column:
    own = beta / F.sqrt(visits.cast("double"))
    return own if cluster_visits is None else own + beta / F.sqrt(cluster_visits.cast("double"))


# --- uncertainty ---


def token_similarity(answers: DataFrame) -> DataFrame:
    """(qid, i, j, p), i < j: Jaccard similarity of the word sets of a question's answers(qid, i, text).

    Answers of one question are joined on shared words; pairs without any have similarity 0 and no row.
    """
    words = answers.select("qid", "i", F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != ""))).alias("w"))
    sizes = words.groupBy("qid", "i").agg(F.count(F.lit(1)).alias("n"))
    a, b = words, words.select("qid", F.col("i").alias("j"), "w")
    shared = a.join(b, ["qid", "w"]).where("i < j").groupBy("qid", "i", "j").agg(F.count(F.lit(1)).alias("s"))
    rows = shared.join(sizes, ["qid", "i"]).join(sizes.select("qid", F.col("i").alias("j"), F.col("n").alias("m")), ["qid", "j"])
    return rows.select("qid", "i", "j", (F.col("s") / (F.col("n") + F.col("m") - F.col("s"))).alias("p"))


def answer_graph(similarity: DataFrame, least: float = 0.05) -> DataFrame:
    """Edges between answers of one question; smaller similarities are noise."""
    return canonical(similarity.where(F.col("p") >= least).select(F.col("qid").cast("string").alias(GID), F.col("i").alias("src"), F.col("j").alias("dst"), "p"), "p")


def uncertainty(answers: DataFrame, similarity: DataFrame, least: float = 0.05) -> DataFrame:
    """(qid, n, score): entropy of the answers' graph under its best partition; log2 of their number if none are alike."""
    from . import search
    from .scores import two_dimensional

    edges = search.cut(answer_graph(similarity, least))
    vertices = answers.select(F.col("qid").cast("string").alias(GID), F.col("i").alias("id")).join(edges.select(GID).distinct(), GID, "left_semi")
    labels = search.cut(search.se_louvain(edges, vertices, starts=2))
    found = two_dimensional(edges, labels).select(F.col(GID).alias("qid"), "h2")
    sizes = answers.groupBy(F.col("qid").cast("string").alias("qid")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(found, "qid", "left").select("qid", "n", F.coalesce("h2", F.log2(F.greatest(F.col("n"), F.lit(2)).cast("double"))).alias("score"))


# --- tables of facets ---


def facet_matrix(tags: DataFrame, row_facet: str, column_facet: str, order: str = "year") -> DataFrame:
    """(row, col, n, keys): keys(key, facet, value, year) that carry both values, in order."""
    r = tags.where(F.col("facet") == row_facet).select("key", F.col("value").alias("row"), order)
    c = tags.where(F.col("facet") == column_facet).select("key", F.col("value").alias("col"))
    cells = r.join(c, "key").distinct().groupBy("row", "col").agg(F.count_distinct("key").alias("n"), F.array_sort(F.collect_set(F.struct(order, "key"))).alias("k"))
    return cells.select("row", "col", "n", F.transform("k", lambda x: x["key"]).alias("keys"))


def folds(rows: DataFrame, key: str, by: str, k: int = 10, seed: int = 0) -> DataFrame:
    """``rows`` with ``fold`` 1..k: shares of equal size within each value of ``by``, in the order of a seeded hash."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return rows.withColumn("fold", F.ntile(k).over(Window.partitionBy(by).orderBy(order, key)))


def set_operations(members: DataFrame, a, b) -> DataFrame:
    """(op, key): the intersection, the union and the difference (except) of sets ``a`` and ``b`` of ``members(set, key)``.

    All three come from one aggregation by key; a null key is a key like others.
    """
    sides = members.where(F.col("set").isin(a, b)).groupBy("key").agg(F.bool_or(F.col("set") == F.lit(a)).alias("a"), F.bool_or(F.col("set") == F.lit(b)).alias("b"))
    ops = [F.when(F.col("a") & F.col("b"), F.lit("intersect")), F.lit("union"), F.when(F.col("a") & ~F.col("b"), F.lit("except"))]
    return sides.select(F.explode(F.array_compact(F.array(*ops))).alias("op"), "key")
