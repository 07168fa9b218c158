"""Scores of graphs and partitions, one row for each graph.

Entropies are in bits. All scores need one pass over the edges and two over the
vertices; ``communities`` may be computed once and handed to several scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import plogp, ratio, xlog
from .graph import GID, communities, degrees, few, volume


def one_dimensional(edges: DataFrame, degree: DataFrame | None = None) -> DataFrame:
    """(graph_id, h1): entropy of the degree distribution, 0 for a graph without edges."""
    degree = degrees(edges) if degree is None else degree
    # sum d/m2 * log2(d/m2) = (sum d log2 d) / m2 - log2 m2, so that one aggregation is enough
    sums = degree.groupBy(GID).agg(F.sum("d").alias("m2"), F.sum(plogp(F.col("d"))).alias("s"))
    return sums.select(GID, F.when(F.col("m2") > 0, F.log2("m2") - F.col("s") / F.col("m2")).otherwise(F.lit(0.0)).alias("h1"))


def two_dimensional(edges: DataFrame, labels: DataFrame, comm: DataFrame | None = None, degree: DataFrame | None = None) -> DataFrame:
    """(graph_id, h1, h2, k): entropies of the graph and of the partition, and the number of communities.

    H2 = const + sum of the communities' terms, const = -(sum d log2 d) / m2.
    """
    degree = degrees(edges, labels) if degree is None else degree
    comm = communities(edges, labels, degree) if comm is None else comm
    own = degree.groupBy(GID).agg(F.sum("d").alias("m2"), F.sum(plogp(F.col("d"))).alias("s"))
    terms = comm.join(own.select(GID, "m2"), GID)
    total = terms.groupBy(GID).agg(F.sum(term(F.col("v"), F.col("g"), F.col("m2"))).alias("terms"), F.count(F.lit(1)).alias("k"))
    some = F.col("m2") > 0
    return own.join(total, GID).select(
        GID,
        F.when(some, F.log2("m2") - F.col("s") / F.col("m2")).otherwise(F.lit(0.0)).alias("h1"),
        F.when(some, F.col("terms") - F.col("s") / F.col("m2")).otherwise(F.lit(0.0)).alias("h2"),
        "k",
    )


def term(v: Column, g: Column, m2: Column) -> Column:
    """A community's part of H2 but for the constant: (v log2 v - g log2(v/m2)) / m2."""
    return ratio(plogp(v) - xlog(g, ratio(v, m2)), m2)


def constant(degree: DataFrame) -> DataFrame:
    """(graph_id, const): the part of H2 that no partition changes."""
    return degree.groupBy(GID).agg((-ratio(F.sum(plogp(F.col("d"))), F.sum("d"))).alias("const"))


def breakdown(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(graph_id, c, n, v, g, module, within): both parts of H2 for each community."""
    degree = degrees(edges, labels)
    comm = communities(edges, labels, degree)
    inside = labels.join(degree, [GID, "id"]).groupBy(GID, "c").agg(F.sum(plogp(F.col("d"))).alias("s"))
    m2 = F.col("m2")
    rows = comm.join(inside, [GID, "c"]).join(volume(degree), GID)
    return rows.select(
        GID, "c", "n", "v", "g",
        (-ratio(xlog(F.col("g"), ratio(F.col("v"), m2)), m2)).alias("module"),
        ratio(plogp(F.col("v")) - F.col("s"), m2).alias("within"),
    )


def modularity(comm: DataFrame, degree: DataFrame) -> DataFrame:
    """(graph_id, modularity): null for a graph without edges."""
    m2 = F.col("m2")
    part = (F.col("v") - F.col("g")) / m2 - F.pow(F.col("v") / m2, 2)
    return comm.join(volume(degree), GID).groupBy(GID).agg(F.sum(F.when(m2 > 0, part)).alias("modularity"))


def map_equation(comm: DataFrame, degree: DataFrame) -> DataFrame:
    """(graph_id, map_equation): two-level description length."""
    m2 = F.col("m2")
    own = degree.groupBy(GID).agg(F.sum("d").alias("m2"), F.sum(plogp(F.col("d"))).alias("s"))
    sums = comm.join(own.select(GID, "m2"), GID).groupBy(GID).agg(
        F.sum(ratio(F.col("g"), m2)).alias("q"),
        F.sum(plogp(ratio(F.col("g"), m2))).alias("exits"),
        F.sum(plogp(ratio(F.col("g") + F.col("v"), m2))).alias("both"),
    )
    visits = F.when(m2 > 0, F.col("s") / m2 - F.log2(m2)).otherwise(F.lit(0.0))
    return own.join(sums, GID).select(GID, F.when(m2 > 0, plogp(F.col("q")) - 2 * F.col("exits") - visits + F.col("both")).otherwise(F.lit(0.0)).alias("map_equation"))


def cross_objective(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(graph_id, modularity, map_equation, structural_entropy_2d, num_communities)."""
    degree = degrees(edges, labels)
    comm = communities(edges, labels, degree)
    h2 = two_dimensional(edges, labels, comm, degree).select(GID, F.col("h2").alias("structural_entropy_2d"), F.col("k").alias("num_communities"))
    return modularity(comm, degree).join(map_equation(comm, degree), GID).join(h2, GID)


def contingency(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(graph_id, t, p, n): how many vertices have truth t and label p."""
    t = truth.select(GID, "id", F.col("c").alias("t"))
    return t.join(found.select(GID, "id", F.col("c").alias("p")), [GID, "id"]).groupBy(GID, "t", "p").agg(F.count(F.lit(1)).alias("n"))


def agreement(table: DataFrame) -> DataFrame:
    """(graph_id, ari, nmi) of a contingency table.

    Adjusted Rand index: 1 if both partitions are trivial and equal. Mutual information
    over the mean of the entropies: 1 if both have one community, 0 without information.
    """
    rows = table.groupBy(GID, "t").agg(F.sum("n").alias("a"))
    cols = table.groupBy(GID, "p").agg(F.sum("n").alias("b"))
    pairs = lambda x: x * (x - 1) / 2
    n, a, b = F.col("n").cast("double"), F.col("a").cast("double"), F.col("b").cast("double")
    cell = table.groupBy(GID).agg(F.sum("n").alias("total"), F.sum(pairs(n)).alias("nij"), F.sum(plogp(n)).alias("sij"))
    row = rows.groupBy(GID).agg(F.sum(pairs(a)).alias("ai"), F.sum(plogp(a)).alias("si"), F.count(F.lit(1)).alias("kt"))
    col = cols.groupBy(GID).agg(F.sum(pairs(b)).alias("bj"), F.sum(plogp(b)).alias("sj"), F.count(F.lit(1)).alias("kp"))
    x = F.col
    total = x("total").cast("double")
    expected = ratio(x("ai") * x("bj"), pairs(total))
    most = (x("ai") + x("bj")) / 2
    ari = F.when(most == expected, F.lit(1.0)).otherwise(ratio(x("nij") - expected, most - expected))
    # entropies from sums of n log2 n: H = log2 N - s / N
    ht, hp = F.log2(total) - x("si") / total, F.log2(total) - x("sj") / total
    mutual = F.greatest(ht + hp - (F.log2(total) - x("sij") / total), F.lit(0.0))
    nmi = F.when((x("kt") == 1) & (x("kp") == 1), F.lit(1.0)).when(mutual <= 1e-15, F.lit(0.0)).otherwise(mutual / ((ht + hp) / 2))
    return cell.join(row, GID).join(col, GID).select(GID, ari.alias("ari"), nmi.alias("nmi"))


def matched_accuracy(table: DataFrame) -> DataFrame:
    """(graph_id, acc): share of vertices right under the best one-to-one matching of labels.

    The contingency table of a graph, with a row for each pair of labels, is one task's.
    """
    import pandas as pd

    from .kernels.assign import best_matching

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot_table(index="t", columns="p", values="n", aggfunc="sum", fill_value=0).to_numpy()
        return pd.DataFrame({GID: [rows[GID].iloc[0]], "acc": [best_matching(wide) / wide.sum()]})

    return table.groupBy(GID).applyInPandas(match, f"{GID} string, acc double")


def block_f1(labels: DataFrame, block: DataFrame, query: DataFrame) -> DataFrame:
    """(graph_id, f1): how well the query vertex's community recovers a block.

    ``block(graph_id, id)`` has the true members, ``query(graph_id, id)`` one vertex for each graph.
    """
    inside = block.select(GID, "id", F.lit(1).alias("true"))
    home = query.join(labels, [GID, "id"]).select(GID, F.col("c").alias("home"))
    rows = labels.join(few(home), GID).join(inside, [GID, "id"], "left")
    true, found = F.coalesce("true", F.lit(0)), (F.col("c") == F.col("home")).cast("int")
    sums = rows.groupBy(GID).agg(F.sum(true * found).alias("tp"), F.sum(found).alias("found"), F.sum(true).alias("size"))
    return sums.select(GID, F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (F.col("found") + F.col("size"))).otherwise(F.lit(0.0)).alias("f1"))


def auroc(scored: DataFrame, score: str = "score", positive: str = "positive", by: str | None = None) -> DataFrame:
    """Area under the ROC curve by the rank sum, ties at their mean rank.

    Rows are first summed up by score value; ranks are running sums over values.
    """
    from .ranking import running

    keys = [by] if by else ["_all"]
    rows = scored if by else scored.withColumn("_all", F.lit(0))
    values = rows.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(positive).cast("long")).alias("pos"))
    ranked = running(values, keys, score, ["n"]).select(*keys, "n", "pos", (F.col("before_n") + (F.col("n") + 1) / 2.0).alias("rank"))
    sums = ranked.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"), F.sum(F.col("pos") * F.col("rank")).alias("r"))
    p, q = F.col("p"), F.col("q")
    return sums.select(*([by] if by else []), F.when((p > 0) & (q > 0), (F.col("r") - p * (p + 1) / 2.0) / (p * q)).alias("auroc"))
