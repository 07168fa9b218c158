"""Weighted undirected graphs as DataFrames.

``edges(graph_id, src, dst, w)`` has one row for each pair of vertices, ``src <= dst``;
a row with ``src = dst`` is a self-loop. ``labels(graph_id, id, c)`` is a partition.
All operators work on any number of graphs at once, told apart by ``graph_id``.

Scale: everything here is joins and sums on vertex or community ids with partial
aggregation. A hub's edges are spread over its neighbours' partitions; joins on
hub vertices may be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import stored

GID = "graph_id"
#: Rows of one for each graph may be sent to all tasks if there are no more.
MOST_GRAPHS = 100_000
#: Rows of a partition, about, where their number is known beforehand.
PART_ROWS = 1 << 20


def sent(rows: DataFrame) -> DataFrame:
    """``rows`` of one for each graph, to be sent to all tasks if they are few: joined by a shuffle, a graph's rows would meet in one task."""
    return F.broadcast(rows) if rows.count() <= MOST_GRAPHS else rows


def few(rows: DataFrame) -> DataFrame:
    """``sent`` of rows that are computed and stored first."""
    return sent(stored(rows))


def dealt(rows: DataFrame, count: int, *keys: str) -> DataFrame:
    """``rows``, about ``count`` of them, by ``keys``: partitions don't grow with the input beyond ``PART_ROWS``, but by large keys."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(width, count // PART_ROWS + 1), *keys)


def canonical(pairs: DataFrame, weight: str | None = None, graph_id: str = "g") -> DataFrame:
    """Edges from rows with ``src`` and ``dst`` in any order; weights of equal pairs add up, a missing one is 1."""
    gid = F.col(GID) if GID in pairs.columns else F.lit(graph_id)
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    rows = pairs.select(gid.alias(GID), F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), w.alias("w"))
    return rows.groupBy(GID, "src", "dst").agg(F.sum("w").alias("w"))


def incidence(edges: DataFrame) -> DataFrame:
    """(graph_id, id, nbr, w): each edge from both ends; a self-loop twice."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("nbr")), F.struct(F.col("dst").alias("id"), F.col("src").alias("nbr"))))
    return edges.select(GID, ends.alias("e"), "w").select(GID, "e.id", "e.nbr", "w")


def degrees(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(graph_id, id, d): weighted degree; a self-loop counts twice, a vertex without edges 0 if ``vertices`` lists it."""
    found = incidence(edges).groupBy(GID, "id").agg(F.sum("w").alias("d"))
    if vertices is None:
        return found
    return vertices.select(GID, "id").join(found, [GID, "id"], "left").withColumn("d", F.coalesce("d", F.lit(0.0)))


def loops(edges: DataFrame) -> DataFrame:
    return edges.where("src = dst").select(GID, F.col("src").alias("id"), F.col("w").alias("sl"))


def volume(degree: DataFrame) -> DataFrame:
    """(graph_id, m2): twice the total weight."""
    return degree.groupBy(GID).agg(F.sum("d").alias("m2"))


def labelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with the communities of both ends, cu and cv."""
    u = labels.select(GID, F.col("id").alias("src"), F.col("c").alias("cu"))
    v = labels.select(GID, F.col("id").alias("dst"), F.col("c").alias("cv"))
    return edges.join(u, [GID, "src"]).join(v, [GID, "dst"])


def communities(edges: DataFrame, labels: DataFrame, degree: DataFrame | None = None) -> DataFrame:
    """(graph_id, c, v, g, n): volume, cut and size of each community; self-loops aren't cut."""
    degree = degrees(edges, labels) if degree is None else degree
    vol = labels.join(degree, [GID, "id"]).groupBy(GID, "c").agg(F.sum("d").alias("v"), F.count(F.lit(1)).alias("n"))
    crossing = labelled(edges, labels).where("cu <> cv").select(GID, F.explode(F.array("cu", "cv")).alias("c"), "w")
    cut = crossing.groupBy(GID, "c").agg(F.sum("w").alias("g"))
    return vol.join(cut, [GID, "c"], "left").select(GID, "c", "v", F.coalesce("g", F.lit(0.0)).alias("g"), "n")


def contracted(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The graph of communities: weights between them add up, weights within become self-loops."""
    pairs = labelled(edges, labels).select(GID, F.col("cu").alias("src"), F.col("cv").alias("dst"), "w")
    return canonical(pairs, "w")


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges whose ends are both among ``members(graph_id, id)``."""
    u, v = members.select(GID, F.col("id").alias("src")), members.select(GID, F.col("id").alias("dst"))
    return edges.join(u, [GID, "src"], "left_semi").join(v, [GID, "dst"], "left_semi").select(GID, "src", "dst", "w")


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def first_seen(labels: DataFrame, order: str = "id") -> DataFrame:
    """Labels renumbered from 0 in the order in which ``order`` first meets them."""
    from .ranking import numbered

    fresh = numbered(labels.groupBy(GID, "c").agg(F.min(order).alias("o")), [GID], [F.col("o")], "fresh").drop("o")
    return labels.join(fresh, [GID, "c"]).select(GID, "id", F.col("fresh").alias("c"))


def dense_labels(labels: DataFrame) -> DataFrame:
    """Labels renumbered from 0 in order of their values."""
    from .ranking import numbered

    fresh = numbered(labels.select(GID, "c").distinct(), [GID], [F.col("c")], "fresh")
    return labels.join(fresh, [GID, "c"]).select(GID, "id", F.col("fresh").alias("c"))


def dense_ids(vertices: DataFrame) -> DataFrame:
    """(graph_id, id, n): vertices numbered from 0 in order of id."""
    from .ranking import numbered

    return numbered(vertices.select(GID, "id").distinct(), [GID], [F.col("id")])
