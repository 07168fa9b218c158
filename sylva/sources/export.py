"""Graphs and labels as lines of text, and back.

Writers give DataFrames of (line order, line); ``write_lines`` stores them as text in
that order. Readers take any DataFrame of numbered lines, as ``numbered_lines`` makes of a file.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import GID


def edge_lines(edges: DataFrame, one_based: bool = False, weighted: bool = False, sep: str = " ") -> DataFrame:
    """(src, dst, line) for each edge."""
    off = int(one_based)
    parts = [(F.col("src") + off).cast("string"), (F.col("dst") + off).cast("string")] + ([F.col("w").cast("string")] if weighted else [])
    return edges.select("src", "dst", F.concat_ws(sep, *parts).alias("line"))


def community_lines(labels: DataFrame, one_based: bool = True, sep: str = "\t") -> DataFrame:
    """(c, line): the members of each community in order of id, a line each."""
    members = F.transform(F.sort_array(F.collect_list(F.col("id") + int(one_based))), lambda x: x.cast("string"))
    return labels.groupBy(GID, "c").agg(F.array_join(members, sep).alias("line")).select("c", "line")


def label_lines(labels: DataFrame) -> DataFrame:
    """(id, line): one label a line, in order of id."""
    return labels.select("id", F.col("c").cast("string").alias("line"))


def dedoc_lines(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(src, dst, line): the number of vertices, then an edge a line from 1 with its weight."""
    head = vertices.agg(F.count(F.lit(1)).alias("n")).select(F.lit(-1).cast("long").alias("src"), F.lit(-1).cast("long").alias("dst"), F.col("n").cast("string").alias("line"))
    return head.union(edge_lines(edges, one_based=True, weighted=True))


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """Store lines as text files whose names sort in the order of ``order``."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, line) of one text file. It is a single record, so this is for files of labels, not corpora."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line"))


def read_communities(lines: DataFrame, vertices: DataFrame, one_based: bool = True) -> DataFrame:
    """(graph_id, id, c) from numbered lines of members.

    Blank lines don't count, unknown ids are ignored, of several lines the last one counts,
    and vertices in none get communities of their own after the others.
    """
    tokens = lines.where(F.trim("line") != "").select("n", F.explode(F.split(F.trim("line"), r"\s+")).alias("t"))
    order = tokens.select("n").distinct().select("n", (F.row_number().over(Window.orderBy("n")) - 1).alias("c"))
    given = tokens.where(F.col("t").rlike("^-?[0-9]+$")).join(order, "n").groupBy((F.col("t").cast("long") - int(one_based)).alias("id")).agg(F.max("c").alias("c"))
    most = order.agg(F.coalesce(F.max("c"), F.lit(-1)).alias("most"))
    rows = vertices.select(GID, "id").join(given, "id", "left")
    alone = rows.where("c is null").crossJoin(F.broadcast(most)).select(GID, "id", (F.row_number().over(Window.partitionBy(GID).orderBy("id")) + F.col("most")).alias("c"))
    return rows.where("c is not null").select(GID, "id", F.col("c").cast("long").alias("c")).union(alone.select(GID, "id", F.col("c").cast("long").alias("c")))


def write_records(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def read_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """JSON records, or None if there is no such file."""
    reader = spark.read.option("multiLine", path.endswith(".json"))
    try:
        return (reader.schema(schema) if schema else reader).json(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_gml(lines: DataFrame, name: str = "gml") -> tuple[DataFrame, DataFrame]:
    """(edges, vertices) from numbered lines of a GML file; ids by sorted label, truth from ``value``.

    Blocks are found with a running count of their openings; 'Creator' lines don't count.
    """
    from ..operators.graph import canonical

    rows = lines.where(~F.trim("line").startswith("Creator"))
    opened = F.when(F.regexp_extract("line", r"^\s*(node|edge)\b", 1) != "", F.regexp_extract("line", r"^\s*(node|edge)\b", 1))
    rows = rows.withColumn("kind", opened)
    run = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("n", "line", F.count("kind").over(run).alias("block"), F.last("kind", ignorenulls=True).over(run).alias("kind"))
    pairs = rows.select("block", "kind", F.regexp_extract("line", r"^\s*(id|label|value|source|target|weight)\s+", 1).alias("k"), F.regexp_extract("line", r"^\s*\w+\s+\"?([^\"]*?)\"?\s*$", 1).alias("v"))
    wide = pairs.where("k <> ''").groupBy("block", "kind").pivot("k", ["id", "label", "value", "source", "target", "weight"]).agg(F.first("v"))
    nodes = wide.where("kind = 'node'").select(F.col("id").alias("gml_id"), F.coalesce("label", "id").alias("label"), F.col("value").cast("double").cast("long").alias("truth"))
    nodes = nodes.select("gml_id", "label", "truth", (F.row_number().over(Window.orderBy("label")) - 1).cast("long").alias("id"))
    number = nodes.select("gml_id", "id")
    ends = wide.where("kind = 'edge'").join(number.select(F.col("gml_id").alias("source"), F.col("id").alias("src")), "source").join(number.select(F.col("gml_id").alias("target"), F.col("id").alias("dst")), "target")
    edges = canonical(ends.select("src", "dst", F.col("weight").cast("double").alias("weight")), "weight", name)
    return edges, nodes.select(F.lit(name).alias(GID), "id", F.col("id").alias("ord"), "truth")
