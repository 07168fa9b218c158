"""Exact dedup by content sort.

Texts are normalised by deleting ASCII white space. Sampled splitters
range-partition the normalised texts, an external sort places equal texts next
to each other, and each row is compared in full with the neighbour before it: a row that
differs begins a group. Of a group, the row with the most code points in its original text
stays, then the smallest ``doc_id``.

A sort key is a text's first ``PREFIX_BYTES`` bytes and its XXH64; the full text follows in the sort within
a range. Equal texts have equal keys, so a group lies within one range and ends where neighbours differ.

Hot groups. Range partitioning can't split a key, so a key that has more rows than an even partition is
dealt out to further ranges by a salt, and only such keys are: there are at most as many as partitions, and they
are all that is broadcast. A group's parts, one in each range, are then stitched:
the first rows of parts are sorted and each is compared in full with its neighbour, as everywhere.

Scale. The texts are read once to count keys, once to sample splitters and once for the sort, which shuffles them once. What
follows moves ids, digests and the first texts of the parts of hot groups, which are at most two for each partition.

Defined results: a null text counts as empty; a null ``doc_id`` comes after all
others; of rows that agree in everything, one stays; an empty table gives an
empty result; further columns are kept by :func:`exact_dedup`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut, sha256_text, staying, table, text_hash, width

#: The characters that normalisation deletes.
WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
PREFIX_BYTES = 64

def normalised(text: Column) -> Column:
    return reduce(lambda c, w: F.replace(c, F.lit(w), F.lit("")), WHITE, F.coalesce(text, F.lit("")))


def key_hash(norm: str) -> Column:
    return F.xxhash64(norm)


KEY = ("head", "norm_hash", "salt")


def content_sorted(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows in order of content, with the group that each is in by comparison with its neighbour.

    head, norm_hash, salt, run: the part of a group; place: the row's in it, the best first; members; best, the
    first row's (shorter, none, doc_id, text_hash); part_text: the normalised text, at the first rows of parts of hot groups.
    """
    wide = width(docs.sparkSession)
    source = docs.select(
        F.col(doc_id).alias("doc_id"),
        normalised(F.col(text)).alias("norm"),
        (-F.length(F.coalesce(F.col(text), F.lit("")))).cast("long").alias("shorter"),
        text_hash(F.col(text)).alias("text_hash"),
    ).withColumn("norm_hash", key_hash("norm"))
    counts = source.groupBy("norm_hash").agg(F.count(F.lit(1)).alias("n"))
    total = docs.count()
    # Fewer than ``wide`` keys can each have more than the wide-th part of all rows.
    hot = F.broadcast(counts.where(F.col("n") * wide > total).select("norm_hash", F.ceil(F.col("n") * wide / max(total, 1)).alias("parts")))
    keyed = source.join(hot, "norm_hash", "left").select(
        "doc_id", "norm", "shorter", "text_hash", "norm_hash",
        F.substring(F.col("norm").cast("binary"), 1, PREFIX_BYTES).alias("head"),
        F.coalesce(F.pmod(F.xxhash64("doc_id", "text_hash"), F.col("parts")) + 1, F.lit(0)).cast("int").alias("salt"),
    )
    best = ["shorter", F.col("doc_id").asc_nulls_last(), "text_hash"]
    along = Window.partitionBy(*KEY).orderBy("norm", *best)
    differs = F.coalesce(F.col("norm") != F.lag("norm").over(along), F.lit(True))
    runs = keyed.repartitionByRange(*KEY).withColumn("new", differs.cast("int")).withColumn("run", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    narrow = runs.select(
        "doc_id", "shorter", "text_hash", *KEY, "run", "new",
        sha256_text(F.col("norm")).alias("text_sha256"),
        F.when((F.col("salt") > 0) & (F.col("new") == 1), F.col("norm")).alias("part_text"),
    )
    part = Window.partitionBy(*KEY, "run").orderBy(*best)
    whole = part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row = F.struct("shorter", F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    return (
        narrow.withColumn("place", F.row_number().over(part))
        .withColumn("members", F.count(F.lit(1)).over(whole))
        .withColumn("best", F.first(row).over(whole))
        .drop("new", "shorter")
    )


def stitched(rows: DataFrame) -> DataFrame:
    """(head, norm_hash, salt, run, whole): for each part of a hot group its group's size and best row, and where that one is."""
    parts = rows.where("part_text is not null").select(*KEY, "run", "members", "best", "part_text")
    along = Window.partitionBy("head", "norm_hash").orderBy("part_text", "salt", "run")
    differs = F.coalesce(F.col("part_text") != F.lag("part_text").over(along), F.lit(True)).cast("int")
    joined = parts.withColumn("new", differs).withColumn("id", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy("head", "norm_hash", "id")
    best = F.min(F.struct("best", "salt", "run")).over(group)
    return joined.select(*KEY, "run", F.struct(F.sum("members").over(group).alias("size"), best.alias("first")).alias("whole"))


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, text_hash.

    ``text_hash`` (64-bit, of the original text) tells rows apart that share a doc_id.
    """
    rows = cut(content_sorted(docs, text, doc_id))
    # At most two parts for each partition.
    both = rows.join(F.broadcast(stitched(rows)), [*KEY, "run"], "left")
    first = F.col("whole.first")
    own = first.isNull() | ((first["salt"] == F.col("salt")) & (first["run"] == F.col("run")))
    return both.select(
        "doc_id",
        F.when(first.isNull(), F.col("best.doc_id")).otherwise(first["best"]["doc_id"]).alias("keep_id"),
        F.coalesce("whole.size", "members").alias("group_size"),
        ((F.col("place") == 1) & own).alias("kept"),
        "text_sha256",
        "text_hash",
    )


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all of their columns.

    Rows that share doc_id and text are one choice; the other columns of the one
    that stays are those of any of them.
    """
    return staying(docs, exact_groups(docs, text, doc_id).where("kept"), text, doc_id)


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), n AS (
  SELECT doc_id, length(text) AS n, regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM d
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents", "doc_id", "text"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
