"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: what ``spark.checkpoint.dir`` names, which all executors share.

    Where the session names none, one is set: a temporary folder if everything runs on
    this machine, as in tests, else one beside the warehouse's tables.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        local = context.master.startswith("local") and not context.master.startswith("local-cluster")
        own = tempfile.mkdtemp(prefix="sylva-checkpoint-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the session's checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a compressed table in the checkpoint folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 16 << 20).parquet(path)  # a task buffers one row group
    return df.sparkSession.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the test data, with only the columns asked for."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def latest(slot: str, key, make: Callable):
    """``make()``, made once for ``key`` in each Python process; a slot holds one value."""
    store = sys.__dict__.setdefault("_sylva_latest", {})
    if slot not in store or store[slot][0] != key:
        store.pop(slot, None)
        store[slot] = (key, make())
    return store[slot][1]


def tidied(scan: Callable) -> Callable:
    """``scan``, a function for mapInArrow, for worker processes that go on to other stages.

    Values of ``latest`` made in another stage, as a tokenizer's tables, are dropped before it; memory that is free is given back to the system after it.
    """

    def run(batches: Iterator) -> Iterator:
        stage, store = TaskContext.get().stageId(), sys.__dict__.setdefault("_sylva_latest", {})
        if sys.__dict__.get("_sylva_stage") != stage:
            store.clear()
            sys.__dict__["_sylva_stage"] = stage
        try:
            yield from scan(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None  # not in every C library
            if trim:
                trim(0)

    return run


def sha256_text(column: Column) -> Column:
    """Lowercase hex SHA-256 of a string column's UTF-8 bytes."""
    return F.sha2(column.cast("binary"), 256)


def text_hash(text: Column) -> Column:
    """A 64-bit hash that tells rows apart which share a doc_id; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def staying(docs: DataFrame, stay: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose (doc_id, text_hash) is in ``stay``, with all columns, one for each pair."""
    chosen = stay.select(F.col("doc_id").alias("stay_id"), F.col("text_hash").alias("stay_hash")).alias("s")
    rows = docs.alias("d")
    found = rows.join(chosen, F.col(f"d.{doc_id}").eqNullSafe(F.col("s.stay_id")) & (text_hash(F.col(f"d.{text}")) == F.col("s.stay_hash")), "left_semi")
    repeats = not docs.groupBy(doc_id).count().where("count > 1").isEmpty()
    return found.dropDuplicates([doc_id, text]) if repeats else found


def split_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner equi-join whose hot keys Spark may split.

    Adaptive execution splits a partition of a join only if both sides come
    straight from a shuffle that the join asked for. A key more, a small number that
    the others fix, makes it ask for one on a side that is already partitioned by ``on``.
    """
    key = F.pmod(F.xxhash64(*on), F.lit(251))
    return left.withColumn("_key", key).join(right.withColumn("_key", key), ["_key", *on]).drop("_key")
