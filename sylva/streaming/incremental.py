"""Structural entropy of a growing graph (an extension: there are no streams in batch use).

A stream of steps is turned into signed changes of degrees, volumes and cuts for
each micro-batch; totals are the sum over batches, so that H1 and H2 after
any batch come from three small tables. A batch that is delivered again replaces itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.scalar import plogp
from ..operators.graph import GID, canonical, incidence, labelled
from ..operators.scores import term


def degree_changes(edges: DataFrame) -> DataFrame:
    return incidence(edges).groupBy(GID, "id").agg(F.sum("w").alias("d"))


def community_changes(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(graph_id, c, v, g): what new edges add to volumes and cuts."""
    pair = labelled(edges, labels)
    cut = F.when(F.col("cu") != F.col("cv"), F.col("w")).otherwise(F.lit(0.0))
    ends = F.explode(F.array(F.struct(F.col("cu").alias("c")), F.struct(F.col("cv").alias("c")))).alias("e")
    return pair.select(GID, ends, "w", cut.alias("g")).groupBy(GID, F.col("e.c").alias("c")).agg(F.sum("w").alias("v"), F.sum("g").alias("g"))


class GrowingGraph:
    """Tables of changes in a folder, one part for each batch."""

    def __init__(self, spark: SparkSession, folder: str, labels: DataFrame):
        self.spark, self.folder, self.labels = spark, folder.rstrip("/"), labels

    def apply(self, edges: DataFrame, batch: int) -> None:
        """For ``foreachBatch``: add the batch's edges; again under the same number changes nothing."""
        degree_changes(edges).write.mode("overwrite").parquet(f"{self.folder}/degree/batch={batch}")
        community_changes(edges, self.labels).write.mode("overwrite").parquet(f"{self.folder}/community/batch={batch}")

    def scores(self) -> DataFrame:
        """(graph_id, h1, h2) of all that has come."""
        degree = self.spark.read.parquet(f"{self.folder}/degree").groupBy(GID, "id").agg(F.sum("d").alias("d"))
        comm = self.spark.read.parquet(f"{self.folder}/community").groupBy(GID, "c").agg(F.sum("v").alias("v"), F.sum("g").alias("g"))
        own = degree.groupBy(GID).agg(F.sum("d").alias("m2"), F.sum(plogp(F.col("d"))).alias("s"))
        terms = comm.join(own.select(GID, "m2"), GID).groupBy(GID).agg(F.sum(term(F.col("v"), F.col("g"), F.col("m2"))).alias("t"))
        return own.join(terms, GID).select(GID, (F.log2("m2") - F.col("s") / F.col("m2")).alias("h1"), (F.col("t") - F.col("s") / F.col("m2")).alias("h2"))


def to_batches(changes: DataFrame, path: str) -> DataStreamWriter:
    """A sink for a streamed aggregation: each batch's changed rows as a part of one table; a batch that comes again replaces itself."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return changes.writeStream.outputMode("update").foreachBatch(write)


def latest_of(spark: SparkSession, changes: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """The last row of each key that ``to_batches`` wrote."""
    schema = StructType([*changes.schema.fields, StructField("batch", LongType())])
    spark.createDataFrame([], changes.schema).write.mode("overwrite").parquet(f"{path}/batch=-1")  # a stream without rows has no batch
    values = [c for c in changes.columns if c not in keys]
    last = spark.read.schema(schema).parquet(path).groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return last.select(*[c if c in keys else F.col("v")[c].alias(c) for c in changes.columns])


def windowed_transitions(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", time: str = "ts", state: str = "event_type") -> DataFrame:
    """Counts of states by time window with a watermark, for streams and tables alike."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, window).alias("w"), state).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), state, "n")


def steps_of_batch(events: DataFrame, actor: str = "user_id", state: str = "event_type", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Edges between successive states of each actor within a batch."""
    nxt = F.lead(state).over(Window.partitionBy(actor).orderBy(*order))
    pairs = events.select(F.col(state).alias("src"), nxt.alias("dst")).where("dst is not null")
    return canonical(pairs, graph_id="ev")


def stateful_steps(events: DataFrame, actor: str = "user_id", state: str = "event_type", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """(src, dst) of each actor's successive states over a whole stream: keyed state holds the last state of each actor.

    So the step from one micro-batch to the next isn't lost, and any split of the stream into batches gives the same steps, as long as
    an actor's events come in order between batches; within one they may come in any order. An actor's rows of
    one micro-batch are sorted in one task; ``maxFilesPerTrigger`` bounds them. Null actors are one actor; null states are skipped.
    """

    def steps(_: tuple, chunks: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = list(chunks)
        rows = rows[0] if len(rows) == 1 else pd.concat(rows)
        keys = [rows[c].to_numpy() for c in reversed(order)]
        # An actor has few rows, for which a sort of the frame takes longest of all; objects may be null, which only that one sorts.
        some = rows[state].to_numpy()[np.lexsort(keys)] if all(k.dtype != object for k in keys) else rows.sort_values(list(order))[state]
        now = some.tolist()
        if held.exists:
            now = [held.get[0], *now]
        held.update((now[-1],))
        yield pd.DataFrame({"src": now[:-1], "dst": now[1:]})

    kind = events.schema[state].dataType.simpleString()
    rows = events.where(F.col(state).isNotNull()).select(actor, state, *order).groupBy(actor)
    return rows.applyInPandasWithState(steps, f"src {kind}, dst {kind}", f"last {kind}", "append", GroupStateTimeout.NoTimeout)
