"""Row numbers without a window over all rows.

Rows are range-sorted; a row's number is its place in its partition and the
number of its group's rows in the partitions before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import cut


def numbered(rows: DataFrame, by: list[str], order: list, name: str = "n") -> DataFrame:
    """``rows`` with ``name``: 0, 1, ... within each group of ``by``, in ``order``.

    ``order`` should leave no ties. The sorted rows are stored, so that both uses of
    their partitions see the same ones.
    """
    keys = [*map(F.col, by), *order]
    placed = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    sizes = placed.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_part", "_first", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return placed.join(offsets, [*by, "_part"]).select(*rows.columns, (F.col("_offset") + F.col("_at") - F.col("_first")).alias(name))


def running(values: DataFrame, by: list[str], order: str, sums: list[str]) -> DataFrame:
    """``values`` with ``before_<x>`` for each column of ``sums``: its sum over earlier rows of the group.

    As ``numbered``: sums within a range partition, and the sums of those before.
    """
    keys = [*by, order]
    placed = cut(values.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("_part")))
    sizes = placed.groupBy(*by, "_part").agg(*[F.sum(x).alias(f"_t_{x}") for x in sums])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_part", *[F.coalesce(F.sum(f"_t_{x}").over(before), F.lit(0)).alias(f"_o_{x}") for x in sums])
    inside = Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.join(offsets, [*by, "_part"])
    return rows.select(*values.columns, *[(F.col(f"_o_{x}") + F.coalesce(F.sum(x).over(inside), F.lit(0))).alias(f"before_{x}") for x in sums])
