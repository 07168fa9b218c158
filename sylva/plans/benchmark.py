"""Methods on data sets: one job for the whole grid, scores in one query.

Every (data set, method, seed) is a graph of its own, ``dataset|method|seed``, so that
the runs are groups of one job and all partitions are scored together.
"""

from __future__ import annotations

import time
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import fixed
from ..operators import scores, search
from ..operators.graph import GID
from ..sources.generators import REGISTRY
from . import registry

DEFAULT = ("Karate", "SBM-Clean", "SBM-Noisy")
RECORD = ("method", "is_se", "dataset", "seed", "ari", "nmi", "modularity", "map_equation", "structural_entropy_2d", "num_communities", "time_s", "n", "m", "k_true")


def load(spark: SparkSession, spec) -> tuple[str, DataFrame, DataFrame]:
    """A data set by name, by function of the session, or as (name, edges, vertices)."""
    if isinstance(spec, str):
        return spec, *REGISTRY[spec](spark)
    if callable(spec):
        edges, vertices = spec(spark)
        return getattr(spec, "__name__", "data"), edges, vertices
    return spec


def run_grid(spark: SparkSession, datasets: Iterable, names: Iterable[str], seeds: Iterable[int]) -> DataFrame:
    """(graph_id, id, c, time_s) of every run; a failing run gives no rows."""
    seeds, edges, vertices, runs = list(seeds), None, None, []
    for spec in datasets:
        name, e, v = load(spark, spec)
        e, v = e.withColumn(GID, F.lit(name)), v.withColumn(GID, F.lit(name)).select(GID, "id", "ord", "truth")
        edges, vertices = (e, v) if edges is None else (edges.union(e), vertices.union(v))
        for m in map(registry.get, names):
            if m.native:
                runs += [(name, m.name, s) for s in (seeds[:1] if m.deterministic else seeds)]
    grid = F.broadcast(spark.createDataFrame(runs, f"{GID} string, method string, seed int"))
    fns = {m: registry.get(m).fn for m in {r[1] for r in runs}}

    def run(key, e: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        net, ids = search.net_of(e, v)
        k = v["truth"].nunique()
        began = time.perf_counter()
        try:
            labels = fns[key[1]](net, int(k) or None, int(key[2]))
        except Exception:  # as a benchmark does: this run is left out, the others go on
            return pd.DataFrame(columns=[GID, "id", "c", "time_s"])
        return pd.DataFrame({GID: "|".join(map(str, key)), "id": ids, "c": labels, "time_s": time.perf_counter() - began})

    by = [GID, "method", "seed"]
    found = edges.join(grid, GID).groupBy(*by).cogroup(search.renewed(vertices.join(grid, GID)).groupBy(*by)).applyInPandas(run, f"{GID} string, id long, c long, time_s double")
    return _Grid(search.cut(found), search.cut(edges), search.cut(vertices)).records()


class _Grid:
    def __init__(self, found: DataFrame, edges: DataFrame, vertices: DataFrame):
        self.found, self.edges, self.vertices = found, edges, vertices

    def records(self) -> DataFrame:
        runs = self.found.groupBy(GID).agg(F.first("time_s").alias("time_s"))
        part = lambda i: F.split(F.col(GID), r"\|")[i]
        runs = runs.select(GID, part(0).alias("dataset"), part(1).alias("method"), part(2).cast("int").alias("seed"), "time_s")
        edges = self.edges.withColumnRenamed(GID, "dataset").join(runs.select(GID, "dataset"), "dataset").select(GID, "src", "dst", "w")
        truth = self.vertices.withColumnRenamed(GID, "dataset").join(runs.select(GID, "dataset"), "dataset").select(GID, "id", F.col("truth").alias("c"))
        facts = self.vertices.groupBy(F.col(GID).alias("dataset")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("truth").alias("k_true"))
        sizes = self.edges.groupBy(F.col(GID).alias("dataset")).agg(F.count(F.lit(1)).alias("m"))
        labels = self.found.select(GID, "id", "c")
        agreed = scores.agreement(scores.contingency(truth.where("c is not null"), labels))
        rows = runs.join(scores.cross_objective(edges, labels), GID).join(agreed, GID, "left").join(facts, "dataset").join(sizes, "dataset")
        kinds = F.broadcast(registry.as_table(self.found.sparkSession).select(F.col("name").alias("method"), "is_se"))
        return rows.join(kinds, "method").select(*RECORD)


def benchmark(spark: SparkSession, names: Iterable[str] | None = None, datasets: Iterable | None = None, seeds: Iterable[int] = range(5)) -> DataFrame:
    """A record for each data set, method and seed; external methods that aren't set up leave themselves out."""
    return run_grid(spark, datasets or DEFAULT, names or registry.list_methods(family="community_detection"), seeds)


def summarize(records: DataFrame, metric: str = "ari", methods: list[str] | None = None) -> DataFrame:
    """A row for each data set, a column of means for each method; nulls don't count."""
    return records.groupBy("dataset").pivot("method", methods).agg(F.avg(metric))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``old`` and ``new``, one for each key; a key of both has the new row. Of repeated keys in one table the greatest row counts.

    One shuffle with partial aggregation, for tables of any size; null keys are keys like others.
    """
    values = [c for c in old.columns if c not in keys]
    sides = [t.select(*keys, F.struct(F.lit(turn).alias("turn"), *values).alias("v")) for turn, t in enumerate((old, new))]
    last = sides[0].union(sides[1]).groupBy(*keys).agg(F.max("v").alias("v"))
    return last.select(*[c if c in keys else F.col("v")[c].alias(c) for c in old.columns])


def spread(records: DataFrame, metric: str, by: tuple[str, ...] = ("dataset", "method")) -> DataFrame:
    """Mean, half the range, number and population deviation; NaN doesn't count."""
    x = F.when(~F.isnan(metric), F.col(metric))
    return records.groupBy(*by).agg(F.avg(x).alias("mean"), ((F.max(x) - F.min(x)) / 2).alias("half_range"), F.count(x).alias("n"), F.stddev_pop(x).alias("std"))


def flagged_best(rows: DataFrame, value: str, by: str = "dataset", lower: bool = True, tolerance: float = 1e-9) -> DataFrame:
    """``rows`` with ``best``: within ``tolerance`` of the best of its group."""
    from pyspark.sql import Window

    best = (F.min if lower else F.max)(value).over(Window.partitionBy(by))
    return rows.withColumn("best", F.abs(F.col(value) - best) < tolerance)


def wins(rows: DataFrame, value: str, method: str, by: str = "dataset", tolerance: float = 1e-9) -> DataFrame:
    """One row: groups in which ``method`` is best, and all groups."""
    flags = flagged_best(rows, value, by, True, tolerance).where(F.col("method") == method)
    return flags.agg(F.count_if("best").alias("wins"), F.count(F.lit(1)).alias("total"))


def latex_rows(records: DataFrame, metric: str, places: int = 3, lower: bool = False) -> DataFrame:
    """(dataset, row): a LaTeX table row of means by method, the best in bold."""
    means = flagged_best(records.groupBy("dataset", "method").agg(F.avg(metric).alias("x")), "x", lower=lower)
    cell = F.when(F.col("best"), F.concat(F.lit("\\textbf{"), fixed(F.col("x"), places), F.lit("}"))).otherwise(fixed(F.col("x"), places))
    cells = means.select("dataset", F.struct("method", cell.alias("cell")).alias("c")).groupBy("dataset").agg(F.array_sort(F.collect_list("c")).alias("cells"))
    return cells.select("dataset", F.concat(F.col("dataset"), F.lit(" & "), F.array_join(F.transform("cells", lambda c: c["cell"]), " & "), F.lit(" \\\\")).alias("row"))
