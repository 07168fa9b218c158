"""Cutting a plan's lineage in the session's checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors share.

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
    """``df`` computed once and checkpointed."""
    folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the checkpoint folder and read again, with its true size for the optimizer."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Deletes a table that ``stored`` wrote and nothing reads any more, and lets go of the shuffles of plans that are gone."""
    spark = table.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for uri in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if uri.rsplit("/", 1)[1].startswith("table-"):
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
            path.getFileSystem(conf).delete(path, True)
    jvm.System.gc()  # Spark's cleaner deletes a shuffle's files once the driver has collected what refers to it
