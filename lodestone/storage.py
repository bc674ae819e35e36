"""Tables and the shared work folder: writing a DataFrame once cuts its lineage and survives lost executors."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where the setting is missing, a local master gets a temporary folder; a cluster raises, as its executors
    could not read the driver's disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-work-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lodestone-{uuid.uuid4().hex}"


def keep(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back."""
    path = work_folder(df.sparkSession)
    writer = df.write.option("compression", "zstd")  # ids in hex take about half of what snappy leaves
    writer = writer.partitionBy(partition_by) if partition_by else writer
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lodestone_kept = path
    return out


def keep_bucketed(df: DataFrame, column: str, buckets: int, sort: list[str], partition_by: str | None = None) -> DataFrame:
    """Write df once as a table bucketed by a column, one file a bucket and partition, and read it back.

    The table lies in the shared folder; its name in the session's catalog carries the bucketing.
    """
    spark, path = df.sparkSession, work_folder(df.sparkSession)
    name = path.rpartition("/")[2].replace("-", "_")
    writer = df.repartition(buckets, column).write.bucketBy(buckets, column).sortBy(*sort)
    writer = writer.partitionBy(partition_by) if partition_by else writer
    writer.format("parquet").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._lodestone_kept, out._lodestone_table = path, name
    return out


def forget(*kept: DataFrame) -> None:
    """Delete what keep() wrote for these DataFrames; nothing that is still to be read may depend on them."""
    for df in kept:
        path, name = getattr(df, "_lodestone_kept", None), getattr(df, "_lodestone_table", None)
        if name:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of DataFrames that nothing refers to, now instead of at the driver's next collection."""
    gc.collect()  # frames in Python's cycles keep theirs
    spark._jvm.System.gc()
