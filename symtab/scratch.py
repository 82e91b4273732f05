"""Tables in the shared folder that spark.checkpoint.dir names; set here only where it is unset and Spark runs on one machine, as in tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, removed when the application ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-checkpoints-')}"
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/symtab-{label}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` and reads it again; lineage ends in files that outlive executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_folder = path
    return out


def bucketed(df: DataFrame, label: str, buckets: int, *keys: str) -> DataFrame:
    """Like ``cut``, but kept in buckets by ``keys``: joins on these do not shuffle the table again.

    ``df`` must be hash-partitioned by ``keys`` into as many partitions, so that a bucket is one file. The table has a name in the
    session's catalog until ``forget``; its files stay until the application ends.
    """
    path, name = scratch_path(df.sparkSession, label), f"symtab_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(name)
    out = df.sparkSession.table(name)
    out.scratch_folder, out.scratch_name = path, name
    return out


def forget(table: DataFrame) -> DataFrame:
    """The rows of a table in buckets as plain files; its name is dropped."""
    out = table.sparkSession.read.schema(table.schema).parquet(table.scratch_folder)
    table.sparkSession.sql(f"DROP TABLE IF EXISTS {table.scratch_name}")
    out.scratch_folder = table.scratch_folder
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what ``cut`` wrote for these tables, once nothing is left to be computed from them."""
    for df in tables:
        hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_folder)
        hadoop.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
