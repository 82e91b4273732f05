"""Parts that operators on ordered rows share: dyadic ranges, and running values over keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bytes of input files that a task of a large join or aggregation is meant for; they are compressed, its rows are many times larger.
TASK_BYTES = 4_000_000


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` is read from."""
    spark, size = df.sparkSession, 0
    for file in df.inputFiles():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        size += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return size


def spread(df: DataFrame, *keys: str, task_bytes: int | None = None) -> DataFrame:
    """``df`` by hash of ``keys`` in as many partitions as its input files ask for, where these are more than the session's; else as it is.

    Spark's number of shuffle partitions is fixed, so that a task's memory would grow with the input.
    """
    tasks = input_bytes(df) // (task_bytes or TASK_BYTES) + 1
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def bins(df: DataFrame, lo: str, hi: str, levels: int) -> DataFrame:
    """A row for each of the dyadic ranges that make up lo to hi (both included, from 0): (_level, _bin), at most two a level."""
    df = df.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    first, end = F.expr(f"shiftright({lo} + shiftleft(1L, _level) - 1, _level)"), F.expr(f"shiftright({hi} + 1, _level)")
    df = df.withColumn("_first", first).withColumn("_stop", end)
    left = F.when((F.col("_first") % 2 == 1) & (F.col("_first") < F.col("_stop")), F.col("_first"))
    right = F.when((F.col("_stop") % 2 == 1) & (F.col("_first") + F.col("_first") % 2 < F.col("_stop")), F.col("_stop") - 1)
    return df.withColumn("_bin", F.explode(F.array_compact(F.array(left, right)))).drop("_first", "_stop", lo, hi)


def running_max(df: DataFrame, keys: list[str], order: str, slices: Column, value: Column, out: str, before: bool = False) -> DataFrame:
    """``df`` plus ``out``: the greatest value of the key's rows up to this one in ``order`` (only of those before it, if so asked).

    ``slices`` are parts of the order, as integers: rows of one slice are put in order together, and what came in earlier
    slices of the key is carried over, a row a slice, so that a key of any size is many tasks' work.
    """
    df = df.withColumn("_slice", slices)
    last = Window.currentRow - 1 if before else Window.currentRow
    inside = F.max(value).over(Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, last))
    carry = Window.partitionBy(*(f"{k}2" for k in keys)).orderBy("_slice2").rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy(*(F.col(k).alias(f"{k}2") for k in keys), F.col("_slice").alias("_slice2")).agg(F.max(value).alias("_most"))
    parts = parts.select(*(f"{k}2" for k in keys), "_slice2", F.max("_most").over(carry).alias("_carried"))
    same = [F.col(k) == F.col(f"{k}2") for k in (*keys, "_slice")]
    joined = df.withColumn("_inside", inside).join(parts, same)
    return joined.withColumn("_out", F.greatest("_inside", "_carried")).select(*(c for c in df.columns if c != "_slice"), F.col("_out").alias(out))
