"""Continuous replace-by-file: versions of files arrive as events, the newest of each file makes the table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of the table that a bucket is meant for; buckets are by hash of the uri, a batch rewrites only those that it touches, a task each.
BUCKET_BYTES = 32_000_000
#: Buckets of a table whose size is not told.
BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _numbered(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers n of the entries name=n of a folder, in order."""
    fs, hadoop = _fs(spark, path)
    if not fs.exists(hadoop):
        return []
    found = (re.fullmatch(rf"{name}=(\d+)", str(s.getPath().getName())) for s in fs.listStatus(hadoop))
    return sorted(int(m[1]) for m in found if m)


def snapshot(spark: SparkSession, table_path: str, below: int | None = None) -> dict[int, list[int]]:
    """For each bucket the batches that wrote it, in order, of the complete ones (whose _SUCCESS mark is there) below ``below``."""
    held: dict[int, list[int]] = {}
    for n in _numbered(spark, table_path, "batch"):
        fs, mark = _fs(spark, f"{table_path}/batch={n}/_SUCCESS")
        if (below is None or n < below) and fs.exists(mark):
            for bucket in _numbered(spark, f"{table_path}/batch={n}", "bucket"):
                held.setdefault(bucket, []).append(n)
    return held


def _read(spark: SparkSession, table_path: str, held: dict[int, list[int]], schema) -> DataFrame | None:
    paths = [f"{table_path}/batch={batches[-1]}/bucket={bucket}" for bucket, batches in sorted(held.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else None


def read_snapshot(spark: SparkSession, table_path: str, schema) -> DataFrame | None:
    """The newest complete state of every bucket."""
    return _read(spark, table_path, snapshot(spark, table_path), schema)


def drop_old(spark: SparkSession, table_path: str) -> None:
    """Removes what no reader and no replay needs: of each bucket the newest two complete states stay."""
    for bucket, batches in snapshot(spark, table_path).items():
        for n in batches[:-2]:
            fs, path = _fs(spark, f"{table_path}/batch={n}/bucket={bucket}")
            fs.delete(path, True)


def _newest(versions: DataFrame, *keys: str) -> DataFrame:
    """Of each file what is newest: by version, of one version a deletion, then by the rows, so that no order of arrival decides.

    Rows with fields that Spark can't put in order (maps, variants) are so by their text.
    """
    unordered = re.search(r"\b(map<|variant\b)", versions.schema["rows"].dataType.simpleString())
    by = ["version", "deleted", F.to_json(F.struct("rows")).alias("text") if unordered else "rows"]
    newest = F.max_by(F.struct("version", "deleted", "rows"), F.struct(*by)) if unordered else F.max(F.struct(*by))
    return versions.groupBy(*keys, "uri").agg(newest.alias("r")).select("uri", "r.*", *keys)


def apply_versions(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """State after a batch of (uri, version, deleted, rows: array<struct>): the newest version of each file, unless the state has a newer one.

    A file keeps one row (uri, version, deleted, rows); a deleted file stays as a mark, so that a late older version can't
    revive it. Different rows of one version have an order too, so the state depends neither on batches nor on replays.
    """
    return _newest(batch if state is None else state.unionByName(batch))


def live_rows(state: DataFrame) -> DataFrame:
    """(uri, version, fields of the rows) of the files that are not deleted."""
    return state.filter(~F.col("deleted")).select("uri", "version", F.explode("rows").alias("r")).select("uri", "version", "r.*")


def table_buckets(spark: SparkSession, table_path: str, expected_bytes: int | None = None, buckets: int | None = None) -> int:
    """The table's number of buckets, which is set, from the bytes that it is expected to have, when it is first asked for."""
    if not (held := _numbered(spark, table_path, "buckets")):
        held = [buckets or (max(1, -(-expected_bytes // BUCKET_BYTES)) if expected_bytes else BUCKETS)]
        fs, mark = _fs(spark, f"{table_path}/buckets={held[0]}")
        fs.mkdirs(mark)
    return held[0]


def upsert(batch: DataFrame, n: int, table_path: str, buckets: int | None = None, expected_bytes: int | None = None) -> None:
    """Writes batch ``n``: the buckets that it touches, made from their newest states below ``n``, so a replayed batch writes the same again.

    What is stored and what came are shuffled once, to the tasks of their buckets, which choose and write.
    """
    spark = batch.sparkSession
    buckets = table_buckets(spark, table_path, expected_bytes, buckets)
    batch = batch.select("uri", "version", "deleted", "rows")
    of = F.pmod(F.xxhash64("uri"), F.lit(buckets)).cast("int")
    touched = {r[0] for r in batch.select(of.alias("bucket")).distinct().collect()}
    held = {bucket: batches for bucket, batches in snapshot(spark, table_path, n).items() if bucket in touched}
    state = _read(spark, table_path, held, batch.schema)
    versions = (batch if state is None else state.unionByName(batch)).withColumn("bucket", of).repartitionById(buckets, "bucket")
    _newest(versions, "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{table_path}/batch={n}")
    drop_old(spark, table_path)


def stream_file_versions(stream: DataFrame, table_path: str, checkpoint: str, available_now: bool = False, buckets: int | None = None, expected_bytes: int | None = None):
    """Starts the query; the table is read by ``read_snapshot``. Its number of buckets, given or from the bytes that are expected, is kept with it."""
    writer = stream.writeStream.foreachBatch(lambda batch, n: upsert(batch, n, table_path, buckets, expected_bytes)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
