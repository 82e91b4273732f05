"""Content-addressed cache of extraction results, and symbols as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symtab.schema import SYMBOL

#: Buckets that results are filed under: the first two hex digits of the key.
BUCKET_DIGITS = 2


def content_sha256(df: DataFrame, col: str) -> DataFrame:
    """Adds ``sha``: hex SHA-256 of the bytes; equal bytes have equal keys."""
    return df.withColumn("sha", F.sha2(F.col(col).cast("binary"), 256))


def cache_lookup(inputs: DataFrame, manifest: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of inputs by whether (version, sha) is in the manifest; results of other versions are never read."""
    known = manifest.filter(F.col("version") == version).select("sha").distinct()
    return inputs.join(known, "sha", "left_semi"), inputs.join(known, "sha", "left_anti")


def cache_store(results: DataFrame, done: DataFrame, path: str, version: str) -> None:
    """Writes ``results`` (sha, ...) of the keys ``done`` (sha), an empty result too, and then the manifest.

    Results go to new files under version, batch and bucket; a key's earlier rows are outdated by the manifest's newer batch. A
    reader takes, of each key, the rows of the newest batch that the manifest names, so a failed write is never seen.
    ``cache_clean`` removes batches that are wholly outdated.
    """
    spark = results.sparkSession
    batch = spark.sql("SELECT uuid()").first()[0]
    filed = lambda df: df.withColumn("version", F.lit(version)).withColumn("batch", F.lit(batch)).withColumn("bucket", F.substring("sha", 1, BUCKET_DIGITS))
    filed(results).write.mode("append").partitionBy("version", "batch", "bucket").parquet(f"{path}/results")
    filed(done.select("sha").distinct()).withColumn("at", F.current_timestamp()).write.mode("append").partitionBy("version").parquet(f"{path}/manifest")


def cache_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(sha, version, batch): the newest batch of each key."""
    rows = spark.read.parquet(f"{path}/manifest")
    return rows.groupBy("sha", "version").agg(F.max_by("batch", F.struct("at", "batch")).alias("batch"))


def cache_read(spark: SparkSession, path: str, hits: DataFrame, version: str) -> DataFrame:
    """Cached results of the keys ``hits`` (sha)."""
    newest = cache_manifest(spark, path).filter(F.col("version") == version).join(hits.select("sha").distinct(), "sha", "left_semi")
    rows = spark.read.parquet(f"{path}/results").filter(F.col("version") == version)
    return rows.join(newest.select("sha", "batch"), ["sha", "batch"]).drop("batch", "version", "bucket")


def cache_clean(spark: SparkSession, path: str) -> int:
    """Removes the results of batches whose every key has a newer batch, and tells how many; replaced entries so take no room.

    Only batches that the manifest names are looked at, so one that is just being written stays.
    """
    named = spark.read.parquet(f"{path}/manifest").select("version", "batch").distinct()
    outdated = named.join(cache_manifest(spark, path).select("version", "batch").distinct(), ["version", "batch"], "left_anti").collect()  # names of batches
    for r in outdated:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/results/version={r.version}/batch={r.batch}")
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    return len(outdated)


def symbols_to_json(symbols: DataFrame) -> DataFrame:
    """(json): one object a symbol; unions are told apart by ``_kind``."""
    return symbols.select(F.to_json(F.struct(*symbols.columns)).alias("json"))


def symbols_from_json(df: DataFrame, schema=SYMBOL, col: str = "json") -> DataFrame:
    """Symbols from JSON; what can't be read counts as missing."""
    schema = schema.simpleString() if hasattr(schema, "simpleString") else schema
    parsed = df.select(F.from_json(col, schema, {"mode": "PERMISSIVE"}).alias("s"), F.from_json(col, "map<string,string>").alias("m"))
    return parsed.filter(F.col("s").isNotNull() & F.coalesce(F.size("m") > 0, F.lit(False))).select("s.*")
