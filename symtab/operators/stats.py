"""Counts, capped listings and per-file groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symtab.functions import text as T
from symtab.operators.lookup import search_symbols


def index_stats(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """One row: project and dependency symbols, files (with declarations or uses), containers, references.

    ``symbols`` bears tier, sym, uri and container, ``refs`` uri. Both go through one global aggregate.
    """
    rows = symbols.select("tier", "sym", "uri", "container").unionByName(refs.select(F.lit("use").alias("tier"), F.lit(None).alias("sym"), "uri", F.lit(None).alias("container")))
    of = lambda *tiers: F.col("tier").isin(*tiers)
    return rows.agg(
        F.count_distinct(F.when(of("project"), F.col("sym"))).alias("project_symbols"), F.count_distinct(F.when(of("dependency"), F.col("sym"))).alias("dependency_symbols"),
        F.count_distinct(F.when(of("project", "use"), F.col("uri"))).alias("files"), F.count_distinct(F.when(of("dependency"), F.col("container"))).alias("containers"),
        F.count_if(of("use")).alias("references"),
    )


def debug_search(symbols: DataFrame, queries: DataFrame, limit: int = 100) -> DataFrame:
    """At most ``limit`` matches by (name_key, sym), displayed; no query, no matches. Top-k without a full sort."""
    shown = T.symbol_display(F.col("name"), F.col("kind"), F.col("sym"), F.col("owner"), F.col("origin"), F.col("location"))
    return search_symbols(symbols, queries).orderBy("name_key", "sym").limit(limit).select("name_key", shown.alias("shown")).select("name_key", "shown.*")


def debug_index(counts: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: the columns of ``counts`` (one row, as of ``index_stats``) and ``matches``, at most as many as ``debug_search`` leaves, in its order; none gives an empty array."""
    one = matches.agg(F.sort_array(F.collect_list(F.struct(*matches.columns))).alias("matches")).withColumn("_one", F.lit(1))
    return counts.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")


def diagnostic_rollup(diags: DataFrame, keep: int = 20) -> DataFrame:
    """(container, errors, warnings, status, messages): exact counts and the first ``keep`` messages by seq.

    Messages are cut by rank before they are collected, so no group grows beyond ``keep``.
    """
    counts = diags.groupBy("container").agg(F.count_if("is_error").alias("errors"), F.count_if(~F.col("is_error")).alias("warnings"))
    rank = F.row_number().over(Window.partitionBy("container").orderBy("seq"))
    first = diags.withColumn("rank", rank).filter(F.col("rank") <= keep).groupBy("container").agg(F.array_sort(F.collect_list(F.struct("rank", "message"))).alias("m"))
    joined = counts.join(first, "container", "left")
    return joined.select("container", "errors", "warnings", F.when(F.col("errors") > 0, "Error").otherwise("Ok").alias("status"), F.transform("m", lambda x: x["message"]).alias("messages"))


def group_by_file(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """(uri, symbols, refs): what each file declares and uses, arrays sorted; a file with only one of them stays."""
    declared = symbols.groupBy("uri").agg(F.sort_array(F.collect_list("sym")).alias("symbols"))
    used = refs.groupBy("uri").agg(F.sort_array(F.collect_list("sym")).alias("refs"))
    empty = lambda c, df: F.coalesce(c, F.array().cast(df.schema[c].dataType))
    return declared.join(used, "uri", "full_outer").select("uri", empty("symbols", declared).alias("symbols"), empty("refs", used).alias("refs"))
