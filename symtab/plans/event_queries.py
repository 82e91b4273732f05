"""Queries for incremental maintenance and keyed event rules (operators 53 to 65)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symtab.operators import events, maintain
from symtab.operators.ranges import input_bytes, spread
from symtab.plans.fixtures import ctes, table, view
from symtab.scratch import scratch_path
from symtab.streaming import file_versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None):
    """Registers a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _batch(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state, changed uris, new rows): every tenth order is rewritten, every twentieth deleted."""
    refs, changed = view(spark, d, "refs"), view(spark, d, "changed_files")
    new = spread(refs, "uri").join(changed.filter("not deleted"), "uri", "left_semi").withColumn("start_line", F.col("start_line") + 100)
    return refs, changed.select("uri"), new


_STATE = "SELECT sid, uri, start_line, start_col, kind FROM refs WHERE uri NOT IN (SELECT uri FROM changed_files)"
_NEW = "SELECT sid, uri, (start_line + 100)::INT AS start_line, start_col, kind FROM refs WHERE uri IN (SELECT uri FROM changed_files WHERE NOT deleted)"
_COLUMNS = ("sid", "uri", "start_line", "start_col", "kind")


def _typed(df: DataFrame) -> DataFrame:
    return df.withColumn("start_line", F.col("start_line").cast("int")).select(*_COLUMNS)


_UPDATED = ctes("refs", "changed_files") + f" SELECT sid, uri, start_line::INT AS start_line, start_col, kind FROM ({_STATE} UNION ALL {_NEW})"


@query(_UPDATED)
def sym53_update_files(spark, d):
    return _typed(maintain.update_files(*_batch(spark, d)))


@query(ctes("refs", "changed_files") + f" SELECT sid, uri, start_line::INT AS start_line, start_col, kind FROM ({_STATE})")
def sym54_remove_files(spark, d):
    state, changed, _ = _batch(spark, d)
    return _typed(maintain.remove_files(state, changed))


@query(ctes("symbols") + """, a AS (SELECT sid AS sym, owner1 AS container, 1 AS load_seq, sid AS ordinal FROM symbols WHERE in_project UNION ALL SELECT sid, 'new' || (sid % 4), 2, sid FROM symbols WHERE in_dependency)
SELECT sym, arg_max(container, load_seq) AS container, max(load_seq)::INT AS load_seq FROM a GROUP BY sym""")
def sym55_add_container(spark, d):
    s = view(spark, d, "symbols")
    state = s.filter("in_project").select(F.col("sid").alias("sym"), F.col("owner1").alias("container"), F.lit(1).alias("load_seq"), F.col("sid").alias("ordinal"))
    added = s.filter("in_dependency").select(F.col("sid").alias("sym"), F.concat(F.lit("new"), F.col("sid") % 4).alias("container"), F.lit(2).alias("load_seq"), F.col("sid").alias("ordinal"))
    return maintain.add_container(state, added).select("sym", "container", "load_seq")


@query(ctes("symbols") + " SELECT sid, CASE WHEN sid % 3 = 0 THEN 'file:///new/' || sid ELSE uri END AS uri FROM symbols")
def sym56_update_locations(spark, d):
    s = view(spark, d, "symbols").select("sid", F.struct("uri").alias("location"))
    updates = s.filter("sid % 3 = 0").select((F.col("sid")).alias("sid"), F.struct(F.concat(F.lit("file:///new/"), "sid").alias("uri")).alias("location"))
    unknown = updates.withColumn("sid", -F.col("sid") - 1)
    return maintain.update_locations(s, updates.unionByName(unknown), key="sid").select("sid", "location.uri")


@query(ctes("refs", "changed_files") + f" SELECT sid, uri, start_line::INT AS start_line, start_col, kind FROM ({_STATE} UNION ALL {_NEW})")
def sym57_apply_compile_output(spark, d):
    state, changed, new = _batch(spark, d)
    unasked = state.join(changed, "uri", "left_anti").withColumn("start_line", F.col("start_line") + 500)
    return _typed(maintain.apply_compile_output(state, changed, new.unionByName(unasked)))


@query(_UPDATED)
def sym58_stream_file_versions(spark, d):
    """Files and their rewritten versions arrive as a stream of files; the snapshot at the end is that of operator 53."""
    state, changed = view(spark, d, "refs"), view(spark, d, "changed_files")
    row = F.struct("sid", F.col("start_line").cast("int").alias("start_line"), "start_col", "kind")
    folder = scratch_path(spark, "stream")
    first = spread(state, "uri").groupBy("uri").agg(F.collect_list(row).alias("rows")).select("uri", F.lit(1).cast("long").alias("version"), F.lit(False).alias("deleted"), "rows")
    first.write.parquet(f"{folder}/in/b")
    first = spark.read.schema(first.schema).parquet(f"{folder}/in/b")
    rewritten = F.transform("rows", lambda r: r.withField("start_line", r["start_line"] + 100))
    second = spread(first, "uri").drop("version", "deleted").join(changed, "uri").select("uri", F.lit(2).cast("long").alias("version"), "deleted", F.when(F.col("deleted"), F.array().cast(first.schema["rows"].dataType)).otherwise(rewritten).alias("rows"))
    second.write.parquet(f"{folder}/in/a")
    files = max(8, len(first.inputFiles()), len(spark.read.parquet(f"{folder}/in/a").inputFiles()))
    # what was written last, the later versions, comes first, so the earlier ones must be refused
    stream = spark.readStream.schema(first.schema).option("recursiveFileLookup", "true").option("latestFirst", "true").option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    buckets = max(16, -(-input_bytes(first) // file_versions.BUCKET_BYTES))
    started = file_versions.stream_file_versions(stream, f"{folder}/table", f"{folder}/progress", available_now=True, buckets=buckets)
    started.awaitTermination()
    return file_versions.live_rows(file_versions.read_snapshot(spark, f"{folder}/table", first.schema)).select(*_COLUMNS)


@query(ctes("stamps_prev", "stamps_curr") + " SELECT c.source FROM stamps_curr c LEFT JOIN stamps_prev p USING (source) WHERE p.source IS NULL OR p.content <> c.content")
def sym59_changed_sources(spark, d):
    stamp = lambda name: view(spark, d, name).select("source", F.sha2("content", 256).alias("stamp"))
    return maintain.changed_sources(stamp("stamps_prev"), stamp("stamps_curr"))


@query("""SELECT 'file:///d/' || o_custkey AS source, string_agg('shop/O' || o_orderkey || '.class', ',' ORDER BY 'shop/O' || o_orderkey || '.class') AS products FROM orders GROUP BY o_custkey
UNION ALL SELECT 'file:///d/' || c_custkey, '' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def sym60_explode_products(spark, d):
    key = lambda c: F.concat(F.lit("file:///d/"), c).alias("source")
    changed = table(spark, d, "customer").select(key("c_custkey")).unionByName(table(spark, d, "orders").select(key("o_custkey"))).distinct()
    names = table(spark, d, "orders").select(key("o_custkey"), F.concat(F.lit("shop.O"), "o_orderkey").alias("class_name"))
    return maintain.explode_products(changed, names).withColumn("products", F.array_join("products", ","))


#: Edits on line 0 or 1 of the content so far; a line that is not there has the offset -1, so the text is prepended.
_FOLD = """, o AS (SELECT uri, list({'f': full_replace, 'l': start_line, 'a': start_col, 'b': end_col, 't': text} ORDER BY version) AS es FROM edits GROUP BY uri)
SELECT uri::BIGINT AS uri, list_reduce(list_prepend('', list_transform(es, lambda e: (CASE WHEN e.f THEN '1' ELSE '0' END) || e.l || lpad(e.a::VARCHAR, 4, '0') || lpad(e.b::VARCHAR, 4, '0') || e.t)),
lambda s, x: CASE WHEN x[1] = '1' THEN x[11:] WHEN x[2] = '1' AND strpos(s, chr(10)) = 0 THEN x[11:] || s
ELSE substring(s, 1, x[2]::INT * strpos(s, chr(10)) + x[3:6]::INT) || x[11:] || substring(s, x[2]::INT * strpos(s, chr(10)) + x[7:10]::INT + 1) END) AS content FROM o"""


@query(ctes("edits") + _FOLD)
def sym61_fold_edits(spark, d):
    edits = view(spark, d, "edits").withColumn("uri", F.col("uri").cast("string"))
    first = edits.groupBy("uri").agg(F.lit("not yet opened").alias("content"))
    return events.fold_edits(first, edits).select(F.col("uri").cast("long").alias("uri"), "content")


@query(ctes("edits") + ", x AS (SELECT * FROM edits WHERE uri % 3 <> 0)" + _FOLD.replace("FROM edits GROUP BY", "FROM x GROUP BY"))
def sym62_document_lifecycle(spark, d):
    """Turn 0 opens, later turns change, and every third document is closed at the end."""
    e = view(spark, d, "edits").withColumn("event_type", F.when(F.col("version") == 0, "open").otherwise("change"))
    ends = e.groupBy("uri").agg((F.max("version") + 1).alias("version")).filter("uri % 3 = 0").select("uri", "version", F.lit("close").alias("event_type"))
    both = e.unionByName(ends, allowMissingColumns=True).withColumn("uri", F.col("uri").cast("string"))
    return events.document_lifecycle(both).select(F.col("uri").cast("long").alias("uri"), "content")


@query(ctes("diagnostic_events") + """, e AS (SELECT *, sum(reset::INT) OVER (PARTITION BY uri ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM diagnostic_events)
SELECT uri, event_id, array_to_string(list_sort(list_distinct(list(item) OVER (PARTITION BY uri, epoch ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))), '|') AS items FROM e""")
def sym63_accumulate_with_reset(spark, d):
    return events.accumulate_with_reset(view(spark, d, "diagnostic_events")).select("uri", "event_id", F.array_join("items", "|").alias("items"))


@query(ctes("diagnostic_events") + """, s AS (SELECT *, CASE event_id % 5 WHEN 0 THEN [] WHEN 1 THEN NULL WHEN 2 THEN [item, NULL] ELSE [item, 'kind:' || split_part(item, ':', 1)] END AS items FROM diagnostic_events),
e AS (SELECT *, sum(reset::INT) OVER (PARTITION BY uri ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM s)
SELECT uri, event_id, array_to_string(list_sort(list_distinct(flatten(list(coalesce(items, [])) OVER (PARTITION BY uri, epoch ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)))), '|') AS items FROM e""")
def sym63_accumulate_sets(spark, d):
    """Events that bear a set each, of which some are empty or null, as for a file without findings."""
    e, item, n = view(spark, d, "diagnostic_events"), F.col("item"), F.col("event_id") % 5
    kind = F.concat(F.lit("kind:"), F.split_part("item", F.lit(":"), F.lit(1)))
    none = F.array().cast("array<string>")
    sets = F.when(n == 0, none).when(n == 1, None).when(n == 2, F.array(item, F.lit(None).cast("string"))).otherwise(F.array(item, kind))
    return events.accumulate_with_reset(e.withColumn("found", sets), item="found").select("uri", "event_id", F.array_join("items", "|").alias("items"))


@query(ctes("diagnostic_events") + """, n AS (SELECT uri, event_id, ts, lead(ts) OVER (PARTITION BY uri ORDER BY ts, event_id) AS nx, lead(ts) OVER (ORDER BY ts, event_id) AS nx_all FROM diagnostic_events)
SELECT 'each' AS scope, uri, event_id FROM n WHERE nx IS NULL OR nx > ts + INTERVAL 6 HOUR UNION ALL SELECT 'all', uri, event_id FROM n WHERE nx_all IS NULL OR nx_all > ts + INTERVAL 10 MINUTE""")
def sym64_debounce(spark, d):
    e = view(spark, d, "diagnostic_events")
    each = events.debounce(e, ["uri"], "6 HOURS").select(F.lit("each").alias("scope"), "uri", "event_id")
    return each.unionByName(events.debounce(e, [], "10 MINUTES").select(F.lit("all").alias("scope"), "uri", "event_id"))


@query(ctes("diagnostic_events") + """, e AS (SELECT uri, event_id, ts, row_number() OVER (PARTITION BY uri ORDER BY ts, event_id) AS rn FROM diagnostic_events),
run AS (SELECT uri, event_id, rn, ts AS start FROM e WHERE rn = 1
  UNION ALL SELECT r.uri, n.event_id, n.rn, greatest(n.ts, r.start + INTERVAL 12 HOUR) FROM run r, LATERAL (
    SELECT event_id, rn, ts FROM e WHERE e.uri = r.uri AND e.rn > r.rn
    AND e.rn = (SELECT coalesce(max(rn) FILTER (ts <= r.start + INTERVAL 12 HOUR), min(rn)) FROM e x WHERE x.uri = r.uri AND x.rn > r.rn)) n)
SELECT uri, event_id, start FROM run""")
def sym65_conflate_latest(spark, d):
    return events.conflate_latest(view(spark, d, "diagnostic_events"), "uri", 12 * 3600)
