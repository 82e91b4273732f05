"""Streams give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from symtab.operators import events, ranges
from symtab.plans.event_queries import QUERIES
from symtab.plans.fixtures import view
from symtab.streaming import events as streams
from symtab.streaming import file_versions


@pytest.fixture(autouse=True)
def store(spark):
    streams.configure(spark)


def run(spark, df, make, tmp_path, parts, mode, name, order=None):
    """Feeds ``df`` in as many files, one a batch, and returns all that the stream put out."""
    folder = str(tmp_path / "in")
    for i, part in enumerate(parts):
        df.filter(part).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = make(source).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "check")).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


@pytest.fixture
def diagnostics(spark, sf_dir):
    return view(spark, sf_dir, "diagnostic_events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("uri", F.col("uri").cast("string"))


def halves(df):
    middle = df.agg(F.percentile("event_id", 0.5)).first()[0]
    times = df.agg(F.expr("percentile_approx(unix_micros(ts), 0.5)")).first()[0]
    return middle, F.unix_micros("ts") <= times


END = "uri = 'end'"


def with_end(spark, df):
    """A late event of another key, which moves the watermark past everything."""
    row = df.limit(1).select(F.lit("end").alias("uri"), F.lit("2030-01-01").cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("event_id"), F.lit(False).alias("reset"), F.lit("").alias("item"))
    return df.unionByName(row).unionByName(row.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY")).withColumn("event_id", F.lit(-2).cast("long")))


def test_accumulate(spark, diagnostics, tmp_path):
    _, early = halves(diagnostics)
    out = run(spark, diagnostics, streams.stream_accumulate, tmp_path, [early, ~early], "append", "acc")
    batch = events.accumulate_with_reset(diagnostics).select("uri", "event_id", "items")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))


def test_accumulate_sets(spark, diagnostics, tmp_path):
    _, early = halves(diagnostics)
    n = F.col("event_id") % 4
    sets = diagnostics.withColumn("item", F.when(n == 0, F.array().cast("array<string>")).when(n == 1, None).otherwise(F.array("item", F.lit(None).cast("string"))))
    out = run(spark, sets, streams.stream_accumulate, tmp_path, [early, ~early], "append", "accsets")
    batch = events.accumulate_with_reset(sets).select("uri", "event_id", "items")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))


def test_debounce_of_one_scope(spark, diagnostics, tmp_path):
    _, early = halves(diagnostics)
    fed = with_end(spark, diagnostics)
    make = lambda s: streams.stream_debounce(s.withWatermark("ts", "0 seconds"), 600, keyed=False)
    out = run(spark, fed, make, tmp_path, [early & ~F.expr(END), ~early & ~F.expr(END), F.expr(END + " and event_id = -1"), F.expr(END + " and event_id = -2")], "append", "deb1").filter("uri <> 'end'")
    batch = events.debounce(diagnostics, [], "10 MINUTES").select("uri", "event_id")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))


def test_debounce(spark, diagnostics, tmp_path):
    _, early = halves(diagnostics)
    fed = with_end(spark, diagnostics)
    make = lambda s: streams.stream_debounce(s.withWatermark("ts", "0 seconds"), 6 * 3600)
    out = run(spark, fed, make, tmp_path, [early & ~F.expr(END), ~early & ~F.expr(END), F.expr(END + " and event_id = -1"), F.expr(END + " and event_id = -2")], "append", "deb").filter("uri <> 'end'")
    batch = events.debounce(diagnostics, ["uri"], "6 HOURS").select("uri", "event_id")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))


def test_conflate(spark, diagnostics, tmp_path):
    _, early = halves(diagnostics)
    fed = with_end(spark, diagnostics)
    make = lambda s: streams.stream_conflate(s.withWatermark("ts", "0 seconds"), 12 * 3600)
    out = run(spark, fed, make, tmp_path, [early & ~F.expr(END), ~early & ~F.expr(END), F.expr(END + " and event_id = -1"), F.expr(END + " and event_id = -2")], "append", "con").filter("uri <> 'end'")
    batch = events.conflate_latest(diagnostics, "uri", 12 * 3600)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))


def test_documents(spark, sf_dir, tmp_path):
    e = view(spark, sf_dir, "edits").withColumn("uri", F.col("uri").cast("string")).withColumn("ordinal", F.lit(0)).withColumn("event_type", F.when(F.col("version") == 0, "open").otherwise("change"))
    out = run(spark, e, streams.stream_documents, tmp_path, [F.col("version") <= 1, F.col("version") > 1], "update", "docs")
    last = {}
    for r in out.collect():
        last[r.uri] = r.content
    # the memory sink keeps each batch's row; a document touched twice ends with the longer history
    batch = dict(map(tuple, events.document_lifecycle(e).collect()))
    touched_once = {r.uri for r in e.groupBy("uri").agg(F.max("version").alias("v")).filter("v <= 1").collect()}
    assert set(last) == set(batch)
    assert all(last[u] == batch[u] for u in touched_once)
    final = {(r.uri, r.content) for r in out.collect()}
    assert set(batch.items()) <= final


def test_snapshots_are_replay_safe(spark, tmp_path):
    schema = "uri string, version long, deleted boolean, rows array<struct<sym:string>>"
    one = spark.createDataFrame([("a", 1, False, [("x",)]), ("a", 2, False, [("y",)]), ("b", 5, False, [("z",)])], schema)
    two = spark.createDataFrame([("a", 1, False, [("late",)]), ("b", 6, True, [])], schema)
    state = file_versions.apply_versions(None, one)
    again = file_versions.apply_versions(file_versions.apply_versions(state, two), two)
    assert sorted(map(tuple, file_versions.live_rows(again).collect())) == [("a", 2, "y")]
    assert file_versions.read_snapshot(spark, str(tmp_path / "none"), one.schema) is None


def test_batches_rewrite_only_touched_buckets(spark, tmp_path):
    schema = "uri string, version long, deleted boolean, rows array<struct<sym:string>>"
    table = f"file://{tmp_path}/table"
    batches = [[("a", 1, False, [("x",)]), ("b", 1, False, [("y",)]), ("c", 1, False, [("z",)])], [("a", 2, False, [("x2",)])], [("a", 3, True, [])], [("a", 2, False, [("late",)]), ("b", 3, False, [])]]
    state = None
    for n, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, schema)
        state = spark.createDataFrame(file_versions.apply_versions(state, batch).collect(), schema)
        for _ in range(2):  # a replay changes nothing
            file_versions.upsert(batch, n, table, buckets=16)
            got = file_versions.read_snapshot(spark, table, batch.schema)
            assert sorted(map(str, got.collect())) == sorted(map(str, state.collect()))
    held = file_versions.snapshot(spark, table)
    assert sum(map(len, held.values())) <= 2 * len(held)
    touched = {len(b) for b in held.values()}
    assert 1 in touched and 2 in touched  # what no later batch touched was written once


def test_ties_of_a_version_do_not_depend_on_arrival(spark):
    schema = "uri string, version long, deleted boolean, rows array<struct<sym:string>>"
    made = [("a", 1, False, [("x",)]), ("a", 1, False, [("y",)]), ("b", 2, False, [("z",)]), ("b", 2, True, []), ("c", 3, False, None), ("c", 3, False, [])]
    df = lambda rows: spark.createDataFrame(rows, schema)
    whole = sorted(map(str, file_versions.apply_versions(None, df(made)).collect()))
    for order in (made, made[::-1]):
        state = None
        for row in order:
            state = df(file_versions.apply_versions(state, df([row])).collect())
        assert sorted(map(str, state.collect())) == whole
    assert "deleted=True" in next(r for r in whole if "uri='b'" in r)


def test_buckets_are_kept_with_the_table(spark, tmp_path):
    table = f"file://{tmp_path}/sized"
    assert file_versions.table_buckets(spark, table, expected_bytes=10 * file_versions.BUCKET_BYTES + 1) == 11
    assert file_versions.table_buckets(spark, table, expected_bytes=1) == file_versions.table_buckets(spark, table, buckets=5) == 11
    batch = spark.createDataFrame([(f"u{i}", 1, False, [("x",)]) for i in range(60)], "uri string, version long, deleted boolean, rows array<struct<sym:string>>")
    file_versions.upsert(batch, 0, table, buckets=3)
    assert set(file_versions.snapshot(spark, table)) == set(range(11))
    assert file_versions.read_snapshot(spark, table, batch.schema).count() == 60


def test_a_batch_is_read_for_its_buckets_and_once_to_be_written(spark, tmp_path):
    schema = "uri string, version long, deleted boolean, rows array<struct<sym:string>>"
    table, seen = f"file://{tmp_path}/once", spark.sparkContext.accumulator(0)

    def read(it):
        for got in it:
            seen.add(got.num_rows)
            yield got

    for n in range(2):
        spark.createDataFrame([(f"u{i}", n, False, [("x",)]) for i in range(50)], schema).write.parquet(f"{tmp_path}/in{n}")
        batch = spark.read.schema(schema).parquet(f"{tmp_path}/in{n}").mapInArrow(read, schema)
        file_versions.upsert(batch, n, table, buckets=40)
    assert seen.value == 2 * 2 * 50
    files = list((tmp_path / "once" / "batch=1").rglob("*.parquet"))
    assert len(files) == len({f.parent for f in files}) > 20


def test_rows_with_maps_have_an_order_too(spark):
    schema = "uri string, version long, deleted boolean, rows array<struct<m:map<string,int>>>"
    made = [("a", 1, False, [({"x": 1},)]), ("a", 1, False, [({"y": 1},)]), ("a", 0, False, [({"z": 1},)])]
    both = [file_versions.apply_versions(None, spark.createDataFrame(rows, schema)).collect() for rows in (made, made[::-1])]
    assert both[0] == both[1] and len(both[0]) == 1 and both[0][0].version == 1


def test_a_larger_stream_has_more_files_and_buckets_not_more_batches(spark, sf_dir, monkeypatch):
    """What a task of operator 58's query makes, chooses and writes is bounded, and the table is not rewritten more often."""
    tables = []
    start = file_versions.stream_file_versions
    monkeypatch.setattr(file_versions, "BUCKET_BYTES", 2_000)
    monkeypatch.setattr(ranges, "TASK_BYTES", 4_000)
    monkeypatch.setattr(file_versions, "stream_file_versions", lambda stream, table, *a, **k: tables.append(table) or start(stream, table, *a, **k))
    rows = sorted(map(tuple, QUERIES["sym58_stream_file_versions"](spark, sf_dir).collect()))
    assert rows == sorted(map(tuple, QUERIES["sym53_update_files"](spark, sf_dir).collect()))
    held = file_versions.snapshot(spark, tables[0])
    assert len(held) > 16 and len({n for batches in held.values() for n in batches}) == 2
    written = spark.read.parquet(tables[0].removesuffix("table") + "in/b").inputFiles()
    assert len(written) > 8
