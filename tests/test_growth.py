"""Operators whose work must not grow with the square of a key: results against plain versions, and what is made on the way."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from symtab.operators import events, ingest, lookup, maintain
from symtab.plans import index_queries

SPAN = "uri string, sym string, start_line int, start_col int, end_line int, end_col int"


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def timed(job):
    began = time.perf_counter()
    job()
    return time.perf_counter() - began


def brute_position(spans, points):
    out = []
    for qid, uri, line, col in points:
        held = [((s[4] - s[2]) * 10000 + s[5] - s[3], s[1]) for s in spans if None not in (uri, line, col, *s) and s[0] == uri and (s[2], s[3]) <= (line, col) <= (s[4], s[5])]
        if held:
            out.append((qid, min(held)[1]))
    return sorted(out, key=repr)


def test_positions_like_brute_force(spark):
    rng = random.Random(4)
    for lines, cols in ((3, 4), (40, 9), (1000, 130)):
        spans = []
        for i in range(150):
            a, b = sorted((rng.randrange(-2, lines), rng.randrange(-2, cols)) for _ in range(2))
            spans.append((f"u{i % 3}", f"s{i:03d}", *a, *b) if rng.random() < 0.9 else (f"u{i % 3}", f"s{i:03d}", *b, *a))
        spans += [("u0", "null", None, 1, 2, 2), (None, "nofile", 0, 0, lines, 0), ("u1", "twin1", 0, 0, lines, 0), ("u1", "twin0", 0, 0, lines, 0)]
        points = [(i, f"u{i % 4}", rng.randrange(-3, lines + 2), rng.randrange(-3, cols + 2)) for i in range(200)] + [(900, None, 1, 1), (901, "u1", None, 1), (902, "u1", 1, None)]
        found = lookup.resolve_at_position(spark.createDataFrame(spans, SPAN), spark.createDataFrame(points, "qid int, uri string, line int, col int"))
        assert rows(found) == brute_position(spans, points)


def test_positions_in_an_empty_batch(spark):
    spans = spark.createDataFrame([("u", "a", 0, 0, 9, 0)], SPAN)
    assert lookup.resolve_at_position(spans, spark.createDataFrame([], "qid int, uri string, line int, col int")).count() == 0
    assert lookup.resolve_at_position(spans.limit(0), spark.createDataFrame([(1, "u", 0, 0)], "qid int, uri string, line int, col int")).count() == 0


def test_a_hot_file_of_nested_spans(spark):
    """A hundred thousand spans, all around the middle of one file, and as many points there: 5 * 10**9 pairs."""
    n = 100_000
    spans = spark.range(n).select(F.lit("u").alias("uri"), F.format_string("s%06d", "id").alias("sym"), F.col("id").cast("int").alias("start_line"), F.lit(0).alias("start_col"), (2 * n - F.col("id")).cast("int").alias("end_line"), F.lit(5).alias("end_col"))
    points = spark.range(n).select(F.col("id").alias("qid"), F.lit("u").alias("uri"), (F.col("id") * 2).cast("int").alias("line"), F.lit(3).alias("col"))
    found = lookup.resolve_at_position(spans, points)
    assert timed(lambda: found.count()) < 90
    assert rows(found.filter("qid in (0, 7, 49999, 50000, 50001)")) == sorted([(0, "s000000"), (7, "s000014"), (49999, "s099998"), (50000, "s099999"), (50001, "s099998")], key=repr)


def brute_sets(events_):
    sets, out = {}, []
    for uri, ts, event, items, reset in sorted(events_, key=lambda e: (repr(e[0]), e[1], e[2])):
        held = set() if reset else sets.get(uri, set())
        held = sets[uri] = held | {i for i in items or [] if i is not None}
        out.append((event, sorted(held)))
    return sorted(out)


def test_sets_like_brute_force(spark):
    rng = random.Random(5)
    made = [(rng.choice(["a", "b", None]), rng.randrange(50), i, rng.choice([None, [], [None], [rng.choice("pqrst") for _ in range(rng.randrange(4))]]), rng.choice([True, False, False, False, None])) for i in range(400)]
    df = spark.createDataFrame(made, "uri string, ts int, event_id long, found array<string>, reset boolean").withColumn("_AT", F.lit(1)).withColumn("_epoch", F.lit("x"))
    out = events.accumulate_with_reset(df, item="found")
    assert out.columns == [*df.columns, "items"]
    assert [(r.event_id, r["items"]) for r in sorted(out.collect(), key=lambda r: r.event_id)] == brute_sets(made)


def test_sets_of_a_hot_key_grow_with_the_events(spark):
    """One file with ten items that come again and again: a hundred thousand events take about as long a piece as fifty thousand."""

    def job(n):
        e = spark.range(n).select(F.lit("u").alias("uri"), F.col("id").alias("ts"), F.col("id").alias("event_id"), F.array((F.col("id") * 7 % 10).cast("string"), (F.col("id") % 10).cast("string")).alias("item"), F.lit(False).alias("reset"))
        out = events.accumulate_with_reset(e)
        assert out.agg(F.sum(F.size("items")), F.count("*")).first()[1] == n
        return out

    job(1000)
    small, large = timed(lambda: job(50_000)), timed(lambda: job(200_000))
    assert large < 8 * small + 5 and large < 60


def test_prefixes_like_brute_force(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abé中\U0001f600") for _ in range(rng.randrange(5))) for _ in range(700)] + [None, ""] + ["ab"] * 600
    asked = [*("", "a", "ab", "AB", "abé", "é", "中", "\U0001f600", "zz", "b\U0001f600", "a"), None]
    symbols = spark.createDataFrame(list(enumerate(words)), "sid int, name_key string")
    queries = spark.createDataFrame(list(enumerate(asked)), "qid int, query string")
    found = lookup.search_prefix(symbols, queries, "name_key")
    assert found.columns == ["sid", "name_key", "qid", "query"]
    assert rows(found, "sid", "qid") == sorted(((i, j) for i, w in enumerate(words) for j, q in enumerate(asked) if w is not None and q is not None and w.startswith(q.lower())), key=repr)
    assert lookup.search_prefix(symbols, queries.limit(0), "name_key").count() == 0
    assert lookup.search_prefix(symbols.limit(0), queries, "name_key").count() == 0


def joined_rows(df):
    """Rows that each side of each join had, from the metrics of the executed plan."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        if "Join" in name:
            out.append(node)
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return [n.metrics().apply("numOutputRows").value() for n in out]


@pytest.mark.parametrize("lengths", [1, 12])
def test_prefix_rows_do_not_grow_with_query_lengths(spark, lengths):
    """Each join hands on no more than the rows, or what is found; one name that a third of all rows have is no hot key."""
    keys = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.lit("samename")).otherwise(F.format_string("k%011d", "id")).alias("name_key"))
    queries = spark.createDataFrame([("k" + "0" * i + "~",) for i in range(lengths)] + [("same",)], "query string")
    found = lookup.search_prefix(keys, queries, "name_key")
    assert found.count() == 2000
    assert max(joined_rows(found)) <= 6000
    stored = [r["count"] for r in found.select("name_key").groupBy("name_key").count().collect()]
    assert stored == [2000]


def test_the_empty_query_is_dealt_out(spark):
    keys = spark.range(20_000).select("id", F.lit("same").alias("name_key"))
    found = lookup.search_prefix(keys, spark.createDataFrame([("",)], "query string"), "name_key").select("id", F.expr(f"id div {lookup.RUN}").alias("run"))
    assert found.count() == 20_000


def brute_runs(made, service):
    by_key = {}
    for key, ts, event in made:
        if ts is not None:
            by_key.setdefault(key, []).append((ts, event))
    out = []
    for key, found in by_key.items():
        found.sort()
        out += [(key, found[i][1], start) for i, start in events.conflate_times([t for t, _ in found], service)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("spread", [3, 40])
def test_conflation_like_the_fold(spark, spread, monkeypatch):
    """Gaps of all widths around the service time, ties, repeated rows, a null key and a null time; slices of few service times."""
    monkeypatch.setattr(events, "SLICE", 3)
    rng = random.Random(spread)
    made, service = [], 10
    for key in ("a", "b", None, "d"):
        t = rng.randrange(100)
        for i in range(120):
            t += rng.choice([0, 0, 1, 5, 9, 10, 11, 12, 19, 20, 21, rng.randrange(spread)])
            made.append((key, t, rng.randrange(40) if i % 7 else 5))
    made += [("p", 13 * i, i) for i in range(200)] + [("q", 11 * i, i) for i in range(64)] + [("a", None, 1), ("one", 5, 1), ("two", 5, 1), ("two", 5, 1)] + made[:10]
    df = spark.createDataFrame(made, "uri string, s long, event_id long").withColumn("ts", F.timestamp_seconds("s"))
    kind = "timestamp" if spread < 10 else "timestamp_ntz"
    out = events.conflate_latest(df.withColumn("ts", F.col("ts").cast(kind)), "uri", service)
    assert out.columns == ["uri", "event_id", "start"] and out.schema["start"].dataType.simpleString() == kind
    assert rows(out.select("uri", "event_id", F.unix_seconds(F.col("start").cast("timestamp")))) == brute_runs(made, service)


def test_conflation_of_one_key_is_dealt_out(spark):
    """One key with 100,000 events, in gaps that are rarely certain: as the fold says, and no task reads them all."""
    n = 100_000
    e = spark.range(n).select(F.lit("u").alias("uri"), F.timestamp_seconds(F.col("id") * 7 + F.pmod(F.xxhash64("id"), F.lit(9))).alias("ts"), F.col("id").alias("event_id"))
    out = events.conflate_latest(e, "uri", 10)
    began = time.perf_counter()
    found = rows(out.select("event_id", F.unix_seconds("start")))
    assert time.perf_counter() - began < 120
    times = sorted((r[0], r[1]) for r in e.select(F.unix_seconds("ts"), "event_id").collect())
    assert found == sorted(((times[i][1], s) for i, s in events.conflate_times([t for t, _ in times], 10)), key=repr)


def test_edits_before_a_reset_never_reach_the_fold(spark, monkeypatch):
    schema = "uri string, version int, ordinal int, full_replace boolean, start_line int, start_col int, end_line int, end_col int, text string, event_type string"
    made = [("u", v, 0, v in (3, 90), 0, 0, 0, 0, f"{v};", "change") for v in range(100)] + [("c", 1, 0, False, 0, 0, 0, 0, "x", "open"), ("c", 2, 0, False, 0, 0, 0, 0, None, "close"), ("c", 3, 0, False, 0, 0, 0, 0, "y", "open")]
    kept = events._since_reset(spark.createDataFrame(made, schema))
    assert rows(kept.groupBy("uri").count()) == [("c", 2), ("u", 10)]
    assert rows(events.document_lifecycle(spark.createDataFrame(made, schema))) == [("c", "y"), ("u", "".join(f"{v};" for v in range(99, 89, -1)))]


def test_names_like_brute_force(spark, monkeypatch):
    """Names of many rows and many queries, repeated and null ones, other columns kept, with blocks of few rows."""
    monkeypatch.setattr(lookup, "BLOCK", 5)
    rng = random.Random(7)
    words = [rng.choice(["ab", "aB", "AB", "abé", "ABÉ", "c", None, ""]) for _ in range(90)]
    asked = [rng.choice(["ab", "AB", "abÉ", "d", None, ""]) for _ in range(60)]
    symbols = lookup.with_keys(spark.createDataFrame(list(enumerate(words)), "sid int, name string"))
    queries = spark.createDataFrame([*enumerate(asked), (0, asked[0])], "qid int, query string")
    found = lookup.symbols_by_name(symbols, queries)
    assert found.columns == ["name_key", "sid", "name", "initials_key", "qid", "query"]
    want = [(i, j) for j, q in [*enumerate(asked), (0, asked[0])] for i, w in enumerate(words) if w is not None and q is not None and w.lower() == q.lower()]
    assert rows(found, "sid", "qid") == sorted(want, key=repr)
    assert lookup.symbols_by_name(symbols.limit(0), queries).count() == lookup.symbols_by_name(symbols, queries.limit(0)).count() == 0


def test_one_name_is_dealt_out(spark, monkeypatch):
    """A name of 4,000 rows that 4,000 queries ask for: sixteen million rows, of which no task makes more than a fifth."""
    monkeypatch.setattr(lookup, "BLOCK", 200, raising=False)
    monkeypatch.setattr(lookup, "TASK_PAIRS", 500_000, raising=False)
    symbols = lookup.with_keys(spark.range(4000).select(F.col("id").alias("sid"), F.when(F.col("id") >= 0, "Same").alias("name")))
    found = lookup.symbols_by_name(symbols, spark.range(4000).select(F.col("id").alias("qid"), F.when(F.col("id") >= 0, "SAME").alias("query")))
    made = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 16_000_000 and max(made) < 3_200_000


def shuffled(spark, after: int = -1) -> tuple[int, int]:
    """The last stage so far, and the rows that stages after the given one handed to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(10_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    stages = [stages.apply(i) for i in range(stages.size())]
    return max((s.stageId() for s in stages), default=-1), sum(s.shuffleWriteRecords() for s in stages if s.stageId() > after)


def test_pairs_of_one_name_need_little_disk(spark, tmp_path, monkeypatch):
    """8,192 rows and 2,048 queries of a name: few rows are shuffled, however small the blocks, and files have a sixth of a byte a row."""
    monkeypatch.setattr(lookup, "BLOCK", 128)
    symbols = lookup.with_keys(spark.range(8192).select(F.col("id").alias("sid"), F.when(F.col("id") >= 0, "Same").alias("name"))).select("sid", "name_key")
    queries = spark.range(2048).select(F.col("id").alias("qid"), F.when(F.col("id") >= 0, "SAME").alias("query"))
    last, _ = shuffled(spark)
    lookup.symbols_by_name(symbols, queries).select("qid", "sid").write.format("noop").mode("overwrite").save()
    assert shuffled(spark, last)[1] < 50_000  # 8,192 * 16 + 2,048 * 64 copies of rows were 262,144
    monkeypatch.undo()
    lookup.symbols_by_name(symbols, queries).select("qid", "sid").write.parquet(str(tmp_path / "pairs"))
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 8192 * 2048 / 6
    found = spark.read.parquet(str(tmp_path / "pairs")).groupBy("qid").agg(F.count("*").alias("n"), F.sum(F.col("sid") * F.col("sid")).alias("squares")).groupBy("n", "squares").count()
    assert rows(found) == [(8192, sum(i * i for i in range(8192)), 2048)]


def test_names_of_wide_and_equal_rows(spark, monkeypatch):
    """Rows that are wide make small blocks and turns, equal rows are dealt like others; columns of any name and type are kept."""
    monkeypatch.setattr(lookup, "BLOCK_BYTES", 20_000, raising=False)
    monkeypatch.setattr(lookup, "TURN_BYTES", 2_000, raising=False)
    made = [(None if i % 3 == 0 else 7, "x" * (i % 5 * 900), [i % 4, None]) for i in range(120)]
    symbols = lookup.with_keys(spark.createDataFrame([("N", *r) for r in made], "name string, `a.b` int, wide string, many array<int>"))
    queries = spark.createDataFrame([("n", 1.5, "y" * 700), ("n", None, None), ("n", None, None), ("o", 1.0, "z")] * 10, "query string, `a.b` double, text string")
    found = lookup.symbols_by_name(symbols, queries)
    assert found.columns == ["name_key", "name", "a.b", "wide", "many", "initials_key", "query", "a.b", "text"]
    got = Counter((r[0], r[2], r[3], tuple(r[4]), *r[6:]) for r in found.collect())
    assert got == Counter(("n", a, w, tuple(m), *q) for a, w, m in made for q in [("n", 1.5, "y" * 700), ("n", None, None), ("n", None, None)] * 10)


def test_class_files_are_dealt_out_by_number(spark, sf_dir, monkeypatch):
    """A table of few bytes makes much work: no task has more than about two hundred of its class files' rows."""
    monkeypatch.setattr(index_queries, "CLASS_FILES", 50, raising=False)
    found = index_queries.QUERIES["sym02_extract_classfile_symbols"](spark, sf_dir)
    made = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(made) > 3 and max(made) <= 250


def test_large_inputs_are_dealt_out_by_bytes(spark, tmp_path, monkeypatch):
    """More tasks than the session's four for a state and for files' candidates whose bytes ask for them."""
    from symtab.operators import ranges

    monkeypatch.setattr(ranges, "TASK_BYTES", 5_000)
    path = str(tmp_path / "state")
    spark.range(20_000).selectExpr("concat('u', id) as uri", "id % 50 as target_id", "concat('1.', id % 7) as version").coalesce(1).write.parquet(path)
    state = spark.read.schema("uri string, target_id long, version string").parquet(path)
    left = maintain.remove_files(state, state.filter("target_id = 3").select("uri"))
    best = ingest.best_target_for_file(state.select("uri", "target_id"), ingest.latest_per_target(state.select("target_id", "version")))
    for df, n in ((left, 19_600), (best, 20_000)):
        made = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(made) == n and len(made) > 8 and max(made) < n / 4
    assert {r.version for r in best.select("version").distinct().collect()} == {"1.6"}
