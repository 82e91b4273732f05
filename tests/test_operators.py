"""Behaviour that oracles over the driver's tables don't show, and the plans."""

import pytest
from pyspark.sql import functions as F

from symtab.functions import text
from symtab.operators import events, hierarchy, ingest, lookup, maintain, stats
from symtab.plans.fixtures import view


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_search_styles(spark):
    symbols = spark.createDataFrame([("s1", "HashMap"), ("s2", "indexOf")], "sym string, name string")
    hits = {"hashmap": True, "HM": True, "hash": True, "HashMap": True, "IO": False, "HashMaps": False}
    found = lookup.search_symbols(symbols, spark.createDataFrame([(q,) for q in hits], "query string")).collect()
    assert sorted((r.query, r.sym) for r in found) == sorted((q, "s1") for q, hit in hits.items() if hit)


def test_prefixes(spark):
    keys = spark.range(10000).select(F.format_string("key%05d", "id").alias("name"), "id")
    asked = spark.createDataFrame([("key001",), ("",), ("key0012",), ("nokey",)], "query string")
    found = dict(lookup.search_prefix(lookup.with_keys(keys), asked, "name_key").groupBy("query").count().collect())
    assert found == {"key001": 100, "": 10000, "key0012": 10}


def test_hierarchy_cycle_and_depth(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "parent string, child string")
    start = spark.createDataFrame([("a",)], "parent string")
    assert rows(hierarchy.transitive_subtypes(edges, start)) == [("a", "a", 3), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3)]
    assert rows(hierarchy.transitive_subtypes(edges, start, 2)) == [("a", "b", 1), ("a", "c", 2)]
    assert hierarchy.transitive_subtypes(edges, spark.createDataFrame([("zz",)], "parent string")).count() == 0


def test_implementations_are_concrete(spark):
    symbols = spark.createDataFrame([("MyTrait", "MyTrait", "Trait"), ("Abstract", "Abstract", "Trait"), ("Concrete", "Concrete", "Class")], "sym string, name string, kind string")
    edges = spark.createDataFrame([("MyTrait", "Abstract"), ("Abstract", "Concrete"), ("Abstract", "Gone")], "parent string, child string")
    found = hierarchy.implementations(symbols, edges, spark.createDataFrame([("MyTrait",)], "parent string"))
    assert rows(found, "sym") == [("Concrete",)]


def test_position(spark):
    symbols = spark.createDataFrame([("u", "Outer", 0, 0, 20, 0), ("u", "inner", 5, 2, 10, 2), ("u", "twin", 5, 2, 10, 2)], "uri string, sym string, start_line int, start_col int, end_line int, end_col int")
    positions = spark.createDataFrame([(1, "u", 7, 5), (2, "u", 15, 0), (3, "u", 30, 0), (4, "v", 7, 5)], "qid int, uri string, line int, col int")
    assert rows(lookup.resolve_at_position(symbols, positions)) == [(1, "inner"), (2, "Outer")]


def test_replaying_batches_equals_one_build(spark, sf_dir):
    refs = view(spark, sf_dir, "refs")
    state = refs.limit(0)
    for part in range(3):
        batch = refs.filter(F.crc32("uri") % 3 == part)
        state = maintain.update_files(state, batch.select("uri"), batch)
    state = maintain.update_files(state, refs.select("uri").limit(50), refs.join(refs.select("uri").limit(50).distinct(), "uri", "left_semi"))
    assert state.exceptAll(refs.select(*state.columns)).isEmpty() and refs.select(*state.columns).exceptAll(state).isEmpty()


def test_failed_compile(spark):
    state = spark.createDataFrame([("a", 1), ("b", 2)], "uri string, sym int")
    changed = spark.createDataFrame([("a",)], "uri string")
    assert rows(maintain.apply_compile_output(state, changed, None)) == [("b", 2)]
    assert rows(maintain.apply_compile_output(state, changed, None, "keep")) == [("a", 1), ("b", 2)]
    everything = maintain.apply_compile_output(state, changed.limit(0), spark.createDataFrame([("a", 7), ("c", 8)], "uri string, sym int"))
    assert rows(everything) == [("a", 7), ("b", 2), ("c", 8)]


def test_deleted_sources(spark):
    prev = spark.createDataFrame([("a", "1"), ("b", "1"), ("gone", "1")], "source string, stamp string")
    curr = spark.createDataFrame([("a", "1"), ("b", "2"), ("new", "1")], "source string, stamp string")
    assert rows(maintain.changed_sources(prev, curr)) == [("b",), ("new",)]
    assert rows(maintain.changed_sources(prev, curr, include_deleted=True)) == [("b",), ("gone",), ("new",)]


EDIT = "uri string, version long, ordinal int, full_replace boolean, start_line int, start_col int, end_line int, end_col int, text string"


def test_double_edit(spark):
    docs = spark.createDataFrame([("u", "one two\nthree four\nfive six"), ("still", "x")], "uri string, content string")
    edits = spark.createDataFrame([("u", 1, 0, False, 1, 0, 1, 6, ""), ("u", 1, 1, False, 0, 3, 1, 1, "\nsh"), ("new", 1, 0, False, 0, 0, 0, 0, "fresh")], EDIT)
    assert rows(events.fold_edits(docs, edits)) == [("new", "fresh"), ("still", "x"), ("u", "one\nshour\nfive six")]


def test_missing_line_prepends_and_columns_count_utf16(spark):
    assert events.apply_edit("abc", (9, 0), (9, 0), "X") == "Xabc"
    docs = spark.createDataFrame([("u", "\U0001f600b")], "uri string, content string")
    edits = spark.createDataFrame([("u", 1, 0, False, 0, 2, 0, 3, "c")], EDIT)
    assert rows(events.fold_edits(docs, edits)) == [("u", "\U0001f600c")]


def test_offsets_count_utf16_units(spark):
    lines = spark.createDataFrame([("\U0001f600a\nb", 1, 0), ("ab\nc", 1, 1), ("ab", 2, 0), ("ab", -1, 0), ("", 0, 3)], "text string, line int, col int")
    assert [r[0] for r in lines.select(text.line_col_to_offset(F.col("text"), F.col("line"), F.col("col"))).collect()] == [4, 4, -1, -1, 3]


def test_debug_index_without_matches(spark):
    counts = spark.createDataFrame([(3, 4)], "project_symbols int, files int")
    row = stats.debug_index(counts, spark.createDataFrame([], "name_key string, sym string")).first()
    assert (row.project_symbols, row.files, row.matches) == (3, 4, [])


def test_owner_must_exist(spark):
    paths = spark.createDataFrame([(1, "a.jar"), (1, "b.jar"), (2, "a.jar"), (2, "c.jar"), (2, "out.jar"), (3, "x.txt")], "target_ord int, path string")
    only = lambda *p: paths.filter(F.col("path").isin(*p)).select("path")
    owners = ingest.assign_container_owner(paths, only("out.jar"), only("a.jar", "c.jar", "out.jar"))
    assert rows(ingest.with_class_path(owners, paths), "path", "target_ord", "class_path") == [("a.jar", 1, ["a.jar", "b.jar"]), ("c.jar", 2, ["a.jar", "c.jar", "out.jar"])]


def test_sets_may_be_empty_or_null(spark):
    e = spark.createDataFrame([("u", 1, 1, ["b", None, "a"], False), ("u", 2, 2, None, False), ("u", 3, 3, [], True), ("u", 4, 4, ["c"], False), ("v", 1, 5, None, False)], "uri string, ts int, event_id long, item array<string>, reset boolean")
    assert rows(events.accumulate_with_reset(e), "event_id", "items") == [(1, ["a", "b"]), (2, ["a", "b"]), (3, []), (4, ["c"]), (5, [])]


def test_lifecycle(spark):
    schema = EDIT + ", event_type string"
    e = lambda uri, version, kind, text: (uri, version, 0, False, 0, 0, 0, 0, text, kind)
    found = events.document_lifecycle(spark.createDataFrame([
        e("a", 1, "open", "one"), e("a", 2, "open", "two"), e("b", 1, "open", "x"), e("b", 2, "close", None), e("c", 1, "change", "made"), e("d", 1, "save", "s"), e("d", 2, "change", "t"),
    ], schema))
    assert rows(found) == [("a", "one"), ("c", "made"), ("d", "ts")]


def test_conflation_boundary():
    assert events.conflate_times([0, 1, 2, 3], 3) == [(0, 0), (3, 3)]  # an arrival as a run ends is pending
    assert events.conflate_times([0, 4], 3) == [(0, 0), (1, 4)]
    assert events.conflate_times([0, 1, 10], 3) == [(0, 0), (1, 3), (2, 10)]


@pytest.mark.parametrize("name", ["sym25_get_symbols", "sym27_search_prefix", "sym28_search_symbols", "sym30_references_of", "sym34_resolve_at_position", "sym36_subtypes", "sym39_implementations"])
def test_plans_have_no_nested_loops(spark, sf_dir, name):
    from symtab.plans.registry import QUERIES

    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_lookup_reads_only_what_it_needs(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").withColumnRenamed("p_partkey", "sid")
    asked = spark.createDataFrame([(7,)], "sid long")
    plan = lookup.get_symbols(part, asked, "sid").select("sid", "p_name")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in plan and "PushedFilters: [IsNotNull(p_partkey)]" in plan


def test_rollup_keeps_first_messages(spark):
    diags = spark.range(50).select(F.lit("c").alias("container"), F.col("id").alias("seq"), (F.col("id") == 49).alias("is_error"), F.col("id").cast("string").alias("message"))
    row = stats.diagnostic_rollup(diags).first()
    assert (row.errors, row.warnings, row.status, row.messages) == (1, 49, "Error", [str(i) for i in range(20)])
