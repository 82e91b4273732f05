"""Queries for sources, scalar functions, lookups, hierarchy, ingest and statistics (operators 1 to 52)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symtab.functions import ids as I
from symtab.functions import text as T
from symtab.operators import hierarchy, ingest, lookup, stats
from symtab.plans.fixtures import class_bytes, ctes, damaged_zip, table, view, write_archives, zip_bytes
from symtab.scratch import scratch_path
from symtab.sources import archives, cache

#: Class files that a task makes and reads.
CLASS_FILES = 10_000

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


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "symbols")


# sources and sinks

@query("SELECT 'lib/' || source || '-' || (doc_id // 50) || '.jar' AS container, doc_id || '.txt' AS entry, octet_length(encode(text))::BIGINT AS size FROM documents")
def sym01_scan_archives(spark, d):
    """Archives of 50 documents each are written to the shared folder, then scanned as files."""
    docs = table(spark, d, "documents").select(F.format_string("lib/%s-%d.jar", "source", F.expr("doc_id div 50")).alias("path"), "doc_id", "text")
    folder = scratch_path(spark, "archives")
    write_archives(docs, folder, lambda rows: zip_bytes([(f"{i}.txt", t.encode()) for i, t in rows]))
    return archives.scan_archives(spark, folder, contents=False).select(F.regexp_extract("container", "lib/[^/]*$", 0).alias("container"), "entry", "size")


@query(ctes("symbols") + """,
c AS (SELECT sid, pkg, owner1, owner2, pkg || '.' || owner1 AS outer_sym, pkg || '.' || owner1 || '.' || owner2 AS cls, kind FROM symbols)
SELECT cls AS sym, owner2 AS name, CASE kind WHEN 'Enum' THEN 'Enum' WHEN 'Trait' THEN 'Trait' ELSE 'Class' END AS kind, 'Public' AS visibility, outer_sym AS owner, pkg || '.Base,p9.Face' AS parents FROM c
UNION ALL SELECT cls || '.f()', 'f', CASE WHEN sid % 2 = 0 THEN 'Val' ELSE 'Var' END, 'Public', cls, '' FROM c
UNION ALL SELECT cls || '.<init>()', '<init>', 'Constructor', CASE sid % 3 WHEN 0 THEN 'Public' WHEN 1 THEN 'Private' ELSE 'Protected' END, cls, '' FROM c
UNION ALL SELECT cls || '.run()', 'run', 'Method', 'Public', cls, '' FROM c WHERE sid % 5 <> 0
""")
def sym02_extract_classfile_symbols(spark, d):
    """Class files are made from a row each and read; the table has few bytes for that work, so tasks get equal numbers of rows."""

    def build(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            data = []
            for s in pdf.itertuples(index=False):
                outer, name = f"{s.pkg}/{s.owner1}", f"{s.pkg}/{s.owner1}${s.owner2}"
                flags = {"Enum": 0x4001, "Trait": 0x201}.get(s.kind, 1)
                methods = [("<init>", "()V", (1, 2, 4)[s.sid % 3]), ("run", "()V", 0x1001 if s.sid % 5 == 0 else 1), ("<clinit>", "()V", 8)]
                data.append(class_bytes(name, flags, f"{s.pkg}/Base", ["p9/Face"], [("f", "I", 0x11 if s.sid % 2 == 0 else 1)], methods, (name, outer, s.owner2)))
            yield pd.DataFrame({"container": pdf["owner1"] + ".jar", "entry": pdf["owner2"] + ".class", "bytes": data})

    s = _symbols(spark, d).select("sid", "pkg", "owner1", "owner2", "kind")
    entries = s.repartition(s.count() // CLASS_FILES + 1).mapInPandas(build, "container string, entry string, bytes binary")
    return archives.extract_classfile_symbols(entries).select("sym", "name", "kind", "visibility", "owner", F.array_join("parents", ",").alias("parents"))


@query("SELECT 'lib/' || s_suppkey || '.jar' AS container, 'g' || s_nationkey AS group_id, CASE WHEN s_suppkey % 3 = 0 THEN 'second' ELSE 'first' END AS artifact_id, '1.' || s_suppkey AS version FROM supplier WHERE s_suppkey % 6 <> 0")
def sym03_archive_coordinates(spark, d):
    s = table(spark, d, "supplier")
    key = F.col("s_suppkey")
    said = lambda artifact, full: F.concat(F.lit("#made\ngroupId=g"), F.col("s_nationkey"), F.lit(f"\nartifactId={artifact}\n"), F.when(full, F.concat(F.lit("version=1."), key, F.lit("\n"))).otherwise(""))
    files = F.array(
        F.struct(F.lit("META-INF/maven/g/a/pom.properties").alias("entry"), F.lit(1).cast("long").alias("entry_index"), said("first", key % 3 != 0).alias("t")),
        F.struct(F.lit("META-INF/maven/g/b/pom.properties").alias("entry"), F.lit(2).cast("long").alias("entry_index"), said("second", key % 6 != 0).alias("t")),
        F.struct(F.lit("other/pom.properties").alias("entry"), F.lit(0).cast("long").alias("entry_index"), said("other", F.lit(True)).alias("t")),
    )
    entries = s.select(F.concat(F.lit("lib/"), key, F.lit(".jar")).alias("container"), F.explode(files).alias("f")).select("container", "f.entry", "f.entry_index", F.encode("f.t", "UTF-8").alias("bytes"))
    return archives.archive_coordinates(entries)


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def sym04_content_sha256(spark, d):
    return cache.content_sha256(table(spark, d, "documents"), "text").select("doc_id", "sha")


def _cached(spark, d):
    docs = cache.content_sha256(table(spark, d, "documents").select("doc_id", "text"), "text")
    return docs.drop("text"), docs.filter("doc_id % 3 = 0").select("sha", F.lit("1").alias("version"))


@query("SELECT doc_id, sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) AS hit FROM documents")
def sym05_cache_lookup(spark, d):
    inputs, manifest = _cached(spark, d)
    hits, misses = cache.cache_lookup(inputs, manifest, "1")
    return hits.select("doc_id", F.lit(True).alias("hit")).unionByName(misses.select("doc_id", F.lit(False).alias("hit")))


@query("SELECT DISTINCT sha256(text) AS sha, length(text) AS n FROM documents WHERE lang = 'en'")
def sym06_cache_store(spark, d):
    docs = cache.content_sha256(table(spark, d, "documents").select("text", "lang"), "text")
    results = docs.filter("lang = 'en'").select("sha", F.length("text").cast("long").alias("n")).distinct()
    folder = scratch_path(spark, "cache")
    cache.cache_store(results, docs.select("sha"), folder, "1")
    return cache.cache_read(spark, folder, docs.select("sha"), "1").select("sha", "n")


@query(ctes("symbols") + " SELECT sid, name, kind, uri, in_project FROM symbols")
def sym07_symbols_json(spark, d):
    rows = _symbols(spark, d).select("sid", "name", "kind", F.struct(F.lit("ProjectSource").alias("_kind"), F.col("uri").alias("source_file")).alias("origin"), "in_project")
    back = cache.symbols_from_json(cache.symbols_to_json(rows), rows.schema)
    return back.select("sid", "name", "kind", F.col("origin.source_file").alias("uri"), "in_project")


# scalar functions

def _ids(spark, d) -> DataFrame:
    s = _symbols(spark, d)
    is_type = F.col("kind").isin("Class", "Trait", "Enum")
    return s.withColumn("id", I.symbol_id(F.array("pkg"), F.array(F.concat("owner1", F.lit("$")), F.col("owner2")), F.concat("name", F.when(F.col("sid") % 2 == 0, "$").otherwise("")), is_type))


@query(ctes("symbols") + " SELECT sid, pkg, owner1 || '/' || owner2 AS owners, name, kind NOT IN ('Class', 'Trait', 'Enum') AS is_term FROM symbols")
def sym08_symbol_id(spark, d):
    return _ids(spark, d).select("sid", F.array_join("id.pkg", "/").alias("pkg"), F.array_join("id.owners", "/").alias("owners"), "id.name", "id.is_term")


@query(ctes("jvm_names") + """,
p AS (SELECT *, split_part(internal_name, '/', 1) AS pkg, split_part(internal_name, '/', 2) AS last FROM jvm_names),
q AS (SELECT *, CASE WHEN last LIKE '%$' THEN left(last, -1) ELSE last END AS bare FROM p),
r AS (SELECT *, coalesce(inner_simple, bare) AS cls, CASE WHEN inner_outer IS NULL THEN '' ELSE split_part(inner_outer, '/', 2) || '.' END AS own FROM q)
SELECT k, CASE WHEN member IS NOT NULL THEN pkg || '.' || own || cls || '.' || member || '()' WHEN last LIKE '%$' THEN pkg || '.' || own || cls || '()' ELSE pkg || '.' || own || cls END AS sym FROM r""")
def sym09_parse_jvm_name(spark, d):
    return view(spark, d, "jvm_names").select("k", I.render_symbol_id(I.parse_jvm_name(*map(F.col, ("internal_name", "member", "inner_outer", "inner_simple")))).alias("sym"))


_SDB = r"""c AS (SELECT *, regexp_replace(symbol, '\(\+?\d*\)', '', 'g') AS cleaned FROM {0}),
t AS (SELECT *, regexp_extract(cleaned, '^(.*)/[^/]*$', 1) AS pkg, list_filter(regexp_split_to_array(regexp_extract(cleaned, '([^/]*)$', 1), '[.#]'), lambda x: x <> '') AS tokens FROM c),
s AS (SELECT *, replace(pkg, '/', '.') || '.' || array_to_string(tokens, '.') || CASE WHEN cleaned LIKE '%#' THEN '' ELSE '()' END AS sym FROM t)"""


@query(ctes("semanticdb_strings") + "," + _SDB.replace("{0}", "semanticdb_strings") + " SELECT k, sym, tokens[-1] AS name FROM s")
def sym10_parse_semanticdb_symbol(spark, d):
    id_ = I.parse_semanticdb_symbol(F.col("symbol"))
    return view(spark, d, "semanticdb_strings").select("k", I.render_symbol_id(id_).alias("sym"), id_["name"].alias("name"))


@query(ctes("symbols") + " SELECT sid, pkg || '.' || owner1 || '.' || owner2 || '.' || name || CASE WHEN kind IN ('Class', 'Trait', 'Enum') THEN '' ELSE '()' END AS sym FROM symbols")
def sym11_render_symbol_id(spark, d):
    return _ids(spark, d).select("sid", I.render_symbol_id(F.col("id")).alias("sym"))


#: Initials in DuckDB, whose regular expressions have no look-behind.
_INITIALS = "CASE WHEN regexp_matches(name, '^[A-Z]') THEN lower(list_reduce(list_prepend('', list_filter(list_transform(range(1, length(name) + 1), lambda i: CASE WHEN i = 1 OR (regexp_matches(name[i], '[A-Z]') AND (regexp_matches(name[i - 1], '[a-z]') OR regexp_matches(name[i + 1], '[a-z]'))) THEN name[i] ELSE '' END), lambda x: x <> '')), lambda a, b: a || b)) ELSE '' END"
_KEYED = ctes("symbols", "search_queries") + f",\nkeyed AS (SELECT *, lower(name) AS name_key, {_INITIALS} AS initials_key FROM symbols)"


@query(ctes("symbols") + " SELECT sid, lower(name) AS name_key FROM symbols")
def sym12_name_key(spark, d):
    return _symbols(spark, d).select("sid", I.name_key(F.col("name")).alias("name_key"))


@query(_KEYED + " SELECT sid, initials_key FROM keyed")
def sym13_initials_key(spark, d):
    return _symbols(spark, d).select("sid", I.initials_key(F.col("name")).alias("initials_key"))


@query("SELECT p_partkey AS sid, regexp_full_match(upper(split_part(p_name, ' ', 1)), '[A-Z]{2,}') AND p_size % 2 = 0 AS is_initials FROM part")
def sym14_is_initials_query(spark, d):
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    return table(spark, d, "part").select(F.col("p_partkey").alias("sid"), I.is_initials_query(F.when(F.col("p_size") % 2 == 0, F.upper(word)).otherwise(word)).alias("is_initials"))


_FLAGS = "SELECT l_orderkey AS k, l_linenumber AS ln, l_partkey AS p, (floor(l_quantity)::INT * 257) & 32767 AS flags FROM lineitem"


def _flags(spark, d) -> DataFrame:
    flags = (F.floor("l_quantity").cast("int") * 257).bitwiseAND(F.lit(32767))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("p"), flags.alias("flags"))


@query(f"WITH f AS ({_FLAGS}) SELECT k, ln, p, CASE WHEN flags & 2 <> 0 THEN 'Private' WHEN flags & 4 <> 0 THEN 'Protected' ELSE 'Public' END AS visibility FROM f")
def sym15_access_visibility(spark, d):
    return _flags(spark, d).select("k", "ln", "p", I.access_visibility(F.col("flags")).alias("visibility"))


@query(f"""WITH f AS ({_FLAGS}) SELECT k, ln, p, CASE WHEN flags & 16384 <> 0 THEN 'Enum' WHEN flags & 512 <> 0 THEN 'Trait' WHEN p % 3 = 0 AND p % 2 <> 0 THEN 'Object' ELSE 'Class' END AS class_kind,
CASE WHEN flags & 16384 <> 0 THEN 'EnumCase' WHEN flags & 16 <> 0 THEN 'Val' ELSE 'Var' END AS field_kind FROM f""")
def sym16_classify_kind(spark, d):
    name = F.concat(F.lit("a/B"), F.when(F.col("p") % 3 == 0, "$").otherwise(""), F.when(F.col("p") % 6 == 0, "$").otherwise(""))
    return _flags(spark, d).select("k", "ln", "p", I.classify_kind(F.col("flags"), name, "class").alias("class_kind"), I.classify_kind(F.col("flags"), name, "field").alias("field_kind"))


@query(f"WITH f AS ({_FLAGS}) SELECT k, ln, p, flags & 4096 = 0 AND p % 7 <> 0 AS class_kept, flags & 4160 = 0 AND p % 5 <> 0 AS method_kept FROM f")
def sym17_keep_symbol(spark, d):
    cls = F.when(F.col("p") % 7 == 0, "a/B$anon$1").otherwise("a/B")
    method = F.when(F.col("p") % 5 == 0, "m$default$1").otherwise("m")
    return _flags(spark, d).select("k", "ln", "p", I.keep_symbol(F.col("flags"), cls, "class").alias("class_kept"), I.keep_symbol(F.col("flags"), method, "method").alias("method_kept"))


@query(ctes("symbols") + " SELECT sid, CASE WHEN sid % 4 = 0 THEN '' ELSE pkg || '.' || owner1 || ',' END || pkg || '.I1,' || pkg || '.I2' AS parents FROM symbols")
def sym18_parent_ids(spark, d):
    sup = F.when(F.col("sid") % 4 == 0, "java/lang/Object").otherwise(F.concat("pkg", F.lit("/"), "owner1"))
    return _symbols(spark, d).select("sid", F.array_join(I.parent_ids(sup, F.array(F.concat("pkg", F.lit("/I1")), F.concat("pkg", F.lit("/I2")))), ",").alias("parents"))


@query(ctes("infos") + r""" SELECT symbol, regexp_extract(symbol, '#([^().]*)', 1) AS name, CASE kind WHEN 'METHOD' THEN 'Method' WHEN 'CLASS' THEN 'Class' ELSE 'Object' END AS kind FROM infos""")
def sym19_semanticdb_kind(spark, d):
    return view(spark, d, "infos").select("symbol", I.simple_name(F.col("symbol")).alias("name"), I.semanticdb_kind(F.col("kind")).alias("kind"))


@query(ctes("spans") + " SELECT sid, (end_line - start_line)::BIGINT * 10000 + (end_col - start_col) AS area, (start_line + 3 > start_line AND (start_line + 3 < end_line OR (start_line + 3 = end_line AND 10 <= end_col))) AS holds FROM spans")
def sym20_span(spark, d):
    loc = F.struct("start_line", "start_col", "end_line", "end_col")
    return view(spark, d, "spans").select("sid", T.span_area(loc).alias("area"), T.span_contains(loc, F.col("start_line") + 3, F.lit(10)).alias("holds"))


@query(r"""WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls, (doc_id % 9)::INT AS line, (doc_id % 5)::INT AS col FROM documents)
SELECT doc_id, CASE WHEN line < len(ls) THEN (coalesce(list_sum(list_transform(ls[1:line], lambda x: length(x) + len(regexp_extract_all(x, '[\x{10000}-\x{10FFFF}]')) + 1)), 0) + col)::INT ELSE -1 END AS off FROM t""")
def sym21_line_col_to_offset(spark, d):
    return table(spark, d, "documents").select("doc_id", T.line_col_to_offset(F.col("text"), (F.col("doc_id") % 9).cast("int"), (F.col("doc_id") % 5).cast("int")).alias("off"))


_PARTS = "[split_part(version, '.', 1)::INT, split_part(version, '.', 2)::INT, split_part(version, '.', 3)::INT]"


@query(ctes("versions") + f" SELECT target_id, row_id, ln, version, {_PARTS} > [3, 7, 2] AS newer FROM versions")
def sym22_version_gt(spark, d):
    return view(spark, d, "versions").select("target_id", "row_id", "ln", "version", T.version_gt(F.col("version"), F.lit("3.7.2")).alias("newer"))


_SHOWN = "'s' || sid AS sym, name, kind, owner1 AS owner, CASE WHEN in_project THEN 'project:' || pkg WHEN in_dependency THEN 'jar:' || owner1 ELSE 'unknown' END AS origin, CASE WHEN in_project THEN uri || ':' || sid || ':0' END AS location"


def _displayable(spark, d) -> DataFrame:
    s = _symbols(spark, d)
    kind = F.when(F.col("in_project"), "ProjectSource").when(F.col("in_dependency"), "DependencyJar").otherwise("Other")
    origin = F.struct(kind.alias("_kind"), F.col("pkg").alias("build_target"), F.col("owner1").alias("container"), F.col("uri").alias("source_file"))
    location = F.when(F.col("in_project"), F.struct("uri", F.col("sid").alias("start_line"), F.lit(0).alias("start_col")))
    return s.select(F.concat(F.lit("s"), "sid").alias("sym"), "name", "kind", F.col("owner1").alias("owner"), origin.alias("origin"), location.alias("location"))


@query(ctes("symbols") + f" SELECT {_SHOWN} FROM symbols")
def sym23_symbol_display(spark, d):
    return _displayable(spark, d).select(T.symbol_display(*map(F.col, ("name", "kind", "sym", "owner", "origin", "location"))).alias("s")).select("s.*")


@query("""SELECT page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/?#]*)?([^?#]*)', 1) AS path,
split_part(regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/?#]*)?([^?#]*)', 1), '^/+', ''), '/', 1) AS key FROM pages""")
def sym24_uri_path(spark, d):
    path = T.uri_path(F.col("url"))
    return table(spark, d, "pages").select("page_id", path.alias("path"), T.path_key(path).alias("key"))


# lookups

def _asked(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("qid"), (F.col("s_suppkey") * 7).alias("sid"))


_ASKED = "asked AS (SELECT s_suppkey AS qid, s_suppkey * 7 AS sid FROM supplier)"


@query(ctes("symbols") + f", {_ASKED} SELECT qid, sid, name, kind FROM symbols JOIN asked USING (sid)")
def sym25_get_symbols(spark, d):
    return lookup.get_symbols(_symbols(spark, d), _asked(spark, d), "sid").select("qid", "sid", "name", "kind")


@query(_KEYED + " SELECT query_id, sid FROM keyed JOIN (SELECT sid AS query_id, upper(name) AS q FROM symbols WHERE kind = 'Enum') ON name_key = lower(q)")
def sym26_symbols_by_name(spark, d):
    s = lookup.with_keys(_symbols(spark, d)).select("sid", "name_key")
    names = _symbols(spark, d).filter("kind = 'Enum'").select(F.col("sid").alias("query_id"), F.upper("name").alias("query"))
    return lookup.symbols_by_name(s, names).select("query_id", "sid")


@query(_KEYED + " SELECT query_id, sid FROM keyed, search_queries WHERE starts_with(name_key, lower(query))")
def sym27_search_prefix(spark, d):
    return lookup.search_prefix(lookup.with_keys(_symbols(spark, d)), view(spark, d, "search_queries"), "name_key").select("query_id", "sid")


_SEARCH = "search AS (SELECT query_id, query, keyed.* FROM keyed, search_queries WHERE starts_with(CASE WHEN regexp_full_match(query, '[A-Z]{2,}') THEN initials_key ELSE name_key END, lower(query)))"


def _tiers(spark, d) -> tuple[DataFrame, DataFrame]:
    s = _symbols(spark, d).select("sid", "name", "kind", "uri", "parent_sid", "in_project", "in_dependency")
    return s.filter("in_project").withColumn("tier", F.lit("project")), s.filter("in_dependency").withColumn("tier", F.lit("dependency"))


_OVERLAY = "overlaid AS (SELECT *, 'project' AS tier FROM symbols WHERE in_project UNION ALL SELECT *, 'dependency' FROM symbols WHERE in_dependency AND NOT in_project)"


@query(_KEYED + f", {_SEARCH} SELECT query_id, sid, name, CASE WHEN in_project THEN 'project' ELSE 'dependency' END AS tier FROM search WHERE in_project OR in_dependency")
def sym28_search_symbols(spark, d):
    both = hierarchy.overlay(*_tiers(spark, d), on="sid")
    return lookup.search_symbols(both, view(spark, d, "search_queries")).select("query_id", "sid", "name", "tier")


@query(ctes("symbols") + " SELECT qid, uri, sid FROM symbols JOIN (SELECT r_regionkey AS qid, 'file:///src/Brand1' || (r_regionkey + 1) || '.scala' AS uri FROM region) USING (uri)")
def sym29_symbols_in_file(spark, d):
    uris = table(spark, d, "region").select(F.col("r_regionkey").alias("qid"), F.concat(F.lit("file:///src/Brand1"), F.col("r_regionkey") + 1, F.lit(".scala")).alias("uri"))
    return lookup.symbols_in_file(_symbols(spark, d), uris).select("qid", "uri", "sid")


@query(ctes("refs") + f", {_ASKED} SELECT qid, sid, uri, start_line, start_col, kind FROM refs JOIN asked USING (sid)")
def sym30_references_of(spark, d):
    return lookup.references_of(view(spark, d, "refs"), _asked(spark, d), "sid").select("qid", "sid", "uri", "start_line", "start_col", "kind")


@query(ctes("refs") + " SELECT qid, uri, sid, start_line FROM refs JOIN (SELECT c_custkey AS qid, 'file:///o/' || (c_custkey * 3) AS uri FROM customer) USING (uri)")
def sym31_references_in_file(spark, d):
    uris = table(spark, d, "customer").select(F.col("c_custkey").alias("qid"), F.concat(F.lit("file:///o/"), F.col("c_custkey") * 3).alias("uri"))
    return lookup.references_in_file(view(spark, d, "refs"), uris).select("qid", "uri", "sid", "start_line")


@query(ctes("refs") + " SELECT DISTINCT sid FROM refs")
def sym32_reference_targets(spark, d):
    return lookup.reference_targets(view(spark, d, "refs"), "sid")


@query(ctes("refs") + """ SELECT s_suppkey AS qid, 'shop/Part#p' || (s_suppkey * 7) || '(+1).' AS symbol, 'shop.Part.p' || sid || '()' AS sym, uri, start_line, start_col, start_line AS end_line, start_col + 3 AS end_col
FROM refs JOIN supplier ON sid = s_suppkey * 7""")
def sym33_find_references(spark, d):
    refs = view(spark, d, "refs").select(F.concat(F.lit("shop.Part.p"), "sid", F.lit("()")).alias("sym"), "uri", "start_line", "start_col", F.col("start_line").alias("end_line"), (F.col("start_col") + 3).alias("end_col"))
    asked = table(spark, d, "supplier").select(F.col("s_suppkey").alias("qid"), F.concat(F.lit("shop/Part#p"), F.col("s_suppkey") * 7, F.lit("(+1).")).alias("symbol"))
    return lookup.find_references(asked, refs)


@query(ctes("spans", "positions") + """ SELECT qid, arg_min(sid, ((end_line - start_line)::BIGINT * 10000 + (end_col - start_col), sid)) AS sid
FROM spans JOIN positions USING (uri) WHERE (line, col) >= (start_line, start_col) AND (line, col) <= (end_line, end_col) GROUP BY qid""")
def sym34_resolve_at_position(spark, d):
    return lookup.resolve_at_position(view(spark, d, "spans"), view(spark, d, "positions"), sym="sid")


# tiers and hierarchy

@query(ctes("symbols") + f", {_OVERLAY} SELECT sid, name, tier FROM overlaid")
def sym35_overlay(spark, d):
    return hierarchy.overlay(*_tiers(spark, d), on="sid").select("sid", "name", "tier")


@query(ctes("edges") + ", asked AS (SELECT s_suppkey AS parent FROM supplier) SELECT DISTINCT parent, child FROM edges JOIN asked USING (parent)")
def sym36_subtypes(spark, d):
    edges = view(spark, d, "edges")
    both = edges.filter("child % 2 = 0").unionByName(edges.filter("child % 2 <> 0 or child % 3 = 0"))
    return hierarchy.subtypes(both, table(spark, d, "supplier").select(F.col("s_suppkey").alias("parent")))


@query(ctes("symbols") + f", {_OVERLAY}, {_ASKED} SELECT qid, sid, 0 AS pos, parent_sid AS parent FROM overlaid JOIN asked USING (sid) UNION ALL SELECT qid, sid, 1, 0 FROM overlaid JOIN asked USING (sid)")
def sym37_supertypes(spark, d):
    both = hierarchy.overlay(*_tiers(spark, d), on="sid").withColumn("parents", F.array(F.col("parent_sid"), F.lit(0).cast("long")))
    return hierarchy.supertypes(both, _asked(spark, d), "sid")


_CLOSURE = "asked AS (SELECT n_nationkey AS start FROM nation), walk AS (SELECT start, child, 1 AS depth FROM asked JOIN edges ON start = parent UNION SELECT start, edges.child, depth + 1 FROM walk JOIN edges ON walk.child = edges.parent WHERE depth < 10), closure AS (SELECT start, child, min(depth)::INT AS depth FROM walk GROUP BY ALL)"


def _starts(spark, d) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("parent"))


@query(ctes("edges") + f", {_CLOSURE} SELECT start::BIGINT AS start, child, depth FROM closure")
def sym38_transitive_subtypes(spark, d):
    return hierarchy.transitive_subtypes(view(spark, d, "edges"), _starts(spark, d))


@query(ctes("edges", "symbols") + f", {_CLOSURE} SELECT start::BIGINT AS start, sid, name, kind, depth FROM closure JOIN symbols ON child = sid WHERE (in_project OR in_dependency) AND kind IN ('Class', 'Object', 'Enum', 'EnumCase')")
def sym39_implementations(spark, d):
    both = hierarchy.overlay(*_tiers(spark, d), on="sid")
    return hierarchy.implementations(both, view(spark, d, "edges"), _starts(spark, d), on="sid")


@query(ctes("symbols") + " SELECT parent_sid AS sid, uri, 'Extends' AS kind FROM symbols WHERE in_project UNION ALL SELECT sid + 1, uri, 'Override' FROM symbols WHERE in_project AND kind = 'Method'")
def sym40_structural_references(spark, d):
    s = _symbols(spark, d).select(F.array("parent_sid").alias("parents"), F.when(F.col("kind") == "Method", F.array(F.col("sid") + 1)).alias("overrides"), F.when(F.col("in_project"), F.struct("uri")).alias("location"))
    return hierarchy.structural_references(s, sym="sid").select("sid", "location.uri", "kind")


# ingest

@query(ctes("occurrences", "infos") + r""", o AS (SELECT o.*, regexp_extract(o.symbol, '#([^().]*)', 1) AS nm, display_name, i.kind AS ik FROM occurrences o LEFT JOIN infos i ON o.symbol = i.symbol WHERE o.symbol <> '')
SELECT 'symbol' AS what, 'shop.Part.' || nm || '()' AS sym, CASE WHEN coalesce(display_name, '') <> '' THEN display_name ELSE nm END AS name,
       CASE ik WHEN 'METHOD' THEN 'Method' WHEN 'CLASS' THEN 'Class' WHEN 'OBJECT' THEN 'Object' ELSE 'Val' END AS kind, uri, start_line FROM o WHERE role = 'definition'
UNION ALL SELECT 'ref', 'shop.Part.' || nm || '()', NULL, 'Call', uri, start_line FROM o WHERE role = 'reference'""")
def sym41_occurrences_to_index(spark, d):
    symbols, refs = ingest.occurrences_to_index(view(spark, d, "occurrences"), view(spark, d, "infos"))
    return symbols.withColumn("what", F.lit("symbol")).unionByName(refs.withColumn("what", F.lit("ref")).withColumn("name", F.lit(None).cast("string"))).select("what", "sym", "name", "kind", "uri", "start_line")


@query("""WITH t AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 10 = 0 THEN '/.metals/readonly/' ELSE 't' END || s_nationkey AS target_id, s_name FROM supplier),
o AS (SELECT 't' || n_nationkey AS target_id, n_name AS opts FROM nation), x AS (SELECT 't' || c_nationkey AS target_id, arg_max(c_name, c_custkey) AS src FROM customer GROUP BY 1)
SELECT target_id, s_name, opts, src FROM t JOIN o USING (target_id) JOIN x USING (target_id)""")
def sym42_import_targets(spark, d):
    targets = table(spark, d, "supplier").select(F.concat(F.when(F.col("s_suppkey") % 10 == 0, "/.metals/readonly/").otherwise("t"), "s_nationkey").alias("target_id"), "s_name")
    options = table(spark, d, "nation").select(F.concat(F.lit("t"), "n_nationkey").alias("target_id"), F.col("n_name").alias("opts"), F.lit(0).alias("seq"))
    sources = table(spark, d, "customer").select(F.concat(F.lit("t"), "c_nationkey").alias("target_id"), F.col("c_name").alias("src"), F.col("c_custkey").alias("seq"))
    return ingest.import_targets(targets, options, sources)


@query(ctes("versions") + f" SELECT target_id, arg_max(version, {_PARTS}) AS version FROM versions GROUP BY target_id")
def sym43_latest_per_target(spark, d):
    return ingest.latest_per_target(view(spark, d, "versions")).select("target_id", "version")


@query(ctes("versions") + f""", best AS (SELECT target_id, max({_PARTS}) AS k FROM versions GROUP BY target_id),
f AS (SELECT DISTINCT 'file:///o/' || l_orderkey AS uri, l_suppkey AS target_id FROM lineitem)
SELECT uri, arg_max(target_id, (k, target_id)) AS target_id, array_to_string(max(k), '.') AS version FROM f JOIN best USING (target_id) GROUP BY uri""")
def sym44_best_target_for_file(spark, d):
    files = table(spark, d, "lineitem").select(F.concat(F.lit("file:///o/"), "l_orderkey").alias("uri"), F.col("l_suppkey").alias("target_id")).distinct()
    return ingest.best_target_for_file(files, ingest.latest_per_target(view(spark, d, "versions").select("target_id", "version")))


@query(ctes("target_paths") + """, o AS (SELECT path, min(target_ord) AS target_ord FROM target_paths WHERE path LIKE '%.jar' AND path NOT LIKE 'out/%' AND path NOT LIKE '%3.jar' GROUP BY path),
c AS (SELECT target_ord, string_agg(path, ':' ORDER BY path) AS class_path FROM target_paths GROUP BY target_ord) SELECT path, target_ord, class_path FROM o JOIN c USING (target_ord)""")
def sym45_assign_container_owner(spark, d):
    """Archives whose number ends in 3 are on class paths, but not there."""
    paths = view(spark, d, "target_paths")
    existing = paths.filter("path not like '%3.jar'").select("path")
    owners = ingest.assign_container_owner(paths, paths.filter("path like 'out/%'").select("path"), existing)
    return ingest.with_class_path(owners, paths).withColumn("class_path", F.array_join("class_path", ":"))


@query("""SELECT o_custkey AS container, CASE WHEN bool_or(o_orderstatus = 'F' AND o_orderkey % 5 = 0) THEN 'tasty' WHEN o_custkey % 2 = 0 AND o_custkey % 3 = 0 THEN 'java_source' ELSE 'bytecode' END AS source FROM orders GROUP BY o_custkey""")
def sym46_choose_source(spark, d):
    suffix = F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 5 == 0), ".tasty").otherwise(".class")
    entries = table(spark, d, "orders").select(F.col("o_custkey").alias("container"), F.concat("o_orderkey", suffix).alias("entry"))
    made = table(spark, d, "customer").select(F.col("c_custkey").alias("container"), F.concat(F.lit("a"), "c_custkey").alias("artifact_id"), F.lit("1").alias("version"))
    companions = made.filter("container % 3 = 0").select(F.concat("artifact_id", F.lit("-1-sources.jar")).alias("file"))
    return ingest.choose_source(entries, made.filter("container % 2 = 0"), companions)


@query(ctes("attempts") + """, chosen AS (SELECT container, arg_max(source, source) AS source, bool_or(failed) AS failed FROM attempts GROUP BY container),
used AS (SELECT container, CASE WHEN failed THEN 'bytecode' ELSE source END AS source FROM chosen)
SELECT a.container, a.source, a.row_id FROM attempts a JOIN used u ON a.container = u.container AND a.source = u.source""")
def sym47_fallback_merge(spark, d):
    rows = view(spark, d, "attempts")
    chosen = rows.groupBy("container").agg(F.max("source").alias("source"), F.bool_or("failed").alias("failed"))
    return ingest.fallback_merge(chosen, rows.drop("failed")).select("container", "source", "row_id")


@query(ctes("symbols") + """, n AS (SELECT DISTINCT owner1 AS container, name FROM symbols), p AS (SELECT DISTINCT 'Brand1' || (1 + s_suppkey % 6) AS container, name FROM supplier, (SELECT DISTINCT name FROM symbols WHERE kind = 'Enum'))
SELECT container, name FROM p JOIN n USING (container, name)""")
def sym48_membership_filter(spark, d):
    names = _symbols(spark, d).select(F.col("owner1").alias("container"), "name").distinct()
    filters = ingest.membership_filter_build(names)
    owners = table(spark, d, "supplier").select(F.explode(F.array(F.concat(F.lit("Brand1"), 1 + F.col("s_suppkey") % 6))).alias("container")).distinct()
    wanted = _symbols(spark, d).filter("kind = 'Enum'").select("name").distinct()
    probes = wanted.withColumn("container", F.explode(F.array(*[F.lit(r[0]) for r in owners.orderBy("container").collect()])))  # six containers at most
    hits = ingest.membership_filter_probe(filters, probes).filter("might_contain")
    return hits.select("container", "name").join(names, ["container", "name"], "left_semi")


# aggregations and limits

@query(ctes("symbols", "refs") + """ SELECT count(DISTINCT sid) FILTER (in_project) AS project_symbols, count(DISTINCT sid) FILTER (in_dependency) AS dependency_symbols,
(SELECT count(*) FROM (SELECT uri FROM symbols WHERE in_project UNION SELECT uri FROM refs)) AS files, count(DISTINCT owner1) FILTER (in_dependency) AS containers, (SELECT count(*) FROM refs) AS "references" FROM symbols""")
def sym49_index_stats(spark, d):
    s = _symbols(spark, d).select(F.col("sid").cast("string").alias("sym"), "uri", F.col("owner1").alias("container"), "in_project", "in_dependency")
    tiers = s.filter("in_project").withColumn("tier", F.lit("project")).unionByName(s.filter("in_dependency").withColumn("tier", F.lit("dependency")))
    return stats.index_stats(tiers, view(spark, d, "refs"))


@query(ctes("symbols") + f" SELECT lower(name) AS name_key, {_SHOWN} FROM symbols WHERE starts_with(lower(name), 's') ORDER BY lower(name), 's' || sid LIMIT 100")
def sym50_debug_search(spark, d):
    return stats.debug_search(_displayable(spark, d), view(spark, d, "search_queries").filter("query = 'S'"))


@query(ctes("symbols", "refs") + f""", m AS (SELECT lower(name) AS k, 's' || sid AS sym FROM symbols WHERE starts_with(lower(name), 's') ORDER BY lower(name), 's' || sid LIMIT 100)
SELECT count(DISTINCT sid) FILTER (in_project) AS project_symbols, count(DISTINCT sid) FILTER (in_dependency) AS dependency_symbols, (SELECT count(*) FROM (SELECT uri FROM symbols WHERE in_project UNION SELECT uri FROM refs)) AS files,
count(DISTINCT owner1) FILTER (in_dependency) AS containers, (SELECT string_agg(sym, ',' ORDER BY k, sym) FROM m) AS matches FROM symbols""")
def sym50_debug_index(spark, d):
    """The counts of the index and, in the same row, what the search finds."""
    found = stats.debug_search(_displayable(spark, d), view(spark, d, "search_queries").filter("query = 'S'"))
    report = stats.debug_index(sym49_index_stats(spark, d).drop("references"), found)
    return report.withColumn("matches", F.array_join(F.transform("matches", lambda m: m["sym"]), ","))


@query(ctes("index_diagnostics") + """, r AS (SELECT *, row_number() OVER (PARTITION BY container ORDER BY seq) AS rk FROM index_diagnostics)
SELECT container, count(*) FILTER (is_error) AS errors, count(*) FILTER (NOT is_error) AS warnings, CASE WHEN bool_or(is_error) THEN 'Error' ELSE 'Ok' END AS status,
string_agg(message, '|' ORDER BY rk) FILTER (rk <= 20) AS messages FROM r GROUP BY container""")
def sym51_diagnostic_rollup(spark, d):
    return stats.diagnostic_rollup(view(spark, d, "index_diagnostics")).withColumn("messages", F.array_join("messages", "|"))


@query("""WITH c AS (SELECT 'lib/' || source || '-' || (doc_id // 50) || '.jar' AS container, (doc_id // 50) % 5 = 4 AS cut, count(*) FILTER (doc_id % 11 = 3) AS bad FROM documents GROUP BY ALL)
SELECT container, CASE WHEN cut THEN 1 ELSE bad END AS errors, 0::BIGINT AS warnings, 'Error' AS status, (CASE WHEN cut THEN 1 ELSE least(bad, 20) END)::INT AS n_messages FROM c WHERE cut OR bad > 0""")
def sym51_broken_entries(spark, d):
    """Archives of which every fifth is cut off and some entries are damaged: what can't be read is counted by container."""
    docs = table(spark, d, "documents").select(F.format_string("lib/%s-%d.jar", "source", F.expr("doc_id div 50")).alias("path"), "doc_id", "text")
    folder = scratch_path(spark, "broken-archives")
    def pack(rows: list[tuple]) -> bytes:
        data = damaged_zip([(f"{i}.txt", f"!{t}".encode()) for i, t in rows], {f"{i}.txt" for i, _ in rows if i % 11 == 3})
        return data[: len(data) // 2] if rows[0][0] // 50 % 5 == 4 else data

    write_archives(docs, folder, pack)
    found = archives.index_diagnostics(archives.scan_with_errors(spark, folder, contents=False))
    found = found.withColumn("container", F.regexp_extract("container", "lib/[^/]*$", 0))
    return stats.diagnostic_rollup(found).select("container", "errors", "warnings", "status", F.size("messages").alias("n_messages"))


@query(ctes("symbols", "refs") + """, s AS (SELECT CASE WHEN sid % 2 = 0 THEN uri ELSE 'file:///o/' || sid END AS uri, count(*) AS n_symbols, string_agg(sid::VARCHAR, ',' ORDER BY sid) AS symbols FROM symbols GROUP BY 1),
r AS (SELECT uri, count(*) AS n_refs, string_agg(sid::VARCHAR, ',' ORDER BY sid) AS refs FROM refs GROUP BY uri)
SELECT coalesce(s.uri, r.uri) AS uri, coalesce(n_symbols, 0) AS n_symbols, coalesce(symbols, '') AS symbols, coalesce(n_refs, 0) AS n_refs, coalesce(refs, '') AS refs FROM s FULL JOIN r ON s.uri = r.uri""")
def sym52_group_by_file(spark, d):
    s = _symbols(spark, d).select(F.when(F.col("sid") % 2 == 0, F.col("uri")).otherwise(F.concat(F.lit("file:///o/"), "sid")).alias("uri"), F.col("sid").alias("sym"))
    g = stats.group_by_file(s, view(spark, d, "refs").select("uri", F.col("sid").alias("sym")))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return g.select("uri", F.size("symbols").cast("long").alias("n_symbols"), joined("symbols").alias("symbols"), F.size("refs").cast("long").alias("n_refs"), joined("refs").alias("refs"))
