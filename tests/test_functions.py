"""Column functions on the values of FIXTURES.md, part A."""

import pytest
from pyspark.sql import functions as F

from symtab.functions import ids as I
from symtab.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("name, key", [("AbstractListType", "alt"), ("ListBuffer", "lb"), ("map", ""), ("IOException", "ie"), ("HTMLParser", "hp"), ("x", ""), ("XML", "x"), ("indexOf", ""), ("", ""), ("HashMap", "hm")])
def test_initials(spark, name, key):
    assert value(spark, I.initials_key(F.lit(name))) == key


@pytest.mark.parametrize("query, yes", [("HM", True), ("H", False), ("Hm", False), ("IO", True), ("MINUTES", True), ("", False)])
def test_initials_query(spark, query, yes):
    assert value(spark, I.is_initials_query(F.lit(query))) is yes


@pytest.mark.parametrize(
    "internal, member, outer, simple, sym",
    [
        ("crossproducer/Lib$", None, None, None, "crossproducer.Lib()"), ("crossproducer/Lib", None, None, None, "crossproducer.Lib"),
        ("com/example/Outer$Inner", None, "com/example/Outer", "Inner", "com.example.Outer.Inner"), ("com/example/Foo$Bar", None, None, None, "com.example.Foo$Bar"),
        ("foo/foo$package$", "bar", None, None, "foo.foo$package.bar()"), ("Top", None, None, None, "Top"), ("a/B", "m", None, None, "a.B.m()"),
        ("a/B$C$", None, "a/B", None, "a.B.B$C()"),
    ],
)
def test_jvm_names(spark, internal, member, outer, simple, sym):
    assert value(spark, I.render_symbol_id(I.parse_jvm_name(*[F.lit(x).cast("string") for x in (internal, member, outer, simple)]))) == sym


@pytest.mark.parametrize(
    "symbol, sym",
    [
        ("scala/collection/immutable/List#", "scala.collection.immutable.List"), ("scala/Predef.println(+1).", "scala.Predef.println()"),
        ("pkg/Outer.Inner#run().", "pkg.Outer.Inner.run()"), ("pkg/Outer#Inner.run().", "pkg.Outer.Inner.run()"), ("bare", "bare()"), ("pkg/", "pkg."), ("", ""),
    ],
)
def test_semanticdb(spark, symbol, sym):
    assert value(spark, I.render_symbol_id(I.parse_semanticdb_symbol(F.lit(symbol)))) == sym


def test_id_drops_one_dollar(spark):
    id_ = value(spark, I.symbol_id(F.array(F.lit("p$")), F.array(F.lit("O$$")), F.lit("n$"), F.lit(True)))
    assert (id_.pkg, id_.owners, id_.name, id_.is_term, id_.disambig) == (["p"], ["O$"], "n", False, None)


def test_named_flags(spark):
    flags = lambda *names: F.array(*map(F.lit, names)).cast("array<string>")
    assert [value(spark, I.access_visibility(flags(*f), "flags")) for f in (("PrivateLocal",), ("Protected", "Package"), ("Package",), ())] == ["Private", "Protected", "Public", "Public"]
    kept = [(("Case",), "name"), (("Synthetic",), "name"), (("Artifact",), "name"), (("Param",), "x"), (("ModuleVal",), "X"), ((), "$anon"), ((), "evidence$evidence$1"), ((), "$x"), ((), "x$")]
    assert [value(spark, I.keep_symbol(flags(*f), F.lit(n), "named")) for f, n in kept] == [True, *[False] * 7, True]


@pytest.mark.parametrize("flags, out", [(["Private", "Protected"], "Private"), (["Package"], "PackagePrivate"), (["Protected"], "Protected"), ([], "Public")])
def test_java_visibility(spark, flags, out):
    assert value(spark, I.access_visibility(F.lit(flags) if flags else F.array().cast("array<string>"), "java")) == out


@pytest.mark.parametrize(
    "rule, flags, name, kind",
    [
        ("named_class", ["Enum", "Case"], "C", "EnumCase"), ("named_class", ["Module"], "C", "Object"), ("named_val", ["Given"], "v", "Given"), ("named_val", ["Mutable"], "v", "Var"),
        ("named_def", ["x"], "<init>", "Constructor"), ("named_type", ["Param"], "T", "TypeParam"), ("named_type", ["x"], "T", "TypeAlias"),
    ],
)
def test_kinds_by_flag_names(spark, rule, flags, name, kind):
    assert value(spark, I.classify_kind(F.lit(flags), F.lit(name), rule)) == kind


@pytest.mark.parametrize("a, b, newer", [("3.10.0", "3.9.9", True), ("3.7.2", "3.7.2", False), ("3.7.2-RC1", "3.7.2", True), ("3.7", "3.7.0", False), ("3.7.2.1", "3.7.2", True), ("x", "1", True)])
def test_versions(spark, a, b, newer):
    assert value(spark, T.version_gt(F.lit(a), F.lit(b))) is newer


@pytest.mark.parametrize("line, col, offset", [(0, 0, 0), (0, 2, 2), (1, 1, 4), (2, 0, 5), (3, 0, -1), (-1, 0, -1)])
def test_offsets(spark, line, col, offset):
    assert value(spark, T.line_col_to_offset(F.lit("ab\nc\n"), F.lit(line), F.lit(col))) == offset


def test_spans(spark):
    loc = F.struct(F.lit(5).alias("start_line"), F.lit(2).alias("start_col"), F.lit(10).alias("end_line"), F.lit(2).alias("end_col"))
    for line, col, yes in ((5, 2, True), (5, 1, False), (10, 2, True), (10, 3, False), (7, 99, True)):
        assert value(spark, T.span_contains(loc, F.lit(line), F.lit(col))) is yes
    none = F.lit(None).cast("struct<start_line:int,start_col:int,end_line:int,end_col:int>")
    assert value(spark, T.span_contains(none, F.lit(1), F.lit(1))) is False
    assert value(spark, T.span_area(loc)) == 50000


def test_uris(spark):
    assert value(spark, T.uri_path(F.lit("file:///src/A.scala?x#y"))) == "/src/A.scala"
    assert value(spark, T.uri_path(F.lit("jar:file:///a.jar!/B.java"))) == "file:///a.jar!/B.java"
    assert value(spark, T.path_key(F.lit("/java.base/java/lang/X.java"))) == "java.base"


HARD = [None, "", " ", "$", "/", "//", "a/", "$$", "#", ".", "()", "1", "01", "99999999999999999999.1", "1" * 400, "1..2", "\x00", "\U0001f600", "A" * 10_000]


def test_no_value_ends_a_job(spark):
    """Each column function on null, empty, odd and huge values, under ANSI rules."""
    rows = spark.createDataFrame([(v, w) for v in HARD for w in (None, "", "a/B$C")], "v string, w string")
    c, w = F.col("v"), F.col("w")
    columns = [
        I.strip_dollar(c), I.symbol_id(F.split(c, "/"), F.split(w, "/"), c, w.isNull()), I.parse_jvm_name(c, w, w, c), I.parse_jvm_name(w, c, c, w), I.parse_semanticdb_symbol(c),
        I.render_symbol_id(I.parse_jvm_name(c, w, w, c)), I.name_key(c), I.initials_key(c), I.is_initials_query(c), T.version_key(c), T.version_gt(c, w), T.path_key(c), T.uri_path(c),
        T.line_col_to_offset(c, F.lit(2147483647), F.lit(3)), T.line_col_to_offset(c, F.lit(None).cast("int"), F.lit(0)), I.simple_name(c),
    ]
    assert len(rows.select(*[x.alias(f"c{i}") for i, x in enumerate(columns)]).collect()) == 3 * len(HARD)


@pytest.mark.parametrize("older, newer", [("9" * 30, "1" + "0" * 30), ("1.99999999999999999999", "1.100000000000000000000"), ("3.7.2", "3.7.10"), ("1.9", "1.10"), ("007", "8"), ("1.0", "1.0.0")])
def test_numbers_of_any_length(spark, older, newer):
    assert value(spark, T.version_gt(F.lit(newer), F.lit(older))) is True and value(spark, T.version_gt(F.lit(older), F.lit(newer))) is False


def test_leading_zeros_are_equal(spark):
    assert value(spark, T.version_gt(F.lit("1.02"), F.lit("1.2"))) is False and value(spark, T.version_gt(F.lit("1.2"), F.lit("1.02"))) is False
