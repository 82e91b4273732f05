"""Archives, class files and the cache."""

import glob
import os
import zipfile

import pyspark
from pyspark import TaskContext
from pyspark.sql import functions as F

from symtab.operators import ranges, stats
from symtab.plans.fixtures import class_bytes, damaged_zip, table, write_archives, zip_bytes
from symtab.sources import archives, cache


def test_archives(spark, tmp_path):
    good = class_bytes("a/Good", 1, "java/lang/Object", [], [("f", "I", 0x4019)], [("m", "()V", 2), ("$x", "()V", 1), ("b", "()V", 0x41)])
    (tmp_path / "ok.jar").write_bytes(zip_bytes([("a/Good.class", good), ("a/Broken.class", b"\xca\xfe\xba\xbe\0"), ("readme.txt", b"x"), ("a/Anon$anon$1.class", class_bytes("a/Anon$anon$1", 1, None, [], [], []))]))
    (tmp_path / "empty.jar").write_bytes(zip_bytes([]))
    (tmp_path / "text.jar").write_bytes(b"not an archive")
    entries = archives.scan_archives(spark, str(tmp_path))
    assert sorted(r.entry for r in entries.collect()) == ["a/Anon$anon$1.class", "a/Broken.class", "a/Good.class", "readme.txt"]
    found = {(r.sym, r.kind, r.visibility, r.owner) for r in archives.extract_classfile_symbols(entries).collect()}
    assert found == {("a.Good", "Class", "Public", None), ("a.Good.f()", "EnumCase", "Public", "a.Good"), ("a.Good.m()", "Method", "Private", "a.Good")}


def test_what_cannot_be_read_is_counted(spark, tmp_path):
    good = class_bytes("a/Good", 1, "java/lang/Object", [], [], [("m", "()V", 1)])
    (tmp_path / "ok.jar").write_bytes(zip_bytes([("a/Good.class", good), ("a/Broken.class", b"\xca\xfe\xba\xbe\0"), ("b/Short.class", b"\xca"), ("readme.txt", b"x")]))
    (tmp_path / "damaged.jar").write_bytes(damaged_zip([("1.txt", b"one"), ("2.txt", b"two"), ("a/Good.class", good)], {"2.txt"}))
    (tmp_path / "text.jar").write_bytes(b"not an archive")
    (tmp_path / "empty.jar").write_bytes(b"")
    binary = archives.read_archives(spark.read.format("binaryFile").load(str(tmp_path)))  # Spark leaves out files without bytes
    for read, empty in ((archives.scan_with_errors(spark, str(tmp_path)), [("empty.jar", 1, "Error", 1)]), (binary, [])):
        members = archives.read_class_files(archives.without_errors(read))
        found = stats.diagnostic_rollup(archives.index_diagnostics(read, members)).select(F.regexp_extract("container", "[^/]*$", 0), "errors", "status", F.size("messages")).collect()
        assert sorted(map(tuple, found)) == [("damaged.jar", 1, "Error", 1), *empty, ("ok.jar", 2, "Error", 2), ("text.jar", 1, "Error", 1)]
        assert sorted(r.entry for r in archives.without_errors(read).collect()) == ["1.txt", "a/Broken.class", "a/Good.class", "a/Good.class", "b/Short.class", "readme.txt"]
        assert archives.class_file_members(archives.without_errors(read)).count() == 4


def test_archives_are_dealt_out_by_bytes(spark, tmp_path):
    """A large archive is many tasks' work, small ones are put together, and every entry is read once."""
    data = os.urandom(3000)
    (tmp_path / "large.jar").write_bytes(damaged_zip([(f"{i}", data) for i in range(40)], {"7"}))
    for i in range(30):
        (tmp_path / f"small{i}.jar").write_bytes(damaged_zip([("x", b"y")], set()))
    read = archives.scan_with_errors(spark, str(tmp_path), part_bytes=10_000)
    assert 12 <= read.rdd.getNumPartitions() <= 16
    rows = read.collect()
    assert len(rows) == 70 and len({(r.container, r.entry) for r in rows}) == 70
    assert [r.entry for r in rows if r.error] == ["7"] and all(bytes(r.bytes) == data for r in rows if "large" in r.container and not r.error)
    assert archives.scan_archives(spark, str(tmp_path), "none*.jar").count() == 0


def test_small_archives_are_many_tasks_work(spark, tmp_path):
    """Opening them is the work, not their bytes; without contents each entry is read and checked all the same."""
    data = damaged_zip([("x", b"y"), ("z", b"y")], {"z"})
    for i in range(6000):
        (tmp_path / f"{i}.jar").write_bytes(data)
    read = archives.scan_with_errors(spark, str(tmp_path), contents=False)
    assert read.rdd.getNumPartitions() >= 3
    assert read.filter("bytes is null").groupBy("entry", "size", F.col("error").isNull().alias("read")).count().orderBy("entry").collect() == [("x", 1, True, 6000), ("z", None, False, 6000)]


def test_many_documents_are_packed_in_tasks_by_bytes(spark, sf_dir, tmp_path, monkeypatch):
    """Not in the session's few: what a task sorts and packs does not grow with the input, and each document is packed once."""
    docs = table(spark, sf_dir, "documents").select(F.format_string("lib/%d.jar", F.expr("doc_id div 5")).alias("path"), "doc_id", "text")
    monkeypatch.setattr(ranges, "TASK_BYTES", 8_000)
    write_archives(docs, f"file://{tmp_path}", lambda rows: zip_bytes([(f"{TaskContext.get().partitionId()}/{i}", t.encode()) for i, t in rows]))
    found = archives.scan_archives(spark, str(tmp_path)).select(F.split_part("entry", F.lit("/"), F.lit(1)).alias("task"), F.split_part("entry", F.lit("/"), F.lit(2)).cast("long").alias("doc_id"), F.decode("bytes", "UTF-8").alias("text"))
    assert found.select("task").distinct().count() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert found.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).isEmpty() and found.count() == docs.count()


def test_what_is_counted_is_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def read(it):
        for pdf in it:
            seen.add(len(pdf))
            yield pdf

    made = spark.range(100).selectExpr("concat('c', id % 3) as container", "case when id % 2 = 0 then concat('broken ', id) end as error")
    rolled = stats.diagnostic_rollup(archives.index_diagnostics(made.mapInPandas(read, made.schema)))
    assert sorted((r.container, r.errors) for r in rolled.collect()) == [("c0", 17), ("c1", 16), ("c2", 17)]
    assert seen.value == 100


def test_an_archive_beyond_two_gigabytes(spark, tmp_path):
    """Too large for one row: it begins with 2.2 GB that hold nothing (a sparse file), and its entries stand behind them."""
    path = tmp_path / "huge.jar"
    with open(path, "wb") as f:
        f.truncate(2_200_000_000)
    with zipfile.ZipFile(path, "a") as z:
        for i in range(5):
            z.writestr(f"{i}.txt", f"text {i}")
    assert path.stat().st_size > 1 << 31
    rows = archives.scan_archives(spark, str(tmp_path)).collect()
    assert sorted((r.entry, bytes(r.bytes).decode()) for r in rows) == [(f"{i}.txt", f"text {i}") for i in range(5)]


def test_real_archive(spark):
    jar = sorted(glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-tags*.jar")))[0]
    symbols = archives.extract_classfile_symbols(archives.scan_archives(spark, jar))
    assert symbols.filter("sym = 'org.apache.spark.annotation.Experimental' and kind = 'Trait'").count() == 1


def test_entry_kinds(spark):
    names = spark.createDataFrame([("A.class",), ("x/A.tasty",), ("A.java",), ("x/module-info.java",), ("A.txt",)], "entry string")
    assert [r.k for r in names.select(archives.entry_kind(F.col("entry")).alias("k")).collect()] == ["class", "tasty", "java", None, None]


def test_sha(spark):
    df = spark.createDataFrame([(b"hello world",)], "data binary")
    assert cache.content_sha256(df, "data").first().sha == "b94d27b9934d3e08a52e52d7da7dabfac484efe37a5380ee9088f7ace2efcde9"


def test_cache_replaces_and_keeps_versions_apart(spark, tmp_path):
    path = str(tmp_path / "cache")
    keys = spark.createDataFrame([("aa",), ("bb",)], "sha string")
    one = spark.createDataFrame([("aa", "old"), ("aa", "older")], "sha string, sym string")
    cache.cache_store(one, keys, path, "1")
    cache.cache_store(spark.createDataFrame([("aa", "new")], "sha string, sym string"), keys.filter("sha = 'aa'"), path, "1")
    assert [tuple(r) for r in cache.cache_read(spark, path, keys, "1").select("sha", "sym").collect()] == [("aa", "new")]
    hits, misses = cache.cache_lookup(spark.createDataFrame([("aa",), ("bb",), ("cc",)], "sha string"), cache.cache_manifest(spark, path), "1")
    assert sorted(r.sha for r in hits.collect()) == ["aa", "bb"] and [r.sha for r in misses.collect()] == ["cc"]
    assert cache.cache_lookup(keys, cache.cache_manifest(spark, path), "2")[0].count() == 0


def test_outdated_batches_are_removed(spark, tmp_path):
    path = str(tmp_path / "cache")
    keys = spark.createDataFrame([("aa",), ("bb",)], "sha string")
    rows = lambda *r: spark.createDataFrame(list(r), "sha string, sym string")
    held = lambda: len(glob.glob(f"{path}/results/version=*/batch=*"))
    cache.cache_store(rows(("aa", "1"), ("bb", "1")), keys, path, "1")
    cache.cache_store(rows(("aa", "2")), keys.filter("sha = 'aa'"), path, "1")
    assert cache.cache_clean(spark, path) == 0 and held() == 2  # the first batch still has the entry of bb
    cache.cache_store(rows(("bb", "2")), keys.filter("sha = 'bb'"), path, "1")
    cache.cache_store(rows(("aa", "other")), keys.filter("sha = 'aa'"), path, "2")
    os.makedirs(f"{path}/results/version=1/batch=unfinished")
    assert cache.cache_clean(spark, path) == 1 and held() == 4
    assert sorted(tuple(r) for r in cache.cache_read(spark, path, keys, "1").select("sha", "sym").collect()) == [("aa", "2"), ("bb", "2")]
    assert [tuple(r) for r in cache.cache_read(spark, path, keys, "2").select("sha", "sym").collect()] == [("aa", "other")]


def test_json_skips_what_it_cannot_read(spark):
    rows = spark.createDataFrame([('{"sym":"a","name":"A"}',), ("not json",), ("",)], "json string")
    assert [r.sym for r in cache.symbols_from_json(rows).collect()] == ["a"]
