"""Archives (jar and zip files) as tables of entries, and class files as tables of symbols."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

from symtab.functions import ids as I
from symtab.schema import ENTRY, MEMBER
from symtab.scratch import cut

#: Bytes of entries handed on at a time.
CHUNK = 8_000_000
#: Bytes of archives that a task reads.
PART_BYTES = 128_000_000
#: Bytes that opening an archive counts for, so that a task has no more than some thousand small ones.
OPEN_BYTES = 64_000
#: Entries and raw members with what went wrong.
READ = StructType(ENTRY.fields).add("error", StringType())
MEMBER_READ = StructType(MEMBER.fields).add("error", StringType())
ARROW_READ = to_arrow_schema(READ)
ARROW_MEMBER_READ = to_arrow_schema(MEMBER_READ)
#: Members handed on at a time.
MEMBER_ROWS = 10_000


def _entries(container: str, file, start: int = 0, end: int | None = None, contents: bool = True) -> Iterator[tuple]:
    """Rows of READ from an archive's open file: entries whose header begins at a byte from ``start`` to ``end``.

    What can't be read is a row with an error instead: an entry with its number, a whole archive once, without one. Without
    ``contents`` every entry is read and checked all the same, but its bytes are not handed on.
    """
    try:
        archive = zipfile.ZipFile(file)
    except (zipfile.BadZipFile, OSError, EOFError, struct.error, ValueError) as error:
        if not start:
            yield container, None, None, None, None, f"archive: {error}"
        return
    for i, info in enumerate(archive.infolist()):
        if info.is_dir() or info.header_offset < start or (end is not None and info.header_offset >= end):
            continue
        try:
            data = archive.read(info)
            yield container, info.filename, i, len(data), data if contents else None, None
        except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, EOFError, struct.error, zlib.error, ValueError) as error:
            yield container, info.filename, i, None, None, f"{info.filename}: {error}"


def _chunks(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows in lists of about CHUNK bytes, of which a row without any counts for some."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[4] or b"") + 200
        if size > CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def read_archives(files: DataFrame, contents: bool = True) -> DataFrame:
    """(container, entry, entry_index, size, bytes, error) of the files in each archive of (path, content); without ``contents`` bytes are null.

    A broken archive or entry is a row with an error and no bytes, so that nothing is lost uncounted (``index_diagnostics``).
    """

    def entries(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                for rows in _chunks(_entries(path, io.BytesIO(content), contents=contents)):
                    yield pd.DataFrame(rows, columns=READ.names)

    return files.select("path", "content").mapInPandas(entries, READ)


def without_errors(read: DataFrame) -> DataFrame:
    """The entries that could be read: (container, entry, entry_index, size, bytes)."""
    return read.filter("error is null").select(*ENTRY.names)


def archive_entries(files: DataFrame) -> DataFrame:
    """(container, entry, entry_index, size, bytes) of the files in each archive of (path, content); a broken archive or entry gives no rows."""
    return without_errors(read_archives(files))


@dataclass
class Part(InputPartition):
    """Parts of archives that one task reads: (path below ``root``, first byte, end), of which it reads the entries that begin there."""

    root: str
    pieces: tuple[tuple[str, int, int], ...]


class ArchiveReader(DataSourceReader):
    """Deals archives out by bytes: small ones together, a large one in pieces.

    The driver only lists files. Each task reads an archive's directory, at its end, and the bytes of its own entries, so an archive
    may be of any size, and no part of it passes through a task that does not need it. Small archives are read at once; for
    them opening counts too.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.glob, self.bytes = options["path"], options.get("glob", "*.jar"), int(options.get("partBytes", PART_BYTES))
        self.contents = options.get("contents", "true") == "true"

    def partitions(self) -> list[Part]:
        system, root = FileSystem.from_uri(self.path)
        found = system.get_file_info(root)
        if found.type == FileType.NotFound:
            raise FileNotFoundError(self.path)
        infos = [found] if found.is_file else system.get_file_info(FileSelector(root, recursive=True))
        files = sorted((i.path, i.size) for i in infos if i.is_file and fnmatch(i.base_name, self.glob))
        opening = min(OPEN_BYTES, self.bytes // 100)
        parts, held, size = [], [], 0
        for path, length in files:
            for start in range(0, max(length, 1), self.bytes):
                end = min(start + self.bytes, max(length, 1))
                if held and size + end - start > self.bytes:
                    parts.append(Part(root, tuple(held)))
                    held, size = [], 0
                held.append((path.removeprefix(root), start, end))
                size += end - start + opening
        return [*parts, Part(root, tuple(held))] if held else parts

    def _rows(self, part: Part) -> Iterator[tuple]:
        system, _ = FileSystem.from_uri(self.path)
        for name, start, end in part.pieces:
            path = part.root + name
            with system.open_input_file(path) as file:
                small = not start and end <= CHUNK and file.size() <= end
                yield from _entries(path, io.BytesIO(file.read()) if small else file, start, end, self.contents)

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(self._rows(part) if part else iter(())):  # no part: no file
            yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), ARROW_READ, strict=True)], schema=ARROW_READ)


class ArchiveSource(DataSource):
    """``spark.read.format("symtab_archives").option("glob", "*.jar").load(uri)``: rows of ``read_archives``."""

    @classmethod
    def name(cls) -> str:
        return "symtab_archives"

    def schema(self):
        return READ

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def scan_with_errors(spark: SparkSession, path: str, glob: str = "*.jar", part_bytes: int | None = None, contents: bool = True) -> DataFrame:
    """Rows of ``read_archives`` for the archives below a path; without ``contents`` their bytes are read and checked, but null.

    Where Arrow knows the path's file system, archives are read in parts (``ArchiveReader``). Other stores are read by
    Spark's binary files, whole and thus below 2 GB each.
    """
    try:
        FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
        return read_archives(files, contents)
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("symtab_archives").option("glob", glob).option("partBytes", str(part_bytes or PART_BYTES)).option("contents", str(contents).lower()).load(path)


def scan_archives(spark: SparkSession, path: str, glob: str = "*.jar", contents: bool = True) -> DataFrame:
    """Entries of the archives below a path; broken ones give no rows."""
    return without_errors(scan_with_errors(spark, path, glob, contents=contents))


def entry_kind(entry: Column) -> Column:
    """``class``, ``tasty`` or ``java`` by suffix (``module-info.java`` is no source), else null."""
    return F.when(entry.endswith(".class"), "class").when(entry.endswith(".tasty"), "tasty").when(entry.endswith(".java") & ~entry.rlike(r"(^|/)module-info\.java$"), "java")


def archive_coordinates(entries: DataFrame) -> DataFrame:
    """(container, group_id, artifact_id, version) from the first pom.properties that has all three."""
    text = F.decode("bytes", "UTF-8")
    value = lambda key: F.regexp_extract(text, rf"(?m)^\s*{key}\s*[=:]\s*(\S.*?)\s*$", 1)
    props = entries.filter(F.col("entry").rlike(r"^META-INF/maven/(.*/)?pom\.properties$"))
    found = props.select("container", "entry_index", value("groupId").alias("group_id"), value("artifactId").alias("artifact_id"), value("version").alias("version"))
    full = found.filter("group_id <> '' and artifact_id <> '' and version <> ''")
    first = full.groupBy("container").agg(F.min_by(F.struct("group_id", "artifact_id", "version"), "entry_index").alias("c"))
    return first.select("container", "c.*")


class _Reader:
    """Big-endian reads of a class file."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str):
        value = struct.unpack_from(f">{form}", self.data, self.at)
        self.at += struct.calcsize(f">{form}")
        return value[0] if len(value) == 1 else value

    def skip(self, n: int) -> None:
        self.at += n


#: Sizes of constant-pool items by tag, without the tag (1, Utf8, has its own length; 5 and 6 fill two places).
POOL_SIZES = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}


def class_members(data: bytes) -> list[dict]:
    """One dict for the class, then one for each field and method: raw names, flags, parents, signatures. Raises on a broken file."""
    r = _Reader(data)
    if r.take("I") != 0xCAFEBABE:
        raise ValueError("no class file")
    r.skip(4)
    texts, classes = {}, {}
    i, n = 1, r.take("H")
    while i < n:
        tag = r.take("B")
        if tag == 1:
            size = r.take("H")
            texts[i] = r.data[r.at : r.at + size].replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass")
            r.skip(size)
        else:
            if tag == 7:
                classes[i] = struct.unpack_from(">H", r.data, r.at)[0]
            r.skip(POOL_SIZES[tag])
        i += 2 if tag in (5, 6) else 1
    name_of = lambda k: texts[classes[k]] if k else None
    flags, this, parent, count = r.take("HHHH")
    interfaces = [name_of(r.take("H")) for _ in range(count)]
    own = {"level": "class", "internal_name": name_of(this), "inner_outer": None, "inner_simple": None, "anonymous": False, "name": None, "flags": flags, "class_flags": flags, "super_name": name_of(parent), "interfaces": interfaces, "signature": None}

    def attributes() -> dict[str, bytes]:
        out = {}
        for _ in range(r.take("H")):
            name, size = r.take("HI")
            out[texts[name]] = r.data[r.at : r.at + size]
            r.skip(size)
        return out

    members = []
    for level in ("field", "method"):
        for _ in range(r.take("H")):
            bits, name, descriptor = r.take("HHH")
            said = attributes()
            signature = texts[struct.unpack(">H", said["Signature"])[0]] if "Signature" in said else texts[descriptor]
            members.append({"level": level, "name": texts[name], "flags": bits, "signature": signature})
    said = attributes()
    inner = said.get("InnerClasses", b"\0\0")
    for k in range(struct.unpack_from(">H", inner)[0]):
        cls, outer, simple, _ = struct.unpack_from(">HHHH", inner, 2 + 8 * k)
        if name_of(cls) == own["internal_name"]:
            own |= {"inner_outer": name_of(outer), "inner_simple": texts.get(simple), "anonymous": simple == 0}
    return [own, *({**own, **m} for m in members)]


def read_class_files(entries: DataFrame) -> DataFrame:
    """Raw rows of the class files among the entries, plus ``error``: a broken file is one row with nothing but its error, and
    the others of its archive stay."""

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in ARROW_MEMBER_READ], schema=ARROW_MEMBER_READ)

    def parse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for got in it:
            for container, entry, data in zip(*(got[c].to_pylist() for c in ("container", "entry", "bytes")), strict=True):
                said = {"container": container, "entry": entry}
                try:
                    rows += [{**said, "ordinal": k, **m} for k, m in enumerate(class_members(data))]
                except (ValueError, KeyError, IndexError, struct.error) as error:
                    rows.append({**said, "error": f"{entry}: {type(error).__name__} {error}"})
                if len(rows) >= MEMBER_ROWS:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    return entries.filter(entry_kind(F.col("entry")) == "class").select("container", "entry", "bytes").mapInArrow(parse, MEMBER_READ)


def class_file_members(entries: DataFrame) -> DataFrame:
    """Raw rows of the class files among the entries; a broken entry is left out, the others of its archive stay."""
    return read_class_files(entries).filter("error is null").select(*MEMBER.names)


def index_diagnostics(*read: DataFrame) -> DataFrame:
    """(container, seq, is_error, message) of what could not be read, for ``diagnostic_rollup``: the errors of ``read_archives``,
    ``scan_with_errors`` and ``read_class_files``. Messages of a container are numbered in order of their text. Errors are written
    first, so that archives are read once, however often what comes of them is asked for."""
    errors = reduce(DataFrame.unionByName, [r.filter("error is not null").select("container", F.col("error").alias("message")) for r in read])
    errors = cut(errors, "read-errors")
    seq = F.row_number().over(Window.partitionBy("container").orderBy("message")) - 1
    return errors.select("container", seq.cast("long").alias("seq"), F.lit(True).alias("is_error"), "message")


def extract_classfile_symbols(entries: DataFrame) -> DataFrame:
    """Symbols of class files: one row for each class, method and field that its author wrote."""
    raw = class_file_members(entries)
    level, flags, internal = F.col("level"), F.col("flags"), F.col("internal_name")
    keep_class = I.keep_symbol(F.col("class_flags"), internal, "class") & ~F.col("anonymous")
    keep = F.when(level == "method", I.keep_symbol(flags, F.col("name"), "method")).when(level == "field", I.keep_symbol(flags, F.col("name"), "field")).otherwise(True)
    none = F.lit(None).cast("string")
    of_class = I.parse_jvm_name(internal, none, F.col("inner_outer"), F.col("inner_simple"))
    id_ = I.parse_jvm_name(internal, F.col("name"), F.col("inner_outer"), F.col("inner_simple"))
    outer = F.when(F.col("inner_outer").isNotNull(), I.render_symbol_id(I.parse_jvm_name(F.col("inner_outer"), none, none, none)))
    is_class = level == "class"
    kind = F.when(is_class, I.classify_kind(flags, internal, "class")).when(level == "field", I.classify_kind(flags, F.col("name"), "field")).otherwise(I.classify_kind(flags, F.col("name"), "method"))
    rows = raw.filter(keep_class & keep).withColumn("id", id_)
    return rows.select(
        I.render_symbol_id(F.col("id")).alias("sym"), "id", F.coalesce("name", F.col("id.name")).alias("name"), kind.alias("kind"), I.access_visibility(flags).alias("visibility"),
        F.when(is_class, outer).otherwise(I.render_symbol_id(of_class)).alias("owner"),
        F.when(is_class, I.parent_ids(F.col("super_name"), F.col("interfaces"))).otherwise(F.array().cast("array<string>")).alias("parents"),
        F.when(is_class, I.render_symbol_id(F.col("id"))).otherwise(F.col("signature")).alias("type_signature"), "container", "entry", "ordinal",
    )
