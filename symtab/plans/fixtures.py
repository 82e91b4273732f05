"""Views that give the driver's tables the shapes of the library's inputs, in SQL that Spark and DuckDB both run.

A table name in braces is replaced by the DataFrame (Spark) or the registered view (DuckDB).
"""

from __future__ import annotations

import io
import re
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession

from symtab.operators.ranges import spread

VIEWS = {
    "symbols": """
SELECT p_partkey AS sid, 'p' || CAST(p_size % 5 AS STRING) AS pkg, replace(p_brand, '#', '') AS owner1, 'P' || CAST(p_partkey AS STRING) AS owner2,
       upper(substring(split_part(p_name, ' ', 1), 1, 1)) || substring(split_part(p_name, ' ', 1), 2)
         || upper(substring(split_part(p_name, ' ', 2), 1, 1)) || substring(split_part(p_name, ' ', 2), 2) AS name,
       CASE p_size % 5 WHEN 0 THEN 'Class' WHEN 1 THEN 'Trait' WHEN 2 THEN 'Object' WHEN 3 THEN 'Enum' ELSE 'Method' END AS kind,
       'file:///src/' || replace(p_brand, '#', '') || '.scala' AS uri, CAST(floor(p_partkey / 2) AS BIGINT) AS parent_sid,
       p_partkey % 2 = 0 AS in_project, p_partkey % 3 = 0 AS in_dependency
FROM {part}""",
    "search_queries": "SELECT * FROM (VALUES (1, 'small'), (2, 'SR'), (3, 'RW'), (4, 'RED'), (5, ''), (6, 'zzz'), (7, 'S'), (8, 'coldW')) AS t(query_id, query)",
    "edges": "SELECT CAST(floor(p_partkey / 2) AS BIGINT) AS parent, p_partkey AS child FROM {part}",
    "refs": """
SELECT l_partkey AS sid, 'file:///o/' || CAST(l_orderkey AS STRING) AS uri, l_linenumber AS start_line, CAST(floor(l_quantity) AS INT) AS start_col,
       CASE l_returnflag WHEN 'R' THEN 'Override' WHEN 'A' THEN 'Extends' ELSE 'Call' END AS kind
FROM {lineitem}""",
    "spans": """
SELECT event_id AS sid, user_id AS uri, CAST((extract(day FROM ts) - 1) * 1440 + extract(hour FROM ts) * 60 + extract(minute FROM ts) AS INT) AS start_line,
       CAST(floor(extract(second FROM ts)) AS INT) AS start_col,
       CAST((extract(day FROM ts) - 1) * 1440 + extract(hour FROM ts) * 60 + extract(minute FROM ts) + floor(value * 10) AS INT) AS end_line,
       CAST(floor(extract(second FROM ts)) AS INT) AS end_col
FROM {events}""",
    "positions": """
SELECT event_id AS qid, user_id AS uri, CAST((extract(day FROM ts) - 1) * 1440 + extract(hour FROM ts) * 60 + extract(minute FROM ts) AS INT) AS line,
       CAST(floor(extract(second FROM ts)) AS INT) AS col
FROM {events} WHERE event_type = 'error'""",
    "occurrences": """
SELECT 'file:///o/' || CAST(l_orderkey AS STRING) AS uri, CASE WHEN l_partkey % 50 = 0 THEN '' ELSE 'shop/Part#p' || CAST(l_partkey AS STRING) || '().' END AS symbol,
       CASE WHEN l_linenumber = 1 THEN 'definition' ELSE 'reference' END AS role, l_linenumber AS start_line
FROM {lineitem}""",
    "infos": """
SELECT 'shop/Part#p' || CAST(p_partkey AS STRING) || '().' AS symbol, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END AS display_name,
       CASE p_size % 3 WHEN 0 THEN 'METHOD' WHEN 1 THEN 'CLASS' ELSE 'OBJECT' END AS kind
FROM {part} WHERE p_partkey % 5 <> 0""",
    "semanticdb_strings": """
SELECT c_custkey AS k, lower(r_name) || '/' || n_name || '#' || c_name || '(+' || CAST(c_custkey % 3 AS STRING) || ').' AS symbol
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "jvm_names": """
SELECT c_custkey AS k, lower(r_name) || '/' || n_name || '$C' || CAST(c_custkey AS STRING) || CASE WHEN c_custkey % 4 = 0 THEN '$' ELSE '' END AS internal_name,
       CASE WHEN c_custkey % 2 = 0 THEN lower(r_name) || '/' || n_name END AS inner_outer, CASE WHEN c_custkey % 2 = 0 THEN 'C' || CAST(c_custkey AS STRING) END AS inner_simple,
       CASE WHEN c_custkey % 3 = 0 THEN 'm' || CAST(c_custkey AS STRING) END AS member
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "versions": """
SELECT l_suppkey AS target_id, l_orderkey AS row_id, l_linenumber AS ln,
       CAST(l_linenumber AS STRING) || '.' || CAST(CAST(floor(l_quantity) AS INT) AS STRING) || '.' || CAST(l_partkey AS STRING) AS version
FROM {lineitem}""",
    "target_paths": """
SELECT DISTINCT l_suppkey AS target_ord, CASE WHEN l_partkey % 11 = 0 THEN 'out/' || CAST(l_suppkey AS STRING) || '.jar'
       WHEN l_partkey % 7 = 0 THEN 'lib/' || CAST(l_partkey AS STRING) || '.txt' ELSE 'lib/' || CAST(l_partkey AS STRING) || '.jar' END AS path
FROM {lineitem}""",
    "attempts": """
SELECT o_custkey AS container, CASE o_orderstatus WHEN 'F' THEN 'tasty' WHEN 'P' THEN 'java_source' ELSE 'bytecode' END AS source, o_orderkey AS row_id, o_orderkey % 13 = 0 AS failed
FROM {orders}""",
    "index_diagnostics": "SELECT user_id AS container, event_id AS seq, event_type = 'error' AS is_error, props AS message FROM {events} WHERE event_type IN ('error', 'click')",
    "diagnostic_events": "SELECT user_id AS uri, ts, event_id, event_type = 'signup' AS reset, event_type || ':' || props AS item FROM {events}",
    "stamps_curr": "SELECT 'file:///d/' || CAST(doc_id AS STRING) AS source, text AS content FROM {documents}",
    "stamps_prev": "SELECT 'file:///d/' || CAST(doc_id AS STRING) AS source, CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END AS content FROM {documents} WHERE doc_id % 10 <> 0",
    "edits": """
SELECT conv_id AS uri, turn AS version, role = 'system' OR turn = 0 AS full_replace, turn % 2 AS start_line, turn AS start_col, turn % 2 AS end_line, turn + 2 AS end_col,
       CASE WHEN role = 'system' OR turn = 0 THEN text || chr(10) || text ELSE text END AS text
FROM {conversations}""",
    "changed_files": "SELECT DISTINCT 'file:///o/' || CAST(l_orderkey AS STRING) AS uri, l_orderkey % 20 = 0 AS deleted FROM {lineitem} WHERE l_orderkey % 10 = 0",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a DataFrame."""
    sql = VIEWS[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", sql))})


def ctes(*names: str) -> str:
    """The WITH clause that gives DuckDB the views."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in names)


def zip_bytes(entries: list[tuple[str, bytes]]) -> bytes:
    """An archive of the entries."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def damaged_zip(entries: list[tuple[str, bytes]], damaged: set[str]) -> bytes:
    """An archive, uncompressed, in which the first byte of some entries was changed afterwards."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in entries:
            z.writestr(name, data)
        at = [i.header_offset + 30 + len(i.filename) for i in z.infolist() if i.filename in damaged]
    data = bytearray(out.getvalue())
    for i in at:
        data[i] ^= 1
    return bytes(data)


def write_archives(docs: DataFrame, folder: str, archive: Callable[[list[tuple]], bytes]) -> None:
    """Writes an archive below a folder of any store for each ``path`` of ``docs``, made from its rows (doc_id, text) in their order.

    A task has many archives and holds the rows of one; one that runs twice leaves one whole file. Many rows are dealt to tasks by
    the bytes they come from.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = FileSystem.from_uri(folder)
        mine, folders = uuid.uuid4().hex, set()
        rows = ((p, (i, t)) for b in batches for p, i, t in zip(b["path"], b["doc_id"].tolist(), b["text"], strict=True))
        for path, found in groupby(rows, lambda row: row[0]):
            name = f"{root}/{path}"
            if (parent := name.rsplit("/", 1)[0]) not in folders:
                fs.create_dir(parent, recursive=True)
                folders.add(parent)
            with fs.open_output_stream(f"{name}.{mine}.part") as f:
                f.write(archive([row for _, row in found]))
            fs.move(f"{name}.{mine}.part", name)
        yield pd.DataFrame({"path": []}, dtype=str)

    docs = docs.select("path", "doc_id", "text")
    dealt = spread(docs, "path")
    ordered = (docs.repartition("path") if dealt is docs else dealt).sortWithinPartitions("path", "doc_id")
    ordered.mapInPandas(pack, "path string").write.format("noop").mode("overwrite").save()


def class_bytes(name: str, flags: int, parent: str | None, interfaces: list[str], fields: list[tuple], methods: list[tuple], inner: tuple[str, str | None, str | None] | None = None) -> bytes:
    """A class file without code. ``fields`` and ``methods`` are (name, descriptor, flags); ``inner`` is (class, outer, simple name)."""
    pool: list[bytes] = []
    places: dict = {}

    def place(key, item: bytes) -> int:
        if key not in places:
            pool.append(item)
            places[key] = len(pool)
        return places[key]

    def text(s: str) -> int:
        data = s.encode()
        return place(s, struct.pack(">BH", 1, len(data)) + data)

    def cls(s: str | None) -> int:
        return place(("class", s), struct.pack(">BH", 7, text(s))) if s else 0

    head = struct.pack(">HHHH", flags, cls(name), cls(parent), len(interfaces)) + b"".join(struct.pack(">H", cls(i)) for i in interfaces)
    body = b""
    for members in (fields, methods):
        body += struct.pack(">H", len(members)) + b"".join(struct.pack(">HHHH", f, text(n), text(d), 0) for n, d, f in members)
    if inner:
        said = struct.pack(">HHHHH", 1, cls(inner[0]), cls(inner[1]), text(inner[2]) if inner[2] else 0, flags)
        tail = struct.pack(">HHI", 1, text("InnerClasses"), len(said)) + said
    else:
        tail = struct.pack(">H", 0)
    return struct.pack(">IHHH", 0xCAFEBABE, 0, 61, len(pool) + 1) + b"".join(pool) + head + body + tail
