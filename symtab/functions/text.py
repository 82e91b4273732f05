"""Positions in texts, spans, version order, and how symbols and paths are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def span_contains(loc: Column, line: Column, col: Column) -> Column:
    """Whether the position lies in the span, both ends included; a null location contains nothing."""
    after = (line > loc["start_line"]) | ((line == loc["start_line"]) & (col >= loc["start_col"]))
    before = (line < loc["end_line"]) | ((line == loc["end_line"]) & (col <= loc["end_col"]))
    return F.coalesce(after & before, F.lit(False))


def span_area(loc: Column) -> Column:
    """Lines times 10,000 plus columns."""
    return (loc["end_line"] - loc["start_line"]).cast("long") * 10000 + (loc["end_col"] - loc["start_col"]).cast("long")


def line_col_to_offset(text: Column, line: Column, col: Column) -> Column:
    """Offset of a 0-based position in UTF-16 units, the start of its line plus the column; -1 for a line that is not there."""
    lines = F.split(text, "\n")
    before = F.aggregate(F.slice(lines, 1, F.greatest(line, F.lit(0)).cast("int")), F.lit(0), lambda total, x: total + (F.octet_length(F.encode(x, "UTF-16LE")) / 2).cast("int") + 1)
    return F.when((line >= 0) & (line < F.size(lines)), before + col).otherwise(F.lit(-1)).cast("int")


def version_key(v: Column) -> Column:
    """Sortable key: the leading numbers (parts split by ``.``, ``-``, ``_``; fewer first in a tie), then the rest as text.

    A version that starts with no digit compares with one that does by its first character. Numbers may have any number of
    digits: they compare by how many they have without leading zeros, then as text.
    """
    digits = F.regexp_extract(v, r"^(\d+(?:[_.-]\d+)*)", 1)
    bare = F.transform(F.split(digits, "[._-]"), lambda x: F.regexp_replace(x, "^0+", ""))
    sized = F.transform(bare, lambda x: F.struct(F.length(x).alias("digits"), x.alias("number")))
    numbers = F.when(digits == "", F.filter(sized, lambda x: F.lit(False))).otherwise(sized)
    lead = F.when(v == "", 0).when(v < "0", 1).when(digits != "", 2).otherwise(3)
    return F.struct(lead.alias("lead"), numbers.alias("numbers"), F.substr(v, F.length(digits) + 1).alias("rest"))


def version_gt(v: Column, least: Column) -> Column:
    """Whether a version is newer than another."""
    return version_key(v) > version_key(least)


def symbol_display(name: Column, kind: Column, sym: Column, owner: Column, origin: Column, location: Column) -> Column:
    """(sym, name, kind, owner, origin, location) as texts."""
    said = (
        F.when(origin["_kind"] == "ProjectSource", F.concat(F.lit("project:"), origin["build_target"]))
        .when(origin["_kind"] == "ProjectOutput", F.concat(F.lit("output:"), origin["build_target"]))
        .when(origin["_kind"] == "DependencyJar", F.concat(F.lit("jar:"), origin["container"]))
        .when(origin["_kind"] == "DependencySource", F.concat(F.lit("source:"), origin["container"], F.lit("!"), origin["source_file"]))
        .otherwise(F.lit("unknown"))
    )
    at = F.when(location.isNotNull(), F.concat_ws(":", location["uri"], location["start_line"], location["start_col"]))
    return F.struct(sym.alias("sym"), name.alias("name"), kind.alias("kind"), owner.alias("owner"), said.alias("origin"), at.alias("location"))


def path_key(path: Column) -> Column:
    """First component of a path: the key that work is dealt out by."""
    return F.split_part(F.regexp_replace(path, "^/+", ""), F.lit("/"), F.lit(1))


def uri_path(uri: Column) -> Column:
    """Path of a URI, without query and fragment; of a jar URI what stands behind its scheme."""
    return F.when(uri.startswith("jar:"), F.substr(uri, F.lit(5))).otherwise(F.regexp_extract(uri, r"^[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/?#]*)?([^?#]*)", 1))
