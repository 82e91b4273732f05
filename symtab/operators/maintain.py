"""Keeping the tables current: file by file, container by container, snapshot by snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symtab.operators.ranges import spread


def remove_files(state: DataFrame, uris: DataFrame) -> DataFrame:
    """State without the rows of the files; no files, no change. Edges follow, since they are exploded from the rows. A large
    state is dealt to tasks by its bytes, so that what one sorts does not grow with it."""
    return spread(state, "uri").join(uris.select("uri").distinct(), "uri", "left_anti").select(*state.columns)


def update_files(state: DataFrame, batch_uris: DataFrame, batch_rows: DataFrame) -> DataFrame:
    """For every file of the batch all its rows go, then the new ones come; a file without new rows is emptied."""
    return remove_files(state, batch_uris).unionByName(batch_rows.select(*state.columns))


def add_container(state: DataFrame, added: DataFrame, load_seq: str = "load_seq", ordinal: str = "ordinal", key: str = "sym") -> DataFrame:
    """Insert by id, the last writer (load_seq, ordinal) wins; the row remembers its container.

    Membership filters are refreshed by ``ingest.membership_filter_add`` with the same rows.
    """
    both = state.unionByName(added.select(*state.columns))
    rest = [c for c in state.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(load_seq, ordinal)).alias("r")).select(key, "r.*").select(*state.columns)


def update_locations(symbols: DataFrame, updates: DataFrame, key: str = "sym", location: str = "location") -> DataFrame:
    """Sets the location of ids that exist; of several updates of an id the greatest counts, unknown ids are ignored."""
    new = updates.groupBy(key).agg(F.max(location).alias("_new"))
    return symbols.join(new, key, "left").withColumn(location, F.coalesce("_new", location)).select(*symbols.columns)


def apply_compile_output(state: DataFrame, changed_uris: DataFrame, results: DataFrame | None, on_error: str = "drop") -> DataFrame:
    """Changed files go, then the results of changed files come; an empty changed set takes all results.

    ``results`` is None if indexing failed: then ``drop`` still removes the changed files, ``keep`` leaves the state.
    """
    if results is None:
        return state if on_error == "keep" else remove_files(state, changed_uris)
    changed = changed_uris.select("uri").distinct()
    kept = results if changed.isEmpty() else results.join(changed, "uri", "left_semi")
    return update_files(state, changed.unionByName(kept.select("uri")).distinct(), kept)


def changed_sources(prev: DataFrame, curr: DataFrame, include_deleted: bool = False) -> DataFrame:
    """Sources that are new or whose stamp differs; on request also those that are gone."""
    old = prev.select("source", F.col("stamp").alias("_old"))
    out = curr.join(old, "source", "left").filter(F.col("_old").isNull() | (F.col("_old") != F.col("stamp"))).select("source")
    return out.unionByName(prev.join(curr, "source", "left_anti").select("source")) if include_deleted else out


def explode_products(changed: DataFrame, class_names: DataFrame, suffix: str = ".class") -> DataFrame:
    """(source, products): sorted product paths of each changed source, dots as slashes; none gives an empty array."""
    made = changed.join(class_names, "source", "left").withColumn("p", F.concat(F.replace("class_name", F.lit("."), F.lit("/")), F.lit(suffix)))
    return made.groupBy("source").agg(F.sort_array(F.collect_list("p")).alias("products"))
