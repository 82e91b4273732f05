"""From producers' rows (occurrences, build targets, archives) to the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symtab.functions import ids as I
from symtab.functions import text as T
from symtab.operators.ranges import spread

#: Marks of build targets that are not part of the build.
SYNTHETIC_TARGETS = ("mill-synthetic-root-target", "/.metals/readonly/")


def occurrences_to_index(occurrences: DataFrame, infos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, refs): definitions become symbols, references become Call uses. Rows without symbol or range are skipped.

    A name comes from the symbol's information or from the symbol itself, a kind from the information or is Val. Of several
    informations the last (by ``seq``, where there is one) counts.
    """
    order = F.col("seq") if "seq" in infos.columns else F.lit(0)
    info = infos.groupBy("symbol").agg(F.max_by(F.struct("display_name", "kind"), order).alias("i"))
    rows = occurrences.filter((F.col("symbol") != "") & F.col("start_line").isNotNull())
    sym = I.render_symbol_id(I.parse_semanticdb_symbol(F.col("symbol"))).alias("sym")
    place = [c for c in ("uri", "start_line", "start_col", "end_line", "end_col") if c in occurrences.columns]
    defined = rows.filter(F.col("role") == "definition").join(info, "symbol", "left")
    name = F.when(F.col("i.display_name") != "", F.col("i.display_name")).otherwise(I.simple_name(F.col("symbol")))
    kind = F.when(F.col("i").isNotNull(), I.semanticdb_kind(F.col("i.kind"))).otherwise("Val")
    return defined.select(sym, name.alias("name"), kind.alias("kind"), *place), rows.filter(F.col("role") == "reference").select(sym, F.lit("Call").alias("kind"), *place)


def _last(df: DataFrame, key: str, order: str) -> DataFrame:
    rest = F.struct(*[c for c in df.columns if c != key])
    return df.groupBy(key).agg(F.max_by(rest, order).alias("r")).select(key, "r.*")


def import_targets(targets: DataFrame, options: DataFrame, sources: DataFrame, order: str = "seq") -> DataFrame:
    """Targets with their options and sources; synthetic targets go, of repeated options or sources the last by ``order`` counts."""
    real = targets
    for mark in SYNTHETIC_TARGETS:
        real = real.filter(~F.col("target_id").contains(mark))
    return real.join(_last(options, "target_id", order).drop(order), "target_id").join(_last(sources, "target_id", order).drop(order), "target_id")


def latest_per_target(targets: DataFrame, version: str = "version", key: str = "target_id") -> DataFrame:
    """The row with the greatest version of each id; ties go to the greatest rest of the row."""
    rest = [c for c in targets.columns if c != key]
    order = F.struct(T.version_key(F.col(version)), *rest)
    dealt = spread(targets, *targets.columns)  # by whole rows: what a task sorts is bounded, and one target's rows are many tasks'
    return dealt.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*").select(*targets.columns)


def best_target_for_file(file_targets: DataFrame, targets: DataFrame, version: str = "version") -> DataFrame:
    """(uri, target_id, version): of a file's candidates the one with the newest version, ties to the greatest id; no candidates, no row."""
    met = file_targets.join(targets.select("target_id", version), "target_id")
    best = spread(met, "uri").groupBy("uri").agg(F.max(F.struct(T.version_key(F.col(version)).alias("k"), "target_id", version)).alias("b"))
    return best.select("uri", "b.target_id", f"b.{version}")


def assign_container_owner(target_paths: DataFrame, outputs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(path, target_ord): each archive on a class path that is there (in ``existing``, if given), except the project's own outputs, belongs to its first target."""
    archives = target_paths.filter(F.col("path").endswith(".jar"))
    archives = archives if existing is None else archives.join(existing.select("path").distinct(), "path", "left_semi")
    return archives.join(outputs.select("path").distinct(), "path", "left_anti").groupBy("path").agg(F.min("target_ord").alias("target_ord"))


def with_class_path(owners: DataFrame, target_paths: DataFrame, order: str = "path") -> DataFrame:
    """``owners`` plus ``class_path``, the whole class path of the owning target by ``order``."""
    whole = target_paths.groupBy("target_ord").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "path"))).alias("p"))
    return owners.join(whole, "target_ord").select(*owners.columns, F.transform("p", lambda x: x["path"]).alias("class_path"))


def choose_source(entries: DataFrame, coordinates: DataFrame, companions: DataFrame) -> DataFrame:
    """(container, source): ``tasty`` if any entry is, else ``java_source`` if the sources' archive of its coordinates is there, else ``bytecode``."""
    has = entries.groupBy("container").agg(F.bool_or(F.col("entry").endswith(".tasty")).alias("tasty"))
    named = coordinates.withColumn("file", F.concat("artifact_id", F.lit("-"), "version", F.lit("-sources.jar")))
    found = named.join(companions.select("file").distinct(), "file", "left_semi").select("container").distinct().withColumn("found", F.lit(True))
    source = F.when(F.col("tasty"), "tasty").when(F.col("found"), "java_source").otherwise("bytecode")
    return has.join(found, "container", "left").select("container", source.alias("source"))


def fallback_merge(attempts: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of each container's chosen source, or of bytecode where that failed or, for Java sources, gave nothing.

    ``attempts``: (container, source, failed), the chosen source of each container; ``rows``: (container, source, ...).
    """
    counts = rows.groupBy("container", "source").agg(F.count("*").alias("n"))
    tried = attempts.join(counts, ["container", "source"], "left")
    back = F.col("failed") | ((F.col("source") == "java_source") & (F.coalesce("n", F.lit(0)) == 0))
    use = tried.select("container", F.when(back, F.lit("bytecode")).otherwise(F.col("source")).alias("source")).distinct()
    return rows.join(use, ["container", "source"], "left_semi")


#: Bits of a block, in which all bits of a name lie; blocks of a row; bits that a name sets.
BLOCK_BITS, ROW_BLOCKS, HASHES = 512, 64, 7
#: Bits a name has at least: a rate of false hits below 1 %.
NAME_BITS = 12


def filter_blocks(n: Column) -> Column:
    """Number of blocks for n names, 16 at least: the least power of two that gives each NAME_BITS bits."""
    wanted = F.ceil(F.greatest(n, F.lit(16)) * NAME_BITS / BLOCK_BITS)
    doublings = F.when(wanted > 1, F.length(F.bin(wanted - 1))).otherwise(0)
    return F.call_function("shiftleft", F.lit(1).cast("long"), doublings)


def _hashed(names: DataFrame) -> DataFrame:
    """``names`` plus ``_block``, which tells the block in a filter of any size, and ``_bits``, the places in the block."""
    key = I.name_key(F.col("name"))
    bits = F.xxhash64(F.lit(1), key)
    return names.withColumn("_block", F.xxhash64(F.lit(0), key)).withColumn("_bits", F.array(*[F.shiftrightunsigned(bits, 9 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(HASHES)]))


def _masked(block: Column, blocks: Column) -> Column:
    return block.bitwiseAND(blocks - 1)


def membership_filter_build(names: DataFrame) -> DataFrame:
    """Blocked Bloom filters over lower-cased names by container: (container, blocks, n, row, bits).

    A filter has as many blocks of 512 bits as its names need, a power of two; a name sets its bits in one of them. Filters of
    up to 64 blocks (about 2,700 names) are one row, whose bytes follow the names; a larger one has a row for each 64 blocks,
    so that no row is large and a probe finds its row by (container, row).
    """
    keys = names.filter("container is not null and name is not null").select("container", I.name_key(F.col("name")).alias("name")).distinct()
    sizes = keys.groupBy("container").agg(F.count("*").alias("n")).select(F.col("container").alias("_container"), "n", filter_blocks(F.col("n")).alias("blocks"))
    return _built(_hashed(keys).join(sizes, F.col("container") == F.col("_container")))


def _built(hashed: DataFrame) -> DataFrame:
    """Rows of filters from hashed names that bear ``n`` and ``blocks`` of their container."""
    block = _masked(F.col("_block"), F.col("blocks"))
    rows = hashed.withColumn("row", F.floor(block / ROW_BLOCKS)).withColumn("_within", block % ROW_BLOCKS * BLOCK_BITS)
    places = rows.select("container", "blocks", "n", "row", F.explode(F.transform("_bits", lambda b: b + F.col("_within"))).alias("p"))
    bitmap = F.bitmap_construct_agg("p")
    made = places.groupBy("container", "blocks", "n", "row").agg(bitmap.alias("bits"))
    return made.withColumn("bits", _trimmed(F.col("bits"), F.col("blocks")))


def _trimmed(bits: Column, blocks: Column) -> Column:
    """A bitmap of Spark's (of 64 blocks) cut to the blocks that a filter has."""
    return F.substring(bits, F.lit(1), (F.least(blocks, F.lit(ROW_BLOCKS)) * (BLOCK_BITS // 8)).cast("int"))


def membership_filter_add(filters: DataFrame, added: DataFrame, names: DataFrame) -> DataFrame:
    """Filters after names were added to containers, old or new. ``names`` holds all names, the added ones too.

    Where a filter still has room the new names' bits are set in it. One that has none, or that is new, is built from
    ``names``, so bytes and the rate of false hits follow the names however they came. Filters can't forget: a name that
    moved may still be contained where it was, until its filter is built anew.
    """
    keys = added.filter("container is not null and name is not null").select("container", I.name_key(F.col("name")).alias("name")).distinct()
    more = keys.groupBy("container").agg(F.count("*").alias("_more"))
    sizes = filters.groupBy(F.col("container").alias("_c")).agg(F.max("blocks").alias("blocks"), F.max("n").alias("n"))
    after = more.join(sizes, F.col("container") == F.col("_c"), "left").withColumn("_n", F.coalesce("n", F.lit(0)) + F.col("_more"))
    after = after.withColumn("_fits", F.coalesce(filter_blocks(F.col("_n")) <= F.col("blocks"), F.lit(False)))
    fits = after.filter("_fits").select(F.col("container").alias("_container"), "blocks", F.col("_n").alias("n"))
    outgrown = after.filter("not _fits").select("container")
    set_now = _built(_hashed(keys).join(fits, F.col("container") == F.col("_container")))
    kept = filters.join(outgrown, "container", "left_anti").unionByName(set_now)
    merged = kept.groupBy("container", "blocks", "row").agg(F.max("n").alias("n"), F.bitmap_or_agg("bits").alias("bits")).withColumn("bits", _trimmed(F.col("bits"), F.col("blocks")))
    counts = merged.groupBy(F.col("container").alias("_c")).agg(F.max("n").alias("_n"))  # rows that no new name touched too
    merged = merged.join(counts, F.col("container") == F.col("_c")).withColumn("n", F.col("_n")).select(*filters.columns)
    return merged.unionByName(membership_filter_build(names.join(outgrown, "container", "left_semi")).select(*filters.columns))


def membership_filter_fold(filters: DataFrame, blocks: int) -> DataFrame:
    """Filters folded to ``blocks`` (a power of two); smaller ones stay as they are.

    A block's number is a mask of the name's hash, so a filter of half the size is the two halves laid over each other.
    """
    larger = filters.filter(F.col("blocks") > blocks)
    if blocks >= ROW_BLOCKS:
        parts = larger.withColumn("row", F.col("row") % (blocks // ROW_BLOCKS))
    else:
        size = blocks * BLOCK_BITS // 8
        starts = F.sequence(F.lit(1), F.octet_length("bits"), F.lit(size))
        parts = larger.withColumn("_start", F.explode(starts)).withColumn("bits", F.substring(F.col("bits"), F.col("_start"), F.lit(size))).withColumn("row", F.lit(0).cast("long"))
    folded = parts.groupBy("container", "row").agg(F.max("n").alias("n"), F.bitmap_or_agg("bits").alias("bits"))
    folded = folded.withColumn("blocks", F.lit(blocks).cast("long")).withColumn("bits", _trimmed(F.col("bits"), F.col("blocks")))
    return folded.select(*filters.columns).unionByName(filters.filter(F.col("blocks") <= blocks))


def membership_filter_union(filters: DataFrame, blocks: int | None = None, container: str = "*") -> DataFrame:
    """One filter, named ``container``, of what any of the filters contains, all folded to the size of the smallest.

    ``blocks`` asks for another size, for which each filter must be large enough: smaller ones can't be unfolded and raise.
    """
    least, n = filters.groupBy("container").agg(F.min("blocks").alias("b"), F.max("n").alias("n")).agg(F.min("b"), F.sum("n")).first()  # two numbers
    least = least or 1
    blocks = blocks or least
    if blocks > least:
        raise ValueError(f"a filter has {least} blocks; a union has no more than the smallest")
    both = membership_filter_fold(filters, blocks).groupBy("row").agg(F.bitmap_or_agg("bits").alias("bits"))
    out = both.select(F.lit(container).alias("container"), F.lit(blocks).cast("long").alias("blocks"), F.lit(n).cast("long").alias("n"), "row", "bits")
    return out.withColumn("bits", _trimmed(F.col("bits"), F.col("blocks"))).select(*filters.columns)


def membership_filter_probe(filters: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes`` (container, name, ...) plus ``might_contain``; false for an unknown container. A hit still needs the exact join.

    A probe is one row: the size of its container's filter, a number a container, tells the block, and the block's row of
    bits is met by (container, row).
    """
    sizes = filters.groupBy(F.col("container").alias("_container")).agg(F.max("blocks").alias("_blocks"))
    asked = _hashed(probes).join(sizes, F.col("container") == F.col("_container"), "left")
    block = _masked(F.col("_block"), F.col("_blocks"))
    asked = asked.withColumn("_row", F.floor(block / ROW_BLOCKS)).withColumn("_within", block % ROW_BLOCKS * BLOCK_BITS).drop("_container")
    kept = filters.select(F.col("container").alias("_c"), F.col("row").alias("_r"), F.col("bits").alias("_filter"))
    met = asked.join(kept, (F.col("container") == F.col("_c")) & (F.col("_row") == F.col("_r")), "left")
    place = lambda b: (b + F.col("_within")).cast("int")
    # bit k of the bitmap is bit k % 8 of byte k / 8
    byte = lambda b: F.conv(F.hex(F.substring(F.col("_filter"), F.shiftright(place(b), 3) + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.forall("_bits", lambda b: byte(b).bitwiseAND(F.pow(F.lit(2), place(b) % 8).cast("int")) != 0)
    return met.withColumn("might_contain", F.coalesce(is_set, F.lit(False))).select(*probes.columns, "might_contain")
