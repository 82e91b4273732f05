"""Sharding by proportional stratified interleaving (operator 1), with DataFrame functions only.

Rows of each source are shuffled by a seeded hash and ranked; the fractional rank ``(2 * rank - 1) / (2 * rows of the
source)`` spreads every source evenly over (0, 1). Rows sorted by it are cut into shards of equal row counts, so each
shard holds each source in proportion, to within about one row a source.

A rank over a whole source, or over everything, would be one task's work. Both ranks are therefore split: the hash (and
the fractional rank) is divided into SLICES equal ranges, rows are counted by slice first (aggregated before the
shuffle), running sums of these small counts give every slice its offset, and only rows of one slice are sorted together.
A source with a third of all rows is spread over all its slices.

Defined results: a null source is a source of its own; a null id is shuffled as the text ``null``; repeated rows are all
placed; no rows give no rows; input columns named like the outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symtab.llm.common import fresh, shuffle_key, source_key, without

#: Hex digits of the shuffle key that number a slice: 16 ** 3 = 4,096 slices of a source.
SLICE_DIGITS = 3
#: Slices of the global order.
SLICES = 4096


def interleaved_shards(docs: DataFrame, n_shards: int, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", tie_col: str | None = None) -> DataFrame:
    """``docs`` plus ``shard`` (int, 0 to n_shards - 1) and ``slot`` (long, gapless from 0 within its shard).

    Shard sizes differ by one row at most. ``tie_col`` orders rows whose id is equal.
    """
    docs = without(docs, "shard", "slot")
    key, sl, rank, n, off, frac, gsl, pos, total = fresh(docs, "ps_key", "ps_slice", "ps_rank", "ps_n", "ps_off", "ps_frac", "ps_gslice", "ps_pos", "ps_total")
    src, src2, sl2, gsl2 = fresh(docs, "ps_src", "ps_src2", "ps_slice2", "ps_gslice2")
    ties = [F.col(tie_col)] if tie_col else []
    keyed = docs.withColumn(key, shuffle_key(seed, id_col)).withColumn(sl, F.substring(key, 1, SLICE_DIGITS)).withColumn(src, source_key(F.col(source_col)))

    # rows by source and slice, and the rows of the source that come before each slice
    counts = keyed.groupBy(F.col(src).alias(src2), F.col(sl).alias(sl2)).agg(F.count("*").alias(n))
    by_source = Window.partitionBy(src2)
    offsets = counts.select(
        src2, sl2,
        (F.sum(n).over(by_source.orderBy(sl2).rowsBetween(Window.unboundedPreceding, -1))).alias(off),
        F.sum(n).over(by_source).alias(total),
    ).fillna(0, [off])
    within = Window.partitionBy(src, sl).orderBy(key, id_col, *ties)
    ranked = keyed.withColumn(rank, F.row_number().over(within)).join(offsets, (F.col(src) == F.col(src2)) & (F.col(sl) == F.col(sl2)))
    ranked = ranked.withColumn(frac, (2.0 * (F.col(rank) + F.col(off)) - 1) / (2.0 * F.col(total))).drop(src, src2, sl2, rank, off, total, sl)
    ranked = ranked.withColumn(gsl, F.floor(F.col(frac) * SLICES).cast("int"))

    # How many rows of each source fall into a global slice follows from its size alone: ranks r with
    # floor((2r - 1) / (2n) * SLICES) = slice. It is counted rather than derived, so that rounding can't differ.
    before = Window.orderBy(gsl2).rowsBetween(Window.unboundedPreceding, -1)
    globals_ = ranked.groupBy(F.col(gsl).alias(gsl2)).agg(F.count("*").alias(n))
    globals_ = globals_.select(gsl2, F.sum(n).over(before).alias(off), F.sum(n).over(Window.partitionBy()).alias(total)).fillna(0, [off])
    order = Window.partitionBy(gsl).orderBy(frac, F.col(source_col).asc_nulls_last(), key, id_col, *ties)
    placed = ranked.withColumn(rank, F.row_number().over(order)).join(globals_, F.col(gsl) == F.col(gsl2))
    placed = placed.withColumn(pos, F.col(off) + F.col(rank) - 1)
    shard = F.expr(f"`{pos}` * {n_shards} div `{total}`")
    # the first position of shard s is ceil(s * total / n_shards)
    first = F.expr(f"(shard * `{total}` + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col(pos) - first).cast("long")).select(*docs.columns, "shard", "slot")
