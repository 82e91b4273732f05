"""Mixing sources to target weights by weighted fair queueing (operator 7), with DataFrame functions only.

Every source is a flow whose packets are its shuffled documents, offered up to MAX_EPOCHS times. A document's virtual
finish time is its source's cumulative tokens, itself included, divided by the source's target; in one unit of virtual
time each source is served its target. Documents are taken in the global order of finish times until the total budget
is reached.

Nothing is ranked as a whole: cumulative tokens come from slice totals of the shuffle key (see ``sharding``), and the
place where the budget ends is found by two histograms of finish times (aggregated before the shuffle), each finer than
the one before, and an exact running sum inside the last, narrow bucket. Its key, one row, then decides for each
document how many of its epochs lie before the end.

Defined results: a null source comes last in source order and is a source of its own; a null or empty text has size 0
and is never counted; a source whose texts are all empty has target 0 and takes nothing; repeated rows are separate
packets; no rows give no rows; input columns named like the outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symtab.llm.common import WORD, discard, fresh, materialize, shuffle_key, source_key, without

SLICE_DIGITS = 3
MAX_EPOCHS = 3
#: Buckets of virtual time per unit, the number of them, and how often one is split for the second histogram.
COARSE, LAST_COARSE, FINE = 1024, 8191, 4096

OUTPUTS = ("size", "source_size", "target", "copies", "taken")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(src, src_no, source_size, target) from (src, source_size): shares by weight, stopped at MAX_EPOCHS times the size.

    Weights go round the sources by code point, null last. Water filling in closed form: with sources sorted by the level
    at which they are full, the first k are full exactly if the level that the rest share is below the next one's.
    """
    everything, upto = Window.partitionBy(), Window.orderBy("full_at", "src_no").rowsBetween(Window.unboundedPreceding, 0)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("src_no") - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("src_no", F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last()))).withColumn("w", w)
    t = t.withColumn("cap", F.col("source_size") * float(MAX_EPOCHS)).withColumn("full_at", F.col("cap") / F.col("w"))
    t = t.withColumn("total", F.sum("source_size").over(everything)).withColumn("total_w", F.sum("w").over(everything))
    t = t.withColumn("cap_before", F.sum("cap").over(upto) - F.col("cap")).withColumn("w_before", F.sum("w").over(upto) - F.col("w"))
    # the level if all sources before this one are full; the true level is the first that does not fill this source
    t = t.withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("total_w") - F.col("w_before")))
    t = t.withColumn("true_level", F.min(F.when(F.col("level") < F.col("full_at"), F.struct("full_at", "src_no", "level"))).over(everything)["level"])
    return t.select("src", "src_no", "source_size", F.when(F.col("full_at") <= F.col("true_level"), F.col("cap")).otherwise(F.coalesce(F.col("w") * F.col("true_level"), F.lit(0.0))).alias("target"))


def fair_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 11, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` plus size (long), source_size (long), target (double), copies (int, 0 to 3) and taken (long: copies x size)."""
    docs = without(docs, *OUTPUTS)
    columns = docs.columns
    key, sl, tie, cum, before = fresh(docs, "fq_key", "fq_slice", "fq_tie", "fq_cum", "fq_before")
    src, src_no, src2, sl2, srck = fresh(docs, "src", "src_no", "fq_src2", "fq_slice2", "fq_srck")

    def sized(df: DataFrame) -> DataFrame:
        size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
        return df.withColumn("size", size).withColumn(srck, source_key(F.col(source_col))).withColumn(key, shuffle_key(seed, id_col)).withColumn(sl, F.substring(key, 1, SLICE_DIGITS)).withColumn(tie, F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))

    narrow = materialize(sized(docs.select(id_col, source_col, text_col)).drop(text_col), "mix-sizes")
    targets = materialize(source_targets(narrow.groupBy(F.col(source_col).alias("src")).agg(F.sum("size").alias("source_size")), weights), "mix-targets")

    slices = narrow.groupBy(F.col(srck).alias(src2), F.col(sl).alias(sl2)).agg(F.sum("size").alias(before))
    earlier = Window.partitionBy(src2).orderBy(sl2).rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    slices = slices.join(targets.withColumn("src", source_key(F.col("src"))).withColumnsRenamed({"src": src, "src_no": src_no}), F.col(src) == F.col(src2)).drop(src)

    def finished(df: DataFrame) -> DataFrame:
        """Adds the source's figures and the cumulative tokens of the source up to the document."""
        within = Window.partitionBy(srck, sl).orderBy(key, F.col(id_col), tie, "size").rowsBetween(Window.unboundedPreceding, 0)
        run = df.withColumn(cum, F.sum("size").over(within)).join(slices, (F.col(srck) == F.col(src2)) & (F.col(sl) == F.col(sl2)))
        return run.withColumn(cum, F.col(cum) + F.col(before)).drop(srck, src2, sl2, sl, before)

    def item(epoch: int):
        """Order of the offer of a document in an epoch; a source without a target is never served."""
        finish = F.when(F.col("target") > 0, (F.col(cum) + F.lit(epoch) * F.col("source_size")) / F.col("target")).otherwise(F.lit(float("inf")))
        return F.struct(finish.alias("finish"), F.col(src_no).alias("src_no"), F.col(key).alias("key"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(tie).alias("tie"), F.lit(epoch).alias("epoch"))

    budget = targets.agg(F.sum("source_size")).first()[0] or 0
    offers = finished(narrow).filter("size > 0 and target > 0").select("size", F.explode(F.array(*[item(e) for e in range(MAX_EPOCHS)])).alias("item"))
    offers = offers.withColumn("coarse", F.least(F.floor(F.col("item.finish") * COARSE), F.lit(LAST_COARSE)))
    offers = offers.withColumn("fine", F.least(F.floor((F.col("item.finish") * COARSE - F.col("coarse")) * FINE), F.lit(FINE)))
    offers = materialize(offers, "mix-offers")
    last = _last_offer(offers, budget)
    discard(offers)
    out = finished(sized(docs))
    copies = F.lit(0)
    for e in range(MAX_EPOCHS if last is not None else 0):
        end = F.struct(*[F.lit(last[f]).cast(t) for f, t in (("finish", "double"), ("src_no", "int"), ("key", "string"), ("id", "string"), ("tie", "string"), ("epoch", "int"))])
        copies = copies + (item(e) <= end).cast("int")
    return out.withColumn("copies", copies.cast("int")).withColumn("taken", F.col("copies") * F.col("size")).select(*columns, *OUTPUTS)


def _last_offer(offers: DataFrame, budget: int):
    """The last offer, in order, up to which sizes sum to no more than the budget; None if there is none. One row each time."""
    def crossing(df: DataFrame, bucket: str, already: int):
        """The first bucket whose running total passes the budget, and the total before it."""
        sums = df.groupBy(bucket).agg(F.sum("size").alias("s"))
        run = sums.withColumn("upto", F.sum("s").over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)) + already)
        row = run.filter(F.col("upto") > budget).orderBy(bucket).select(bucket, (F.col("upto") - F.col("s")).alias("before")).first()
        return (None, 0) if row is None else (row[0], row[1])

    def greatest(df: DataFrame):
        return df.agg(F.max("item")).first()[0]

    coarse, before = crossing(offers, "coarse", 0)
    if coarse is None:
        return greatest(offers)
    inside = offers.filter(F.col("coarse") == coarse)
    fine, before = crossing(inside, "fine", before)
    exact = inside.filter(F.col("fine") == fine).withColumn("upto", F.sum("size").over(Window.orderBy("item").rowsBetween(Window.unboundedPreceding, 0)) + before)
    within = greatest(exact.filter(F.col("upto") <= budget))
    if within is not None:
        return within
    earlier = greatest(inside.filter(F.col("fine") < fine))
    return earlier if earlier is not None else greatest(offers.filter(F.col("coarse") < coarse))
