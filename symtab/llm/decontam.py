"""Benchmark decontamination by size-partitioned MinHash containment search (operator 5), with DataFrame functions only.

Test items are short, documents are long, and the question is containment: the share of an item's word shingles that a
document has. Plain MinHash compares whole sets, whose Jaccard similarity tends to 0 as the document grows. So items are
partitioned by size, and every partition gets windows of its own over the documents, twice as long as its largest item
and half overlapping. Against such a window an item with containment t has a Jaccard similarity of at least about t / 5,
which HASHES single-value bands miss with a chance of 0.84 ** HASHES = 1.4e-5 at a containment of 0.8 and far less above,
whether the item stands in one place or in pieces.

1. Items: shingle sets by size class; per item and seed the least hash (its signature).
2. Documents: a window's least hash can equal an item's only if that shingle is in the window. So shingles are first
   met with the signature shingles (loses nothing), and only windows that were hit are hashed.
3. Windows whose least hash under some seed is an item's propose (text, item) pairs.
4. Pairs are verified by exact containment over the whole text.

A text is known by its 128-bit hash from step 2 on, so copies are searched once. The item side is broadcast only when it
has at most BROADCAST_ITEMS rows; beyond that both sides are shuffled on the shingle hash.

Defined results: words are as in WORD, lower-cased; an item with fewer words than a shingle is one shingle of that many
words and is met by equal word sequences of documents; null or empty items and texts match nothing; a null doc_id is
kept as a null; repeated rows get rows of their own; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symtab.llm.common import fresh, materialize

SHINGLE = 5
HASHES = 64
#: Rows of an item-side table (24 bytes each), and of text hashes (32 characters each), that may be broadcast.
BROADCAST_ITEMS, BROADCAST_TEXTS = 2_000_000, 200_000


def words(text: Column) -> Column:
    """Lower-cased words of a text; A-Z only, so that every engine agrees."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(F.coalesce(lower, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hashes(ws: str, size: int) -> Column:
    """Hashes of the runs of ``size`` words of the array column ``ws``, in order."""
    run = ", ".join(f"{ws}[i + {j}]" for j in range(size))
    return F.expr(f"CASE WHEN size({ws}) >= {size} THEN transform(sequence(0, size({ws}) - {size}), i -> xxhash64({size}, {run})) ELSE cast(array() AS array<bigint>) END")


def item_shingles(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, k, n, class, h): distinct shingle hashes of k words; n of them; size class: n <= 2 ** class."""
    t = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).filter("size(w) > 0")
    t = t.withColumn("k", F.least(F.size("w"), F.lit(SHINGLE)))
    hashes = F.when(F.col("k") == 1, shingle_hashes("w", 1))
    for k in range(2, SHINGLE + 1):
        hashes = hashes.when(F.col("k") == k, shingle_hashes("w", k))
    t = t.select("item_id", "k", F.array_distinct(hashes).alias("hs"))
    n = F.size("hs")
    return t.select("item_id", "k", n.alias("n"), F.ceil(F.log2(n)).cast("int").alias("class"), F.explode("hs").alias("h")).distinct()


def least_hash(h: Column, seed: int) -> Column:
    return F.min(F.xxhash64(F.lit(seed), h))


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ITEMS) -> DataFrame:
    """Broadcast only what has been counted and is small; else Spark's shuffle joins take it."""
    return F.broadcast(df) if rows <= limit else df


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(text_key, item_id, n_shared, n_item): texts, by hash, that hold at least ``threshold`` of an item's shingles."""
    shingles = materialize(item_shingles(items, item_id, item_text), "items")
    n_rows = shingles.count()
    # per class and seed, the least hash of each item
    seeded = shingles.groupBy("item_id", "k", "class").agg(*[F.struct(least_hash(F.col("h"), s).alias("m"), F.min_by("h", F.xxhash64(F.lit(s), "h")).alias("h")).alias(f"s{s}") for s in range(HASHES)])
    signature = seeded.select("item_id", "k", "class", F.posexplode(F.array(*[f"s{s}" for s in range(HASHES)])).alias("seed", "x")).select("item_id", "k", "class", "seed", "x.m", "x.h")
    signature = materialize(signature, "signatures")
    n_bands = n_rows * HASHES  # at least the rows of the signature table

    # at most SHINGLE lengths and, in each, as many classes as a size has bits
    classes = {r["k"]: sorted(r["cs"]) for r in shingles.groupBy("k").agg(F.collect_set("class").alias("cs")).collect()}
    lengths = sorted(classes)
    if not lengths:
        return shingles.select(F.lit("").alias("text_key"), "item_id", F.lit(0).alias("n_shared"), F.col("n").alias("n_item")).limit(0)

    def read(df: DataFrame) -> DataFrame:
        return df.select(text_key(F.col(text_col)).alias("text_key"), words(F.col(text_col)).alias("w"))

    def positions(df: DataFrame) -> DataFrame:
        """One row for each shingle of each length that items have: (text_key, k, p, h)."""
        runs = [df.select("text_key", F.lit(k).alias("k"), F.posexplode(shingle_hashes("w", k)).alias("p", "h")) for k in lengths]
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        return out

    # windows of class c start at multiples of 2 ** c and are 2 ** (c + 1) long, so a position is in two of them
    asked = signature.select("k", "class", "h").distinct()
    hit = positions(read(docs)).join(small(asked, n_bands), ["k", "h"])
    number = F.floor(F.col("p") / F.pow(F.lit(2.0), F.col("class"))).cast("long")
    hit = hit.select("text_key", "k", "class", F.explode(F.array(number, number - 1)).alias("window")).filter("window >= 0 or window = -1").distinct()
    hit = materialize(hit, "windows")

    keys = materialize(hit.select("text_key").distinct(), "touched-keys")
    # raw texts meet the keys (not their word arrays, which are far larger), each text once
    texts = docs.select(F.col(text_col).alias(text_col), text_key(F.col(text_col)).alias("key")).join(small(keys, keys.count(), BROADCAST_TEXTS), F.col("key") == F.col("text_key"), "left_semi")
    touched = materialize(read(texts.groupBy("key").agg(F.first(text_col).alias(text_col))), "touched")
    cls = F.col("class")
    of_length = F.create_map(*[x for k in lengths for x in (F.lit(k), F.array(*map(F.lit, classes[k])))])
    inside = positions(touched).withColumn("class", F.explode(of_length[F.col("k")]))
    base = F.floor(F.col("p") / F.pow(F.lit(2.0), cls)).cast("long")
    inside = inside.select("text_key", "k", "class", "h", F.explode(F.array(base, base - 1)).alias("window")).join(hit, ["text_key", "k", "class", "window"], "left_semi")
    least = inside.groupBy("text_key", "k", "class", "window").agg(*[least_hash(F.col("h"), s).alias(f"m{s}") for s in range(HASHES)])
    bands = least.select("text_key", "k", "class", F.posexplode(F.array(*[f"m{s}" for s in range(HASHES)])).alias("seed", "m"))
    pairs = bands.join(small(signature.select("item_id", "k", "class", "seed", "m"), n_bands), ["k", "class", "seed", "m"]).select("text_key", "item_id").distinct()
    pairs = materialize(pairs, "pairs")

    # exact containment over whole texts
    wanted = pairs.join(small(shingles.select("item_id", "k", "n", "h"), n_rows), "item_id")
    have = positions(touched).select("text_key", "k", "h").join(small(shingles.select("k", "h").distinct(), n_rows), ["k", "h"]).distinct()
    shared = wanted.join(have, ["text_key", "k", "h"]).groupBy("text_key", "item_id", "n").agg(F.count("*").alias("n_shared"))
    return shared.filter(F.col("n_shared") >= threshold * F.col("n") - 1e-9).select("text_key", "item_id", "n_shared", F.col("n").alias("n_item"))


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment): one row for each document row and item that it holds."""
    found = materialize(contaminated(docs, items, threshold, id_col, text_col, item_id, item_text), "leaks")
    keyed = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"))
    return keyed.join(found, "text_key").select("doc_id", "item_id", F.col("n_shared").cast("long"), F.col("n_item").cast("long"), (F.col("n_shared") / F.col("n_item")).alias("containment"))


def decontaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no item."""
    found = materialize(contaminated(docs, items, threshold, id_col, text_col, item_id, item_text).select("text_key").distinct(), "leaks")
    (key,) = fresh(docs, "dc_key")
    return docs.withColumn(key, text_key(F.col(text_col))).join(small(found.withColumnRenamed("text_key", key), found.count(), BROADCAST_TEXTS), key, "left_anti").select(*docs.columns)
