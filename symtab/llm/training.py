"""Labelled rows to fit classifiers on: a bounded sample, never from the held-out fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symtab.llm.common import id_remainder_col

FOLDS, HELD_OUT = 3, 1


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y) of at most ``bound`` labelled rows outside the held-out fold (crc32 of the id, modulo 3, is not 1).

    The rows with the least hash of their id are taken, so a rerun fits on the same ones. Rows with a null label or id are
    never used; of equal texts with equal labels one is used.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & (id_remainder_col(id_col, FOLDS) != HELD_OUT))
    known = known.groupBy(id_col).agg(F.max(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64(F.lit(29), id_col), id_col).limit(bound)
    texts = docs.select(id_col, F.col(text_col).alias("text")).filter("text is not null")
    return texts.join(chosen, id_col).select("text", "y").distinct()
