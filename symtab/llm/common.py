"""What the operators share: reading tables, tables between steps, fresh column names, and word hashing for Arrow batches."""

from __future__ import annotations

import zlib

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symtab.scratch import cut as materialize  # noqa: F401  (tables between steps)
from symtab.scratch import discard  # noqa: F401

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; only Spark's reader opens the path, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` does not have yet (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add: its own output replaces input columns of that name."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def shuffle_key(seed: int, id_col: str) -> Column:
    """Pseudo-random order of rows as 32 hex digits; it depends on the seed and the id alone, so reruns agree."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))


def source_key(source: Column) -> Column:
    """A source as text that is never null, so that windows and joins by source are dealt out alike and need one shuffle."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def id_remainder(ids, modulus: int) -> np.ndarray:
    """crc32 of each id as text, modulo ``modulus``; a null id counts as the text ``null``."""
    return np.fromiter((zlib.crc32(b"null" if i is None or i != i else str(int(i)).encode()) % modulus for i in ids), np.int64)


def id_remainder_col(id_col: str, modulus: int) -> Column:
    """The same as a native column."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % modulus


class WordHashes(dict):
    """64-bit hash of a word (bytes), remembered; forgets everything when full, so memory stays bounded."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of a text as UTF-8. bytes.split() splits on exactly the white space of WORD."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (two multiply-xorshift rounds)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def text_blocks(texts, limit: int = 4_000_000):
    """Index ranges of ``texts`` with about ``limit`` characters each, so that work arrays stay small; a longer text stands alone."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t) if isinstance(t, str) else 0
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)
