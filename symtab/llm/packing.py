"""Best-fit packing of tokenized documents into training sequences (operator 11) by large-item matching.

A document is its token ids and an end id. One longer than a sequence is cut into pieces of a whole sequence, of which the
first may be shorter. A whole piece is a sequence by itself; all others are packed:

* *large* pieces, above a third of the capacity, come at most two to a sequence: from the longest down, each is matched
  with the longest large piece that still fits beside it (pieces fit by their sum alone, so this matches as many as can be);
* *small* pieces, from the longest down, go to the sequence whose gap they fill best, or to a new one if none has room.

Pieces of one length can be exchanged, so all of this is decided on the histogram of lengths, which has no more rows than a
sequence has tokens, however many documents there are. A decision is a *move*: a run of pieces of one length, by their
rank, goes into a run of sequences at one offset. A move ends with a length's pieces or with a run of sequences of one gap,
and a run is split only where a length ends, so that the number of moves is bounded by the capacity alone:
there are at most 4 runs a length, and at most the square root of twice the capacity different lengths in a sequence, so at
most half a million moves at 2,048 tokens (some thousands on given texts). They are what executors are sent.

Each piece then needs its rank among pieces of its length. Pieces are written once, with a row number that no reading
changes; rows of a length are dealt into SLICES by a hash of that number, counted by slice, and ranked within a slice, so
that a length (or a text) that a third of all rows have is spread evenly. Whole pieces are never shuffled.

Defined results: a null text counts as the empty one, which is the end id alone; a null id stays null; repeated rows are
packed each; no rows give no rows. Other columns are left out.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symtab.llm.common import materialize
from symtab.llm.tokens import ByteLevel, SegmentIds, size_blocks

CAPACITY = 2048
END_ID = 0
#: Parts of a length that are ranked apart.
SLICES = 65_536
#: Bytes of text tokenized at a time.
BLOCK = 4_000_000


def pieces_of(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(number, start, ids) of the pieces; all but the first have ``capacity`` ids."""
    first = len(ids) % capacity or min(capacity, len(ids))
    for number, end in enumerate(range(first, len(ids) + 1, capacity)):
        start = max(0, end - capacity)
        yield number, start if number else 0, ids[start if number else 0 : end]


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids); ids are unsigned 32-bit integers, little-endian."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = SegmentIds(ByteLevel(tokenizer).encode)
        for batch in it:
            texts = batch.column(1).fill_null("")
            for a, b in size_blocks(pc.binary_length(texts).to_numpy(), BLOCK):
                row, piece, start, length, parts = [], [], [], [], []
                ((ids, bounds),) = segments.of(texts.slice(a, b - a))
                for i in range(b - a):
                    for number, begin, part in pieces_of(np.append(ids[bounds[i] : bounds[i + 1]], end_id).astype("<u4"), capacity):
                        row.append(a + i)
                        piece.append(number)
                        start.append(begin)
                        length.append(len(part))
                        parts.append(part.tobytes())
                columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


class Plan:
    """Moves of pieces, decided on the number of pieces of each length below the capacity."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.sequences = capacity, 0
        self.left, self.ranks = dict(counts), defaultdict(int)
        self.moves: list[tuple[int, int, int, int, int]] = []
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first sequence, sequences)
        self.gaps: list[int] = []
        self.match_large()
        self.fill_gaps()
        self.moves.sort()

    def move(self, length: int, pieces: int, sequence: int, each: int, offset: int) -> None:
        """The next ``pieces`` of a length go to sequences from ``sequence`` on, ``each`` to one, from ``offset`` on."""
        self.moves.append((length, self.ranks[length], sequence, each, offset))
        self.ranks[length] += pieces
        self.left[length] -= pieces

    def put(self, gap: int, first: int, n: int) -> None:
        if gap and n:
            if not self.runs[gap]:
                insort(self.gaps, gap)
            self.runs[gap].append((first, n))

    def opened(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def match_large(self) -> None:
        large = sorted(x for x, n in self.left.items() if 3 * x > self.capacity and n)
        while large:
            one = large[-1]
            at = bisect_left(large, min(one, self.capacity - one) + 1) - 1
            other = large[at] if at >= 0 else None
            if other == one and self.left[one] == 1:  # no second one of this length: the next shorter
                other = large[at - 1] if at > 0 else None
            if other is None:
                n = self.left[one]
                first = self.opened(n)
                self.move(one, n, first, 1, 0)
                self.put(self.capacity - one, first, n)
            else:
                n = self.left[one] // 2 if other == one else min(self.left[one], self.left[other])
                first = self.opened(n)
                if other == one:
                    self.move(one, 2 * n, first, 2, 0)
                else:
                    self.move(one, n, first, 1, 0)
                    self.move(other, n, first, 1, one)
                self.put(self.capacity - one - other, first, n)
            large = [x for x in large if self.left[x]]

    def fill_gaps(self) -> None:
        for length in sorted((x for x, n in self.left.items() if n), reverse=True):
            while n := self.left[length]:
                at = bisect_left(self.gaps, length)
                if at == len(self.gaps):
                    some = -(-n // (self.capacity // length))
                    self.put(self.capacity, self.opened(some), some)
                gap = self.gaps[at]
                first, some = self.runs[gap].pop()
                if not self.runs[gap]:
                    del self.gaps[at]
                each = gap // length  # after one piece the gap that is left is the best one for the next
                if full := min(some, n // each):
                    self.move(length, full * each, first, each, self.capacity - gap)
                    self.put(gap - each * length, first, full)
                    self.put(gap, first + full, some - full)
                else:
                    self.move(length, n, first, each, self.capacity - gap)
                    self.put(gap - n * length, first, 1)
                    self.put(gap, first + 1, some - 1)

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by length and rank (from 0) among those of that length."""
        size, since, sequence, each, offset = self.columns
        at = np.searchsorted((size << 44) | since, (length << 44) | rank, side="right") - 1
        nth = rank - since[at]
        return sequence[at] + nth // each[at], offset[at] + nth % each[at] * length

    def finished(self) -> Plan:
        """The moves as columns, which is all that ``places`` needs."""
        self.columns = np.array(self.moves, np.int64).reshape(-1, 5).T.copy()
        self.moves = self.runs = self.gaps = self.left = self.ranks = None
        return self


def packed_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each piece with its ids, its sequence and its offset there: (doc_id, piece, start, length, ids, sequence_id, offset).

    Sequences of whole pieces have negative numbers, the others 0, 1, ...
    """
    pieces = token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    pieces = materialize(pieces, "pack-pieces")
    whole = pieces.filter(F.col("length") == capacity).select("*", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts = pieces.filter(F.col("length") < capacity).withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(SLICES)).cast("int"))

    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # less rows than a sequence has tokens
    plan = Plan(counts, capacity).finished()

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = plan.places(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    before = Window.partitionBy("length2").orderBy("slice2").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy(F.col("length").alias("length2"), F.col("slice").alias("slice2")).agg(F.count("*").alias("n"))
    offsets = offsets.select("length2", "slice2", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "slice").orderBy("row")
    ranked = parts.withColumn("nth", F.row_number().over(within)).join(offsets, (F.col("length") == F.col("length2")) & (F.col("slice") == F.col("slice2")))
    placed = ranked.withColumn("place", place("length", F.col("before") + F.col("nth") - 1)).select(*pieces.columns, "place.*")
    return placed.unionByName(whole).drop("row")


def packed_sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the pieces of each sequence one after another. A sequence has at most ``capacity`` pieces."""
    pieces = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))
    ids = F.aggregate("pieces", F.lit(b""), lambda sofar, piece: F.concat(sofar, piece.ids))
    return pieces.select("sequence_id", "n_tokens", ids.alias("ids"))
