"""Alignment of two tokenizers' tokens (operator 12) by diagonal run skipping.

Tokenizer A is byte-level and gets the text after a space, B is a piece tokenizer that adds the space itself, so both
tokenize the same bytes. Where tokens of both end at one byte, a *group* ends. Ends are increasing, and mostly pair up one
to one for long stretches, on a diagonal of the two arrays of ends: from place (i, j) the ends at (i + k, j + k) are
compared in slices of 1, 2, 4, ... until a slice differs, and the last doubling is halved down to the exact length of the
run. What follows is an irregular group, resolved locally by stepping to the lesser end until both ends meet, after which
the diagonal has another shift. The steps of an irregular group, like the places of a run, are the *links*: the pairs of
tokens whose bytes overlap.

How many documents hold a linked pair of ids, and whether that is the most for its A id, are facts about the whole corpus.
Documents are aligned in blocks; a block sends each distinct pair once, with its number of documents, so that a pair that
every document holds is one row a block and is added up before the shuffle; it gets the counts back in the same rows and
weighs its documents' links with them. Blocks keep their links packed, are written once, and no text is tokenized twice.

Defined results: null and empty texts, and texts whose tokens do not give back their bytes, have no tokens: zeros and an
empty digest. A null id stays null, repeated rows count each, no rows give no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symtab.llm.common import materialize
from symtab.llm.tokens import ByteLevel, Pieces, SegmentIds, ranges, size_blocks

#: Bytes of text tokenized and aligned at a time, and bytes of text whose pairs are counted together.
STEP, BLOCK = 4_000_000, 16_000_000


def run_length(a: list[int], b: list[int], i: int, j: int) -> int:
    """How many ends from (i, j) on are alike one to one, by exponential probing and halving."""
    run, step = 0, 1
    while (left := a[i + run : i + run + step]) and left == b[j + run : j + run + step]:
        run += len(left)
        step *= 2
    while step > 1:
        step //= 2
        if (left := a[i + run : i + run + step]) and left == b[j + run : j + run + step]:
            run += len(left)
    return run


#: Places compared one by one before a run is probed: most runs are short.
SINGLES = 8


def group_ends(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where each group ends in A's and in B's tokens (after its last token), from the increasing ends of the tokens.

    The last ends are equal. Only irregular groups are written down: all other tokens are groups one to one.
    """
    from_a, to_a, from_b, to_b = [], [], [], []
    i = j = 0
    n = len(a)
    while i < n:
        near = min(i + SINGLES, n)
        while i < near and a[i] == b[j]:
            i += 1
            j += 1
        if i == near:
            run = run_length(a, b, i, j)
            i += run
            j += run
            if i == n:
                break
        if (left := a[i]) == (right := b[j]):
            continue
        from_a.append(i)
        from_b.append(j)
        while left != right:
            if left < right:
                i += 1
                left = a[i]
            else:
                j += 1
                right = b[j]
        i += 1
        j += 1
        to_a.append(i)
        to_b.append(j)
    return _but_inside(n, from_a, to_a), _but_inside(len(b), from_b, to_b)


def _but_inside(n: int, starts: list[int], ends: list[int]) -> np.ndarray:
    """1 to n but for the ends of tokens within start to end that are not the last there."""
    inside = np.zeros(n + 1, np.int8)
    np.add.at(inside, np.array(starts, np.int64), 1)
    np.add.at(inside, np.array(ends, np.int64) - 1, -1)
    return np.flatnonzero(np.cumsum(inside[:n], dtype=np.int8) == 0) + 1


class Alignment:
    """Groups and links of a block of texts, whose tokens stand in a row.

    ``bounds_a``, ``bounds_b``: where the tokens of each text begin; ``ends_a``, ``ends_b``: bytes up to each token's end.
    """

    def __init__(self, ends_a: np.ndarray, ends_b: np.ndarray, bounds_a: np.ndarray, bounds_b: np.ndarray):
        self.ends_a, self.ends_b, self.bounds_a, self.bounds_b = ends_a, ends_b, bounds_a, bounds_b
        self.to_a, self.to_b = group_ends(ends_a.tolist(), ends_b.tolist())
        self.from_a, self.from_b = (np.concatenate([[0], x[:-1]]) if len(x) else x for x in (self.to_a, self.to_b))

    def groups(self) -> np.ndarray:
        """Number of groups of each text."""
        return np.diff(np.searchsorted(self.to_a, self.bounds_a, side="right"))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Places in A and in B of all links, in order of A."""
        n_a, n_b = self.to_a - self.from_a, self.to_b - self.from_b
        odd = (n_a > 1) | (n_b > 1)
        # in an irregular group each end, of either, closes a link of the tokens that stand there
        ends = np.union1d(self.ends_a[ranges(self.from_a[odd], n_a[odd])], self.ends_b[ranges(self.from_b[odd], n_b[odd])])
        at_a = np.concatenate([self.from_a[~odd], np.searchsorted(self.ends_a, ends)])
        at_b = np.concatenate([self.from_b[~odd], np.searchsorted(self.ends_b, ends)])
        order = np.argsort(at_a, kind="stable")
        return at_a[order], at_b[order]


class Aligner:
    """Both tokenizers, and the alignments of blocks of texts."""

    #: Tokens written as text at a time.
    CHUNK = 200_000

    def __init__(self, path_a: str | None = None, path_b: str | None = None):
        self.a, self.b = ByteLevel(path_a, plain_specials=True), Pieces(path_b)
        self.segments = SegmentIds(self.a.encode, self.b.encode)
        self.n_b, self.n = len(self.b.token_bytes), max(len(self.a.token_bytes), len(self.b.token_bytes))
        # each id as a decimal number and a mark, for each of the marks
        said = [f"{i}{mark}".encode() for mark in ",|;" for i in range(self.n)]
        self.said, self.said_length = np.frombuffer(b"".join(said), np.uint8), np.array([len(x) for x in said])
        self.said_at = np.cumsum(self.said_length) - self.said_length

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Alignment]:
        """Ids by A, ids by B and their alignment, for the texts that have tokens; the others are empty in it."""
        sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
        (ids_a, from_a), (ids_b, from_b) = self.segments.of(pc.binary_join_element_wise(pa.scalar(" "), texts, ""))
        bad = ids_b == Pieces.BAD
        lengths_a, lengths_b = self.a.byte_lengths[ids_a], self.b.byte_lengths[np.where(bad, 0, ids_b)]
        total = lambda x, at: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
        good = (sizes > 0) & (total(bad, from_b) == 0) & (total(lengths_a, from_a) == sizes + 1) & (total(lengths_b, from_b) == sizes + 1)
        kept = []
        for ids, lengths, at in ((ids_a, lengths_a, from_a), (ids_b, lengths_b, from_b)):
            of_good = np.repeat(good, np.diff(at))
            kept.append((ids[of_good], np.cumsum(lengths[of_good]), np.concatenate([[0], np.cumsum(np.where(good, np.diff(at), 0))])))
        (ids_a, ends_a, bounds_a), (ids_b, ends_b, bounds_b) = kept
        return ids_a, ids_b, Alignment(ends_a, ends_b, bounds_a, bounds_b)

    def texts(self, ids_a: np.ndarray, ids_b: np.ndarray, found: Alignment) -> Iterator[Iterator[bytes]]:
        """For each text its groups as ``a1,a2|b1;a3|b2,b3``, in pieces; none without tokens."""
        marks = np.empty(len(ids_a) + len(ids_b), np.int64)
        group_a, group_b = (np.repeat(np.arange(len(x)), x - y) for x, y in ((found.to_a, found.from_a), (found.to_b, found.from_b)))
        last_a, last_b = (np.zeros(len(x), np.int64) for x in (ids_a, ids_b))
        last_a[found.to_a - 1], last_b[found.to_b - 1] = 1, 2
        marks[np.arange(len(ids_a)) + found.from_b[group_a]] = last_a * self.n + ids_a
        marks[np.arange(len(ids_b)) + found.to_a[group_b]] = last_b * self.n + ids_b
        bounds = (found.bounds_a + found.bounds_b).tolist()
        for start, end in zip(bounds, bounds[1:], strict=False):
            yield self._pieces(marks, start, end)

    def _pieces(self, marks: np.ndarray, start: int, end: int) -> Iterator[bytes]:
        for at in range(start, end, self.CHUNK):
            some = marks[at : min(end, at + self.CHUNK)]
            said = self.said[ranges(self.said_at[some], self.said_length[some])].tobytes()
            yield said if at + self.CHUNK < end else said[:-1]  # no mark after the last group


def token_groups(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, groups): the groups of each text as ``a1,a2|b1;a3|b2,b3`` (empty without tokens)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        for batch in it:
            texts = batch.column(1).fill_null("")
            for a, b in size_blocks(pc.binary_length(texts).to_numpy(), STEP):
                groups = [b"".join(pieces).decode() for pieces in aligner.texts(*aligner.of(texts.slice(a, b - a)))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(groups, pa.string())], names=["doc_id", "groups"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, groups string")


class Block:
    """Results of the documents of a block, and their links packed: of each distinct pair its place in the block's list
    of pairs, the most frequent first, and how often the document has it."""

    FIELDS = ("n_a", "n_b", "n_groups", "n_links")

    def __init__(self):
        self.ids, self.digests, self.numbers = [], [], {f: [] for f in self.FIELDS}
        self.keys, self.times, self.distinct, self.size = [], [], [], 0

    def add(self, aligner: Aligner, doc_ids: pa.Array, texts: pa.Array) -> None:
        self.ids.append(doc_ids)
        self.size += pc.sum(pc.binary_length(texts)).as_py() or 0
        ids_a, ids_b, found = aligner.of(texts)
        for pieces in aligner.texts(ids_a, ids_b, found):
            digest = hashlib.sha256()
            empty = True
            for piece in pieces:
                digest.update(piece)
                empty = False
            self.digests.append("" if empty else digest.hexdigest())
        at_a, at_b = found.links()
        n = len(texts)
        document = np.searchsorted(found.bounds_a, at_a, side="right") - 1
        width = aligner.n_b * aligner.n
        keys, times = np.unique(document * width + ids_a[at_a].astype(np.int64) * aligner.n_b + ids_b[at_b], return_counts=True)
        numbers = np.diff(found.bounds_a), np.diff(found.bounds_b), found.groups(), np.bincount(document, minlength=n)
        for f, v in zip(self.FIELDS, numbers, strict=True):
            self.numbers[f].append(v)
        self.keys.append(keys % width)
        self.times.append(times.astype(np.int32))
        self.distinct.append(np.bincount(keys // width, minlength=n))

    def row(self, number: int) -> pa.RecordBatch:
        pairs, place, documents = np.unique(np.concatenate(self.keys), return_inverse=True, return_counts=True)
        order = np.argsort(-documents, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        packed = zstandard.ZstdCompressor(3).compress(planes(rank[place]) + planes(np.concatenate(self.times)))
        numbers = [pa.array([np.concatenate(self.numbers[f])], pa.list_(pa.int64())) for f in self.FIELDS]
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(self.distinct))])
        ids = pa.concat_arrays(self.ids)
        ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        columns = [pa.array([number], pa.int64()), ids, *numbers, pa.array([self.digests], pa.list_(pa.string())), pa.array([bounds], pa.list_(pa.int64())), pa.array([packed], pa.binary())]
        columns += [pa.array([pairs[order]], pa.list_(pa.int64())), pa.array([documents[order]], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["block", "doc_id", *self.FIELDS, "groups_sha256", "bounds", "links", "pairs", "documents"])


def planes(x: np.ndarray) -> bytes:
    """The four bytes of each 32-bit number apart, which compresses small numbers well."""
    return x.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(packed: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the block's list of pairs, and times."""
    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(2, 4, n)
    rank, times = (np.ascontiguousarray(x.T).view("<i4").reshape(-1).astype(np.int64) for x in both)
    return rank, times


def alignment_statistics(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    ``n_best``: links whose pair of ids is held by as many documents as the best pair of its A id; ``count_sum``: those
    numbers of documents, added over all links; ``groups_sha256``: digest of what ``token_groups`` gives.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block, number = Aligner(path_a, path_b), Block(), TaskContext.get().partitionId() << 32
        for batch in it:
            texts = batch.column(1).fill_null("")
            for a, b in size_blocks(pc.binary_length(texts).to_numpy(), STEP):
                block.add(aligner, batch.column(0).slice(a, b - a), texts.slice(a, b - a))
                if block.size >= BLOCK:
                    yield block.row(number)
                    block, number = Block(), number + 1
        if block.ids:
            yield block.row(number)

    long_lists = ", ".join(f"{f} array<long>" for f in Block.FIELDS)
    schema = f"block long, doc_id array<{kind}>, {long_lists}, groups_sha256 array<string>, bounds array<long>, links binary, pairs array<long>, documents array<long>"
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    blocks = materialize(narrow.mapInArrow(run, schema), "align-blocks")

    n_b = len(Pieces(path_b).pieces)
    pair = F.explode(F.arrays_zip("pairs", "documents"))
    counts = blocks.select(pair.alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.documents").alias("n"))
    by_a = Window.partitionBy(F.expr(f"pair div {n_b}"))  # at most as many rows as B has ids
    counts = counts.select("pair", "n", (F.col("n") == F.max("n").over(by_a)).alias("best"))
    asked = blocks.select(F.col("block").alias("of"), F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(counts, "pair").select("of", "at", "n", "best")

    def weigh(mine: pa.Table, found: pa.Table) -> pa.Table:
        row = mine.to_pylist()[0] if mine.num_rows else None
        if row is None:
            return pa.table({"doc_id": mine["doc_id"].combine_chunks().flatten(), **{f: pa.array([], pa.int64()) for f in (*Block.FIELDS, "n_best", "count_sum")}, "groups_sha256": pa.array([], pa.string())})
        n, best = np.zeros(len(row["pairs"]), np.int64), np.zeros(len(row["pairs"]), np.int64)
        at = found["at"].to_numpy()
        n[at], best[at] = found["n"].to_numpy(), found["best"].to_numpy()
        bounds = np.array(row["bounds"])
        rank, times = unpacked(row["links"], bounds[-1])
        sums = [np.diff(np.concatenate([[0], np.cumsum(x[rank] * times)])[bounds]) for x in (best, n)]
        fields = {f: pa.array(row[f], pa.int64()) for f in Block.FIELDS}
        return pa.table({"doc_id": mine["doc_id"].combine_chunks().flatten(), **fields, "n_best": sums[0], "count_sum": sums[1], "groups_sha256": pa.array(row["groups_sha256"], pa.string())})

    out = ", ".join(f"{f} long" for f in (*Block.FIELDS, "n_best", "count_sum"))
    mine = blocks.drop("documents").groupBy("block")
    return mine.cogroup(answers.groupBy("of")).applyInArrow(weigh, f"doc_id {kind}, {out}, groups_sha256 string")
