"""N-gram Jaccard join with count vectors and R-trees (operator 6).

Two documents link when the Jaccard similarity of their sets of distinct word shingles is at least PERCENT / 100; a
component is what links connect. The steps:

1. Every text becomes a set of 64-bit shingle hashes, its tokens. Equal sets are one vertex, known by 128 bits.
2. Tokens are hashed into groups. The sets of a linked pair differ in D <= (1 - t) / t * |x| = |x| / 4 tokens at most, x the
   smaller one, so among the first D + 1 groups that are not empty in both is one that they have alike. The hash of (size
   class, group, tokens of the group) of each of these groups is therefore a key on which linked sets meet. The number of
   groups depends on the size class of the smaller set; the larger one also posts under the class below if its partner can
   be there. Keys of several tokens are far more selective than single tokens: a passage that many documents share gives
   keys only where a whole group happens to lie inside it. A set with D groups or fewer (GROUP_SHARE leaves over 7 standard
   deviations) has no such guarantee; for these every token is a group of its own in a second round.
3. The sets of a key are a cell; of cells with the same sets one is kept. Sets are points: token counts in groups, about as
   many groups as tokens, but COARSE at most, so that what goes to the cells is linear in the text. The overlap of two sets is at most the sum of the coordinate minima of their points. In a cell a
   packed R-tree finds the pairs that this bound leaves (a cell of one leaf is compared directly); it hands on which sets
   they connect, a row for each set and never one for each pair.
4. What is connected comes together once more, with its tokens: pairs that an R-tree leaves are verified by their exact
   overlap, in points of as many groups as tokens, until all are verified or already connected, and the edges of a spanning forest of the links are handed on.
5. Components of the forests, by alternating large-star and small-star steps.

An R-tree gives no key to deal work out by; the agreement keys do the dealing, the trees work inside a cell. Cells beyond
BLOCK sets or BLOCK_TOKENS tokens are dealt out as pairs of blocks, each a task's share. Nothing but scalars passes
through the driver. Rows that leave a step grow with the rows that enter it, however alike the sets of a cell are.

Words are as in WORD with A-Z lower-cased, whole texts. Defined results: fewer than SHINGLE words make one shingle of the
whole sequence; no words (or a null text) make the empty set, linked with nothing; component_id is the smallest non-null
doc_id of the component, null if it has none; repeated rows each get a row; no rows give no rows; only the id and text
columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symtab.llm.common import WordHashes, discard, fresh, materialize, mix, text_blocks, words_of

SHINGLE = 5
PERCENT = 80
#: Groups by size class, as a share of the class's upper end (a power of two); below the first class each token is a group.
FIRST_CLASS = 5
GROUP_SHARE = {5: 0.5, 6: 0.4, 7: 0.35, 8: 0.3, 9: 0.28}
LATER_SHARE = 0.27
#: Distinct sets that a task remembers, so that copies go on once, and tokens that one shard of cells should have.
REMEMBERED, SHARD_TOKENS = 1_000_000, 4_000_000
#: Hashes of texts (8 bytes each) that may be broadcast.
BROADCAST_TEXTS = 500_000
#: Sets and tokens of a cell that one task holds; larger cells are dealt out in pairs of blocks.
BLOCK, BLOCK_TOKENS = 2048, 2_000_000
FANOUT = 16
#: Groups of the points that go to the cells of keys, at most: of a set that has many keys, what goes with each is bounded.
COARSE = 2048
#: Queries that go down a tree together, and characters of the texts that are shingled together.
CHUNK, TEXT_CHARS = 64, 1_000_000

_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_sets(texts: list[str | None], cache: WordHashes, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(starts, tokens): distinct shingle hashes of text i, sorted, are tokens[starts[i]:starts[i + 1]]."""
    hashed, lengths = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        ws = words_of(t)
        lengths[i] = len(ws)
        hashed.append(np.fromiter(map(cache.__getitem__, ws), np.uint64, len(ws)))
    flat = np.concatenate(hashed) if hashed else np.zeros(0, np.uint64)
    first = np.concatenate([[0], np.cumsum(lengths)])
    count = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
    doc = np.repeat(np.arange(len(texts)), count)
    at = first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(count)])[:-1], count)
    span = np.minimum(lengths, size)[doc]
    h = span.astype(np.uint64) * _P[4]
    for j in range(size):
        more = j < span
        h = np.where(more, mix((h ^ flat[np.where(more, at + j, 0)]) * _P[j % 5] + _P[(j + 1) % 5]), h) if len(flat) else h
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return np.searchsorted(doc[keep], np.arange(len(texts) + 1)), h[keep]


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum (modulo 2 ** 64) of each run; an empty run sums to 0."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[starts[1:]] - total[starts[:-1]]


def set_ids(starts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """128-bit identity of each set, as two columns."""
    one, two, three = (_sums(mix(tokens * _P[i] + _P[j]), starts) for i, j in ((1, 3), (4, 0), (2, 1)))
    return np.stack([mix(one ^ mix(two * _P[0])), mix(three ^ mix((two + _P[3]) * _P[2]))], 1)


def _slices(x: np.ndarray) -> list[bytes]:
    """Each row of ``x`` as bytes."""
    raw, width = np.ascontiguousarray(x).tobytes(), x.itemsize * int(np.prod(x.shape[1:]))
    return [raw[i : i + width] for i in range(0, len(raw), width)]


def groups_of_class(c: np.ndarray) -> np.ndarray:
    """Number of groups for a size class c (sets with 2 ** c <= n < 2 ** (c + 1)); 0: each token is a group."""
    share = np.array([GROUP_SHARE.get(i, LATER_SHARE) for i in range(64)])[c]
    return np.where(c < FIRST_CLASS, 0, np.floor(share * 2.0 ** (c + 1))).astype(np.uint64)


def agreement_keys(starts: np.ndarray, tokens: np.ndarray, single: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key starts of each set, keys, whether a set has too few groups): a key for each of a set's first groups, under the class of its size and of its smallest partner's.

    ``single``: every token is a group, whatever the size.
    """
    n = np.diff(starts)
    own = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
    least = -(-n * PERCENT // 100)
    partner = np.floor(np.log2(np.maximum(least, 1))).astype(np.int64)
    # all classes of single tokens are one scheme
    own, partner = (np.where(single | (c < FIRST_CLASS), 0, c) for c in (own, partner))
    owner = np.repeat(np.arange(len(n)), n)
    differ = n * (100 - PERCENT) // PERCENT
    groups = np.zeros(len(n), np.int64)
    out_set, out_key = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for scheme, use in ((own, n > 0), (partner, (n > 0) & (partner != own))):
        chosen = use[owner]
        t, s = tokens[chosen], owner[chosen]
        if not len(t):
            continue
        g = groups_of_class(scheme)[s]
        group = np.where(g > 0, ((t >> np.uint64(32)) * g) >> np.uint64(32), t)
        tag = mix(group * _P[0] + scheme[s].astype(np.uint64) * _P[2] + _P[1])
        order = np.lexsort((tag, s))
        t, s, tag = t[order], s[order], tag[order]
        head = np.flatnonzero(np.concatenate([[True], (tag[1:] != tag[:-1]) | (s[1:] != s[:-1])]))
        key, s = mix(np.add.reduceat(mix(t * _P[3] + _P[4]), head) ^ tag[head]), s[head]
        if scheme is own:
            groups = np.bincount(s, minlength=len(n))
        place = np.arange(len(s)) - np.searchsorted(s, s)
        first = place <= differ[s]  # tags order groups alike in all sets
        out_set.append(s[first])
        out_key.append(key[first])
    at, keys = np.concatenate(out_set), np.concatenate(out_key)
    order = np.argsort(at, kind="stable")
    return np.searchsorted(at[order], np.arange(len(n) + 1)), keys[order], (n > 0) & (groups <= differ)


def count_points(starts: np.ndarray, tokens: np.ndarray, most: int | None = None) -> list[bytes]:
    """Token counts of each set in 2 ** k groups (32 at least), 2 ** k the next power of two above its size, a byte each.

    With ``most`` there are no more groups than that, and counts have two bytes: coarser points, whose bound is looser but
    holds, of a size that does not grow with the set.
    """
    n = np.diff(starts)
    dims = np.maximum(32, 2 ** np.ceil(np.log2(np.maximum(n, 1) + 1)).astype(np.int64))
    kind = np.dtype(np.uint16 if most else np.uint8)
    dims = np.minimum(dims, most) if most else dims
    begin = np.concatenate([[0], np.cumsum(dims)])
    owner = np.repeat(np.arange(len(n)), n)
    cell = begin[owner] + (tokens.astype(np.uint64) % dims[owner].astype(np.uint64)).astype(np.int64)
    flat = np.minimum(np.bincount(cell, minlength=begin[-1]), np.iinfo(kind).max).astype(kind).tobytes()
    return [flat[a:b] for a, b in zip((begin[:-1] * kind.itemsize).tolist(), (begin[1:] * kind.itemsize).tolist(), strict=True)]


def same_groups(points: list[bytes], kind: type = np.uint8) -> np.ndarray:
    """Points as rows of one array: finer ones are folded to the number of groups of the coarsest (a power of two divides the others)."""
    arrays = [np.frombuffer(p, kind) for p in points]
    d = min(map(len, arrays))
    out = np.empty((len(points), d), kind)
    for i, x in enumerate(arrays):
        out[i] = x if len(x) == d else np.minimum(x.reshape(-1, d).sum(0, dtype=np.int64), np.iinfo(kind).max)
    return out


class CountRTree:
    """Packed R-tree over count points, bulk-loaded by total and then by the coordinates that vary most.

    A box needs its upper corner and its least total only: for any point p in it, sum(min(q, p)) <= sum(min(q, corner)), and
    a link needs an overlap of at least PERCENT / (100 + PERCENT) of both totals together.
    """

    def __init__(self, points: np.ndarray, totals: np.ndarray):
        spread = np.argsort(-points.var(axis=0))[:2] if len(points) > FANOUT else [0, 1]
        self.order = np.lexsort((points[:, spread[1]], points[:, spread[0]], totals))
        corner, least = points[self.order], totals[self.order]
        self.levels = [(corner, least)]
        while len(corner) > 1:
            cut = np.arange(0, len(corner), FANOUT)
            corner, least = np.maximum.reduceat(corner, cut), np.minimum.reduceat(least, cut)
            self.levels.append((corner, least))

    def search(self, queries: np.ndarray, totals: np.ndarray, wanted=None) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) index pairs that the bound leaves; ``wanted``, of such index arrays, tells which pairs are asked for."""
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        chunk = max(1, 8_000_000 // max(1, queries.shape[1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, least = self.levels[depth]
            if depth == 0 and wanted is not None:
                asked = wanted(q, self.order[node])
                q, node = q[asked], node[asked]
            keep = [np.zeros(0, bool)]
            for i in range(0, len(q), chunk):
                a, b = q[i : i + chunk], node[i : i + chunk]
                overlap = np.minimum(queries[a], corner[b]).sum(1, dtype=np.int64)
                keep.append(overlap * (100 + PERCENT) >= PERCENT * (totals[a] + least[b]))
            keep = np.concatenate(keep)
            q, node = q[keep], node[keep]
            if depth:
                below = len(self.levels[depth - 1][0])
                child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                q = np.repeat(q, FANOUT)
                q, node = q[child < below], child[child < below]
        return q, self.order[node]


def _batches(it: Iterator[pa.RecordBatch], column: str):
    """(batch slice, texts) with a bounded number of characters each."""
    for batch in it:
        texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
        for a, b in text_blocks(texts, TEXT_CHARS):
            yield batch.slice(a, b - a), texts[a:b]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _describe(single: bool):
    """Size, identity, point and keys of each text's set; with ``single`` only identity and keys, of single tokens. Copies in a task bear no keys."""

    def describe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = WordHashes(), set()
        for batch, texts in _batches(it, "text"):
            starts, tokens = shingle_sets(texts, cache)
            ids = set_ids(starts, tokens)
            sids = _slices(ids)
            new = np.array([sid not in seen and not seen.add(sid) for sid in sids], bool)
            if len(seen) > REMEMBERED:
                seen = set()
            cut, keys, short = agreement_keys(starts, tokens, single)
            length = np.diff(cut)
            keys, cut = keys[np.repeat(new, length)], np.concatenate([[0], np.cumsum(length * new)])
            columns = {
                "sid": pa.array(sids, pa.binary()), "v": pa.array(_signed(ids[:, 0].copy())), "n": pa.array(np.diff(starts)),
                "point": pa.array([None] * len(texts) if single else count_points(starts, tokens, COARSE), pa.binary()),
                "keys": pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(_signed(keys))), "short": pa.array(short),
            }
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *columns.values()], names=[*kept, *columns])

    return describe


def _tokens(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache, seen = WordHashes(), set()
    for _, texts in _batches(it, "text"):
        starts, tokens = shingle_sets(texts, cache)
        ids = _slices(set_ids(starts, tokens))
        new = [i for i, sid in enumerate(ids) if sid not in seen and not seen.add(sid)]  # copies in this task go on once
        if len(seen) > REMEMBERED:
            seen = set()
        yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in new], pa.binary()), pa.array([tokens[starts[i] : starts[i + 1]].tobytes() for i in new], pa.binary())], names=["sid", "tokens"])


class Forest:
    """Union-find over 0 .. n - 1; ``edges`` are the pairs that united two parts."""

    def __init__(self, n: int):
        self.up, self.edges = list(range(n)), []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def roots(self, some: np.ndarray) -> np.ndarray:
        return np.fromiter(map(self.root, some.tolist()), np.int64, len(some))

    def unite(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.edges.append((a, b))


def close_pairs(points: list[bytes], totals: np.ndarray, a: np.ndarray, b: np.ndarray, kind: type = np.uint8) -> np.ndarray:
    """Which pairs (a, b) of points the bound leaves, with points of any number of groups."""
    dims = np.array([len(p) // np.dtype(kind).itemsize for p in points])
    flat, begin = np.frombuffer(b"".join(points), kind), np.cumsum(dims) - dims
    swap = dims[a] > dims[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    left = np.zeros(len(a), bool)
    shape = dims[a] << 32 | dims[b]
    for s in np.unique(shape):
        d, e = int(s >> 32), int(s & 0xFFFFFFFF)
        pairs = np.flatnonzero(shape == s)
        for i in range(0, len(pairs), max(1, 4_000_000 // e)):
            p = pairs[i : i + max(1, 4_000_000 // e)]
            x, y = flat[begin[a[p]][:, None] + np.arange(d)], flat[begin[b[p]][:, None] + np.arange(e)]
            if e > d:
                y = np.minimum(y.reshape(len(p), -1, d).sum(1, dtype=np.int64), np.iinfo(kind).max).astype(kind)
            overlap = np.minimum(x, y).sum(1, dtype=np.int64)
            left[p] = overlap * (100 + PERCENT) >= PERCENT * (totals[a[p]] + totals[b[p]])
    return left


def _cells(pdf):
    """(row numbers of each cell of a shard, node of each row: equal sets of a cell are one)."""
    order = pdf.groupby(["cell", "block", "part"], sort=False).ngroup().to_numpy()
    rows = np.argsort(order, kind="stable")
    return np.split(rows, np.flatnonzero(np.diff(order[rows])) + 1)


def _in_trees(rows: np.ndarray, node: np.ndarray, role: np.ndarray, totals: np.ndarray, points: list[bytes], forest: Forest, meet, kind: type = np.uint8) -> None:
    """Sends the pairs of a cell that an R-tree leaves, and that the forest does not connect yet, to ``meet(row, rows)``, query by query."""
    box, ask = rows[role[rows] != 1], rows[role[rows] != 0]
    if not len(box) or not len(ask):
        return
    place = {r: i for i, r in enumerate(rows.tolist())}
    matrix = same_groups([points[r] for r in rows], kind)
    inside = np.array([place[r] for r in box.tolist()])
    tree = CountRTree(matrix[inside], totals[box])
    for i in range(0, len(ask), CHUNK):
        some = ask[i : i + CHUNK]
        mine, theirs = forest.roots(node[some]), forest.roots(node[box])
        q, p = tree.search(matrix[[place[r] for r in some.tolist()]], totals[some], lambda q, p: mine[q] != theirs[p])
        by_query = np.argsort(q, kind="stable")
        q, p = q[by_query], p[by_query]
        for j, found in zip(q[np.flatnonzero(np.diff(q, prepend=-1))].tolist(), np.split(p, np.flatnonzero(np.diff(q)) + 1), strict=False):
            meet(some[j], box[found])


def _candidates(pdf):
    """For each cell of a shard, the sets that the bound connects with another: (least set of what is connected, set).

    Rows of ``role`` 0 are in the tree, of 1 ask, of 2 do both.
    """
    import pandas as pd

    sids, points, totals, role = pdf["sid"].tolist(), pdf["point"].tolist(), pdf["n"].to_numpy(), pdf["role"].to_numpy()
    node = np.arange(len(pdf))
    small_a, small_b, large = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for rows in _cells(pdf):
        if len(rows) <= FANOUT and (role[rows] == 2).all():  # one leaf
            i, j = np.triu_indices(len(rows), 1)
            small_a.append(rows[i])
            small_b.append(rows[j])
        else:
            first = {}
            node[rows] = [first.setdefault(sids[r], r) for r in rows.tolist()]
            large.append(rows)
    a, b = np.concatenate(small_a), np.concatenate(small_b)
    left = close_pairs(points, totals, a, b, np.uint16)
    forest = Forest(len(pdf))
    for x, y in zip(a[left].tolist(), b[left].tolist(), strict=True):
        forest.unite(x, y)

    def meet(row: int, found: np.ndarray) -> None:
        for x in found.tolist():
            forest.unite(int(node[row]), int(node[x]))

    for rows in large:
        _in_trees(rows, node, role, totals, points, forest, meet, np.uint16)
    root = forest.roots(node)
    out = pd.DataFrame({"root": root, "sid": sids}).drop_duplicates()
    sizes = out["root"].map(out["root"].value_counts())
    out = out[sizes > 1]
    out["head"] = out.groupby("root")["sid"].transform("min")
    return out[["head", "sid"]].drop_duplicates()


def _links(pdf):
    """Edges (a, b) of a spanning forest of the links in each cell of a shard, by exact overlaps of the pairs that the bound leaves."""
    import pandas as pd

    sids, totals, role = pdf["sid"].tolist(), pdf["n"].to_numpy(), pdf["role"].to_numpy()
    packed = [np.frombuffer(b, np.uint64) for b in pdf["tokens"]]
    found = []
    for rows in _cells(pdf):
        first: dict[bytes, int] = {}
        node = np.array([first.setdefault(sids[r], i) for i, r in enumerate(rows.tolist())])
        sets = [packed[r] for r in rows.tolist()]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        flat = np.concatenate(sets)
        distinct, number = np.unique(flat, return_inverse=True)
        mark = np.zeros(len(distinct), bool)
        forest, n = Forest(len(rows)), totals[rows]

        def meet(i: int, others: np.ndarray) -> None:
            mark[number[starts[i] : starts[i + 1]]] = True
            for j in others.tolist():
                if forest.root(node[i]) != forest.root(node[j]):
                    overlap = int(np.count_nonzero(mark[number[starts[j] : starts[j + 1]]]))
                    if overlap * (100 + PERCENT) >= PERCENT * (n[i] + n[j]):
                        forest.unite(int(node[i]), int(node[j]))
            mark[number[starts[i] : starts[i + 1]]] = False

        here = np.arange(len(rows))
        if len(rows) == 2:
            meet(0, here[1:])
        else:
            _in_trees(here, node, role[rows], n, count_points(starts, flat), forest, meet)
        found += [(sids[rows[x]], sids[rows[y]]) for x, y in forest.edges]
    return pd.DataFrame(found, columns=["a", "b"]).drop_duplicates()


def components(links: DataFrame) -> DataFrame:
    """(v, root): for each vertex of the links (a, b), the least vertex of its component; alternating star steps.

    Least neighbours are aggregated before the shuffle and joined back, so that a vertex with very many links is no one
    task's work.
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    seen = mark(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        discard(edges)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.col("v"), F.col("u"))).alias("x"), "m").filter("x > m")
        edges = materialize(small.select(F.col("x").alias("u"), F.col("m").alias("v")).distinct(), "small")
        discard(large)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("root"))


def described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tkey, r1, r2, sid, v, n, point, keys, short) of every row: hashes of the text and the row; identity (and its first half), size, point and keys of its shingle set."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tkey"), *(row_key(id_col, text_col, i).alias(f"r{i}") for i in (1, 2)))
    return materialize(rows.mapInArrow(_describe(False), f"doc_id {kind}, tkey long, r1 long, r2 long, {_SET}"), "sets")


_SET = "sid binary, v long, n long, point binary, keys array<bigint>, short boolean"


def row_key(id_col: str, text_col: str, half: int):
    """One half of a 128-bit hash of the id and the text of a row."""
    return F.xxhash64(F.lit(half), F.col(id_col).isNull(), id_col, F.length(text_col), text_col)


def _shards(docs: DataFrame, tokens: int) -> int:
    return max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), tokens // SHARD_TOKENS)


def dealt(cells: DataFrame) -> DataFrame:
    """(cell, sid, n) with the block, part and role of each row: cells that fit a task as they are, larger ones as pairs of blocks, in one of which any two sets meet."""
    large = cells.groupBy("cell").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks")).filter("blocks > 1")
    cells = cells.join(large, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine, other = (F.pmod(F.xxhash64("sid", F.lit(i)), F.col("blocks")).cast("int") for i in (0, 1))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    ways = F.when(F.col("blocks") <= 1, F.array(F.struct(F.lit(0).alias("block"), F.lit(0).alias("part"), F.lit(2).alias("role")))).otherwise(
        F.concat(F.transform(every, lambda i: F.struct(mine.alias("block"), i.alias("part"), F.lit(0).alias("role"))), F.transform(every, lambda i: F.struct(i.alias("block"), other.alias("part"), F.lit(1).alias("role"))))
    )
    return cells.withColumn("way", F.explode(ways)).select("cell", "sid", "n", "way.*")


def meetings(sets: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """(key, v) of the keys that several sets have; with ``again``, sets described anew, of those that a set short of groups has.

    Sets go by the first half of their identity here; two that have it alike meet whom either meets.
    """
    posts = (sets if again is None else again).select("v", F.explode("keys").alias("key"))
    if again is not None:
        short = sets.filter("short").select("sid").distinct()
        asked = again.join(short, "sid", "left_semi").select(F.explode("keys").alias("key")).distinct()
        posts = posts.join(asked, "key", "left_semi")
    several = posts.groupBy("key").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).filter("lo <> hi").select("key")
    return posts.join(materialize(several, "several"), "key", "left_semi").distinct()


def set_roots(docs: DataFrame, sets: DataFrame, text_col: str) -> DataFrame:
    """(sid, root) of the sets that are linked with another set."""
    met = meetings(sets)
    if sets.agg(F.max("short")).first()[0]:
        texts = docs.select(F.col(text_col).alias("text"))
        met = met.unionByName(meetings(sets, materialize(texts.mapInArrow(_describe(True), _SET), "sets-again")))
    met = materialize(met, "meetings")
    # one key for all that have the same sets
    low, high = F.col("v").bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned("v", 33)
    keys = met.groupBy("key").agg(F.count("*").alias("members"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum(low).alias("s1"), F.sum(high).alias("s2"))
    keys = keys.groupBy("members", "lo", "hi", "s1", "s2").agg(F.min("key").alias("key")).select("key")
    all_met, met = met, materialize(met.join(keys, "key", "left_semi"), "distinct-meetings")
    discard(all_met)

    # points of the sets that met others, and a text of each
    points = sets.join(met.select("v").distinct(), "v", "left_semi").groupBy("sid").agg(F.first("v").alias("v"), F.min("tkey").alias("tkey"), F.first("n").alias("n"), F.first("point").alias("point"))
    points = materialize(points, "points")
    cells = materialize(dealt(met.join(points.select("v", "sid", "n"), "v").select(F.col("key").alias("cell"), "sid", "n")), "cells")
    discard(met)
    n_shards = _shards(docs, cells.agg(F.sum("n")).first()[0] or 0)
    shard = lambda n: F.pmod(F.xxhash64("cell", "block", "part"), F.lit(n))
    pointed = cells.join(points.select("sid", "point"), "sid").withColumn("shard", shard(n_shards))
    near = materialize(pointed.groupBy("shard").applyInPandas(_candidates, "head binary, sid binary").distinct(), "candidates")
    discard(cells)

    # tokens of the sets that are candidates, each read again from one text
    sized = near.join(points.select("sid", "n", "tkey"), "sid")
    keys = materialize(sized.select("tkey").distinct(), "keys-of-texts")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_TEXTS else keys
    some = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tkey")).join(keys, "tkey", "left_semi")
    tokens = some.select("text").mapInArrow(_tokens, "sid binary, tokens binary").groupBy("sid").agg(F.first("tokens").alias("tokens"))
    cells = materialize(dealt(sized.select(F.col("head").alias("cell"), "sid", "n")), "groups")
    n_shards = _shards(docs, cells.agg(F.sum("n")).first()[0] or 0)
    links = cells.join(tokens, "sid").withColumn("shard", shard(n_shards)).groupBy("shard").applyInPandas(_links, "a binary, b binary")
    links = materialize(links, "links")
    discard(cells, near)
    out = materialize(components(links).select(F.col("v").alias("sid"), "root"), "roots-of-sets")
    discard(points, links)
    return out


def _rooted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, r1, r2, n, root) of every row; ``root`` is the identity of a set of its component."""
    sets = described(docs, id_col, text_col)
    roots = set_roots(docs, sets, text_col)
    roots = materialize(roots.unionByName(roots.select(F.col("root").alias("sid"), "root")).distinct(), "roots")
    return sets.select("doc_id", "r1", "r2", "n", "sid").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    rooted = _rooted(docs, id_col, text_col)
    label = rooted.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = rooted.filter("n > 0").join(label, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(rooted.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component one row with its smallest id stays; rows without words all stay."""
    # one row for each component: that of the smallest id, then the smallest hash; equal rows have one key
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2")
    keep = _rooted(docs, id_col, text_col).filter("n > 0").groupBy("root").agg(F.min(order).alias("k")).select("k.r1", "k.r2")
    one, two, blank = fresh(docs, "jc_key", "jc_key2", "jc_blank")
    keyed = docs.withColumn(one, row_key(id_col, text_col, 1)).withColumn(two, row_key(id_col, text_col, 2))
    keyed = keyed.withColumn(blank, F.coalesce(~F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(True)))
    keep = materialize(keep.withColumnsRenamed({"r1": one, "r2": two}), "kept")
    first = keyed.filter(~F.col(blank)).join(keep, [one, two], "left_semi").dropDuplicates([one, two])
    return first.unionByName(keyed.filter(F.col(blank))).select(*docs.columns)
