"""Language-model scoring with a weighted backoff automaton (operator 10).

States are word histories of length 0, 1 and 2 that training texts have, those of length 2 from their second occurrence on (what
followed a history once tells about one text, not about the corpus). The arc of word w out of state s bears
log10 P(w | s) of an n-gram seen in training and leads to the longest state that ends what was read. A state without an arc
for w has a failure arc to the state without its first word, which bears log10 of the mass that s leaves to words it has not
seen; arcs of the empty state bear unigram probabilities. A text starts in the state of a start mark, is read left to right
once, and the weights of the arcs taken add up; its end is a token.

Weights: unigrams are those of the base score, P(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)). For a state s of length k,
P(w | s) = (c(s, w) + K_k * P(w | s')) / (c(s) + K_k), s' being s without its first word (smoothing by a Dirichlet prior), so the
failure weight is K_k / (c(s) + K_k), and each state sums to 1 over the V known tokens and the unknown one. K_k is NOVELTY times
the K at which the mass that all states of length k leave to the unseen is what their arcs that were seen once tell (Good and
Turing): the sum of c(s) * K / (c(s) + K) is the number of these. Texts of a corpus have copies and passages in common, so they meet less
that is new in each other than another text would; NOVELTY allows for that.

The automaton of a corpus fits no machine, so it is never in one place. Texts are packed into blocks, written once. A block
asks for each n-gram that it has once, with its own training count of it. Requests go to shards by the hash of the n-gram,
packed as arrays; a shard adds up the counts of all blocks and answers each block in the order of its request. With the answers,
a block builds the part of the automaton that its texts can reach and scores them. All counts are over all training texts
and exact; nothing is pruned or sampled. An n-gram that a third of all tokens are costs a block one request. Blocks and
shards have bounded sizes (a longer text is a block of its own); their numbers grow with the corpus.

Words are as in WORD, A-Z lower-cased. N-grams are known by hashes, which get longer as there are more shards. Defined
results: a null or empty text is its end token alone; a null doc_id counts as the text ``null`` for the fold; repeated rows
are texts of their own; without training texts every token is unknown; no rows give no rows; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from symtab.llm.common import WordHashes, id_remainder_col, materialize, mix, text_blocks, words_of

FOLDS, HELD_OUT = 5, 1
ORDER = 3
#: Characters of the texts of a block, and requests that one shard should have, about.
BLOCK_CHARS, SHARD_REQUESTS = 6_000_000, 2_000_000
#: Occurrences from which on a history of each length from 1 on is a state.
STATE_FROM = (1, 2)
#: How much more a new text meets that is new than the texts of the corpus in each other.
NOVELTY = 4.0
#: Values of K at which shards add up what their states leave to the unseen.
STRENGTHS = [2 ** (i / 4) for i in range(-24, 65)]
#: Bits of an n-gram's hash beyond those that name its shard.
KEY_BITS = 48
#: Levels of compression of texts, and of keys and counts.
TEXT_LEVEL, ARRAY_LEVEL = 6, 1

# words hold no spaces, so these are no word's hashes
START, END = np.uint64(xxhash.xxh3_64_intdigest(b" start")), np.uint64(xxhash.xxh3_64_intdigest(b" end"))
_PAIR, _PAIR2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def token_stream(texts: list[str | None], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, n): hashes of the words and the end of each text, one text after the other, and how many each has."""
    out, n = [], np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        ws = words_of(t)
        n[i] = len(ws) + 1
        out.append(np.fromiter(map(cache.__getitem__, ws), np.uint64, len(ws)))
        out.append(np.array([END]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), n


def longer(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from those of its history and its last word."""
    return mix(mix(history * _PAIR) + word * _PAIR2)


def squeeze(x: np.ndarray) -> bytes:
    """Integers with their first bytes together, then the second ones, and so on, compressed."""
    return zstandard.ZstdCompressor(ARRAY_LEVEL).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def unsqueeze(data: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class Grams:
    """The distinct n-grams of one length in a block, in the order of their keys.

    The first bits of a key name its shard, so a shard's keys follow each other. The last bit tells an n-gram that no text goes on after.
    """

    def __init__(self, hashes: np.ndarray, ends: np.ndarray, at: np.ndarray, shards: int):
        drop = np.uint64(max(0, 64 - KEY_BITS - int(np.log2(shards))))
        keys = (hashes >> drop) & ~np.uint64(1) | ends.astype(np.uint64)
        self.keys, first, self.number = np.unique(keys, return_index=True, return_inverse=True)
        self.where, self.first = at, at[first]  # positions that end an n-gram; one of each
        self.shard = (self.keys << drop >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)

    def cuts(self) -> tuple[np.ndarray, np.ndarray]:
        """(the shards that are asked, where the keys of each begin and the last ones end)."""
        asked, begin = np.unique(self.shard, return_index=True)
        return asked.astype(np.int64), np.append(begin, len(self.keys))


class Block:
    """Tokens of some texts, and their n-grams by length."""

    def __init__(self, texts: list[str | None], cache: WordHashes, shards: int):
        tokens, self.n = token_stream(texts, cache)
        self.first = np.cumsum(self.n) - self.n
        position = np.arange(len(tokens))
        ends, opens = np.zeros(len(tokens), bool), np.zeros(len(tokens), bool)
        ends[self.first + self.n - 1], opens[self.first] = True, True
        self.opens = opens
        hashes, self.grams = tokens, [Grams(tokens, ends, position, shards)]
        before = np.roll(tokens, 1)
        before[opens] = START
        for k in range(2, ORDER + 1):
            hashes = longer(before, tokens)
            there = np.flatnonzero(~opens) if k > 2 else position  # a start mark has nothing before it
            self.grams.append(Grams(hashes[there], ends[there], there, shards))
            before = np.roll(hashes, 1)


def _pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block of texts: ids, fold, lengths in bytes, and the texts one after the other."""
    from pyspark import TaskContext

    task, number = TaskContext.get().partitionId(), 0
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        ids = pa.concat_arrays([h[0] for h in held])
        texts = [t.encode("utf-8", "surrogatepass") for h in held for t in h[2]]
        folds = np.concatenate([np.array(h[1].to_pylist(), bool) for h in held])
        whole = zstandard.ZstdCompressor(TEXT_LEVEL).compress(b"".join(texts))
        return pa.RecordBatch.from_arrays(
            [pa.array([task << 24 | number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([folds.tobytes()], pa.binary()), pa.array([squeeze(np.array([len(t) for t in texts], np.int64))], pa.binary()), pa.array([whole], pa.binary())],
            names=["block", "ids", "folds", "lengths", "texts"],
        )

    for batch in it:
        texts = batch.column(2).to_pylist()
        for a, b in text_blocks(texts, BLOCK_CHARS // 8):
            held.append((batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), texts[a:b]))
            size += sum(map(len, texts[a:b]))
            if size >= BLOCK_CHARS:
                yield flush()
                held, size, number = [], 0, number + 1
    if held:
        yield flush()


def _unpack(lengths: bytes, texts: bytes) -> list[str]:
    ends = np.cumsum(unsqueeze(lengths, np.int64)).tolist()
    texts = zstandard.ZstdDecompressor().decompress(texts)
    return [texts[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _ask(shards: int):
    def ask(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in it:
            for r in range(batch.num_rows):
                number, folds, lengths, texts = (batch.column(c)[r].as_py() for c in (0, 2, 3, 4))
                own = Block(_unpack(lengths, texts), cache, shards)
                learn = np.repeat(~np.frombuffer(folds, bool), own.n)
                for k, g in enumerate(own.grams, 1):
                    counts = np.bincount(g.number[learn[g.where]], minlength=len(g.keys)).astype(np.uint32)
                    asked, cut = g.cuts()
                    parts = list(zip(cut[:-1], cut[1:], strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number] * len(parts), pa.int64()), pa.array([k] * len(parts), pa.int32()), pa.array(asked), pa.array([squeeze(np.diff(g.keys[a:b], prepend=np.uint64(0))) for a, b in parts], pa.binary()), pa.array([squeeze(counts[a:b]) for a, b in parts], pa.binary())],
                        names=["block", "length", "shard", "keys", "counts"],
                    )

    return ask


def left_over(counts: np.ndarray) -> list[float]:
    """What states with these counts leave to the unseen, at each of STRENGTHS."""
    return [float((counts * (k / (counts + k))).sum()) for k in STRENGTHS]


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Adds up a shard's requests; each block gets the totals in the order of its request. The first row bears the shard's own sums."""
    keys = [np.cumsum(unsqueeze(b, np.uint64), dtype=np.uint64) for b in pdf["keys"]]
    cut = np.cumsum([0, *map(len, keys)])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate([unsqueeze(b, np.uint32) for b in pdf["counts"]]), len(distinct)).astype(np.int64)
    seen, histories = total[total > 0], total[(total > 0) & (distinct & np.uint64(1) == 0)]
    length = int(pdf["length"].iloc[0])
    states = histories[histories >= STATE_FROM[length - 1]] if length < ORDER else histories[:0]
    none = [None] * (len(pdf) - 1)
    return pd.DataFrame({
        "block": pdf["block"], "length": pdf["length"], "shard": pdf["shard"], "totals": [squeeze(total[at[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)],
        "types": pd.array([len(seen), *none], "Int64"), "tokens": pd.array([int(seen.sum()), *none], "Int64"), "once": pd.array([int((seen == 1).sum()), *none], "Int64"), "once_histories": pd.array([int((histories == 1).sum()), *none], "Int64"), "left": [left_over(states), *none],
    })


class Weights:
    """Arc and failure weights from counts. ``n``, ``v``: all and distinct training tokens; ``texts``: training texts; ``strength``: K of the states of each length from 1 on."""

    def __init__(self, n: int, v: int, texts: int, strength: list[float]):
        self.n, self.v, self.texts, self.strength = n, v, texts, strength

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))

    def failure(self, length: int, c: np.ndarray) -> np.ndarray:
        k = self.strength[length - 1]
        return np.log10(k / (c + k))

    def arc(self, length: int, c: np.ndarray, cw: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Weight of an arc of a state with count ``c``, for an n-gram with count ``cw`` whose last word weighs ``shorter`` in the state that failure leads to."""
        k = self.strength[length - 1]
        return np.log10((cw + k * 10.0**shorter) / (c + k))


def strength_of(left: np.ndarray, once: int) -> float:
    """The K at which states leave ``once`` to the unseen, between the next of STRENGTHS."""
    if not once or not left[-1]:
        return 1.0
    return float(np.exp(np.interp(np.log(once), np.log(left), np.log(STRENGTHS))))


class Automaton:
    """States, arcs and failure arcs that the texts of a block can reach.

    State 0 is empty, 1 the start mark's; the block's shorter n-grams follow by length, as far as they are seen. The arcs for the n-grams of a length are
    numbered as these; ``to`` is the longest state that ends the n-gram, ``fail`` that without the first word.
    """

    def __init__(self, block: Block, weights: Weights, counts: list[np.ndarray]):
        self.gram = []  # number of the n-gram of each length that ends in a position, or -1
        for g in block.grams:
            self.gram.append(np.full(len(block.opens), -1))
            self.gram[-1][g.where] = g.number
        begin = np.cumsum([2, *(len(c) for c in counts[:-1])])
        self.count = np.concatenate([[0, weights.texts], *counts[:-1]])
        self.length = np.concatenate([[0, 1], *(np.full(len(c), k) for k, c in enumerate(counts[:-1], 1))])
        self.fail = np.zeros(len(self.count), np.int64)
        # the longest state that ends in a position
        self.reached = np.zeros(len(block.opens), np.int64)
        for k, (g, c) in enumerate(zip(block.grams[:-1], counts, strict=False), 1):
            self.fail[begin[k - 1] : begin[k]] = self.reached[g.first]
            seen = c[g.number] >= STATE_FROM[k - 1]
            self.reached[g.where[seen]] = begin[k - 1] + g.number[seen]
        self.fail_weight = np.zeros(len(self.count))
        for k in range(1, ORDER):
            some = self.length == k
            self.fail_weight[some] = weights.failure(k, self.count[some])
        self.seen = [c > 0 for c in counts]
        self.arcs = [weights.unigram(counts[0])]
        before = np.roll(self.reached, 1)
        before[block.opens] = 1 if weights.texts else 0
        self.before = before
        for k in range(2, ORDER + 1):
            g = block.grams[k - 1]
            last = g.first
            state = before[last]
            while (longer_ones := self.length[state] >= k).any():
                state = np.where(longer_ones, self.fail[state], state)
            shorter = self._read(np.where(self.length[state] == k - 1, self.fail[state], state), last)
            self.arcs.append(weights.arc(k - 1, self.count[state], counts[k - 1], shorter))

    def _read(self, state: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Weights of reading the tokens of the positions ``at`` in ``state``: of an arc, or of failure arcs up to a state that has it."""
        total, going, state = np.zeros(len(at)), np.arange(len(at)), state.copy()
        for k in range(len(self.arcs), 0, -1):
            mine = going[self.length[state[going]] == k - 1]
            found = self.gram[k - 1][at[mine]]
            has = (found >= 0) & (self.seen[k - 1][found] | (k == 1))
            total[mine[has]] += self.arcs[k - 1][found[has]]
            failed = mine[~has]
            total[failed] += self.fail_weight[state[failed]]
            state[failed] = self.fail[state[failed]]
            done = np.zeros(len(at), bool)
            done[mine[has]] = True
            going = going[~done[going]]
        return total

    def walk(self) -> np.ndarray:
        """Weight of each token, read in the state that the tokens before it lead to.

        That state is the longest one which ends there, whatever came before, so all positions can be read at once.
        """
        return self._read(self.before, np.arange(len(self.before)))


def _score(weights: Weights, shards: int, kind: pa.DataType):
    schema = pa.schema([("doc_id", kind), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        text_row = t.filter(pa.compute.is_valid(t["texts"]))
        own = Block(_unpack(text_row["lengths"][0].as_py(), text_row["texts"][0].as_py()), WordHashes(), shards)
        counts = []
        for k in range(1, ORDER + 1):
            rows = t.filter(pa.compute.equal(t["length"], k)).sort_by("shard")
            counts.append(np.concatenate([unsqueeze(b, np.int64) for b in rows["totals"].to_pylist()] or [np.zeros(0, np.int64)]))
        automaton = Automaton(own, weights, counts)
        words = own.grams[0].number
        add = lambda x: np.add.reduceat(x, own.first)
        out = [np.frombuffer(text_row["folds"][0].as_py(), bool), own.n, add((counts[0][words] > 0).astype(np.int64)), add(automaton.arcs[0][words]), add(automaton.walk())]
        return pa.table([text_row["ids"].chunk(0).flatten(), *map(pa.array, out)], schema=schema)

    return score


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    kind = docs.schema[id_col].dataType
    name = kind.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), (id_remainder_col(id_col, FOLDS) == HELD_OUT).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chars, texts = rows.agg(F.sum(F.length("text")), F.count_if(~F.col("held_out"))).first()
    # words have about six characters, and a block asks for nearly two n-grams a word
    shards = max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (chars or 0) // (3 * SHARD_REQUESTS))
    packed = materialize(rows.mapInArrow(_pack, f"block long, ids array<{name}>, folds binary, lengths binary, texts binary"), "lm-blocks")
    asked = packed.mapInArrow(_ask(shards), "block long, length int, shard long, keys binary, counts binary")
    answered = asked.groupBy("length", "shard").applyInPandas(_answer, "block long, length int, shard long, totals binary, types long, tokens long, once long, once_histories long, left array<double>")
    answers = materialize(answered, "lm-answers")
    sums = answers.filter("types is not null").groupBy("length").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens"), F.sum("once").alias("once"), F.sum("once_histories").alias("once_histories"), *(F.sum(F.col("left")[i]).alias(f"left{i}") for i in range(len(STRENGTHS))))
    sums = {r.length: r for r in sums.collect()}
    n, v = (sums[1].tokens, sums[1].types) if sums else (0, 0)
    left = [np.array([sums[k][f"left{i}"] for i in range(len(STRENGTHS))]) if k in sums else np.zeros(1) for k in range(1, ORDER)]
    if sums:  # of texts, as many end as start: the start mark's state stands for the end's
        left[0] = left[0] + left_over(np.array([texts]))
    # a history that is no state, for it occurs once, has one arc less that was seen once
    once = [sums[k].once - (sums[k - 1].once_histories if STATE_FROM[k - 2] == 2 else 0) if k in sums else 0 for k in range(2, ORDER + 1)]
    weights = Weights(n, v, texts, [NOVELTY * strength_of(x, k) for x, k in zip(left, once, strict=True)])
    both = packed.unionByName(answers.select("block", "length", "shard", "totals"), allowMissingColumns=True)
    scored = both.groupBy("block").applyInArrow(_score(weights, shards, to_arrow_type(kind)), f"doc_id {name}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(weights.n).cast("long").alias("train_tokens"), "base_score", "score")
