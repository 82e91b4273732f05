"""Toxicity by a factorization machine over hashed terms (operator 9).

Terms of a document are its distinct words and the beginnings of its words (inflected and derived insults share one), hashed
into 2 ** BITS slots, and for beginnings also marks that several words of the document, or many for its length, share it. The
logit is a bias, a weight for each slot present and an inner product of the factors of each pair of slots present,
computed in linear time. The pairs let two terms mean together what neither means alone, which an additive model can't.

Fitting uses at most SAMPLE labelled documents outside the held-out fold. Slots that occur with the label no more often
than chance explains (Z_LEAST standard deviations, at least DF_LEAST documents) get no weight by themselves, so that the many words
which occur a few times can't add up in long texts. But two words that say nothing alone get weights and factors too if
they occur together with the label that much more often than chance explains (Z_PAIR); such pairs are looked for among the words of toxic
documents that no slot explains, and beside words that do tell (so that an insult can count for more with a mention). Weights and factors are fitted by Adam with an L2 penalty, weights around a share of each slot's
own log odds.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Defined results: a null or empty text has
no terms and scores by the bias alone; repeated rows score alike; without labelled rows everything scores 0.5; no rows
give no rows; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symtab.llm.common import id_remainder_col, text_blocks
from symtab.llm.training import FOLDS, HELD_OUT, labelled_sample

BITS = 21
#: Lengths of beginnings in bytes; numbers of distinct words that share one, and shares of the distinct words, that are marked.
BEGINNINGS = (4, 5, 6, 7, 8)
SEVERAL, RATES = (2, 3, 4), (0.01, 0.02, 0.04)
#: Marks are slots of their own, at these even distances: odd slots are beginnings and marks.
_MARKS = [i * 0x9E3779B2 for i in (*SEVERAL, *range(11, 11 + len(RATES)))]
FACTORS = 4
#: At most this many labelled documents are fitted on.
SAMPLE = 8000
Z_LEAST, Z_PAIR, DF_LEAST = 6.0, 7.0, 8
#: Words that are paired with as many at a time.
PAIR_BLOCK = 1000
STEPS, RATE, L2 = 400, 0.05, 2e-4
#: Prior weights as shares of the log odds: of beginnings and marks (of which a word has several), of words.
PRIOR = (0.35, 0.9)

_SEPARATE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


class TermSlots(dict):
    """Slots of a word (bytes): its own and those of its beginnings, or of these only the ``wanted``; remembered, and forgotten when full."""

    LIMIT = 200_000

    def __init__(self, wanted: frozenset[int] | None = None):
        super().__init__()
        self.wanted = wanted

    def __missing__(self, word: bytes) -> list[int]:
        if len(self) >= self.LIMIT:
            self.clear()
        own = xxhash.xxh3_64_intdigest(word) >> (65 - BITS) << 1
        # the last bit tells beginnings from words
        out = [own, *(xxhash.xxh3_64_intdigest(word[:k], 1) >> (65 - BITS) << 1 | 1 for k in BEGINNINGS if len(word) > k)]
        if self.wanted is not None:
            out = [slot for slot in out if slot in self.wanted]
        self[word] = out
        return out


def term_slots(text: str | None, cache: TermSlots) -> np.ndarray:
    """Distinct slots of the terms of a text."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().translate(_SEPARATE).split()
    words = set(tokens)
    found = np.fromiter(chain.from_iterable(map(cache.__getitem__, words)), np.int64)
    slots, n = np.unique(found, return_counts=True)
    begun = (slots & 1 == 1) & (n > 1)
    if not begun.any():
        return slots
    many, n = slots[begun], n[begun]
    marks = [many[n >= c] + i for c, i in zip(SEVERAL, _MARKS, strict=False)] + [many[n >= r * len(words)] + i for r, i in zip(RATES, _MARKS[len(SEVERAL) :], strict=True)]
    return np.unique(np.concatenate([slots, *(mark % (1 << BITS) for mark in marks)]))


class FactorMachine:
    """``slots``: sorted slots that have weights; ``w``: bias, then a weight each; ``v``: factors of each."""

    def __init__(self, slots: np.ndarray, w: np.ndarray, v: np.ndarray):
        self.slots, self.w, self.v = slots, w, v

    def logits(self, rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        linear = np.bincount(rows, self.w[1 + at], n) + self.w[0]
        for f in range(self.v.shape[1]):
            x = self.v[at, f]
            linear += 0.5 * (np.bincount(rows, x, n) ** 2 - np.bincount(rows, x * x, n))
        return linear

    def wanted(self) -> frozenset[int]:
        """Slots that have weights or whose marks may have."""
        return frozenset(self.slots.tolist()) | {(slot - mark) % (1 << BITS) for slot in self.slots.tolist() for mark in _MARKS if slot & 1}

    def scores(self, texts: list[str | None], cache: TermSlots) -> np.ndarray:
        found = [term_slots(t, cache) for t in texts]
        rows = np.repeat(np.arange(len(texts)), [len(x) for x in found])
        slots = np.concatenate(found) if found else np.zeros(0, np.int64)
        at = np.searchsorted(self.slots, slots)
        known = np.flatnonzero(self.slots[np.minimum(at, len(self.slots) - 1)] == slots) if len(self.slots) else np.zeros(0, np.int64)
        return 1 / (1 + np.exp(-np.clip(self.logits(rows[known], at[known], len(texts)), -30, 30)))


def telling_pairs(examples: list[tuple[int, np.ndarray]], df: np.ndarray, chosen: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Slots of words that are not ``chosen`` but occur in pairs with the label more often than chance explains.

    All words that are frequent enough in unexplained toxic documents are paired, a block of words with a block at a time.
    """
    strong = chosen[toxic[chosen] > 0.5 * df[chosen]]
    unexplained = [slots for label, slots in examples if label and not np.isin(strong, slots, assume_unique=True).any()]
    if len(unexplained) < DF_LEAST:
        return chosen[:0]
    slots, n = np.unique(np.concatenate(unexplained), return_counts=True)
    y = np.array([label for label, _ in examples], bool)
    share = y.mean()
    least = Z_PAIR**2 * share / max(1 - share, 1e-9)  # labelled documents that a pair must have, were it never without the label
    slots = slots[(slots & 1 == 0) & (n >= DF_LEAST) & (toxic[slots] >= least) & ~np.isin(slots, chosen)]
    telling = np.zeros(len(slots), bool)
    has = lambda some: np.stack([np.isin(some, x, assume_unique=True) for _, x in examples]).astype(np.float32)
    for i in range(0, len(slots), PAIR_BLOCK):
        left = has(slots[i : i + PAIR_BLOCK])
        for j in range(i, len(slots), PAIR_BLOCK):
            right = left if i == j else has(slots[j : j + PAIR_BLOCK])
            with_label = left[y].T @ right[y]
            if i == j:
                np.fill_diagonal(with_label, 0)
            if with_label.max() < least:
                continue
            both = left.T @ right
            z = (with_label - both * share) / np.sqrt(np.maximum(both * share * (1 - share), 1e-9))
            found = (both >= DF_LEAST) & (z >= Z_PAIR)
            telling[i : i + PAIR_BLOCK] |= found.any(axis=1)
            telling[j : j + PAIR_BLOCK] |= found.any(axis=0)
    return slots[telling]


def telling_beside(examples: list[tuple[int, np.ndarray]], df: np.ndarray, chosen: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Slots of words that are not ``chosen`` but change what a chosen word says: beside it the label is more, or less, frequent than
    with the word at large, beyond chance (Z_PAIR). So an insult counts for more beside a mention that says nothing alone."""
    words = chosen[(chosen & 1 == 0) & (toxic[chosen] > 0.2 * df[chosen])]
    found = []
    for word in words.tolist():
        beside = [(label, slots) for label, slots in examples if (at := np.searchsorted(slots, word)) < len(slots) and slots[at] == word]
        share = toxic[word] / df[word]
        slots, of = np.unique(np.concatenate([slots for _, slots in beside]), return_inverse=True)
        n = np.bincount(of)
        labelled = np.bincount(of, np.repeat([label for label, _ in beside], [len(slots) for _, slots in beside]))
        z = (labelled - n * share) / np.sqrt(np.maximum(n * share * (1 - share), 1e-9))
        found.append(slots[(n >= DF_LEAST) & (n < df[word]) & (np.abs(z) >= Z_PAIR) & (slots & 1 == 0)])
    return np.setdiff1d(np.concatenate(found), chosen) if found else chosen[:0]


def fit_machine(examples: list[tuple[int, np.ndarray]]) -> FactorMachine:
    """Fits on (label, distinct slots) examples."""
    none = FactorMachine(np.zeros(0, np.int64), np.zeros(1), np.zeros((0, FACTORS)))
    if not examples:
        return none
    y = np.array([e[0] for e in examples], float)
    share = y.mean()
    none.w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    df, toxic = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    for label, slots in examples:
        df[slots] += 1
        toxic[slots] += label
    z = (toxic - df * share) / np.sqrt(np.maximum(df * share * (1 - share), 1e-9))
    chosen = np.flatnonzero((df >= DF_LEAST) & (np.abs(z) >= Z_LEAST))
    chosen = np.union1d(chosen, np.union1d(telling_pairs(examples, df, chosen, toxic), telling_beside(examples, df, chosen, toxic)))
    if not len(chosen):
        return none
    found = [np.flatnonzero(np.isin(chosen, slots, assume_unique=True)) for _, slots in examples]
    rows, at = np.repeat(np.arange(len(y)), [len(x) for x in found]), np.concatenate(found)
    # prior means: a share of each slot's own log odds, so that words that usually come with others keep weight when alone
    clean = df[chosen] - toxic[chosen]
    odds = np.log((toxic[chosen] + 0.5) / (y.sum() + 1)) - np.log((clean + 0.5) / (len(y) - y.sum() + 1))
    prior = np.concatenate([[0.0], np.where(chosen & 1, *PRIOR) * np.clip(odds, -6, 6)])
    m = FactorMachine(chosen, prior + np.concatenate([none.w, np.zeros(len(chosen))]), np.random.default_rng(5).normal(0, 0.05, (len(chosen), FACTORS)))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (m.w, m.v)]
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(m.logits(rows, at, len(y)), -30, 30)))
        r = (p - y) / len(y)
        gw = np.concatenate([[r.sum()], np.bincount(at, r[rows], len(chosen))])
        gv = np.empty_like(m.v)
        for f in range(FACTORS):
            x = m.v[at, f]
            gv[:, f] = np.bincount(at, r[rows] * (np.bincount(rows, x, len(y))[rows] - x), len(chosen))
        grads = (gw + L2 * (m.w - prior) * (np.arange(len(m.w)) > 0), gv + L2 * m.v)
        new = []
        for p_, g, mo in zip((m.w, m.v), grads, moments, strict=True):
            mo[0], mo[1] = 0.9 * mo[0] + 0.1 * g, 0.99 * mo[1] + 0.01 * g * g
            new.append(p_ - RATE * (mo[0] / (1 - 0.9**step)) / (np.sqrt(mo[1] / (1 - 0.99**step)) + 1e-8))
        m.w, m.v = new
    return m


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> FactorMachine:
    """Fits on term slots that the executors make; at most SAMPLE documents' slots come to the driver."""
    sample = labelled_sample(docs, labels, "toxic", SAMPLE, id_col, text_col)

    def slots(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = TermSlots()
        for batch in it:
            packed = [term_slots(t, cache).astype(np.int32).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(packed, pa.binary())], names=["y", "x"])

    rows = sample.mapInArrow(slots, "y int, x binary").collect()
    return fit_machine([(y, np.frombuffer(x, np.int32)) for y, x in sorted((r.y, bytes(r.x)) for r in rows)])


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; predicted is 1 from a score of 0.7 on."""
    machine = fit_toxicity(docs, labels, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    wanted = machine.wanted()

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = TermSlots(wanted)
        for batch in it:
            texts = batch.column(1).to_pylist()
            scores = [machine.scores(texts[a:b], cache) for a, b in text_blocks(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["doc_id", "score"])

    scored = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", (id_remainder_col("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
