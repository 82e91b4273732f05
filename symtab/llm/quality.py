"""Quality classifier: a linear-chain conditional random field over the lines of a document (operator 8).

Every line is good or bad. The unary score of a line comes from thermometer-coded ratios (symbols, table bars, capitals,
digits, ...) of the line and of its two neighbours and from whether the document repeats the line; pair weights tie
neighbouring labels. Forward-backward gives each line's marginal, and the document's score is their mean, weighted by the
lines' lengths. The weights maximise the likelihood of the label sequences (each line bears its document's label) on at
most SAMPLE labelled documents outside the held-out fold; that bound is the only one, all documents are scored whole.

Defined results: a null or empty text is one empty line; repeated rows score alike; no labelled rows give a model that
scores everything 0.5; other columns pass through; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from symtab.llm.common import fresh, id_remainder_col, text_blocks
from symtab.llm.training import FOLDS, HELD_OUT, labelled_sample

#: At most this many labelled documents are fitted on.
SAMPLE = 6000
STEPS, RATE, L2 = 150, 0.15, 1e-3

#: Thermometer thresholds by quantity (shares of the line's characters; words and characters; share of its words that it has had before).
THRESHOLDS = {
    "symbol": (0.02, 0.05, 0.08, 0.12, 0.2, 0.3),
    "bar": (0.005, 0.02, 0.05, 0.1),
    "upper": (0.05, 0.1, 0.2, 0.35, 0.6),
    "digit": (0.02, 0.05, 0.1, 0.3),
    "bang": (0.01, 0.05),
    "space": (0.05, 0.1, 0.15, 0.25),
    "word_length": (3, 4, 5, 6, 8, 12),
    "length": (1, 10, 20, 40, 80, 160, 400, 1000),
    "repeats": (0.1, 0.25, 0.4, 0.6, 0.8),
}
N_LINE = sum(map(len, THRESHOLDS.values())) + 1


def _byte_classes() -> np.ndarray:
    """Bit set of each byte: 1 symbol, 2 bar, 4 upper, 8 digit, 16 bang, 32 space, 64 starts a character."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b) if b < 128 else ""
        out[b] = (64 if not 0x80 <= b < 0xC0 else 0) | (32 if c.isspace() else 0) | (8 if c.isdigit() else 0) | (4 if "A" <= c <= "Z" else 0)
        if c and not c.isalnum() and not c.isspace() and c not in ".,'":
            out[b] |= 1 | (2 if c == "|" else 0) | (16 if c == "!" else 0)
    return out


_CLASSES = _byte_classes()


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, document of each line, length of each line in characters)."""
    data = [(t or "").encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    joined = np.frombuffer(b"".join(data), np.uint8)
    ends = np.flatnonzero(joined == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    doc = np.searchsorted(np.cumsum([len(d) for d in data]), starts, side="right")
    bits = _CLASSES[joined]
    bits[ends] = 0

    def count(bit: int) -> np.ndarray:
        return np.add.reduceat((bits & bit) != 0, starts, dtype=np.int32).astype(np.float64)

    length = count(64)
    n = np.maximum(length, 1)
    space = count(32)
    quantity = {"symbol": count(1) / n, "bar": count(2) / n, "upper": count(4) / n, "digit": count(8) / n, "bang": count(16) / n, "space": space / n, "word_length": length / (space + 1), "length": length}
    raw = joined.tobytes()
    said = [raw[a:b].split() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    n_words = np.maximum(np.fromiter(map(len, said), np.float64, len(said)), 1)
    quantity["repeats"] = 1 - np.maximum(np.fromiter((len(set(ws)) for ws in said), np.float64, len(said)), 1) / n_words
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    order = np.lexsort((hashes, doc))
    same = (hashes[order][1:] == hashes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    again = np.zeros(len(starts), bool)
    again[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    columns = [quantity[k] >= t for k, ts in THRESHOLDS.items() for t in ts]
    columns.append(again & (length > 0))
    return np.stack(columns, 1).astype(np.float32), doc, length


class LineField:
    """Weights of the chain: bias, own, previous and next line's features for label 1 (label 0 scores 0), and a 2 x 2 table."""

    def __init__(self, weights: np.ndarray | None = None):
        self.w = np.zeros(1 + 3 * N_LINE + 4) if weights is None else weights

    def unary(self, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
        own, before, after = (x @ self.w[1 + i * N_LINE : 1 + (i + 1) * N_LINE].astype(np.float32) for i in range(3))
        u = self.w[0] + own.astype(np.float64)
        same = doc[1:] == doc[:-1]
        u[1:] += np.where(same, before[:-1], 0)
        u[:-1] += np.where(same, after[1:], 0)
        return u

    def marginals(self, u: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(P(label 1) of each line, summed pair marginals, sum of log Z), all documents of the block at once."""
        head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        length = np.diff(np.concatenate([head, [len(doc)]]))
        by = np.argsort(-length, kind="stable")
        head, length = head[by], length[by]
        alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")  # documents with at least t lines
        table = self.w[-4:].reshape(2, 2)
        phi = np.stack([np.zeros(len(u)), u], 1)
        fwd, bwd = np.empty_like(phi), np.zeros_like(phi)
        fwd[head] = phi[head]
        for t in range(1, length[0]):
            at = head[: alive[t]] + t
            a = fwd[at - 1]
            fwd[at] = phi[at] + np.logaddexp(a[:, :1] + table[0], a[:, 1:] + table[1])
        for t in range(length[0] - 2, -1, -1):
            at = head[: alive[t + 1]] + t
            b = bwd[at + 1] + phi[at + 1]
            bwd[at] = np.logaddexp(table[:, 0] + b[:, :1], table[:, 1] + b[:, 1:])
        last = head + length - 1
        z = np.logaddexp(fwd[last, 0], fwd[last, 1])
        z_line = np.empty(len(u))
        z_line[np.repeat(head, length) + _offsets(length)] = np.repeat(z, length)
        p = np.exp(fwd[:, 1] + bwd[:, 1] - z_line)
        inner = np.flatnonzero(doc[1:] == doc[:-1])
        pairs = np.zeros((2, 2))
        if len(inner):
            b = bwd[inner + 1] + phi[inner + 1]
            for i in range(2):
                for j in range(2):
                    pairs[i, j] = np.exp(fwd[inner, i] + table[i, j] + b[:, j] - z_line[inner]).sum()
        return p, pairs, float(z.sum())

    def fit(self, x: np.ndarray, doc: np.ndarray, y: np.ndarray) -> LineField:
        """Adam ascent of the mean log-likelihood of the lines' labels ``y``."""
        inner = np.flatnonzero(doc[1:] == doc[:-1])
        truth = np.zeros((2, 2))
        np.add.at(truth, (y[inner], y[inner + 1]), 1)
        m, v = np.zeros_like(self.w), np.zeros_like(self.w)
        for step in range(1, STEPS + 1):
            p, pairs, _ = self.marginals(self.unary(x, doc), doc)
            r = (y - p).astype(np.float32)
            after, before = np.zeros_like(r), np.zeros_like(r)
            after[inner], before[inner + 1] = r[inner + 1], r[inner]
            # the features of line t act on line t + 1 as "previous" and on t - 1 as "next"
            g = np.concatenate([[r.sum()], r @ x, after @ x, before @ x, (truth - pairs).ravel()]) / len(doc) - L2 * self.w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            self.w = self.w + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x, doc, length = line_features(texts)
        p, _, _ = self.marginals(self.unary(x, doc), doc)
        weight = np.maximum(length, 1e-9)
        return np.clip(np.bincount(doc, p * weight) / np.bincount(doc, weight), 0.0, 1.0)


def _offsets(length: np.ndarray) -> np.ndarray:
    return np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)


def fit_field(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineField:
    """Fits on line features that the executors make; at most SAMPLE documents' features come to the driver."""
    sample = labelled_sample(docs, labels, "quality", SAMPLE, id_col, text_col)

    def features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x, doc, _ = line_features(batch.column(0).to_pylist())
            packed = np.packbits(x.astype(bool), axis=1)
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([packed[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["y", "x"])

    rows = sorted((r.y, bytes(r.x)) for r in sample.mapInArrow(features, "y int, x binary").collect())
    if not rows:
        return LineField()
    width = -(-N_LINE // 8)
    lines = [np.unpackbits(np.frombuffer(x, np.uint8).reshape(-1, width), axis=1)[:, :N_LINE] for _, x in rows]
    n = [len(x) for x in lines]
    return LineField().fit(np.concatenate(lines).astype(np.float32), np.repeat(np.arange(len(rows)), n), np.repeat([y for y, _ in rows], n))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` plus the quality score, 0 to 1."""
    field = fit_field(docs, labels, id_col, text_col)
    docs = docs.drop(*[c for c in docs.columns if c.lower() == score_col.lower()])
    at = docs.columns.index(text_col)

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(at).to_pylist()
            for a, b in text_blocks(texts):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(field.scores(texts[a:b]))], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(score, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    scored = score_quality(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels)
    return scored.select("doc_id", (id_remainder_col("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    (name,) = fresh(docs, "crf_score")
    return score_quality(docs, labels, id_col, text_col, name).filter(F.col(name) >= 0.5).drop(name)
