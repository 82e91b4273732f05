"""Operator 2 against brute force, and on awkward rows."""

import numpy as np
from pyspark.sql import functions as F

from symtab.llm import ann
from symtab.llm.common import table


def brute(rows, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for i, q in enumerate(ids):
        if q % 20 == 0:
            s = x @ x[i]
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
            out[int(q)] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_recall_and_order(spark):
    vectors = table(spark, "/root/testdata/sf0.01", "embeddings")
    want = brute([(r.vec_id, r.embedding) for r in vectors.collect()], 20)
    got = {}
    for r in sorted(ann.nearest(vectors, F.col("vec_id") % 20 == 0).collect()):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hits = [len({v for v, _ in want[q]} & {v for _, v, _ in got[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert found == sorted(found, key=lambda f: (-f[2], f[1])) and q not in {v for _, v, _ in found}


def test_copies_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(0, 60)] + [(100 + i, [0.5, float(i)]) for i in range(3)]
    rows += [(200, None), (220, [0.0, 0.0]), (240, [nan, 1.0]), (260, [inf, 1.0]), (280, [None, 1.0]), (None, [1.0, 1.0]), (300, [1.0, 2.0, 3.0]), (40, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("g", F.lit("clash")).withColumn("q", F.lit(1))
    out = ann.nearest(vectors, F.col("vec_id") % 20 == 0, k=5).collect()
    got = {}
    for r in sorted(out):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == {0, 20, 40, 100}
    assert got[0] == [1, 2, 3, 4, 5] and got[40] == [0, 1, 2, 3, 4] and got[20] == [0, 1, 2, 3, 4]
    assert got[100] == [0, 1, 2, 3, 4]
    assert ann.nearest(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(two, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 2.0)]


def test_blocks_find_what_one_block_finds(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    vectors = table(spark, "/root/testdata/sf0.01", "embeddings")
    want = brute([(r.vec_id, r.embedding) for r in vectors.collect()], 20)
    got = {}
    for r in ann.nearest(vectors, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len({v for v, _ in want[q]} & got[q]) / 20 for q in want]) >= 0.9


def test_share_reranked_does_not_fall_with_the_block():
    for n in (500, 5_000, 8_192, 20_000):
        assert ann.reranked(n, 21) >= ann.SHARE * n
    assert ann.reranked(100, 21) == 84 and ann.reranked(50, 21) == 50


def test_postings_give_the_footrule_distance():
    rng = np.random.default_rng(4)
    points, queries, pivots = rng.normal(size=(300, 16)), rng.normal(size=(5, 16)), rng.normal(size=(60, 16))
    index, asked = ann.InvertedFiles(points, pivots, 12), ann.prefixes(queries, pivots, 12)
    for q, pre in zip(queries, asked):
        assert pre.tolist() == np.argsort(-(pivots @ q))[:12].tolist()
        near = index.near(pre)
        for i, p in enumerate(points):
            rank = {v: r for r, v in enumerate(np.argsort(-(pivots @ p))[:12].tolist())}
            mine = {v: r for r, v in enumerate(pre.tolist())}
            footrule = sum(abs(rank.get(v, 12) - mine.get(v, 12)) for v in rank.keys() | mine.keys())
            assert footrule == 2 * sum(range(1, 13)) - 2 * near[i]


def test_recall_over_full_blocks():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3 * ann.BLOCK, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    queries, pivots = x[rng.choice(len(x), 30, replace=False)], x[rng.choice(len(x), ann.PIVOTS, replace=False)]
    want = [set(np.argsort(-(x @ q))[1:21]) for q in queries]
    got = [[] for _ in queries]
    for b in range(3):
        for i, (rows, scores) in enumerate(ann.search_block(x[b * ann.BLOCK : (b + 1) * ann.BLOCK], queries, pivots, 21)):
            got[i] += zip(-scores, rows + b * ann.BLOCK)
    assert np.mean([len({r for _, r in sorted(g)[1:21]} & w) / 20 for g, w in zip(got, want)]) >= 0.9


def test_recall_where_only_a_share_is_reranked(spark):
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    want = brute([(r.vec_id, r.embedding) for r in vectors.collect()], 20)
    got = {}
    for r in ann.nearest(vectors, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len({v for v, _ in want[q]} & got[q]) / 20 for q in want]) >= 0.9


def test_exact_way(spark):
    vectors = table(spark, "/root/testdata/sf0.001", "embeddings")
    want = brute([(r.vec_id, r.embedding) for r in vectors.collect()], 20)
    got = {}
    for r in sorted(ann.nearest(vectors, F.col("vec_id") % 20 == 0, prefix=ann.PIVOTS, share=1.0).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert all([v for v, _ in got[q]] == [v for v, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12) for q in want)
