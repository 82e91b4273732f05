"""Operators 5 and 6 against brute force, and on awkward rows."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from symtab.llm import decontam, jaccard

DOCS = "doc_id long, text string"


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    label = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            label[r] = min(label.get(r, d), d)
    return sorted(((d, len(sets[i]), label.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed=1, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = [rng.choice(vocabulary) for _ in range(70)]
    out = []
    for i in range(n):
        kind = i % 8
        if kind < 3 or not out:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 5, 6, 8, 12, 30, 40, 70, 150, 600]))]
        elif kind == 3:
            words = [rng.choice(vocabulary) for _ in range(30)] + shared
        else:  # a copy with a few changes, so that similarities lie about the threshold
            words = out[rng.randrange(len(out))].split()
            for _ in range(rng.choice([0, 0, 1, 2, max(1, len(words) // 45)])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words = words[: max(1, int(len(words) * rng.uniform(0.8, 1)))]
        out.append(" ".join(words))
    return out


def test_components(spark):
    rows = list(enumerate(corpus())) + [(500, None), (501, ""), (502, " \n\t"), (503, "Some Words only"), (504, "some words ONLY"), (None, "some words only"), (505, "a b c d"), (506, "a b c d e"), (3, "again the same id"), (3, "again the same id")]
    docs = spark.createDataFrame(rows, DOCS)
    got = jaccard.jaccard_components(docs).collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows)


def test_hot_group_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        words[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.component_id for r in got} == {0}


def rows_of(sets, head="c"):
    """A shard's rows of one cell, as the steps of the join get them."""
    tokens = [np.unique(np.array([hash(t) & ((1 << 63) - 1) for t in s], np.uint64)) for s in sets]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
    flat = np.concatenate(tokens)
    points = jaccard.count_points(starts, flat)
    return pd.DataFrame({"cell": head, "block": 0, "part": 0, "role": 2, "sid": [b"%06d" % i for i in range(len(sets))], "n": np.diff(starts), "point": points, "tokens": [t.tobytes() for t in tokens]})


@pytest.mark.parametrize("changed", [9, 17, 30])
def test_rows_grow_with_the_group_and_not_with_its_pairs(changed):
    """Near copies whose similarities to each other lie about and just below the threshold."""
    rng = random.Random(changed)
    for n in (150, 300, 600):
        sets = [{f"t{i}" for i in rng.sample(range(120), 120 - changed)} | {f"x{j}-{k}" for k in range(changed // 3)} for j in range(n)]
        pdf = rows_of(sets)
        assert len(jaccard._candidates(pdf)) <= n
        edges = jaccard._links(pdf)
        assert len(edges) < n
        root = list(range(n))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in edges.itertuples(index=False):
            assert 100 * len(sets[int(a)] & sets[int(b)]) >= 80 * len(sets[int(a)] | sets[int(b)])
            root[find(int(a))] = find(int(b))
        for i in range(0, n, 7):
            for j in range(n):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    assert find(i) == find(j)


def test_cells_beyond_a_block_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 20)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(w if rng.random() > 0.02 else f"x{i}-{k}" for k, w in enumerate(base))) for i in range(130)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows)


def test_sets_short_of_groups_have_an_exact_way(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_SHARE", {})
    monkeypatch.setattr(jaccard, "LATER_SHARE", 0.03)  # far too few
    rows = list(enumerate(corpus(4, 60)))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows)


def test_one_stays_of_each_component(spark):
    texts = corpus(2, 80)
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (0, texts[0])]
    docs = spark.createDataFrame(rows, DOCS).withColumn("jc_key", F.lit(1))
    kept = jaccard.one_per_component(docs)
    assert kept.columns == ["doc_id", "text", "jc_key"]
    want = {c for d, n, c in brute_components(rows) if n} | {900, 901}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert jaccard.one_per_component(docs.limit(0)).count() == 0


def test_tree_finds_all_that_the_bound_leaves():
    rng = np.random.default_rng(0)
    points = rng.poisson(3, (500, 64)).astype(np.uint8)
    queries = points[:40] + rng.poisson(0.2, (40, 64)).astype(np.uint8)
    n, m = points.sum(1, dtype=np.int64), queries.sum(1, dtype=np.int64)
    q, p = jaccard.CountRTree(points, n).search(queries, m)
    overlap = np.minimum(queries[:, None], points[None]).sum(2, dtype=np.int64)
    bound = overlap * 180 >= 80 * (m[:, None] + n[None])
    assert set(zip(q.tolist(), p.tolist())) == set(zip(*map(list, map(np.ndarray.tolist, np.nonzero(bound)))))


def test_points_of_different_sizes_bound_the_overlap():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    y = np.concatenate([x[:250], rng.integers(0, 1 << 63, 900, dtype=np.uint64)])
    points = jaccard.count_points(np.array([0, 300, 1450]), np.concatenate([np.sort(x), np.sort(y)]))
    assert [len(p) for p in points] == [512, 2048]
    a, b = jaccard.same_groups(points)
    assert 250 <= np.minimum(a, b).sum() < 300


def brute_leaks(docs, items, threshold=0.8):
    out = []
    for item, it in items:
        w = (it or "").lower().split()
        k = min(5, len(w))
        if not k:
            continue
        wanted = shingles(it, k)
        for d, t in docs:
            words = (t or "").encode().lower().split()
            have = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
            if len(wanted & have) >= threshold * len(wanted) - 1e-9:
                out.append((d, item, len(wanted & have), len(wanted)))
    return sorted(out, key=repr)


def test_containment(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(300)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(words(rng.choice([2, 4, 5, 9, 15, 40, 59])))) for i in range(30)] + [(90, None), (91, ""), (92, "Upper CASE words five six seven")]
    docs = []
    for i in range(150):
        base = words(rng.choice([3, 40, 300, 3000]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            part = items[rng.randrange(30)][1].split()
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = "changed"
            if rng.random() < 0.3:  # in two pieces, far apart
                docs.append((1000 + i, " ".join(part[: len(part) // 2] + base + part[len(part) // 2 - 4 if len(part) > 12 else 0 :])))
            at = rng.randrange(len(base))
            base[at:at] = part
        docs.append((i, " ".join(base)))
    docs += [(None, "upper case words FIVE six seven eight"), (7, None), (8, ""), docs[3], docs[3]]
    got = decontam.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got.collect()), key=repr) == brute_leaks(docs, items)
    frame = spark.createDataFrame(docs, DOCS).withColumn("dc_key", F.lit(0))
    dirty = {(d, t) for d, t in docs if any(x[0] == d for x in brute_leaks([(d, t)], items))}
    clean = decontam.decontaminated(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=repr) == sorted((x for x in docs if x not in dirty), key=repr)


def test_containment_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], DOCS)
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontam.leaks(docs.limit(0), items).count() == 0
    assert decontam.leaks(docs, items.limit(0)).count() == 0
    assert decontam.decontaminated(docs, items.limit(0)).count() == 1
    assert decontam.decontaminated(docs, items).count() == 0


def test_points_that_go_to_cells_are_bounded(spark):
    """Bytes of points in all cells of 12 near copies are linear in the length of the text, and coarse bounds lose no link."""
    rng = random.Random(11)
    sizes = {}
    for n in (1000, 3000, 10_000):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        docs = []
        for i in range(12):
            words = list(base)
            for at in rng.sample(range(n), n // 100):
                words[at] = f"x{i}.{at}"
            docs.append((i, " ".join(words)))
        df = spark.createDataFrame(docs, DOCS)
        sets = [(len(r.keys), len(r.point), r.n) for r in jaccard.described(df, "doc_id", "text").collect()]
        assert all(k <= m // 4 + 1 + m // 4 + 1 and p <= 2 * jaccard.COARSE for k, p, m in sets)
        sizes[n] = sum(k * p for k, p, _ in sets)
        assert {r.component_id for r in jaccard.jaccard_components(df).collect()} == {0}
    assert sizes[10_000] < 2.2 * 10 / 3 * sizes[3000]  # a set whose smallest partner is of the class below posts twice


def test_coarse_points_bound_the_overlap():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 30_000, dtype=np.uint64)
    y = np.concatenate([x[:27_000], rng.integers(0, 1 << 63, 2000, dtype=np.uint64)])
    z = rng.integers(0, 1 << 63, 29_000, dtype=np.uint64)
    starts = np.array([0, 30_000, 59_000, 88_000])
    points = jaccard.count_points(starts, np.concatenate([np.sort(v) for v in (x, y, z)]), jaccard.COARSE)
    a, b, c = jaccard.same_groups(points, np.uint16)
    assert a.sum() == 30_000 and 27_000 <= np.minimum(a, b).sum(dtype=np.int64) and np.minimum(a, c).sum(dtype=np.int64) * 180 < 80 * 59_000
    assert jaccard.close_pairs(points, np.diff(starts), np.array([0, 0, 1]), np.array([1, 2, 2]), np.uint16).tolist() == [True, False, False]
