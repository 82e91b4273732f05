"""Operators 1 and 7 against brute force, and on awkward rows."""

import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from symtab.llm import mixing, sharding

DOCS = "doc_id long, text string, source string"


def awkward(spark):
    rows = [(i, f"w{i} " * (i % 7), f"s{i % 3}") for i in range(60)] + [(None, "a b", None), (None, "a b", None), (5, None, "s0"), (6, "", None), (6, "", None), (7, "x " * 500, "tiny")]
    return spark.createDataFrame(rows, DOCS)


def test_interleaving(spark):
    docs = awkward(spark)
    out = sharding.interleaved_shards(docs, 5, tie_col="text").collect()
    assert len(out) == docs.count()
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    by_source = Counter((r.source, r.shard) for r in out)
    totals = Counter(r.source for r in out)
    for (source, _), n in by_source.items():
        assert abs(n - totals[source] / 5) <= 2
    again = sharding.interleaved_shards(docs.repartition(7), 5, tie_col="text").collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))


def test_interleaving_empty_and_clashing_columns(spark):
    docs = awkward(spark)
    assert sharding.interleaved_shards(docs.limit(0), 5).count() == 0
    clash = docs.withColumn("shard", F.lit("mine")).withColumn("PS_KEY", F.lit(1)).withColumn("ps_rank", F.lit(1))
    out = sharding.interleaved_shards(clash, 5)
    assert out.columns == ["doc_id", "text", "source", "PS_KEY", "ps_rank", "shard", "slot"]
    assert out.count() == docs.count()


def brute_mix(rows, weights=(1, 2, 3)):
    """Plain weighted fair queueing; (doc_id, source, text) -> sizes, targets, copies."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(r[1]) for r in rows if r[2] == s) for s in sources}
    w = {s: float(weights[i % len(weights)]) for i, s in enumerate(sources)}
    target, left, open_ = {}, float(sum(total.values())), set(sources)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level >= 3 * total[s]}
        if not full:
            target |= {s: w[s] * level for s in open_}
            break
        target |= {s: 3.0 * total[s] for s in full}
        left -= sum(3.0 * total[s] for s in full)
        open_ -= full
    offers = []
    for no, s in enumerate(sources, 1):
        mine = [(hashlib.md5(f"11:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest(), size(r[1])) for r in rows if r[2] == s]
        cum = 0
        for k in sorted(mine):
            cum += k[4]
            if k[4] and target[s] > 0:
                offers += [((cum + e * total[s]) / target[s], no, k[0], str(k[2]) if k[1] else "", k[3], e, k[4], s) for e in range(3)]
    taken, run = Counter(), 0
    for o in sorted(offers):
        run += o[6]
        if run > sum(total.values()):
            break
        taken[(o[7], o[2], o[4])] += o[6]
    return total, target, taken


def test_mix(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    total, target, taken = brute_mix(rows)
    out = mixing.fair_mix(docs).collect()
    assert len(out) == len(rows)
    got = defaultdict(int)
    for r in out:
        assert r.size == len((r.text or "").split()) and r.source_size == total[r.source]
        assert abs(r.target - target[r.source]) < 1e-6
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        if r.taken:
            got[(r.source, hashlib.md5(f"11:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest(), hashlib.md5((r.text or "").encode()).hexdigest())] += r.taken
    assert got == dict(taken)


def test_mix_empty(spark):
    docs = awkward(spark)
    assert mixing.fair_mix(docs.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "  ", None)], DOCS)
    assert {(r.taken, r.target) for r in mixing.fair_mix(blank).collect()} == {(0, 0.0)}
    clash = docs.withColumn("size", F.lit("x")).withColumn("fq_key", F.lit(1)).withColumn("src", F.lit(2))
    assert mixing.fair_mix(clash).columns == ["doc_id", "text", "source", "fq_key", "src", "size", "source_size", "target", "copies", "taken"]
