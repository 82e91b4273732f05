"""The pipeline's stages, each against a plain version on its own input, and the llm queries against their oracles."""

import os
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
from comparing import assert_same  # noqa: E402
from test_pairs import brute_components, brute_leaks  # noqa: E402
from test_sharding_mixing import brute_mix  # noqa: E402

import corpus_pipeline  # noqa: E402
from symtab.llm import queries  # noqa: E402
from symtab.llm.common import materialize, table  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, sf_dir, duck, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLES[name])


def test_each_stage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = materialize(stage(spark, docs, sf_dir), name)
        results[name] = before, [tuple(r) for r in docs.collect()]
        assert docs.columns[: len(columns)] == columns
    at = {c: i for i, c in enumerate(columns)}
    pair = lambda rows: [(r[at["doc_id"]], r[at["text"]]) for r in rows]
    # quality: good documents stay
    before, after = results["quality"]
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    kept = {r[0] for r in after}
    good = [d for d, _ in pair(before) if labels.get(d) == 1]
    bad = [d for d, _ in pair(before) if labels.get(d) == 0]
    assert sum(d in kept for d in good) >= 0.97 * len(good) and sum(d in kept for d in bad) <= 0.1 * len(bad)
    # near duplicates: the smallest id of each component
    before, after = results["near_duplicates"]
    assert sorted(d for d, _ in pair(after)) == sorted({c for _, n, c in brute_components(pair(before)) if n} | {d for d, t in pair(before) if not (t or "").split()})
    # decontamination
    before, after = results["decontamination"]
    dirty = {x[0] for x in brute_leaks(pair(before), [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()])}
    assert sorted(d for d, _ in pair(after)) == sorted(d for d, _ in pair(before) if d not in dirty)
    # mixing: words taken of each source
    before, after = results["mixing"]
    words = lambda rows: Counter({s: sum(len(t.split()) for t, x in ((r[at["text"]], r[at["source"]]) for r in rows) if x == s) for s in {r[at["source"]] for r in rows}})
    _, _, taken = brute_mix([(r[at["doc_id"]], r[at["text"]], r[at["source"]]) for r in before])
    want = Counter()
    for (source, *_), n in taken.items():
        want[source] += n
    assert words(after) == want
    # sharding: every row once
    before, after = results["sharding"]
    assert Counter(r[: len(columns)] for r in after) == Counter(before)
    assert len({r[len(columns) :] for r in after}) == len(after)


def test_empty_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        assert docs.count() == 0
