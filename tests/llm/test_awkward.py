"""Every operator and stage on nulls in any column, empty and very long texts, ties, repeated rows and clashing columns."""

import math
import os
import re
import sys
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from test_pairs import brute_components  # noqa: E402
from test_sharding_mixing import brute_mix  # noqa: E402
from test_texts import brute_lm  # noqa: E402

import corpus_pipeline  # noqa: E402
from symtab.llm import chat, decontam, html_text, jaccard, mixing, ngram_lm, quality, sharding, toxicity  # noqa: E402
from symtab.llm.common import materialize, table  # noqa: E402


@pytest.fixture(scope="module")
def awkward(spark):
    long_text = " ".join(f"word{i % 9973} tail{i % 31}." for i in range(60_000))
    rows = [(1, long_text, "en", "a", len(long_text)), (2, None, None, None, None), (None, "no id here at all today", "en", "a", 0), (3, "", "en", None, 0), (4, " \n\t ", "en", "b", 4)]
    rows += [(5, "said twice over and over again", "en", "b", 1)] * 3 + [(6, "said twice over and over again", None, "c", 1)] + [(7 + i, f"plain text number {i} about nothing in particular.\nSecond line {i}.", "en", "abc"[i % 3], 9) for i in range(20)]
    rows += [(90, "ünï çödé \U0001f600 text \x00 with odd   spaces", "xx", "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = {"Score": F.lit("x"), "size": F.lit(1), "shard": F.lit("s"), "block": F.lit(1), "sid": F.lit(2), "tkey": F.lit(3), "root": F.lit(4), "w": F.lit(5), "p": F.lit(6), "h": F.lit(7), "y": F.lit(8), "rkey": F.lit(9)}
    return docs.withColumns(extra)


def test_operators(spark, sf_dir, awkward):
    rows = [tuple(r) for r in awkward.select("doc_id", "text", "source").collect()]
    n, texts = len(rows), [(d, t) for d, t, _ in rows]
    labels = table(spark, sf_dir, "labels").unionByName(spark.createDataFrame([(None, None, None), (5, None, 1)], "doc_id long, quality int, toxic int"))
    items = spark.createDataFrame([(1, "said twice over and over again"), (None, None), (3, "")], "item_id long, text string")
    # shards: as many rows as can be alike, slots without gaps, every row once
    out = sharding.interleaved_shards(awkward, 3, tie_col="text").collect()
    places = sorted((r.shard, r.slot) for r in out)
    assert places == [(s, i) for s in range(3) for i in range(sum(p[0] == s for p in places))]
    assert max(Counter(s for s, _ in places).values()) - min(Counter(s for s, _ in places).values()) <= 1
    assert Counter((r.doc_id, r.text) for r in out) == Counter(texts)
    # mixing: the words of each source, repeated rows alike together
    out = mixing.fair_mix(awkward).collect()
    _, target, taken = brute_mix(rows)
    assert len(out) == n and all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and r.taken == r.copies * r["size"] and r.copies <= 3 for r in out)
    by_source, want = Counter(), Counter()
    for r in out:
        by_source[r.source] += r.taken
    for (source, *_), words in taken.items():
        want[source] += words
    assert +by_source == +want and all(math.isclose(r.target, target[r.source]) for r in out)
    # links, language model and leaks as by brute force
    key = lambda r: (str(r[0]), *map(str, r[1:4]))
    assert sorted(map(tuple, jaccard.jaccard_components(awkward).collect()), key=repr) == brute_components(texts)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ngram_lm.score_texts(awkward).collect()), key=key)
    want = sorted(brute_lm(texts), key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want] and all(math.isclose(x, y, rel_tol=1e-9) for g, w in zip(got, want) for x, y in zip(g[4:], w[4:]))
    assert sorted((r.doc_id, r.item_id, r.containment) for r in decontam.leaks(awkward, items).collect()) == [(5, 1, 1.0)] * 3 + [(6, 1, 1.0)]
    # classifiers: equal texts score alike, for toxicity texts without words as the empty one
    for scored, empty in ((quality.quality_scores, (2, 3)), (toxicity.toxicity_scores, (2, 3, 4))):
        out = scored(awkward, labels).collect()
        assert len(out) == n and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in out)
        held = {r.doc_id: r.held_out for r in out}
        assert all(held[d] == (zlib.crc32(("null" if d is None else str(d)).encode()) % 3 == 1) for d in held)
        of = lambda *ids: {round(r.score, 12) for r in out if r.doc_id in ids}
        assert len(of(5, 6)) == 1 and len(of(*empty)) == 1


def test_very_long_page_and_turn(spark):
    body = "".join(f"<p>line {i} of many</p>" for i in range(40_000))
    pages = spark.createDataFrame([(1, "http://x.example/", f"<body><nav>menu</nav><article>{body}</article></body>"), (2, None, "<p>" + "x" * 3_000_000)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_main_text(pages).collect()}
    assert got[1] == "\n\n".join(f"line {i} of many" for i in range(40_000)) and got[2] == "x" * 3_000_000
    long_turn = "word " * 400_000
    turns = [(c, 0, "user", "hello") for c in range(300)] + [(c, 1, "assistant", f"{c % 7}") for c in range(300)] + [(900, 0, "user", long_turn), (901, 0, "user", long_turn), (901, 1, "assistant", "short")]
    kept = {r.conv_id: r for r in chat.collapse_and_render(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert set(kept) == {*range(7), 901}  # one first turn for all, and a prefix of two million characters
    assert kept[3].same == sum(c % 7 == 3 for c in range(300)) and long_turn in kept[901].text


def test_one_common_host(spark):
    page = lambda i: f"<body><div class='top'><p>Site {i % 2}</p></div><div class='text'><p>page {i}</p></div></body>"
    rows = [(i, "http://hot.example/x" if i % 3 else f"http://h{i}.example/", page(i)) for i in range(900)]
    got = {r.page_id: r.text for r in html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == (f"page {i}" if i % 3 else f"Site {i % 2}\n\npage {i}") for i in got) and len(got) == 900


def test_stages_keep_columns_and_survive(spark, sf_dir, awkward):
    docs = awkward
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, sf_dir), name)
        want = [c for c in docs.columns if name != "sharding" or c.lower() not in ("shard", "slot")] + (["shard", "slot"] if name == "sharding" else [])
        assert out.columns == want
        docs = out
    assert docs.count() > 0


def test_quality_keeps_rows_as_they_are(spark, sf_dir, awkward):
    kept = {tuple(r) for r in quality.good_documents(awkward, table(spark, sf_dir, "labels")).collect()}
    assert kept <= {tuple(r) for r in awkward.collect()}
