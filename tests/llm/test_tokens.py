"""Packing, alignment and fill-in-middle against plain versions, on given and awkward texts."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from symtab.llm import alignment, fim, packing, queries, tokens
from symtab.llm.common import table

os.environ["TOKENIZERS_PARALLELISM"] = "false"
ODD = [
    "  a  b \n\n c\t d", "\n x", " ", "", "a ", "a \n", "x y　\n z", "<|endoftext|> a<|endoftext|>b \x00 \x1c q", "  \n\n\n  \t x  ", "it's 'S don't\n'll  123 456",
    "Straße, über.\nÀß×a ÷ b", ". a.b ... \nx..y", "▁a ▁", "\U0001f600\U0001f600 中文 ́a", "<P>x", "\n", "word​ next﻿ one", "a\r\nb\r\n c", "<s> </s> <unk> <0x0A>",
    "x" * 5000 + " " + "ab" * 3000, "é é. ,, , .a",
]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    plain, special = (Tokenizer.from_file(P.path("byte_bpe_50k.json")) for _ in range(2))
    plain.encode_special_tokens = True
    return plain, special, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def documents(spark):
    long_text = " ".join(f"word{i % 997} tail{i % 31}." for i in range(12_000))
    rows = [(i, t) for i, t in enumerate([*ODD, long_text])] + [(None, "no id here"), (900, None), (901, "twice over"), (901, "twice over")]
    return rows, spark.createDataFrame([(d, t, "x", -1) for d, t in rows], "doc_id long, text string, output string, N int")


def ids_by(make, texts):
    ((ids, bounds),) = tokens.SegmentIds(make).of(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def test_segments_give_the_ids_of_whole_texts(libraries, spark, sf_dir):
    plain, special, pieces = libraries
    texts = ODD + [r.text for r in table(spark, sf_dir, "documents").collect() if r.text]
    assert ids_by(tokens.ByteLevel(plain_specials=True).encode, texts) == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert ids_by(tokens.ByteLevel().encode, texts) == [e.ids for e in special.encode_batch(texts, add_special_tokens=False)]
    found = ids_by(tokens.Pieces().encode, [" " + t if t else "" for t in texts])
    assert all(tokens.Pieces.BAD in x if "▁" in t else x == pieces.encode(t) for t, x in zip(texts, found))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t\r'ab,.1é中　́<|", max_size=25), max_size=5))
def test_segments_of_any_text(libraries, texts):
    plain, _, pieces = libraries
    assert ids_by(tokens.ByteLevel(plain_specials=True).encode, texts) == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert ids_by(tokens.Pieces().encode, [" " + t if t else "" for t in texts]) == [pieces.encode(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 99), st.integers(1, 40), max_size=30))
def test_plan_places_every_piece_once(counts):
    plan = packing.Plan(counts, 100).finished()
    used = defaultdict(list)
    for length, n in counts.items():
        sequence, offset = plan.places(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist()):
            used[s].append((o, length))
    assert set(used) == set(range(plan.sequences))
    for parts in used.values():
        end = 0
        for o, length in sorted(parts):
            assert o == end
            end += length
        assert end <= 100
    # as good as best fit, item by item, after the large ones are matched: never more than plain best-fit decreasing
    gaps = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [g for g in gaps if g >= length]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - length)
            else:
                gaps.append(100 - length)
    assert plan.sequences <= len(gaps)
    assert len(plan.columns.T) <= 4 * 99 * 14


def test_plan_matches_as_many_large_pieces_as_can_be():
    plan = packing.Plan({90: 2, 60: 3, 55: 1, 45: 2, 40: 2, 36: 1, 10: 2}, 100)
    assert plan.sequences == 2 + 4 + 1  # 60+40, 60+40, 60+36, 55+45, 45 alone; tens beside the nineties
    # the number of moves follows the lengths, not the pieces
    few, many = ({i: n for i in range(1, 2048)} for n in (50, 50_000_000))
    assert len(packing.Plan(many).moves) < 1.2 * len(packing.Plan(few).moves) + 100


def check_packed(rows, packed, library, capacity):
    want, got, used = Counter(), Counter(), defaultdict(list)
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or capacity
        starts = [0, *range(first, len(ids), capacity)] if len(ids) > capacity else [0]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[doc_id, k, a, tuple(ids[a:b])] += 1
    for r in packed:
        ids = tuple(np.frombuffer(r.ids, "<u4").tolist())
        assert r.length == len(ids)
        got[r.doc_id, r.piece, r.start, ids] += 1
        used[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for parts in used.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= capacity
    return len(used), -(-sum(len(k[3]) * n for k, n in want.items()) // capacity)


def test_packing(spark, sf_dir, documents, libraries):
    rows, docs = documents
    for capacity in (2048, 64):
        packed = packing.packed_pieces(docs, capacity=capacity)
        n, least = check_packed(rows, packed.collect(), libraries[1], capacity)
        assert n <= least * 1.1 + 1
        sequences = packing.packed_sequences(packed).collect()
        assert len(sequences) == n and sum(s.n_tokens for s in sequences) == sum(len(s.ids) // 4 for s in sequences)
    given_rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    n, least = check_packed(given_rows, packing.packed_pieces(table(spark, sf_dir, "documents")).collect(), libraries[1], 2048)
    assert n <= least + 1
    assert packing.packed_pieces(docs.limit(0)).count() == 0


def test_packing_query(spark, sf_dir, libraries):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    out = queries.op11_best_fit_packing(spark, sf_dir)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    for r in out.collect():
        ids = np.array(libraries[1].encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [0], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def brute_alignment(rows, plain, pieces):
    """From byte offsets alone: common ends, overlaps of all pairs, document counts."""
    found, per_doc = [], []
    for _, text in rows:
        a = plain.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        of_b = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
        bytes_of = tokens.ByteLevel().token_bytes if not found else bytes_of  # noqa: F821
        of_a = [bytes_of[i] for i in a]
        if not text or b"".join(of_a) != (" " + text).encode() or b"".join(of_b) != (" " + text).encode():
            found.append(None)
            per_doc.append(Counter())
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in of_a]).tolist(), np.cumsum([len(x) for x in of_b]).tolist()
        groups, links, i, j = [], Counter(), 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append((a[i:x], b[j:y]))
            for k in range(i, x):
                for m in range(j, y):
                    if max(ends_a[k] - len(of_a[k]), ends_b[m] - len(of_b[m])) < min(ends_a[k], ends_b[m]):
                        links[a[k], b[m]] += 1
            i, j = x, y
        found.append((len(a), len(b), groups))
        per_doc.append(links)
    counts = Counter(p for links in per_doc for p in links)
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for (doc_id, _), x, links in zip(rows, found, per_doc):
        if x is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in x[2])
        best = sum(n for p, n in links.items() if counts[p] == most[p[0]])
        out.append((doc_id, x[0], x[1], len(x[2]), sum(links.values()), best, sum(n * counts[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_alignment(spark, sf_dir, documents, libraries, monkeypatch):
    plain, _, pieces = libraries
    rows, docs = documents
    rows = [(d, t) for d, t in rows if t is None or len(t) < 100_000]
    docs = docs.filter("text is null or length(text) < 100000")
    want = brute_alignment(rows, plain, pieces)
    assert sorted(map(tuple, alignment.alignment_statistics(docs).collect()), key=repr) == want
    monkeypatch.setattr(alignment, "STEP", 300)
    monkeypatch.setattr(alignment, "BLOCK", 900)  # many blocks a partition
    monkeypatch.setattr(alignment.Aligner, "CHUNK", 7)
    assert sorted(map(tuple, alignment.alignment_statistics(docs).collect()), key=repr) == want
    groups = {hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "" for r in alignment.token_groups(docs).collect()}
    assert groups == {w[-1] for w in want}
    assert alignment.alignment_statistics(docs.limit(0)).count() == 0


def test_alignment_query(spark, sf_dir, libraries):
    plain, _, pieces = libraries
    given_rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    out = queries.op12_diagonal_alignment(spark, sf_dir)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == brute_alignment(given_rows, plain, pieces)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=40), min_size=2, max_size=6))
def test_runs_and_groups_of_any_ends(lengths):
    """Several texts in a row: groups end where both end, links are the overlaps."""
    all_a, all_b, bounds_a, bounds_b, base = [], [], [0], [0], 0
    for a, b in zip(lengths, lengths[1:]):
        total = max(sum(a), sum(b))
        all_a += [base + x for x in sorted({*np.cumsum(a).tolist(), total})]
        all_b += [base + x for x in sorted({*np.cumsum(b).tolist(), total})]
        base += total
        bounds_a.append(len(all_a))
        bounds_b.append(len(all_b))
    found = alignment.Alignment(np.array(all_a), np.array(all_b), np.array(bounds_a), np.array(bounds_b))
    common = sorted(set(all_a) & set(all_b))
    assert found.to_a.tolist() == [all_a.index(x) + 1 for x in common] and found.to_b.tolist() == [all_b.index(x) + 1 for x in common]
    assert found.groups().sum() == len(common)
    want = {(i, j) for i in range(len(all_a)) for j in range(len(all_b)) if max([0, *all_a][i], [0, *all_b][j]) < min(all_a[i], all_b[j])}
    got = list(zip(*(x.tolist() for x in found.links())))
    assert len(got) == len(want) and set(got) == want


def test_a_run_takes_few_comparisons():
    class Counted(list):
        slices = 0

        def __getitem__(self, key):
            Counted.slices += 1
            return list.__getitem__(self, key)

    ends = Counted(range(1, 100_001))
    assert alignment.run_length(ends, list(range(1, 90_001)) + [0] * 10_000, 0, 0) == 90_000
    assert Counted.slices < 40


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab<>PSMé中\U0001f600 ", max_size=40), st.integers())
def test_rotation_restores_any_text(text, doc_id):
    output, n, form, prefix, middle = fim.transform(text.encode(), doc_id, "1")
    assert n == len(text) and fim.restore(output, form).decode() == text
    if form != "plain":
        p, m, s = text[:prefix], text[prefix : prefix + middle], text[prefix + middle :]
        assert output.decode() == (f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}")


def test_rotation_of_long_arrays():
    rng = random.Random(3)
    for n in (0, 1, 7, fim.STEP - 1, 2 * fim.STEP + 1, 5 * fim.STEP + 3):
        x = np.frombuffer(rng.randbytes(n), np.uint8).copy()
        cut = rng.randint(0, n)
        want = np.concatenate([x[cut:], x[:cut]])
        fim.rotate(x, 0, cut, n)
        assert (x == want).all()


def test_fill_in_middle_of_awkward_rows(documents):
    rows, docs = documents
    out = fim.undo(fim.fill_in_middle(docs)).collect()
    assert Counter((r.doc_id, r.restored) for r in out) == Counter((d, t or "") for d, t in rows)
    assert all(r.form == "plain" and r.output == "" for r in out if not r.text)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    assert fim.fill_in_middle(docs).columns == ["doc_id", "text", "output", "n", "form", "prefix_chars", "middle_chars"]
