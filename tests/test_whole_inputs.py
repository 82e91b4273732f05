"""Registered queries run over whole inputs, not over prefixes or subsets of them."""

from symtab.plans import registry


def test_folds_read_whole_texts(spark, tmp_path):
    long = "first line of fifteen and more\nsecond \U0001f600 line\n" + "tail " * 500
    rows = [(1, 0, "user", long), (1, 1, "assistant", "X" * 40 + "\nmore \U0001f680"), (1, 2, "user", "end of the edits of this one"), (2, 0, "user", long), (2, 1, "system", long[::-1])]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = {}
    for c, turn, role, text in rows:
        if turn == 0 or role == "system":
            want[c] = f"{text}\n{text}"
            continue
        units = want.get(c, "").encode("utf-16-le")  # columns count these, two bytes each
        start = units.index("\n".encode("utf-16-le")) + 2 if turn % 2 else 0
        want[c] = (units[: start + 2 * turn] + text.encode("utf-16-le") + units[start + 2 * (turn + 2) :]).decode("utf-16-le")
    for name in ("sym61_fold_edits", "sym62_document_lifecycle"):
        assert {r.uri: r.content for r in registry.QUERIES[name](spark, str(tmp_path)).collect()} == want
