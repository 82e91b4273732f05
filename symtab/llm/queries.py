"""The registered queries of this subpackage and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symtab.llm import alignment, ann, chat, decontam, fim, html_text, jaccard, mixing, ngram_lm, packing, quality, sharding, toxicity
from symtab.llm.common import table

N_SHARDS = 24


def op1_stratified_interleaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.interleaved_shards(docs, N_SHARDS, tie_col="text_crc32")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.collapse_and_render(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", F.col("n_turns").cast("long"), F.col("same").cast("long"), "text")


def op5_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_fair_queueing_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.fair_mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", F.col("copies").cast("long").alias("copies"))


def op6_count_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op8_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_lm.score_texts(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.packed_pieces(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op12_diagonal_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_statistics(table(spark, sf_dir, "documents"))


def op13_block_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = fim.undo(fim.fill_in_middle(docs, seed="1"))
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{name}_sha256") for c, name in (("output", "output"), ("restored", "restored"))]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES = {f.__name__: f for f in (op1_stratified_interleaving, op2_permutation_index, op3_site_style_tree, op4_snapshot_collapse, op5_containment_search, op6_count_vector_join, op7_fair_queueing_mix, op8_line_crf_quality, op9_factorization_toxicity, op10_backoff_automaton, op11_best_fit_packing, op12_diagonal_alignment, op13_block_rotation)}

#: Words of a text column, lower-cased (A-Z only), in DuckDB.
_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

#: CRC-32 from its polynomial: a table of 256 steps, then one fold over the bytes of each distinct text.
_STEPS = """
steps AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i) AS v FROM range(256) r(i))
)"""
_CRC = _STEPS + """,
crcs AS (
  SELECT text, xor(list_reduce(list_transform(range(octet_length(encode(text))), lambda k: ('0x' || substr(hex(encode(text)), 2 * k + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS crc
  FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents), steps
)"""

ORACLES = {
    "op1_stratified_interleaving": f"""
WITH {_CRC},
d AS (SELECT doc_id, source, octet_length(encode(coalesce(documents.text, ''))) + 8 AS size, crc AS text_crc32,
        md5('7:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents JOIN crcs ON crcs.text = coalesce(documents.text, '')),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, doc_id, text_crc32) AS rk, count(*) OVER (PARTITION BY source) AS n FROM d),
f AS (SELECT *, (2.0::DOUBLE * rk - 1) / (2.0::DOUBLE * n) AS frac FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY frac, source NULLS LAST, k, doc_id, text_crc32) - 1 AS pos, count(*) OVER () AS total FROM f),
s AS (SELECT *, (pos * {N_SHARDS} // total)::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, pos - (shard * total + {N_SHARDS - 1}) // {N_SHARDS} AS slot, NULL::INT AS grown_shard FROM s
""",
    "op4_snapshot_collapse": """
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY n) AS l,
        string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>')
          || '<|im_end|>' || chr(10), '' ORDER BY n) AS text FROM t GROUP BY conv_id),
g AS (SELECT n_turns, l, min(conv_id) AS conv_id, count(*) AS same, min(text) AS text FROM c GROUP BY n_turns, l)
SELECT conv_id, n_turns, same, text FROM g
WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.n_turns > g.n_turns AND c.l[1] = g.l[1] AND c.l[1:g.n_turns] = g.l)
""",
    "op5_containment_search": f"""
WITH i AS (SELECT item_id, w, least(len(w), 5) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
s AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS g FROM i),
n AS (SELECT item_id, count(*) AS n_item FROM s GROUP BY item_id),
d AS (SELECT text, {_WORDS} AS w FROM (SELECT DISTINCT text FROM documents)),
ks AS (SELECT DISTINCT k FROM i),
e AS (SELECT DISTINCT text, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS g FROM d, ks WHERE len(w) >= k),
m AS (SELECT text, item_id, count(*) AS n_shared FROM e JOIN s USING (k, g) GROUP BY text, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM m JOIN n USING (item_id) JOIN documents USING (text) WHERE n_shared >= 0.8::DOUBLE * n_item - 1e-9
""",
    "op6_count_vector_join": f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, min(doc_id) AS first_id, text FROM documents GROUP BY text),
w AS (SELECT id, w, least(len(w), 5) AS k FROM (SELECT id, {_WORDS} AS w FROM d)),
e AS (SELECT id, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' ')))) AS g FROM w WHERE k > 0),
n AS (SELECT id, count(*) AS n FROM e GROUP BY id),
shared AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id),
links AS (SELECT a, b FROM shared JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS id, a AS other FROM sym UNION SELECT reach.id, sym.b FROM reach JOIN sym ON reach.other = sym.a),
comp AS (SELECT reach.id, min(first_id) AS component_id FROM reach JOIN d ON d.id = other GROUP BY reach.id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE coalesce(component_id, first_id) END AS component_id
FROM documents JOIN d ON d.text IS NOT DISTINCT FROM documents.text LEFT JOIN n USING (id) LEFT JOIN comp USING (id)
""",
    "op10_backoff_automaton": f"""
WITH {_STEPS},
ids AS (SELECT s, xor(list_reduce(list_transform(range(octet_length(encode(s))), lambda k: ('0x' || substr(hex(encode(s)), 2 * k + 1, 2))::BIGINT),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % {ngram_lm.FOLDS} = {ngram_lm.HELD_OUT} AS held_out FROM (SELECT DISTINCT coalesce(doc_id::VARCHAR, 'null') AS s FROM documents), steps),
d AS (SELECT row_number() OVER () AS r, doc_id, held_out, list_append({_WORDS}, ' end') AS ws FROM documents JOIN ids ON s = coalesce(doc_id::VARCHAR, 'null')),
x AS (SELECT r, held_out, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
p AS (SELECT r, held_out, w, coalesce(lag(w) OVER y, ' start') AS v, CASE WHEN i > 0 THEN coalesce(lag(w, 2) OVER y, ' start') END AS u FROM x WINDOW y AS (PARTITION BY r ORDER BY i)),
c1 AS (SELECT w, count(*) AS c FROM p WHERE NOT held_out GROUP BY w),
c2 AS (SELECT v, w, count(*) AS c FROM p WHERE NOT held_out GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS c FROM p WHERE NOT held_out AND u IS NOT NULL GROUP BY u, v, w),
n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v, (SELECT count(*) FROM d WHERE NOT held_out) AS texts FROM c1),
states AS (SELECT 1 AS len, c FROM c1 WHERE w <> ' end' UNION ALL SELECT 1, texts FROM n WHERE texts > 0 UNION ALL SELECT 2, c FROM c2 WHERE w <> ' end' AND c >= 2),
once AS (SELECT 1 AS len, count(*) AS once FROM c2 WHERE c = 1 UNION ALL SELECT 2, count(*) FROM c3 JOIN c2 h ON h.v = c3.u AND h.w = c3.v WHERE c3.c = 1 AND h.c >= 2),
g AS (SELECT pow(2.0::DOUBLE, j / 4.0::DOUBLE) AS k FROM range(-24, 65) t(j)),
l AS (SELECT len, k, sum(m * c * (k / (c + k))) AS x FROM (SELECT len, c, count(*) AS m FROM states GROUP BY len, c), g GROUP BY len, k),
b AS (SELECT len, k, x, lead(k) OVER o AS k2, lead(x) OVER o AS x2, min(x) OVER a AS least, max(x) OVER a AS most FROM l WINDOW o AS (PARTITION BY len ORDER BY k), a AS (PARTITION BY len)),
s AS (SELECT len, CASE WHEN once <= least THEN min(k) WHEN once >= most THEN max(k) ELSE max(exp(ln(k) + (ln(once) - ln(x)) * (ln(k2) - ln(k)) / (ln(x2) - ln(x)))) FILTER (x <= once AND x2 > once) END AS k
  FROM b JOIN once USING (len) WHERE once > 0 GROUP BY len, once, least, most),
q AS (SELECT r, coalesce(c1.c, 0) AS c, coalesce(c2.c, 0) AS cc, coalesce(c3.c, 0) AS ccc, CASE WHEN p.v = ' start' THEN texts ELSE coalesce(h1.c, 0) END AS h, coalesce(h2.c, 0) AS hh,
  (coalesce(c1.c, 0) + 0.5::DOUBLE) / (n.n + 0.5::DOUBLE * (n.v + 1)) AS p1,
  {ngram_lm.NOVELTY}::DOUBLE * coalesce((SELECT k FROM s WHERE len = 1), 1.0::DOUBLE) AS k2, {ngram_lm.NOVELTY}::DOUBLE * coalesce((SELECT k FROM s WHERE len = 2), 1.0::DOUBLE) AS k3
  FROM p CROSS JOIN n LEFT JOIN c1 ON c1.w = p.w LEFT JOIN c2 ON c2.v = p.v AND c2.w = p.w LEFT JOIN c3 ON c3.u = p.u AND c3.v = p.v AND c3.w = p.w
  LEFT JOIN c1 h1 ON h1.w = p.v LEFT JOIN c2 h2 ON h2.v = p.u AND h2.w = p.v),
q2 AS (SELECT *, CASE WHEN h > 0 THEN (cc + k2 * p1) / (h + k2) ELSE p1 END AS p2 FROM q),
z AS (SELECT r, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, sum(log10(p1)) AS base_score, sum(log10(CASE WHEN hh >= 2 THEN (ccc + k3 * p2) / (hh + k3) ELSE p2 END)) AS score FROM q2 GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, n.n AS train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score FROM z JOIN d USING (r) CROSS JOIN n
""",
    "op7_fair_queueing_mix": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
             md5('11:' || coalesce(doc_id::VARCHAR, 'null')) AS k, md5(coalesce(text, '')) AS tie FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS src_no FROM d GROUP BY source),
w AS (SELECT *, ((src_no - 1) % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / w AS full_at,
        (sum(source_size) OVER () - (sum(cap) OVER upto - cap)) / (sum(w) OVER () - (sum(w) OVER upto - w)) AS level
      FROM w WINDOW upto AS (ORDER BY cap / w, src_no ROWS UNBOUNDED PRECEDING)),
v AS (SELECT arg_min(level, (full_at, src_no)) AS true_level FROM l WHERE level < full_at),
t AS (SELECT source, src_no, source_size, CASE WHEN full_at <= true_level THEN cap ELSE coalesce(w * true_level, 0.0::DOUBLE) END AS target FROM l, v),
c AS (SELECT d.*, src_no, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, tie, size ROWS UNBOUNDED PRECEDING)::BIGINT AS cum
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
o AS (SELECT c.*, e, (cum + e * source_size) / target AS finish FROM c, range(3) r(e) WHERE size > 0 AND target > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, src_no, k, doc_id::VARCHAR, tie, e ROWS UNBOUNDED PRECEDING) AS upto, (SELECT sum(size) FROM d) AS budget FROM o),
x AS (SELECT doc_id, source, k, tie, cum, count(*) AS copies FROM r WHERE upto <= budget GROUP BY ALL)
SELECT c.doc_id, c.size, c.source_size, c.target, coalesce(x.copies, 0) * c.size AS taken, c.source, coalesce(x.copies, 0) AS copies
FROM c LEFT JOIN x ON c.doc_id IS NOT DISTINCT FROM x.doc_id AND c.source IS NOT DISTINCT FROM x.source AND c.tie = x.tie AND c.cum = x.cum AND c.size > 0
""",
    "op13_block_rotation": """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS x FROM documents),
u AS (SELECT *, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM h),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
o AS (SELECT *, '<P>' || substring(t, 1, a) AS p, '<M>' || substring(t, a + 1, b - a) AS m, '<S>' || substring(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN p || s || m ELSE s || p || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM o
""",
}
