"""The registered queries of this subpackage: one per operator, whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright.llm import (debruijn, idcoder, language, lines, merkle, minhash, negatives, packing, pii, rules, shards,
                             suffixes, winnow)
from scenewright.llm.corpus import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.dedup_substrings(table(spark, sf_dir, "documents"), 20, with_text=False).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_bytes(table(spark, sf_dir, "documents"), 200, with_text=False).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is; executors have it at the same place."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op5_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), 2048, 1)


def op7_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idcoder.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), 2)


def op6_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lines.clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", *(f"cleaning.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op10_surrogate_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_entities")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    drawn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.when(drawn, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    proofs = merkle.manifest(docs, changes={"tampered": {"n_chars": more}})
    folded = merkle.fold(F.col("tampered"), F.col("path"))
    return (proofs.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
                          folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def op12_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard_documents(table(spark, sf_dir, "documents"), 8, carry=["doc_id"])
    return placed.select("row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.quantised(table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved.cast("int")), "vec_id % 50 = 0")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_minhash_near_dedup, op3_suffix_array_dedup,
                                op4_winnowing_decontamination, op5_retrieval_packing, op6_rule_ensemble_quality,
                                op7_token_id_files, op8_line_cleaning, op9_language_id,
                                op10_surrogate_pii, op11_merkle_manifest, op12_histogram_shards, op13_hard_negatives, pipeline)}
SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS rn FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM f WHERE rn > 1),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS x FROM w WHERE len(ws) > 0),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n
  FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
    "op2_minhash_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS k FROM (
  SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
sized AS MATERIALIZED (SELECT doc_id, k, n FROM s JOIN n USING (doc_id)),
links AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM sized a JOIN sized b
  ON a.k = b.k AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, node) AS (SELECT x, y FROM e UNION SELECT r.doc_id, e.y FROM reach r JOIN e ON e.x = r.node),
root AS (SELECT doc_id, min(node) AS m FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
  doc_id <= coalesce(m, doc_id) AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN root USING (doc_id)""",
    "op3_suffix_array_dedup": r"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
-- pieces of 1,000 window starts with the 199 bytes after them
piece AS (SELECT doc_id, b, substr(x, 2 * b + 1, 2398) AS y FROM (
  SELECT doc_id, x, unnest(range(0, len(x) // 2, 1000)) AS b FROM d WHERE len(x) >= 400)),
win AS MATERIALIZED (SELECT doc_id, b + o AS i, md5(substr(y, 2 * o + 1, 400)) AS k FROM (
  SELECT doc_id, b, y, unnest(range(0, least(len(y) // 2 - 199, 1000))) AS o FROM piece WHERE len(y) >= 400)),
often AS MATERIALIZED (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM win SEMI JOIN often USING (k)),
fresh AS (SELECT *, CASE WHEN i - lag(i) OVER w <= 200 THEN 0 ELSE 1 END AS f FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
run AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM fresh),
span AS MATERIALIZED (SELECT doc_id, r, min(i) AS a, max(i) + 200 AS z FROM run GROUP BY ALL),
stop AS (SELECT doc_id, a, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS s FROM span
  UNION ALL SELECT d.doc_id, any_value(len(x)) // 2, coalesce(max(z), 0) FROM d LEFT JOIN span USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * s + 1, 2 * (a - s)), '' ORDER BY s) AS y FROM stop JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed FROM span GROUP BY doc_id)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(y)) AS kept_sha256 FROM d JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op4_winnowing_decontamination": r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM low),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (
  SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i
  FROM b WHERE len(ws) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (
  SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, ns WHERE len(ws) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, k)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY 1)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op8_line_cleaning": rf"""
WITH w AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(t, '{lines.SOLID}+') AS ws,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{lines.SOLID}')) AS ls FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + {lines.WINDOW - 1}], ' ') AS k FROM (
  SELECT doc_id, ws, unnest(range(1, len(ws) - {lines.WINDOW - 2})) AS i FROM w WHERE len(ws) >= {lines.WINDOW})),
often AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
  SELECT doc_id, unnest(range(i, i + {lines.WINDOW})) AS p FROM often WHERE n > 1) GROUP BY 1),
line AS (SELECT DISTINCT doc_id, unnest(ls) AS l FROM w),
parts AS (SELECT *, greatest(len(regexp_split_to_array(trim(l), '{lines.GAP}+')), 1) AS n,
  regexp_extract_all(l, '{lines.SOLID}+') AS lw FROM line),
judged AS (SELECT doc_id, length(regexp_replace(l, '{lines.GAP}', '', 'g')) AS size,
  (len(regexp_extract_all(l, '{lines.SEPARATOR}')) >= 2 AND {lines.WORDS_PER_SEPARATOR} * len(regexp_extract_all(l, '{lines.SEPARATOR}')) >= n) OR 5 * len(regexp_extract_all(l, '{lines.SYMBOLS}')) >= n
  OR 3 * len(regexp_extract_all(l, '{lines.SHOUT}')) >= n
  OR (length(l) >= 20 AND 2 * len(regexp_extract_all(l, '\p{{Lu}}')) > len(regexp_extract_all(l, '\p{{L}}')))
  OR (regexp_matches(l, '{lines.BOILERPLATE}') AND {lines.WORDS_PER_PHRASE} * len(regexp_extract_all(l, '{lines.BOILERPLATE}')) >= n)
  OR 3 * len(list_filter(range(2, len(lw) + 1), lambda i: lw[i] = lw[i - 1])) >= len(lw) AS bad FROM parts),
good AS (SELECT doc_id, sum(size) AS size FROM judged WHERE NOT bad GROUP BY 1),
b AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
  len(regexp_extract_all(t, '{lines.SYMBOLS}')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, coalesce(good.size, 0) AS solid
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN good USING (doc_id)),
f AS (SELECT *, n_words < {lines.MIN_WORDS} OR 100 * n_repeat_words > {lines.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND solid >= {1 - lines.MAX_LOST} * word_chars AS kept FROM f""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE fields AS (SELECT *, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END AS a,
  CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END AS b,
  CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS c,
  CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS e FROM documents),
-- CRC-32 of the decimal id, bit by bit
crc(doc_id, s, i, r) AS (SELECT DISTINCT doc_id, doc_id::VARCHAR, 0, 4294967295::BIGINT FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, s, i + 1, CASE WHEN i % 9 = 0 THEN xor(r, ascii(s[i // 9 + 1])::BIGINT)
    WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END FROM crc WHERE i < 9 * length(s)),
drawn AS (SELECT doc_id FROM crc WHERE i = 9 * length(s) AND xor(r, 4294967295::BIGINT) % 7 = 0),
leaves AS MATERIALIZED (SELECT f.doc_id, coalesce('=' || lang, '') AS g,
  sha256(a || b || c || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || e) AS leaf,
  sha256(a || b || c || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen((n_chars + t)::VARCHAR) || ':' || (n_chars + t) END || e) AS bad
  FROM (SELECT f.*, CASE WHEN d.doc_id IS NULL THEN 0 ELSE 1 END AS t FROM fields f LEFT JOIN drawn d ON d.doc_id = f.doc_id) f),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM leaves),
low(l, g, i, h, n) AS (SELECT 0, g, p, leaf, count(*) OVER (PARTITION BY g) FROM placed
  UNION ALL SELECT l + 1, g, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM low WHERE n > 1 GROUP BY l, g, i // 2),
subroots AS MATERIALIZED (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS p FROM low WHERE n = 1),
high(l, i, h, n) AS (SELECT 0, p, subroot, count(*) OVER () FROM subroots
  UNION ALL SELECT l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM high WHERE n > 1 GROUP BY l, i // 2),
way(doc_id, g, p, l, i, h, x, s) AS (SELECT doc_id, g, p, 0, p, bad, 0, '' FROM placed
  UNION ALL SELECT w.doc_id, w.g, w.p, w.l + 1, w.i // 2, CASE WHEN w.i % 2 = 0 THEN sha256(w.h || coalesce(o.h, '')) ELSE sha256(o.h || w.h) END,
    0, w.s || coalesce(o.h, '') FROM way w JOIN low me ON me.l = w.l AND me.g = w.g AND me.i = w.i AND me.n > 1
    LEFT JOIN low o ON o.l = w.l AND o.g = w.g AND o.i = xor(w.i, 1::BIGINT)),
middle AS MATERIALIZED (SELECT w.*, r.subroot, r.p AS q FROM way w JOIN low me ON me.l = w.l AND me.g = w.g AND me.i = w.i AND me.n = 1
  JOIN subroots r ON r.g = w.g),
up(doc_id, g, p, subroot, l, i, h, s) AS (SELECT doc_id, g, p, subroot, 0, q, h, s FROM middle
  UNION ALL SELECT w.doc_id, w.g, w.p, w.subroot, w.l + 1, w.i // 2,
    CASE WHEN w.i % 2 = 0 THEN sha256(w.h || coalesce(o.h, '')) ELSE sha256(o.h || w.h) END, w.s || coalesce(o.h, '')
  FROM up w JOIN high me ON me.l = w.l AND me.i = w.i AND me.n > 1 LEFT JOIN high o ON o.l = w.l AND o.i = xor(w.i, 1::BIGINT))
SELECT u.doc_id, pl.leaf, u.subroot, r.h AS root, sha256(u.s) AS proof_sha256, u.h AS folded_root, u.h = r.h AS verified
FROM up u JOIN high r ON r.n = 1 AND r.l = u.l JOIN placed pl ON pl.g = u.g AND pl.p = u.p""",
    "op13_hard_negatives": r"""
WITH once AS (SELECT vec_id, min(ROW(label, embedding)) AS r FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL
  AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (r[1] + 1) % 10 ELSE r[1] END AS label,
  list_transform(r[2], lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM once),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
  list_sum(list_transform(range(1, least(len(a.e), len(b.e)) + 1), lambda i: a.e[i] * b.e[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 3""",
}


def queries():
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
