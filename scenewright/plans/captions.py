"""Queries of the caption text algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright import fixtures as X
from scenewright.functions import captions as E
from scenewright.functions import tokens as T
from scenewright.games import GAMES, PLATFORMER, PLATFORMER_NEGATED
from scenewright.operators import generation, vocabulary
from scenewright.plans.platformer import caption_with_absence
from scenewright.plans.platformer_sql import captions as platformer_captions

TOPICS = PLATFORMER.topics
# Phrase buckets in matching order; fixed values.
PATTERNS = ["floor", "ceiling", "platform", "rectangular", "irregular", "enem", "ladder", "gold",
            "rope", "chamber", "background area", "diggable ground", "solid ground", "pipe", "coin",
            "tower", "cannon", "staircase", "question block", "loose block", "entrance direction",
            "exit direction", "powerup", "hazard", "water", "dissapearing block"]


def _pairs(*columns):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return X.pairs(spark, sf_dir).select("sample_id", *[c() for c in columns])
    return run


def _flat(column, sep: str = "|"):
    return F.array_join(column, sep, "-")


def split_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.spread(X.table(spark, sf_dir, "documents").select("doc_id", "text"))
    split = docs.select("doc_id", E.split_phrases(F.col("text")).alias("p"),
                        E.split_phrases(F.col("text"), ".,;").alias("w"))
    size = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, p: a + F.length(p))
    return split.select("doc_id", F.size("p").cast("bigint").alias("phrases"),
                        size("p").alias("letters"), F.size("w").cast("bigint").alias("clauses"))


def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = X.pairs(spark, sf_dir).select(F.explode(E.split_phrases(F.col("prompt"))).alias("p"))
    return phrases.groupBy("p", E.normalize_plural(F.col("p")).alias("normal")).agg(
        F.count("*").alias("n"))


def compare_sql(terms: list[str], topics: list[str]) -> str:
    """CTEs ``topics_of(id, side, t, phrase)`` by replaying the claims, and ``judged``."""
    values = ", ".join(f"({i}, '{t}')" for i, t in enumerate(topics))
    n = lambda x: (f"array_to_string(list_transform(regexp_split_to_array(replace({x}, 'enemies', 'enemy'), "  # noqa: E731
                   f"'\\s+'), lambda w: CASE WHEN w LIKE '%s' AND w NOT LIKE '%ss' "
                   f"THEN left(w, length(w)-1) ELSE w END), ' ')")
    idx = lambda x: "CASE " + " ".join(
        f"WHEN contains({x}, '{t}') THEN {i}" for i, t in enumerate(terms)) + " END"
    return f""",
tp AS (SELECT * FROM (VALUES {values}) v(t, topic)),
claim AS (
  SELECT id, side, -1 AS t, list_filter(list_transform(string_split(caption, '.'), lambda p: trim(p)),
    lambda p: p <> '') AS phrases, []::VARCHAR[] AS claimed, NULL::VARCHAR AS phrase
  FROM fx_text WHERE side IN ('p','g','k')
  UNION ALL
  SELECT id, side, t, phrases, CASE WHEN m IS NULL OR lower(m) LIKE 'no %' THEN claimed
      ELSE list_append(claimed, m) END, CASE WHEN lower(m) LIKE 'no %' THEN NULL ELSE m END
  FROM (SELECT c.id, c.side, tp.t, c.phrases, c.claimed, list_filter(c.phrases, lambda p:
      contains(p, tp.topic) AND NOT list_contains(c.claimed, p))[1] AS m
    FROM claim c JOIN tp ON tp.t = c.t + 1)),
topics_of AS (
  SELECT id, side, t, phrase, {n('phrase')} AS normal FROM claim WHERE t >= 0),
quantified AS (SELECT *, {idx('normal')} AS qi FROM topics_of),
judged AS (
  SELECT a.id AS sample_id, a.t, a.phrase AS pa, b.phrase AS pb, CASE
    WHEN a.phrase IS NULL AND b.phrase IS NULL THEN 1.0::DOUBLE
    WHEN a.phrase IS NULL OR b.phrase IS NULL THEN -1.0
    WHEN a.normal = b.normal THEN 1.0
    WHEN a.qi IS NOT NULL AND b.qi IS NOT NULL THEN 1.0 - abs(a.qi - b.qi) / {float(len(terms) - 1)}::DOUBLE
    ELSE 0.1 END AS score, a.normal = b.normal AS same
  FROM quantified a JOIN quantified b ON a.id = b.id AND a.t = b.t AND a.side = 'p' AND b.side = 'g'),
scored AS (
  SELECT sample_id, sum(score) / {len(topics)} AS score, count(*) FILTER (same) AS exact,
    count(*) FILTER (pa IS NOT NULL AND pb IS NOT NULL AND NOT same) AS partial,
    count(*) FILTER (pa IS NULL AND pb IS NOT NULL) AS excess
  FROM judged GROUP BY sample_id)
"""


PAIRS = "WITH RECURSIVE " + X.PAIRS_SQL
COMPARE = PAIRS + compare_sql(PLATFORMER.quantity_terms, TOPICS)


def _score_query(game_name: str):
    game = GAMES[game_name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        judged = X.pairs(spark, sf_dir).withColumn(
            "j", E.compare_captions(F.col("prompt"), F.col("generated"), game))
        return judged.select("sample_id", F.round("j.score", 9).alias("score"),
                             *[F.size(f"j.{k}").cast("bigint").alias(k)
                               for k in ("exact", "partial", "excess")])
    return run


def topic_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = X.pairs(spark, sf_dir).select(
        (E.topic_key(F.col("prompt")) == E.topic_key(F.col("generated"))).alias("equal_keys"),
        (E.caption_score(F.col("prompt"), F.col("generated")) == 1.0).alias("perfect"))
    return keyed.groupBy("equal_keys", "perfect").agg(F.count("*").alias("n"))


def positive_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = E.split_positive_negative(F.col("caption"), drop_upside_down=True)
    return caption_with_absence(spark, sf_dir).withColumn("x", parts).select(
        "scene_id", "x.positive", "x.negative", F.col("x.problem").isNotNull().alias("unusable"))


def negative_of_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    cap = F.concat(F.array_join(F.filter(E.split_phrases(F.col("prompt")), lambda p: ~p.contains(
        "no ")), ". "), F.lit("."))
    return X.pairs(spark, sf_dir).withColumn("x", E.split_positive_negative(cap)).select(
        "sample_id", "x.positive", "x.negative")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = X.pairs(spark, sf_dir).select(
        F.explode(E.split_phrases(F.col("prompt"))).alias("phrase")).distinct()
    return phrases.select("phrase", E.bucket_phrase(F.col("phrase"), PATTERNS).alias("bucket"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.spread(X.table(spark, sf_dir, "documents").select("text"))
    return docs.select(F.explode(T.tokenize(F.col("text"))).alias("token")).groupBy("token").agg(
        F.count("*").alias("n"))


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.spread(X.table(spark, sf_dir, "documents").select("text"))
    return vocabulary.build_vocab(docs, "text", min_freq=2)


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.spread(X.table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = vocabulary.encode(docs, vocabulary.build_vocab(docs, "text"), "doc_id", "text")
    padded = T.pad_ids(F.col("ids"), 64)
    return ids.select("doc_id", F.size("ids").cast("bigint").alias("n"),
                      F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"),
                      F.array_join(padded, " ").alias("padded"))


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.spread(X.table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = vocabulary.build_vocab(docs, "text")
    back = vocabulary.decode(vocabulary.encode(docs, words, "doc_id", "text"), words, "doc_id", "ids")
    return back.select("doc_id", F.md5(F.col("decoded").cast("binary")).alias("digest"))


def longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.pairs(spark, sf_dir).agg(E.max_length(F.col("prompt")).cast("bigint").alias("length"))


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    cap = T.mask_tokens(T.tokenize(F.col("prompt")), F.col("sample_id"), 7)
    return X.pairs(spark, sf_dir).select("sample_id", F.array_join(cap, " ").alias("masked"))


def permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = X.pairs(spark, sf_dir).withColumn(
        "orders", E.permute_phrases(F.col("prompt"), F.col("sample_id")))
    return made.select("sample_id", F.posexplode("orders").alias("k", "caption"))


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("draw"))
    return generation.generate_captions(ids, "draw", PLATFORMER, seed=512, absence=False)


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = list(PLATFORMER.phrases)
    return X.pairs(spark, sf_dir).select(
        "sample_id", _flat(E.phrase_topics(F.col("prompt"), topics)).alias("topics"),
        E.is_valid_caption(F.col("prompt"), topics).alias("valid"))


def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("entrance direction "), F.split("prompt", " ")[0],
                    F.lit(". exit direction up. "), F.col("prompt"))
    return X.pairs(spark, sf_dir).select(
        "sample_id", E.entrance_direction(said).alias("entrance"))


_P = "list_filter(list_transform(string_split({0}, '.'), lambda p: trim(p)), lambda p: p <> '')"
_ABSENT = {"rectangular": "rectangular block clusters", "irregular": "irregular block clusters",
           "ceiling": "ceiling", "floor": "floor", "enem": "enemies"}
_absence_values = ", ".join(f"({i}, '{t}', 'no {_ABSENT.get(t, t + 's')}')"
                            for i, t in enumerate(TOPICS) if "broken" not in t)


def _negated(expr: str) -> str:
    for old, new in PLATFORMER_NEGATED:
        expr = f"replace({expr}, '{old}', '{new}')"
    return expr


_first = lambda values, p: f"list_filter([{', '.join(repr(v) for v in values)}], lambda t: contains({p}, t))[1]"
_unit = lambda key: f"CAST(CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"
TOKENS_SQL = r"""regexp_extract_all(lower({0}), '([\p{L}\p{N}_]+|[.,]|\[mask\]|\[pad\])', 1)"""
VOCAB_SQL = """vocab AS (
  SELECT '[PAD]' AS token, 0 AS id UNION ALL SELECT '[MASK]', 1 UNION ALL
  SELECT token, 1 + row_number() OVER (ORDER BY encode(token)) FROM (
    SELECT token FROM (SELECT unnest(""" + TOKENS_SQL.replace("{0}", "text") + """) AS token FROM documents)
    GROUP BY token HAVING count(*) >= {min}))"""
ENCODED_SQL = "WITH " + VOCAB_SQL.replace("{min}", "1") + """,
tok AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS i
  FROM (SELECT doc_id, """ + TOKENS_SQL.replace("{0}", "text") + """ AS t FROM documents))
"""
_topic_list = "[" + ", ".join(f"'{t}'" for t in TOPICS) + "]"
_dedupe = f"""
ph AS (SELECT sample_id, unnest(p) AS p, generate_subscripts(p, 1) AS i
  FROM (SELECT sample_id, {_P.format("prompt || ' ' || generated")} AS p FROM fx_pairs)),
kk AS (SELECT *, coalesce('t:' || {_first(TOPICS, 'lower(p)')}, 'p:' || lower(p)) AS k,
  lower(p) LIKE 'no %' AS neg FROM ph),
ch AS (SELECT sample_id, k, min(i) AS at, coalesce(min_by(p, i) FILTER (NOT neg), min_by(p, i)) AS p
  FROM kk GROUP BY sample_id, k)
SELECT f.sample_id, coalesce(string_agg(ch.p, '. ' ORDER BY ch.at), '') || '.' AS deduped
FROM fx_pairs f LEFT JOIN ch USING (sample_id) GROUP BY f.sample_id"""

QUERIES = {
    "e01_split_phrases": (split_phrases, """
WITH s AS (SELECT doc_id,
  list_filter(list_transform(string_split(text, '.'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') AS p,
  list_filter(list_transform(regexp_split_to_array(text, '[.,;]'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') AS w
  FROM documents)
SELECT doc_id, len(p) AS phrases, coalesce(list_sum(list_transform(p, lambda x: length(x))), 0)::BIGINT AS letters,
  len(w) AS clauses FROM s"""),
    "e02_extract_topics": (
        _pairs(lambda: _flat(E.extract_topics(F.col("prompt"), TOPICS)).alias("topics")),
        COMPARE + """SELECT id AS sample_id, string_agg(coalesce(phrase, '-'), '|' ORDER BY t) AS topics
FROM topics_of WHERE side = 'p' GROUP BY id"""),
    "e03_normalize_plural": (normalize, COMPARE + """
SELECT p, array_to_string(list_transform(string_split(replace(p, 'enemies', 'enemy'), ' '), lambda w:
  CASE WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w)-1) ELSE w END), ' ') AS normal, count(*) AS n
FROM (SELECT unnest(phrases) AS p FROM claim WHERE t = -1 AND side = 'p') GROUP BY p"""),
    "e04_quantity_score": (
        _pairs(lambda: F.round(E.quantity_score(F.col("prompt"), F.col("generated"),
                                                PLATFORMER.quantity_terms), 9).alias("score")),
        PAIRS + """, qq AS (SELECT sample_id,
  """ + ", ".join("CASE " + " ".join(f"WHEN contains({c}, '{t}') THEN {i}" for i, t in enumerate(
            PLATFORMER.quantity_terms)) + f" END AS {c[0]}" for c in ("prompt", "generated")) + """ FROM fx_pairs)
SELECT sample_id, CASE WHEN p IS NULL OR g IS NULL THEN 0.1 ELSE 1 - abs(p-g)/4.0::DOUBLE END AS score FROM qq"""),
    "e05_compare_captions": (_score_query("platformer"), COMPARE + """
SELECT sample_id, round(score, 9) AS score, exact, partial, excess FROM scored"""),
    "e05_compare_captions_ladder": (
        _score_query("ladder"),
        PAIRS + compare_sql(GAMES["ladder"].quantity_terms, GAMES["ladder"].topics) + """
SELECT sample_id, round(score, 9) AS score, exact, partial, excess FROM scored"""),
    "e05_compare_captions_directional": (
        _score_query("directional"),
        PAIRS + compare_sql(GAMES["directional"].quantity_terms, GAMES["directional"].topics) + """
SELECT sample_id, round(score, 9) AS score, exact, partial, excess FROM scored"""),
    "e07_topic_key": (topic_keys, COMPARE + """
SELECT score = 1.0 AS equal_keys, score = 1.0 AS perfect, count(*) AS n FROM scored GROUP BY 1, 2"""),
    "e08_append_absence": (
        _pairs(lambda: E.append_absence(F.col("prompt")).alias("appended")),
        PAIRS + f""", ab AS (SELECT * FROM (VALUES {_absence_values}) v(o, topic, said)),
wd AS (SELECT sample_id, unnest(string_split(replace(lower(prompt), '.', ' '), ' ')) AS w FROM fx_pairs),
hit AS (SELECT DISTINCT sample_id, topic FROM wd JOIN ab ON starts_with(w, topic)),
mis AS (SELECT f.sample_id, string_agg(said, '. ' ORDER BY o) AS m FROM fx_pairs f, ab
  WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.sample_id = f.sample_id AND h.topic = ab.topic) GROUP BY 1)
SELECT sample_id, CASE WHEN m IS NULL THEN prompt ELSE rtrim(prompt, ' .') || '. ' || m || '.' END AS appended
FROM fx_pairs LEFT JOIN mis USING (sample_id)"""),
    "e09_split_positive_negative": (positive_negative, platformer_captions(True) + f""",
pc AS (SELECT *, {_P.format('caption')} AS p FROM captions)
SELECT scene_id, CASE WHEN len(p) = 16 THEN coalesce(array_to_string(list_filter(p, lambda x: NOT contains(x, 'no ')), '. '), '') || '.'
    ELSE '' END AS positive,
  CASE WHEN len(p) = 16 THEN replace(replace(array_to_string(list_transform(list_filter(p, lambda x: contains(x, 'no ')),
    lambda x: replace(x, 'no ', '')), '. ') || '.', ' upside down pipes.', ''), 'upside down pipes. ', '') ELSE '' END AS negative,
  len(p) <> 16 AS unusable FROM pc"""),
    "e09_negative_topics": (negative_of_positive, PAIRS + f""",
pp AS (SELECT sample_id, array_to_string(list_filter({_P.format('prompt')}, lambda x: NOT contains(x, 'no ')), '. ') || '.' AS c FROM fx_pairs)
SELECT sample_id, c AS positive, """ + _negated(
        f"(array_to_string(list_filter({_topic_list}, lambda t: NOT contains(c, t)), '. ') || '.')") + """ AS negative
FROM pp"""),
    "e10_dedupe_phrases": (
        _pairs(lambda: E.dedupe_phrases(F.concat_ws(" ", "prompt", "generated"), TOPICS).alias(
            "deduped")),
        PAIRS + "," + _dedupe),
    "e11_shuffle_phrases": (
        _pairs(lambda: E.shuffle_phrases(F.col("prompt"), F.col("sample_id"), 3).alias("shuffled")),
        PAIRS + f""", u AS (SELECT sample_id, unnest({_P.format('prompt')}) AS p FROM fx_pairs)
SELECT f.sample_id, coalesce(string_agg(p, '. ' ORDER BY md5('3:' || f.sample_id || ':' || p), p), '') || '.' AS shuffled
FROM fx_pairs f LEFT JOIN u USING (sample_id) GROUP BY f.sample_id"""),
    "e12_permute_phrases": (permutations, PAIRS + f""",
u AS (SELECT sample_id, k, unnest({_P.format('prompt')}) AS p FROM fx_pairs, range(1, 51) t(k)),
o AS (SELECT f.sample_id, t.k, coalesce(string_agg(p, '.' ORDER BY md5(t.k || ':' || f.sample_id || ':' || p), p), '') || '.' AS caption
  FROM fx_pairs f CROSS JOIN range(1, 51) t(k) LEFT JOIN u ON u.sample_id = f.sample_id AND u.k = t.k GROUP BY ALL),
d AS (SELECT sample_id, caption, min(k) AS k FROM o GROUP BY ALL)
SELECT * FROM (SELECT sample_id, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY k) - 1 AS INT) AS k, caption FROM d)
WHERE k < 5"""),
    "e13_generate_captions": (generated, generation.check_sql(PLATFORMER, 512)),
    "e14_parse_caption": (parsed, PAIRS + f""",
g AS (SELECT sample_id, list_transform(list_transform(string_split(trim(prompt, '.'), '.'), lambda p: trim(p)),
  lambda p: {_first(list(PLATFORMER.phrases), 'p')}) AS ts FROM fx_pairs)
SELECT sample_id, array_to_string(list_transform(ts, lambda t: coalesce(t, '-')), '|') AS topics,
  len(list_filter(ts, lambda t: t IS NULL)) = 0 AND len(list_distinct(ts)) = len(ts) AS valid FROM g"""),
    "e15_phrase_catalog": (catalog, PAIRS + f"""
SELECT phrase, coalesce({_first(PATTERNS, 'phrase')}, 'Other') AS bucket
FROM (SELECT DISTINCT unnest({_P.format('prompt')}) AS phrase FROM fx_pairs)"""),
    "e16_pad_phrases": (
        _pairs(lambda: _flat(E.pad_phrases(F.col("prompt"), 20)).alias("padded")),
        PAIRS + f""", p AS (SELECT sample_id, {_P.format('prompt')} AS p FROM fx_pairs)
SELECT sample_id, array_to_string(list_concat(p, list_transform(range(20 - len(p)), lambda x: '')), '|') AS padded FROM p"""),
    "e17_tokenize": (tokens, "SELECT token, count(*) AS n FROM (SELECT unnest(" + TOKENS_SQL.replace(
        "{0}", "text") + ") AS token FROM documents) GROUP BY token"),
    "e18_build_vocab": (vocab, "WITH " + VOCAB_SQL.replace("{min}", "2") +
                        " SELECT token, id FROM vocab"),
    "e19_encode": (encoded, ENCODED_SQL + """
SELECT doc_id, count(*) AS n, sum(id)::BIGINT AS total,
  array_to_string((list_concat(list(id ORDER BY i)[1:64], list_transform(range(greatest(64 - count(*), 0)), lambda x: 0))), ' ') AS padded
FROM tok JOIN vocab USING (token) GROUP BY doc_id"""),
    "e19_decode": (decoded, ENCODED_SQL + """
SELECT doc_id, md5(string_agg(token, ' ' ORDER BY i)) AS digest FROM tok GROUP BY doc_id"""),
    "e20_max_length": (longest, PAIRS + """
SELECT max(len(regexp_split_to_array(trim(replace(prompt, '.', ' .')), '\\s+'))) + 5 AS length FROM fx_pairs"""),
    "e21_mask_tokens": (masked, PAIRS + ", t AS (SELECT sample_id, unnest(x) AS tok, generate_subscripts(x, 1) - 1 AS i FROM (SELECT sample_id, "
                        + TOKENS_SQL.replace("{0}", "prompt") + """ AS x FROM fx_pairs))
SELECT f.sample_id, coalesce(string_agg(CASE WHEN """ + _unit("'7:' || f.sample_id || ':' || i") + """ < 0.15
  THEN '[MASK]' ELSE tok END, ' ' ORDER BY i), '') AS masked FROM fx_pairs f LEFT JOIN t USING (sample_id) GROUP BY 1"""),
    "e22_strip_absence": (
        _pairs(lambda: E.strip_absence(F.col("prompt"), "pipe").alias("stripped")),
        PAIRS + """ SELECT sample_id, trim(replace(replace(replace(replace(replace(replace(prompt, 'no broken pipes', ''),
'no broken pipe', ''), 'no pipes', ''), 'no pipe', ''), 'no upside down pipes', ''), 'no upside down pipe', '')) AS stripped FROM fx_pairs"""),
    "e23_entrance_direction": (directions, PAIRS + """
SELECT sample_id, string_split(string_split(prompt, ' ')[1], '.')[1] AS entrance FROM fx_pairs"""),
}
