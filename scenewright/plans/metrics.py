"""Queries of similarity joins and quality metrics."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright import fixtures as X
from scenewright.functions import grid as G
from scenewright.games import PLATFORMER as P
from scenewright.operators import captioner as C
from scenewright.operators import generation
from scenewright.operators import metrics as M
from scenewright.operators import similarity as S
from scenewright.plans.captions import COMPARE, PAIRS, compare_sql
from scenewright.plans.platformer_sql import captions as platformer_captions

TARGETS = [t for t in P.topics if "broken" not in t]


def _grids(df: DataFrame) -> DataFrame:
    return df.select(F.col("scene_id").alias("id"), F.array_join("rows", "").alias("grid"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grids(X.scenes(spark, sf_dir))


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = X.table(spark, sf_dir, "benchmark").select("item_id", "text")
    return _grids(X.scenes_from_text(items, "platformer", "item_id"))


def nearest_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.min_edit_distance_self(_documents(spark, sf_dir), P).select(
        F.col("id").alias("scene_id"), "distance")


def mean_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mean_self_distance(_documents(spark, sf_dir)).select(
        "scenes", F.round("mean_distance", 6).alias("mean_distance"))


def nearest_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.min_edit_distance_cross(_documents(spark, sf_dir), _known(spark, sf_dir), P).select(
        F.col("id").alias("scene_id"), "distance")


def mean_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mean_cross_distance(_documents(spark, sf_dir), _known(spark, sf_dir)).select(
        "scenes", F.round("mean_distance", 6).alias("mean_distance"), "perfect")


def flip_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = X.scenes(spark, sf_dir).select(
        "scene_id", G.ids_from_rows(F.col("rows"), P.alphabet).alias("scene"))
    turned = F.transform("scene", lambda row: F.reverse(row))
    return ids.select("scene_id", S.edit_distance(F.col("scene"), turned).alias("distance"))


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = X.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return S.knn_cosine(vectors, 5).select("id", "rank", "neighbour")


def best_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = X.pairs(spark, sf_dir).select(F.col("sample_id").alias("id"), F.col("prompt").alias("caption"))
    right = X.known_captions(spark, sf_dir).select(F.col("item_id").alias("id"), "caption")
    return S.best_caption_match(left, right, P).select("id", "match", F.round("score", 9).alias("score"))


def novel(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = X.pairs(spark, sf_dir).select("sample_id", F.col("generated").alias("caption"))
    known = X.pairs(spark, sf_dir).select(F.col("prompt").alias("caption"))
    return S.novel_captions(made, known, P).select("sample_id", "caption")


def random_test_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = X.pairs(spark, sf_dir).select(F.col("prompt").alias("caption"))
    return generation.draw_until(known, 100, P, seed=512)


def defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.defect_rate(X.pairs(spark, sf_dir), F.col("generated"), "pipe", "cannon").select(
        "feature", "captions", "broken", "mentions", F.round("of_captions", 6).alias("of_captions"),
        F.round("of_mentions", 6).alias("of_mentions"))


def scene_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    captions = C.platformer_caption(X.scenes(spark, sf_dir).select("scene_id", "rows"))
    return M.defect_rate(captions, F.col("caption"), "pipe").select(
        "feature", "captions", "broken", "mentions")


def _phrases(strict: bool, columns: list[str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = M.phrase_metrics(X.pairs(spark, sf_dir), "prompt", "generated", TARGETS, strict)
        return out.select("keyword", *[F.round(c, 6).alias(c) if c in ("precision", "recall", "f1")
                                       else F.col(c) for c in columns])
    return run


def breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.match_breakdown(X.pairs(spark, sf_dir), "prompt", "generated")
    return out.select(*[F.round(c, 6).alias(c) if c.endswith("percent") else F.col(c)
                        for c in out.columns])


def document(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.evaluation_document(X.pairs(spark, sf_dir), "prompt", "generated", list(P.topics), P,
                                _documents(spark, sf_dir), _known(spark, sf_dir))
    return out.select(
        "match.n", "match.perfect", F.round("match.perfect_percent", 6).alias("perfect_percent"),
        F.round("self_distance.mean_distance", 6).alias("self_distance"),
        F.round("real_distance.mean_distance", 6).alias("real_distance"),
        F.col("real_distance.perfect").alias("real_perfect"),
        F.round("real_distance.perfect_percent", 6).alias("real_perfect_percent"),
        F.col("broken_pipe.broken").alias("broken_pipes"), F.col("broken_pipe.mentions").alias("pipes"),
        F.round("broken_pipe.of_mentions", 6).alias("broken_of_pipes"),
        F.round(F.col("phrase_targeting")["tower"]["f1"], 6).alias("tower_f1"),
        F.col("broken_cannon.broken").alias("broken_cannons"),
        F.col("phrase_targeting")["tower"]["tp"].alias("tower_tp"),
        F.col("phrase_targeting")["broken pipe"]["fp"].alias("broken_pipe_fp"),
        F.size("phrase_targeting").alias("keywords"))


def adherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.adherence(X.pairs(spark, sf_dir, "source"), "prompt", "generated", ["source"])
    return out.select("source", "n", F.round("score", 6).alias("score"))


def _has(text: str, target: str, strict: bool) -> str:
    words = [target] if strict else [t for t in P.topics if t in target]
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def confusion_sql(strict: bool) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{t}' AS keyword, {_has('lower(prompt)', t, strict)} AS p, "
        f"{_has('lower(generated)', t, strict)} AS c FROM fx_pairs" for t in TARGETS)
    return PAIRS + f""", hits AS ({parts}),
conf AS (SELECT keyword, count(*) FILTER (p AND c) AS tp, count(*) FILTER (NOT p AND c) AS fp,
  count(*) FILTER (NOT p AND NOT c) AS tn, count(*) FILTER (p AND NOT c) AS fn FROM hits GROUP BY keyword),
prf AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
  tp + fp + tn + fn AS total FROM conf)
"""


SCENES2 = "WITH " + X.scene_sql() + "," + X.scene_sql("platformer", "benchmark", "item_id", "k_")
NEAREST = SCENES2 + """,
g AS MATERIALIZED (SELECT grid, count(*) AS n FROM fx_grid GROUP BY grid),
near AS (SELECT a.grid, CASE WHEN any_value(a.n) > 1 THEN 0 ELSE min(hamming(a.grid, b.grid)) END AS distance
  FROM g a JOIN g b ON a.grid <> b.grid GROUP BY a.grid)
"""
KNOWN = SCENES2 + """,
k AS MATERIALIZED (SELECT DISTINCT grid FROM k_fx_grid), g AS MATERIALIZED (SELECT * FROM fx_grid),
near AS (SELECT scene_id, min(hamming(g.grid, k.grid)) AS distance FROM g, k GROUP BY scene_id)
"""
STRIPPED = lambda f: ("lower(" + "replace(" * 6 + "generated" + "".join(
    f", 'no {lead}{f}{tail}', '')" for lead in ("broken ", "", "upside down ") for tail in ("s", "")) + ")")

QUERIES = {
    "f01_best_caption_match": (best_matches, COMPARE + """,
best AS (SELECT a.id, b.id AS other, sum(CASE WHEN a.phrase IS NULL AND b.phrase IS NULL THEN 20
  WHEN a.phrase IS NULL OR b.phrase IS NULL THEN -20 WHEN a.normal = b.normal THEN 20
  WHEN a.qi IS NOT NULL AND b.qi IS NOT NULL THEN 20 - 5*abs(a.qi - b.qi) ELSE 2 END)::BIGINT AS points
  FROM quantified a JOIN quantified b ON a.t = b.t AND a.side = 'p' AND b.side = 'k' GROUP BY a.id, b.id),
top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY points DESC, other) AS rk FROM best)
SELECT id, other AS match, round(points / 360.0::DOUBLE, 9) AS score FROM top WHERE rk = 1 AND points < 360"""),
    "f02_novel_captions": (novel, COMPARE + """,
keyed AS (SELECT id, side, string_agg(coalesce(CAST(qi AS VARCHAR), normal, ''), '|' ORDER BY t) AS k
  FROM quantified GROUP BY id, side)
SELECT f.sample_id, f.generated AS caption FROM fx_pairs f JOIN keyed g ON g.id = f.sample_id AND g.side = 'g'
WHERE NOT EXISTS (SELECT 1 FROM keyed p WHERE p.side = 'p' AND p.k = g.k)"""),
    "f02_random_test_captions": (random_test_captions, "WITH RECURSIVE drawn AS (" + generation.check_sql(P, 512).replace(
        "FROM documents", "FROM (SELECT unnest(range(1000)) AS doc_id)") + ")," + re.sub(
        r"\bfx_text\b", "fx_all", X.PAIRS_SQL) + """,
fx_text AS (SELECT id, side, caption FROM fx_all WHERE side = 'p' UNION ALL SELECT draw, 'g', caption FROM drawn)"""
        + compare_sql(P.quantity_terms, list(P.topics)) + """,
keyed AS (SELECT id, side, string_agg(coalesce(CAST(qi AS VARCHAR), normal, ''), '|' ORDER BY t) AS k
  FROM quantified GROUP BY id, side)
SELECT draw, caption FROM drawn JOIN keyed g ON g.id = draw AND g.side = 'g'
WHERE NOT EXISTS (SELECT 1 FROM keyed p WHERE p.side = 'p' AND p.k = g.k) ORDER BY draw LIMIT 100"""),
    "f03_min_edit_distance_self": (nearest_self, NEAREST + """
SELECT scene_id, distance FROM fx_grid JOIN near USING (grid)"""),
    "f03_mean_edit_distance": (mean_nearest, NEAREST + """
SELECT count(*) AS scenes, round(avg(distance), 6) AS mean_distance FROM fx_grid JOIN near USING (grid)"""),
    "f04_min_edit_distance_cross": (nearest_known, KNOWN + "SELECT scene_id, distance FROM near"),
    "f04_mean_cross_distance": (mean_known, KNOWN + """
SELECT count(*) AS scenes, round(avg(distance), 6) AS mean_distance, count(*) FILTER (distance = 0) AS perfect FROM near"""),
    "f05_edit_distance": (flip_distance, "WITH " + X.scene_sql() + """
SELECT scene_id, sum(hamming(line, reverse(line)))::INT AS distance FROM fx_rows GROUP BY scene_id"""),
    "f09_knn_cosine": (neighbours, """
WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
c AS (SELECT a.id, b.id AS neighbour, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM v a JOIN v b ON a.id <> b.id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY cosine DESC, neighbour) AS INT) AS rank FROM c)
SELECT id, rank, neighbour FROM r WHERE rank <= 5"""),
    "g01_defect_rate": (defects, PAIRS + ", s AS (" + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, contains({STRIPPED(f)}, 'broken {f}') AS b, contains({STRIPPED(f)}, '{f}') AS m FROM fx_pairs"
        for f in ("pipe", "cannon")) + """)
SELECT feature, count(*) AS captions, count(*) FILTER (b) AS broken, count(*) FILTER (m) AS mentions,
  round(100.0 * count(*) FILTER (b) / count(*), 6) AS of_captions,
  round(coalesce(100.0 * count(*) FILTER (b) / nullif(count(*) FILTER (m), 0), 0), 6) AS of_mentions FROM s GROUP BY feature"""),
    "g01_scene_defect_rate": (scene_defects, platformer_captions() + """
SELECT 'pipe' AS feature, count(*) AS captions, count(*) FILTER (contains(caption, 'broken pipe')) AS broken,
  count(*) FILTER (contains(caption, 'pipe')) AS mentions FROM captions"""),
    "g02_phrase_confusion": (_phrases(True, ["tp", "fp", "tn", "fn"]), confusion_sql(True) + """
SELECT keyword, tp, fp, tn, fn FROM conf"""),
    "g03_phrase_prf": (_phrases(False, ["precision", "recall", "f1", "total"]), confusion_sql(False) + """
SELECT keyword, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1, total FROM prf"""),
    "g04_match_breakdown": (breakdown, COMPARE + """,
k AS (SELECT CASE WHEN score = 1 AND excess = 0 THEN 'perfect' WHEN exact > 0 THEN 'partial' ELSE 'none' END AS kind FROM scored)
SELECT count(*) AS n, count(*) FILTER (kind = 'perfect') AS perfect, round(100.0 * count(*) FILTER (kind = 'perfect') / count(*), 6) AS perfect_percent,
  count(*) FILTER (kind = 'partial') AS partial, round(100.0 * count(*) FILTER (kind = 'partial') / count(*), 6) AS partial_percent,
  count(*) FILTER (kind = 'none') AS "none", round(100.0 * count(*) FILTER (kind = 'none') / count(*), 6) AS none_percent FROM k"""),
    "g05_evaluation_document": (document, COMPARE + f"""
SELECT (SELECT count(*) FROM scored) AS n, (SELECT count(*) FROM scored WHERE score = 1 AND excess = 0) AS perfect,
  round(100.0 * (SELECT count(*) FROM scored WHERE score = 1 AND excess = 0) / (SELECT count(*) FROM scored), 6) AS perfect_percent,
  (SELECT round(avg(distance), 6) FROM ({NEAREST} SELECT distance FROM fx_grid JOIN near USING (grid))) AS self_distance,
  (SELECT round(avg(distance), 6) FROM ({KNOWN} SELECT distance FROM near)) AS real_distance,
  (SELECT count(*) FROM ({KNOWN} SELECT distance FROM near) WHERE distance = 0) AS real_perfect,
  (SELECT round(100.0 * count(*) FILTER (distance = 0) / count(*), 6) FROM ({KNOWN} SELECT distance FROM near)) AS real_perfect_percent,
  (SELECT count(*) FROM fx_pairs WHERE contains({STRIPPED('pipe')}, 'broken pipe')) AS broken_pipes,
  (SELECT count(*) FROM fx_pairs WHERE contains({STRIPPED('pipe')}, 'pipe')) AS pipes,
  (SELECT round(coalesce(100.0 * count(*) FILTER (contains({STRIPPED('pipe')}, 'broken pipe'))
    / nullif(count(*) FILTER (contains({STRIPPED('pipe')}, 'pipe')), 0), 0), 6) FROM fx_pairs) AS broken_of_pipes,
  (SELECT round(coalesce(2.0 * count(*) FILTER (p AND g) / nullif(2 * count(*) FILTER (p AND g) + count(*) FILTER (p <> g), 0), 0), 6)
    FROM (SELECT contains(prompt, 'tower') AS p, contains(generated, 'tower') AS g FROM fx_pairs)) AS tower_f1,
  (SELECT count(*) FROM fx_pairs WHERE contains({STRIPPED('cannon')}, 'broken cannon')) AS broken_cannons,
  (SELECT count(*) FROM fx_pairs WHERE contains(prompt, 'tower') AND contains(generated, 'tower')) AS tower_tp,
  (SELECT count(*) FROM fx_pairs WHERE NOT contains(lower(prompt), 'broken pipe') AND contains(lower(generated), 'broken pipe')) AS broken_pipe_fp,
  {len(P.topics)} AS keywords"""),
    "g06_adherence_mean": (adherence, COMPARE + """
SELECT source, count(*) AS n, round(avg(score), 6) AS score FROM scored JOIN documents ON doc_id = sample_id GROUP BY source"""),
}
