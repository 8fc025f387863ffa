"""Queries of windows, reshaping, encodings, patches and dataset files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright import fixtures as X
from scenewright.functions import captions as E
from scenewright.functions import grid as G
from scenewright.functions import scenes as S
from scenewright.games import DIRECTIONAL, PLATFORMER
from scenewright.operators import captioner as C
from scenewright.operators import features as D
from scenewright.operators import metrics as M
from scenewright.operators import patches as PT
from scenewright.operators import windows as WI
from scenewright.plans.captions import PAIRS, compare_sql
from scenewright.plans.platformer_sql import BASE
from scenewright.plans.platformer_sql import captions as platformer_captions
from scenewright.sources import levels as LV
from scenewright.session import scratch_folder
from scenewright.sources import json_arrays, sinks

PIPES = "<>[]"
BAND = 16


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines as levels, in bands of 16 lines so that whole texts are used."""
    docs = X.spread(X.table(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = docs.select("doc_id", LV.level_lines(F.col("text")).alias("all")).where("size(all) > 0")
    bands = lines.select("doc_id", "all", F.explode(F.sequence(
        F.lit(0), F.floor((F.size("all") - 1) / BAND).cast("int"))).alias("band"))
    return bands.select("doc_id", "band", F.slice("all", F.col("band") * BAND + 1, F.lit(BAND)).alias("lines"))


def _scene_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.scenes(spark, sf_dir).select(
        "scene_id", G.ids_from_rows(F.col("rows"), PLATFORMER.alphabet).alias("scene"))


def _text(scene: Column) -> Column:
    return F.array_join(F.transform(scene, lambda row: F.array_join(row, ",")), ";")


def level_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).select("doc_id", "band", F.size("lines").alias("height"),
                                         WI.widest(F.col("lines")).alias("width"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = WI.sliding_windows(_levels(spark, sf_dir), ["doc_id", "band"], 16, 16, 1, "-")
    flat = F.array_join("rows", "")
    return cut.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum(F.length(flat) - F.length(F.replace(flat, F.lit("e"), F.lit("")))).alias("e"))


def extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = X.scenes(spark, sf_dir).select("scene_id", F.col("rows").alias("lines"))
    taller = WI.sliding_windows(levels, ["scene_id"], 20, 16, 1, "-", PIPES)
    return taller.select("scene_id", F.concat_ws("/", F.slice("rows", 1, 5)).alias("top"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = WI.room_clusters(_levels(spark, sf_dir), ["doc_id", "band"], 2, 8)
    flat = F.array_join(F.flatten("rooms"), "")
    return cut.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(
        F.length(F.replace(flat, F.lit("-"), F.lit("")))).alias("filled"))


def patch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = WI.patches(_scene_levels(spark, sf_dir), 3).groupBy("patch").agg(F.count("*").alias("n"))
    return counted.agg(F.count("*").alias("distinct_patches"), F.sum("n").alias("patches"),
                       F.max("n").alias("most"))


def _scene_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.scenes(spark, sf_dir).select("scene_id", F.col("rows").alias("lines"))


def centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = PT.center_counts(WI.patches(_scene_levels(spark, sf_dir), 3), 3)
    return out.withColumn("keep", F.round("keep", 6))


def skipgrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PT.skipgram_pairs(WI.patches(_scene_levels(spark, sf_dir), 3), 3)


def path_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = WI.concat_scenes(X.scenes(spark, sf_dir), "doc_id", "scene_id").withColumnRenamed("rows", "lines")
    names = F.array(*[F.lit(d) for d in WI.DIRECTIONS])
    path = levels.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(
        F.length(F.col("lines")[0]) / 16).cast("int") - 1)).alias("step")).select(
        "doc_id", "step", (F.col("step") * 16).alias("x"), F.lit(2).alias("y"),
        F.get(names, (F.pmod(F.col("step") * F.col("step") + F.col("doc_id"), F.lit(4))).cast("int")).alias("direction"))
    cut = WI.path_windows(levels, path, "doc_id", 14, 16)
    return cut.select("doc_id", "step", F.array_join("rows", "").alias("grid"), "entrance_direction", "exit_direction")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = X.scenes(spark, sf_dir).select(
        "scene_id", F.posexplode(WI.segment_scene(F.col("rows"), 6)).alias("k", "part"))
    return cut.select("scene_id", "k", F.array_join("part", "").alias("grid"))


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = WI.concat_scenes(X.scenes(spark, sf_dir), "doc_id", "scene_id")
    return whole.select("doc_id", F.posexplode("rows").alias("r", "line"))


def _ids(expr):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _scene_ids(spark, sf_dir).select("scene_id", _text(expr(F.col("scene"))).alias("scene"))
    return run


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = S.decode_tiles(S.one_hot(F.col("scene"), len(PLATFORMER.alphabet)))
    same = _scene_ids(spark, sf_dir).select("scene_id", (back == F.col("scene")).alias("same"))
    return same.groupBy("same").agg(F.count("*").alias("n"))


def _tile_vectors(spark: SparkSession, sf_dir: str) -> list[list[float]]:
    """Mean embedding per label, in label order: one vector per tile."""
    parts = X.table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    found = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("x")).orderBy("label")
    return [[c["v"] for c in row["x"]] for row in found.collect()]  # a row per tile


def nearest_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = _tile_vectors(spark, sf_dir)
    return X.table(spark, sf_dir, "embeddings").select("vec_id", S.nearest_tile(F.col("embedding"), tiles).alias("tile"))


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = S.embed_tiles(F.col("scene"), _tile_vectors(spark, sf_dir))
    first = F.aggregate(F.flatten(vectors), F.lit(0.0), lambda s, v: s + F.coalesce(F.get(v, F.lit(0)), F.lit(0.0)))
    return _scene_ids(spark, sf_dir).select("scene_id", F.round(first, 6).alias("total"))


def backed_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples written twice: the backup has the first version."""
    folder = scratch_folder(spark, "backup")
    pairs = X.pairs(spark, sf_dir)
    for caption in ("prompt", "generated"):
        sinks.write_backed_up(pairs.select("sample_id", F.col(caption).alias("caption")), f"{folder}/now", f"{folder}/old")
    read = lambda name: spark.read.schema("sample_id bigint, caption string").json(f"{folder}/{name}").select(
        F.lit(name).alias("version"), "sample_id", "caption")
    return read("now").unionByName(read("old"))


def square(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scene_ids(spark, sf_dir).groupBy(S.is_square(F.col("scene"), 16).alias("square")).agg(
        F.count("*").alias("n"))


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = D.explode_cells(X.scenes(spark, sf_dir, "directional"), "scene_id")
    small = S.grouped_alphabet(DIRECTIONAL)
    tile = F.instr(F.lit(small), S.group_of(F.col("ch"), DIRECTIONAL)) - 1
    return cells.groupBy("ch", tile.alias("tile")).agg(F.count("*").alias("n"))


def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.scenes(spark, sf_dir, "ladder").groupBy(F.coalesce(
        S.invalid_reason(F.col("rows")), F.lit("fine")).alias("reason")).agg(F.count("*").alias("n"))


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.scenes(spark, sf_dir).select("scene_id", sinks.ascii_text(F.col("rows"), last_rows=15).alias("text"))


def _through_arrays(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The same rows, written as JSON arrays and read back in ranges."""
    folder = f"{scratch_folder(spark, 'arrays')}/table"
    json_arrays.write_arrays(df, folder)
    return json_arrays.read_array(spark, folder, df.schema)


def sample_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = X.pairs(spark, sf_dir).select("sample_id", "prompt", F.col("generated").alias("caption"))
    return _through_arrays(spark, pairs)


def document_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _through_arrays(spark, X.table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"))
    return docs.select("doc_id", F.md5("text").alias("digest"), "n_chars")


def sample_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = X.pairs(spark, sf_dir)
    return pairs.select("sample_id", F.to_json(F.struct("prompt", F.col("generated").alias("caption"))).alias("line"))


def scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = D.explode_cells(X.scenes(spark, sf_dir), "scene_id")
    return PT.tile_scaling(cells, PLATFORMER.alphabet, 4).withColumn("scaling", F.round("scaling", 6))


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = X.table(spark, sf_dir, "embeddings")
    means = PT.mean_pool(vectors.withColumn("u", PT.l2_normalize(F.col("embedding"))), ["label"], "u")
    return means.select("label", F.round(PT.dot(F.col("mean"), F.col("mean")), 6).alias("power"),
                        F.round(F.col("mean")[0], 6).alias("first"))


def similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.table(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.round(PT.cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("cosine"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = X.table(spark, sf_dir, "events").select(
        "event_id", F.from_json("props", "k INT, _corrupt_record STRING",
                                {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("p"))
    return parsed.where("p._corrupt_record IS NULL").select("event_id", F.col("p.k").alias("k"))


def metric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("agent started\nvalue: "), F.col("value").cast("string"), F.lit("\nbeaten: "),
                    F.when(F.col("value") > 20, "True").otherwise("false"), F.lit("\nk: "),
                    F.get_json_object("props", "$.k"))
    rows = X.table(spark, sf_dir, "events").select("event_id", F.explode(S.metric_lines(text)).alias("m"))
    return rows.groupBy("m.key", "m.kind").agg(F.count("*").alias("n"), F.round(F.sum("m.value"), 3).alias("total"))


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.concat("n_name", F.lit(":0-"), F.col("n_regionkey").cast("string"), F.lit(":*.jsonl:label "), "n_name")
    parsed = X.table(spark, sf_dir, "nation").select(S.experiment_spec(spec).alias("s"))
    return parsed.select("s.prefix", "s.pattern", "s.label", F.explode("s.runs").alias("run"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = X.table(spark, sf_dir, "nation").select(F.col("n_name").alias("g"), F.col("n_regionkey").alias("r"))
    region = X.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r"), F.col("r_name").alias("label"))
    named = nation.join(F.broadcast(region.where("r <> 2")), "r", "left")
    return named.select("g", F.coalesce("label", "g").alias("label"), F.when(F.col("label").isNotNull(), F.col("r")).alias("ord"))


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = X.table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("w"))
    plain = tokens.union(X.table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string")))
    return plain.select(S.to_number(F.col("w")).alias("v")).groupBy("v").agg(F.count("*").alias("n"))


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.to_hours(X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("k"), "o_totalprice"))
    return out.select("k", F.round("o_totalprice", 6).alias("hours"))


def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    b = X.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return a.unionByName(b, allowMissingColumns=True).groupBy("lang").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("letters"))


def distinct_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).groupBy(F.md5(F.array_join("lines", "\n").cast("binary")).alias("digest")).agg(
        F.min(F.size("lines")).alias("height"))


def common_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = X.score_log(spark, sf_dir).select("grp", "run", "epoch").distinct()
    runs = per.select("grp", "run").distinct().groupBy("grp").agg(F.count("*").alias("runs"))
    return per.groupBy("grp", "epoch").agg(F.count("*").alias("n")).join(F.broadcast(runs), "grp").where(
        "n = runs").select("grp", "epoch")


def selected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("source", F.lit("_LevelsAndCaptions-"), "lang", F.lit(".json"))
    return X.table(spark, sf_dir, "documents").select(name.alias("file")).where(
        F.col("file").startswith("src1") & ~F.col("file").contains("-de")).distinct()


def tile_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each language as a tileset: ids in code point order."""
    chars = X.spread(X.table(spark, sf_dir, "documents").select("lang", "text")).select(
        "lang", F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).distinct()
    return LV.number_tiles(chars, "lang")


def prompt_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.table(spark, sf_dir, "documents").select("doc_id")
    return docs.select("doc_id", F.explode(LV.prompt_grid()).alias("prompt")).groupBy("prompt").agg(
        F.count("*").alias("n"))


def segment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is one wide scene; its segments are scored against the document's prompt."""
    wide = WI.concat_scenes(X.scenes(spark, sf_dir).select("doc_id", "scene_id", "rows"), "doc_id", "scene_id")
    prompts = X.pairs(spark, sf_dir).select(F.col("sample_id").alias("doc_id"), "prompt")
    out = M.score_segments(wide.join(prompts, "doc_id"), "doc_id", "prompt", C.platformer_caption)
    whole = F.transform("scores", lambda s: F.round(s * 1000000).cast("bigint").cast("string"))
    return out.select("doc_id", F.round("score", 6).alias("score"), F.size("captions").cast("bigint").alias("segments"),
                      F.md5(F.array_join("captions", "/").cast("binary")).alias("captions"),
                      F.array_join(whole, " ").alias("scores"))


ID = "instr('" + PLATFORMER.alphabet + "', ch) - 1"
LV_SQL = """WITH fx_l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
  lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS a FROM documents),
lv AS (SELECT doc_id, band, a[band*16+1 : band*16+16] AS lines FROM (
  SELECT doc_id, a, unnest(range(0, (len(a) + 15) // 16)) AS band FROM fx_l WHERE len(a) > 0)),
lw AS (SELECT doc_id, band, lines, list_max(list_transform(lines, lambda x: length(x))) AS w, len(lines) AS h FROM lv)
"""


def ids_sql(expr: str, order: str = "c") -> str:
    return BASE + f""",
rw AS (SELECT scene_id, r, string_agg(CAST({expr} AS VARCHAR), ',' ORDER BY {order}) AS line FROM cells GROUP BY scene_id, r)
SELECT scene_id, string_agg(line, ';' ORDER BY r) AS scene FROM rw GROUP BY scene_id"""


PATCH = BASE + """, ln AS (SELECT a.scene_id, a.r, a.line AS l0, b.line AS l1, d.line AS l2 FROM fx_rows a
  JOIN fx_rows b ON b.scene_id = a.scene_id AND b.r = a.r + 1 JOIN fx_rows d ON d.scene_id = a.scene_id AND d.r = a.r + 2),
pt AS (SELECT substr(l0, x, 3) || substr(l1, x, 3) || substr(l2, x, 3) AS patch FROM ln, (SELECT unnest(range(1, 15)) AS x))
"""

TILE_VECTORS = """WITH parts AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT label, i, avg(v) AS v FROM parts GROUP BY label, i),
tiles AS (SELECT row_number() OVER (ORDER BY label) - 1 AS tile, list(v ORDER BY i) AS e FROM means GROUP BY label)"""

PAD = "\u2591"


def padded_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tile set file of all characters of the documents, written and read back with a padding tile."""
    at = f"{scratch_folder(spark, 'tileset')}/set"
    chars = X.table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")
    tiles = chars.groupBy("ch").agg(F.array_sort(F.collect_set("lang")).alias("langs"))
    named = F.map_from_entries(F.collect_list(F.struct("ch", "langs")))
    tiles.agg(F.to_json(F.struct(named.alias("tiles"))).alias("value")).write.text(at)
    return LV.read_tileset(spark, at, extra_tile=PAD).select("tile", "ch", F.size("descriptors").alias("langs"))


QUERIES = {
    "a01_tile_ids": (tile_ids, """
WITH c AS (SELECT DISTINCT lang, unnest(string_split(text, '')) AS ch FROM documents)
SELECT lang, ch, CAST(row_number() OVER (PARTITION BY lang ORDER BY encode(ch)) - 1 AS INT) AS tile FROM c"""),
    "a02_padded_tiles": (padded_tiles, f"""
WITH c AS (SELECT lang, unnest(string_split(text, '')) AS ch FROM documents),
t AS (SELECT ch, count(DISTINCT lang) AS langs, 0 AS pad FROM c WHERE ch <> '' GROUP BY ch),
p AS (SELECT * FROM t UNION ALL SELECT '{PAD}', 0, 1 WHERE NOT EXISTS (SELECT 1 FROM t WHERE ch = '{PAD}'))
SELECT CAST(row_number() OVER (ORDER BY pad, encode(ch)) - 1 AS INT) AS tile, ch, CAST(langs AS INT) AS langs FROM p"""),
    "a03_level_lines": (level_lines, LV_SQL + "SELECT doc_id, band, h AS height, w AS width FROM lw"),
    "a04_sample_arrays": (sample_arrays, PAIRS + "SELECT sample_id, prompt, generated AS caption FROM fx_pairs"),
    "a04_document_arrays": (document_arrays, "SELECT doc_id, md5(text) AS digest, n_chars FROM documents"),
    "a05_jsonl_records": (log_lines, """
SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events"""),
    "a08_sample_lines": (sample_lines, PAIRS + """
SELECT sample_id, to_json({'prompt': prompt, 'caption': generated})::VARCHAR AS line FROM fx_pairs"""),
    "a09_write_ascii": (written, BASE + """
SELECT scene_id, string_agg(line, chr(10) ORDER BY r) AS text FROM fx_rows WHERE r >= 1 GROUP BY scene_id"""),
    "a11_file_selection": (selected_files, """
SELECT DISTINCT source || '_LevelsAndCaptions-' || lang || '.json' AS file FROM documents WHERE source LIKE 'src1%' AND lang <> 'de'"""),
    "b01_encode_tiles": (_ids(lambda s: s), ids_sql(ID)),
    "b02_group_tiles": (grouped, "WITH " + X.scene_sql("directional") + f"""
SELECT ch, instr('{S.grouped_alphabet(DIRECTIONAL)}', CASE WHEN instr('{DIRECTIONAL.having('enemy')}', ch) > 0 THEN 'a'
  WHEN instr('{DIRECTIONAL.having('powerup')}', ch) > 0 THEN 'l'
  WHEN instr('{DIRECTIONAL.having('empty', without=('water',))}', ch) > 0 THEN '-' ELSE ch END) - 1 AS tile, count(*) AS n
FROM fx_cells GROUP BY ALL"""),
    "b03_wrap_tiles": (_ids(lambda s: S.wrap_tiles(s, 8)), ids_sql(f"({ID}) % 8")),
    "b04_one_hot_decode": (decoded, "WITH " + X.scene_sql() + " SELECT true AS same, count(*) AS n FROM fx_grid"),
    "a10_backed_up": (backed_up, PAIRS + """
SELECT 'now' AS version, sample_id, generated AS caption FROM fx_pairs UNION ALL SELECT 'old', sample_id, prompt FROM fx_pairs"""),
    "b04_embedding_lookup": (embedded, TILE_VECTORS + "," + X.scene_sql() + f"""
SELECT scene_id, round(sum(coalesce(e[1], 0)), 6) AS total FROM fx_cells LEFT JOIN tiles ON tile = {ID} GROUP BY scene_id"""),
    "b05_nearest_tile": (nearest_tiles, TILE_VECTORS + """,
c AS (SELECT vec_id, tile, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), e), 9) AS cosine FROM embeddings, tiles)
SELECT vec_id, CAST(tile AS INT) AS tile FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, tile) AS rk FROM c) WHERE rk = 1"""),
    "b08_validate_patches": (square, "WITH " + X.scene_sql() + " SELECT true AS square, count(*) AS n FROM fx_grid"),
    "b07_validate_scene": (reasons, "WITH " + X.scene_sql("ladder") + """
SELECT CASE WHEN NOT contains(grid, 'M') THEN 'no spawn' WHEN NOT contains(grid, 'G') THEN 'no gold' ELSE 'fine' END AS reason,
  count(*) AS n FROM fx_grid GROUP BY 1"""),
    "b10_to_hours": (hours, "SELECT o_orderkey::VARCHAR AS k, round(o_totalprice / 3600.0, 6) AS hours FROM orders"),
    "b11_rename_and_order": (labelled, """
SELECT n_name AS g, coalesce(r_name, n_name) AS label, r_regionkey AS ord FROM nation LEFT JOIN region
ON r_regionkey = n_regionkey AND r_regionkey <> 2"""),
    "b12_numeric_coercion": (numbers, """
WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS w FROM part UNION ALL SELECT p_size::VARCHAR FROM part)
SELECT TRY_CAST(w AS DOUBLE) AS v, count(*) AS n FROM w GROUP BY 1"""),
    "b13_parse_metric_lines": (metric_lines, """
SELECT 'value' AS key, 'float' AS kind, count(*) AS n, round(sum(value), 3) AS total FROM events
UNION ALL SELECT 'beaten', 'bool', count(*), count(*) FILTER (value > 20)::DOUBLE FROM events
UNION ALL SELECT 'k', 'int', count(*), sum(CAST(json_extract(props, '$.k') AS INT))::DOUBLE FROM events"""),
    "b14_experiment_spec": (specs, """
SELECT n_name AS prefix, '*.jsonl' AS pattern, 'label ' || n_name AS label, CAST(unnest(range(0, n_regionkey + 1)) AS INT) AS run FROM nation"""),
    "c01_sliding_windows": (windows, LV_SQL + """,
ch AS (SELECT doc_id, band, w, h, r, unnest(string_split(lines[r], '')) AS c, unnest(range(0, length(lines[r]))) AS x
  FROM (SELECT doc_id, band, w, h, lines, unnest(range(1, h + 1)) AS r FROM lw WHERE w >= 16)),
e AS (SELECT doc_id, sum(least(x, w - 16) - greatest(0, x - 15) + 1) AS e FROM ch WHERE c = 'e' GROUP BY doc_id)
SELECT doc_id, n, coalesce(e, 0)::BIGINT AS e FROM (SELECT doc_id, sum(w - 15)::BIGINT AS n FROM lw WHERE w >= 16 GROUP BY doc_id) LEFT JOIN e USING (doc_id)"""),
    "c02_extend_top_pipes": (extended, BASE + """
SELECT scene_id, repeat(regexp_replace(line, '[^<>\\[\\]]', '-', 'g') || '/', 4) || line AS top FROM fx_rows WHERE r = 0"""),
    "c03_room_clusters": (clusters, LV_SQL + """,
g AS (SELECT doc_id, band, lines, h, h // 2 AS rn, w // 8 AS cn FROM lw WHERE h >= 2 AND w >= 8),
p AS (SELECT doc_id, band, gy, unnest(range(0, cn)) AS gx, lines, h FROM (SELECT *, unnest(range(0, rn)) AS gy FROM g)),
f AS (SELECT doc_id, band, gy, gx, length(replace(array_to_string(list_transform(lines[gy*2+1 : gy*2+4],
  lambda x: substr(x, gx*8+1, 16)), ''), '-', '')) AS filled FROM p)
SELECT doc_id, count(*) AS n, sum(filled)::BIGINT AS filled FROM f WHERE filled > 0 GROUP BY doc_id"""),
    "c04_unique_patches": (patch_counts, PATCH + """, k AS (SELECT patch, count(*) AS n FROM pt GROUP BY patch)
SELECT count(*) AS distinct_patches, sum(n)::BIGINT AS patches, max(n) AS most FROM k"""),
    "c05_path_windows": (path_cuts, BASE + """, st AS (SELECT DISTINCT doc_id, scene_id, scene_id - doc_id * 100000 AS step FROM fx_rows),
d AS (SELECT *, (step * step + doc_id) % 4 AS k FROM st),
e AS (SELECT *, (coalesce(lag(k) OVER (PARTITION BY doc_id ORDER BY step), k) + 2) % 4 AS b FROM d),
gr AS (SELECT scene_id, string_agg(line, '' ORDER BY r) AS grid FROM fx_rows WHERE r >= 2 GROUP BY scene_id)
SELECT doc_id, CAST(step AS INT) AS step, repeat('@', 32) || grid AS grid, ['UP','RIGHT','DOWN','LEFT'][CAST(b AS INT) + 1] AS entrance_direction,
  ['UP','RIGHT','DOWN','LEFT'][CAST(k AS INT) + 1] AS exit_direction FROM e JOIN gr USING (scene_id)"""),
    "c06_segment_scene": (segments, BASE + """
SELECT scene_id, CAST(k AS INT) AS k, string_agg(substr(line, k*6+1, 6), '' ORDER BY r) AS grid FROM fx_rows, (SELECT unnest(range(0, 3)) AS k) GROUP BY scene_id, k"""),
    "c07_concat_scenes": (joined, BASE + "SELECT doc_id, r, string_agg(line, '' ORDER BY scene_id) AS line FROM fx_rows GROUP BY doc_id, r"),
    "c08_mask_half": (_ids(lambda s: WI.mask_right(s, -1)["input"]), ids_sql(f"CASE WHEN c >= 8 THEN -1 ELSE {ID} END")),
    "c08_recombine": (_ids(lambda s: WI.recombine(s, WI.flip_scene(s))), BASE + f""",
fl AS (SELECT scene_id, r, 15 - c AS c, CASE {ID} WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 9 THEN 10 WHEN 10 THEN 9 ELSE {ID} END AS v FROM cells),
mx AS (SELECT scene_id, r, c, {ID} AS v FROM cells WHERE c < 8 UNION ALL SELECT * FROM fl WHERE c >= 8),
rw AS (SELECT scene_id, r, string_agg(CAST(v AS VARCHAR), ',' ORDER BY c) AS line FROM mx GROUP BY scene_id, r)
SELECT scene_id, string_agg(line, ';' ORDER BY r) AS scene FROM rw GROUP BY scene_id"""),
    "c09_flip_scene": (_ids(WI.flip_scene), ids_sql(
        f"CASE {ID} WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 9 THEN 10 WHEN 10 THEN 9 ELSE {ID} END", "c DESC")),
    "e06_score_segments": (segment_scores, "WITH RECURSIVE caps AS MATERIALIZED (" + platformer_captions()
        + " SELECT scene_id, caption FROM captions)," + re.sub(r"\bfx_text\b", "fx_all", X.PAIRS_SQL) + f""",
fx_text AS (SELECT scene_id AS id, 'g' AS side, caption FROM caps UNION ALL
  SELECT scene_id, 'p', p.caption FROM caps JOIN fx_all p ON p.side = 'p' AND p.id = scene_id // {X.SCENES_PER_DOCUMENT})"""
        + compare_sql(PLATFORMER.quantity_terms, list(PLATFORMER.topics)) + f"""
SELECT scene_id // {X.SCENES_PER_DOCUMENT} AS doc_id, round(avg(score), 6) AS score, count(*) AS segments,
  md5(string_agg(caption, '/' ORDER BY scene_id)) AS captions,
  string_agg(CAST(CAST(round(score * 1000000) AS BIGINT) AS VARCHAR), ' ' ORDER BY scene_id) AS scores
FROM scored JOIN caps ON scene_id = sample_id GROUP BY 1"""),
    "f10_prompt_grid": (prompt_grid, """
SELECT a || ' pipes, ' || b || ' enemies, ' || c || ' blocks, ' || d || ' elevation' AS prompt, count(*) AS n
FROM documents, (SELECT unnest(['no','little','some','many']) AS a), (SELECT unnest(['no','little','some','many']) AS b),
  (SELECT unnest(['little','some','many']) AS c), (SELECT unnest(['low','high']) AS d) GROUP BY 1"""),
    "g18_mean_pool": (pooled, """
WITH v AS (SELECT label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT label, unnest(list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))) AS v, unnest(range(0, len(e))) AS i FROM v),
m AS (SELECT label, i, avg(v) AS m FROM u GROUP BY label, i)
SELECT label, round(sum(m * m), 6) AS power, round(max(m) FILTER (i = 0), 6) AS first FROM m GROUP BY label"""),
    "g18_cosine": (similarity, """
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_reverse(CAST(embedding AS DOUBLE[]))), 6) AS cosine FROM embeddings"""),
    "g19_tile_scaling": (scaling, BASE + f""", al AS (SELECT unnest(range(0, 13)) AS tile),
ct AS (SELECT {ID} AS tile, count(*) AS n FROM cells GROUP BY 1),
k AS (SELECT CAST(al.tile AS INT) AS tile, greatest(coalesce(n, 0), 1) AS n FROM al LEFT JOIN ct ON ct.tile = al.tile)
SELECT tile, n, round(pow(n, 0.25) / min(pow(n, 0.25)) OVER (), 6) AS scaling FROM k"""),
    "g20_center_counts": (centers, PATCH + """, k AS (SELECT substr(patch, 5, 1) AS center, count(*) AS n FROM pt GROUP BY 1),
s AS (SELECT *, n / sum(n) OVER () AS f FROM k)
SELECT center, n, round(least((sqrt(f / 0.001) + 1) * (0.001 / f), 1.0), 6) AS keep FROM s"""),
    "g21_skipgram_pairs": (skipgrams, PATCH + """,
x AS (SELECT substr(patch, 5, 1) AS center, unnest(string_split(substr(patch, 1, 4) || substr(patch, 6), '')) AS context FROM pt)
SELECT center, context, count(*) AS n FROM x GROUP BY ALL"""),
    "i01_union_all": (combined, """
SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS letters FROM (SELECT lang, text FROM documents UNION ALL SELECT NULL, text FROM benchmark) GROUP BY lang"""),
    "i02_distinct_levels": (distinct_levels, LV_SQL + "SELECT md5(array_to_string(lines, chr(10))) AS digest, min(h) AS height FROM lw GROUP BY 1"),
    "i05_common_epochs": (common_epochs, "WITH " + X.LOG_SQL + """
SELECT grp, epoch FROM fx_score_log s GROUP BY grp, epoch HAVING count(DISTINCT run) = (SELECT count(DISTINCT run) FROM fx_score_log t WHERE t.grp = s.grp)"""),
}
