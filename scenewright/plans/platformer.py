"""Queries over platformer scenes cut from the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright import fixtures as X
from scenewright.functions import grid as G
from scenewright.functions.quantity import count_phrase, describe_runs, location, quantity, size_word
from scenewright.games import PLATFORMER as P
from scenewright.operators import captioner as C
from scenewright.operators import features as D
from scenewright.operators.components import component_labels, components
from scenewright.plans.platformer_sql import BASE, PIPE, SOLID, captions, plural, q



def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.scenes(spark, sf_dir, "platformer").select("scene_id", "rows")


def _feature(**columns):
    """A query that adds feature columns to every scene."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _scenes(spark, sf_dir).select(
            "scene_id", *[make().alias(name) for name, make in columns.items()])
    return run


def _shapes(select):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return select(C.with_shapes(_scenes(spark, sf_dir)))
    return run


def explode_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = "".join(P.alphabet)
    cells = D.explode_cells(_scenes(spark, sf_dir), "scene_id")
    tile = (F.instr(F.lit(ids), F.col("ch")) - 1).alias("tile")
    return cells.groupBy("r", "c", tile).agg(F.count("*").alias("n"))


def ceiling_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda row: D.ceiling_phrase(row, P, P.having("solid"), P.having("passable", "moving"))
    return _scenes(spark, sf_dir).select(
        "scene_id", F.posexplode(F.transform(F.slice("rows", 1, P.ceiling + 1), text)).alias(
            "r", "ceiling_text"))


def ceiling_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.with_ceiling(_scenes(spark, sf_dir), P).select("scene_id", "ceiling_row",
                                                            "ceiling_text")


def coin_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = G.runs_of(D.horizontal_run_bits(F.col("rows"), P, "coin", 2), 1)
    return _scenes(spark, sf_dir).select("scene_id", F.explode_outer(runs).alias("run")).where(
        "run IS NOT NULL").select(
        "scene_id", F.col("run.line").alias("r"), F.col("run.first").alias("c0"),
        F.col("run.last").alias("c1"))


def described_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = G.runs_of(D.horizontal_run_bits(F.col("rows"), P, "coin", 2), 1)
    return _scenes(spark, sf_dir).withColumn("runs", runs).select(
        "scene_id",
        describe_runs(F.col("runs"), "coin line", P).alias("counted"),
        describe_runs(F.col("runs"), "coin line", P, where="coarse").alias("placed"),
        describe_runs(F.col("runs"), "coin line", P, where="exact").alias("listed"))


def tile_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = D.explode_cells(_scenes(spark, sf_dir), "scene_id").where(F.col("ch") == "E")
    return cells.groupBy(location(F.col("c"), F.col("r"), P).alias("place")).agg(
        F.count("*").alias("n"))


def _stairs(df: DataFrame) -> DataFrame:
    one = lambda name, kind: F.transform(name, lambda s: F.struct(
        F.lit(kind).alias("kind"), s["c"].alias("c"), s["r"].alias("r"), s["n"].alias("n")))
    both = F.concat(one("up_stairs", "ascending"), one("down_stairs", "descending"))
    return df.select("scene_id", F.explode_outer(both).alias("s")).where("s IS NOT NULL").select(
        "scene_id", "s.kind", "s.c", "s.r", "s.n")


def solid_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = G.class_bits(F.col("rows"), P, P.having("solid", without=("pipe",)))
    cells = _scenes(spark, sf_dir).withColumn("labels", component_labels(bits, P.width)).select(
        "scene_id", F.posexplode_outer("labels").alias("i", "lab"))
    return cells.where("lab IS NOT NULL")


def pipe_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(G.class_bits(F.col("rows"), P, P.having("pipe")), P.width,
                       G.class_bits(F.col("rows"), P, ">]"), G.class_bits(F.col("rows"), P, "<["))
    boxes = _scenes(spark, sf_dir).withColumn("found", found).select(
        "scene_id", F.explode_outer("found.boxes").alias("b")).where("b IS NOT NULL")
    return boxes.select("scene_id", F.col("b.label").alias("lab"), F.col("b.top").alias("r0"),
                        F.col("b.bottom").alias("r1"), F.col("b.left").alias("c0"),
                        F.col("b.cells").alias("n"))


def _kinds(column: str, boxes: str):
    def select(df: DataFrame) -> DataFrame:
        pairs = F.zip_with(boxes, column, lambda b, k: F.struct(
            b["label"].alias("lab"), k.alias("kind")))
        return df.select("scene_id", F.explode_outer(pairs).alias("k")).where(
            "k IS NOT NULL").select("scene_id", "k.lab", "k.kind")
    return _shapes(select)


def _loose(df: DataFrame) -> DataFrame:
    return df.select("scene_id", G.bit_total(G.minus_rows(
        G.minus_rows(F.col("loose_bits"), F.col("claimed_bits")), F.col("block_bits"))).alias("n"))


def caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.platformer_caption(_scenes(spark, sf_dir)).select("scene_id", "caption")


def caption_with_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.platformer_caption(_scenes(spark, sf_dir), absence=True).select("scene_id", "caption")


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.phrase_cells(_scenes(spark, sf_dir)).groupBy("scene_id", "topic").agg(
        F.count("*").alias("cells"), F.min(F.col("r") * 16 + F.col("c")).alias("first_cell"),
        F.max(F.col("r") * 16 + F.col("c")).alias("last_cell"))


def caption_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caption(spark, sf_dir).groupBy("caption").agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "caption")


def _location_sql(x: str, y: str) -> str:
    left, right, top, bottom = P.thirds()
    return (f"CASE WHEN {x}<{left!r} THEN 'left' WHEN {x}<{right!r} THEN 'center' ELSE 'right' END"
            f"||' '||CASE WHEN {y}<{top!r} THEN 'top' WHEN {y}<{bottom!r} THEN 'middle' ELSE 'bottom' END")


COIN_RUNS = BASE + """,
coin0 AS (SELECT scene_id, r, c, c-row_number() OVER (PARTITION BY scene_id, r ORDER BY c) AS g
  FROM cells WHERE ch='o' AND r<15),
coinruns AS (SELECT scene_id, r, min(c) AS c0, max(c) AS c1 FROM coin0 GROUP BY scene_id, r, g
  HAVING count(*)>=2)
"""
DESCRIBED = COIN_RUNS + f""",
placed AS (SELECT *, {_location_sql('(c0+c1)/2.0', 'r')} AS place FROM coinruns),
byplace AS (SELECT scene_id, place, count(*) AS k, min(r*100+c0) AS o FROM placed GROUP BY 1, 2),
plc AS (SELECT scene_id, ' '||string_agg(({q('k')})||' coin line'||CASE WHEN k>1 THEN 's' ELSE '' END
  ||' at '||place, '. ' ORDER BY o)||'.' AS t FROM byplace GROUP BY 1),
lst AS (SELECT scene_id, count(*) AS n, string_agg(r||' (cols '||c0||'-'||c1||')', ', ' ORDER BY r, c0) AS t
  FROM coinruns GROUP BY 1)
SELECT scene_id, CASE WHEN lst.n IS NULL THEN '' ELSE ' '||{plural('lst.n', 'coin line')}||'.' END AS counted,
  coalesce(plc.t, '') AS placed,
  CASE WHEN lst.n IS NULL THEN '' ELSE ' '||({q('lst.n')})||' coin line'||CASE WHEN lst.n>1 THEN 's' ELSE '' END
    ||' at row'||CASE WHEN lst.n>1 THEN 's' ELSE '' END||' '||lst.t||'.' END AS listed
FROM ids LEFT JOIN plc USING (scene_id) LEFT JOIN lst USING (scene_id)"""

SOLID_LABELS = BASE + """,
blk AS (SELECT scene_id, c, r*16+c AS i FROM cells WHERE solid AND NOT pipe),
reach AS (
  SELECT scene_id, i, i AS lab FROM blk
  UNION SELECT b.scene_id, f.i, b.lab FROM reach b JOIN blk f ON f.scene_id=b.scene_id AND f.i>b.lab
    AND ((f.i=b.i+1 AND f.c>0) OR (f.i=b.i-1 AND f.c<15) OR f.i=b.i+16 OR f.i=b.i-16))
SELECT scene_id, i, min(lab) AS lab FROM reach GROUP BY scene_id, i"""

PROVENANCE = BASE + """,
ev AS (
  SELECT scene_id, 'floor' AS topic, r, c FROM cells JOIN floorrows USING (scene_id, r)
  UNION ALL SELECT scene_id, 'ceiling', r, c FROM cells JOIN ceilrows USING (scene_id, r)
  UNION ALL SELECT scene_id, CASE ch WHEN 'E' THEN 'enemy' WHEN 'B' THEN 'cannon' WHEN 'o' THEN 'coin'
    ELSE 'question block' END, r, c FROM cells WHERE ch IN ('E','B','o','Q','?')
  UNION ALL SELECT scene_id, 'coin line', r, c FROM near WHERE r<15 AND ch='o' AND (lf='o' OR rt='o')
  UNION ALL SELECT scene_id, 'platform', r, unnest(range(c0, c1+1)) FROM platruns
  UNION ALL SELECT DISTINCT b.scene_id, s.kind||' staircase', b.r, b.c FROM (
      SELECT kind, scene_id, CAST(r+v*j AS INT) AS r, CAST(c+j AS INT) AS c
      FROM stairs, LATERAL (SELECT unnest(range(0, n)) AS j) WHERE r+v*j>0) s
    JOIN vrun a USING (scene_id, r, c)
    JOIN vrun b ON b.scene_id=a.scene_id AND b.c=a.c AND b.g=a.g AND b.r>=a.r
  UNION ALL SELECT scene_id, 'loose block', r, c FROM cells ANTI JOIN claimed USING (scene_id, r, c)
    ANTI JOIN (SELECT l.scene_id, i//16 AS r, i%16 AS c FROM blocklab l JOIN blockbox USING (scene_id, lab)) b
    USING (scene_id, r, c) WHERE ch IN ('X','S')
  UNION ALL SELECT scene_id, kind, i//16, i%16 FROM pipelab JOIN pipekind USING (scene_id, lab)
  UNION ALL SELECT scene_id, kind, i//16, i%16 FROM blocklab JOIN blockkind USING (scene_id, lab))
SELECT scene_id, topic, count(*) AS cells, min(r*16+c) AS first_cell, max(r*16+c) AS last_cell
FROM ev GROUP BY scene_id, topic"""

QUERIES = {
    "c10_explode_cells": (explode_cells, BASE + f"""
SELECT r, c, instr('{P.alphabet}', ch) - 1 AS tile, count(*) AS n FROM fx_cells GROUP BY ALL"""),
    "d01_count_tiles": (
        _feature(enemies=lambda: D.count_tiles(F.col("rows"), P, "E"),
                 solids=lambda: D.count_tiles(F.col("rows"), P, P.having("solid")),
                 coins_off_floor=lambda: D.count_tiles(
                     F.col("rows"), P, "o", exclude=F.transform(
                         F.col("rows"), lambda row, r: F.when(
                             r == F.size(F.col("rows")) - 1, G.whole_row(F.length(row))).otherwise(
                             F.lit(0).cast("bigint"))))),
        BASE + f"""SELECT scene_id, count(*) FILTER (ch='E') AS enemies, count(*) FILTER (ch IN {SOLID})
        AS solids, count(*) FILTER (ch='o' AND r<15) AS coins_off_floor FROM cells GROUP BY scene_id"""),
    "d02_quantity_bucket": (
        _feature(quantity=lambda: quantity(D.count_tiles(F.col("rows"), P, "o")),
                 size=lambda: size_word(D.count_tiles(F.col("rows"), P, "o"))),
        BASE + f"""SELECT scene_id, {q('coins')} AS quantity,
        CASE WHEN coins<=4 THEN 'small' ELSE 'big' END AS size FROM counts"""),
    "d03_count_phrase": (
        _feature(phrase=lambda: count_phrase(D.count_tiles(F.col("rows"), P, "E"), "enemy", "enemies", True)),
        BASE + f"""SELECT scene_id, CASE WHEN enemies=0 THEN ' no enemies.' ELSE ' '||({q('enemies')})||
        CASE WHEN enemies>1 THEN ' enemies.' ELSE ' enemy.' END END AS phrase FROM counts"""),
    "d04_floor_class": (_feature(floor_text=lambda: D.floor_phrase(F.col("rows"), P)),
                        BASE + "SELECT scene_id, floor_text FROM floors"),
    "d05_ceiling_class": (ceiling_rows, BASE + "SELECT scene_id, r, t AS ceiling_text FROM ceils"),
    "d06_ceiling_search": (ceiling_search, BASE + """
SELECT scene_id, cr AS ceiling_row, ceiling_text FROM ceiling"""),
    "d07_double_floor": (
        _feature(floor_rows=lambda: F.size(D.floor_rows(F.col("rows")))),
        BASE + "SELECT scene_id, count(*) AS floor_rows FROM floorrows GROUP BY scene_id"),
    "d08_horizontal_runs": (coin_runs, COIN_RUNS + "SELECT scene_id, r, c0, c1 FROM coinruns"),
    "d08_platform_runs": (
        _shapes(lambda df: df.select("scene_id", F.explode_outer(
            G.runs_of(F.col("platform_bits"), 1)).alias("x")).where("x IS NOT NULL").select(
            "scene_id", F.col("x.line").alias("r"), F.col("x.first").alias("c0"),
            F.col("x.last").alias("c1"))),
        BASE + "SELECT scene_id, r, c0, c1 FROM platruns"),
    "d10_describe_runs": (described_runs, DESCRIBED),
    "d11_location_bucket": (tile_places, BASE + f"""
SELECT {_location_sql('c', 'r')} AS place, count(*) AS n FROM cells WHERE ch='E' GROUP BY 1"""),
    "d12_broken_cannons": (_feature(broken=lambda: D.broken_cannons(F.col("rows"), P)),
                           BASE + "SELECT scene_id, broken FROM counts"),
    "d13_staircases": (_shapes(_stairs), BASE + "SELECT scene_id, kind, c, r, n FROM stairs"),
    "d14_components": (solid_labels, SOLID_LABELS),
    "d14_pipe_components": (pipe_boxes, BASE + "SELECT scene_id, lab, r0, r1, c0, n FROM pipebox"),
    "d15_pipe_class": (_kinds("pipe_kinds", "pipes"),
                       BASE + "SELECT scene_id, lab, kind FROM pipekind"),
    "d16_structure_class": (_kinds("block_kinds", "blocks"),
                            BASE + "SELECT scene_id, lab, kind FROM blockkind"),
    "d17_loose_blocks": (_shapes(_loose), BASE + """
SELECT scene_id, coalesce(n, 0) AS n FROM ids LEFT JOIN loose USING (scene_id)"""),
    "d18_assign_caption": (caption, captions() + "SELECT scene_id, caption FROM captions"),
    "d18_phrase_provenance": (provenance, PROVENANCE),
    "d30_absence_phrases": (caption_with_absence,
                            captions(True) + "SELECT scene_id, caption FROM captions"),
    "caption_frequency": (caption_counts, captions() + """
SELECT caption, count(*) AS n FROM captions GROUP BY caption ORDER BY n DESC, caption"""),
}
