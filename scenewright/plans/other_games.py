"""Queries over ladder-game and directional-game scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright import fixtures as X
from scenewright.functions import grid as G
from scenewright.functions.quantity import describe_runs
from scenewright.games import DIRECTIONAL as DG
from scenewright.games import LADDER as LG
from scenewright.operators import directional_captioner as DC
from scenewright.operators import features as D
from scenewright.operators import ladder_captioner as LC
from scenewright.plans.platformer_sql import plural, q, said

DIRECTIONS = ["UP", "RIGHT", "DOWN", "LEFT", "left", "right"]


def _ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.scenes(spark, sf_dir, "ladder").select("scene_id", "rows")


def _directional(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(d) for d in DIRECTIONS])
    return X.scenes(spark, sf_dir, "directional").select(
        "scene_id", "rows", F.get(names, (F.col("scene_id") % 4).cast("int")).alias("entrance"),
        F.get(names, (F.floor(F.col("scene_id") / 4) % 6).cast("int")).alias("exit"))


def vertical_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = D.vertical_run_bits(F.col("rows"), LG, "ladder", 2)
    runs = _ladder(spark, sf_dir).select("scene_id", F.explode_outer(G.runs_of(bits, 1)).alias("x"))
    return runs.where("x IS NOT NULL").select(
        "scene_id", F.col("x.line").alias("c"), F.col("x.first").alias("r0"),
        F.col("x.last").alias("r1"))


def _ladder_shapes(select):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return select(LC.with_ladder_shapes(_ladder(spark, sf_dir)))
    return run


def _directional_feature(**columns):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _directional(spark, sf_dir).select(
            "scene_id", *[make().alias(k) for k, make in columns.items()])
    return run


def ladder_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LC.ladder_caption(_ladder(spark, sf_dir)).select("scene_id", "caption")


def ladder_rope_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = LC.with_ladder_shapes(_ladder(spark, sf_dir))
    return shapes.select("scene_id", describe_runs(
        G.runs_of(F.col("rope_bits"), 1), "rope", LG).alias("ropes"))


def directional_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DC.directional_caption(_directional(spark, sf_dir), F.col("entrance"),
                                  F.col("exit")).select("scene_id", "caption")


def directional_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    walls = DC.walls_of()
    others = "".join(c for c in DG.alphabet if c not in walls)
    return _directional(spark, sf_dir).select(
        "scene_id", D.wall_floor_phrase(F.col("rows"), walls).alias("floor"),
        D.ceiling_phrase(F.col("rows")[2], DG, walls, others).alias("ceiling"))


def directional_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = DC.with_directional_shapes(_directional(spark, sf_dir), F.col("exit"))
    return shapes.select("scene_id", G.total_runs(F.col("moving_bits")).alias("moving"),
                         G.total_runs(F.col("platform_bits")).alias("platforms"))


LBASE = "WITH RECURSIVE " + X.scene_sql("ladder") + f""",
ids AS (SELECT scene_id FROM fx_grid),
cells AS (SELECT scene_id, r, c, ch, r*32+c AS i, ch IN ('B','b') AS solid, ch IN ('.','-','#','G','M') AS pass FROM fx_cells),
near AS (SELECT *, lag(ch) OVER h AS lf, lead(ch) OVER h AS rt FROM cells WINDOW h AS (PARTITION BY scene_id, r ORDER BY c)),
counts AS (
  SELECT scene_id, count(*) FILTER (ch='E') AS enemies, count(*) FILTER (ch='G') AS gold,
    count(*) FILTER (ch='B') AS nb, count(*) FILTER (ch='b') AS nd,
    count(*) FILTER (r<31 AND ch='G' AND coalesce(lf,'')<>'G' AND rt='G') AS gold_lines,
    count(*) FILTER (r<31 AND ch='G' AND (lf='G' OR rt='G')) AS gold_in_lines,
    count(*) FILTER (r<31 AND ch='-' AND coalesce(lf,'')<>'-') AS ropes
  FROM near GROUP BY scene_id),
floors AS (
  SELECT scene_id, CASE WHEN ns=32 THEN 'full floor.' WHEN np=32 THEN ''
    WHEN ns>np THEN 'floor with '||{plural('gaps', 'gap')}||'.'
    ELSE 'giant gap with '||{plural('chunks', 'chunk')}||' of floor.' END AS floor_text
  FROM (SELECT scene_id, count(*) FILTER (solid) AS ns, count(*) FILTER (pass) AS np,
      count(*) FILTER ((pass OR ch='E') AND NOT coalesce(lf NOT IN ('B','b'), false)) AS gaps,
      count(*) FILTER (solid AND NOT coalesce(lf IN ('B','b'), false)) AS chunks
    FROM near WHERE r=31 GROUP BY scene_id)),
lad0 AS (SELECT *, r-row_number() OVER (PARTITION BY scene_id, c ORDER BY r) AS g FROM cells WHERE ch='#'),
lads AS (SELECT scene_id, c, min(r) AS r0, max(r) AS r1, count(*) AS h FROM lad0 GROUP BY scene_id, c, g),
ladn AS (SELECT scene_id, count(*) FILTER (h=1) AS n1, count(*) FILTER (h BETWEEN 2 AND 4) AS n2,
  count(*) FILTER (h>=5) AS n5 FROM lads GROUP BY scene_id)
"""

_in = lambda chars: "(" + ",".join(f"'{c}'" for c in chars) + ")"
_WALL = _in(DC.walls_of())
_SOLID = _in(DG.having("solid"))
DBASE = "WITH RECURSIVE " + X.scene_sql("directional") + f""",
ids AS (SELECT scene_id, ['UP','RIGHT','DOWN','LEFT'][CAST(scene_id % 4 AS INT) + 1] AS entr,
  ['UP','RIGHT','DOWN','LEFT','left','right'][CAST((scene_id // 4) % 6 AS INT) + 1] AS ext FROM fx_grid),
cells AS (SELECT scene_id, r, c, ch, r*16+c AS i, ch IN {_SOLID} AS solid, ch IN {_WALL} AS wall FROM fx_cells),
near AS (SELECT *, lag(wall) OVER h AS lfw, lag(ch) OVER v AS up,
  coalesce(lag(solid) OVER v, false) AS sup, coalesce(lead(solid) OVER v, false) AS sdn
  FROM cells WINDOW h AS (PARTITION BY scene_id, r ORDER BY c), v AS (PARTITION BY scene_id, c ORDER BY r)),
counts AS (
  SELECT scene_id, count(*) FILTER (ch IN {_in(DG.having('enemy'))}) AS enemies,
    count(*) FILTER (ch IN {_in(DG.having('powerup'))}) AS powerups, count(*) FILTER (ch IN {_in(DG.having('hazard'))}) AS hazards,
    count(*) FILTER (ch='A') AS fading, count(*) FILTER (ch IN {_in(DG.having('empty'))}) AS empties,
    count(*) FILTER (ch='~') AS water, count(*) FILTER (ch='|' AND coalesce(up,'')<>'|') AS ladders
  FROM near GROUP BY scene_id),
rowstat AS (SELECT scene_id, r, count(*) FILTER (wall) AS ns, count(*) FILTER (NOT wall AND coalesce(lfw, true)) AS gaps,
  count(*) FILTER (wall AND NOT coalesce(lfw, false)) AS chunks FROM near GROUP BY scene_id, r),
floors AS (SELECT scene_id, CASE WHEN ns=16 THEN ' full floor.' WHEN ns=0 THEN ''
  WHEN ns>8 THEN ' floor with '||{plural('gaps', 'gap')}||'.'
  ELSE ' giant gap with '||{plural('chunks', 'chunk')}||' of floor.' END AS floor_text FROM rowstat WHERE r=15),
ceils AS (SELECT scene_id, CASE WHEN ns=16 THEN ' full ceiling.'
  WHEN ns>8 THEN ' ceiling with '||{plural('gaps', 'gap')}||'.' ELSE '' END AS ceiling_text FROM rowstat WHERE r=2),
wrun AS (SELECT scene_id, c FROM (SELECT scene_id, c, r-row_number() OVER (PARTITION BY scene_id, c ORDER BY r) AS g
  FROM cells WHERE wall) GROUP BY scene_id, c, g HAVING count(*)>=3),
walln AS (SELECT scene_id, count(DISTINCT c) AS n FROM wrun GROUP BY scene_id),
clear AS (SELECT n.scene_id, r, c, i, ch IN {_in(DG.having('moving'))} AS moving, solid FROM near n JOIN ids USING (scene_id)
  WHERE r BETWEEN 1 AND 14 AND NOT sup AND NOT sdn AND NOT (ext IN ('left','right') AND r=2)),
mov AS (SELECT *, c-row_number() OVER (PARTITION BY scene_id, r ORDER BY c) AS g FROM clear WHERE moving),
sol AS (SELECT *, c-row_number() OVER (PARTITION BY scene_id, r ORDER BY c) AS g FROM clear WHERE solid),
solrun AS (SELECT scene_id, r, g, min(c) AS c0, max(c) AS c1 FROM sol GROUP BY scene_id, r, g HAVING count(*)>=2),
plats AS (SELECT i.scene_id, coalesce(m.n,0) AS moving, coalesce(p.n,0) AS platforms FROM ids i
  LEFT JOIN (SELECT scene_id, count(DISTINCT (r,g)) AS n FROM mov GROUP BY 1) m USING (scene_id)
  LEFT JOIN (SELECT scene_id, count(*) AS n FROM solrun GROUP BY 1) p USING (scene_id)),
claimed AS (SELECT scene_id, i FROM mov UNION SELECT s.scene_id, s.i FROM sol s JOIN solrun USING (scene_id, r, g)
  UNION SELECT scene_id, i FROM cells WHERE ch='|'),
free AS (SELECT scene_id, i, c FROM cells ANTI JOIN claimed USING (scene_id, i) WHERE solid),
reach AS (
  SELECT scene_id, i, i AS lab FROM free
  UNION SELECT b.scene_id, f.i, b.lab FROM reach b JOIN free f ON f.scene_id=b.scene_id AND f.i>b.lab
    AND ((f.i=b.i+1 AND f.c>0) OR (f.i=b.i-1 AND f.c<15) OR f.i=b.i+16 OR f.i=b.i-16)),
lab AS (SELECT scene_id, i, min(lab) AS lab FROM reach GROUP BY scene_id, i),
big AS (SELECT scene_id, i FROM (SELECT *, count(*) OVER (PARTITION BY scene_id, lab) AS n FROM lab) WHERE n>=3),
loose AS (SELECT scene_id, count(*) AS n FROM cells ANTI JOIN claimed USING (scene_id, i) ANTI JOIN big USING (scene_id, i)
  WHERE wall GROUP BY scene_id)
"""
WATER = ("CASE WHEN empties=0 OR water=0 THEN '' WHEN water/empties<0.35 THEN ' some water.' "
         "WHEN water/empties<0.65 THEN ' half water.' WHEN water<>empties THEN ' mostly water.' "
         "ELSE ' all water.' END")
DCAP = DBASE + f"""
SELECT i.scene_id, trim(' entrance direction '||lower(entr)||'. exit direction '||lower(ext)||'.'
  || {said('enemies', 'enemy', 'enemies')} || {said('powerups', 'powerup', 'powerups')} || {said('hazards', 'hazard', 'hazards')}
  || {said('fading', 'dissapearing block', 'dissapearing blocks')} || {WATER}
  || CASE WHEN ext IN ('left','right') THEN ceiling_text ELSE '' END || floor_text
  || {said('coalesce(walln.n,0)', 'wall', 'walls')} || {said('moving', 'moving platform', 'moving platforms')}
  || {said('platforms', 'platform', 'platforms')} || {said('ladders', 'ladder', 'ladders')}
  || {said('coalesce(loose.n,0)', 'loose block', 'loose blocks')}) AS caption
FROM ids i JOIN counts USING (scene_id) JOIN floors USING (scene_id) JOIN ceils USING (scene_id) JOIN plats USING (scene_id)
LEFT JOIN walln USING (scene_id) LEFT JOIN loose USING (scene_id)"""

QUERIES = {
    "d09_vertical_runs": (vertical_runs, LBASE + "SELECT scene_id, c, r0, r1 FROM lads WHERE h>=2"),
    "d19_gold_split": (
        _ladder_shapes(lambda df: df.select(
            "scene_id", G.total_runs(F.col("gold_line_bits")).alias("lines"),
            G.bit_total(G.minus_rows(F.col("_gold"), F.col("gold_line_bits"))).alias("singles"))),
        LBASE + "SELECT scene_id, gold_lines AS lines, gold-gold_in_lines AS singles FROM counts"),
    "d20_ropes": (ladder_rope_lines, LBASE + f"""
SELECT scene_id, {said('ropes', 'rope', 'ropes')} AS ropes FROM counts"""),
    "d21_ladders": (
        _ladder_shapes(lambda df: df.select(
            "scene_id", *[F.size(LC._heights(F.col("ladder_columns"), low, high)).alias(name)
                          for name, low, high in (("lone", 1, 1), ("short", 2, 4), ("tall", 5, 32))])),
        LBASE + """SELECT i.scene_id, coalesce(n1,0) AS lone, coalesce(n2,0) AS short, coalesce(n5,0) AS tall
        FROM ids i LEFT JOIN ladn USING (scene_id)"""),
    "d21_ladder_clusters": (
        _ladder_shapes(lambda df: df.select("scene_id", LC.cluster_count(
            F.col("_ladder"), F.col("ladder_pair_bits"), 32).alias("clusters"))),
        None),
    "d22_ground_counts": (
        lambda spark, sf_dir: _ladder(spark, sf_dir).select(
            "scene_id", D.count_tiles(F.col("rows"), LG, "B").alias("solid"),
            D.count_tiles(F.col("rows"), LG, "b").alias("diggable")),
        LBASE + "SELECT scene_id, nb AS solid, nd AS diggable FROM counts"),
    "d23_chambers": (
        _ladder_shapes(lambda df: df.select(
            "scene_id", LC.area_kinds(F.col("_areas.boxes"), 32, 32).alias("a")).select(
            "scene_id", "a.chambers", F.col("a.open").alias("areas"))),
        None),
    "d24_assign_caption_ladder": (ladder_caption, None),
    "d25_water_ratio": (
        _directional_feature(water=lambda: D.water_phrase(F.col("rows"))),
        DBASE + f"SELECT scene_id, {WATER} AS water FROM counts"),
    "d26_wall_floor_ceiling": (directional_surfaces, DBASE + """
SELECT scene_id, floor_text AS floor, ceiling_text AS ceiling FROM floors JOIN ceils USING (scene_id)"""),
    "d27_walls": (
        _directional_feature(walls=lambda: D.wall_columns(F.col("rows"), DC.walls_of())),
        DBASE + "SELECT scene_id, coalesce(n,0) AS walls FROM ids LEFT JOIN walln USING (scene_id)"),
    "d28_platforms": (directional_platforms,
                      DBASE + "SELECT scene_id, moving, platforms FROM plats"),
    "d29_assign_caption_directional": (directional_caption, DCAP),
}
