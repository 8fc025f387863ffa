"""Whole captions for ladder-game scenes (32 x 32)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewright.functions import grid as G
from scenewright.functions.binding import let
from scenewright.functions.quantity import count_phrase, describe_runs, quantity
from scenewright.games import LADDER, Game
from scenewright.operators import features as D
from scenewright.operators import shapes
from scenewright.operators.captioner import placed, structure_text
from scenewright.operators.components import component_labels, components
from scenewright.operators.pipes import structure_kind

SKY_ROWS = 10  # rows on top that never belong to an empty area


def _heights(bits: Column, low: int, high: int) -> Column:
    return F.filter(G.runs_of(bits, 1), lambda run: (
        (run["last"] - run["first"] + 1) >= low) & ((run["last"] - run["first"] + 1) <= high))


def with_ladder_shapes(scenes: DataFrame, game: Game = LADDER) -> DataFrame:
    """Add the bitmaps, run lists and components the ladder captions are made of."""
    rows = F.col("rows")
    df = G.with_tile_bitmaps(scenes, game, {
        "_gold": game.having("gold"), "_rope": game.having("rope"),
        "_ladder": game.having("ladder"), "_solid": game.having("solid"),
        "_empty": game.having("empty")})
    inner = lambda bits: G.without_rows(bits, F.array(F.size(bits) - 1))
    below_sky = F.transform("_empty", lambda b, r: F.when(r < SKY_ROWS, F.lit(0).cast("bigint"))
                            .otherwise(b))
    return df.withColumns({
        "gold_line_bits": F.transform(inner(F.col("_gold")), lambda b: G.run_mask(b, 2)),
        "rope_bits": inner(F.col("_rope")),
        "ladder_columns": G.class_bits(G.columns(rows), game, game.having("ladder")),
        "ladder_pair_bits": F.transform(inner(F.col("_ladder")), lambda b: G.run_mask(b, 2)),
        "_blocks": components(F.col("_solid"), F.length(rows[0])),
        "_areas": components(below_sky, F.length(rows[0])),
    })


def cluster_count(ladder: Column, pairs: Column, width: int | Column) -> Column:
    """Ladder components with two ladder tiles side by side above the last row."""
    width = F.lit(width) if isinstance(width, int) else width
    labels = component_labels(ladder, width)
    at_pairs = F.zip_with(
        labels, F.flatten(F.transform(pairs, lambda b: F.transform(
            F.sequence(F.lit(0), width - 1), lambda c: F.getbit(b, c)))),
        lambda label, on: F.when(on == 1, label))
    return F.size(F.array_distinct(F.array_compact(at_pairs)))


def area_kinds(areas: Column, height: Column, width: Column) -> Column:
    """``STRUCT<chambers, open>`` counts: a chamber touches no border of the scene."""
    touches = lambda a: ((a["top"] == 0) | (a["bottom"] == height - 1)
                         | (a["left"] == 0) | (a["right"] == width - 1))
    return F.struct(F.size(F.filter(areas, lambda a: ~touches(a))).alias("chambers"),
                    F.size(F.filter(areas, touches)).alias("open"))


def ladder_caption(scenes: DataFrame, absence: bool = False, where: str | None = None,
                   game: Game = LADDER) -> DataFrame:
    """Add ``caption`` to a frame with ``rows``."""
    kept = scenes.columns
    if where is None:  # the same rules for a batch of scenes at a time
        @F.arrow_udf("string")
        def caption_of(rows: pa.Array) -> pa.Array:
            return shapes.ladder_captions(rows, game, absence, SKY_ROWS)

        return scenes.select(*kept, caption_of("rows").alias("caption"))
    return _placed_caption(scenes, absence, where, game)


def _placed_caption(scenes: DataFrame, absence: bool, where: str | None, game: Game) -> DataFrame:
    """The caption from column expressions, which also say where things are."""
    kept = scenes.columns
    df = with_ladder_shapes(scenes, game)
    rows = F.col("rows")
    df = df.withColumn("n_clusters", cluster_count(F.col("_ladder"), F.col("ladder_pair_bits"),
                                                   F.length(rows[0])))
    tiles = lambda chars: D.count_tiles(rows, game, chars)
    runs = lambda name: G.runs_of(F.col(name), 1)
    single_gold = G.bit_total(G.minus_rows(F.col("_gold"), F.col("gold_line_bits")))
    n_gold_lines = G.total_runs(F.col("gold_line_bits"))
    no_gold = F.when(n_gold_lines == 0, " no gold." if absence else "").otherwise("")
    upright = F.col("ladder_columns")

    def ladders(low: int, high: int, label: str) -> Column:
        return describe_runs(_heights(upright, low, high), label, game, absence, where,
                             vertical=True)

    def counted(n: Column, one: str, many: str) -> Column:
        return let(n, lambda k: F.when(k == 0, "").otherwise(
            F.concat(F.lit(" "), quantity(k), F.when(k == 1, f" {one}.").otherwise(f" {many}."))))

    def ground(ch: str, label: str) -> Column:
        return count_phrase(tiles(ch), label, label, absence)

    kinds = F.filter(
        F.transform("_blocks.boxes", lambda b: placed(
            structure_kind(b, F.lit(game.ceiling), F.lit(game.height - 1), towers=None), b, game,
            where)),
        lambda k: k.isNotNull())
    df = df.withColumns({
        "floor_text": D.floor_phrase(rows, game, absence), "block_kinds": kinds,
        "areas": area_kinds(F.col("_areas.boxes"), F.size(rows), F.length(rows[0])),
    })
    caption = F.concat(
        F.when(F.col("floor_text") == "", "").otherwise(F.concat("floor_text", F.lit("."))),
        count_phrase(tiles("E"), "enemy", "enemies", absence),
        describe_runs(runs("gold_line_bits"), "gold line", game, absence, where),
        let(single_gold, lambda n: F.when(n > 0, count_phrase(n, "gold", "gold")).otherwise(no_gold)),
        describe_runs(runs("rope_bits"), "rope", game, absence, where),
        counted(F.col("n_clusters"), "ladder cluster", "ladder clusters"),
        ladders(1, 1, "lone ladder tile"), ladders(2, 4, "short ladder"),
        ladders(5, game.height, "tall ladder"),
        structure_text(F.col("block_kinds"), ["rectangular block cluster",
                                              "irregular block cluster"] if absence else []),
        ground("B", "solid ground"), ground("b", "diggable ground"),
        counted(F.col("areas.chambers"), "chamber", "chambers"),
        counted(F.col("areas.open"), "empty background area", "empty background areas"),
    )
    return df.select(*kept, F.trim(caption).alias("caption"))
