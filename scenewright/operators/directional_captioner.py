"""Whole captions for directional-game scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewright.functions import grid as G
from scenewright.functions.binding import let
from scenewright.functions.quantity import count_phrase, describe_runs, lines_phrase
from scenewright.games import DIRECTIONAL, Game
from scenewright.operators import features as D
from scenewright.operators.components import components

CEILING_ROW = 2


def walls_of(game: Game = DIRECTIONAL) -> str:
    return game.having("solid", without=("penetrable", "hazard"))


def with_directional_shapes(scenes: DataFrame, exit_direction: Column | None = None,
                            game: Game = DIRECTIONAL) -> DataFrame:
    """Add bitmaps and claimed cells. The ceiling row counts only for scenes left
    to the side, that is when ``exit_direction`` is ``left`` or ``right``."""
    df = G.with_tile_bitmaps(scenes, game, {
        "_solid": game.having("solid"), "_moving": game.having("moving"),
        "_climb": game.having("climbable"), "_wall": walls_of(game)})
    sideways = F.lit(False) if exit_direction is None else F.coalesce(
        exit_direction.isin("left", "right"), F.lit(False))
    last = F.size("rows") - 1
    df = df.withColumn("_skip", F.when(sideways, F.array(F.lit(CEILING_ROW), last)).otherwise(
        F.array(last))).withColumn("_sideways", sideways)

    def clear_runs(bits: str, n: int) -> Column:
        clear = G.without_rows(G.clear_above_and_below(F.col(bits), F.col("_solid")),
                               F.col("_skip"))
        return F.transform(clear, lambda b: G.run_mask(b, n))

    df = df.withColumns({"moving_bits": clear_runs("_moving", 1),
                         "platform_bits": clear_runs("_solid", 2)})
    df = df.withColumn("claimed_bits", G.or_rows(
        F.col("moving_bits"), F.col("platform_bits"), F.col("_climb")))
    df = df.withColumn("_blocks", components(
        G.minus_rows(F.col("_solid"), F.col("claimed_bits")), F.length(F.col("rows")[0]), min_cells=3))
    return df.withColumn("loose_bits", G.minus_rows(
        G.minus_rows(F.col("_wall"), F.col("claimed_bits")), F.col("_blocks.bits")))


def directional_caption(scenes: DataFrame, entrance: Column | None = None,
                        exit_direction: Column | None = None, absence: bool = False,
                        where: str | None = None, strict_case: bool = True,
                        game: Game = DIRECTIONAL) -> DataFrame:
    """Add ``caption``.

    Stored directions are upper case, and only lower-case ``left``/``right``
    switch on ceiling phrases; ``strict_case=False`` compares without case.
    """
    kept = scenes.columns
    gate = None
    if exit_direction is not None:
        gate = exit_direction if strict_case else F.lower(exit_direction)
    df = with_directional_shapes(scenes, gate, game)
    rows = F.col("rows")
    walls = walls_of(game)

    def tiles(chars: str, one: str, many: str) -> Column:
        return count_phrase(D.count_tiles(rows, game, chars), one, many, absence)

    head = F.lit("")
    if entrance is not None:
        head = F.concat(F.lit(" entrance direction "), F.lower(entrance),
                        F.lit(". exit direction "), F.lower(exit_direction), F.lit("."))
    ceiling = F.when(F.col("_sideways"), D.ceiling_phrase(
        rows[CEILING_ROW], game, walls, "".join(c for c in game.alphabet if c not in walls),
        absence)).otherwise("")
    n_walls = D.wall_columns(rows, walls, game)
    n_ladders = G.total_runs(G.class_bits(G.columns(rows), game, game.having("climbable")))
    runs = lambda name: G.runs_of(F.col(name), 1)
    caption = F.concat(
        head,
        tiles(game.having("enemy"), "enemy", "enemies"),
        tiles(game.having("powerup"), "powerup", "powerups"),
        tiles(game.having("hazard"), "hazard", "hazards"),
        tiles("A", "dissapearing block", "dissapearing blocks"),
        D.water_phrase(rows, game, absence),
        ceiling,
        D.wall_floor_phrase(rows, walls, game, absence),
        let(n_walls, lambda n: F.when(n > 0, lines_phrase(n, "wall")).otherwise("")),
        describe_runs(runs("moving_bits"), "moving platform", game, absence, where),
        describe_runs(runs("platform_bits"), "platform", game, absence, where),
        lines_phrase(n_ladders, "ladder", absence),
        count_phrase(G.bit_total(F.col("loose_bits")), "loose block", "loose blocks", absence),
    )
    return df.select(*kept, F.trim(caption).alias("caption"))
