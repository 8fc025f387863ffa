"""Whole captions for platformer scenes, and which cells each phrase is about."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from scenewright.functions import grid as G
from scenewright.functions.binding import let
from scenewright.functions.quantity import (
    count_phrase,
    describe_runs,
    lines_phrase,
    location,
    quantity,
)
from scenewright.games import PLATFORMER, Game
from scenewright.operators import features as D
from scenewright.operators import shapes
from scenewright.operators.components import components
from scenewright.operators.pipes import PIPE_TILES, pipe_kind, structure_kind, with_pipe_lips
from scenewright.operators.stairs import staircase_bits, with_staircases


def structure_text(kinds: Column, absent: list[str]) -> Column:
    """`` one tower. two pipes.`` in order of first appearance, then absences."""

    def said(kind: Column) -> Column:
        n = F.size(F.filter(kinds, lambda k: k == kind))
        noun = F.regexp_replace(kind, "(pipe|tower|cluster)(?= at |$)", "$1s")
        return F.when(n == 1, F.concat(F.lit(" one "), kind, F.lit("."))).otherwise(
            F.concat(F.lit(" "), quantity(n), F.lit(" "), noun, F.lit(".")))

    out = F.array_join(F.transform(F.array_distinct(kinds), said), "")
    for name in absent:
        out = F.concat(
            out, F.when(F.array_contains(kinds, name), "").otherwise(f" no {name}s."))
    return out


# Width of the scene at hand, as SQL.
WIDTH_SQL = "length(rows[0])"


def placed(kind: Column, comp: Column, game: Game, where: str | None) -> Column:
    if where is None:
        return kind
    if where == "coarse":
        return F.concat(kind, F.lit(" at "), location(
            (comp["left"] + comp["right"]) / 2.0, (comp["top"] + comp["bottom"]) / 2.0, game))
    text = lambda name: comp[name].cast("string")
    return F.concat(kind, F.lit(" from row "), text("top"), F.lit(" to "), text("bottom"),
                    F.lit(", columns "), text("left"), F.lit(" to "), text("right"))


def with_shapes(scenes: DataFrame, absence: bool = False, where: str | None = None,
                game: Game = PLATFORMER) -> DataFrame:
    """Add every bitmap, run list and component list the captions are made of."""
    rows = F.col("rows")
    whole = G.whole_row(F.length(rows[0]))
    df = G.with_tile_bitmaps(scenes, game, {f"_is_{name}": chars for name, chars in {
        "solid": game.having("solid"), "pipe": game.having("pipe"),
        "block": game.having("solid", without=("pipe",)), "coin": game.having("coin"),
        "cannon": "B", "support": "b", "any_cannon": "Bb", "loose": "XS",
        "no_right": ">]", "no_left": "<[", **PIPE_TILES}.items()})
    tile = lambda name: F.col(f"_is_{name}")
    df = df.withColumns({
        "solid_bits": tile("solid"), "pipe_bits": tile("pipe"), "loose_bits": tile("loose"),
        "n_broken": D.broken_supports(tile("support"), tile("any_cannon")),
        "floor_lines": D.floor_rows(rows),
    })
    df = D.with_ceiling(df, game, absence)
    platform = G.without_rows(G.clear_above_and_below(tile("block"), F.col("solid_bits")), F.when(
        F.col("ceiling_row").isNull(), F.array().cast("array<int>")).otherwise(
        F.array("ceiling_row")))
    coins = F.concat(F.slice(tile("coin"), F.lit(1), F.size(rows) - 1),
                     F.array(F.lit(0).cast("bigint")))
    df = df.withColumn("coin_run_bits", F.transform(coins, lambda b: G.run_mask(b, 2))).withColumn(
        "platform_bits", F.transform(platform, lambda b: G.run_mask(b, 2)))
    df = with_staircases(df, "up_stairs", -1, width=WIDTH_SQL)
    df = with_staircases(df, "down_stairs", 1, width=WIDTH_SQL)
    solid = F.col("solid_bits")
    df = df.withColumn("up_bits", staircase_bits(F.col("up_stairs"), solid, -1)).withColumn(
        "down_bits", staircase_bits(F.col("down_stairs"), solid, 1))
    floor = F.transform(
        rows,
        lambda row, r: F.when(F.array_contains(F.col("floor_lines"), r), whole).otherwise(
            F.lit(0).cast("bigint")))
    df = df.withColumn("floor_bits", floor).withColumn(
        "claimed_bits",
        G.or_rows(F.col("floor_bits"), F.col("ceiling_bits"), F.col("platform_bits"),
                  F.col("up_bits"), F.col("down_bits"), tile("cannon")))
    df = df.withColumn(
        "free_bits", G.minus_rows(G.minus_rows(solid, F.col("pipe_bits")), F.col("claimed_bits")))
    df = df.withColumn(
        "_pipes", components(F.col("pipe_bits"), F.length(rows[0]), tile("no_right"),
                             tile("no_left"))
    ).withColumn("_blocks", components(F.col("free_bits"), F.length(rows[0]), min_cells=3))
    df = df.withColumns({"pipes": F.col("_pipes.boxes"), "blocks": F.col("_blocks.boxes"),
                         "block_bits": F.col("_blocks.bits")})
    df = with_pipe_lips(df, {name: tile(name) for name in PIPE_TILES})
    # Bound outside the inner lambdas so that they are computed once per scene.
    lips = F.struct(F.col("lips_down").alias("down"), F.col("lips_up").alias("up"))
    edges = F.struct(F.col("ceiling_row").alias("ceiling"),
                     F.array_min("floor_lines").alias("floor"))
    return df.withColumns({
        "pipe_kinds": let(lips, lambda at: F.transform("pipes", lambda p: placed(
            pipe_kind(p, at["down"], at["up"]), p, game, where))),
        "block_kinds": let(edges, lambda at: F.transform("blocks", lambda b: placed(
            structure_kind(b, at["ceiling"], at["floor"]), b, game, where))),
    })


def platformer_caption(scenes: DataFrame, absence: bool = False, where: str | None = None,
                       game: Game = PLATFORMER, upside_down: bool = True) -> DataFrame:
    """Add ``caption`` to a frame with ``rows``; other columns pass through.

    ``absence`` also says what is missing, ``where`` adds places (``"coarse"``
    or ``"exact"``). ``upside_down=False`` never mentions missing upside-down
    pipes and fails if one is present.
    """
    kept = scenes.columns
    if where is None:  # the same rules for a batch of scenes at a time
        @F.arrow_udf("string")
        def caption_of(rows: pa.Array) -> pa.Array:
            return shapes.captions(rows, game, absence, upside_down)

        return scenes.select(*kept, caption_of("rows").alias("caption"))
    return _placed_caption(scenes, absence, where, game, upside_down)


def _placed_caption(scenes: DataFrame, absence: bool, where: str | None, game: Game, upside_down: bool) -> DataFrame:
    """The caption from column expressions, which also say where things are."""
    kept = scenes.columns
    df = with_shapes(scenes, absence, where, game)
    rows = F.col("rows")

    def tiles(chars: str, one: str, many: str) -> Column:
        return count_phrase(D.count_tiles(rows, game, chars), one, many, absence)

    def runs(bits: str, label: str) -> Column:
        if where is None:
            return lines_phrase(G.total_runs(F.col(bits)), label, absence)
        return describe_runs(G.runs_of(F.col(bits), 1), label, game, absence, where)

    def stairs(name: str, kind: str) -> Column:
        n = F.size(name)
        return F.when(n == 0, "").otherwise(
            F.concat(F.lit(" "), quantity(n), F.lit(f" {kind} staircase"),
                     F.when(n > 1, "s").otherwise(""), F.lit(".")))

    df = df.withColumn("floor_text", D.floor_phrase(rows, game, absence))
    floor = F.col("floor_text")
    loose = G.bit_total(G.minus_rows(
        G.minus_rows(F.col("loose_bits"), F.col("claimed_bits")), F.col("block_bits")))
    pipe_text = structure_text(
        F.col("pipe_kinds"),
        (["pipe", "upside down pipe"] if upside_down else ["pipe"]) if absence else [])
    if not upside_down:
        pipe_text = F.when(
            F.exists("pipe_kinds", lambda k: k.startswith("upside down pipe")),
            F.raise_error(F.lit("upside down pipes were excluded but occur in the data")),
        ).otherwise(pipe_text)
    absent_stairs = F.lit("")
    if absence:
        absent_stairs = F.concat(
            F.when(F.size("up_stairs") == 0, " no ascending staircases.").otherwise(""),
            F.when(F.size("down_stairs") == 0, " no descending staircases.").otherwise(""))
    caption = F.concat(
        F.when(floor == "", "").otherwise(F.concat(floor, F.lit("."))),
        F.col("ceiling_text"),
        tiles("E", "enemy", "enemies"),
        tiles("Q?", "question block", "question blocks"),
        tiles("B", "cannon", "cannons"),
        count_phrase(F.col("n_broken"), "broken cannon", "broken cannons"),
        tiles("o", "coin", "coins"),
        runs("coin_run_bits", "coin line"),
        runs("platform_bits", "platform"),
        stairs("up_stairs", "ascending"),
        stairs("down_stairs", "descending"),
        absent_stairs,
        pipe_text,
        structure_text(
            F.col("block_kinds"),
            ["tower", "rectangular block cluster", "irregular block cluster"] if absence else []),
        count_phrase(loose, "loose block", "loose blocks", absence),
    )
    return df.select(*kept, F.trim(caption).alias("caption"))


def phrase_cells(scenes: DataFrame, key: str = "scene_id", game: Game = PLATFORMER) -> DataFrame:
    """Cells each kind of phrase is about: ``key, topic, r, c``."""
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from shapes.cells(batch, game)

    schema = StructType([scenes.schema[key], StructField("topic", StringType()), StructField("r", IntegerType()),
                         StructField("c", IntegerType())])
    return scenes.select(key, "rows").mapInArrow(cells, schema)
