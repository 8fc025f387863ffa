"""Pipe and block-structure classes.

A pipe is read from its lip: the two columns must go on as lips or bodies until
the scene ends or a place without any pipe tile is reached. An upside-down pipe
is read upwards and must not end in an empty tile. At the left and right edge of
the scene half a pipe is enough. Row bitmaps let one pass over the rows decide
this for every column at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewright.functions import grid as G


def _continues(good: Column, stop: Column, downward: bool) -> Column:
    """For each row and column, may a pipe go on into the next row?

    ``good`` marks tiles that continue a pipe and ``stop`` all tiles that break
    one (``good`` included): row by row, a place holds when it is good and the
    place after it holds, or when it does not stop a pipe.
    """
    held = F.lit(-1).cast("bigint")
    steps = F.arrays_zip(good.alias("good"), stop.alias("stop"))

    def hold(x: Column, after: Column) -> Column:
        return x["good"].bitwiseAND(after).bitwiseOR(F.bitwise_not(x["stop"]))

    if downward:
        scan = F.aggregate(F.reverse(steps), F.array(held),
                           lambda acc, x: F.array_prepend(acc, hold(x, acc[0])))
        return F.slice(scan, 2, G.MAX_WIDTH)
    scan = F.aggregate(steps, F.array(held),
                       lambda acc, x: F.array_append(acc, hold(x, F.element_at(acc, -1))))
    return F.slice(scan, F.lit(1), F.size(scan) - 1)


PIPE_TILES = {"lip_left": "<", "lip_right": ">", "body_left": "[", "body_right": "]",
              "empty": "-"}


def with_pipe_lips(df: DataFrame, tiles: dict[str, Column]) -> DataFrame:
    """Add ``lips_down`` and ``lips_up``: where a valid pipe's lip may stand.

    ``tiles`` holds one bitmap column for each name in ``PIPE_TILES``.
    """
    both = lambda a, b: a.bitwiseAND(F.shiftright(b, 1))
    either = lambda a, b: a.bitwiseOR(b)
    spread = lambda m: m.bitwiseOR(F.shiftright(m, 1))
    df = df.withColumns({
        "_ll": tiles["lip_left"], "_lr": tiles["lip_right"], "_empty": tiles["empty"],
        "_left": F.zip_with(tiles["lip_left"], tiles["body_left"], either),
        "_right": F.zip_with(tiles["lip_right"], tiles["body_right"], either),
        "_lip": F.zip_with(tiles["lip_left"], tiles["lip_right"], both),
        "_body": F.zip_with(tiles["body_left"], tiles["body_right"], both),
    })
    df = df.withColumns({"_pair": F.zip_with("_lip", "_body", either),
                         "_stop_down": F.zip_with("_left", "_right", either)})
    df = df.withColumn("_stop_up", F.zip_with("_stop_down", "_empty", either))
    one = F.lit(1).cast("bigint")
    last = G.shift_left(one, F.length(F.col("rows")[0]) - 1)

    def lips(downward: bool) -> Column:
        stop = F.col("_stop_down" if downward else "_stop_up")
        wide = F.zip_with(
            "_lip", _continues(F.col("_pair"), F.transform(stop, spread), downward),
            lambda a, b: a.bitwiseAND(b).bitwiseAND(F.bitwise_not(last)))
        left = F.zip_with("_lr", _continues(F.col("_right"), stop, downward),
                          lambda a, b: a.bitwiseAND(b).bitwiseAND(one))
        right = F.zip_with("_ll", _continues(F.col("_left"), stop, downward),
                           lambda a, b: a.bitwiseAND(b).bitwiseAND(last))
        return G.or_rows(wide, left, right)

    return df.withColumns({"lips_down": lips(True), "lips_up": lips(False)}).drop(
        "_ll", "_lr", "_empty", "_left", "_right", "_lip", "_body", "_pair", "_stop_down",
        "_stop_up")


def pipe_kind(comp: Column, lips_down: Column, lips_up: Column) -> Column:
    """``pipe``, ``upside down pipe`` or ``broken pipe`` for one component."""
    return (
        F.when(F.getbit(F.get(lips_down, comp["top"]), comp["left"]) == 1, "pipe")
        .when(F.getbit(F.get(lips_up, comp["bottom"]), comp["left"]) == 1, "upside down pipe")
        .otherwise("broken pipe")
    )


def structure_kind(comp: Column, ceiling_row: Column, floor_row: Column,
                   towers: str | None = "tower") -> Column:
    """``tower``, ``rectangular block cluster`` or ``irregular block cluster``.

    A tower is at most two wide, at least three high, stands on the floor and
    does not hang from the ceiling row. ``towers=None`` yields null for them.
    """
    width = comp["right"] - comp["left"] + 1
    height = comp["bottom"] - comp["top"] + 1
    hangs = F.coalesce((comp["top"] <= ceiling_row) & (comp["bottom"] >= ceiling_row), F.lit(False))
    stands = (comp["top"] <= floor_row - 1) & (comp["bottom"] >= floor_row - 1)
    return (
        F.when(~hangs & (width <= 2) & (height >= 3) & stands, F.lit(towers).cast("string"))
        .when(comp["cells"] == width * height, "rectangular block cluster")
        .otherwise("irregular block cluster")
    )
