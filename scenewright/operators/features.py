"""Shape features of scenes as columns added to a scene DataFrame.

Input frames hold ``rows ARRAY<STRING>``. All rules here are row-local column
expressions over tile bitmaps (see ``functions.grid``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewright.functions import grid as G
from scenewright.functions.binding import let
from scenewright.functions.quantity import quantity
from scenewright.games import DIRECTIONAL, Game


def explode_cells(scenes: DataFrame, *keys: str, rows: str = "rows") -> DataFrame:
    """One row per cell: ``keys, r, c, ch``."""
    lines = scenes.select(*keys, F.posexplode(rows).alias("r", "line"))
    return lines.select(*keys, "r", F.posexplode(F.split("line", "")).alias("c", "ch"))


def count_tiles(rows: Column, game: Game, chars: str, exclude: Column | None = None) -> Column:
    """Cells holding one of ``chars`` that are not in the bitmap ``exclude``."""
    if exclude is not None:
        return G.bit_total(G.minus_rows(G.class_bits(rows, game, chars), exclude))
    others = "".join(ch for ch in game.alphabet if ch not in chars)
    return F.length(F.translate(F.array_join(rows, ""), others, ""))


def _gaps(n: Column, what: str) -> Column:
    return let(n, lambda k: F.concat(quantity(k), F.lit(f" {what}"),
                                     F.when(k == 1, "").otherwise("s")))


def floor_phrase(rows: Column, game: Game, absence: bool = False) -> Column:
    """Describe the last row: full, with gaps, a giant gap with chunks, or none.

    Gaps are runs of passable tiles or enemies. A row without solid tiles that
    is not fully passable (an enemy stands in it) still counts as a giant gap
    with no chunks.
    """
    last = F.element_at(rows, -1)
    width = F.length(last)

    def bits(chars: str) -> Column:
        return G.class_bits(F.array(last), game, chars)[0]

    n_solid = F.bit_count(bits(game.having("solid", "diggable")))
    n_passable = F.bit_count(bits(game.having("passable")))
    gaps = G.count_runs(bits(game.having("passable", "enemy")))
    chunks = G.count_runs(bits(game.having("solid")))
    return (
        F.when(n_solid == width, "full floor")
        .when(n_passable == width, "no floor" if absence else "")
        .when(n_solid > n_passable, F.concat(F.lit("floor with "), _gaps(gaps, "gap")))
        .otherwise(F.concat(F.lit("giant gap with "), _gaps(chunks, "chunk"), F.lit(" of floor")))
    )


def wall_floor_phrase(rows: Column, wall: str, game: Game = DIRECTIONAL,
                      absence: bool = False) -> Column:
    """As ``floor_phrase`` where only wall tiles count and all else is a gap."""
    last = F.element_at(rows, -1)
    width = F.length(last)
    solid = G.class_bits(F.array(last), game, wall)[0]
    other = G.class_bits(F.array(last), game, "".join(c for c in game.alphabet if c not in wall))[0]
    n = F.bit_count(solid)
    return (
        F.when(n == width, " full floor.")
        .when(n == 0, " no floor." if absence else "")
        .when(n > width - n, F.concat(F.lit(" floor with "), _gaps(G.count_runs(other), "gap"),
                                      F.lit(".")))
        .otherwise(F.concat(F.lit(" giant gap with "), _gaps(G.count_runs(solid), "chunk"),
                            F.lit(" of floor.")))
    )


def ceiling_phrase(row: Column, game: Game, solid: str, gap: str, absence: bool = False) -> Column:
    """Describe one row as a ceiling: full, more than half solid with gaps, or none."""
    width = F.length(row)
    n = F.bit_count(G.class_bits(F.array(row), game, solid)[0])
    gaps = G.count_runs(G.class_bits(F.array(row), game, gap)[0])
    return (
        F.when(n == width, " full ceiling.")
        .when(n > F.floor(width / 2), F.concat(F.lit(" ceiling with "), _gaps(gaps, "gap"),
                                               F.lit(".")))
        .otherwise(" no ceiling." if absence else "")
    )


def ceiling_rank(phrase: Column) -> Column:
    """Completeness order of ceiling phrases; 9 when there is no ceiling."""
    ordered = ["full ceiling", "ceiling with one gap", "ceiling with two gaps",
               "ceiling with a few gaps", "ceiling with several gaps", "ceiling with many gaps"]
    out = F.lit(9)
    for i, said in reversed(list(enumerate(ordered))):
        out = F.when(phrase == f" {said}.", i).otherwise(out)
    return out


def with_ceiling(df: DataFrame, game: Game, absence: bool = False) -> DataFrame:
    """Add ``ceiling_row`` (null if none), ``ceiling_text`` and ``ceiling_bits``.

    Rows from the usual ceiling row upwards are tried; at the first place where
    a row or the one above it forms a ceiling, the more complete of the two is
    taken, the upper one on a tie. Rows above that equal the chosen row belong
    to the ceiling as well (unless row 0 was chosen).
    """
    solid = game.having("solid")
    gap = game.having("passable", "moving")
    top = list(range(game.ceiling + 1))
    df = df.withColumn(
        "_ceil",
        F.array(*[ceiling_phrase(F.col("rows")[r], game, solid, gap, absence) for r in top]),
    ).withColumn("_rank", F.transform("_ceil", ceiling_rank))
    rank = F.col("_rank")
    low = game.ceiling
    chosen = F.when(rank[low] < rank[low - 1], low)
    for r in reversed(top[:-1]):
        chosen = chosen.when(rank[r] < 9, r)
    df = df.withColumn("ceiling_row", chosen).withColumn(
        "ceiling_text",
        F.coalesce(F.get("_ceil", F.col("ceiling_row")), F.lit(" no ceiling." if absence else "")),
    )
    line = F.get("rows", F.col("ceiling_row"))
    whole = G.whole_row(F.length(F.col("rows")[0]))
    return df.withColumn(
        "ceiling_bits",
        F.transform(
            "rows",
            lambda row, r: F.when(
                (r == F.col("ceiling_row"))
                | ((r < F.col("ceiling_row")) & (F.col("ceiling_row") > 0) & (row == line)),
                whole,
            ).otherwise(F.lit(0).cast("bigint")),
        ),
    ).drop("_ceil", "_rank")


def floor_rows(rows: Column) -> Column:
    """Rows that count as floor: the last, and the one above when it is equal
    once pipe lips are read as pipe bodies."""
    last = F.element_at(rows, -1)
    above = F.translate(F.element_at(rows, -2), "<>", "[]")
    n = F.size(rows)
    return F.when(last == above, F.array(n - 2, n - 1)).otherwise(F.array(n - 1))


def broken_supports(base: Column, any_cannon: Column) -> Column:
    """Supports whose tile above is neither a cannon nor a support, from bitmaps."""
    return G.bit_total(
        F.zip_with(base, G.above(any_cannon), lambda b, up: b.bitwiseAND(F.bitwise_not(up))))


def broken_cannons(rows: Column, game: Game) -> Column:
    """Cannon supports whose tile above is neither a cannon nor a support."""
    return broken_supports(G.class_bits(rows, game, "b"), G.class_bits(rows, game, "Bb"))


def horizontal_run_bits(rows: Column, game: Game, descriptor: str, min_len: int,
                        clear: bool = False, excluded: Column | None = None,
                        last_row: bool = False, pipes: bool = False) -> Column:
    """Bitmap of the cells in maximal horizontal runs of a descriptor.

    ``clear`` asks for no solid tile above or below (the first row never
    qualifies), ``excluded`` is an array of rows to skip, the last row is
    skipped unless ``last_row``, and pipe tiles unless ``pipes``.
    """
    bits = G.class_bits(rows, game, game.having(descriptor, without=() if pipes else ("pipe",)))
    if clear:
        bits = G.clear_above_and_below(bits, G.class_bits(rows, game, game.having("solid")))
    dropped = F.array().cast("array<int>") if excluded is None else excluded
    if not last_row:
        dropped = F.concat(dropped, F.array(F.size(rows) - 1))
    bits = G.without_rows(bits, dropped)
    return F.transform(bits, lambda b: G.run_mask(b, min_len))


def vertical_run_bits(rows: Column, game: Game, descriptor: str, min_len: int,
                      clear: bool = False) -> Column:
    """As above by column: one bitmap per column whose bit is the row."""
    bits = G.class_bits(G.columns(rows), game, game.having(descriptor))
    if clear:
        sides = G.class_bits(G.columns(rows), game, game.having("solid"))
        bits = G.clear_above_and_below(bits, sides)
    return F.transform(bits, lambda b: G.run_mask(b, min_len))


def water_phrase(rows: Column, game: Game = DIRECTIONAL, absence: bool = False) -> Column:
    """Share of water among empty cells in words."""
    empty = count_tiles(rows, game, game.having("empty"))
    water = count_tiles(
        rows, game, "".join(c for c in game.having("water") if c in game.having("empty")))
    ratio = water / empty
    return (
        F.when((empty == 0) | (water == 0), " no water." if absence else "")
        .when(ratio < 0.35, " some water.").when(ratio < 0.65, " half water.")
        .when(ratio < 1.0, " mostly water.").otherwise(" all water.")
    )


def wall_columns(rows: Column, wall: str, game: Game = DIRECTIONAL, min_height: int = 3) -> Column:
    """Columns that hold a vertical run of at least ``min_height`` wall tiles."""
    bits = G.class_bits(G.columns(rows), game, wall)
    return F.aggregate(
        bits, F.lit(0),
        lambda acc, b: acc + F.when(G.eroded(b, min_height) != 0, 1).otherwise(0))
