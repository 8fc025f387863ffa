"""Staircases: three or more columns whose solid top steps one row per column.

``direction`` is +1 for descending and -1 for ascending. A place starts a step
triple when three neighbouring columns hold solid tiles one row apart with no
solid tile on top. Triples are bitmaps; the left-to-right choice is one fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewright.functions.binding import let
from scenewright.functions.grid import above, below, cleared, shift_left

RUNS = "array<struct<c:int,r:int,n:int>>"


def _with_triples(df: DataFrame, solid: str, direction: int) -> DataFrame:
    """Add ``_t``: bitmaps of triple starts, indexed by ``row + height``.

    The lower half of the index range holds negative rows: an ascending stair
    may climb past row 0, where rows count from the bottom again and nothing is
    required above a tile.
    """
    rows = F.col(solid)
    open_top = F.zip_with(rows, above(rows), lambda s, up: s.bitwiseAND(F.bitwise_not(up)))
    df = df.withColumn("_tops", F.concat(cleared(rows) if direction > 0 else rows, open_top))
    tops = F.col("_tops")
    if direction > 0:
        second, third = below(tops), below(below(tops))
    else:
        second, third = above(tops), above(above(tops))
    pairs = F.zip_with(tops, second, lambda a, b: a.bitwiseAND(F.shiftright(b, 1)))
    return df.withColumn(
        "_t", F.zip_with(pairs, third, lambda a, c: a.bitwiseAND(F.shiftright(c, 2))))


def with_staircases(df: DataFrame, name: str, direction: int, solid: str = "solid_bits",
                    width: int | str = 16) -> DataFrame:
    """Add ``name``: chosen staircases ``(c, r, n)``, left to right.

    ``width`` is a number or SQL for one. Columns are scanned from the left; in each the highest triple start wins, is
    extended while the next triple also holds, and its columns are skipped.
    """
    df = _with_triples(df, solid, direction)
    df = df.withColumn("_any", F.aggregate("_t", F.lit(0).cast("bigint"),
                                           lambda a, b: a.bitwiseOR(b)))
    height = f"size({solid})"
    first, last = ("0", f"{height} - 3") if direction > 0 else ("3", f"{height} - 1")
    chain = (
        f"aggregate(sequence(1, {width}), named_struct('n', 3, 'on', true), "
        f"(s, j) -> if(s.on AND getbit(coalesce(get(_t, rr + {height} + ({direction}) * j), 0L), "
        f"least(cc + j, 63)) = 1, named_struct('n', s.n + 1, 'on', true), "
        f"named_struct('n', s.n, 'on', false)), s -> s.n)"
    )
    pick = (
        f"transform(array_compact(array(get(filter(sequence({first}, {last}), "
        f"r -> getbit(get(_t, r + {height}), cc) = 1), 0))), "
        f"rr -> named_struct('c', cc, 'r', rr, 'n', {chain}))"
    )
    fold = (
        f"aggregate(sequence(0, greatest(0, {width} - 3)), "
        f"named_struct('next', 0, 'found', cast(array() AS {RUNS})), "
        f"(acc, cc) -> if(cc < acc.next OR getbit(_any, cc) = 0, acc, "
        f"transform(array({pick}), got -> if(size(got) = 0, acc, "
        f"named_struct('next', cc + got[0].n, 'found', concat(acc.found, got))))[0]), "
        f"acc -> acc.found)"
    )
    return df.withColumn(name, F.when(F.col("_any") == 0, F.expr(f"cast(array() AS {RUNS})"))
                         .otherwise(F.expr(fold))).drop("_tops", "_t", "_any")


def staircase_bits(runs: Column, solid: Column, direction: int) -> Column:
    """Cells a staircase accounts for: its steps and the solid tiles below them."""
    steps = F.flatten(
        F.transform(
            runs,
            lambda s: F.transform(
                F.sequence(F.lit(0), s["n"] - 1),
                lambda j: F.struct((s["r"] + direction * j).alias("r"), (s["c"] + j).alias("c")),
            ),
        )
    )

    def seeds(cells: Column) -> Column:
        return F.transform(
            solid,
            lambda s, r: F.aggregate(
                cells,
                F.lit(0).cast("bigint"),
                lambda acc, x: F.when(
                    (x["r"] == r) & (r > 0),
                    acc.bitwiseOR(shift_left(F.lit(1).cast("bigint"), x["c"])),
                ).otherwise(acc),
            ),
        )

    filled = F.aggregate(
        F.arrays_zip(let(steps, seeds).alias("seed"), solid.alias("solid")),
        F.array().cast("array<bigint>"),
        lambda acc, x: F.array_append(
            acc,
            x["seed"].bitwiseOR(
                F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("bigint")).bitwiseAND(
                    x["solid"])),
        ),
    )
    return F.when(F.size(runs) == 0, cleared(solid)).otherwise(filled)
