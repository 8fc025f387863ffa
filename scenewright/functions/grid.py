"""Scenes as arrays of text rows, and tile classes as one bitmap per row.

A scene is ``rows ARRAY<STRING>``, one character per tile. A tile class (all
solid tiles, all coins, ...) becomes ``ARRAY<BIGINT>``: one integer per row
whose bit ``c`` says whether column ``c`` holds a tile of that class. Counting,
run finding and neighbour tests are then integer operations on one row of the
DataFrame, so grid features need no explode, no shuffle and no Python. Scenes
may be at most 63 columns wide; cut wider ones with ``segment_scene`` first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenewright.functions.binding import let
from scenewright.games import Game

MAX_WIDTH = 63


def class_bits(rows: Column, game: Game, chars: str) -> Column:
    """Bitmap per row of the tiles in ``chars``; bit ``c`` is column ``c``."""
    alphabet = game.alphabet
    marks = "".join("1" if ch in chars else "0" for ch in alphabet)
    return F.transform(
        rows,
        lambda row: F.conv(F.reverse(F.translate(row, alphabet, marks)), 2, 10).cast("bigint"),
    )


def with_tile_bitmaps(df: DataFrame, game: Game, classes: dict[str, str]) -> DataFrame:
    """Add one bitmap column per tile class, named after it, in one Arrow pass.

    Same bitmaps as ``class_bits``; used where a rule set needs a dozen classes.
    Every scene must have rows of equal length.
    """
    def one_shape(text: list[str], height: int) -> list[np.ndarray]:
        width = len(text[0]) // height
        if width >= MAX_WIDTH:
            raise ValueError(f"rows of {width} tiles do not fit one bitmap of {MAX_WIDTH - 1}; cut the level first")
        codes = np.array([t.encode("ascii") for t in text], dtype=f"S{height * width}")
        codes = codes.view(np.uint8).reshape(-1, width)
        weight = np.int64(1) << np.arange(width, dtype=np.int64)
        out = []
        for chars in classes.values():
            member = np.zeros(256, np.int64)
            member[[ord(ch) for ch in chars]] = 1
            out.append((member[codes] @ weight).reshape(len(text), height))
        return out

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("rows")
            heights = np.diff(rows.offsets.to_numpy())
            text = ["".join(x) for x in rows.to_pylist()]
            shapes = heights.astype(np.int64) * 65536 + np.array([len(t) for t in text], np.int64)
            made = [[None] * len(text) for _ in classes]
            for shape in np.unique(shapes):  # usually there is one
                at = np.flatnonzero(shapes == shape)
                for k, bits in enumerate(one_shape([text[i] for i in at], int(heights[at[0]]))):
                    for i, row in zip(at, bits):
                        made[k][i] = row
            ends = pa.array(np.r_[0, np.cumsum(heights)].astype(np.int32))
            arrays = [pa.ListArray.from_arrays(
                ends, pa.array(np.concatenate(m) if m else np.zeros(0, np.int64))) for m in made]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *arrays], [*batch.schema.names, *classes])

    schema = T.StructType([
        *df.schema.fields,
        *[T.StructField(name, T.ArrayType(T.LongType())) for name in classes]])
    return df.mapInArrow(add, schema)


def columns(rows: Column) -> Column:
    """Transpose: one string per column, top to bottom."""
    def letters(r: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.length(r[0])),
            lambda c: F.array_join(F.transform(r, lambda row: F.substring(row, c, 1)), ""))

    return let(rows, letters)


def shift_left(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by)


def whole_row(width: Column) -> Column:
    """Bitmap of a row with every column set."""
    one = F.lit(1).cast("bigint")
    return shift_left(one, width) - one


def bit_total(bits: Column) -> Column:
    """Number of set cells over all rows."""
    return F.aggregate(bits, F.lit(0), lambda acc, b: acc + F.bit_count(b))


def above(bits: Column, fill: int = 0) -> Column:
    """Bitmaps moved down by one row: each row sees the row above it."""
    return F.concat(F.array(F.lit(fill).cast("bigint")),
                    F.slice(bits, F.lit(1), F.size(bits) - 1))


def below(bits: Column, fill: int = 0) -> Column:
    """Bitmaps moved up by one row: each row sees the row below it."""
    return F.concat(F.slice(bits, F.lit(2), F.size(bits) - 1),
                    F.array(F.lit(fill).cast("bigint")))


def cleared(bits: Column) -> Column:
    return F.transform(bits, lambda b: F.lit(0).cast("bigint"))


def eroded(mask: Column, min_len: int) -> Column:
    """Cells that start a stretch of ``min_len`` set cells to the right."""
    out = mask
    for k in range(1, min_len):
        out = out.bitwiseAND(F.shiftright(mask, k))
    return out


def dilated(mask: Column, min_len: int) -> Column:
    """Undo ``eroded``: all cells of the stretches that begin in ``mask``."""
    out = mask
    for k in range(1, min_len):
        out = out.bitwiseOR(F.shiftleft(mask, k))
    return out


def run_starts(mask: Column) -> Column:
    """First cell of every maximal run."""
    return mask.bitwiseAND(F.bitwise_not(F.shiftleft(mask, 1)))


def count_runs(mask: Column, min_len: int = 1) -> Column:
    """Number of maximal runs of at least ``min_len`` cells in one row."""
    return F.bit_count(run_starts(eroded(mask, min_len)))


def run_mask(mask: Column, min_len: int) -> Column:
    """Cells that belong to runs of at least ``min_len``."""
    return dilated(eroded(mask, min_len), min_len)


def total_runs(bits: Column, min_len: int = 1) -> Column:
    return F.aggregate(bits, F.lit(0), lambda acc, b: acc + count_runs(b, min_len))


def positions(mask: Column) -> Column:
    """Columns of the set bits of one row."""
    return F.filter(F.sequence(F.lit(0), F.lit(MAX_WIDTH - 1)), lambda c: F.getbit(mask, c) == 1)


def runs_of(bits: Column, min_len: int) -> Column:
    """Runs as ``ARRAY<STRUCT<line, first, last>>``, in row then column order.

    The k-th run of a row begins at its k-th start bit and ends at its k-th end
    bit, so starts and ends pair up by position.
    """

    def of_row(kept: Column, r: Column) -> Column:
        starts = run_starts(kept)
        ends = kept.bitwiseAND(F.bitwise_not(F.shiftright(kept, 1)))
        pairs = F.zip_with(
            let(starts, positions),
            let(ends, positions),
            lambda a, b: F.struct(r.cast("int").alias("line"), a.cast("int").alias("first"),
                                  b.cast("int").alias("last")),
        )
        nothing = F.array().cast("array<struct<line:int,first:int,last:int>>")
        return F.when(kept == 0, nothing).otherwise(pairs)

    kept = F.transform(bits, lambda b: run_mask(b, min_len))
    return F.flatten(F.transform(kept, of_row))


def clear_above_and_below(bits: Column, solid: Column) -> Column:
    """Keep cells of inner rows with no solid tile directly above or below."""
    free = F.zip_with(above(solid, -1), below(solid, -1),
                      lambda up, down: F.bitwise_not(up.bitwiseOR(down)))
    return F.zip_with(bits, free, lambda b, f: b.bitwiseAND(f))


def without_rows(bits: Column, dropped: Column) -> Column:
    """Clear the rows whose index is in the array ``dropped``."""
    return F.transform(
        bits,
        lambda b, r: F.when(F.array_contains(dropped, r), F.lit(0).cast("bigint")).otherwise(b),
    )


def or_rows(*many: Column) -> Column:
    out = many[0]
    for other in many[1:]:
        out = F.zip_with(out, other, lambda a, b: a.bitwiseOR(b))
    return out


def minus_rows(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: a.bitwiseAND(F.bitwise_not(b)))


def set_cells(bits: Column) -> Column:
    """Set cells as ``ARRAY<STRUCT<r, c>>``."""
    return F.flatten(
        F.transform(
            bits,
            lambda b, r: F.transform(
                F.filter(F.sequence(F.lit(0), F.lit(MAX_WIDTH - 1)), lambda c: F.getbit(b, c) == 1),
                lambda c: F.struct(r.cast("int").alias("r"), c.cast("int").alias("c")),
            ),
        )
    )


def rows_from_ids(scene: Column, game: Game) -> Column:
    """``ARRAY<ARRAY<INT>>`` of tile ids to text rows."""
    chars = F.array(*[F.lit(ch) for ch in game.alphabet])
    return F.transform(
        scene, lambda row: F.array_join(F.transform(row, lambda t: F.get(chars, t)), "")
    )


def ids_from_rows(rows: Column, alphabet: str, default: int | None = None) -> Column:
    """Text rows to tile ids; unknown characters become ``default`` (or null)."""
    lookup = F.map_from_arrays(
        F.array(*[F.lit(ch) for ch in alphabet]),
        F.array(*[F.lit(i) for i in range(len(alphabet))]),
    )

    def one(ch: Column) -> Column:
        known = F.element_at(lookup, ch)
        return known if default is None else F.coalesce(known, F.lit(default))

    return F.transform(rows, lambda row: F.transform(F.split(row, ""), one))
