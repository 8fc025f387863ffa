"""Connected components of a tile class, per scene.

Each cell is labelled with the smallest row-major index that reaches it. That
minimum does not depend on visiting order and also holds for the one-sided
pipe edges, so a whole Arrow batch of scenes is swept at once until no label
moves. A scene is bounded by its own cells; nothing crosses rows of the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from scenewright.functions.grid import cleared

COMPONENT = "struct<label:int,top:int,bottom:int,left:int,right:int,cells:int>"
OFF = np.int16(0x7FFF)


def _unpack(bits: pa.Array, width: int) -> np.ndarray:
    """Row bitmaps of a batch as booleans ``[row, column, scene]``."""
    values = bits.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.ascontiguousarray(values.reshape(len(bits), -1).T)
    return ((rows[:, None, :] >> np.arange(width)[None, :, None]) & 1).astype(bool)


def _as_or_mask(flags: np.ndarray) -> np.ndarray:
    return np.where(flags, OFF, np.int16(0))


def min_labels(mask: np.ndarray, no_right: np.ndarray, no_left: np.ndarray) -> np.ndarray:
    """Smallest row-major index that reaches each set cell, ``OFF`` elsewhere.

    Arrays are ``[row, column, scene]``. Labels are swept down, up, right and
    left until a whole round changes nothing. OR-ing with ``OFF`` keeps clear
    cells clear and closes the one-sided edges.
    """
    height, width, _ = mask.shape
    off, shut_right, shut_left = _as_or_mask(~mask), _as_or_mask(no_right), _as_or_mask(no_left)
    if height * width >= int(OFF):
        raise ValueError(f"a scene of {height} x {width} cells is too large to label; cut it first")
    index = np.arange(height * width, dtype=np.int16).reshape(height, width, 1)
    label = np.where(mask, index, OFF)
    while True:
        before = label.copy()
        for r in range(1, height):
            np.minimum(label[r], label[r - 1] | off[r], out=label[r])
        for r in range(height - 2, -1, -1):
            np.minimum(label[r], label[r + 1] | off[r], out=label[r])
        for c in range(1, width):
            np.minimum(label[:, c], label[:, c - 1] | shut_right[:, c - 1] | off[:, c],
                       out=label[:, c])
        for c in range(width - 2, -1, -1):
            np.minimum(label[:, c], label[:, c + 1] | shut_left[:, c + 1] | off[:, c],
                       out=label[:, c])
        if np.array_equal(before, label):
            return label


def _labels(mask: pa.Array, no_right: pa.Array, no_left: pa.Array, width: int) -> np.ndarray:
    """Labels as ``[scene, cell]``."""
    out = min_labels(_unpack(mask, width), _unpack(no_right, width), _unpack(no_left, width))
    return np.ascontiguousarray(out.reshape(-1, len(mask)).T)


def _boxes(label: np.ndarray, width: int, min_cells: int) -> pa.Array:
    """Bounding box and size per component of at least ``min_cells``, by label."""
    n, cells = label.shape
    scene, cell = np.nonzero(label != OFF)
    key = scene.astype(np.int64) * cells + label[scene, cell]
    order = np.argsort(key, kind="stable")
    key, row, col = key[order], cell[order] // width, cell[order] % width
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    sizes = np.diff(np.r_[first, len(key)])

    def extreme(ufunc: np.ufunc, values: np.ndarray) -> np.ndarray:
        return ufunc.reduceat(values, first) if len(first) else values[:0]

    table = np.stack([key[first] % cells, extreme(np.minimum, row), extreme(np.maximum, row),
                      extreme(np.minimum, col), extreme(np.maximum, col), sizes])
    keep = sizes >= min_cells
    owner = (key[first] // cells)[keep]
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    fields = ["label", "top", "bottom", "left", "right", "cells"]
    structs = pa.StructArray.from_arrays(
        [pa.array(part[keep].astype(np.int32)) for part in table], fields)
    return pa.ListArray.from_arrays(pa.array(offsets), structs)


def _by_shape(mask: pa.Array, width: pa.Array, edges: list[pa.Array], run) -> pa.Array:
    """``run(masks, edges, height, width)`` for the scenes of each shape, in the order of the batch."""
    shapes = np.diff(mask.offsets.to_numpy()).astype(np.int64) << 32 | width.to_numpy(zero_copy_only=False).astype(np.int64)
    parts, places = [], []
    for shape in np.unique(shapes):
        at = np.flatnonzero(shapes == shape)
        pick = (lambda a: a) if len(at) == len(shapes) else (lambda a: a.take(pa.array(at)))
        parts.append(run(pick(mask), [pick(e) for e in edges], int(shape >> 32), int(shape & 0xFFFFFFFF)))
        places.append(at)
    if len(parts) == 1:
        return parts[0]
    back = np.argsort(np.concatenate(places), kind="stable")
    return pa.concat_arrays(parts).take(pa.array(back))


def _width(width: int | Column) -> Column:
    return F.lit(width) if isinstance(width, int) else width


def components(mask: Column, width: int | Column, no_right: Column | None = None,
               no_left: Column | None = None, min_cells: int = 1) -> Column:
    """Components of at least ``min_cells``, ordered by label.

    ``width`` may differ from row to row, and so may the height. Returns
    ``STRUCT<boxes ARRAY<...>, bits ARRAY<BIGINT>>``: one box per component and
    the mask restricted to those components.
    """
    kind = pa.struct([("boxes", pa.list_(pa.struct([(f, pa.int32()) for f in (
        "label", "top", "bottom", "left", "right", "cells")]))), ("bits", pa.list_(pa.int64()))])

    def one_shape(mask: pa.Array, edges: list[pa.Array], height: int, width: int) -> pa.Array:
        n, cells = len(mask), height * width
        if cells == 0:
            return pa.array([{"boxes": [], "bits": [0] * height}] * n, kind)
        label = _labels(mask, *edges, width)
        key = np.arange(n)[:, None] * (cells + 1) + np.minimum(label, cells)
        sizes = np.bincount(key.reshape(-1), minlength=n * (cells + 1))
        keep = (label != OFF) & (sizes[key] >= min_cells)
        bits = (keep.reshape(n, height, width).astype(np.int64) << np.arange(width)).sum(axis=2)
        offsets = np.arange(0, (n + 1) * height, height, dtype=np.int32)
        return pa.StructArray.from_arrays(
            [_boxes(label, width, min_cells),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(bits.reshape(-1)))],
            ["boxes", "bits"])

    @F.arrow_udf(f"struct<boxes:array<{COMPONENT}>,bits:array<bigint>>")
    def find(mask: pa.Array, width: pa.Array, no_right: pa.Array, no_left: pa.Array) -> pa.Array:
        if len(mask) == 0:
            return pa.array([], kind)
        return _by_shape(mask, width, [no_right, no_left], one_shape)

    return find(mask, _width(width), cleared(mask) if no_right is None else no_right,
                cleared(mask) if no_left is None else no_left)


def component_labels(mask: Column, width: int | Column, no_right: Column | None = None,
                     no_left: Column | None = None) -> Column:
    """Label per cell in row-major order, null where the mask is clear; ``width`` as in ``components``."""
    def one_shape(mask: pa.Array, edges: list[pa.Array], height: int, width: int) -> pa.Array:
        if height * width == 0:
            return pa.array([[]] * len(mask), pa.list_(pa.int32()))
        label = _labels(mask, *edges, width)
        flat = label.reshape(-1)
        offsets = np.arange(0, len(flat) + 1, label.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(
            pa.array(offsets), pa.array(flat.astype(np.int32), mask=flat == OFF))

    @F.arrow_udf("array<int>")
    def labels(mask: pa.Array, width: pa.Array, no_right: pa.Array, no_left: pa.Array) -> pa.Array:
        if len(mask) == 0:
            return pa.array([], pa.list_(pa.int32()))
        return _by_shape(mask, width, [no_right, no_left], one_shape)

    return labels(mask, _width(width), cleared(mask) if no_right is None else no_right,
                  cleared(mask) if no_left is None else no_left)
