"""Shapes of platformer and ladder scenes for a whole Arrow batch at once: captions and the cells they are about.

The rules are those of ``captioner.with_shapes``, which states them as column
expressions; there every bitmap is an interpreted array expression per scene,
here it is one integer operation over all scenes of a batch. Row bitmaps are
``[row, scene]`` arrays whose bit ``c`` is column ``c``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from scenewright.functions.grid import MAX_WIDTH
from scenewright.games import Game
from scenewright.operators.components import OFF, min_labels

#: Scenes that are worked on together; their arrays stay in the processor's cache.
CHUNK = 2048
QUANTITIES = ["no", "one", "two", "a few", "several", "many"]
PIPE_KINDS = ["pipe", "upside down pipe", "broken pipe"]
BLOCK_KINDS = ["tower", "rectangular block cluster", "irregular block cluster"]


def bucket(n: np.ndarray) -> np.ndarray:
    """Position in ``QUANTITIES``."""
    return np.searchsorted([1, 2, 3, 5, 10], n, side="right")


def count_runs(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits & ~(bits << 1))


def pairs_mask(bits: np.ndarray) -> np.ndarray:
    """Cells of runs of at least two."""
    kept = bits & (bits >> 1)
    return kept | (kept << 1)


def _down(bits: np.ndarray) -> np.ndarray:
    """Each row sees the row above it."""
    return np.concatenate([np.zeros_like(bits[:1]), bits[:-1]])


def _up(bits: np.ndarray) -> np.ndarray:
    """Each row sees the row below it."""
    return np.concatenate([bits[1:], np.zeros_like(bits[:1])])


def _total(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=0, dtype=np.int64)


class Shapes:
    """Bitmaps, staircases and components of scenes of one shape; ``codes`` is ``[scene, row, column]``."""

    def __init__(self, codes: np.ndarray, game: Game):
        self.codes, self.game = codes, game
        self.n, self.height, self.width = codes.shape
        if self.width >= MAX_WIDTH:
            raise ValueError(f"rows of {self.width} tiles do not fit one bitmap of {MAX_WIDTH - 1}; cut the level first")
        self.full = np.int64((1 << self.width) - 1)
        self._tiles: dict[str, np.ndarray] = {}

    def tiles(self, chars: str) -> np.ndarray:
        out = np.zeros((self.height, self.n), np.int64)
        for ch in dict.fromkeys(chars):
            if ch not in self._tiles:
                packed = np.packbits(self.codes == ord(ch), axis=2, bitorder="little")
                words = np.zeros((self.n, self.height, 8), np.uint8)
                words[:, :, : packed.shape[2]] = packed
                self._tiles[ch] = np.ascontiguousarray(words.view("<i8")[:, :, 0].T)
            out |= self._tiles[ch]
        return out

    def having(self, *descriptors: str, without: tuple[str, ...] = ()) -> np.ndarray:
        return self.tiles(self.game.having(*descriptors, without=without))

    def count(self, chars: str) -> np.ndarray:
        """Cells that hold no other tile of the game."""
        others = "".join(ch for ch in self.game.alphabet if ch not in chars)
        return self.height * self.width - _total(self.tiles(others))

    @cached_property
    def solid(self) -> np.ndarray:
        return self.having("solid")

    @cached_property
    def pipe(self) -> np.ndarray:
        return self.having("pipe")

    @cached_property
    def broken_cannons(self) -> np.ndarray:
        return _total(self.tiles("b") & ~_down(self.tiles("Bb")))

    @cached_property
    def double_floor(self) -> np.ndarray:
        above = self.codes[:, -2].copy()
        for lip, body in zip("<>", "[]"):
            above[above == ord(lip)] = ord(body)
        return (self.codes[:, -1] == above).all(axis=1)

    @cached_property
    def floor_bits(self) -> np.ndarray:
        out = np.zeros_like(self.solid)
        out[-1] = self.full
        out[-2] = np.where(self.double_floor, self.full, 0)
        return out

    def _ceiling(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, or -1; kind of its phrase: 0 none, 1 full, 2 and more with gaps by quantity)."""
        low = self.game.ceiling
        solid = np.bitwise_count(self.solid[: low + 1])
        gaps = bucket(count_runs(self.having("passable", "moving")[: low + 1]))
        kind = np.where(solid == self.width, 1, np.where(solid > self.width // 2, 2 + gaps, 0))
        rank = np.array([9, 0, 9, 1, 2, 3, 4, 5])[kind]  # "with no gaps" is no ceiling to choose
        if len(rank) <= low:
            raise IndexError(f"a scene of {self.height} rows has no ceiling row {low}")
        row = np.full(self.n, -1)
        for r in range(low):
            row = np.where(rank[r] < 9, r, row)
        row = np.where(rank[low] < rank[low - 1], low, row)
        return row, np.where(row >= 0, np.take_along_axis(kind, np.maximum(row, 0)[None], axis=0)[0], 0)

    @cached_property
    def ceiling(self) -> tuple[np.ndarray, np.ndarray]:
        return self._ceiling()

    @cached_property
    def ceiling_bits(self) -> np.ndarray:
        row = self.ceiling[0]
        out = np.zeros_like(self.solid)
        has = np.flatnonzero(row >= 0)
        out[row[has], has] = self.full
        for r in range(self.game.ceiling):
            above = np.flatnonzero(row > r)
            same = (self.codes[above, r] == self.codes[above, row[above]]).all(axis=1)
            out[r, above[same]] = self.full
        return out

    @cached_property
    def platforms(self) -> np.ndarray:
        solid = self.solid
        bits = self.having("solid", without=("pipe",)) & ~(_down(solid) | _up(solid))
        bits[0] = bits[-1] = 0
        row = self.ceiling[0]
        has = np.flatnonzero(row >= 0)
        bits[row[has], has] = 0
        return pairs_mask(bits)

    @cached_property
    def coin_lines(self) -> np.ndarray:
        bits = self.having("coin")
        bits[-1] = 0
        return pairs_mask(bits)

    def _stairs(self, direction: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(scene, column, row, steps) of the chosen staircases, as ``stairs.with_staircases`` chooses them."""
        h, w = self.height, self.width
        solid = self.solid
        tops = np.concatenate([np.zeros_like(solid) if direction > 0 else solid, solid & ~_down(solid)])
        step = _up if direction > 0 else _down
        second = step(tops)
        triple = tops & (second >> 1) & (step(second) >> 2)
        some = np.bitwise_or.reduce(triple, axis=0)
        first, last = (h, 2 * h - 3) if direction > 0 else (h + 3, 2 * h - 1)
        free_from = np.zeros(self.n, np.int64)
        found = []
        for c in range(max(1, w - 2)):
            at = np.flatnonzero((free_from <= c) & ((some >> c) & 1 == 1))
            if not len(at):
                continue
            starts = (triple[first : last + 1, at] >> c) & 1
            has = starts.any(axis=0)
            at, r = at[has], first + starts[:, has].argmax(axis=0)
            n = np.full(len(at), 3)
            on = np.arange(len(at))
            for j in range(1, w + 1):
                row = r[on] + direction * j
                inside = (row >= 0) & (row < 2 * h)
                on, row = on[inside], row[inside]
                on = on[(triple[row, at[on]] >> min(c + j, 63)) & 1 == 1]
                if not len(on):
                    break
                n[on] += 1
            free_from[at] = c + n
            found.append((at, np.full(len(at), c), r - h, n))
        return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found)) if found else (
            np.zeros(0, np.int64),) * 4

    @cached_property
    def up_stairs(self):
        return self._stairs(-1)

    @cached_property
    def down_stairs(self):
        return self._stairs(1)

    def _stair_bits(self, stairs, direction: int) -> np.ndarray:
        """Steps and the solid tiles below them; row 0 and the rows above it hold none."""
        out = np.zeros_like(self.solid)
        scene, c, r, n = stairs
        for j in range(int(n.max(initial=0))):
            on = np.flatnonzero((j < n) & (r + direction * j > 0))
            np.bitwise_or.at(out, (r[on] + direction * j, scene[on]), np.int64(1) << (c[on] + j))
        for row in range(1, self.height):
            out[row] |= out[row - 1] & self.solid[row]
        return out

    @cached_property
    def up_bits(self) -> np.ndarray:
        return self._stair_bits(self.up_stairs, -1)

    @cached_property
    def down_bits(self) -> np.ndarray:
        return self._stair_bits(self.down_stairs, 1)

    @cached_property
    def claimed(self) -> np.ndarray:
        return self.floor_bits | self.ceiling_bits | self.platforms | self.up_bits | self.down_bits | self.tiles("B")

    def _cells(self, bits: np.ndarray) -> np.ndarray:
        """``[row, column, scene]`` flags."""
        return ((bits[:, None, :] >> np.arange(self.width)[None, :, None]) & 1).astype(bool)

    def _components(self, bits: np.ndarray, no_right: np.ndarray, no_left: np.ndarray, least: int):
        """(scene, label, top, bottom, left, right, cells) of components, and (component, scene, row, column) of their cells."""
        some = np.flatnonzero(bits.any(axis=0))
        label = min_labels(self._cells(bits[:, some]), self._cells(no_right[:, some]), self._cells(no_left[:, some]))
        per_scene = np.ascontiguousarray(label.reshape(self.height * self.width, len(some)).T)
        scene, cell = np.nonzero(per_scene != OFF)
        cells = self.height * self.width
        key = scene * cells + per_scene[scene, cell]
        order = np.argsort(key, kind="stable")
        key, scene, row, col = key[order], some[scene[order]], cell[order] // self.width, cell[order] % self.width
        start = np.flatnonzero(np.diff(key, prepend=-1)) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(key)))

        def extreme(ufunc: np.ufunc, values: np.ndarray) -> np.ndarray:
            return ufunc.reduceat(values, start) if len(start) else values

        boxes = np.stack([scene[start], key[start] % cells, extreme(np.minimum, row), extreme(np.maximum, row),
                          extreme(np.minimum, col), extreme(np.maximum, col), size])
        keep = size >= least
        number = np.cumsum(keep) - 1
        member = np.repeat(np.where(keep, number, -1), size)
        kept = member >= 0
        return boxes[:, keep], (member[kept], scene[kept], row[kept], col[kept])

    @cached_property
    def pipes(self):
        return self._components(self.pipe, self.tiles(">]"), self.tiles("<["), 1)

    @cached_property
    def free(self) -> np.ndarray:
        return self.solid & ~self.pipe & ~self.claimed

    @cached_property
    def blocks(self):
        none = np.zeros_like(self.solid)
        return self._components(self.free, none, none, 3)

    @cached_property
    def block_bits(self) -> np.ndarray:
        _, (_, scene, row, col) = self.blocks
        out = np.zeros_like(self.solid)
        np.bitwise_or.at(out, (row, scene), np.int64(1) << col)
        return out

    @cached_property
    def loose(self) -> np.ndarray:
        return self.tiles("XS") & ~self.claimed & ~self.block_bits

    def _lips(self, downward: bool) -> np.ndarray:
        """Where a valid pipe's lip may stand, as ``pipes.with_pipe_lips`` decides it."""
        ll, lr, bl, br = (self.tiles(ch) for ch in "<>[]")
        left, right = ll | bl, lr | br
        lip = ll & (lr >> 1)
        pair = lip | bl & (br >> 1)
        stop = left | right
        if not downward:
            stop = stop | self.tiles("-")
        last = np.int64(1) << (self.width - 1)

        def goes_on(good: np.ndarray, stop: np.ndarray) -> np.ndarray:
            out = np.empty_like(good)
            held = np.full(self.n, -1, np.int64)
            for r in range(self.height - 1, -1, -1) if downward else range(self.height):
                out[r] = held
                held = good[r] & held | ~stop[r]
            return out

        return (lip & goes_on(pair, stop | (stop >> 1)) & ~last | lr & goes_on(right, stop) & 1
                | ll & goes_on(left, stop) & last)

    @cached_property
    def pipe_kinds(self) -> np.ndarray:
        scene, _, top, bottom, left, _, _ = self.pipes[0]
        down = (self._lips(True)[top, scene] >> left) & 1
        up = (self._lips(False)[bottom, scene] >> left) & 1
        return np.where(down == 1, 0, np.where(up == 1, 1, 2))

    @cached_property
    def block_kinds(self) -> np.ndarray:
        scene, _, top, bottom, left, right, cells = self.blocks[0]
        ceiling = self.ceiling[0][scene]
        floor = self.height - 1 - self.double_floor[scene]
        wide, high = right - left + 1, bottom - top + 1
        hangs = (ceiling >= 0) & (top <= ceiling) & (bottom >= ceiling)
        stands = (top <= floor - 1) & (bottom >= floor - 1)
        return np.where(~hangs & (wide <= 2) & (high >= 3) & stands, 0, np.where(cells == wide * high, 1, 2))

    def captions(self, absence: bool, upside_down: bool) -> pa.Array:
        lines = lambda label: [f" no {label}s." if absence else "", f" one {label}.", *[
            f" {q} {label}s." for q in QUANTITIES[2:]]]

        def counted(n: np.ndarray, one: str, many: str, absent: bool = absence) -> pa.Array:
            texts = [f" no {many}." if absent else "", f" one {one}.", *[f" {q} {many}." for q in QUANTITIES[2:]]]
            return _texts(bucket(n), texts)

        def stairs(found, kind: str) -> pa.Array:
            n = np.bincount(found[0], minlength=self.n)
            return _texts(bucket(n), ["", f" one {kind} staircase.", *[f" {q} {kind} staircases." for q in QUANTITIES[2:]]])

        pipes = (["pipe", "upside down pipe"] if upside_down else ["pipe"]) if absence else []
        if not upside_down and (self.pipe_kinds == 1).any():
            raise ValueError("upside down pipes were excluded but occur in the data")
        parts = [
            self._floor_texts(absence), self._ceiling_texts(absence),
            counted(self.count("E"), "enemy", "enemies"),
            counted(self.count("Q?"), "question block", "question blocks"),
            counted(self.count("B"), "cannon", "cannons"),
            counted(self.broken_cannons, "broken cannon", "broken cannons", False),
            counted(self.count("o"), "coin", "coins"),
            _texts(bucket(count_runs(self.coin_lines).sum(axis=0, dtype=np.int64)), lines("coin line")),
            _texts(bucket(count_runs(self.platforms).sum(axis=0, dtype=np.int64)), lines("platform")),
            stairs(self.up_stairs, "ascending"), stairs(self.down_stairs, "descending"),
            *[_texts((np.bincount(found[0], minlength=self.n) > 0).astype(int), [f" no {kind} staircases.", ""])
              for found, kind in ((self.up_stairs, "ascending"), (self.down_stairs, "descending")) if absence],
            self._structures(self.pipes[0][0], self.pipe_kinds, PIPE_KINDS, pipes),
            self._structures(self.blocks[0][0], self.block_kinds, BLOCK_KINDS, BLOCK_KINDS if absence else []),
            counted(_total(self.loose), "loose block", "loose blocks")]
        return pc.utf8_trim(pc.binary_join_element_wise(*parts, ""), " ")

    def _floor_texts(self, absence: bool) -> pa.Array:
        row = lambda bits: bits[-1]
        solid, passable = np.bitwise_count(row(self.having("solid", "diggable"))), np.bitwise_count(row(self.having("passable")))
        gaps = bucket(count_runs(row(self.having("passable", "enemy"))))
        chunks = bucket(count_runs(row(self.solid)))
        many = lambda q, what: f"{q} {what}" + ("" if q == "one" else "s")
        texts = ["full floor.", "no floor." if absence else "", *[f"floor with {many(q, 'gap')}." for q in QUANTITIES],
                 *[f"giant gap with {many(q, 'chunk')} of floor." for q in QUANTITIES]]
        return _texts(np.where(solid == self.width, 0, np.where(passable == self.width, 1, np.where(
            solid > passable, 2 + gaps, 8 + chunks))), texts)

    def _ceiling_texts(self, absence: bool) -> pa.Array:
        return _texts(self.ceiling[1], [" no ceiling." if absence else "", " full ceiling.", *[
            f" ceiling with {q} gap" + ("." if q == "one" else "s.") for q in QUANTITIES]])

    def _structures(self, scene: np.ndarray, kind: np.ndarray, names: list[str], absent: list[str]) -> pa.Array:
        """Kinds with their numbers in order of first appearance, then what is absent."""
        n = np.stack([np.bincount(scene[kind == k], minlength=self.n) for k in range(3)])
        first = np.full((3, self.n), 1 << 30)
        np.minimum.at(first, (kind, scene), np.arange(len(scene)))
        order = np.argsort(first, axis=0, kind="stable")
        key = (bucket(n) * np.array([[1], [6], [36]])).sum(axis=0) + 216 * order[0] + 648 * order[1]

        def text(key: int) -> str:
            counts, a, b = [key % 6, key // 6 % 6, key // 36 % 6], key // 216 % 3, key // 648
            said = "".join(f" one {names[k]}." if counts[k] == 1 else f" {QUANTITIES[counts[k]]} {names[k]}s."
                           for k in (a, b, 3 - a - b) if counts[k])
            return said + "".join(f" no {name}s." for name in absent if not counts[names.index(name)])

        seen, at = np.unique(key, return_inverse=True)
        return _texts(at, [text(int(k)) for k in seen])

    def phrase_cells(self) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        """(topic, scene, row, column) of the cells each kind of phrase is about."""
        masks = {"floor": self.floor_bits, "ceiling": self.ceiling_bits, "enemy": self.tiles("E"),
                 "question block": self.tiles("Q?"), "cannon": self.tiles("B"), "coin": self.tiles("o"),
                 "coin line": self.coin_lines, "platform": self.platforms, "ascending staircase": self.up_bits,
                 "descending staircase": self.down_bits, "loose block": self.loose}
        for topic, bits in masks.items():
            some = np.flatnonzero(bits.any(axis=0))
            row, col, scene = np.nonzero(self._cells(bits[:, some]))
            yield topic, some[scene], row, col
        for (_, cells), kinds, names in ((self.pipes, self.pipe_kinds, PIPE_KINDS),
                                         (self.blocks, self.block_kinds, BLOCK_KINDS)):
            member, scene, row, col = cells
            for k, name in enumerate(names):
                at = kinds[member] == k
                yield name, scene[at], row[at], col[at]


class LadderShapes(Shapes):
    """The same for the ladder game; the rules are those of ``ladder_captioner.with_ladder_shapes``."""

    def _inner(self, bits: np.ndarray) -> np.ndarray:
        return np.concatenate([bits[:-1], np.zeros_like(bits[:1])])

    def _ladders(self) -> list[np.ndarray]:
        """Numbers of upright runs of ladder tiles: of one, two to four, and five tiles to the game's height."""
        cells = self._cells(self.having("ladder"))
        upright = (cells.astype(np.int64) << np.arange(self.height)[:, None, None]).sum(axis=0)  # [column, scene]
        least = []
        for size in (1, 2, 5, self.game.height + 1):
            kept = upright
            for _ in range(size - 1):
                kept = kept & (kept >> 1)
            least.append(count_runs(kept).sum(axis=0, dtype=np.int64))
        return [a - b for a, b in zip(least, least[1:])]

    def _clusters(self) -> np.ndarray:
        """Ladder components that hold two ladder tiles side by side above the last row."""
        none = np.zeros_like(self.solid)
        ladder = self.having("ladder")
        boxes, (member, scene, row, col) = self._components(ladder, none, none, 1)
        paired = (pairs_mask(self._inner(ladder))[row, scene] >> col) & 1 == 1
        return np.bincount(boxes[0][np.unique(member[paired])], minlength=self.n)

    def captions(self, absence: bool, sky_rows: int) -> pa.Array:
        game, none = self.game, np.zeros_like(self.solid)

        def counted(n: np.ndarray, one: str, many: str, nothing: str) -> pa.Array:
            return _texts(bucket(n), [nothing, f" one {one}.", *[f" {q} {many}." for q in QUANTITIES[2:]]])

        def lines(n: np.ndarray, label: str) -> pa.Array:
            return counted(n, label, f"{label}s", f" no {label}s." if absence else "")

        runs = lambda bits: count_runs(bits).sum(axis=0, dtype=np.int64)
        gold = self.having("gold")
        gold_lines = pairs_mask(self._inner(gold))
        n_lines, single = runs(gold_lines), bucket(_total(gold & ~gold_lines))
        no_gold = " no gold." if absence else ""
        scene, _, top, bottom, left, right, cells = self._components(self.solid, none, none, 1)[0]
        wide, high = right - left + 1, bottom - top + 1
        hangs = (top <= game.ceiling) & (bottom >= game.ceiling)
        stands = (top <= game.height - 2) & (bottom >= game.height - 2)
        kept = ~(~hangs & (wide <= 2) & (high >= 3) & stands)  # towers are not spoken of
        kinds = np.where(cells == wide * high, 1, 2)
        below = self.having("empty")
        below[:sky_rows] = 0
        area, _, a_top, a_bottom, a_left, a_right, _ = self._components(below, none, none, 1)[0]
        open_ = (a_top == 0) | (a_bottom == self.height - 1) | (a_left == 0) | (a_right == self.width - 1)
        ground = lambda ch, label: counted(self.count(ch), label, label, f" no {label}." if absence else "")
        parts = [
            self._floor_texts(absence),
            counted(self.count("E"), "enemy", "enemies", " no enemies." if absence else ""),
            lines(n_lines, "gold line"),
            _texts(np.where(single > 0, single, np.where(n_lines == 0, 0, 6)),
                   [no_gold, *[f" {q} gold." for q in QUANTITIES[1:]], ""]),
            lines(runs(self._inner(self.having("rope"))), "rope"),
            counted(self._clusters(), "ladder cluster", "ladder clusters", ""),
            *[lines(n, label) for n, label in zip(self._ladders(), ("lone ladder tile", "short ladder", "tall ladder"))],
            self._structures(scene[kept], kinds[kept], BLOCK_KINDS, BLOCK_KINDS[1:] if absence else []),
            ground("B", "solid ground"), ground("b", "diggable ground"),
            counted(np.bincount(area[~open_], minlength=self.n), "chamber", "chambers", ""),
            counted(np.bincount(area[open_], minlength=self.n), "empty background area", "empty background areas", "")]
        return pc.utf8_trim(pc.binary_join_element_wise(*parts, ""), " ")


def _texts(index: np.ndarray, texts: list[str]) -> pa.Array:
    return pa.array(texts, pa.string()).take(pa.array(index.astype(np.int64)))


def by_shape(rows: pa.Array, run: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Call ``run(places, codes)`` for the scenes of each shape, at most ``CHUNK`` at a time."""
    if rows.null_count or rows.flatten().null_count:
        raise ValueError("a scene without rows, or a null row")
    heights = np.diff(rows.offsets.to_numpy())
    lines = rows.flatten()
    ends = lines.offsets.to_numpy() if hasattr(lines, "offsets") else np.frombuffer(
        lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1]
    data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)
    first = rows.offsets.to_numpy() - rows.offsets[0].as_py()
    begin, end = ends[first[:-1]].astype(np.int64), ends[first[1:]].astype(np.int64)
    if len(data) and (data[ends[0] : ends[-1]] > 127).any():
        raise ValueError("a scene holds a tile that is no ASCII sign")
    shapes = heights.astype(np.int64) << 32 | (end - begin)
    for shape in np.unique(shapes):
        height, cells = int(shape >> 32), int(shape & 0xFFFFFFFF)
        every = np.flatnonzero(shapes == shape)
        for at in range(0, len(every), CHUNK):
            places = every[at : at + CHUNK]
            run(places, data[begin[places][:, None] + np.arange(cells)].reshape(len(places), height, cells // height))


def each_scene(rows: pa.Array, say: Callable[[np.ndarray], pa.Array]) -> pa.Array:
    """What ``say`` makes of the scenes of each shape, in the order of the batch."""
    made, order = [pa.array([], pa.string())], []

    def run(places: np.ndarray, codes: np.ndarray) -> None:
        order.append(places)
        made.append(say(codes))

    by_shape(rows, run)
    if not order:
        return made[0]
    return pa.concat_arrays(made).take(pa.array(np.argsort(np.concatenate(order), kind="stable")))


def captions(rows: pa.Array, game: Game, absence: bool, upside_down: bool) -> pa.Array:
    """A caption for each platformer scene of a batch."""
    return each_scene(rows, lambda codes: Shapes(codes, game).captions(absence, upside_down))


def ladder_captions(rows: pa.Array, game: Game, absence: bool, sky_rows: int) -> pa.Array:
    """A caption for each scene of the ladder game."""
    return each_scene(rows, lambda codes: LadderShapes(codes, game).captions(absence, sky_rows))


def cells(batch: pa.RecordBatch, game: Game) -> Iterator[pa.RecordBatch]:
    """``(key, topic, r, c)`` for a batch of ``(key, rows)``."""
    out: list[pa.RecordBatch] = []

    def run(places: np.ndarray, codes: np.ndarray) -> None:
        topics, scenes, rows, cols = [], [], [], []
        for topic, scene, row, col in Shapes(codes, game).phrase_cells():
            topics.append(pa.repeat(pa.scalar(topic, pa.string()), len(scene)))
            scenes.append(places[scene])
            rows.append(row)
            cols.append(col)
        out.append(pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(np.concatenate(scenes))), pa.concat_arrays(topics),
             pa.array(np.concatenate(rows).astype(np.int32)), pa.array(np.concatenate(cols).astype(np.int32))],
            [batch.schema.names[0], "topic", "r", "c"]))

    by_shape(batch.column(1), run)
    yield from out
