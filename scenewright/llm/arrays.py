"""Words, bytes, rolling hashes and packed columns as numpy arrays.

Helpers that run inside Spark tasks on Arrow batches. Texts are handled in
slices of a few megabytes, so memory does not depend on the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)


def release() -> None:
    """Give back what Arrow holds free: a worker waits for its next task beside an executor that may need all the rest."""
    pa.default_memory_pool().release_unused()


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and n + 1 offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    ends = ends[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, bytes, offsets) of whole texts, about ``limit`` bytes at a time."""
    data, ends = utf8(texts)
    n, at = len(ends) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield at, to, data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def word_spans(data: np.ndarray, ends: np.ndarray, gap: np.ndarray = SPACE):
    """Start and end byte of every word, and the first word of each text (n + 1)."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~gap[data]
    lead = solid[1:-1] & ~solid[:-2]
    tail = solid[1:-1] & ~solid[2:]
    cut = ends[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    lead[cut] |= solid[1:-1][cut]
    tail[cut - 1] |= solid[1:-1][cut - 1]
    starts = np.flatnonzero(lead)
    return starts, np.flatnonzero(tail) + 1, np.searchsorted(starts, ends)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


#: So many powers of a base are kept (4 MB); longer runs are made anew.
POWERS = 1 << 19


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


@lru_cache(maxsize=2)
def _first_powers(base: np.uint64) -> np.ndarray:
    out = _powers(base, POWERS)
    out.flags.writeable = False
    return out


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base * base, ...; not to be written to."""
    return _first_powers(base)[:n] if n <= POWERS else _powers(base, n)


def byte_codes(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix polynomial of 64-bit values, one entry longer than they are."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), dtype=np.uint64, out=out[1:])
    return out


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], equal for equal contents wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(INVERSE, len(sums))[starts])


def windows_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` values."""
    n = len(sums) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((sums[width:] - sums[:-width]) * powers(INVERSE, n))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    sums = prefix(byte_codes(seed)[data])
    return spans_hash(sums, starts, ends) ^ mix((ends - starts).astype(np.uint64))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over every ``width`` consecutive values."""
    if len(values) < width:
        return values[:0]
    done, out = 1, values
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    if done < width:
        rest = width - done
        out = np.minimum(out[:-rest], out[rest:])
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every range, joined."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - skip, lengths)


def first_in_run(*columns: np.ndarray) -> np.ndarray:
    """True where any of the columns differs from the row before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = False
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of one length, one after the other."""
    return b"".join([np.int64(len(columns[0])).tobytes(), *(np.ascontiguousarray(c).tobytes() for c in columns)])


def unpack(blob: bytes, dtypes: list[str]) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(blob, np.int64, 1)[0]), 8, []
    for d in dtypes:
        out.append(np.frombuffer(blob, d, n, at))
        at += n * np.dtype(d).itemsize
    return out


def by_bucket(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Rows of each bucket that occurs, in their given order."""
    order = np.argsort(bucket, kind="stable")
    sorted_bucket = bucket[order]
    at = np.flatnonzero(first_in_run(sorted_bucket))
    to = np.append(at[1:], len(order))
    columns = [c[order] for c in columns]
    for a, b in zip(at, to):
        yield int(sorted_bucket[a]), [c[a:b] for c in columns]


def union_of_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the spans, in order; touching spans join."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return starts[at], reach[np.append(at[1:], len(starts)) - 1] if len(at) else starts
