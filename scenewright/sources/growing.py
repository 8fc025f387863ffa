"""Tail of text files that grow in place, as a streaming source.

The offset of a stream is, for every file, the byte after the last whole line; that of many files is
kept in a file the offset names.
A batch is the bytes between two offsets, cut into ranges of bounded size that
tasks read on their own; a range owns the lines that start in it. A restarted
query goes on from its checkpoint. What was read must stay: a file that became
shorter, disappeared or has another beginning is an error.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from scenewright.session import scratch_folder
from scenewright.sources.tree import system

LINE = "file string, at bigint, line string"
#: Bytes of a file's beginning that must not change.
HEAD = 1024
#: Bytes of a task, unless that makes more than ``MOST_TASKS``.
RANGE, MOST_TASKS = 32 << 20, 20_000
READ = 1 << 20
#: An offset lists up to so many files itself. Spark holds offsets several times over, and keeps them in its reports.
INLINE = 1000
THREADS = 16


@dataclass
class Ranges(InputPartition):
    """(path, start of the batch, from, to, end of the batch) of the ranges of one task."""

    ranges: list[tuple[str, int, int, int, int]]

    def __getstate__(self) -> bytes:
        return zlib.compress(pickle.dumps(self.ranges), 1)  # paths are long and alike

    def __setstate__(self, state: bytes) -> None:
        self.ranges = pickle.loads(zlib.decompress(state))


def _listed(path: str, suffix: str) -> pa.Table:
    """``(path, size)`` of the files, in order of their paths."""
    found, inner, front = system(path)
    info = found.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return pa.table({"path": [front + inner], "size": pa.array([info.size], pa.int64())})
    every = found.get_file_info(fs.FileSelector(inner, recursive=True))
    kept = [x for x in every if x.type == fs.FileType.File and x.path.endswith(suffix)]
    del every
    out = pa.table({"path": pa.array([front + x.path for x in kept], pa.string()),
                    "size": pa.array([x.size for x in kept], pa.int64())})
    del kept
    return out.sort_by("path")


def _read_at(path: str, at: int, length: int) -> bytes:
    found, inner, _ = system(path)
    with found.open_input_file(inner) as source:
        return source.read_at(length, at)


def _whole_lines(path: str, size: int) -> tuple[int, int, int]:
    """(the byte after the last line break in the first ``size`` bytes, length of the head, its checksum)."""
    found, inner, _ = system(path)
    with found.open_input_file(inner) as source:
        at = size
        data, start = b"", size
        while at:
            start = max(0, at - READ)
            data = source.read_at(at - start, start)
            last = data.rfind(b"\n")
            if last >= 0:
                at = start + last + 1
                break
            at = start
        head = min(HEAD, at)
        return at, head, zlib.crc32(data[:head] if not start else source.read_at(head, 0))


def _each(run: Callable, paths: list[str], *columns: list) -> list:
    """``run`` for every file; by threads where the store is far away."""
    if not paths or isinstance(system(paths[0])[0], fs.LocalFileSystem):
        return list(map(run, paths, *columns))
    with ThreadPoolExecutor(THREADS) as pool:
        return list(pool.map(run, paths, *columns))


STATE = pa.schema([("path", pa.string()), ("at", pa.int64()), ("head", pa.int64()), ("crc", pa.int64())])


def _state(offset: dict) -> pa.Table:
    """``(path, at, head, crc)`` of an offset, from itself or from the file it names."""
    if "files" in offset:
        rows = [(p, x["at"], x["head"], x["crc"]) for p, x in sorted(offset["files"].items())]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), STATE)] if rows else [[]] * 4, schema=STATE)
    found, inner, _ = system(offset["state"])
    with found.open_input_file(inner) as source:
        return pq.read_table(source).combine_chunks()


def _offset(state: pa.Table, folder: str) -> dict:
    """Few files are listed in the offset, more in a file beside; the offset names it, and its contents its name."""
    if state.num_rows <= INLINE:
        return {"files": {p: {"at": a, "head": h, "crc": c} for p, a, h, c in zip(*(x.to_pylist() for x in state.columns))}}
    state = state.combine_chunks()
    sink = pa.BufferOutputStream()
    pq.write_table(state, sink, compression="zstd")
    data = sink.getvalue()
    path = f"{folder}/{hashlib.sha256(data).hexdigest()}.parquet"
    found, inner, _ = system(path)
    if found.get_file_info(inner).type == fs.FileType.NotFound:
        found.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        new = f"{inner}.{uuid.uuid4().hex}.new"
        with found.open_output_stream(new) as out:
            out.write(data)
        found.move(new, inner)
    return {"state": path, "files_read": state.num_rows}


def _lines(path: str, first: int, start: int, stop: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that start in [start, stop); ``first`` starts a line and ``end`` ends one."""
    found, inner, _ = system(path)
    with found.open_input_file(inner) as source:
        at = start
        rest = b""
        if start > first:  # a line that started before belongs to the range before
            at = start - 1
            source.seek(at)
            while True:
                data = source.read(min(READ, end - at))
                cut = data.find(b"\n")
                if cut >= 0:
                    rest, at = data[cut + 1:], at + cut + 1
                    break
                at += len(data)
                if not data or at >= end:
                    return
        else:
            source.seek(at)
        read = at + len(rest)
        held: list[bytes] = []  # a long line's earlier pieces
        while at < stop:
            parts = rest.split(b"\n")
            for part in parts[:-1]:
                line = b"".join([*held, part])
                held = []
                yield at, line[:-1] if line.endswith(b"\r") else line
                at += len(line) + 1
                if at >= stop:
                    return
            held.append(parts[-1])
            rest = source.read(min(READ, end - read))
            if not rest:
                if read < end:
                    raise ValueError(f"{path} became shorter while it was read")
                return
            read += len(rest)


def _batches(partition: Ranges) -> Iterator[pa.RecordBatch]:
    for path, first, start, stop, end in partition.ranges:
        at: list[int] = []
        lines: list[str] = []
        held = 0

        def batch():
            return pa.RecordBatch.from_arrays(
                [pa.array([path] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(lines, pa.string())],
                ["file", "at", "line"])

        for offset, line in _lines(path, first, start, stop, end):
            at.append(offset)
            lines.append(line.decode(errors="replace"))
            held += len(line)
            if held > 4 << 20 or len(at) == 10_000:
                yield batch()
                at, lines, held = [], [], 0
        if at:
            yield batch()


def _cut(spans: list[tuple[str, int, int]], size: int) -> list[Ranges]:
    """Ranges of at most ``size`` bytes, small ones together in one task."""
    size = max(size, -(-sum(b - a for _, a, b in spans) // MOST_TASKS))
    out: list[Ranges] = []
    room = 0
    for path, a, b in spans:
        for start in range(a, b, size):
            stop = min(b, start + size)
            if stop - start > room:
                out.append(Ranges([]))
                room = size
            out[-1].ranges.append((path, a, start, stop, b))
            room -= stop - start
    return out


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.size = int(options.get("rangebytes", RANGE))
        self.folder = options.get("offsets")
        self.seen: pa.Table | None = None

    def initialOffset(self) -> dict:
        return {"files": {}}

    def _now(self) -> pa.Table:
        """``STATE`` of all files that have a whole line; only changed files are opened."""
        now = _listed(self.path, self.suffix)
        paths, sizes = now["path"].combine_chunks(), now["size"].to_numpy()
        made = np.zeros((now.num_rows, 3), np.int64)
        changed = np.ones(now.num_rows, bool)
        if self.seen is not None:
            place = pc.index_in(paths, self.seen["path"].combine_chunks()).fill_null(-1).to_numpy()
            known = place >= 0
            same = np.flatnonzero(known)[self.seen["size"].to_numpy()[place[known]] == sizes[known]]
            changed[same] = False
            made[same] = np.stack([self.seen[c].to_numpy()[place[same]] for c in STATE.names[1:]], axis=1)
        at = np.flatnonzero(changed)
        if len(at):
            made[at] = _each(_whole_lines, paths.take(pa.array(at)).to_pylist(), sizes[at].tolist())
        parts = [pa.array(made[:, i]) for i in range(3)]
        self.seen = pa.table([paths, now["size"], *parts], ["path", "size", *STATE.names[1:]])
        return pa.table([paths, *parts], schema=STATE).filter(pa.array(made[:, 0] > 0))

    def latestOffset(self) -> dict:
        if self.folder is None:
            self.folder = tempfile.mkdtemp(prefix="scenewright-offsets-")
        return _offset(self._now(), self.folder)

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        return self._ranges(_state(start), _state(end)) or [Ranges([])]

    def _ranges(self, before: pa.Table, after: pa.Table) -> list[Ranges]:
        old, new = (x["path"].combine_chunks() for x in (before, after))
        place = pc.index_in(old, new)
        if place.null_count:
            raise ValueError(f"{old.filter(place.is_null())[0]} was read and has no lines or is gone")
        place = place.to_numpy()
        was, now = before["at"].to_numpy(), after["at"].to_numpy()
        for i in np.flatnonzero(now[place] < was).tolist():
            raise ValueError(f"{old[i]} became shorter: {was[i]} bytes were read, {now[place[i]]} are left")
        differ = np.zeros(len(old), bool)
        for c in STATE.names[1:]:
            differ |= before[c].to_numpy() != after[c].to_numpy()[place]
        grown = np.flatnonzero(differ)
        heads = before["head"].to_numpy()[grown].tolist()
        found = _each(lambda p, n: zlib.crc32(_read_at(p, 0, n)), old.take(pa.array(grown)).to_pylist(), heads) if len(grown) else []
        for i, crc in zip(grown.tolist(), found):
            if crc != before["crc"][i].as_py():
                raise ValueError(f"{old[i]} has another beginning than what was read of it")
        first = np.zeros(len(new), np.int64)
        first[place] = was
        more = np.flatnonzero(first < now)
        return _cut([*zip(new.take(pa.array(more)).to_pylist(), first[more].tolist(), now[more].tolist())], self.size)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return _batches(partition)


class _Batch(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.stream = _Stream(options)

    def partitions(self) -> list[Ranges]:
        return self.stream._ranges(_state(self.stream.initialOffset()), self.stream._now()) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return _batches(partition)


class GrowingLines(DataSource):
    """Options: ``path`` (a file or a folder), ``suffix`` of file names, ``rangebytes`` of a task."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return LINE

    def _lower(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self._lower())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self._lower())


def growing_lines(spark: SparkSession, path: str, suffix: str = "", stream: bool = True, range_bytes: int = RANGE
                  ) -> DataFrame:
    """``(file, at, line)`` of whole lines, ``at`` being the line's first byte.

    A line without its line break waits until that is written. Bytes that are
    not UTF-8 become replacement characters. The state of many files is in a file
    of the shared folder, and the offset names it, so Spark holds no list of files.
    """
    spark.dataSource.register(GrowingLines)
    reader = (spark.readStream if stream else spark.read).format("growing_lines")
    if stream:
        reader = reader.option("offsets", scratch_folder(spark, "offsets"))
    return reader.option("path", path).option("suffix", suffix).option("rangebytes", range_bytes).load()


def growing_records(spark: SparkSession, path: str, schema: str, suffix: str = ".jsonl", stream: bool = True,
                    bad_lines: str = "skip", range_bytes: int = RANGE) -> DataFrame:
    """Fields of JSON lines with ``file`` and ``at``; a line that is no object is skipped, raised or kept with nulls."""
    if bad_lines not in ("skip", "raise", "keep"):
        raise ValueError(f"bad_lines: {bad_lines}")
    lines = growing_lines(spark, path, suffix, stream, range_bytes).where("trim(line) <> ''")
    mode = {"mode": "FAILFAST" if bad_lines == "raise" else "PERMISSIVE"}
    if bad_lines == "skip":
        lines = lines.where(F.try_parse_json("line").isNotNull() & F.ltrim("line").startswith("{"))
    return lines.select("file", "at", F.from_json("line", schema, mode).alias("r")).select("file", "at", "r.*")
