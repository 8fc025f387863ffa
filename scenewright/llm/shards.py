"""Shards of near equal bytes by histogram sort.

Every row gets one sortable key: a hash of its text, its id, and a number that
tells repeated rows apart. A pass counts rows and exact bytes between candidate
keys in every partition and adds the counts up; around each wanted splitter the
bracket of keys shrinks to the one interval that holds the target (and inside it
to the least and largest key found there) and gets new candidates, until the
bytes below a candidate are within ``tolerance`` of the target. Then the rows go
to their place in a single exchange.

A splitter between two different texts is taken if one lies within the
tolerance, so equal texts stay together; else (a group of copies larger than the
tolerance) the search goes on inside the group, by id, and ends at the row
boundary nearest to the target at the latest.

The exchange deals rows into ranges of bounded size whose limits come from the
same passes; a shard is some consecutive ranges, and the counted rows before a
range give its first slot. No task holds a shard.

The driver holds a few numbers per candidate, some 30 candidates per splitter.

Defined cases: a null or empty text has size 1 and checksum 0, and both are the
same group; null ids are kept and come first in their group; repeated rows are
placed once each; very long texts are never cut, so a splitter next to one can
miss the tolerance by up to its size; an empty table gives no rows; columns that
are not named may be anything.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scenewright.llm.corpus import stored

#: Largest distance of a shard limit from its target, as a share of a shard.
TOLERANCE = 0.005
#: The same for the limits of exchange ranges, which only bound a task.
LOOSE = 0.25
PROBES = 32
RANGE_BYTES = 64 << 20
#: Hex digits of a key: text hash, mark and id, number of the row.
GROUP_DIGITS, DIGITS = 16, 50
COUNTS = "bucket int, bytes long, n long, low string, high string"


def _hex(value: Column) -> Column:
    return F.lpad(F.hex(value), 16, "0")


def sort_key(text: Column, key: Column) -> Column:
    """Hex text whose order is that of (text hash, id with null first, row)."""
    flipped = key.cast("long").bitwiseXOR(F.lit(-(1 << 63)))  # negative ids before positive ones
    return F.concat(_hex(F.xxhash64(text)), F.coalesce(F.concat(F.lit("01"), _hex(flipped)), F.lit("0" * 18)),
                    _hex(F.monotonically_increasing_id()))


def _digits(key: int) -> str:
    return f"{key:0{DIGITS}X}" if key < 16**DIGITS else "G"  # beyond every key


def _counter(probes: list[int]):
    limits = np.array([_digits(p).encode() for p in probes], f"S{DIGITS}")

    def count(batches):
        size = np.zeros((2, len(limits) + 1), np.int64)
        low, high = {}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            _, starts, text = batch.column(0).buffers()
            start = int(np.frombuffer(starts, np.int32)[batch.column(0).offset])
            keys = np.frombuffer(text, f"S{DIGITS}", batch.num_rows, start)
            order = np.argsort(keys, kind="stable")
            keys, weight = keys[order], batch.column(1).to_numpy()[order]
            at = np.searchsorted(limits, keys, side="right")
            seen, first = np.unique(at, return_index=True)
            size[0] += np.bincount(at, weight, size.shape[1]).astype(np.int64)
            size[1] += np.bincount(at, minlength=size.shape[1])
            for bucket, a, z in zip(seen.tolist(), keys[first].tolist(), keys[np.append(first[1:], len(keys)) - 1].tolist()):
                low[bucket] = min(a, low.get(bucket, a))
                high[bucket] = max(z, high.get(bucket, z))
        used = sorted(low)
        yield pa.RecordBatch.from_arrays([
            pa.array(used, pa.int32()), pa.array(size[0][used], pa.int64()), pa.array(size[1][used], pa.int64()),
            pa.array([low[b].decode() for b in used], pa.string()), pa.array([high[b].decode() for b in used], pa.string())],
            ["bucket", "bytes", "n", "low", "high"])

    return count


@dataclass
class Edge:
    """A place in the order: the first key at or after it, and what lies before."""

    key: int
    bytes: int
    rows: int


@dataclass
class Splitter:
    """The search for one limit."""

    target: float
    tolerance: float
    unit: int  # limits are multiples of it: whole groups, or single rows
    low: Edge
    high: Edge
    best: Edge | None = None
    done: bool = False

    def near(self, edge: Edge) -> None:
        if self.best is None or abs(edge.bytes - self.target) < abs(self.best.bytes - self.target):
            self.best = edge

    def probes(self, sharing: int) -> list[int]:
        a, z = self.low.key // self.unit, self.high.key // self.unit
        n = min(PROBES * sharing, z - a - 1)
        return [(a + (z - a) * i // (n + 1)) * self.unit for i in range(1, n + 1)]

    def settle(self) -> None:
        """End the search, or go from groups to rows, once the bracket holds a single unit or the best is near enough."""
        self.near(self.low)
        self.near(self.high)
        if abs(self.best.bytes - self.target) <= self.tolerance:
            self.done = True
        elif self.high.key - self.low.key <= self.unit:
            self.done = self.unit == 1
            self.unit = 1


def _aligned(edges: list[tuple[Edge, Edge]], unit: int):
    """The intervals, widened to multiples of ``unit``; those that share one are a single interval."""
    held = None
    for low, high in edges:
        if held and (held[1].key - 1) // unit == low.key // unit:
            held = (held[0], high)
            continue
        if held:
            yield held[0], Edge(-(-held[1].key // unit) * unit, held[1].bytes, held[1].rows)
        held = (Edge(low.key // unit * unit, low.bytes, low.rows), high)
    yield held[0], Edge(-(-held[1].key // unit) * unit, held[1].bytes, held[1].rows)


def search(keyed: DataFrame, total: Edge, splitters: list[Splitter]) -> None:
    """Refine all splitters together; one pass over keys and sizes a round."""
    table = keyed.select("key", "size")
    for s in splitters:
        s.settle()
    while any(not s.done for s in splitters):
        open_ = [s for s in splitters if not s.done]
        sharing = Counter((s.low.key, s.high.key) for s in open_)  # splitters with one bracket, as at the start
        probes = sorted({p for s in open_ for p in s.probes(sharing[s.low.key, s.high.key])})
        counts = {r["bucket"]: r for r in table.mapInArrow(_counter(probes), COUNTS).groupBy("bucket").agg(
            F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()}
        edges, before = [], Edge(0, 0, 0)  # first key of each interval that holds rows, and the place after its last
        for bucket in range(len(probes) + 1):
            row = counts.get(bucket)
            if row:
                after = Edge(int(row["high"], 16) + 1, before.bytes + row["bytes"], before.rows + row["n"])
                edges.append((Edge(int(row["low"], 16), before.bytes, before.rows), after))
                before = after
        for s in open_:
            low, high = next(x for x in _aligned(edges, s.unit) if x[0].bytes <= s.target <= x[1].bytes)
            s.low = max(s.low, low, key=lambda e: e.key)  # the first and last interval reach beyond the bracket
            s.high = min(s.high, high, key=lambda e: e.key)
            s.settle()


def place(keyed: DataFrame, shards: int, tolerance: float = TOLERANCE, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Add ``shard`` and ``slot`` to rows with ``key`` and ``size``."""
    spark = keyed.sparkSession
    n, size, high = keyed.agg(F.count("*"), F.sum("size"), F.max("key")).first()
    if not n:
        return keyed.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    start, end = Edge(0, 0, 0), Edge(int(high, 16) + 1, size, n)
    one, unit = size / shards, 16 ** (DIGITS - GROUP_DIGITS)
    whole = Edge(-(-end.key // unit) * unit, size, n)
    limits = [Splitter(one * i, one * tolerance, unit, start, whole) for i in range(1, shards)]
    per_shard = -(-max(-(-size // range_bytes), int(spark.conf.get("spark.sql.shuffle.partitions"))) // shards)
    part = one / per_shard
    inner = [Splitter(part * i, part * LOOSE, 1, start, end) for i in range(1, shards * per_shard) if i % per_shard]
    search(keyed, end, limits + inner)
    # limits of shards in order, then all ranges
    cuts = sorted((s.best.key, s.best.rows) for s in limits)
    ranges = sorted({(0, 0), *cuts, *((s.best.key, s.best.rows) for s in inner)})
    shard = [sum(key <= at for key, _ in cuts) for at, _ in ranges]
    firsts = [0, *(rows for _, rows in cuts)]
    known = lambda values: F.split(F.lit(",".join(map(str, values))), ",")
    steps = max(1, (len(ranges) - 1).bit_length())
    powers = F.array(*[F.lit(1 << i) for i in reversed(range(steps))])
    bounds = known(_digits(key) for key, _ in ranges[1:]) if ranges[1:] else F.array(F.lit("G"))
    found = F.aggregate(powers, F.lit(0), lambda at, p: at + F.when(F.get(bounds, at + p - 1) <= F.col("key"), p).otherwise(0))
    lookup = lambda values, kind: F.get(known(values), F.col("_range")).cast(kind)
    within = F.row_number().over(W.partitionBy("_range").orderBy("key")) - 1
    return (keyed.withColumn("_range", found).withColumn("slot", within + lookup([r for _, r in ranges], "long"))
            .withColumn("shard", lookup(shard, "int"))
            .withColumn("slot", F.col("slot") - F.get(known(firsts), F.col("shard")).cast("long")).drop("_range"))


def shard_documents(docs: DataFrame, shards: int = 8, carry: list[str] | None = None, key: str = "doc_id", text: str = "text",
                    tolerance: float = TOLERANCE, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The columns ``carry`` (default: all) in a struct ``row``, with size, text_crc32, shard and slot."""
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)])
    keyed = stored(docs.select(
        sort_key(content, F.col(f"`{key}`")).alias("key"), (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"), row.alias("row")), "shards-keyed")
    return place(keyed, shards, tolerance, range_bytes).drop("key")


def write_shards(docs: DataFrame, path: str, shards: int = 8, **options) -> None:
    """Write whole rows as Parquet under ``path``/shard=0 and so on; ``slot`` is the place in the shard."""
    placed = shard_documents(docs, shards, **options)
    placed.write.partitionBy("shard").parquet(path)
