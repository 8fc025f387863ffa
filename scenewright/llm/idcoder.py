"""Token ids in binary files, coded by a context-mixing range coder.

Ids are cut into blocks of ``BLOCK``. Every block starts from fresh guesses, has
its own CRC-32 and can be decoded alone with the models of its segment. Per id
three models predict: order 2 (the id that last followed the two before), order
1 (the one before) and order 0 (frequencies in the segment of the ids that both
miss). How far the order-2 and order-1 guesses are trusted is mixed from how
often they are right at their present confidences; both measures are taken over
the whole segment and stored with it. The coder is a range coder in its
last-in-first-out form (rANS): one step codes which model is right and, if it is
order 0, the id, and at most one 32-bit word moves. All blocks of a segment
advance together, one id of each block per step, so the work per id is a few
numpy operations over all blocks.

A file row is one segment: MAGIC, counts, document ids and lengths, the block
table (ids, bytes, CRC-32), the models and the coded blocks. Segments stand in ascending
doc_id order; ``part`` and ``first`` (ids before it in its part) place them.

Defined cases: null and empty texts are the end id alone; rows with a null
doc_id are left out; a repeated row is written once per row, next to its like;
an empty table writes no segment; extra columns are ignored. A damaged block
raises ValueError with its number, damaged models raise it as well.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenewright.llm import arrays as A
from scenewright.llm import tokens
from scenewright.llm.corpus import buckets, id_and_text
from scenewright.session import scratch_folder

BLOCK = 2048
#: Ids that a segment holds at most before it is coded.
SEGMENT_IDS = 6_000_000
PART_BYTES = 24 << 20
MAGIC = b"IDCM0002"
SLOT_BITS = 9
#: Confidences of two guesses and whether they are equal.
CONTEXTS = 32
#: Steps of a probability: which model is right, and the id by order 0.
WAY_BITS, ID_BITS = 12, 18
IDS = 1 << 16
#: A coder's state stays in [2**31, 2**63) between ids.
LEAST = 1 << 31


class Guesses:
    """Orders 2 and 1 of ``n`` blocks, the same in coder and decoder; a stretch of one flat table per order and block."""

    def __init__(self, n: int):
        self.table = np.full(2 * n << SLOT_BITS, 0xFFFF, np.uint32)  # id, confidence above
        self.first = (np.arange(2 * n) << SLOT_BITS).reshape(2, n)
        self.hash = np.zeros((2, n), np.uint16)
        self.older, self.newer = np.zeros(n, np.uint16), np.zeros(n, np.uint16)

    def predict(self) -> np.ndarray:
        """The context of each block; the two guesses are in ``guess``."""
        np.right_shift(self.older * np.uint16(40503) + self.newer * np.uint16(30011), 16 - SLOT_BITS, out=self.hash[0])
        np.bitwise_and(self.newer ^ (self.newer >> 7), (1 << SLOT_BITS) - 1, out=self.hash[1])
        self.slot = self.first + self.hash
        self.entry = self.table.take(self.slot)
        self.guess = self.entry.astype(np.uint16)
        trust = (self.entry >> 16).astype(np.uint8)
        return (trust[0] << 3) + (trust[1] << 1) + (self.guess[0] == self.guess[1])

    def learn(self, ids: np.ndarray) -> None:
        """A right guess is trusted more, to 3; a wrong one less, and at 0 the id takes its place."""
        entry, one = self.entry, 1 << 16
        wrong = np.where(entry >= one, entry - one, ids)
        self.table[self.slot] = np.where(self.guess == ids, np.minimum(entry + one, self.guess | np.uint32(3 * one)), wrong)
        self.older, self.newer = self.newer, ids


def _shares(counts: np.ndarray, bits: int) -> np.ndarray:
    """Whole shares of 2**bits of each row of counts; what occurs has one at least, and all are given away."""
    some = counts > 0
    free = (1 << bits) - some.sum(axis=-1, keepdims=True)
    share = some + counts * free // np.maximum(counts.sum(axis=-1, keepdims=True), 1)
    most = counts.argmax(axis=-1, keepdims=True)
    rest = (1 << bits) - share.sum(axis=-1, keepdims=True)
    np.put_along_axis(share, most, np.take_along_axis(share, most, -1) + rest, -1)
    return share


class Mixture:
    """Shares of the three models by context, and of the ids by order 0."""

    def __init__(self, ways: np.ndarray, ids: np.ndarray):
        self.ways, self.ids = ways, ids
        self.way_share, self.way_start = ways.ravel(), (np.cumsum(ways, axis=1) - ways).ravel()
        self.id_share, self.id_start = ids, np.cumsum(ids) - ids

    @classmethod
    def of(cls, contexts: np.ndarray, missed: np.ndarray) -> Mixture:
        """Measured: ``contexts`` by context and way, ids that both guesses miss."""
        seen = np.bincount(contexts.ravel(), minlength=3 * CONTEXTS).reshape(CONTEXTS, 3)
        return cls(_shares(seen + 1, WAY_BITS), _shares(np.bincount(missed, minlength=IDS), ID_BITS))

    def pack(self) -> bytes:
        used = np.flatnonzero(self.ids)
        packed = zlib.compress(b"".join([self.ways.astype("<u2").tobytes(), np.diff(used, prepend=0).astype("<u2").tobytes(),
                                         self.ids[used].astype("<u4").tobytes()]))
        return np.uint32(zlib.crc32(packed)).astype("<u4").tobytes() + packed

    @classmethod
    def unpack(cls, blob: bytes) -> Mixture:
        if len(blob) < 4 or zlib.crc32(blob[4:]) != int.from_bytes(blob[:4], "little"):
            raise ValueError("the models of the segment are damaged")
        raw = zlib.decompress(blob[4:])
        n = (len(raw) - 6 * CONTEXTS) // 6
        ids = np.zeros(IDS, np.int64)
        used = np.cumsum(np.frombuffer(raw, "<u2", n, 6 * CONTEXTS), dtype=np.int64)
        ids[used] = np.frombuffer(raw, "<u4", n, 6 * CONTEXTS + 2 * n)
        return cls(np.frombuffer(raw, "<u2", 3 * CONTEXTS).astype(np.int64).reshape(CONTEXTS, 3), ids)


def _in_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = max(1, -(-len(ids) // BLOCK))
    size = np.full(n, BLOCK, np.int64)
    size[-1] = len(ids) - BLOCK * (n - 1)
    padded = np.zeros(n * BLOCK, np.uint16)
    padded[: len(ids)] = ids
    return padded.reshape(n, BLOCK), size


def encode_blocks(ids: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The models and the coded blocks, and the blocks' numbers of ids (each below 65,535)."""
    blocks, size = _in_blocks(ids)
    columns = np.ascontiguousarray(blocks.T[: int(size.max())])
    n = len(blocks)
    guesses, contexts = Guesses(n), np.zeros(columns.shape, np.uint8)
    for now, context in zip(columns, contexts):
        found = guesses.predict()
        context[:] = 3 * found + np.where(now == guesses.guess[0], 0, np.where(now == guesses.guess[1], 1, 2))
        guesses.learn(now)
    models = Mixture.of(contexts, columns[contexts % 3 == 2])
    way_share, way_start, id_share, id_start = (
        x.astype(np.uint64) for x in (models.way_share, models.way_start, np.append(models.id_share, 1 << ID_BITS),
                                      np.append(models.id_start, 0)))
    # from the last id to the first: what was put last is read first
    state, rows, words = np.full(n, LEAST, np.uint64), [np.zeros(0, np.uint16)], [np.zeros(0, np.uint32)]
    missed = np.arange(3 * CONTEXTS) % 3 == 2
    for now, context in zip(columns[::-1], contexts[::-1]):
        share, of_id = way_share.take(context), np.where(missed.take(context), now, np.int64(IDS))  # a right guess needs no id
        id_of = id_share.take(of_id)
        full = np.flatnonzero(state >= (share * id_of) << (63 - WAY_BITS - ID_BITS))
        moved = state[full]
        rows.append(full)
        words.append(moved.astype(np.uint32))
        state[full] = moved >> 32
        part = state // id_of
        state += part * ((1 << ID_BITS) - id_of) + id_start.take(of_id)
        part = state // share
        state += part * ((1 << WAY_BITS) - share) + way_start.take(context)
    rows, words = np.concatenate(rows)[::-1], np.concatenate(words)[::-1]
    words = words[np.argsort(rows, kind="stable")].astype("<u4").tobytes()
    ends = 4 * np.cumsum(np.bincount(rows, minlength=n))
    last = state.astype("<u8").tobytes()
    return [models.pack(), *(last[8 * i : 8 * i + 8] + words[a:b] for i, (a, b) in enumerate(
        zip([0, *ends[:-1].tolist()], ends.tolist())))], size


def decode_blocks(blobs: list[bytes], size: np.ndarray) -> np.ndarray:
    """All ids of the blocks that follow their models."""
    models, blobs = Mixture.unpack(blobs[0]), blobs[1:]
    n, steps = len(blobs), int(size.max())
    state = np.frombuffer(b"".join(b[:8] for b in blobs), "<u8").astype(np.int64)
    words = np.frombuffer(b"".join([*(b[8:] for b in blobs), bytes(4)]), "<u4").astype(np.int64)
    n_words = np.array([len(b) // 4 - 2 for b in blobs], np.int64)
    at = np.cumsum(n_words) - n_words
    way_share, way_start, id_share, id_start = models.way_share, models.way_start, models.id_share, models.id_start
    one, two = way_start[1::3].copy(), way_start[2::3].copy()
    id_at = np.zeros(1 << ID_BITS, np.uint16)
    held = np.repeat(np.arange(IDS, dtype=np.uint16), id_share)
    id_at[: len(held)] = held
    guesses, out = Guesses(n), np.zeros((steps, n), np.uint16)
    for now in out:
        context = guesses.predict()
        value = state & ((1 << WAY_BITS) - 1)
        past, miss = value >= one.take(context), value >= two.take(context)
        context = 3 * context + past + miss
        state = way_share.take(context) * (state >> WAY_BITS) + value - way_start.take(context)
        now[:] = np.where(past, guesses.guess[1], guesses.guess[0])
        miss = np.flatnonzero(miss)
        low = state[miss]
        value = low & ((1 << ID_BITS) - 1)
        seen = id_at.take(value)
        state[miss] = id_share.take(seen) * (low >> ID_BITS) + value - id_start.take(seen)
        now[miss] = seen
        low = np.flatnonzero(state < LEAST)
        place = at[low]
        state[low] = state[low] << 32 | words.take(place, mode="clip")
        at[low] = place + 1
        guesses.learn(now)
    out = out.T
    return np.concatenate([out[i, :k] for i, k in enumerate(size.tolist())])


def write_segment(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    blobs, size = encode_blocks(ids)
    body = b"".join(blobs)
    raw = ids.astype("<u4")
    checks = [zlib.crc32(raw[i * BLOCK : i * BLOCK + k].tobytes()) for i, k in enumerate(size.tolist())]
    return b"".join([
        MAGIC, np.array([len(doc_ids), len(size)], "<i8").tobytes(), doc_ids.astype("<i8").tobytes(),
        lengths.astype("<i8").tobytes(), size.astype("<u4").tobytes(),
        np.array([len(b) for b in blobs], "<u4").tobytes(), np.array(checks, "<u4").tobytes(), body])


def read_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, lengths, ids) of a segment; every block is checked."""
    if data[:8] != MAGIC:
        raise ValueError("not a segment of token ids")
    n, m = np.frombuffer(data, "<i8", 2, 8).tolist()
    at = 24
    doc_ids = np.frombuffer(data, "<i8", n, at)
    lengths = np.frombuffer(data, "<i8", n, at + 8 * n)
    at += 16 * n
    size, stored_bytes, checks = (np.frombuffer(data, "<u4", k, at + 4 * j) for k, j in ((m, 0), (m + 1, m), (m, 2 * m + 1)))
    at += 12 * m + 4
    cut = at + np.concatenate([[0], np.cumsum(stored_bytes.astype(np.int64))])
    ids = decode_blocks([data[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())], size.astype(np.int64))
    raw, start = ids.astype("<u4"), 0
    for i, (k, check) in enumerate(zip(size.tolist(), checks.tolist())):
        if zlib.crc32(raw[start : start + k].tobytes()) != check:
            raise ValueError(f"block {i} of the segment is damaged")
        start += k
    return doc_ids, lengths, ids


def _write(batches, path, end_id):
    encoder, first = tokens.encoder(path), 0
    held, n_ids, part = [], 0, 0

    def segment():
        doc_ids, lengths, ids = (np.concatenate(c) for c in zip(*held))
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()),
             pa.array([write_segment(doc_ids, lengths, ids)], pa.binary())], ["part", "first", "n_ids", "segment"])

    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            piece = batch.slice(lo, 2000)
            part = piece.column(0)[0].as_py()
            ids, ends = tokens.with_end(*encoder.encode(piece.column(2)), end_id)
            held.append((piece.column(1).to_numpy(zero_copy_only=False).astype(np.int64), np.diff(ends), ids))
            n_ids += len(ids)
            if n_ids >= SEGMENT_IDS:
                yield segment()
                first, n_ids, held = first + n_ids, 0, []
    if held:
        yield segment()
    A.release()


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2) -> None:
    """Write the ids of all texts, in ascending doc_id order, to Parquet files of segments in ``folder``."""
    docs = id_and_text(docs)
    n = buckets(docs, PART_BYTES, 1)
    (docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
     .select(F.spark_partition_id().alias("part"), "doc_id", "text")
     .mapInArrow(lambda batches: _write(batches, tokenizer, end_id), "part int, first long, n_ids long, segment binary")
     .write.option("compression", "none").parquet(folder))


def _read(batches):
    for batch in batches:
        for part, first, data in zip(*(c.to_pylist() for c in batch.columns)):
            doc_ids, lengths, ids = read_segment(data)
            raw = ids.astype("<u4").tobytes()
            ends = np.concatenate([[0], np.cumsum(lengths)])
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(doc_ids), part, np.int32)), pa.array(doc_ids), pa.array(first + ends[:-1]),
                 pa.array(lengths), pa.array(crc, pa.int64())], ["part", "doc_id", "at", "n_tokens", "ids_crc32"])
    A.release()


def read_ids(spark, folder: str) -> DataFrame:
    """Per document, decoded from the files: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.parquet(folder)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row per part
    before, offsets = 0, []
    for part, n in totals:
        offsets.append((part, before))
        before += n
    base = spark.createDataFrame(offsets, "part int, before long")
    # a segment is decoded by one task: deal segments, not bytes, out
    return (files.select("part", "first", "segment").mapInArrow(
                _read, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
            .join(F.broadcast(base), "part")
            .select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    folder = f"{scratch_folder(docs.sparkSession, 'token-ids')}/files"
    write_ids(docs, folder, tokenizer, end_id)
    return read_ids(docs.sparkSession, folder)
