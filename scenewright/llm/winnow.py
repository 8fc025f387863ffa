"""Benchmark decontamination by winnowing.

A window is ``width`` consecutive words of a benchmark item (all words of a
shorter item). Of the hashes of all ``gram``-word runs in a window the smallest
is its fingerprint, so every shared window has a shared fingerprint at the same
place. Documents are fingerprinted in one pass; a fingerprint leaves it with the
words around it, as far as a window can reach. A Spark join by fingerprint finds
the items, and each hit is extended word by word to both sides: if it reaches a
window's length, the words it covers are contaminated. Items of n < ``width``
words are runs of n words and their own fingerprints.

Before the join, documents drop fingerprints that no item has, by a bit map of
fixed size (``MAP_BITS``) that is built from the benchmark and sent to all
tasks. The map only saves work: whatever passes it is compared by the join.
Hits carry hashes of words; an item's windows and a document's are equal if all
64-bit word hashes are.

Defined cases: null texts and texts without words have no words and no hits;
documents or items with a null id are left out; repeated rows are one document
or item; an empty benchmark hits nothing; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenewright.llm import arrays as A
from scenewright.llm.corpus import id_and_text
from scenewright.llm.minhash import LOWER

WIDTH, GRAM = 10, 5
MAP_BITS = 22
GAP = np.zeros(256, bool)
GAP[:0x80] = True
for _a, _b in ((0x30, 0x3A), (0x61, 0x7B)):
    GAP[_a:_b] = False
HIT = "kind int, fp long, at int, left binary, right binary"


def _words(data, ends):
    data = LOWER[data]
    starts, stops, first = A.word_spans(data, ends, GAP)
    return A.word_hashes(data, starts, stops), first


def fingerprints(hashes, first, length, width, gram):
    """(text, word in text, fingerprint) of all windows of ``length`` words."""
    sums = A.prefix(hashes)
    gram = gram if length == width else length
    grams = A.windows_hash(sums, gram)
    span = length - gram + 1
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    n = len(hashes) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    at = np.arange(n)
    inside = at + length <= first[1:][text[:n]]
    if span == 1:
        pick = at[inside]
    else:
        low = np.uint64(0xFFFFFFFF)
        keyed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        pick = np.unique((A.sliding_min(keyed, span)[:n][inside] & low).astype(np.int64))
    return text[pick], pick - first[text[pick]], grams[pick] ^ A.mix(np.full(1, length, np.uint64))[0]


def _around(hashes, first, text, at, gram, reach):
    """Up to ``reach`` word hashes on either side of every run, as bytes."""
    lo, hi = first[text], first[text + 1]
    p = lo + at
    raw = hashes.astype("<u8").tobytes()
    left = [raw[8 * a : 8 * b] for a, b in zip(np.maximum(lo, p - reach).tolist(), p.tolist())]
    right = [raw[8 * a : 8 * b] for a, b in zip((p + gram).tolist(), np.minimum(hi, p + gram + reach).tolist())]
    return left, right


def _hits(hashes, first, lengths, width, gram, seen=None):
    """Fingerprint records (text, kind, fp, at, left, right) of a slice, for each window length."""
    for length in lengths:
        text, at, fp = fingerprints(hashes, first, length, width, gram)
        if seen is not None:
            bit = (fp >> np.uint64(64 - MAP_BITS)).astype(np.int64)
            ok = (seen[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 != 0
            text, at, fp = text[ok], at[ok], fp[ok]
        size = gram if length == width else length
        left, right = _around(hashes, first, text, at, size, length - size)
        yield text, np.full(len(text), length), fp.view(np.int64), at, left, right


def _item_rows(batches, width, gram):
    for batch in batches:
        for a, b, data, ends in A.slices(batch.column(1)):
            ids = batch.column(0).slice(a, b - a)
            hashes, first = _words(data, ends)
            counts = np.diff(first)
            for length in sorted({int(min(c, width)) for c in counts.tolist() if c}):
                whole = counts >= width if length == width else counts == length
                for text, kind, fp, at, left, right in _hits(hashes, first, [length], width, gram):
                    ok = np.flatnonzero(whole[text])
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(text[ok])), pa.array(kind[ok], pa.int32()), pa.array(fp[ok]),
                         pa.array([left[i] for i in ok], pa.binary()), pa.array([right[i] for i in ok], pa.binary())],
                        ["item_id", "kind", "fp", "item_left", "item_right"])


def _doc_rows(batches, lengths, width, gram, seen):
    for batch in batches:
        for a, b, data, ends in A.slices(batch.column(1)):
            hashes, first = _words(data, ends)
            records = [[] for _ in range(b - a)]
            for text, *columns in _hits(hashes, first, lengths, width, gram, seen):
                for t, *hit in zip(text.tolist(), *(c.tolist() if isinstance(c, np.ndarray) else c for c in columns)):
                    records[t].append(dict(zip(("kind", "fp", "at", "left", "right"), hit)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(np.diff(first), pa.int64()),
                 pa.array(records, pa.list_(pa.struct([("kind", pa.int32()), ("fp", pa.int64()), ("at", pa.int32()),
                                                       ("left", pa.binary()), ("right", pa.binary())])))],
                ["doc_id", "n_words", "hits"])


def _shared(a: bytes, b: bytes, backwards: bool) -> int:
    n = min(len(a), len(b))
    if backwards:
        a, b = a[len(a) - n :], b[len(b) - n :]
    same = np.frombuffer(a[:n], "<u8") == np.frombuffer(b[:n], "<u8")
    if backwards:
        same = same[::-1]
    return int(len(same) if same.all() else same.argmin())


def _extend(batches, width, gram):
    """Covered word ranges of joined fingerprints; none if the hit stays below a window."""
    for batch in batches:
        doc, n_words, item, kind, at, *sides = (c.to_pylist() for c in batch.columns)
        begin, end = [], []
        for k, p, left, right, item_left, item_right in zip(kind, at, *sides):
            if k is None or item_left is None:
                begin.append(None)
                end.append(None)
                continue
            size = gram if k == width else k
            back, forth = _shared(left, item_left, True), _shared(right, item_right, False)
            whole = back + size + forth >= k
            begin.append(p - back if whole else None)
            end.append(p + size + forth if whole else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(begin, pa.int64()), pa.array(end, pa.int64())],
            ["doc_id", "n_words", "item_id", "begin", "end"])


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (their ids, sorted as strings), hit_ranges, contaminated.

    ``hit_ranges`` are the covered word ranges [begin, end), as found.
    """
    items = (id_and_text(items, "item_id").withColumnRenamed("doc_id", "item_id").dropDuplicates(["item_id", "text"])
             .mapInArrow(lambda batches: _item_rows(batches, width, gram),
                         "item_id long, kind int, fp long, item_left binary, item_right binary"))
    lengths = sorted(r[0] for r in items.select("kind").distinct().collect())  # at most ``width`` values
    bits = items.select(F.shiftrightunsigned("fp", 64 - MAP_BITS).alias("bit")).distinct()
    # words of the map, one long each: at most 2**MAP_BITS / 64 rows
    words = (bits.groupBy(F.floor(F.col("bit") / 64).alias("word"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("value")).collect())
    seen = np.zeros(1 << (MAP_BITS - 6), np.int64)
    for word, value in words:
        seen[word] = value
    seen = seen.view(np.uint8)
    found = id_and_text(docs).mapInArrow(
        lambda batches: _doc_rows(batches, lengths, width, gram, seen),
        f"doc_id long, n_words long, hits array<struct<{HIT}>>")
    hits = (found.select("doc_id", "n_words", F.explode_outer("hits").alias("h"))
            .select("doc_id", "n_words", "h.*"))
    joined = (hits.join(items, ["kind", "fp"], "left")
              .select("doc_id", "n_words", "item_id", "kind", "at", "left", "right", "item_left", "item_right"))
    ranges = joined.mapInArrow(lambda batches: _extend(batches, width, gram),
                               "doc_id long, n_words long, item_id long, begin long, end long")
    hit = F.col("begin").isNotNull()
    whole = ranges.groupBy("doc_id", "n_words").agg(
        F.collect_set(F.when(hit, F.struct("begin", "end"))).alias("hit_ranges"),
        F.array_sort(F.collect_set(F.when(hit, F.col("item_id").cast("string")))).alias("items"))
    words = F.flatten(F.transform("hit_ranges", lambda r: F.sequence(r["begin"], r["end"] - 1)))
    n_hit = F.when(F.size("hit_ranges") == 0, F.lit(0)).otherwise(F.size(F.array_distinct(words)))
    return (whole.withColumn("n_hit", n_hit.cast("long")).withColumn("n_items", F.size("items").cast("long"))
            .withColumn("contaminated", F.col("n_hit") > 0)
            .select("doc_id", "n_words", "n_hit", "n_items", "items", "hit_ranges", "contaminated"))
