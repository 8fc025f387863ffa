"""Substring dedup by De Bruijn compaction.

Every window of ``width`` words is a k-mer, an edge between its first and its
last ``width - 1`` words. The graph is cut the way assemblers cut it: a k-mer
belongs to the bucket of its minimizer (the smallest hash of ``anchor``
consecutive words in it), so a stretch of consecutive k-mers with one minimizer
(a super-k-mer) travels as one record and every occurrence of an edge meets in
one bucket.

1. Map: hash words, cut super-k-mers, and keep each distinct edge once per few
   million words, at its earliest coordinate (doc_id, first word). An edge that
   is in a third of all documents is therefore one record per map chunk.
2. Bucket: equal edges are grouped; the earliest coordinate is the source.
   Edges that follow each other in a document and whose sources follow each
   other too are one repeated nonbranching path: at a branch the source jumps.
   A path leaves the bucket as (document, start, edges, source document,
   source start).
3. Join: paths meet their document by a Spark join on doc_id; adjacent paths
   with continuing source coordinates are glued over bucket borders and the
   covered words are cut.

Edges are compared on 112 bits (64 of the minimizer, 48 of the whole window),
and a path's every edge must name the next source coordinate, which verifies
long spans once more.

Defined cases: null or empty text has no words; texts of fewer than ``width``
words have no window; rows with a null doc_id cannot be named and are left out;
a repeated row (same doc_id and text) is one document and gives its result once
per row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenewright.llm import arrays as A
from scenewright.llm.corpus import buckets, id_and_text

WIDTH = 20
ANCHOR = 5
#: Words of text that one map chunk holds before it is sorted and dealt out.
CHUNK_WORDS = 2_000_000
#: Bytes of text whose edges meet in one bucket, about.
BUCKET_BYTES = 6 << 20
EDGES = ["<u8", "<i8", "<i4", "<u2"]  # minimizer, doc_id, first word, edges of each record
PATHS = ["<i8", "<i4", "<i4", "<i8", "<i4"]  # doc_id, start, edges, source doc_id, source start


def paths_of(doc, at, sdoc, sat):
    """Compact edges, sorted by (doc, at), into nonbranching paths."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1) | (sdoc[1:] != sdoc[:-1]) | (sat[1:] != sat[:-1] + 1)
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(doc)))
    return [doc[head], at[head].astype(np.int32), n.astype(np.int32), sdoc[head], sat[head].astype(np.int32)]


def repeated_paths(low, tail, doc, at):
    """(paths of edges that start earlier too, index of the earliest of each edge)."""
    order = np.lexsort((at, doc, tail, low))
    new = A.first_in_run(low[order], tail[order])
    source = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = order[~new]
    source = source[~new]
    apart = (doc[later] != doc[source]) | (at[later] != at[source])  # a repeated row is one document
    later, source = later[apart], source[apart]
    back = np.lexsort((at[later], doc[later]))
    later, source = later[back], source[back]
    return paths_of(doc[later], at[later], doc[source], at[source]), np.sort(order[new])


def _edge_chunk(parts, n_buckets):
    low, tail, doc, at = (np.concatenate(c) for c in zip(*parts))
    if not len(low):
        return
    paths, kept = repeated_paths(low, tail, doc, at)
    home = (A.mix(paths[0].astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
    for bucket, columns in A.by_bucket(home, paths):
        yield bucket, 1, A.pack(columns)
    low, tail, doc, at = low[kept], tail[kept], doc[kept], at[kept]
    # a super-k-mer: consecutive edges of one document and one minimizer
    head = A.first_in_run(low, doc, at - np.arange(len(at)))
    first = np.flatnonzero(head)
    count = np.diff(np.append(first, len(low)))
    over = np.flatnonzero(count > 0xFFFF)
    if len(over):
        cuts = [np.arange(first[i] + 0xFFFF, first[i] + count[i], 0xFFFF) for i in over]
        first = np.sort(np.concatenate([first, *cuts]))
        count = np.diff(np.append(first, len(low)))
    home = (A.mix(low[first]) % np.uint64(n_buckets)).astype(np.int64)
    tails = np.ascontiguousarray(tail.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]
    for bucket, (m, d, a, n, f) in A.by_bucket(home, [low[first], doc[first], at[first], count, first]):
        gap = np.diff(d, prepend=np.int64(0))
        blob = A.pack([m, gap.astype("<i8"), a.astype("<i4"), n.astype("<u2")])
        yield bucket, 0, blob + tails[A.ranges(f, n)].tobytes()


def _edges(batches, width, anchor, n_buckets):
    parts, words = [], 0
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b, data, ends in A.slices(batch.column(1)):
            starts, stops, first = A.word_spans(data, ends)
            if len(starts) < width:
                continue
            sums = A.prefix(A.word_hashes(data, starts, stops))
            low = A.sliding_min(A.windows_hash(sums, anchor), width - anchor + 1)
            tail = A.windows_hash(sums, width) & np.uint64((1 << 48) - 1)
            text = np.repeat(np.arange(b - a), np.diff(first))[: len(low)]
            at = np.arange(len(low)) - first[text]
            inside = np.flatnonzero(at + width <= np.diff(first)[text])
            parts.append((low[inside], tail[inside], ids[a:b].astype(np.int64)[text[inside]], at[inside]))
            words += len(starts)
            if words >= CHUNK_WORDS:
                yield from _rows(_edge_chunk(parts, n_buckets))
                parts, words = [], 0
    if parts:
        yield from _rows(_edge_chunk(parts, n_buckets))


def _rows(items):
    items = list(items)
    if items:
        bucket, kind, blob = zip(*items)
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())],
            ["bucket", "kind", "blob"])


def _unpack_edges(blob):
    m, gap, a, n = A.unpack(blob, EDGES)
    total = n.astype(np.int64)
    tails = np.zeros((int(total.sum()), 8), np.uint8)
    at = 8 + len(m) * 22
    tails[:, :6] = np.frombuffer(blob, np.uint8, len(tails) * 6, at).reshape(-1, 6)
    return (np.repeat(m, total), tails.view("<u8").ravel(), np.repeat(np.cumsum(gap), total),
            A.ranges(a.astype(np.int64), total))


def _compact(table: pa.Table) -> pa.Table:
    edges, paths = [], []
    for kind, blob in zip(table["kind"].to_pylist(), table["blob"].to_pylist()):
        if kind:
            paths.append(A.unpack(blob, PATHS))
        else:
            edges.append(_unpack_edges(blob))
    if edges:
        paths.append(repeated_paths(*(np.concatenate(c) for c in zip(*edges)))[0])
    columns = [np.concatenate(c) for c in zip(*paths)]
    # one record per document and bucket
    out = [(int(doc[0]), A.pack(rest)) for _, (doc, *rest) in
           A.by_bucket(columns[0], columns)]
    return pa.table({"doc_id": pa.array([d for d, _ in out], pa.int64()),
                     "paths": pa.array([p for _, p in out], pa.binary())})


def repeated_paths_of(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, paths): packed paths of edges with an earlier occurrence, one row per bucket."""
    docs = id_and_text(docs)
    n = buckets(docs, BUCKET_BYTES)
    return (docs.mapInArrow(lambda batches: _edges(batches, width, anchor, n), "bucket long, kind int, blob binary")
            .groupBy("bucket").applyInArrow(_compact, "doc_id long, paths binary"))


def glue(blobs) -> list[np.ndarray]:
    """Paths of one document, joined where both coordinates continue."""
    start, n, sdoc, sstart = (np.concatenate(c) for c in zip(*(A.unpack(b, PATHS[1:]) for b in blobs)))
    order = np.argsort(start, kind="stable")
    start, n, sdoc, sstart = start[order], n[order].astype(np.int64), sdoc[order], sstart[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1] + n[:-1]) | (sdoc[1:] != sdoc[:-1]) | (sstart[1:] != sstart[:-1] + n[:-1])
    head = np.flatnonzero(new)
    return [start[head], np.add.reduceat(n, head), sdoc[head], sstart[head]]


def _cut(batches, width, with_text):
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            words_n, removed_n, sha, texts, spans = [], [], [], [], []
            for text, blobs in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                words = text.encode().split() if text else []
                gone, n_paths = 0, 0
                if blobs:
                    start, n, _, _ = glue(blobs)
                    n_paths = len(start)
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + n + width - 1, -1)
                    kept = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
                    gone = len(words) - len(kept)
                    kept_words = [words[i] for i in kept.tolist()]
                else:
                    kept_words = words
                joined = b" ".join(kept_words)
                words_n.append(len(words))
                removed_n.append(gone)
                spans.append(n_paths)
                sha.append(hashlib.sha256(joined).hexdigest())
                texts.append(joined.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(words_n, pa.int64()), pa.array(removed_n, pa.int64()),
                 pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_words", "n_removed", "n_paths", "kept_sha256", "kept_text"])


def dedup_substrings(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR,
                     with_text: bool = True) -> DataFrame:
    """Per document the words left after every later copy of a ``width``-word window is removed.

    Columns: doc_id, n_words, n_removed, n_paths (glued repeated paths), kept_sha256 and, if asked for,
    kept_text (words joined by one space).
    """
    paths = (repeated_paths_of(docs, width, anchor)
             .groupBy("doc_id").agg(F.collect_list("paths").alias("paths")))
    return id_and_text(docs).join(paths, "doc_id", "left").mapInArrow(
        lambda batches: _cut(batches, width, with_text),
        "doc_id long, n_words long, n_removed long, n_paths long, kept_sha256 string, kept_text string")
