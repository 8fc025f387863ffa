"""Exact substring dedup on bytes by a sparse suffix array, sorted deep-shallow.

A byte goes if it lies in a window of ``width`` bytes that also starts anywhere
else. Every window has an anchor: the leftmost smallest hash of its ``GRAM``
byte runs. Equal windows have equal anchors at equal places, so only suffixes
that start at anchors are sorted, about one in ninety.

1. Map: each anchor leaves as (gram hash, context hash, doc_id, first window,
   windows, distance of the first window from the anchor). The context is all
   bytes its windows cover. Equal contexts within a map chunk leave once; the
   others are decided there and then.
2. Bucket by gram hash: a gram that occurs once is done, and equal contexts
   decide each other. What differs is asked for as text, one per distinct
   context.
3. Join: documents meet the requests by doc_id and send out the contexts.
4. Bucket again: suffixes to the right of the anchors are sorted by multikey
   radix steps of eight bytes to a shallow depth; what is still tied there has
   a long common prefix and is ordered by a blind trie, which branches on the
   first differing byte only. The reversed left sides are sorted the same way.
   Two windows are equal if, at the same distance from the anchor, both sides
   fall in the same common-prefix class.
5. Join: removed spans meet their documents.

Hot grams: a gram that is frequent within one map chunk, or has many distinct
contexts in its bucket (a passage in very many documents), would make one group
too large to sort. Its windows are asked for as 128-bit hashes instead and dealt
out by those, each once per map chunk, so no group grows with the gram's
frequency. Both ways are exact and run on the same data.

Defined cases: null text is empty; texts below ``width`` bytes have no window;
rows with a null doc_id are left out; a repeated row is one document; ties are
all removed (also the first occurrence); extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenewright.llm import arrays as A
from scenewright.llm.corpus import buckets, id_and_text, stored

WIDTH = 200
GRAM = 24
#: Bytes sorted by radix steps before tied suffixes go to a blind trie.
SHALLOW = 24
CHUNK_BYTES = 24 << 20
BUCKET_BYTES = 8 << 20
#: A gram with so many contexts in one map chunk, or so many distinct ones in all, is compared by window hashes.
HOT_IN_CHUNK, HOT_IN_ALL = 64, 2000
ANCHORS = ["<u8", "<u8", "<i8", "<i4", "<u2", "<u2"]  # gram, context, doc_id, first window, windows, distance
SPANS = ["<i8", "<i4", "<i4"]  # doc_id, first byte, end byte
ASKS = ["<i8", "<i4", "<u2", "<u2", "<u8", "u1"]  # doc_id, first window, windows, distance, gram, kind
DECIDED, OPEN, HOT = 0, 1, 2
BLOBS = "bucket long, kind int, blob binary"


def _emit(items):
    items = list(items)
    if items:
        bucket, kind, blob = zip(*items)
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())],
            ["bucket", "kind", "blob"])


def _home(values, n):
    return (A.mix(values.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def anchors_of(data, ends, width, gram):
    """Anchors of a slice: hash, text, first window, windows, distance, context hash."""
    sums = A.prefix(A.byte_codes(7)[data])
    grams = A.windows_hash(sums, gram)
    span = width - gram + 1
    place = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64(0xFFFFFFFF)
    keyed = (grams & ~low) | place  # smallest upper half of the hash, leftmost on ties
    pick = (A.sliding_min(keyed, span) & low).astype(np.int64)
    lengths = np.diff(ends)
    text = np.repeat(np.arange(len(lengths)), lengths)[: len(pick)]
    inside = np.flatnonzero(np.arange(len(pick)) + width <= ends[1:][text])
    pick, text = pick[inside], text[inside]
    head = np.flatnonzero(A.first_in_run(pick, text))
    count = np.diff(np.append(head, len(pick)))
    first = inside[head]
    anchor, text = pick[head], text[head]
    context = A.spans_hash(sums, first, first + count + width - 1) ^ A.mix(count.astype(np.uint64))
    return grams[anchor], text, first - ends[text], count, anchor - first, context


def _equal_contexts(gram, context, doc, at):
    """Rows sorted so that equal contexts stand together: (order, new context, its size per row)."""
    order = np.lexsort((at, doc, context, gram))
    new = A.first_in_run(gram[order], context[order])
    same = A.first_in_run(gram[order], context[order], doc[order], at[order])
    order, new = order[same], new[same]  # a repeated row is one document
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(order)))
    return order, head, size


def _anchor_chunk(parts, n, width):
    gram, context, doc, at, count, distance = (np.concatenate(c) for c in zip(*parts))
    order, head, size = _equal_contexts(gram, context, doc, at)
    twice = np.repeat(size > 1, size)
    rows = order[twice]
    spans = [doc[rows], at[rows].astype("<i4"), (at[rows] + count[rows] + width - 1).astype("<i4")]
    for b, columns in A.by_bucket(_home(spans[0], n), spans):
        yield b, 1, A.pack(columns)
    rows, size = order[head], size
    g = gram[rows]
    new = np.flatnonzero(A.first_in_run(g))
    hot = np.repeat(np.diff(np.append(new, len(g))) > HOT_IN_CHUNK, np.diff(np.append(new, len(g))))
    marks = rows[new[hot[new]]]
    if len(marks):
        for b, columns in A.by_bucket(_home(gram[marks], n), [gram[marks].astype("<u8")]):
            yield b, 2, A.pack(columns)
        asks = rows[hot]
        columns = [doc[asks], at[asks].astype("<i4"), count[asks].astype("<u2"), distance[asks].astype("<u2"),
                   gram[asks].astype("<u8"), np.full(len(asks), HOT, "u1")]
        for b, columns in A.by_bucket(_home(doc[asks], n), columns):
            yield b, 3, A.pack(columns)
    # a context that occurs twice in the chunk is sent twice-marked: its distance carries the mark
    rows, mark = rows[~hot], (size > 1)[~hot]
    sent = [gram[rows], context[rows], doc[rows], at[rows].astype("<i4"), count[rows].astype("<u2"),
            (distance[rows] + (mark.astype(np.int64) << 15)).astype("<u2")]
    for b, columns in A.by_bucket(_home(gram[rows], n), sent):
        yield b, 0, A.pack(columns)


def _anchors(batches, n, width, gram):
    parts, held = [], 0
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b, data, ends in A.slices(batch.column(1)):
            if len(data) < width:
                continue
            g, text, at, count, distance, context = anchors_of(data, ends, width, gram)
            parts.append((g, context, ids[a:b][text], at, count, distance))
            held += len(data)
            if held >= CHUNK_BYTES:
                yield from _emit(_anchor_chunk(parts, n, width))
                parts, held = [], 0
    if parts:
        yield from _emit(_anchor_chunk(parts, n, width))


def _sort_out(table: pa.Table, width: int) -> pa.Table:
    """Decided spans and requests of one bucket, packed by document."""
    spans, asks, sent, marks = [], [], [], []
    for kind, blob in zip(table["kind"].to_pylist(), table["blob"].to_pylist()):
        if kind == 0:
            sent.append(A.unpack(blob, ANCHORS))
        elif kind == 1:
            spans.append(A.unpack(blob, SPANS))
        elif kind == 2:
            marks.append(A.unpack(blob, ["<u8"])[0])
        else:
            asks.append(A.unpack(blob, ASKS))
    if sent:
        gram, context, doc, at, count, distance = (np.concatenate(c) for c in zip(*sent))
        mark, distance = distance >> 15 != 0, distance & 0x7FFF
        order, head, size = _equal_contexts(gram, context, doc, at)
        twice = np.repeat(size > 1, size)
        rows = order[twice]
        spans.append([doc[rows], at[rows], (at[rows] + count[rows].astype(np.int64) + width - 1).astype("<i4")])
        known = (size > 1) | (np.add.reduceat(mark[order].astype(np.int64), head) > 0)
        rows = order[head]
        new = np.flatnonzero(A.first_in_run(gram[rows]))
        many = np.diff(np.append(new, len(rows)))
        hot = np.isin(gram[rows], np.concatenate(marks)) if marks else np.zeros(len(rows), bool)
        hot |= np.repeat(many > HOT_IN_ALL, many)
        asked = hot | np.repeat(many > 1, many)
        rows, kind = rows[asked], np.where(hot, HOT, np.where(known, DECIDED, OPEN))[asked]
        asks.append([doc[rows], at[rows], count[rows], distance[rows], gram[rows], kind.astype("u1")])
    docs, blobs, kinds = [], [], []
    for kind, parts in ((0, spans), (1, asks)):
        if parts:
            columns = [np.concatenate(c) for c in zip(*parts)]
            for _, (d, *rest) in A.by_bucket(columns[0], columns):
                docs.append(int(d[0]))
                blobs.append(A.pack(rest))
                kinds.append(kind)
    return pa.table({"doc_id": pa.array(docs, pa.int64()), "kind": pa.array(kinds, pa.int32()),
                     "blob": pa.array(blobs, pa.binary())})


def _context_chunk(asks, texts, hashes, n):
    if asks:
        doc, at, count, distance, gram, kind = (np.concatenate(c) for c in zip(*asks))
        size = np.array([len(t) for t in texts], np.int64)
        where = np.cumsum(size) - size
        body = np.frombuffer(b"".join(texts), np.uint8)
        columns = [doc, at, count, distance, gram, kind, size, where]
        for b, (*head, s, w) in A.by_bucket(_home(gram, n), columns):
            yield b, 0, A.pack(head) + body[A.ranges(w, s)].tobytes()
    if hashes:
        one, two, doc, at = (np.concatenate(c) for c in zip(*hashes))
        order = np.lexsort((at, doc, two, one))
        one, two, doc, at = one[order], two[order], doc[order], at[order]
        same = A.first_in_run(one, two, doc, at)
        one, two, doc, at = one[same], two[same], doc[same], at[same]
        head = np.flatnonzero(A.first_in_run(one, two))
        size = np.diff(np.append(head, len(one)))
        twice = np.repeat(size > 1, size)
        for b, columns in A.by_bucket(_home(doc[twice], n), [doc[twice], at[twice].astype("<i4")]):
            yield b, 2, A.pack(columns)
        mark = (size > 1).astype("u1")
        for b, columns in A.by_bucket(_home(one[head], n), [one[head], two[head], doc[head], at[head].astype("<i4"),
                                                            mark]):
            yield b, 1, A.pack(columns)


def _contexts(batches, n, width):
    asks, texts, hashes, held = [], [], [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            part = batch.slice(lo, 200)
            for doc, text, blobs in zip(*(c.to_pylist() for c in part.columns[:3])):
                body = text.encode()
                at, count, distance, gram, kind = (np.concatenate(c) for c in
                                                   zip(*(A.unpack(b, ASKS[1:]) for b in blobs)))
                hot = kind == HOT
                cold = np.flatnonzero(~hot)
                if len(cold):
                    asks.append([np.full(len(cold), doc, np.int64), at[cold], count[cold], distance[cold], gram[cold],
                                 kind[cold]])
                    for a, c in zip(at[cold].tolist(), count[cold].tolist()):
                        texts.append(body[a : a + c + width - 1])
                        held += c + width
                if hot.any():
                    data = np.frombuffer(body, np.uint8)
                    place = A.ranges(at[hot].astype(np.int64), count[hot].astype(np.int64))
                    one, two = (A.spans_hash(A.prefix(A.byte_codes(seed)[data]), place, place + width)
                                for seed in (7, 101))
                    hashes.append([one, two, np.full(len(place), doc, np.int64), place])
                    held += 24 * len(place)
                if held >= CHUNK_BYTES:
                    yield from _emit(_context_chunk(asks, texts, hashes, n))
                    asks, texts, hashes, held = [], [], [], 0
    yield from _emit(_context_chunk(asks, texts, hashes, n))


class BlindTrie:
    """Orders strings with long common prefixes; inner nodes know a depth and branching bytes only."""

    def __init__(self, strings):
        self.strings = strings
        self.root = None

    def _common(self, a, b, least):
        x, y = self.strings[a], self.strings[b]
        n = min(len(x), len(y))
        if x[least:n] == y[least:n]:
            return n
        lo, hi = least, n  # x[:lo] == y[:lo], x[:hi] != y[:hi]
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if x[lo:mid] == y[lo:mid]:
                lo = mid
            else:
                hi = mid
        return lo

    def _byte(self, i, depth):
        s = self.strings[i]
        return s[depth] if depth < len(s) else -1

    def insert(self, i):
        if self.root is None:
            self.root = [None, [i]]
            return
        node = self.root
        while node[0] is not None:  # blind: only branching bytes are looked at
            node = node[1].get(self._byte(i, node[0])) or next(iter(node[1].values()))
        other = node[1][0]
        depth = self._common(i, other, 0)
        if depth == len(self.strings[i]) == len(self.strings[other]):
            node[1].append(i)
            return
        node, above, key = self.root, None, None
        while node[0] is not None and node[0] < depth:
            above, key = node, self._byte(i, node[0])
            node = node[1][key]
        leaf = [None, [i]]
        if node[0] == depth:
            node[1][self._byte(i, depth)] = leaf
            return
        inner = [depth, {self._byte(other, depth): node, self._byte(i, depth): leaf}]
        if above is None:
            self.root = inner
        else:
            above[1][key] = inner

    def walk(self):
        """(string, common prefix with the one before) in order."""
        out, stack = [], [(self.root, 0)]
        while stack:
            node, shared = stack.pop()
            if node[0] is None:
                full = len(self.strings[node[1][0]])
                out.extend((i, full if k else shared) for k, i in enumerate(node[1]))
            else:
                kids = [node[1][k] for k in sorted(node[1])]
                stack.extend((kid, node[0] if k else shared) for k, kid in reversed(list(enumerate(kids))))
        return out


def sorted_sides(group, body, start, size, step, shallow=SHALLOW):
    """Sort strings body[start], body[start + step], ... within groups.

    Returns the order and each one's common prefix with the one before (-1 in
    another group). Radix steps of eight bytes order a shallow prefix; ties go
    to a blind trie.
    """
    n = len(start)
    words = []
    for d in range(0, shallow, 8):
        word = np.zeros(n, np.uint64)
        for k in range(d, d + 8):
            have = k < size
            byte = np.zeros(n, np.uint64)
            byte[have] = body[start[have] + step * k]
            word = (word << np.uint64(8)) | byte
        words.append(word)
    deep = np.minimum(size, shallow)
    order = np.lexsort([deep, *words[::-1], group])
    g, s = group[order], deep[order]
    shared = np.full(n, -1, np.int64)
    open_ = np.zeros(n, bool)  # still equal to the one before
    open_[1:] = g[1:] == g[:-1]
    shared[open_] = 0
    for j, w in enumerate(words):
        w = w[order]
        diff = np.zeros(n, np.uint64)
        diff[1:] = w[1:] ^ w[:-1]
        equal = open_ & (diff == 0)
        part = np.flatnonzero(open_ & (diff != 0))
        if len(part):
            top = np.zeros(len(part), np.int64)
            rest = diff[part]
            for k in range(7, -1, -1):
                top[(rest >> np.uint64(8 * (7 - k))) != 0] = k
            shared[part] = j * 8 + top
        shared[equal] = (j + 1) * 8
        open_ = equal
    shared[1:] = np.where(shared[1:] >= 0, np.minimum(shared[1:], np.minimum(s[1:], s[:-1])), -1)
    tied = np.zeros(n, bool)
    tied[1:] = open_[1:] & (s[1:] == shallow) & (s[:-1] == shallow)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], tied, [False]]).astype(np.int8)))
    raw = body.tobytes()
    for a, b in zip((edge[0::2] - 1).tolist(), edge[1::2].tolist()):
        rows = order[a:b]
        if step > 0:
            strings = [raw[p + shallow : p + m] for p, m in zip(start[rows].tolist(), size[rows].tolist())]
        else:
            strings = [raw[p - m + 1 : p - shallow + 1][::-1] for p, m in zip(start[rows].tolist(), size[rows].tolist())]
        trie = BlindTrie(strings)
        for i in range(len(rows)):
            trie.insert(i)
        walked = trie.walk()
        first = shared[a]
        order[a:b] = rows[[i for i, _ in walked]]
        shared[a:b] = [shallow + c for _, c in walked]
        shared[a] = first
    return order, shared


def equal_windows(gram, kind, count, distance, body, where, width, shallow=SHALLOW):
    """For each context which of its windows also occur elsewhere: rows and window numbers."""
    n = len(gram)
    _, group = np.unique(gram, return_inverse=True)
    size = count + width - 1
    anchor = where + distance
    right_order, right_shared = sorted_sides(group, body, anchor, size - distance, 1, shallow)
    left_order, left_shared = sorted_sides(group, body, anchor - 1, distance, -1, shallow)
    least = distance - count + 1
    found_row, found_at = [], []
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(max(0, least.min())), int(distance.max()) + 1):
        has = (least <= d) & (d <= distance)
        if has.sum() < 2:
            continue
        right[right_order] = np.cumsum(right_shared < width - d)
        left[left_order] = np.cumsum(left_shared < d)
        rows = np.flatnonzero(has)
        key = right[rows] * np.int64(n + 1) + left[rows]
        by = np.argsort(key, kind="stable")
        key = key[by]
        twin = np.zeros(len(key), bool)
        twin[1:] = key[1:] == key[:-1]
        twin[:-1] |= twin[1:].copy()
        hit = rows[by[twin]]
        hit = hit[kind[hit] == OPEN]
        found_row.append(hit)
        found_at.append(distance[hit] - d)
    if not found_row:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_row), np.concatenate(found_at)


def _match(table: pa.Table, width: int) -> pa.Table:
    heads, bodies, hashes, places = [], [], [], []
    for kind, blob in zip(table["kind"].to_pylist(), table["blob"].to_pylist()):
        if kind == 0:
            heads.append(A.unpack(blob, ASKS))
            bodies.append(np.frombuffer(blob, np.uint8, offset=8 + 25 * len(heads[-1][0])))
        elif kind == 1:
            hashes.append(A.unpack(blob, ["<u8", "<u8", "<i8", "<i4", "u1"]))
        else:
            places.append(A.unpack(blob, ["<i8", "<i4"]))
    if heads:
        doc, at, count, distance, gram, kind = (np.concatenate(c) for c in zip(*heads))
        count, distance = count.astype(np.int64), distance.astype(np.int64)
        bodies, size = np.concatenate(bodies), count + width - 1
        where = np.cumsum(size) - size
        once = np.unique(np.stack([doc, at]), axis=1, return_index=True)[1]  # a repeated row is one document
        doc, at, count, distance, gram, kind, where = (c[once] for c in (doc, at, count, distance, gram, kind, where))
        rows, window = equal_windows(gram, kind, count, distance, bodies, where, width)
        places.append([doc[rows], (at[rows] + window).astype("<i4")])
    if hashes:
        one, two, doc, at, mark = (np.concatenate(c) for c in zip(*hashes))
        order = np.lexsort((at, doc, two, one))
        same = A.first_in_run(one[order], two[order], doc[order], at[order])
        marks = mark[order]
        order = order[same]
        marks = np.maximum.reduceat(marks, np.flatnonzero(same))
        head = np.flatnonzero(A.first_in_run(one[order], two[order]))
        size = np.diff(np.append(head, len(order)))
        rows = order[np.repeat(size > 1, size)]
        places.append([doc[rows], at[rows]])
    doc, at = (np.concatenate(c) for c in zip(*places))
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order].astype(np.int64)
    docs, blobs = [], []
    for _, (d, a) in A.by_bucket(doc, [doc, at]):
        docs.append(int(d[0]))
        blobs.append(A.pack([x.astype("<i4") for x in A.union_of_spans(a, a + width)]))
    return pa.table({"doc_id": pa.array(docs, pa.int64()), "blob": pa.array(blobs, pa.binary())})


def _cut(batches, with_text):
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            size, removed, runs, sha, kept_text = [], [], [], [], []
            for text, blobs in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                body = text.encode() if text else b""
                kept, n_runs = body, 0
                if blobs:
                    start, end = (np.concatenate(c).astype(np.int64) for c in
                                  zip(*(A.unpack(b, SPANS[1:]) for b in blobs)))
                    start, end = A.union_of_spans(start, end)
                    n_runs, at, pieces = len(start), 0, []
                    for s, e in zip(start.tolist(), end.tolist()):
                        pieces.append(body[at:s])
                        at = e
                    kept = b"".join([*pieces, body[at:]])
                size.append(len(body))
                removed.append(len(body) - len(kept))
                runs.append(n_runs)
                sha.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept.decode("utf-8", "replace") if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                 pa.array(sha, pa.string()), pa.array(kept_text, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def dedup_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """Per document the bytes left after everything that occurs elsewhere too is cut.

    Columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for,
    kept_text (a character cut in half becomes U+FFFD).
    """
    if not gram <= width < 1 << 15:
        raise ValueError("width must hold a gram and stay below 32768 bytes")
    docs = id_and_text(docs)
    n = buckets(docs, BUCKET_BYTES)
    found = stored(docs.mapInArrow(lambda batches: _anchors(batches, n, width, gram), BLOBS)
                   .groupBy("bucket").applyInArrow(lambda t: _sort_out(t, width), "doc_id long, kind int, blob binary"),
                   "suffix-anchors")
    asked = docs.join(found.where("kind = 1").groupBy("doc_id").agg(F.collect_list("blob").alias("asks")), "doc_id")
    matched = (asked.mapInArrow(lambda batches: _contexts(batches, n, width), BLOBS)
               .groupBy("bucket").applyInArrow(lambda t: _match(t, width), "doc_id long, blob binary"))
    spans = (found.where("kind = 0").select("doc_id", "blob").unionByName(matched)
             .groupBy("doc_id").agg(F.collect_list("blob").alias("blobs")))
    return docs.join(spans, "doc_id", "left").mapInArrow(
        lambda batches: _cut(batches, with_text),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
