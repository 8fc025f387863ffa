"""Near-dedup by b-bit MinHash: signatures, banded candidates, exact links, components.

1. Every text becomes its set of distinct word shingles. Documents with equal
   sets (compared on 128 bits) form a class, so exact copies, however many, are
   one row from here on; the class is its smallest doc_id. Copies in one slice of
   texts are one row already there, so a class of a third of all documents does not
   fill one task of the joins by class.
2. ``HASHES`` minima per class; ``ROWS`` of them make a band key. Of each
   minimum only ``BITS`` low bits are kept, packed as bit planes of 64-bit
   words. Codes of two sets with similarity s differ with probability
   (1 - s)(1 - 2**-b); how many do is three XORs, ORs and a bit count.
3. Classes that share a band key are candidates. A bucket never emits all its
   pairs: first each member is paired with two centres, the smallest id and the
   member that meets most others over all bands. Pairs with more than
   ``most_differing`` codes apart go; the rest is confirmed on the full sets.
4. Confirmed links are contracted to components (large star, small star). Every
   bucket that still holds several components is then searched in blocks of at
   most ``BLOCK`` x ``BLOCK`` members: rows few enough codes apart across
   components are confirmed there on their full sets, all of them, and a block
   returns just the links that join components. So no link is lost that joins
   two components, and no step emits the pairs of a group.

What may be missed: a pair right at the threshold shares no band with
probability 4.9e-5 (80 percent) or 4.3e-7 (85), and is more codes apart than
``most_differing`` with 1.7e-6 or 8.7e-9; pairs more alike are missed less. Such
a link is lost if no other documents join the two.

Defined cases: null, empty or blank texts have an empty set and link with
nothing; with fewer words than a shingle the whole sequence is one shingle;
rows with a null doc_id are left out; a repeated row is one document; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenewright.llm import arrays as A
from scenewright.llm.corpus import id_and_text, stored

BANDS, ROWS, BITS = 25, 5, 4
HASHES = BANDS * ROWS
PLANE = 2  # 64-bit words of a plane
#: Share of the bands' own misses at the threshold that the count of differing codes may add.
ADDED = 1 / 20
BLOCK = 512
#: Groups that small buckets are dealt to.
SLOTS = 1024
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(texts: pa.Array, k: int):
    """For each slice: (first text, distinct shingle hashes, offsets per text)."""
    for a, b, data, ends in A.slices(texts):
        data = LOWER[data]
        starts, stops, first = A.word_spans(data, ends)
        sums = A.prefix(A.word_hashes(data, starts, stops))
        grams = A.windows_hash(sums, k)
        whole = A.spans_hash(sums, first[:-1], first[1:])
        sets = []
        for i, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            if hi - lo >= k:
                sets.append(np.unique(grams[lo : hi - k + 1]))
            else:
                sets.append(whole[i : i + 1] if hi > lo else grams[:0])
        yield a, sets


def _constants():
    r = A.mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    return r[:HASHES], r[HASHES:] | np.uint64(1)


def signatures(sets) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes ``[set, plane word]`` and band keys ``[set, band]`` of sets that are not empty."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    flip, times = _constants()
    low = np.empty((HASHES, len(sets)), np.uint64)
    work = np.empty_like(flat)
    for j in range(HASHES):
        np.bitwise_xor(flat, flip[j], out=work)
        np.multiply(work, times[j], out=work)
        low[j] = np.minimum.reduceat(work, at)
    planes = np.zeros((len(sets), BITS * PLANE), np.uint64)
    for j in range(HASHES):
        word, bit = divmod(j, 64)
        for b in range(BITS):
            planes[:, b * PLANE + word] |= ((low[j] >> np.uint64(b)) & np.uint64(1)) << np.uint64(bit)
    bands = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band + 1, np.uint64)
        for r in range(ROWS):
            key = A.mix(key + low[band * ROWS + r])
        bands[:, band] = key
    return planes.view(np.int64), bands.view(np.int64)


def _sign(batches, k):
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, sets in shingle_sets(batch.column(1), k):
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            copies: dict = {}  # copies that stand in one slice are one row
            for i, key in enumerate(keys):
                copies.setdefault(key, []).append(i)
            docs = [ids[a : a + len(sets)][rows] for rows in copies.values()]
            sets = [sets[rows[0]] for rows in copies.values()]
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            planes, bands = np.zeros((len(sets), BITS * PLANE), np.int64), np.zeros((len(sets), BANDS), np.int64)
            if len(full):
                planes[full], bands[full] = signatures([sets[i] for i in full.tolist()])
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.list_(pa.int64())), pa.array(n), pa.array(list(copies), pa.binary()),
                 pa.FixedSizeListArray.from_arrays(pa.array(planes.ravel()), BITS * PLANE).cast(pa.list_(pa.int64())),
                 pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), BANDS).cast(pa.list_(pa.int64()))],
                ["docs", "n_shingles", "set_key", "planes", "bands"])


def most_differing(percent: int) -> int:
    """Differing codes up to which a pair is confirmed, from the exact binomial tail at the threshold."""
    differ = (1 - percent / 100) * (1 - 2.0**-BITS)
    allowed = ADDED * (1 - (percent / 100) ** ROWS) ** BANDS
    tail, n = 0.0, HASHES
    while n:
        tail += comb(HASHES, n) * differ**n * (1 - differ) ** (HASHES - n)
        if tail > allowed:
            break
        n -= 1
    return n


def differing(a: str, b: str):
    """Codes that differ between two plane columns, by bit counts."""
    differ = F.lit(0)
    for word in range(PLANE):
        x = None
        for bit in range(BITS):
            d = F.col(a)[bit * PLANE + word].bitwiseXOR(F.col(b)[bit * PLANE + word])
            x = d if x is None else x.bitwiseOR(d)
        differ = differ + F.bit_count(x)
    return differ


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(batches, k, percent):
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts, where = {}, []
            for column in (2, 3):
                where.append([texts.setdefault(t, len(texts)) for t in part.column(column).to_pylist()])
            sets = [s for _, some in shingle_sets(pa.array(list(texts), pa.string()), k) for s in some]
            ok = [_linked(sets[i], sets[j], percent) for i, j in zip(*where)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ok, pa.bool_())],
                                             ["a", "b", "linked"])


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, linked) for pairs (a, b), decided on the full shingle sets."""
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(
        lambda batches: _confirm(batches, k, percent), "a long, b long, linked boolean")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for nodes with links (a, b); a component is its smallest node."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(),
                   "links")
    seen = None
    while True:
        # large star: larger neighbours move to the smallest of the closed neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # small star: smaller neighbours and the node itself move to the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.withColumnRenamed("m", "v")).where("u <> v").distinct())
        edges = stored(small, "stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = state


def _blocks(table: pa.Table):
    """(band, left rows, right rows) of every block in the group."""
    band, i, j, side = (table[c].to_numpy() for c in ("band", "i", "j", "side"))
    block = A.mix(band.astype(np.uint64) + A.mix((i.astype(np.uint64) << np.uint64(32)) + j.astype(np.uint64)))
    for _, (rows,) in A.by_bucket(block.view(np.int64), [np.arange(len(band))]):
        yield band[rows[0]], rows[side[rows] == i[rows]], rows[side[rows] == j[rows]]


def _open_rows(table: pa.Table, limit: int) -> pa.Table:
    """Rows of a block with a partner in another component at most ``limit`` codes apart.

    A pair counts in the first band that both share, so it is looked at once.
    """
    comp = table["component"].to_numpy()
    planes = np.array(table["planes"].to_pylist(), np.int64).astype(np.uint64).reshape(len(comp), -1)
    bands = np.array(table["bands"].to_pylist(), np.int64).reshape(len(comp), -1)
    wanted = np.zeros(len(comp), bool)
    for band, left, right in _blocks(table):
        for at in range(0, len(left), 64):
            some = left[at : at + 64]
            differ = np.zeros((len(some), len(right)), np.int64)
            for word in range(PLANE):
                d = np.zeros(differ.shape, np.uint64)
                for bit in range(BITS):
                    column = bit * PLANE + word
                    d |= planes[some, column][:, None] ^ planes[right, column][None, :]
                differ += np.bitwise_count(d)
            x, y = np.nonzero((differ <= limit) & (comp[some][:, None] != comp[right][None, :]))
            for lo in range(0, len(x), 1 << 16):
                u, v = some[x[lo : lo + (1 << 16)]], right[y[lo : lo + (1 << 16)]]
                first = (bands[u] == bands[v]).argmax(axis=1)
                here = bands[u, first] == band
                wanted[u[here]] = True
                wanted[v[here]] = True
    return table.select(["band", "i", "j", "side", "node", "component", "slot"]).filter(pa.array(wanted))


def _overlaps(sets, left, right) -> np.ndarray:
    """Sizes of all intersections of left and right sets, by products of 0/1 columns of shared shingles."""
    rows = np.unique(np.concatenate([left, right]))
    values = np.concatenate([sets[r] for r in rows.tolist()])
    owner = np.repeat(rows, [len(sets[r]) for r in rows.tolist()])
    _, code, count = np.unique(values, return_inverse=True, return_counts=True)
    renumber = np.cumsum(count > 1) - 1
    shared = count[code] > 1
    code, owner = renumber[code[shared]], owner[shared]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    place = {}
    for name, side in (("left", left), ("right", right)):
        place[name] = np.full(int(rows[-1]) + 1, -1)
        place[name][side] = np.arange(len(side))
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        a, b = np.searchsorted(code, [lo, lo + 4096])
        c, o = code[a:b] - lo, owner[a:b]
        width = int(c.max()) + 1 if b > a else 0
        m = []
        for name, side in (("left", left), ("right", right)):
            bits = np.zeros((len(side), width), np.float32)
            has = place[name][o] >= 0
            bits[place[name][o[has]], c[has]] = 1
            m.append(bits)
        out += m[0] @ m[1].T
    return out


def _block_links(table: pa.Table, k: int, percent: int) -> pa.Table:
    """Exact links between components inside each block, as few as join what is joined."""
    node, comp = table["node"].to_numpy(), table["component"].to_numpy()
    texts = table["text"].combine_chunks().dictionary_encode()
    sets = [s for _, some in shingle_sets(texts.dictionary, k) for s in some]
    sets = [sets[i] for i in texts.indices.to_pylist()]
    size = np.array([len(s) for s in sets])
    out_a, out_b = [], []
    for _, left, right in _blocks(table):
        both = _overlaps(sets, left, right).astype(np.int64)
        either = size[left][:, None] + size[right][None, :] - both
        x, y = np.nonzero((100 * both >= percent * either) & (comp[left][:, None] != comp[right][None, :]))
        root = {}
        for u, v in zip(left[x].tolist(), right[y].tolist()):
            p, q = int(comp[u]), int(comp[v])
            while p in root:
                p = root[p]
            while q in root:
                q = root[q]
            if p != q:
                root[max(p, q)] = min(p, q)
                out_a.append(max(int(node[u]), int(node[v])))
                out_b.append(min(int(node[u]), int(node[v])))
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def block_links(shared: DataFrame, heads: DataFrame, comp: DataFrame, texts: DataFrame, limit: int, k: int,
                percent: int) -> DataFrame:
    """Links (a, b) across components, from buckets that still hold several components."""
    member = (shared.join(comp, "node", "left")
              .select("band", "node", F.coalesce("component", "node").alias("component")))
    bucket = (member.groupBy("band").agg(F.count("*").alias("n"), F.min("component").alias("lo"),
                                         F.max("component").alias("hi")).where("lo <> hi").select("band", "n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    slot = F.pmod(F.xxhash64("band", "i", "j"), F.lit(SLOTS))
    rows = (member.join(bucket, "band").join(heads.select("node", "planes", "bands"), "node")
            .withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))
            .select("band", "i", "j", "side", "node", "component", "planes", "bands",
                    F.when(F.col("blocks") > 1, F.xxhash64("band", "i", "j")).otherwise(slot).alias("slot")))
    open_rows = rows.groupBy("slot").applyInArrow(
        lambda t: _open_rows(t, limit), "band long, i int, j int, side int, node long, component long, slot long")
    return (open_rows.join(texts.withColumnRenamed("doc_id", "node"), "node")
            .groupBy("slot").applyInArrow(lambda t: _block_links(t, k, percent), "a long, b long"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their
    sets of distinct ``k``-word shingles.
    """
    docs = id_and_text(docs)
    limit = most_differing(percent)
    signed = stored(docs.mapInArrow(
        lambda batches: _sign(batches, k),
        "docs array<long>, n_shingles long, set_key binary, planes array<long>, bands array<long>"), "signatures")
    full = signed.where(F.col("set_key").isNotNull())
    classes = full.groupBy("set_key").agg(F.min(F.array_min("docs")).alias("node"))
    heads = (full.join(classes, "set_key").where(F.array_min("docs") == F.col("node")).dropDuplicates(["node"])
             .select("node", "set_key", "planes", "bands"))
    heads = stored(heads, "heads")
    exploded = heads.select("node", F.explode("bands").alias("band"))
    crowd = exploded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(exploded.join(crowd, "band"), "buckets")
    degree = shared.groupBy("node").agg(F.sum("n").alias("degree"))
    centre = (shared.select("band", "node").join(degree, "node").groupBy("band")
              .agg(F.min("node").alias("least"), F.max(F.struct("degree", (-F.col("node")).alias("minus"))).alias("top"))
              .select("band", F.array("least", -F.col("top.minus")).alias("centres")))
    pairs = (shared.select("band", "node").join(centre, "band").select("node", F.explode("centres").alias("centre"))
             .where("node <> centre")
             .select(F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b")).distinct())
    planes = heads.select("node", "planes")
    pairs = (pairs.join(planes.select(F.col("node").alias("a"), F.col("planes").alias("pa")), "a")
             .join(planes.select(F.col("node").alias("b"), F.col("planes").alias("pb")), "b")
             .where(differing("pa", "pb") <= limit).select("a", "b"))
    # texts of all classes that any round may compare, once
    texts = stored(docs.join(degree.select(F.col("node").alias("doc_id")), "doc_id").dropDuplicates(["doc_id"]), "texts")
    tested = stored(confirmed(pairs, texts, k, percent), "tested")
    comp = components(tested.where("linked").select("a", "b"))
    more = block_links(shared.select("band", "node"), heads, comp, texts, limit, k, percent)
    comp = components(tested.where("linked").select("a", "b").unionByName(more))
    label = (classes.join(comp, "node", "left")
             .select("set_key", F.coalesce("component", "node").alias("component_id")))
    # the joins above and this one meet one row per class and slice of texts, not one per copy; empty sets meet none
    named = full.select("docs", "n_shingles", "set_key").join(label, "set_key").drop("set_key").unionByName(
        signed.where(F.col("set_key").isNull()).select("docs", "n_shingles", F.lit(None).cast("long").alias("component_id")))
    return (named.select(F.explode("docs").alias("doc_id"), "n_shingles", "component_id")
            .withColumn("component_id", F.coalesce("component_id", "doc_id"))
            .withColumn("kept", F.col("doc_id") == F.col("component_id")))
