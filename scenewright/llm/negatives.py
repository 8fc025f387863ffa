"""Hard negatives by the threshold algorithm over sorted candidate lists.

Scores are integer inner products of quantised vectors. Candidates are dealt by
a hash of their id into blocks of bounded size, anchors (the query set) into
parts, and every block meets every part once. Inside a block each dimension has
a list of the block's distinct vectors, sorted by their component. For an anchor
the lists are read in step, from the top where the anchor's component is
positive and from the bottom where it is negative (a zero component has no say);
each vector met is scored in full by random access. The threshold is the
anchor's inner product with the last components read: no unread vector of the
block scores more. Reading stops once the threshold is strictly below the k-th
score of every window (an equal score could still win by its smaller id) or
below the window itself. The best rows of all blocks are merged by anchor.

First pass: the best rows of the anchor's own label, its positives. Second pass:
per positive a window of scores, from ``low`` to ``high`` percent of the
positive's score, in which the best rows of other labels are its negatives.

Equal vectors of one label in a block are one list entry with all their ids, so
a vector that a third of the rows share costs a list entry a block, and ties
between its copies go to the smallest ids.

Defined cases: rows with a null id, label or vector, or with a null or
non-finite component take no part; vectors of different lengths count as padded
with zeros; rows that repeat an id count once, as the one with the smallest
label and vector; an anchor without positives, or whose windows are empty (as
for negative positive scores), has no rows; scores beyond 64 bits are an error;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenewright.llm.corpus import stored

SCALE = 256
BLOCK_ROWS, PART_ROWS = 32_768, 16_384
#: Blocks are not cut smaller than this for the sake of busy cores.
LEAST_ROWS = 2_048
#: List entries read per dimension in the first step; steps double.
FIRST_STEP = 32
POSITIVES = "anchor_id long, label int, vector array<long>, positive_id long, positive_score long"
NEGATIVES = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    vectors = vectors.combine_chunks()
    ends = vectors.offsets.to_numpy()
    out = np.zeros((len(vectors), width), np.int64)
    size = np.diff(ends)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(ends[:-1] - ends[0], size)] = vectors.flatten().to_numpy()
    return out


def _width(*tables: pa.Table) -> int:
    return max([1, *(int(np.diff(t["vector"].combine_chunks().offsets.to_numpy()).max(initial=0)) for t in tables)])


def _exact(vectors: np.ndarray, anchors: np.ndarray) -> type:
    """The fastest kind of number in which every inner product is exact."""
    if not len(vectors) or not len(anchors):
        return np.float64
    bound = sum(int(a) * int(b) for a, b in zip(np.abs(vectors.astype(object)).max(axis=0), np.abs(anchors.astype(object)).max(axis=0)))
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object


class Block:
    """Distinct vectors of one label or several, with sorted lists of every dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids, *vectors.T[::-1], labels))
        ids, labels, vectors = ids[order], labels[order], vectors[order]
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (labels[1:] != labels[:-1]) | (vectors[1:] != vectors[:-1]).any(axis=1)
        self.ids, self.first = ids, np.append(np.flatnonzero(fresh), len(ids))
        self.labels, self.vectors = labels[fresh], vectors[fresh]
        self.lists = np.argsort(self.vectors, axis=0, kind="stable").T.astype(np.int32)  # dimension, rank
        self.sorted = np.take_along_axis(self.vectors.T, self.lists, axis=1)

    def prepare(self, kind: type) -> None:
        self.numbers = self.vectors.astype(kind)

    def entry_of(self, anchor_id: int) -> int:
        """The list entry that holds the id; -1 if none does."""
        at = np.flatnonzero(self.ids == anchor_id)
        return int(np.searchsorted(self.first, at[0], side="right")) - 1 if len(at) else -1

    def best(self, anchor: np.ndarray, windows: list[tuple], k: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries, scores) of all that can be among the first k allowed ones of any window, best first."""
        m = len(self.labels)
        point = anchor.astype(self.numbers.dtype)
        wide = object if point.dtype == object else np.int64
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        read, met, found, scores = 0, np.zeros(m, bool), [], []
        step = FIRST_STEP if len(up) + len(down) else m  # a zero anchor scores everything the same
        while read < m:
            to = min(m, read + step)
            fresh = np.zeros(m, bool)
            fresh[self.lists[up, m - to : m - read].ravel()] = True
            fresh[self.lists[down, read:to].ravel()] = True
            if not len(up) + len(down):
                fresh[:] = True
            fresh &= ~met
            met |= fresh
            new = np.flatnonzero(fresh & allowed)
            found.append(new)
            scores.append((self.numbers[new] @ point).astype(wide))
            read, step = to, step * 2
            last = np.concatenate([self.sorted[up, m - read], self.sorted[down, read - 1]])
            threshold = int(last.astype(wide) @ np.concatenate([anchor[up], anchor[down]]).astype(wide))
            if met.all():
                break
            if threshold < max(high for _, high in windows):
                ranked = np.sort(np.concatenate(scores))
                if all(self._settled(ranked, threshold, low, high, k) for low, high in windows):
                    break
        entry, score = np.concatenate(found), np.concatenate(scores)
        order = np.argsort(-score, kind="stable")
        return entry[order], score[order]

    @staticmethod
    def _settled(ranked: np.ndarray, threshold: int, low, high, k: int) -> bool:
        if threshold < low:
            return True
        inside = int(np.searchsorted(ranked, high, side="right")) if high != np.inf else len(ranked)
        return inside >= k and ranked[inside - k] >= low and threshold < ranked[inside - k]

    def first_rows(self, entry: np.ndarray, score: np.ndarray, low, high, k: int, without: int | None = None) -> list[tuple[int, int]]:
        """(id, score) of the first k rows in a window, ties by id; entries are best first."""
        inside = np.flatnonzero((score >= low) & (score <= high))
        if len(inside) > k:
            inside = inside[score[inside] >= score[inside[k - 1]]]
        rows = []
        for i in inside.tolist():
            a, z = self.first[entry[i]], self.first[entry[i] + 1]
            rows += [(int(x), int(score[i])) for x in self.ids[a : min(z, a + k + 1)] if x != without]
        return sorted(rows, key=lambda r: (-r[1], r[0]))[:k]


def _positives(k: int):
    def run(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if candidates.num_rows and anchors.num_rows:
            width = _width(candidates, anchors)
            ids, labels, vectors = candidates["vec_id"].to_numpy(), candidates["label"].to_numpy(), _matrix(candidates["vector"], width)
            points, own = _matrix(anchors["vector"], width), anchors["label"].to_numpy()
            kind = _exact(vectors, points)
            for label in np.unique(own).tolist():
                here = labels == label
                if not here.any():
                    continue
                block = Block(ids[here], labels[here], vectors[here])
                block.prepare(kind)
                for row in np.flatnonzero(own == label).tolist():
                    anchor_id = anchors["vec_id"][row].as_py()
                    allowed, at = np.ones(len(block.labels), bool), block.entry_of(anchor_id)
                    if at >= 0 and block.first[at + 1] - block.first[at] == 1:
                        allowed[at] = False  # the anchor alone
                    entry, score = block.best(points[row], [(-np.inf, np.inf)], k, allowed)
                    out += [(anchor_id, label, points[row], *r) for r in block.first_rows(entry, score, -np.inf, np.inf, k, anchor_id)]
        columns = [*zip(*out)] or [[]] * 5
        return pa.table({"anchor_id": pa.array(columns[0], pa.int64()), "label": pa.array(columns[1], pa.int32()),
                         "vector": pa.array(list(columns[2]), pa.list_(pa.int64())),
                         "positive_id": pa.array(columns[3], pa.int64()), "positive_score": pa.array(columns[4], pa.int64())})

    return run


def _negatives(k: int, low: int, high: int):
    def run(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if candidates.num_rows and anchors.num_rows:
            width = _width(candidates, anchors)
            block = Block(candidates["vec_id"].to_numpy(), candidates["label"].to_numpy(), _matrix(candidates["vector"], width))
            points, own = _matrix(anchors["vector"], width), anchors["label"].to_numpy()
            block.prepare(_exact(block.vectors, points))
            for row, (anchor_id, positives) in enumerate(zip(anchors["vec_id"].to_pylist(), anchors["positives"].to_pylist())):
                # whole scores between low and high percent of the positive's
                windows = {p["positive_id"]: (-(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in positives}
                open_ = [w for w in windows.values() if w[0] <= w[1]]
                allowed = block.labels != own[row]
                if not open_ or not allowed.any():
                    continue
                entry, score = block.best(points[row], open_, k, allowed)
                for p in positives:
                    rows = block.first_rows(entry, score, *windows[p["positive_id"]], k)
                    out += [(anchor_id, p["positive_id"], p["positive_score"], *r) for r in rows]
        columns = [*zip(*out)] or [[]] * 5
        return pa.table({name: pa.array(column, pa.int64()) for name, column in zip(
            ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"), columns)})

    return run


def _meet(candidates: DataFrame, anchors: DataFrame, blocks: int, parts: int, run, schema: str) -> DataFrame:
    """Every block of candidates with every part of the anchors."""
    keys = ["block", "part"]
    pmod = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = candidates.withColumn("block", pmod(blocks)).withColumn("part", every(parts))
    right = anchors.withColumn("part", pmod(parts)).withColumn("block", every(blocks))
    pairs, cores = blocks * parts, candidates.sparkSession.sparkContext.defaultParallelism
    n = max(pairs, min(3 * pairs, 4 * cores))  # few pairs are dealt thinly, so that they seldom share a task
    left, right = left.repartition(n, *keys), right.repartition(n, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def quantised(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """vec_id, label and whole-number vector of the rows that take part, one per id."""
    x = F.col(f"`{vector}`")
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    clean = rows.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull() & x.isNotNull() & finite)
    whole = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    return (clean.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.struct(
        F.col(f"`{label}`").cast("int").alias("label"), whole.alias("vector")).alias("row"))
        .groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.vector"))


def hard_negatives(vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   block_rows: int = BLOCK_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id (unique), label and a whole-number vector; ``is_anchor`` is a condition on it.
    """
    table = stored(vectors.select("vec_id", "label", "vector"), "negatives-vectors")
    anchors = table.where(is_anchor)
    n, m = table.count(), anchors.count()
    cores = table.sparkSession.sparkContext.defaultParallelism
    blocks, parts = max(1, -(-n // block_rows), min(2 * cores, -(-n // LEAST_ROWS))), max(1, -(-m // part_rows))
    best = lambda score, tie, *by: F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), tie))
    near = _meet(table, anchors, blocks, parts, _positives(positives), POSITIVES)
    near = near.withColumn("rank", best("positive_score", "positive_id", "anchor_id")).where(F.col("rank") <= positives)
    queries = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"),
        F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))  # a few an anchor
    queries = stored(queries, "negatives-queries")
    found = _meet(table, queries, blocks, parts, _negatives(negatives, low, high), NEGATIVES)
    return (found.withColumn("rank", best("negative_score", "negative_id", "anchor_id", "positive_id"))
            .where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
