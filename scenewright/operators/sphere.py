"""Exact nearest vectors by angle, with clusters that the triangle inequality rules out.

Angles between directions obey the triangle inequality: a vector of a cluster
cannot be nearer to a query than the query's angle to the cluster's centre less
the cluster's radius. Centres are a bounded sample, every vector belongs to its
nearest one, and large clusters are dealt into parts of bounded size. A query is
first compared inside its own part, which bounds its k-th best value from below;
then it is sent to the parts of those clusters only whose bound reaches that
value. On data without any clusters few are ruled out, and results are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenewright.operators.joins import lookup_join
from scenewright.session import cut_lineage

MOST_CENTRES = 1024
PART_ROWS, QUERY_ROWS = 4096, 16384
#: Tables of up to so many rows are compared whole, dealt by query over so many tasks.
SMALL_ROWS, SMALL_PARTS = 8192, 8
#: Matrices of cosines are computed for so many queries at a time.
CHUNK = 1024
FOUND = "id bigint, neighbour bigint, cosine double"


def unit(vectors: pd.Series) -> np.ndarray:
    v = np.stack(vectors.to_numpy()).astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _best(queries: pd.DataFrame, rows: pd.DataFrame, k: int, digits: int) -> pd.DataFrame:
    """The k best rows of each query, ties by id, never itself."""
    out = [pd.DataFrame({"id": np.zeros(0, np.int64), "neighbour": np.zeros(0, np.int64), "cosine": np.zeros(0)})]
    if len(queries) and len(rows):
        rows = rows.sort_values("id")
        other, ids = unit(rows["vector"]), rows["id"].to_numpy()
        for at in range(0, len(queries), CHUNK):
            part = queries.iloc[at : at + CHUNK]
            own = part["id"].to_numpy()
            cosine = np.round(unit(part["vector"]) @ other.T, digits)
            cosine[own[:, None] == ids] = -np.inf
            top = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
            value = np.take_along_axis(cosine, top, axis=1)
            keep = np.isfinite(value)
            out.append(pd.DataFrame({"id": np.repeat(own, top.shape[1])[keep.reshape(-1)],
                                     "neighbour": ids[top][keep], "cosine": value[keep]}))
    return pd.concat(out)


def _centres(vectors: DataFrame, n: int) -> np.ndarray:
    wanted = min(MOST_CENTRES, max(1, int(n**0.5)))
    rows = vectors.orderBy(F.xxhash64("id")).limit(wanted).select("vector").toPandas()
    return unit(rows["vector"])


def _clustered(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """Rows with the number of their nearest centre and the angle to it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            cosine = unit(rows["vector"]) @ centres.T if len(rows) else np.zeros((0, 1))
            nearest = cosine.argmax(axis=1)
            angle = np.arccos(np.clip(np.take_along_axis(cosine, nearest[:, None], axis=1)[:, 0], -1, 1))
            yield rows.assign(cluster=nearest.astype(np.int32), angle=angle)
    kind = dict(vectors.dtypes)["vector"]
    return vectors.mapInPandas(run, f"id bigint, vector {kind}, cluster int, angle double")


def _routed(queries: DataFrame, centres: np.ndarray, radius: np.ndarray, parts: np.ndarray, digits: int) -> DataFrame:
    """A row per query and part that may hold one of its k best: ``target`` is the part's number over all clusters."""
    first = np.cumsum(parts) - parts
    slack = 10.0**-digits  # values are compared after rounding

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            angle = np.arccos(np.clip(unit(rows["vector"]) @ centres.T, -1, 1))
            most = np.cos(np.maximum(angle - radius, 0.0)) + slack  # no vector of the cluster has more
            visit = (most >= rows["least"].to_numpy()[:, None]) & (parts > 0)
            targets = [np.concatenate([np.arange(first[c], first[c] + parts[c]) for c in np.flatnonzero(v)] or [np.zeros(0, int)])
                       for v in visit]
            yield pd.DataFrame({"id": rows["id"], "vector": rows["vector"], "own": rows["target"],
                                "targets": [t.astype(np.int32) for t in targets]})
    kind = dict(queries.dtypes)["vector"]
    sent = queries.mapInPandas(run, f"id bigint, vector {kind}, own int, targets array<int>")
    return sent.select("id", "vector", "own", F.explode("targets").alias("target")).where("target <> own").drop("own")


def nearest_by_angle(vectors: DataFrame, k: int, digits: int = 6) -> tuple[DataFrame, int, int]:
    """``(id, rank, neighbour, cosine)``, the pairs compared, and the pairs that comparing all would take.

    Vectors of length zero have no direction: they have and are no neighbours.
    """
    directed = F.exists("vector", lambda x: x != 0)
    vectors = vectors.select(F.col("id").cast("bigint").alias("id"), "vector").where(directed)
    n = vectors.count()
    if 0 < n <= SMALL_ROWS:
        part, every = F.pmod(F.xxhash64("id"), F.lit(SMALL_PARTS)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(SMALL_PARTS - 1)))
        asking, rows = vectors.withColumn("part", part), vectors.withColumn("part", every)
        found = rows.groupBy("part").cogroup(asking.groupBy("part")).applyInPandas(
            lambda here, own: _best(own, here, k, digits), FOUND)
        return _ranked(found, k, digits), n * (n - 1), n * (n - 1)
    vectors = cut_lineage(vectors)
    if not n:
        empty = vectors.select("id", F.lit(0).alias("rank"), F.col("id").alias("neighbour"), F.lit(0.0).alias("cosine"))
        return empty, 0, 0
    centres = _centres(vectors, n)
    rows = cut_lineage(_clustered(vectors, centres))
    sizes = rows.groupBy("cluster").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()  # a row a centre
    radius, parts = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in sizes:
        radius[r["cluster"]], parts[r["cluster"]] = r["radius"] + 1e-9, -(-r["n"] // PART_ROWS)
    known = lambda values: F.array(*[F.lit(int(v)) for v in values])
    count, before = F.get(known(parts), F.col("cluster")), F.get(known(np.cumsum(parts) - parts), F.col("cluster"))
    rows = rows.select("id", "vector", (before + F.pmod(F.xxhash64("id"), count)).cast("int").alias("target"))
    inside = cut_lineage(rows.groupBy("target").applyInPandas(lambda part: _best(part, part, k, digits), FOUND))
    least = inside.groupBy("id").agg(F.min("cosine").alias("least"), F.count("*").alias("n"))
    queries = rows.join(least, "id", "left").select(
        "id", "vector", "target", F.when(F.col("n") == k, F.col("least")).otherwise(float("-inf")).alias("least"))
    sent = cut_lineage(_routed(queries, centres, radius, parts, digits))
    size = rows.groupBy("target").agg(F.count("*").alias("rows"))
    asked = sent.groupBy("target").agg(F.count("*").alias("asking"))
    load = cut_lineage(size.join(asked, "target", "left").select(
        "target", "rows", F.coalesce("asking", F.lit(0)).alias("asking"),
        F.ceil(F.coalesce("asking", F.lit(0)) / QUERY_ROWS).cast("int").alias("shares")))
    work = load.agg(F.sum(F.col("rows") * (F.col("rows") - 1) + F.col("rows") * F.col("asking"))).first()[0]
    # parts that very many queries ask are repeated, so that no task holds all of their queries
    busy = load.where("shares > 0").select("target", "shares")
    deal = lambda df, share: lookup_join(df, busy, ["target"]).select(
        F.col("id").alias("id"), F.col("vector").alias("vector"), F.col("target").alias("part"), share.alias("share"))
    left = deal(rows, F.explode(F.sequence(F.lit(1), "shares")))
    right = deal(sent, (F.pmod(F.xxhash64("id"), "shares") + 1).cast("int"))
    across = left.groupBy("part", "share").cogroup(right.groupBy("part", "share")).applyInPandas(
        lambda here, asking: _best(asking, here, k, digits), FOUND)
    return _ranked(inside.unionByName(across), k, digits), work, n * (n - 1)


def _ranked(found: DataFrame, k: int, digits: int) -> DataFrame:
    order = W.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("id", "rank", "neighbour", F.round(F.col("cosine") + 0.0, digits).alias("cosine"))
