"""Tile statistics over patches and scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenewright.functions.tokens import unit_hash


def center_and_context(patch: Column, n: int) -> Column:
    """``STRUCT<center, context>`` of a patch given as one string of n*n tiles."""
    middle = n * n // 2
    return F.struct(
        F.substring(patch, middle + 1, 1).alias("center"),
        F.split(F.concat(F.substring(patch, 1, middle), F.substring(patch, middle + 2, n * n)), "")
        .alias("context"))


def center_counts(patches: DataFrame, n: int, threshold: float = 0.001) -> DataFrame:
    """Center tile frequency and its keep probability under subsampling."""
    counts = patches.select(center_and_context(F.col("patch"), n)["center"].alias("center")).groupBy(
        "center").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0)))  # one row per tile kind
    keep = (F.sqrt(share / threshold) + 1) * (threshold / share)
    return counts.select("center", "n", F.least(keep, F.lit(1.0)).alias("keep"))


def skipgram_pairs(patches: DataFrame, n: int, keep: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """``(center, context, n)``: co-occurrence counts, counted per patch content first.

    ``keep`` (from ``center_counts``) thins out frequent centers by a hash of
    the patch.
    """
    counted = patches.groupBy("patch").agg(F.count("*").alias("n"))
    parts = counted.select("patch", "n", center_and_context(F.col("patch"), n).alias("p"))
    if keep is not None:
        parts = parts.join(F.broadcast(keep.select(F.col("center").alias("_c"), "keep")),
                           F.col("p.center") == F.col("_c")).where(
            unit_hash(F.lit(seed), F.col("patch")) <= F.col("keep"))
    pairs = parts.select(F.col("p.center").alias("center"), F.explode("p.context").alias("context"), "n")
    return pairs.groupBy("center", "context").agg(F.sum("n").alias("n"))


def tile_scaling(cells: DataFrame, alphabet: str, root: int) -> DataFrame:
    """``(tile, n, scaling)``: n-th root of the counts relative to the rarest tile."""
    counts = cells.groupBy("ch").agg(F.count("*").alias("n"))
    every = cells.sparkSession.createDataFrame(list(enumerate(alphabet)), "tile int, ch string")
    known = F.broadcast(every).join(counts, "ch", "left").select(
        "tile", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).alias("n"))
    powered = known.withColumn("_s", F.pow("n", F.lit(1.0 / root)))
    least = F.min("_s").over(W.partitionBy(F.lit(0)))  # one row per tile kind
    return powered.select("tile", "n", (F.col("_s") / least).alias("scaling"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def l2_normalize(v: Column) -> Column:
    return F.transform(v, lambda x: x / F.sqrt(dot(v, v)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def mean_pool(vectors: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Mean vector per group, element by element."""
    parts = vectors.select(*by, F.posexplode(vector).alias("i", "v"))
    means = parts.groupBy(*by, "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return means.groupBy(*by).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("mean"))
