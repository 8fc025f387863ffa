"""Sampling, train/validation/test splits and their topic coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenewright.operators.ranking import global_rank


def _shuffle_key(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))


def systematic_sample(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """``n`` rows at equal steps of the ordered data; needs more than ``n`` rows."""
    total = df.count()
    step = total // (n + 1)
    if step == 0:
        raise ValueError(f"cannot take {n} spaced rows from {total}")
    ranked = global_rank(df, order, "_at")
    at = F.col("_at")
    return ranked.where((at % step == 0) & (at / step).between(1, n)).drop("_at")


def random_limit(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, the same on every run."""
    return df.orderBy(_shuffle_key(key, seed), key).limit(n)


def split(df: DataFrame, key: str, seed: int, train: float = 0.8, validate: float = 0.1,
          test: float = 0.1) -> DataFrame:
    """Add ``split``; sizes are cut down to whole rows, the rest goes to test."""
    if abs(train + validate + test - 1.0) > 1e-6:
        raise ValueError("train, validate and test must sum to 1")
    total = df.count()
    n_train, n_validate = int(train * total), int(validate * total)
    ranked = global_rank(df.withColumn("_h", _shuffle_key(key, seed)), ["_h", key], "_at")
    return ranked.withColumn(
        "split", F.when(F.col("_at") < n_train, "train")
        .when(F.col("_at") < n_train + n_validate, "val").otherwise("test")).drop("_h", "_at")


def split_coverage(df: DataFrame, caption: str, topics: list[str]) -> DataFrame:
    """``(split, topic, present)``: is a topic word in any caption of the split?"""
    low = F.lower(F.col(caption))
    flags = df.groupBy("split").agg(*[
        F.max(low.contains(t)).alias(f"t{i}") for i, t in enumerate(topics)])
    return flags.select("split", F.explode(F.array(*[
        F.struct(F.lit(t).alias("topic"), F.col(f"t{i}").alias("present"))
        for i, t in enumerate(topics)])).alias("x")).select("split", "x.topic", "x.present")


def repair_coverage(df: DataFrame, key: str, caption: str, topics: list[str]
                    ) -> tuple[DataFrame, DataFrame]:
    """Move samples so that every split speaks of every topic.

    For each missing topic the first sample (in key order) moves over whose
    split keeps at least one sample of everything that it speaks of. Counts are
    updated for all its topics after every move. Per split and topic only the
    first few carriers are candidates, as many as there can be moves. Returns the
    frame with a new ``split`` and the topics that stay uncovered in the end.
    """
    splits = ["train", "val", "test"]
    low = F.lower(F.col(caption))
    marked = df.select("split", F.col(key).alias("_key"), F.filter(
        F.array(*[F.when(low.contains(t), F.lit(i)) for i, t in enumerate(topics)]),
        lambda i: i.isNotNull()).alias("_has"))
    each = marked.select("split", "_key", "_has", F.explode("_has").alias("_topic"))
    counted = each.groupBy("split", "_topic").count().collect()  # splits x topics
    most = len(splits) * len(topics) + 1
    rank = F.row_number().over(W.partitionBy("split", "_topic").orderBy("_key"))
    first = each.withColumn("_rank", rank).where(F.col("_rank") <= most).collect()  # bounded by the rank
    n = {(s, i): 0 for s in splits for i in range(len(topics))} | {(r["split"], r["_topic"]): r["count"] for r in counted}
    carriers: dict = {}
    for r in sorted(first, key=lambda r: r["_rank"]):
        carriers.setdefault(r["_topic"], []).append((r["_key"], r["split"], r["_has"]))
    moves: dict = {}
    for target in splits:
        for i in range(len(topics)):
            if n[target, i]:
                continue
            free = [(k, s, has) for k, s, has in carriers.get(i, []) if s != target and k not in moves
                    and all(n[s, t] > 1 for t in has)]
            if free:
                k, source, has = min(free, key=lambda c: (splits.index(c[1]), c[0]))
                moves[k] = target
                for t in has:
                    n[source, t] -= 1
                    n[target, t] += 1
    out = F.col("split")
    for k, target in moves.items():
        out = F.when(F.col(key) == k, target).otherwise(out)
    left = df.sparkSession.createDataFrame(
        [(s, topics[i]) for s in splits for i in range(len(topics)) if not n[s, i]], "split string, topic string")
    return df.withColumn("split", out), left
