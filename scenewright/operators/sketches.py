"""Quantiles that can be added to: one sketch per part, merged in any order.

The exact forms in ``ranking`` number all rows again when rows arrive. Here each
part (a file, a day, a batch) leaves a KLL sketch of a few kilobytes; new parts
are sketched alone and merged with the stored ones. A merged quantile has a
rank, as a share of all rows, within ``rank_error(k)`` of the one asked for.

Defined cases: null and NaN values are not counted; a group without values has
no sketch; equal values are one step in rank, and any rank inside it is right;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenewright.operators.joins import lookup_join

#: Size parameter of the sketches; larger is more exact and larger in bytes.
K = 400


def rank_error(k: int = K) -> float:
    """Bound on the error in rank: twice the 99 percent bound of a KLL sketch of size ``k``."""
    return 2 * 2.296 / k**0.9021


def part_sketches(df: DataFrame, part: list[str], by: list[str], value: str, k: int = K) -> DataFrame:
    """``(part, by, sketch)``: a row per part and group, aggregated before the exchange."""
    number = F.col(value).cast("double")
    rows = df.where(number.isNotNull() & ~F.isnan(number))
    return rows.groupBy(*part, *by).agg(F.kll_sketch_agg_double(number, F.lit(k)).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """``(by, n, parts, sketch)`` of all parts of a group; a stored result is merged again like a part."""
    merged = F.kll_merge_agg_double("sketch", F.lit(k))
    return sketches.groupBy(*by).agg(merged.alias("sketch"), F.count("*").alias("parts")).select(
        *by, F.kll_sketch_get_n_double("sketch").alias("n"), "parts", "sketch")


def sketch_quantiles(merged: DataFrame, by: list[str], probabilities: list[float]) -> DataFrame:
    """``(by, n, parts, p, value)``: a row per group and probability."""
    picks = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_double(
        "sketch", F.lit(float(p))).alias("value")) for p in probabilities])
    return merged.select(*by, "n", "parts", F.explode(picks).alias("q")).select(*by, "n", "parts", "q.*")


def rank_of(df: DataFrame, quantiles: DataFrame, by: list[str], value: str) -> DataFrame:
    """``quantiles`` with ``error``: how far the exact rank of each value is from its ``p``.

    A sketch draws at random while it compacts, so another evaluation may find
    another value; ``quantiles`` is read at one place of the plan only.
    """
    rest = [c for c in quantiles.columns if c not in by]
    asked = quantiles.groupBy(*by).agg(F.collect_list(F.struct(*[F.col(c).alias(f"_{c}") for c in rest])).alias("asked"))
    number = F.col(value).cast("double")
    rows = df.where(number.isNotNull() & ~F.isnan(number)).select(*by, number.alias("x"))
    met = lookup_join(rows, asked, by).select(*by, "x", F.explode("asked").alias("a")).select(*by, "x", "a.*")
    below, upto = (F.avg(test.cast("double")) for test in (F.col("x") < F.col("_value"), F.col("x") <= F.col("_value")))
    error = F.greatest(F.col("below") - F.col("_p"), F.col("_p") - F.col("upto"), F.lit(0.0))
    return (met.groupBy(*by, *[f"_{c}" for c in rest]).agg(below.alias("below"), upto.alias("upto"))
            .select(*by, *[F.col(f"_{c}").alias(c) for c in rest], error.alias("error")))
