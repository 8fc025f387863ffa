"""Global positions without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenewright.session import cut_lineage

#: Rows of a range; there are as many ranges as that takes.
RANGE_ROWS = 1_000_000
#: monotonically_increasing_id is the partition, shifted by this, and the row in it.
ROW_BITS = 33


def ranged(df: DataFrame, keys: list[str], ranges: int | None = None) -> DataFrame:
    """The rows in ranges of the keys, with ``_range_row``: the range, shifted by ``ROW_BITS``, and the row in it.

    Spark samples the limits of the ranges. Written once, so that every later
    pass sees the same ranges.
    """
    if ranges is None:
        ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    placed = df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    return cut_lineage(placed.withColumn("_range_row", F.monotonically_increasing_id()))


def global_rank(df: DataFrame, keys: list[str], name: str = "rank", ranges: int | None = None
                ) -> DataFrame:
    """Add the 0-based position of each row in the order of ``keys``.

    ``keys`` must identify rows. Rows are exchanged once into ranges of the
    whole key, so that one frequent leading value does not fill a range, and
    sorted there; the sizes of the earlier ranges, a row each, are added.
    """
    placed = ranged(df, keys, ranges)
    range_ = F.shiftright("_range_row", ROW_BITS)
    sizes = placed.groupBy(range_.alias("_range")).agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(
        W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.col("_range_row").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (
        placed.withColumn("_range", range_).join(F.broadcast(before), "_range")
        .withColumn(name, within + F.col("_before")).drop("_range", "_range_row", "_before")
    )


def group_rank(df: DataFrame, by: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """0-based position of each row inside its group, without a task per group.

    Rows are ranked globally by group and order; the group's first rank is
    subtracted. ``by + order`` must identify rows.
    """
    from scenewright.operators.joins import lookup_join

    ranked = global_rank(df, [*by, *order], "_pos")
    starts = ranked.groupBy(*by).agg(F.min("_pos").alias("_start"))
    return lookup_join(ranked, starts, by).withColumn(
        name, F.col("_pos") - F.col("_start")).drop("_pos", "_start")


def group_quantiles(df: DataFrame, by: list[str], value: str, tie: list[str],
                    probabilities: dict[str, float]) -> DataFrame:
    """Exact quantiles per group with linear interpolation.

    Values are picked by position, so no task holds a whole group. ``tie``
    columns make rows of equal value distinct.
    """
    from scenewright.operators.joins import lookup_join

    ranked = group_rank(df.where(F.col(value).isNotNull()).select(*by, value, *tie), by,
                        [value, *tie], "_k")
    sizes = ranked.groupBy(*by).agg(F.count("*").alias("_n"))
    joined = lookup_join(ranked, sizes, by)
    picks = []
    for name, p in probabilities.items():
        at = F.lit(p) * (F.col("_n") - 1)
        low, part = F.floor(at), at - F.floor(at)
        weight = F.when(F.col("_k") == low, 1.0 - part).when(F.col("_k") == low + 1, part)
        picks.append(F.sum(F.when(weight > 0, weight * F.col(value))).alias(name))
    return joined.groupBy(*by).agg(*picks)
