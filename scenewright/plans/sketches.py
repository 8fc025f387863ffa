"""Roll-ups from sketches that are kept per part and merged, checked by their exact ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright import fixtures as X
from scenewright.operators import sketches as S
from scenewright.session import scratch_folder

ASKED = [0.25, 0.5, 0.75]


def mergeable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by priority: a stored sketch per month, merged; within the stated error of the exact rank?"""
    orders = X.table(spark, sf_dir, "orders").select(
        "o_orderpriority", "o_totalprice", F.trunc("o_orderdate", "month").alias("month"))
    at = f"{scratch_folder(spark, 'sketches')}/parts"
    S.part_sketches(orders, ["month"], ["o_orderpriority"], "o_totalprice").write.parquet(at)
    merged = S.merged_sketches(spark.read.parquet(at), ["o_orderpriority"])
    found = S.sketch_quantiles(merged, ["o_orderpriority"], ASKED)
    return S.rank_of(orders, found, ["o_orderpriority"], "o_totalprice").select(
        "o_orderpriority", "p", "n", "parts", (F.col("error") <= S.rank_error()).alias("within"))


QUERIES = {
    "g16_mergeable_quantiles": (mergeable, """SELECT o_orderpriority, p, n, parts, true AS within FROM (
  SELECT o_orderpriority, count(o_totalprice) AS n, count(DISTINCT date_trunc('month', o_orderdate)) AS parts
  FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1), (VALUES (0.25::DOUBLE), (0.5), (0.75)) AS q(p)"""),
}
