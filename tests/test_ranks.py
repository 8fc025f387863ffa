"""Global positions in ranges without a cap, and joins that look at bytes before they broadcast."""

import random

import pytest
from pyspark.sql import functions as F

from scenewright.operators import joins, ranking


def rows_of(n, hot):
    rng = random.Random(n)
    return [(None if i % 50 == 0 else 0 if rng.random() < hot else rng.randrange(n), i) for i in range(n)]


@pytest.mark.parametrize("ranges", [1, 2, 300, None])
def test_positions_equal_a_sort(spark, ranges):
    data = rows_of(900, 0.4)
    df = spark.createDataFrame(data, "k bigint, id bigint").repartition(5)
    got = {r["id"]: r["rank"] for r in ranking.global_rank(df, ["k", "id"], ranges=ranges).collect()}
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == {r[1]: i for i, r in enumerate(order)}
    empty = ranking.global_rank(df.where("id < 0"), ["k", "id"], ranges=ranges)
    assert empty.columns == ["k", "id", "rank"] and empty.count() == 0


@pytest.mark.parametrize("n,rows", [(40_000, 1000), (80_000, 500)])
def test_ranges_are_even_whatever_their_number(spark, monkeypatch, n, rows):
    monkeypatch.setattr(ranking, "RANGE_ROWS", rows)
    df = spark.range(n, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.xxhash64("id")).alias("k"), "id")  # a third has one key
    sizes = [r["count"] for r in ranking.ranged(df, ["k", "id"]).groupBy(
        F.shiftright("_range_row", ranking.ROW_BITS)).count().collect()]
    assert sum(sizes) == n and len(sizes) == n // rows
    assert max(sizes) <= 2 * rows and max(sizes) <= 2.5 * min(sizes)


def test_group_positions_and_quantiles(spark):
    data = [(g, float(v), i) for i, (g, v) in enumerate((i % 3 and "a", i * 7 % 40) for i in range(90))]
    data = [(str(g), v, i) for g, v, i in data]
    df = spark.createDataFrame(data, "g string, v double, id bigint")
    got = {r["g"]: r["m"] for r in ranking.group_quantiles(df, ["g"], "v", ["id"], {"m": 0.5}).collect()}
    want = {r["g"]: r["m"] for r in df.groupBy("g").agg(F.expr("percentile(v, 0.5)").alias("m")).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("max_rows,max_bytes,small", [(100, 1 << 20, True), (3, 1 << 20, False), (100, 900, False)])
def test_broadcast_by_rows_and_bytes(spark, max_rows, max_bytes, small):
    wide = spark.createDataFrame([(i if i else None, "x" * 200, [1, 2], {"a": 1}) for i in range(5)],
                                 "k bigint, text string, xs array<int>, m map<string,int>")
    assert joins.is_small(wide, max_rows, max_bytes) == small
    facts = spark.createDataFrame([(i % 6 if i % 6 else None, i) for i in range(60)], "k bigint, id bigint")
    out = joins.lookup_join(facts, wide, ["k"], "left", max_rows=max_rows, max_bytes=max_bytes)
    assert {(r["id"], r["text"] is not None) for r in out.collect()} == {(i, i % 6 != 5) for i in range(60)}
    assert ("Broadcast" in out._jdf.queryExecution().optimizedPlan().toString()
            or "broadcast" in out._jdf.queryExecution().optimizedPlan().toString()) == small
    assert joins.is_small(wide.where("k < 0"))
