"""Merged sketches against exact ranks, in any order of parts."""

import os
import random
import sys

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from scenewright.operators import sketches as S  # noqa: E402
from scenewright.session import get_spark  # noqa: E402

P = [0.0, 0.1, 0.5, 0.9, 1.0]


def test_merged_quantiles_keep_the_bound():
    spark, rng = get_spark(), random.Random(3)
    rows = [(f"f{i % 17}", "a" if i % 3 else None, rng.choice([rng.gauss(0, 1), 0.5])) for i in range(20_000)]
    rows += [("f1", "a", None), ("f1", "a", float("nan")), ("f2", "none", None)]
    df = spark.createDataFrame(rows, "part string, g string, v double")
    parts = S.part_sketches(df, ["part"], ["g"], "v")
    early, late = parts.where("part < 'f13'"), parts.where("part >= 'f13'")
    stored = S.merged_sketches(early, ["g"]).select("g", "sketch")
    ways = [S.merged_sketches(parts, ["g"]), S.merged_sketches(late.select("g", "sketch").unionByName(stored), ["g"])]
    for merged in ways:
        got = S.rank_of(df, S.sketch_quantiles(merged, ["g"], P), ["g"], "v").collect()
        assert {(r.g, r.n) for r in got} == {(None, 6667), ("a", 13333)} and len(got) == 2 * len(P)
        for r in got:
            values = sorted(v for _, g, v in rows if g == r.g and v is not None and v == v)
            below, upto = sum(v < r.value for v in values) / len(values), sum(v <= r.value for v in values) / len(values)
            assert abs(r.error - max(below - r.p, r.p - upto, 0)) < 1e-9 and r.error <= S.rank_error()
    size = parts.agg(F.max(F.length("sketch"))).first()[0]
    assert size < 20_000  # bytes, whatever the number of rows


def test_no_rows():
    df = get_spark().createDataFrame([], "part string, g string, v double")
    merged = S.merged_sketches(S.part_sketches(df, ["part"], ["g"], "v"), ["g"])
    assert S.rank_of(df, S.sketch_quantiles(merged, ["g"], P), ["g"], "v").count() == 0
