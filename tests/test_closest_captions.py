"""Best caption matches by bounds against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from scenewright.functions import captions as E
from scenewright.games import PLATFORMER
from scenewright.operators import closest

CAPTION = "id bigint, caption string"
POOL = [p for ps in PLATFORMER.phrases.values() for p in ps]


def every_pair(spark, left, right):
    """Best score, then smallest id, of scores below 1; scores as whole points."""
    a, b = (spark.createDataFrame(x, CAPTION).withColumn("caption", F.coalesce("caption", F.lit(""))) for x in (left, right))
    points = F.round(E.caption_score(F.col("a.caption"), F.col("b.caption")) * 20 * len(PLATFORMER.topics)).cast("int")
    pairs = a.alias("a").join(b.alias("b"), F.lit(True)).select(
        F.col("a.id").alias("id"), points.alias("s"), (-F.col("b.id")).alias("m"))
    best = pairs.groupBy("id").agg(F.max(F.struct("s", "m")).alias("x")).collect()
    return {r["id"]: (-r["x"]["m"], r["x"]["s"]) for r in best if r["x"]["s"] < 20 * len(PLATFORMER.topics)}


def matches(spark, left, right):
    out, compared = closest.closest_captions(
        spark.createDataFrame(left, CAPTION), spark.createDataFrame(right, CAPTION), PLATFORMER)
    rows = out.collect()
    assert len({r["id"] for r in rows}) == len(rows)
    return {r["id"]: (r["match"], round(r["score"] * 20 * len(PLATFORMER.topics))) for r in rows}, compared


def captions(rng, n, most):
    return [". ".join(rng.sample(POOL, rng.randint(1, most))) + "." for _ in range(n)]


@pytest.mark.parametrize("few", [0, 4096])
def test_equals_all_pairs_with_ties_nulls_and_repeats(spark, monkeypatch, few):
    monkeypatch.setattr(closest, "FEW", few)
    rng = random.Random(5)
    known = captions(rng, 40, 5) + ["", None, "one strange pipe.", "many odd pipes. a few enemies."]
    known += rng.sample(known, 10)
    made = captions(rng, 60, 7) + known[:8] + ["", None, "no such words at all.", "several pipes", "one strange pipe. two coins."]
    right = [(100 - i, c) for i, c in enumerate(known)]
    got, _ = matches(spark, list(enumerate(made)), right)
    assert got == every_pair(spark, list(enumerate(made)), right)


@pytest.mark.parametrize("few", [0, 4096])
def test_far_matches_and_single_ones(spark, monkeypatch, few):
    monkeypatch.setattr(closest, "FEW", few)
    rng = random.Random(6)
    far = list(enumerate(captions(rng, 12, 9)))
    assert matches(spark, far, [(7, "")])[0] == every_pair(spark, far, [(7, "")])
    assert matches(spark, far, [])[0] == {}
    assert matches(spark, [], far)[0] == {}
    assert matches(spark, far, far)[0] == {}


def test_few_pairs_are_compared(spark, monkeypatch):
    monkeypatch.setattr(closest, "FEW", 0)
    rng = random.Random(7)
    known = captions(rng, 600, 9)
    made = [c + " " + rng.choice(POOL) + "." for c in known]
    got, compared = matches(spark, list(enumerate(made)), list(enumerate(known)))
    assert len(got) > 200 and compared < len(made) * len(known) / 10
