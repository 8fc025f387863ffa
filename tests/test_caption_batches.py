"""Captions of texts and their comparison, a batch at a time, against the column expressions they replace."""

import random

import pytest
from pyspark.sql import functions as F

from scenewright import fixtures as X
from scenewright.functions import captions as E
from scenewright.functions.binding import let
from scenewright.games import GAMES
from scenewright.operators import metrics as M


def by_replacing(text):
    def part(t, letter):
        count = (F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))) % 12
        words = F.array(*[F.lit(X._phrase(t, k)) for k in range(6)])
        return let(count, lambda n: F.when(n < 6, F.struct(
            ((n * 7 + t * 5) % 17).alias("pos"), F.lit(t).alias("t"), F.get(words, n).alias("p"))))

    parts = [part(t, letter) for t, (letter, _, _) in enumerate(X.CAPTION_TOPICS)]
    ordered = F.transform(F.array_sort(F.array_compact(F.array(*parts))), lambda x: x["p"])
    return let(ordered, lambda ps: F.when(F.size(ps) == 0, "").otherwise(F.concat(F.array_join(ps, ". "), F.lit("."))))


def test_letters_are_counted_once(spark, monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aeiou thnrsdclgbfpÉİxyz.\U0001f600") for _ in range(rng.randrange(400))) for _ in range(120)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", None, "b" * 300])], "id int, text string")
    low = df.select("id", F.lower("text").alias("s"))
    want = low.select("id", by_replacing(F.col("s")), by_replacing(F.translate("s", "aeo", "eoa"))).collect()
    monkeypatch.setattr(X, "PIECE", 7)
    made = low.select("id", X.captions_of(F.col("s")).alias("c"))
    assert sorted((r["id"], *r["c"]) for r in made.collect()) == sorted(map(tuple, want))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "replace(" not in plan and "lambdafunction" not in plan


@pytest.mark.parametrize("name", sorted(GAMES))
def test_comparison_of_batches(spark, name):
    game, rng = GAMES[name], random.Random(2)
    words = [*game.topics, *game.quantity_terms, "enemies", "grass", "No ", "no ", "s", "class\tes", "ls s", "és"]

    def caption():
        return ". ".join(" ".join(rng.choice(words) + rng.choice(["", "s"]) for _ in range(rng.randrange(1, 4)))
                         for _ in range(rng.randrange(8))) + rng.choice([".", "", " . ."])

    rows = [(i, caption(), caption()) for i in range(300)]
    rows += [(1000 + i, a, a) for i, a, _ in rows[:40]] + [(-1, None, None), (-2, "", None), (-3, None, rows[0][2])]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    topics = df.select("id", *[E.extract_topics(F.col(c), game.topics).alias(c) for c in "ab"])
    scores = topics.withColumn("s", E.topic_scores(F.col("a"), F.col("b"), game.quantity_terms))
    same = lambda x: E.normalize_plural(x["a"]) == E.normalize_plural(x["b"])
    want = scores.select(
        "id", E.mean_score(F.col("s"), len(game.topics)).alias("score"), *[
            F.transform(F.filter(F.arrays_zip("a", "b"), keep), lambda x: x["b"]).alias(k) for k, keep in (
                ("exact", lambda x: same(x)), ("partial", lambda x: ~same(x)),
                ("excess", lambda x: x["a"].isNull() & x["b"].isNotNull()))]).collect()
    got = df.select("id", E.compare_captions(F.col("a"), F.col("b"), game).alias("j"),
                    E.caption_score(F.col("a"), F.col("b"), game).alias("s")).collect()
    assert {r["id"]: (r["j"]["score"], r["j"]["exact"], r["j"]["partial"], r["j"]["excess"]) for r in got} == {
        r["id"]: tuple(r)[1:] for r in want}
    assert all(r["s"] == r["j"]["score"] for r in got)
    assert len({r["s"] for r in got}) > 20


def test_defects_of_several_features_take_one_pass(spark):
    df = spark.createDataFrame([("one pipe. two broken cannons.",), ("no broken pipes. one cannon.",), (None,)], "c string")
    both = M.defect_rate(df, F.col("c"), "pipe", "cannon")
    alone = [r for f in ("pipe", "cannon") for r in M.defect_rate(df, F.col("c"), f).collect()]
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, alone))
    assert {r["feature"]: (r["captions"], r["broken"], r["mentions"]) for r in alone} == {
        "pipe": (3, 0, 1), "cannon": (3, 1, 2)}
    assert "Union" not in both._jdf.queryExecution().optimizedPlan().toString()
