"""Caption algebra: demo pairs, quirks and properties."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from scenewright.functions import captions as E
from scenewright.functions import tokens as T
from scenewright.games import PLATFORMER
from scenewright.operators import vocabulary as V
from scenewright.operators.similarity import best_caption_match, knn_cosine, min_edit_distance_self

GOOD = [
    "full floor. two coins. one pipe. several enemies.",
    "full floor. one tower. two cannons.",
    "floor with two gaps. a few coins. one coin line. one descending staircase.",
    "giant gap with one chunk of floor. two question blocks. one platform.",
    "no floor. two enemies. one pipe.",
]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_demo_pair(spark):
    a = "floor with one gap. one cannon. two pipes."
    b = "giant gap with one chunk of floor. one cannon. two pipes."
    got = one(spark, E.compare_captions(F.lit(a), F.lit(b)))
    assert got["score"] == 1.0  # both floors name one
    assert got["partial"] == ["giant gap with one chunk of floor"] and got["excess"] == []


def test_valid_sentences(spark):
    topics = list(PLATFORMER.phrases)
    for text in GOOD:
        assert one(spark, E.is_valid_caption(F.lit(text), topics))
    assert not one(spark, E.is_valid_caption(F.lit("full floor. one pipe. one broken pipe."), topics))


def test_denied_phrase_hides_a_positive_one(spark):
    at = PLATFORMER.topics.index("pipe")
    hidden = one(spark, E.extract_topics(F.lit("no upside down pipes. one pipe."), PLATFORMER.topics))
    shown = one(spark, E.extract_topics(F.lit("one pipe. no upside down pipes."), PLATFORMER.topics))
    assert hidden[at] is None and shown[at] == "one pipe"


def test_keys_are_equal_exactly_for_perfect_scores(spark):
    rng = random.Random(7)
    pool = [p for ps in PLATFORMER.phrases.values() for p in ps] + list(PLATFORMER.absent.values())
    texts = [". ".join(rng.sample(pool, rng.randint(0, 5))) + "." for _ in range(60)]
    pairs = list(itertools.product(texts, texts)) + [(t, t) for t in texts]
    df = spark.createDataFrame(pairs, "a string, b string")
    wrong = df.where((E.topic_key(F.col("a")) == E.topic_key(F.col("b")))
                     != (E.caption_score(F.col("a"), F.col("b")) == 1.0))
    assert wrong.count() == 0


def test_best_match_agrees_with_all_pairs(spark):
    rng = random.Random(9)
    pool = [p for ps in PLATFORMER.phrases.values() for p in ps]
    texts = [". ".join(rng.sample(pool, rng.randint(1, 6))) + "." for _ in range(80)]
    left = spark.createDataFrame(list(enumerate(texts[:50])), "id bigint, caption string")
    right = spark.createDataFrame(list(enumerate(texts[45:])), "id bigint, caption string")
    got = {r["id"]: r["score"] for r in best_caption_match(left, right, PLATFORMER).collect()}
    every = left.alias("a").join(right.alias("b"), F.lit(True)).select(
        F.col("a.id").alias("id"), E.caption_score(F.col("a.caption"), F.col("b.caption")).alias("s"))
    want = {r["id"]: r["s"] for r in every.groupBy("id").agg(F.max("s").alias("s")).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {
        k: round(v, 9) for k, v in want.items() if round(v, 9) < 1}


def test_self_distance_is_symmetric_and_exact(spark):
    rng = random.Random(2)
    grids = ["".join(rng.choice("-X<o") for _ in range(256)) for _ in range(40)]
    grids += [grids[0], grids[1][:250] + "XXXXXX"]
    df = spark.createDataFrame(list(enumerate(grids)), "id bigint, grid string")
    got = dict(min_edit_distance_self(df, PLATFORMER).collect())
    ham = lambda a, b: sum(x != y for x, y in zip(a, b))
    assert got == {i: min(ham(g, h) for j, h in enumerate(grids) if j != i) for i, g in enumerate(grids)}
    with pytest.raises(ValueError):
        min_edit_distance_self(df.limit(1), PLATFORMER)


def test_neighbours_exclude_by_id(spark):
    df = spark.createDataFrame([(i, [float(i + 1), 1.0, float(i % 3)]) for i in range(20)],
                               "id bigint, vector array<float>")
    out = knn_cosine(df, 3).collect()
    assert len(out) == 60 and all(r["id"] != r["neighbour"] for r in out)


def test_tokens_round_trip(spark):
    texts = ["one pipe. two coins.", "full floor, [MASK] naïve wörds."]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    vocab = V.build_vocab(df, "text")
    assert vocab.where("token IN ('[PAD]', '[MASK]')").orderBy("id").collect()[0]["id"] == 0
    ids = V.encode(df, vocab, "id", "text")
    back = dict(V.decode(ids, vocab, "id", "ids").collect())
    assert back[0] == "one pipe . two coins ." and "[MASK] naïve wörds" in back[1]
    with pytest.raises(Exception, match="unknown token"):
        V.encode(df, vocab.where("token <> 'pipe'"), "id", "text").collect()
    padded = one(spark, T.pad_ids(F.array(*[F.lit(i).cast("bigint") for i in (5, 6)]), 4))
    assert padded == [5, 6, 0, 0]
    with pytest.raises(Exception, match="exceeds"):
        one(spark, T.pad_ids(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")), 1, strict=True))


def test_absence_prompt(spark):
    told = one(spark, E.append_absence(F.lit("full floor. one pipe.")))
    assert told.startswith("full floor. one pipe. no ceiling. no upside down pipes. no coin lines.")
    assert "no pipes" not in told and "broken" not in told
