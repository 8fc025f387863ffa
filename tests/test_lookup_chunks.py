"""Texts are encoded by chunks: few rows are exchanged, and repeated or null keys merge as a grouping merges them."""

import random

import pytest
from pyspark.sql import functions as F

from scenewright.functions.tokens import tokenize
from scenewright.operators import vocabulary as V


def texts(n, seed=3):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["one", "two", "pipe", ".", "ä", "coin", f"w{rng.randrange(50)}"]) for _ in range(rng.randrange(30)))
            for _ in range(n)]


def words(text):
    return [t for t in text.replace(".", " . ").split()]


@pytest.mark.parametrize("chunk", [1, 40, 1_000_000])
def test_encode_and_decode(spark, monkeypatch, chunk):
    monkeypatch.setattr(V, "CHUNK_VALUES", chunk)
    made = texts(60)
    df = spark.createDataFrame([*enumerate(made), (-1, None), (-2, "")], "id int, text string").repartition(3)
    vocab = V.build_vocab(df, "text")
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    assert ids == {t: i for i, t in enumerate(["[PAD]", "[MASK]", *sorted({w for t in made for w in words(t)})])}
    coded = V.encode(df, vocab, "id", "text")
    want = {i: [ids[w] for w in words(t)] for i, t in enumerate(made)} | {-1: [], -2: []}
    assert {r["id"]: r["ids"] for r in coded.collect()} == want
    back = V.decode(coded, vocab, "id", "ids")
    assert {r["id"]: r["decoded"] for r in back.collect()} == {
        i: " ".join(words(t)) for i, t in enumerate(made)} | {-1: "", -2: ""}
    loose = {r["id"]: r["ids"] for r in V.encode(df, vocab.where("token <> 'pipe'"), "id", "text", strict=False).collect()}
    assert loose == {i: [None if x == ids["pipe"] else x for x in row] for i, row in want.items()}


def test_repeated_and_null_keys_are_merged_by_position(spark):
    rows = [(1, "b a"), (1, "a b c"), (None, "c"), (None, "a b"), (2, "c a"), (3, None), (3, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    vocab = V.build_vocab(df, "text")
    coded = V.encode(df, vocab, "id", "text")
    assert {r["id"]: r["ids"] for r in coded.collect()} == {1: [2, 3, 2, 3, 4], None: [2, 4, 3], 2: [4, 2], 3: []}
    again = coded.where("id = 1 or id = 2").withColumn("id", F.lit(7))
    assert V.decode(again, vocab, "id", "ids").collect()[0]["decoded"] == "a c a b a b c"


def test_tokens_are_exchanged_by_chunk_not_by_text(spark):
    df = spark.createDataFrame(list(enumerate(["one two pipe coin"] * 2000)), "id int, text string").repartition(2)
    vocab = V.build_vocab(df, "text")
    coded = V.encode(df, vocab, "id", "text")
    assert coded.count() == 2000
    plan = coded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1
    numbered = df.select("id", tokenize(F.col("text")).alias("t")).mapInArrow(
        V._numbered, "_chunk bigint, id int, _numbers array<int>, _distinct array<string>")
    assert numbered.where("_distinct IS NOT NULL").select(F.explode("_distinct")).count() == 8
