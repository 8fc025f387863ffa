"""Nothing is lost: wide scenes, mixed files, null groups, empty texts, unequal grids, repeated moves."""

import json

import pytest
from pyspark.sql import functions as F

from scenewright.games import PLATFORMER
from scenewright.operators import ranking as K
from scenewright.operators import runs as R
from scenewright.operators import splits as SP
from scenewright.operators import vocabulary as V
from scenewright.operators.captioner import platformer_caption
from scenewright.operators.similarity import min_edit_distance_self
from scenewright.sources import samples as SM
from scenewright.sources import sinks


def stairs(width, at):
    """A floor and one ascending staircase of four steps that starts in column ``at``."""
    rows = [["-"] * width for _ in range(15)] + [["X"] * width]
    for step in range(4):
        for r in range(14 - step, 15):
            rows[r][at + step] = "X"
    return ["".join(r) for r in rows]


def test_captions_of_wide_and_mixed_scenes(spark):
    cases = [(1, stairs(16, 5)), (2, stairs(32, 5)), (3, stairs(32, 22)), (4, stairs(60, 50)), (5, stairs(16, 9))]
    got = platformer_caption(spark.createDataFrame(cases, "id int, rows array<string>").repartition(1))
    texts = {r["id"]: r["caption"] for r in got.collect()}
    assert len(set(texts.values())) == 1 and "one ascending staircase" in texts[1]
    wide = spark.createDataFrame([(1, stairs(80, 5))], "id int, rows array<string>")
    with pytest.raises(Exception, match="cut the level first"):
        platformer_caption(wide).collect()


def test_samples_round_trip_and_mixed_files(spark, tmp_path):
    made = spark.createDataFrame([(f"p{i}", [[i, 1]], "c") for i in range(10)],
                                 SM.SAMPLE).coalesce(1)
    sinks.write_samples(made, str(tmp_path / "out"))
    assert SM.read_samples(spark, str(tmp_path / "out")).count() == 10
    mixed = tmp_path / "mixed"
    mixed.mkdir()
    record = lambda i: {"prompt": str(i), "scene": [[i]], "caption": "x"}
    (mixed / "a b.json").write_text(json.dumps([record(1), record(2)], indent=1))
    (mixed / "c.json").write_text("\n" + "\n".join(json.dumps(record(i)) for i in (3, 4, 5)) + "\n")
    (mixed / "d.json").write_text(json.dumps([record(6)]))
    (mixed / "e.json").write_text(json.dumps(record(7), indent=1))
    for read in (SM.read_samples, SM.read_json_or_jsonl):
        assert sorted(r["prompt"] for r in read(spark, str(mixed)).collect()) == list("1234567")


def test_null_groups_stay(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), (None, 1, 5.0), (None, 2, 7.0)],
                               "g string, t int, v double")
    assert K.group_rank(df, ["g"], ["t"]).count() == 4
    got = {r["g"]: r["median"] for r in K.group_quantiles(df, ["g"], "v", ["t"], {"median": 0.5}).collect()}
    assert got == {"a": 2.0, None: 6.0}
    assert R.running_extreme(df, ["g"], "t", F.col("v"), "best", True).count() == 4
    assert R.score_spread(df, ["g"], "v", ["t"]).count() == 2


def test_texts_without_tokens_stay(spark):
    df = spark.createDataFrame([(1, "one pipe."), (2, ""), (3, None)], "id int, text string")
    vocab = V.build_vocab(df, "text")
    ids = V.encode(df, vocab, "id", "text")
    got = {r["id"]: r["ids"] for r in ids.collect()}
    assert len(got[1]) == 3 and got[2] == [] and got[3] == []
    assert {r["id"]: r["decoded"] for r in V.decode(ids, vocab, "id", "ids").collect()} == {
        1: "one pipe .", 2: "", 3: ""}
    with pytest.raises(Exception, match="unknown token"):
        V.encode(df, vocab.where("token <> 'pipe'"), "id", "text").collect()


def test_unequal_grids_and_unknown_tiles_are_errors(spark):
    for grids in (["XXXX", "XXXX----"], ["XXXX", "\x01\x01\x01\x01"]):
        df = spark.createDataFrame(list(enumerate(grids)), "id int, grid string")
        with pytest.raises(Exception, match="grid"):
            min_edit_distance_self(df, PLATFORMER).collect()


def test_repair_counts_after_every_move(spark):
    rows = [(1, "pipe coin", "train"), (2, "pipe coin", "train"), (3, "pipe coin", "val"), (4, "floor", "test")]
    df = spark.createDataFrame(rows, "id int, caption string, split string")
    fixed, left = SP.repair_coverage(df, "id", "caption", ["pipe", "coin"])
    assert left.count() == 0 and fixed.where("split = 'test' and id <> 4").count() == 1
    rows = [(1, "pipe", "train"), (2, "pipe", "train"), (3, "x", "val"), (4, "x", "test")]
    fixed, left = SP.repair_coverage(spark.createDataFrame(rows, "id int, caption string, split string"),
                                     "id", "caption", ["pipe"])
    have = {r["split"] for r in fixed.where("caption = 'pipe'").collect()}
    assert "train" in have and {r["split"] for r in left.collect()} == {"train", "val", "test"} - have and len(have) == 2


def test_run_names(spark):
    names = ["m-conditional-7", "m-conditional-samples", "m-conditional-7-plots", "x-conditional-absence3", "base", "afdm"]
    df = spark.createDataFrame([(f"/r/{n}",) for n in names], "path string")
    got = {r["name"] for r in R.discover_runs(df, "path", unnumbered="base").collect()}
    assert got == {"m-conditional-7", "x-conditional-absence3", "base", "afdm"}
