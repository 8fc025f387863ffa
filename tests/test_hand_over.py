"""Positions, checkpoints, backups, tile vectors, segments and draws on small frames."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scenewright.functions import scenes as S
from scenewright.functions.captions import caption_score
from scenewright.games import PLATFORMER
from scenewright.operators import captioner, generation
from scenewright.operators import metrics as M
from scenewright.operators import runs as R
from scenewright.sources import sinks


def test_prompts_by_position(spark):
    source = spark.createDataFrame([(2, "b."), (1, "a."), (3, None)], "i int, caption string")
    target = spark.createDataFrame([("x", "old"), ("z", "old"), ("y", None)], "k string, prompt string")
    got = {r["k"]: r["prompt"] for r in R.zip_prompts(source, target, ["i"], ["k"], "caption").collect()}
    assert got == {"x": "a.", "y": "b.", "z": None}
    with pytest.raises(ValueError, match="3 source rows and 2 target rows"):
        R.zip_prompts(source, target.limit(2), ["i"], ["k"], "caption")


def test_finished_model_is_one_epoch_later(spark):
    paths = [("a", "o/a/checkpoint-2"), ("a", "o/a/checkpoint-10"), ("a", "o/a/unet"), ("b", "o/b/checkpoint-3"),
             ("c", "o/c/unet/"), (None, "o/n/checkpoint-1"), ("b", "o/b/samples"), ("b", None)]
    df = spark.createDataFrame(paths, "run string, path string")
    got = {r["run"]: (r["path"], r["epoch"]) for r in R.latest_checkpoint(df, ["run"], "path", "unet").collect()}
    assert got == {"a": ("o/a", 11), "b": ("o/b/checkpoint-3", 3), "c": ("o/c", 0), None: ("o/n/checkpoint-1", 1)}
    assert R.checkpoints(df, ["run"], "path").count() == 4


def test_unusable_logs_have_a_reason(spark):
    log = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 1.0), ("c", None), ("c", None)], "run string, loss double")
    expected = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("d",)], "run string")
    got = {r["run"]: r["reason"] for r in R.unusable_logs(expected, log, ["run"], "loss").collect()}
    assert got == {"b": "fewer than two lines", "c": "no loss", "d": "no log"}


def test_backup_has_the_older_version(spark, tmp_path):
    path, backup = str(tmp_path / "now"), str(tmp_path / "old")
    for v in (1, 2, 3):
        sinks.write_backed_up(spark.createDataFrame([(v,)], "v int"), path, backup)
        assert spark.read.json(path).first()["v"] == v
    assert spark.read.json(backup).first()["v"] == 2


def test_nearest_tile(spark):
    tiles = [[1.0, 0.0], [0.0, 2.0], [0.0, 5.0], [0.0, 0.0]]
    df = spark.createDataFrame([(0, [9.0, 1.0]), (1, [0.1, 0.2]), (2, [0.0, 0.0]), (3, [-1.0, 0.0])], "id int, v array<float>")
    got = {r["id"]: r["t"] for r in df.select("id", S.nearest_tile(F.col("v"), tiles).alias("t")).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 1}
    ids = spark.createDataFrame([([[0, 1], [1, 0]],)], "s array<array<int>>")
    back = ids.select(S.decode_nearest(S.embed_tiles(F.col("s"), tiles), tiles).alias("b")).first()["b"]
    assert back == [[0, 1], [1, 0]]


def test_segments_of_a_wide_scene(spark):
    rows = ["-" * 40] * 15 + ["X" * 40]
    df = spark.createDataFrame([(1, rows, "full floor."), (2, ["-" * 16] * 15 + ["X" * 16], "full floor.")],
                               "id int, rows array<string>, prompt string")
    got = {r["id"]: r for r in M.score_segments(df, "id", "prompt", captioner.platformer_caption).collect()}
    assert len(got[1]["captions"]) == 3 and got[2]["captions"] == ["full floor."]
    assert got[1]["score"] == 1.0 and got[1]["scores"] == [1.0] * 3


def test_draws_go_on_until_enough_are_new(spark):
    plain = generation.generate_captions(spark.range(40).withColumnRenamed("id", "draw"), "draw", PLATFORMER, 7)
    known = plain.where("draw < 25").select("caption")
    got = generation.draw_until(known, 10, PLATFORMER, 7).collect()
    old = [r["caption"] for r in known.collect()]
    assert len(got) == 10 and min(r["draw"] for r in got) >= 25
    pairs = spark.createDataFrame([(r["caption"], o) for r in got for o in old], "a string, b string")
    assert pairs.where(caption_score(F.col("a"), F.col("b")) == 1.0).count() == 0


def test_evaluation_document_of_captions_alone(spark):
    pairs = spark.createDataFrame([("one pipe.", "one pipe."), ("one pipe.", "one broken pipe."), ("two coins.", None)],
                                  "prompt string, caption string")
    row = M.evaluation_document(pairs, "prompt", "caption", ["pipe", "tower"]).first()
    assert row["match"]["n"] == 3 and row["match"]["perfect"] == 1 and row["broken_pipe"]["broken"] == 1
    assert row["phrase_targeting"]["pipe"]["tp"] == 2 and row["phrase_targeting"]["tower"]["f1"] == 0.0
