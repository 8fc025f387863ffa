"""Ranks, run logs, statistics, splits and files."""

import json
import math

import pytest
from pyspark.sql import functions as F

from scenewright.games import T_975
from scenewright.operators import runs as R
from scenewright.operators import splits as SP
from scenewright.operators.joins import lookup_join
from scenewright.operators.ranking import global_rank, group_quantiles
from scenewright.sources import levels as LV
from scenewright.sources import samples as SM
from scenewright.sources import sinks


def test_global_rank_with_a_hot_value(spark):
    rows = [("hot", i) for i in range(300)] + [(f"k{i}", i) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, id bigint")
    got = [(r["k"], r["id"]) for r in global_rank(df, ["k", "id"], "at", 8).orderBy("at").collect()]
    assert got == sorted(rows)


def test_lookup_join_without_broadcast(spark):
    facts = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    dim = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k bigint, v string")
    big = lookup_join(facts, dim, ["k"], max_rows=1)
    assert big.groupBy("v").count().count() == 3 and big.count() == 1000


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([("a", float(v), v) for v in (1, 2, 4, 8)] + [("b", 5.0, 1)],
                               "g string, v double, id int")
    got = {r["g"]: (r["q1"], r["m"]) for r in group_quantiles(
        df, ["g"], "v", ["id"], {"q1": 0.25, "m": 0.5}).collect()}
    assert got == {"a": (1.75, 3.0), "b": (5.0, 5.0)}


def test_t_table_against_the_density():
    for nu in (1, 2, 5, 30):
        scale = math.gamma((nu + 1) / 2) / math.sqrt(nu * math.pi) / math.gamma(nu / 2)
        t, n = T_975[nu - 1], 20000
        step = t / n
        f = lambda x: scale * (1 + x * x / nu) ** (-(nu + 1) / 2)
        area = step / 3 * (f(0) + f(t) + sum((4 if i % 2 else 2) * f(i * step) for i in range(1, n)))
        assert abs(area - 0.475) < 1e-6


def test_early_stop_over_piece_borders(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 4)
    losses = [5.0, 4.0, 4.5, 3.0, 3.5, 3.0, 3.2, 3.1, 2.0, 2.5]
    log = spark.createDataFrame([("r", i, v) for i, v in enumerate(losses)] + [("s", 0, 1.0)],
                                "run string, epoch int, loss double")
    best = {r["run"]: r["best_epoch"] for r in R.best_epochs(log, ["run"], "epoch", "loss").collect()}
    stop = {r["run"]: r["stop_epoch"] for r in R.early_stop_epochs(
        log, ["run"], "epoch", "loss", 3).collect()}
    assert best == {"r": 8, "s": 0} and stop == {"r": 6, "s": None}


def test_one_line_logs_and_best_on_first_line(spark):
    log = spark.createDataFrame(
        [("a", 0, 0, "2024-01-01 00:00:00"), ("a", 1, 1, "2024-01-01 00:01:00"),
         ("b", 0, 0, "2024-01-01 00:00:00")], "run string, epoch int, line int, ts string")
    best = spark.createDataFrame([("a", 0), ("b", 0)], "run string, best_epoch int")
    got = R.run_durations(log, best, ["run"], "epoch", "line", "ts").collect()
    assert [(r["run"], r["total"], r["to_best"]) for r in got] == [("a", 60.0, None)]


def test_split_sizes_and_repair(spark):
    df = spark.createDataFrame([(i, "one pipe." if i % 50 == 0 else "full floor.") for i in range(203)],
                               "id bigint, caption string")
    parts = SP.split(df, "id", 1)
    assert {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()} == {
        "train": 162, "val": 20, "test": 21}
    fixed, left = SP.repair_coverage(parts, "id", "caption", ["pipe", "tower"])
    cover = SP.split_coverage(fixed, "caption", ["pipe"]).collect()
    missing = {(r["split"], r["topic"]) for r in left.collect()}
    assert all(r["present"] or (r["split"], "pipe") in missing for r in cover)
    assert {("train", "tower"), ("val", "tower"), ("test", "tower")} <= missing
    with pytest.raises(ValueError):
        SP.split(df, "id", 1, 0.5, 0.1, 0.1)
    with pytest.raises(ValueError):
        SP.systematic_sample(df.limit(3), ["id"], 5)


def test_files(spark, tmp_path):
    (tmp_path / "tiles.json").write_text(json.dumps({"tiles": {"X": ["solid"], "-": ["empty"]}}))
    tiles = LV.read_tileset(spark, str(tmp_path / "tiles.json"), extra_tile="%")
    assert [r["ch"] for r in tiles.orderBy("tile").collect()] == ["-", "X", "%"]
    kept = LV.read_tileset(spark, str(tmp_path / "tiles.json"), sort=False)
    assert [r["ch"] for r in kept.orderBy("tile").collect()] == ["X", "-"]
    levels = tmp_path / "levels"
    levels.mkdir()
    for name in ("a.txt", "b.txt"):
        (levels / name).write_text("--\n\n XX \n")
    assert LV.read_ascii_levels(spark, str(levels)).orderBy("level_id").first()["lines"] == ["--", "XX"]
    assert LV.read_ascii_levels(spark, str(levels), distinct=True).count() == 1

    (tmp_path / "s.json").write_text(json.dumps([{"prompt": None, "scene": [[1]], "caption": "x."},
                                                 {"scene": [], "caption": "y."}]))
    assert SM.read_samples(spark, str(tmp_path / "s.json")).count() == 1
    (tmp_path / "raw.json").write_text(json.dumps([[[1, 2]], [[3, 4]]]))
    assert SM.read_scenes(spark, str(tmp_path / "raw.json")).orderBy("position").first()["scene"] == [[1, 2]]

    (tmp_path / "log.jsonl").write_text('{"epoch": 0, "loss": 1.5}\nnot json\n{"epoch": 1, "val_loss": 2.0}\n')
    assert SM.read_jsonl(spark, str(tmp_path / "log.jsonl")).count() == 2
    assert SM.read_jsonl(spark, str(tmp_path / "log.jsonl"), bad_lines="keep").count() == 3
    with pytest.raises(Exception):
        SM.read_jsonl(spark, str(tmp_path / "log.jsonl"), bad_lines="raise").collect()
    (tmp_path / "num.jsonl").write_text('{"Caption 7": "one pipe.", "Average score": 0.5}\n')
    row = SM.read_numbered(spark, str(tmp_path / "num.jsonl")).first()
    assert (row["number"], row["caption"], row["scores"]) == (7, "one pipe.", {"Average score": 0.5})
    (tmp_path / "g.jsonl").write_text('{"group": "a", "models": [{"e": 1}, {"e": 2}]}\n'
                                      '{"group": "b", "models": [{"e": 3}]}\n')
    stats = SM.read_json_or_jsonl(spark, str(tmp_path / "g.jsonl"))
    assert SM.flatten_group_stats(stats, "group").count() == 3

    out = str(tmp_path / "out")
    df = spark.createDataFrame([(["--", "XX"],)], "rows array<string>")
    sinks.write_ascii(df, out)
    with pytest.raises(Exception):
        sinks.write_ascii(df, out)
    sinks.write_ascii(df, out, if_exists="skip")
    assert [r["value"] for r in spark.read.text(out).collect()] == ["--", "XX", ""]
    sinks.write_samples(spark.createDataFrame([("p", None)], "caption string, prompt string"),
                        str(tmp_path / "w"))
    assert spark.read.json(str(tmp_path / "w")).count() == 1
    assert sinks.write_versioned(df, str(tmp_path / "v"), "1").endswith("version=1")
