"""Many small files are read by a few tasks, and a glob pattern means what Spark's readers take it for."""

import json

import pytest

from scenewright.sources import samples as SM
from scenewright.sources import tree as T


@pytest.fixture()
def runs(tmp_path):
    for i in range(120):
        folder = tmp_path / f"run-{i}" / "samples"
        folder.mkdir(parents=True)
        (folder / "samples.json").write_text(json.dumps([{"prompt": f"{i} {k}", "scene": [[i]]} for k in range(2)]))
        (tmp_path / f"run-{i}" / "log.jsonl").write_text(f'{{"epoch": {i}}}\r\n\n{{"epoch": {i}, "x": [1]}}\n')
    return tmp_path


def test_small_files_share_tasks(spark, runs):
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # a file a task for Spark's readers
    try:
        got = SM.read_samples(spark, f"{runs}/*/samples/samples.json")
        assert got.rdd.getNumPartitions() < 20
        assert sorted(r["prompt"] for r in got.collect()) == sorted(f"{i} {k}" for i in range(120) for k in range(2))
        mixed = SM.read_json_or_jsonl(spark, f"{runs}/*/{{log.jsonl,samples/samples.json}}")
        assert mixed.rdd.getNumPartitions() < 40
        rows = mixed.collect()
        assert len(rows) == 480 and sorted(r["epoch"] for r in rows if r["epoch"] is not None) == sorted([*range(120)] * 2)
        assert sum(r["x"] == [1] for r in rows) == 120
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


@pytest.mark.parametrize("pattern", ["run-1", "run-?/log.jsonl", "run-[1-3]*/log.jsonl", "run-[^1]/{log,none}.jsonl",
                                     "*/samples", "run-{1,2{0,1}}/*.jsonl", "*/*/samples.json"])
def test_patterns(spark, runs, pattern):
    (runs / "run-1" / "_hidden.json").write_text("[]")
    (runs / "run-1" / ".hidden").write_text("[]")
    found = T.find_files(spark, f"{runs}/{pattern}").where("not nested")
    spark_found = spark.read.format("binaryFile").load(f"{runs}/{pattern}").select("path", "length").collect()
    want = sorted((r["path"].removeprefix("file:"), r["length"]) for r in spark_found)
    assert sorted((r["path"], r["bytes"]) for r in found.collect()) == want and want


def test_large_files_are_split_and_small_ones_not(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SM, "SMALL", 100)
    record = lambda i: json.dumps({"prompt": str(i), "scene": [[i]], "caption": "x"})
    (tmp_path / "a.json").write_text("\n\n" + "\n".join(map(record, range(20))))
    (tmp_path / "b.json").write_text("[" + ",\n".join(map(record, range(20, 40))) + "]")
    (tmp_path / "c.json").write_text(record(40))
    (tmp_path / "d.json").write_text("[" + record(41) + "]")
    for read in (SM.read_samples, SM.read_json_or_jsonl):
        assert sorted(int(r["prompt"]) for r in read(spark, str(tmp_path)).collect()) == list(range(42))
    (tmp_path / "e.json").write_text("[" + ",\n".join(map(record, range(20))) + "] 1")
    with pytest.raises(ValueError, match="neither"):
        SM.read_samples(spark, str(tmp_path))
