"""Arrays that are cut into byte ranges: every element once, whatever is in its strings."""

import json
import random

import pytest

from scenewright.sources import json_arrays as J


def records(seed, n):
    rng = random.Random(seed)
    parts = ["a", ",", '"', "\\", "[", "]", "{", "}", "\n", "é", " ", "},{", '\\"', "],["]
    return [{"id": i, "text": "".join(rng.choices(parts, k=rng.choice([0, 3, 40]))), "scene": [[i, 2], [], [3]] if i % 3 else [],
             "more": {"k,": [1, {"x": "]"}]}, "none": None} for i in range(n)]


def read(spark, path):
    return [json.loads(r["value"]) for r in J.array_elements(spark, str(path)).orderBy("file", "start", "n").collect()]


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "701")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("indent", [None, 2])
def test_one_array_in_many_ranges(spark, tmp_path, small_ranges, indent):
    rows = records(1, 120)
    rows[50]["text"] = "long, " * 1500  # over many ranges
    path = tmp_path / "one.json"
    path.write_text(json.dumps(rows, indent=indent, ensure_ascii=False), encoding="utf-8")
    assert J.range_states(spark, str(path)).count() >= 8
    assert read(spark, path) == rows


def test_other_elements_and_several_files(spark, tmp_path, small_ranges):
    folder = tmp_path / "many"
    folder.mkdir()
    values = {"a": [1, "two, 2", None, [3, [4]], {"five": 5}, True], "b": [], "c": records(3, 40), "d": ["x"]}
    for name, value in values.items():
        (folder / f"{name}.json").write_text(("\n " if name == "a" else "") + json.dumps(value) + "\n")
    assert read(spark, folder) == values["a"] + values["c"] + values["d"]


def test_shuffled_states_give_the_same(spark, tmp_path, small_ranges, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_RANGES", 0)
    rows = records(5, 60)
    path = tmp_path / "one.json"
    path.write_text(json.dumps(rows))
    assert read(spark, path) == rows


@pytest.mark.parametrize("text", ['{"a": 1}', '[1, 2', '[1, "2]', '[1, 2]]', '[1, 2], [3]', '1, 2'])
def test_what_is_no_array_is_an_error(spark, tmp_path, text):
    path = tmp_path / "bad.json"
    path.write_text(text)
    with pytest.raises(Exception, match="is not one whole JSON array|goes on after the end"):
        read(spark, path)


def test_written_arrays_come_back(spark, tmp_path):
    rows = [(i, None if i % 5 == 0 else f'text, "{i}"', [i, i + 1]) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, text string, cells array<int>").repartition(3)
    J.write_arrays(df, str(tmp_path / "arrays"))
    for file in (tmp_path / "arrays").glob("*.txt"):
        json.loads(file.read_text())
    back = J.read_array(spark, str(tmp_path / "arrays"), "id long, text string, cells array<int>")
    assert sorted(map(tuple, back.collect())) == sorted((a, b, c) for a, b, c in rows)
