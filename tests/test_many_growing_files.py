"""Offsets of many files stay small and survive a restart."""

import json

import pytest
from pyspark.errors import StreamingQueryException

from scenewright.sources import growing as G
from scenewright.streaming import jobs as J


def test_offset_of_many_files_is_small(tmp_path):
    for i in range(G.INLINE + 200):
        (tmp_path / f"{i}.jsonl").write_text(f'{{"epoch": {i}}}\n' * 2 + "half")
    stream = G._Stream({"path": str(tmp_path), "suffix": ".jsonl"})
    first = stream.latestOffset()
    assert len(json.dumps(first)) < 500 and stream.latestOffset() == first
    parts = stream.partitions({"files": {}}, first)
    assert sum(len(b) for p in parts for b in stream.read(p)) == 2 * (G.INLINE + 200)
    with (tmp_path / "7.jsonl").open("a") as f:
        f.write('"\n{}\n')
    again = G._Stream({"path": str(tmp_path), "suffix": ".jsonl"})  # as after a restart
    second = again.latestOffset()
    assert second != first and stream.latestOffset()["files_read"] == G.INLINE + 200
    parts = again.partitions(first, second)
    assert [r["line"] for p in parts for b in again.read(p) for r in b.to_pylist()] == ['half"', "{}"]


def test_restart_with_a_state_file(spark, tmp_path, monkeypatch):
    logs, out, state = tmp_path / "logs", tmp_path / "out", tmp_path / "state"
    logs.mkdir()
    for i in range(G.INLINE + 5):
        (logs / f"{i}.jsonl").write_text(f'{{"epoch": {i}}}\n')

    def once():
        J.write_available(G.growing_records(spark, str(logs), "epoch BIGINT"), str(out), str(state))

    once()
    once()
    with (logs / "3.jsonl").open("a") as f:
        f.write('{"epoch": -1}\n')
    once()
    got = sorted(r["epoch"] for r in spark.read.parquet(str(out)).collect())
    assert got == [-1, *range(G.INLINE + 5)]
    (logs / "4.jsonl").write_text("")
    with pytest.raises(StreamingQueryException, match="shorter|gone"):
        once()
