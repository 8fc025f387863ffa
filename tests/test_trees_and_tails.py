"""Folder trees, summaries that cannot be used, and files that grow in place."""

import json
import os

import pytest
from pyspark.errors import StreamingQueryException

from scenewright.operators import runs as R
from scenewright.sources import growing as G
from scenewright.sources import tree as T
from scenewright.streaming import jobs as J


def put(path, data: bytes, mode="wb"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, mode) as f:
        f.write(data)


def test_list_tree_equals_walk(spark, tmp_path):
    for i in range(30):
        put(tmp_path / f"run{i % 4}" / f"deep{i % 3}" / f"ü {i}.txt", b"x" * i)
    (tmp_path / "empty").mkdir()
    want = set()
    for folder, folders, files in os.walk(tmp_path):
        want |= {(os.path.join(folder, n), folder, True, None) for n in folders}
        want |= {(os.path.join(folder, n), folder, False, os.path.getsize(os.path.join(folder, n))) for n in files}
    for root in (str(tmp_path), f"file:{tmp_path}/", f"file://{tmp_path}"):
        got = T.list_tree(spark, root).collect()
        assert {(r["path"], r["parent"], r["is_dir"], r["bytes"]) for r in got} == want
        assert len(got) == len(want) and all(r["path"].endswith("/" + r["name"]) for r in got)
    assert T.list_tree(spark, str(tmp_path / "empty")).count() == 0
    with pytest.raises(Exception, match="does not exist|Cannot get|not a directory|FileNotFound"):
        T.list_tree(spark, str(tmp_path / "none"))


def test_list_tree_stops_in_a_loop(spark, tmp_path, monkeypatch):
    (tmp_path / "a").mkdir()
    os.symlink(tmp_path, tmp_path / "a" / "back")
    monkeypatch.setattr(T, "DEEPEST", 4)
    with pytest.raises(ValueError, match="link to a parent"):
        T.list_tree(spark, str(tmp_path))


def test_write_tree_round_trip(spark, tmp_path):
    rows = [(f"{tmp_path}/a/é.txt", "äx\n"), (f"{tmp_path}/a/none.txt", ""), (f"{tmp_path}/b", None)]
    made = T.write_tree(spark.createDataFrame(rows, "path string, content string"))
    assert {tuple(r) for r in made.collect()} == {(rows[0][0], 4), (rows[1][0], 0), (rows[2][0], None)}
    assert (tmp_path / "a" / "é.txt").read_text() == "äx\n" and (tmp_path / "b").is_dir()
    assert sorted(os.listdir(tmp_path / "a")) == ["none.txt", "é.txt"]


def test_latest_log_by_modification_time(spark, tmp_path):
    for i, when in enumerate((500, 900, 100)):
        put(tmp_path / "run" / f"log{i}.jsonl", b"".join(b'{"epoch": %d}\n' % e for e in range(i, i + 5)))
        os.utime(tmp_path / "run" / f"log{i}.jsonl", (when, when))
    files = T.list_tree(spark, str(tmp_path)).where("not is_dir").select("path", "modified")
    log = G.growing_records(spark, str(tmp_path), "epoch BIGINT", stream=False).withColumnRenamed("file", "path")
    log = log.join(files, "path").selectExpr("'run' AS run", "path", "modified", "epoch")
    kept = R.truncate_log(log, ["run"], "path", "modified", "epoch", 3).collect()
    assert {(os.path.basename(r["path"]), r["epoch"]) for r in kept} == {("log1.jsonl", e) for e in (1, 2, 3)}


def test_summaries_read_and_skipped(spark, tmp_path):
    good = {"best_epoch": 3, "best_val_loss": 0.5}
    cases = {
        "good": (json.dumps(good).encode(), "read", None, None),
        "none": (None, "missing", "no summary", None),
        "cut": ('{"ü": 1, "best'.encode(), "unreadable", "Unterminated string starting at", 10),
        "bytes": (b'{"a": "\xff"}', "unreadable", "not UTF-8", 7),
        "list": (b"[1]", "unreadable", "not an object", 0),
        "empty": (b"", "unreadable", "Expecting value", 0),
        "null": (b'{"best_epoch": null, "best_val_loss": 1}', "incomplete", "no best_epoch", None),
        "less": (b"{}", "incomplete", "no best_epoch, best_val_loss", None),
        "large": (b" " * 300, "unreadable", "more than 200 bytes", None),
    }
    for name, (data, *_) in cases.items():
        (tmp_path / name).mkdir()
        if data is not None:
            put(tmp_path / name / "info.json", data)
    put(tmp_path / "good" / "below" / "info.json", b"not its summary")
    listing = T.list_tree(spark, str(tmp_path))
    runs = listing.where(f"is_dir and parent = '{tmp_path}'")
    found = T.read_summaries(runs, listing, "info.json", ("best_epoch", "best_val_loss"), 200)
    got = {os.path.basename(r["run"]): (r["status"], r["reason"], r["at"]) for r in found.collect()}
    assert got == {name: tuple(rest) for name, (_, *rest) in cases.items()}
    used, left = T.usable(found, "best_epoch INT, best_val_loss DOUBLE"), T.skipped(found)
    assert [tuple(r)[1:] for r in used.collect()] == [(3, 0.5)]
    assert used.count() + left.count() == runs.count()


@pytest.mark.parametrize("piece", [1, 3, 1 << 20])
def test_count_entries(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(T, "READ", piece)  # pieces end inside strings, numbers and characters
    prompts = {"prompt": "a, [b] \" ü {"}
    cases = {
        "two.json": (json.dumps([prompts, 12345]), (2, True, None)),
        "wide.json": (json.dumps([{"x": 1}, prompts], ensure_ascii=False, indent=2), (2, False, None)),
        "null.json": ('[{"prompt": null}]', (1, False, None)),
        "zero.json": (" [ ] ", (0, None, None)),
        "object.json": ("{}", (None, None, "no array")),
        "cut.json": ('[{"prompt": "a"}, {"pro', (None, None, "no valid entry")),
        "open.json": ("[1, 2", (None, None, "no comma between two entries")),
        "more.json": ("[1] [2]", (None, None, "text after the array")),
        "blank.json": ("", (None, None, "no array")),
        "lines.jsonl": ('{"prompt": "a"}\n{"prompt"\n', (2, True, None)),
        "last.jsonl": ('{"prompt": null}\n{}\n{}', (3, False, None)),
        "one.jsonl": ('{"prompt": "é"}', (1, True, None)),
        "bad.jsonl": ("{\n{}\n", (None, None, "no valid entry")),
        "zero.jsonl": ("", (0, None, None)),
    }
    for name, (text, _) in cases.items():
        put(tmp_path / name, text.encode())
    run = T._counted("prompt")
    import pyarrow as pa
    names = sorted(cases)
    batch = pa.RecordBatch.from_pydict({"path": [str(tmp_path / n) for n in names]})
    got = {os.path.basename(r["path"]): (r["found"], r["has_prompt"], r["error"])
           for b in run(iter([batch])) for r in b.to_pylist()}
    assert got == {n: want for n, (_, want) in cases.items()}
    if piece > 3:
        files = T.list_tree(spark, str(tmp_path))
        assert T.count_entries(files).count() == len(cases)


def lines_of(data: bytes):
    at, out = 0, []
    for line in data.split(b"\n")[:-1]:
        out.append((at, line.removesuffix(b"\r").decode(errors="replace")))
        at += len(line) + 1
    return out


@pytest.mark.parametrize("size,read", [(1, 1), (2, 3), (5, 2), (7, 1 << 20), (1000, 4)])
def test_ranges_own_the_lines_that_start_in_them(tmp_path, monkeypatch, size, read):
    monkeypatch.setattr(G, "READ", read)
    monkeypatch.setattr(G, "MOST_TASKS", 1 << 20)
    for i, data in enumerate((b"", b"\n", b"a\n\nbc\r\n" + b"d" * 23 + b"\n", b"no end", "ü\nß\n\xe9tc".encode("latin-1"),
                              b"one\ntwo\nhalf")):
        path = tmp_path / f"{i}.txt"
        put(path, data)
        stream = G._Stream({"path": str(path), "rangebytes": str(size)})
        end = stream.latestOffset()
        parts = stream.partitions({"files": {}}, end)
        got = [(r["at"], r["line"]) for p in parts for b in stream.read(p) for r in b.to_pylist()]
        assert got == lines_of(data)
        assert all(sum(c - b for _, _, b, c, _ in p.ranges) <= size for p in parts)


def run_once(spark, folder, out, state):
    rows = G.growing_records(spark, str(folder), "epoch BIGINT, loss DOUBLE", range_bytes=64)
    J.write_available(rows, str(out), str(state))


def test_tail_goes_on_after_a_restart(spark, tmp_path):
    logs, out, state = tmp_path / "logs", tmp_path / "out", tmp_path / "state"
    record = '{{"epoch": {}, "loss": 0.5}}\n'.format
    put(logs / "a.jsonl", "".join(map(record, range(20))).encode() + b'{"epoch": 20, "lo')
    put(logs / "other.txt", b"not a log\n")
    run_once(spark, logs, out, state)
    assert spark.read.parquet(str(out)).count() == 20  # the half line waits
    put(logs / "a.jsonl", b'ss": 1}\nnonsense\n\n', "ab")
    put(logs / "sub" / "b.jsonl", record(7).encode())
    run_once(spark, logs, out, state)
    run_once(spark, logs, out, state)  # nothing new
    put(logs / "a.jsonl", record(21).encode(), "ab")
    run_once(spark, logs, out, state)
    got = sorted(map(tuple, spark.read.parquet(str(out)).collect()))
    once = G.growing_records(spark, str(logs), "epoch BIGINT, loss DOUBLE", stream=False)
    assert got == sorted(map(tuple, once.collect())) and len(got) == 23


def test_tail_while_the_query_runs(spark, tmp_path):
    logs = tmp_path / "logs"
    put(logs / "a.jsonl", b'{"epoch": 1}\n')
    rows = G.growing_records(spark, str(logs), "epoch BIGINT")
    query = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        put(logs / "a.jsonl", b'{"epoch": 2}\n{"epoch"', "ab")
        query.processAllAvailable()
        put(logs / "a.jsonl", b': 3}\n', "ab")
        query.processAllAvailable()
    finally:
        query.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["at"], r["epoch"]) for r in got.collect()) == [(0, 1), (13, 2), (26, 3)]


@pytest.mark.parametrize("harm", ["shorter", "gone", "other"])
def test_lost_bytes_are_an_error(spark, tmp_path, harm):
    logs, out, state = tmp_path / "logs", tmp_path / "out", tmp_path / "state"
    put(logs / "a.jsonl", b'{"epoch": 1}\n{"epoch": 2}\n')
    put(logs / "b.jsonl", b'{"epoch": 1}\n')
    run_once(spark, logs, out, state)
    if harm == "shorter":
        put(logs / "a.jsonl", b'{"epoch": 1}\n')
    elif harm == "gone":
        os.remove(logs / "a.jsonl")
    else:
        put(logs / "a.jsonl", b'{"epoch": 9}\n{"epoch": 2}\n{"epoch": 3}\n')
    with pytest.raises(StreamingQueryException, match="shorter|gone|another beginning"):
        run_once(spark, logs, out, state)


def test_bad_lines(spark, tmp_path):
    put(tmp_path / "a.jsonl", b'{"epoch": 1}\n[2]\nx\n')

    def read(bad):
        return G.growing_records(spark, str(tmp_path), "epoch BIGINT", stream=False, bad_lines=bad)

    assert [r["epoch"] for r in read("skip").collect()] == [1]
    assert [r["epoch"] for r in read("keep").orderBy("at").collect()] == [1, None, None]
    with pytest.raises(Exception, match="MALFORMED|alformed"):
        read("raise").collect()
    with pytest.raises(ValueError):
        read("ignore")
