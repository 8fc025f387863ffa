"""Stop epochs do not depend on how the log is split into files, nor on their order."""

import itertools
import json
import os

from scenewright.streaming import jobs as J

ROWS = [("a", e, float(v)) for e, v in enumerate([9, 8, 8, 8, 7, 7, 7, 7, 7, 1])] + [
    ("b", e, 5.0 - e) for e in range(5)] + [("c", e, None if e % 2 else 3.0) for e in range(6)]


def stops(spark, tmp, parts):
    source = tmp / "in"
    source.mkdir(parents=True)
    for i, part in enumerate(parts):
        at = source / f"{i}.json"
        at.write_text("".join(json.dumps({"run": r, "epoch": e, "loss": v}) + "\n" for r, e, v in part))
        os.utime(at, (1_700_000_000 + i, 1_700_000_000 + i))
    log = J.stream_logs(spark, str(source), "run string, epoch long, loss double", 1)
    rows = J.stop_signals(log, "run", "epoch", "loss", 4)
    J.replace_available(rows, str(tmp / "out"), str(tmp / "state"))
    return {r["run"]: r["stop_epoch"] for r in spark.read.schema(rows.schema).parquet(str(tmp / "out")).collect()}


def test_files_in_any_order(spark, tmp_path):
    whole = stops(spark, tmp_path / "one", [ROWS])
    assert whole == {"a": 8, "c": 4}
    thirds = [[r for r in ROWS if r[1] % 5 in k] for k in ((0, 1), (2, 3), (4,))]
    for i, parts in enumerate(itertools.permutations(thirds)):
        assert stops(spark, tmp_path / f"p{i}", parts) == whole
