"""No record of a JSON file is lost without an error."""

import json

import pytest

from scenewright.sources import samples as SM


def test_odd_lines_lose_nothing(spark, tmp_path):
    record = lambda i: json.dumps({"prompt": str(i), "scene": [[i]], "caption": "x"})
    for name, odd in (("a", "["), ("b", "{")):
        path = tmp_path / f"{name}.json"
        path.write_text("\n".join([record(1), odd, record(2), record(3)]))
        got = SM.read_json_or_jsonl(spark, str(path)).collect()  # malformed lines are left out, and only they
        assert sorted(r["prompt"] for r in got) == ["1", "2", "3"]
        with pytest.raises(ValueError, match="no JSON"):
            SM.read_samples(spark, str(path))
    path = tmp_path / "c.json"
    path.write_text("\n".join(["[" + record(1) + "]", record(2)]))
    for read in (SM.read_samples, SM.read_json_or_jsonl):
        with pytest.raises(ValueError, match="neither"):
            read(spark, str(path))
