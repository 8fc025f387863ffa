"""A class that holds most documents is one row per slice of texts before any join by class."""

import os
import sys

import pyarrow as pa

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
from scenewright.llm import minhash  # noqa: E402
from scenewright.session import get_spark  # noqa: E402


def test_copies_of_a_slice_are_one_row():
    same = "one two three four five six"
    texts = [same, "", None, same.upper(), "x y", same]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    (out,) = minhash._sign([batch], 5)
    assert out.column(0).to_pylist() == [[0, 3, 5], [1, 2], [4]]
    assert out.column(1).to_pylist() == [2, 0, 1] and out.column(2)[1].as_py() is None


def test_hot_class_over_many_partitions():
    spark = get_spark()
    words = [f"w{i}" for i in range(40)]
    copies = [(i, " ".join(words)) for i in range(3, 303)]
    near = [(400, " ".join([*words, "more"])), (401, " ".join(words[:20]))]
    odd = [(500, None), (501, ""), (502, " \n"), (7, " ".join(words)), (None, " ".join(words))]
    df = spark.createDataFrame(copies + near + odd, "doc_id long, text string").repartition(9)
    got = [tuple(r) for r in minhash.near_duplicates(df).collect()]
    want = [(i, 36, 3, i == 3) for i, _ in copies] + [(400, 37, 3, False), (401, 16, 401, True), (7, 36, 3, False)]
    assert sorted(got) == sorted(want + [(i, 0, i, True) for i in (500, 501, 502)])
