"""Links at the threshold whose signatures are unusually far apart are confirmed all the same."""

from __future__ import annotations

import os
import sys

import numpy as np
import pyarrow as pa

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from scenewright.llm import minhash  # noqa: E402


def test_unlucky_signatures_are_linked(spark):
    # 80 words of both, ten of each: similarity 0.80; sought are pairs with 38 codes or more apart
    text = lambda i, side: " ".join([*(f"c{i}x{j}" for j in range(80)), *(f"{side}{i}x{j}" for j in range(10))])
    n = 6000
    texts = [text(i, side) for i in range(n) for side in "lr"]
    planes, bands = map(np.concatenate, zip(*(
        minhash.signatures(sets) for _, sets in minhash.shingle_sets(pa.array(texts), 1))))
    x = (planes[::2] ^ planes[1::2]).view(np.uint64).reshape(n, minhash.BITS, minhash.PLANE)
    differ = np.bitwise_count(np.bitwise_or.reduce(x, axis=1)).sum(axis=1)
    unlucky = np.flatnonzero((differ > 37) & (bands[::2] == bands[1::2]).any(axis=1)).tolist()
    assert unlucky
    docs = [(2 * i + side, texts[2 * i + side]) for i in unlucky for side in (0, 1)]
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 1, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: d - d % 2 for d, _ in docs}


def test_codes_miss_less_than_bands():
    from math import comb

    for percent, bands in ((80, 4.9e-5), (85, 4.3e-7)):
        p = (1 - percent / 100) * 15 / 16
        most = minhash.most_differing(percent)
        assert sum(comb(125, i) * p**i * (1 - p) ** (125 - i) for i in range(most + 1, 126)) < bands / 10
