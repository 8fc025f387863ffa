"""The models of a segment of token ids: close to the entropy, stored with it, checked; each block alone."""

from __future__ import annotations

import os
import sys
import zlib

import numpy as np
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT]

from scenewright.llm import idcoder  # noqa: E402


def drawn(n=200_000):
    rng = np.random.default_rng(3)
    return rng.permutation(50_257)[np.minimum(rng.zipf(1.2, n), 50_256)]


def test_order_0_is_that_of_the_segment():
    ids = drawn()
    share = np.bincount(ids) / len(ids)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    blobs, size = idcoder.encode_blocks(ids)
    assert 8 * sum(map(len, blobs)) / len(ids) < 1.15 * entropy
    assert np.array_equal(idcoder.decode_blocks(blobs, size), ids)


def test_each_block_can_be_decoded_alone():
    ids = drawn(10_000)
    (models, *blobs), size = idcoder.encode_blocks(ids)
    for k, blob in enumerate(blobs):
        alone = idcoder.decode_blocks([models, blob], size[k : k + 1])
        assert np.array_equal(alone, ids[2048 * k : 2048 * k + size[k]])


@pytest.mark.parametrize("ids", [[7], [65_535], [65_535] * 5_000, list(range(65_536)), [1, 2] * 3_000, [0] * 2_049])
def test_odd_ids_round_trip(ids):
    blobs, size = idcoder.encode_blocks(np.array(ids))
    assert idcoder.decode_blocks(blobs, size).tolist() == ids


def test_damaged_models_are_an_error():
    ids = drawn(5_000)
    data = bytearray(idcoder.write_segment(np.array([1]), np.array([len(ids)]), ids))
    found = idcoder.read_segment(bytes(data))
    assert np.array_equal(found[2], ids) and zlib.crc32(found[2].astype("<u4").tobytes()) == zlib.crc32(ids.astype("<u4").tobytes())
    models = 24 + 16 + 4 * (3 * 3 + 1)  # after the counts, one document and the table of three blocks
    data[models + 40] ^= 1
    with pytest.raises(ValueError, match="models"):
        idcoder.read_segment(bytes(data))
