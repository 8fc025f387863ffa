"""The memory of an encoder: shared by the tasks of a worker, bounded, and without influence on the ids."""

from __future__ import annotations

import os
import random
import sys

import pyarrow as pa
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT]

from scenewright.llm import tokens  # noqa: E402
from scenewright.llm.queries import tokenizer_file  # noqa: E402


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memory_is_shared_and_bounded(monkeypatch, name):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "MEMORY", 40)
    monkeypatch.setattr(tokens, "SLICE_BYTES", 300)
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 4))) for _ in range(500)]
    texts = [None, ""] + [" ".join(rng.choices(words, k=rng.randint(1, 30))) + rng.choice(["", ".", "\n12 x", "!?"])
                          for _ in range(200)]
    encoder = tokens.encoder(tokenizer_file(name))
    assert tokens.encoder(tokenizer_file(name)) is encoder
    plain = Tokenizer.from_file(tokenizer_file(name))
    for _ in range(2):
        ids, ends = encoder.encode(pa.array(texts))
        for k, text in enumerate(texts):
            assert ids[ends[k] : ends[k + 1]].tolist() == plain.encode(text or "", add_special_tokens=False).ids
        assert max(map(len, (encoder.words, encoder.tails, encoder.others))) <= 40 + 200


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_piece_in_memory_is_a_few_bytes(name):
    rng = random.Random(6)
    words = sorted({"".join(rng.choices("abcdefghijklmnop", k=rng.randint(4, 9))) for _ in range(20_000)})
    encoder = tokens.Encoder(tokenizer_file(name))
    encoder.encode(pa.array([" ".join(words)]))
    held = encoder.words
    assert len(held) >= len(words) - 1
    assert held.names.nbytes + held.ids.nbytes + held.ends.nbytes <= 60 * len(held)


def test_packing_gives_free_memory_back():
    from scenewright.llm import arrays, packing

    given = []
    release, arrays.release = arrays.release, lambda: given.append(1)
    try:
        table = pa.table({"doc_id": [1, 2], "text": ["a b", None], "seed": [1, 1], "score": pa.array([2.0, 1.0], pa.float32()),
                          "part": pa.array([0, 0], pa.int32())})
        assert packing._pieces(table, tokenizer_file("word_bpe_49k.json"), 2048, 1).num_rows == 2
        assert sum(1 for _ in packing._blocks(iter(table.select(["doc_id", "text"]).to_batches()), 100)) == 2
    finally:
        arrays.release = release
    assert len(given) == 2
