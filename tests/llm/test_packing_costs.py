"""Packing: what is looked up by tables and hashes gives the same scores, order and ids as plain lookups."""

from __future__ import annotations

import os
import random
import sys

import numpy as np
import pyarrow as pa
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT]

from scenewright.llm import arrays, packing, tokens  # noqa: E402
from scenewright.llm.queries import tokenizer_file  # noqa: E402


@pytest.mark.parametrize("dense", [0.0, 1 / 16, 1.0])
def test_postings_of_one_width_score_like_a_plain_sum(monkeypatch, dense):
    monkeypatch.setattr(packing, "DENSE", dense)
    rng = np.random.default_rng(3)
    n = 90
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.3, 40) if i < 500) for _ in range(n)]
    weight, mean = rng.random(1 << packing.TERM_BITS).astype(np.float32) * 9, 30.0
    length, terms, counts, doc, tf = packing.postings(pa.array(texts), n)
    part = np.rint(np.repeat(packing.GRAIN * weight[terms], counts) * (
        tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * length[doc] / mean))))
    index = packing.Index.of(n, weight, mean, length, terms, counts, doc, tf)
    assert len(np.unique(counts)) > 8 and len(index.matrix) + sum(len(d) for d, _ in index.lists.values()) == len(terms)
    assert all(d.shape[1] in packing.WIDTHS for d, _ in index.lists.values())
    asked = [np.sort(rng.choice(terms, size, replace=False)) for size in (0, 1, 25, len(terms))]
    asked.append(np.setdiff1d(np.arange(200), terms)[:3])  # terms of no document
    first = np.concatenate([[0], np.cumsum([len(a) for a in asked])])
    want = np.zeros((len(asked), n))
    for q, mine in enumerate(asked):
        hit = np.isin(np.repeat(terms, counts), mine)
        np.add.at(want[q], doc[hit], part[hit])
    assert (index.scores(first, np.concatenate(asked)) == want).all()


def test_only_rows_of_one_document_are_put_in_order_by_their_texts():
    table = pa.table({"doc_id": [5, 3, 5, 9, 3, 7], "text": ["b", None, "a", "long" * 50, "", "x"]})
    rank = packing._rank(table).tolist()
    assert rank[3] == rank[5] == 0 and rank[0] != rank[2] and rank[1] == rank[4]
    assert not packing._rank(table.slice(3, 1)).any() and len(packing._rank(table.slice(0, 0))) == 0


def test_pieces_whose_hashes_meet_keep_their_own_ids(monkeypatch):
    from tokenizers import Tokenizer

    hashes = tokens.hashes
    monkeypatch.setattr(tokens, "hashes", lambda names: hashes(names) % np.uint64(50))
    monkeypatch.setattr(tokens, "SLICE_BYTES", 2000)
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 5))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=40)) + rng.choice(["", ".", " 12", "!?"]) for _ in range(60)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        plain, encoder = Tokenizer.from_file(tokenizer_file(name)), tokens.Encoder(tokenizer_file(name))
        ids, ends = encoder.encode(pa.array(texts))
        for k, text in enumerate(texts):
            assert ids[ends[k] : ends[k + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_kept_powers_are_those_of_a_longer_run():
    few, many = arrays.powers(arrays.BASE, 1000), arrays.powers(arrays.BASE, arrays.POWERS + 5)
    assert (few == many[:1000]).all() and arrays.powers(arrays.BASE, 7).base is few.base
    assert arrays.powers(arrays.INVERSE, 3).tolist()[:2] == [1, int(arrays.INVERSE)] and not few.flags.writeable
