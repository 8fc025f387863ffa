"""Token ids of whole texts with a public tokenizer file, for Arrow batches inside tasks.

A text is cut at single spaces, where neither tokenizer ever joins anything, and
each distinct piece is encoded once per worker by the ``tokenizers`` library. A
word with a tail of punctuation is two pre-tokens for both, so the two are
looked up apart. Texts with a space after other white space, where a run of
white space may be one token, and texts that hold an added token of the file
(a literal end marker) are encoded as they are.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from scenewright.llm import arrays as A

SLICE_BYTES = 6 << 20
#: Words, and other pieces, kept in memory, some 50 bytes each; beyond it only those of the present slice stay.
MEMORY = 1_000_000
ID = np.dtype("<i4")
RUN = r"[\s\v\x1c-\x1f\x{85}\p{Z}] "
WORD_AND_TAIL = r"^(?P<word> ?[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[.,!?;:|&#$%*()]*)$"


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a file and worker: tasks that follow each other there share its memory."""
    return Encoder(path)


def hashes(names: pa.Array) -> np.ndarray:
    """64 bits of each name."""
    parts = [A.word_hashes(data, ends[:-1], ends[1:]) for _, _, data, ends in A.slices(names, A.POWERS // 2)]
    return np.concatenate([np.zeros(0, np.uint64), *parts])


class Known:
    """Distinct pieces and their ids in Arrow and numpy arrays, a few buffers for all pieces instead of objects for each.

    Pieces are found by their hashes, which are kept sorted, and then compared: one that meets another piece's hash is new.
    """

    def __init__(self):
        self.names, self.ids, self.ends = pa.array([], pa.string()), np.zeros(0, ID), np.zeros(1, np.int64)
        self._empty()

    def _empty(self) -> None:
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def _keep(self, key: np.ndarray, place: np.ndarray) -> None:
        order = np.argsort(key)
        at = np.searchsorted(self.keys, key[order])
        self.keys, self.places = np.insert(self.keys, at, key[order]), np.insert(self.places, at, place[order])

    def _at(self, names: pa.Array, key: np.ndarray) -> np.ndarray:
        """The number of each name, -1 for new ones."""
        at = np.full(len(names), -1, np.int64)
        if len(self.keys):
            order = np.argsort(key)
            near = np.searchsorted(self.keys, key[order])
            near[near == len(self.keys)] = 0
            hit = np.flatnonzero(self.keys[near] == key[order])
            row, place = order[hit], self.places[near[hit]].astype(np.int64)
            same = pc.equal(self.names.take(pa.array(place)), names.take(pa.array(row))).to_numpy(zero_copy_only=False)
            at[row[same]] = place[same]
        return at

    def __len__(self) -> int:
        return len(self.names)

    def find(self, names: pa.Array, encode) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each distinct name start and how many they are; new names are encoded and kept."""
        key = hashes(names)
        at = self._at(names, key)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = names.take(pa.array(new))
            ids, size = encode(fresh.to_pylist())
            if len(self) + len(new) > MEMORY:
                old = np.flatnonzero(at >= 0)
                here = at[old]
                held = np.diff(self.ends)[here]
                self.names = self.names.take(pa.array(here))
                self.ids = self.ids[A.ranges(self.ends[here], held)]
                self.ends = np.concatenate([[0], np.cumsum(held)])
                at[old] = np.arange(len(old))
                self._empty()
                self._keep(key[old], at[old])
            at[new] = len(self) + np.arange(len(new))
            self._keep(key[new], at[new])
            self.names = pa.concat_arrays([self.names, fresh])
            self.ids = np.concatenate([self.ids, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(size)])
        return self.ends[at], self.ends[at + 1] - self.ends[at]


class Encoder:
    """Encodes with one tokenizer file; remembers pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        # a text that holds an added token, in any case the file may fold, is encoded whole
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([RUN, *(f"(?i:{re.escape(t)})" for t in added)])
        size = max(vocab.values()) + 1
        self.word_ends = any(t.endswith("</w>") for t in vocab)  # lower case, white space dropped
        self.edge = np.zeros(size, bool)  # last id of a word, or first id after a space
        for token, i in vocab.items():
            self.edge[i] = token.endswith("</w>") if self.word_ends else token.startswith("Ġ")
        self.words, self.tails = Known(), Known()
        self.others = Known()  # pieces that are not a word and its tail

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        lists = self._encode(texts)
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), ID, int(size.sum())), size

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for plain words; a hundred at a time are one text, cut where words begin or end."""
        glue = " " if self.word_ends else ""
        ids, _ = self._apart([glue.join(words[i : i + 100]) for i in range(0, len(words), 100)])
        cut = np.flatnonzero(self.edge[ids])
        return ids, np.diff(cut + 1, prepend=0) if self.word_ends else np.diff(cut, append=len(ids))

    def _look_up(self, values: pa.Array, held: Known, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in memory, and where those of each value start and how many they are."""
        coded = values.dictionary_encode()
        start, size = held.find(coded.dictionary, encode)
        code = coded.indices.to_numpy()
        return held.ids, start[code], size[code]

    def _pieces(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for distinct pieces, whose words and tails are looked up apart."""
        parts = pc.extract_regex(names, WORD_AND_TAIL)
        plain = pc.is_valid(parts)
        if not self.word_ends:
            plain = pc.and_(plain, pc.starts_with(names, " "))
        parts = parts.filter(plain)
        word, tail = pc.struct_field(parts, "word"), pc.struct_field(parts, "tail")
        if self.word_ends:
            word = pc.utf8_lower(word)
        plain = np.asarray(plain.to_numpy(zero_copy_only=False), bool)
        start, size, flat, base = np.zeros((len(names), 2), np.int64), np.zeros((len(names), 2), np.int64), [], 0
        for rows, column, values, held, encode in (
                (plain, 0, word, self.words, self._words), (plain, 1, tail, self.tails, self._apart),
                (~plain, 0, names.filter(pa.array(~plain)), self.others, self._apart)):
            ids, first, n = self._look_up(values, held, encode)
            start[rows, column], size[rows, column] = first + base, n
            flat.append(ids)
            base += len(ids)
        ids = np.concatenate(flat)[A.ranges(start.ravel(), size.ravel())]
        total = size.sum(axis=1)
        return ids, np.cumsum(total) - total, total

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        whole = np.asarray(pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False), bool)
        if self.word_ends:
            texts = pc.replace_substring(texts, "\n", " ")
        pieces = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        counts = np.diff(pieces.offsets.to_numpy()).astype(np.int64)
        coded = pieces.flatten().dictionary_encode()
        names = coded.dictionary
        code = coded.indices.to_numpy().astype(np.int64)
        if not self.word_ends:  # all but the first piece of a text begin with their space
            first = np.zeros(len(code), bool)
            first[np.cumsum(counts) - counts] = True
            n = len(names)
            names = pa.concat_arrays([pc.binary_join_element_wise("", names, " "), names])
            code = code + n * first
            used = np.zeros(2 * n, bool)
            used[code] = True
            names, code = names.filter(pa.array(used)), (np.cumsum(used) - 1)[code]
        flat, start, size = self._pieces(names)
        lengths = size[code]
        ids = flat[A.ranges(start[code], lengths)]
        total = np.zeros(len(code) + 1, np.int64)
        np.cumsum(lengths, out=total[1:])
        at = np.concatenate([[0], np.cumsum(counts)])
        ends = total[at]
        if whole.any():
            rows = np.flatnonzero(whole)
            own = self._encode(texts.take(pa.array(rows)).to_pylist())
            parts = np.split(ids, ends[1:-1])
            for row, got in zip(rows.tolist(), own):
                parts[row] = np.array(got, np.int32)
            ids = np.concatenate(parts)
            ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, ends

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids and n + 1 offsets; null is an empty text."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        parts, ends, total = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
        for a, b, _, _ in A.slices(texts, SLICE_BYTES):
            ids, cut = self._slice(texts.slice(a, b - a))
            parts.append(ids)
            ends.append(cut[1:] + total)
            total += len(ids)
        return np.concatenate(parts), np.concatenate(ends)


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts, each followed by ``end_id``."""
    return (np.insert(ids, ends[1:], end_id).astype(np.int32), ends + np.arange(len(ends)))
