"""Operators against plain versions, round trips, held-out accuracy and odd inputs."""

from __future__ import annotations

import os
import random
import re
import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from scenewright.llm import (arrays, debruijn, idcoder, language, lines, minhash, packing, pii, rules,  # noqa: E402
                             suffixes, winnow)
from scenewright.llm.queries import tokenizer_file  # noqa: E402
from scenewright.session import get_spark  # noqa: E402

# every name that an operator uses inside, as a column of the input
CLASH = ["words", "bucket", "kind", "blob", "paths", "node", "band", "item_id", "fp", "at", "n_words", "kept", "score",
         "_statistics", "w", "l", "shard", "entity", "value", "replacement", "y", "held_out", "counts", "part"]


@pytest.fixture(scope="module")
def spark():
    session = get_spark("llm-tests", "4")
    session.sparkContext.setLogLevel("ERROR")
    return session


def frame(spark, docs, clash=False):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in CLASH}) if clash else df


def corpus(seed=3, n=60):
    """Random words with copies, near copies, passages, periodic and odd texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(400)]
    text = lambda k: " ".join(rng.choices(vocabulary, k=k))
    passage, base = text(45), text(120).split()
    docs = [(i, text(rng.randint(1, 150))) for i in range(n)]
    docs += [(200 + i, text(15) + " " + passage + "\n" + text(rng.randint(0, 20))) for i in range(12)]
    for i in range(25):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        docs.append((300 + i, " ".join(words)))
    docs += [(400 + i, docs[3][1]) for i in range(5)]
    docs += [(500, None), (501, ""), (502, " \t\n "), (503, "a" * 900), (504, "ab " * 400), (505, text(9000)),
             (506, "x\u0085y   z"), (507, passage), (508, passage + " " + passage), (509, "one two")]
    docs += [docs[5], docs[5]]  # repeated rows
    rng.shuffle(docs)
    return docs


def rows(df, columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("width,chunk", [(20, None), (6, 500)])
def test_substring_dedup(spark, monkeypatch, width, chunk):
    if chunk:
        monkeypatch.setattr(debruijn, "CHUNK_WORDS", chunk)
        monkeypatch.setattr(arrays, "SLICE_BYTES", 3000)
    docs = corpus()
    got = debruijn.dedup_substrings(frame(spark, [*docs, (None, "a b")], True), width, 5).cache()
    assert rows(got, ["doc_id", "n_words", "n_removed", "kept_sha256"]) == brute.substring_dedup(docs, width)
    assert got.where("n_removed > 0 and n_paths = 0").count() == 0


def test_near_dedup(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    docs = corpus()
    for k, percent in ((3, 85), (5, 80)):
        got = minhash.near_duplicates(frame(spark, docs, True), k, percent)
        assert rows(got, ["doc_id", "n_shingles", "component_id", "kept"]) == brute.near_dedup(docs, k, percent)


def test_b_bit_estimate_is_close():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    sets = [np.unique(pool[:1000]), np.unique(pool[100:1100])]
    planes, _ = minhash.signatures(sets)
    differ = sum(int(np.bitwise_count(np.bitwise_or.reduce(
        [planes[0, b * 2 + w].astype(np.uint64) ^ planes[1, b * 2 + w].astype(np.uint64) for b in range(4)])))
        for w in range(2))
    found = ((minhash.HASHES - differ) / minhash.HASHES - 1 / 16) / (1 - 1 / 16)
    assert abs(found - 900 / 1100) < 0.12


@pytest.mark.parametrize("hot", [False, True])
def test_byte_dedup(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(suffixes, "HOT_IN_CHUNK", 2)
        monkeypatch.setattr(suffixes, "HOT_IN_ALL", 3)
        monkeypatch.setattr(suffixes, "CHUNK_BYTES", 4000)
        monkeypatch.setattr(arrays, "SLICE_BYTES", 2000)
    docs = corpus()
    once = list(dict.fromkeys(docs))
    for width, gram in ((200, 24), (40, 8)):
        got = suffixes.dedup_bytes(frame(spark, docs, True), width, gram)
        want = dict((r[0], r) for r in brute.byte_dedup(once, width))
        assert rows(got, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) == sorted(
            want[d] for d, _ in docs)


def test_blind_trie_sorts():
    rng = random.Random(5)
    strings = [b"a" * rng.randint(0, 30) + bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(200)]
    trie = suffixes.BlindTrie(strings)
    for i in range(len(strings)):
        trie.insert(i)
    walked = trie.walk()
    assert [strings[i] for i, _ in walked] == sorted(strings)
    for (a, _), (b, shared) in zip(walked, walked[1:]):
        assert len(os.path.commonprefix([strings[a], strings[b]])) == shared


def test_decontamination(spark):
    docs = list(dict.fromkeys(corpus()))
    words = docs[0][1] or "a b"
    long = next(t for _, t in docs if t and len(t.split()) > 100).split()
    items = [(1, " ".join(long[10:40])), (2, " ".join(long[50:57]).upper()), (3, long[3]), (4, None), (5, "..."),
             (6, "never seen anywhere at all in these texts here now"), (7, " ".join(long[10:40])), (10, words)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("fp", F.lit(1))
    got = winnow.contamination(frame(spark, docs, True), bench).withColumn(
        "sha", F.sha2(F.array_join("items", ","), 256))
    assert rows(got, ["doc_id", "n_words", "n_hit", "n_items", "sha", "contaminated"]) == brute.decontaminate(docs, items)
    none = winnow.contamination(frame(spark, docs), bench.limit(0))
    assert none.where("contaminated").count() == 0 and none.count() == len(docs)


def plain_ids(name, text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file(name))
    return t.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ODD = ["a  b", "a   b\n\n c", "\n x\n\ny  ", "don't it's we'll", "ÄÖ ü ß. É!! İ", "  lead", "tab\tsep \t x", "é äb",
       "nb sp   q", "<|endoftext|> a", "日本語 テスト", "''s 's s'", "end "]


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_BYTES", 20_000)
    docs = list(dict.fromkeys(corpus())) + [(900 + i, t) for i, t in enumerate(ODD)]
    got = packing.pack_documents(frame(spark, docs, True), tokenizer_file("word_bpe_49k.json"), 256).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d, t in docs:
        ids, at = plain_ids("word_bpe_49k.json", t, 1), 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    shards = {s >> 32 for s in sequences}
    assert sum(sum(r.length for r in f) < 256 for f in sequences.values()) <= len(shards)


def test_neighbours_are_best_by_bm25():
    import pyarrow as pa

    texts = ["red fox jumps", "blue whale sings", "red fox sleeps", "green tree"]
    index = packing.Index(pa.array(texts), 4, np.ones(1 << packing.TERM_BITS, np.float32), 3.0)
    assert index.neighbours(0).tolist()[:2] == [0, 2] and index.neighbours(3).tolist() == []


def test_token_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(idcoder, "PART_BYTES", 30_000)
    monkeypatch.setattr(idcoder, "SEGMENT_IDS", 3_000)
    docs = list(dict.fromkeys(corpus())) + [(900 + i, t) for i, t in enumerate(ODD)]
    idcoder.write_ids(frame(spark, docs, True), str(tmp_path / "ids"), tokenizer_file("byte_bpe_50k.json"))
    got = sorted(map(tuple, idcoder.read_ids(spark, str(tmp_path / "ids")).collect()))
    at = 0
    for (d, t), row in zip(sorted(docs, key=lambda r: r[0]), got, strict=True):
        ids = plain_ids("byte_bpe_50k.json", t, 2)
        assert row == (d, at, len(ids), crc(ids))
        at += len(ids)


def test_blocks_round_trip_and_damage():
    rng = np.random.default_rng(2)
    for ids in (np.array([7]), np.full(5000, 3), rng.integers(0, 65535, 4100), rng.zipf(1.3, 9000) % 50257):
        blobs, size = idcoder.encode_blocks(ids)
        assert np.array_equal(idcoder.decode_blocks(blobs, size), ids)
    data = bytearray(idcoder.write_segment(np.array([1]), np.array([len(ids)]), ids))
    data[-40] ^= 255
    with pytest.raises(ValueError):
        idcoder.read_segment(bytes(data))


def labelled(spark):
    rng = random.Random(4)
    docs, marks = [], []
    for i in range(400):
        clean = i % 3 > 0
        words = ["".join(rng.choices("aeilnorst", k=rng.randint(2, 8))) for _ in range(60)]
        docs.append((i, " ".join(words) + "." if clean else " | ".join(w.upper() + "!!" for w in words)))
        marks.append((i, int(clean)))
    docs += [(1000, None), (1001, "")]
    return docs, spark.createDataFrame([*marks, (None, 1), (5, None)], "doc_id long, quality int"), dict(marks)


def test_quality_rules_ensemble(spark):
    docs, labels, marks = labelled(spark)
    got = rules.score_quality(frame(spark, docs, True), labels).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in marks]
    assert sum(r.predicted == marks[r.doc_id] for r in held) >= 0.97 * len(held)
    none = rules.score_quality(frame(spark, docs[:3]), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_language(spark):
    rng = random.Random(6)
    sounds = {"xa": "ka ki ku ta", "xb": "sch ein und lich", "xc": "tion ment eau oi"}
    docs = [(i, " ".join(rng.choices(sounds[lang].split(), k=30)), lang) for i in range(300)
            for lang in [("xa", "xb", "xc")[i % 3]]]
    docs += [(900, None, "xa"), (901, "123 !!", "xa"), (902, "ka ki", None), (None, "ka", "xa")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("counts", F.lit(0))
    got = {r.doc_id: r for r in language.identify(df).collect()}
    assert len(got) == 303 and got[900].lang_pred == got[901].lang_pred == "und"
    assert all(got[d].lang_pred == lang and 0 <= got[d].score <= 1 for d, _, lang in docs[:300])
    assert {r.lang_pred for r in language.identify(df.limit(0).union(df.where("lang is null"))).collect()} == {"und"}


def base(text):
    w = brute.WORD.findall(text or "")
    count, cover = defaultdict(list), set()
    for i in range(len(w) - 7):
        count[tuple(w[i : i + 8])].append(i)
    for found in count.values():
        if len(found) > 1:
            cover.update(p for i in found for p in range(i, i + 8))
    solid = [x for x in (text or "").split("\n") if brute.WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(solid) - len(set(solid)),
            len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w))


def test_line_cleaning(spark):
    good = "This is a calm and ordinary sentence of ten words.\n" + "Another line follows with some more words in it, here."
    docs = corpus() + [(700, good), (701, "Home | News | About | More\nWork | Help | Imprint | Jobs\nA | B | C | D | E\n" + good[:40]),
                       (702, "\n".join(w.upper() + "!! " + w.upper() + "!!" for w in good.split())),
                       (703, "word " * 8 + good + " " + "word " * 8), (704, good + "\nAll rights reserved. Privacy policy.")]
    got = lines.clean_lines(frame(spark, docs, True)).select("doc_id", "text", "cleaning.*").collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(r.text)
    kept = {r.doc_id: r.kept for r in got}
    assert kept[700] and kept[704] and not kept[701] and not kept[702] and not kept[500]
    assert "rights" not in next(r.clean_text for r in got if r.doc_id == 704)


def test_surrogates(spark):
    docs = [(1, "Mail ann.lee@site.example.com or +1 (017) 555-7713, card 4111 1111 1111 1111."),
            (2, "Again ann.lee@site.example.com; other bob@site.example.com and 4111111111111111 from 10.0.0.1"),
            (3, 'token = "04dbebab91ab85687d33eeaaf9ac699e11889233"'), (4, "nothing here"), (5, None), (6, ""),
            (None, "null id bob@site.example.com"), (7, "Mrs Anna Smith wrote to Mr John Smith and 123-45-6789"),
            (8, "Господин Иван Петров"), (2, "Again ann.lee@site.example.com; other bob@site.example.com and "
                                            "4111111111111111 from 10.0.0.1")]
    df = frame(spark, docs, True)
    got = pii.replace_entities(df, "k", count="n_entities")
    assert got.columns == [*df.columns, "n_entities"]
    out = defaultdict(list)
    for r in got.collect():
        out[r.doc_id].append(r.text)
    assert sum(map(len, out.values())) == len(docs)
    assert out[4] == ["nothing here"] and out[5] == [None] and out[6] == [""] and out[2][0] == out[2][1]
    everything = " ".join(t for v in out.values() for t in v if t)
    for secret in ("ann.lee", "bob@", "555-7713", "4111", "10.0.0.1", "04dbebab", "Anna Smith", "John Smith",
                   "123-45-6789", "Петров"):
        assert secret not in everything
    mail = re.search(r"Mail (\S+) or", out[1][0])[1]
    assert mail in out[2][0] and mail.endswith(".com") and mail not in out[None][0]
    card = re.search(r"card ([\d ]+)\.", out[1][0])[1]
    assert card.replace(" ", "") in out[2][0]
    digits = [int(c) for c in reversed(card.replace(" ", ""))]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', out[3][0])
    woman, man = re.search(r"Mrs (\w+) \w+ wrote to Mr (\w+)", out[7][0]).groups()
    assert woman in pii.GIVEN["latin", "w"].split() and man in pii.GIVEN["latin", "m"].split()
    assert re.fullmatch("Господин [А-Я][а-я]+ [А-Я][а-я]+", out[8][0])


def test_surrogates_never_collide(spark):
    # three-digit users of one letter each: few surrogates, so many first draws collide
    docs = [(i, f"x {c}@q.com") for i, c in enumerate("abcdefghij")]
    got = [r.text.split()[1] for r in pii.replace_entities(frame(spark, docs)).collect()]
    assert len(set(got)) == 10 and not set(got) & {t.split()[1] for _, t in docs}


def test_empty_tables(spark):
    none = frame(spark, [(1, "a")]).limit(0)
    assert debruijn.dedup_substrings(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert suffixes.dedup_bytes(none).count() == 0
    assert packing.pack_documents(none, tokenizer_file("word_bpe_49k.json")).count() == 0
    assert idcoder.round_trip(none, tokenizer_file("byte_bpe_50k.json")).count() == 0
    assert lines.clean_lines(none).count() == 0 and pii.replace_entities(none).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghi", k=rng.randint(2, 7))) for _ in range(900)]
    sentence = lambda: " ".join(rng.choices(vocabulary, k=12)).capitalize() + "."
    body = lambda n: "\n".join(sentence() for _ in range(n))
    clean = [(i, body(rng.randint(4, 9))) for i in range(40)]
    near = [(100 + i, clean[i][1] + " extra") for i in range(8)]
    leak = body(2)
    docs = clean + near + [(200, body(4) + "\n" + leak), (201, None), (202, "too short"),
                           (203, body(4) + "\nWrite to eve@mail.example.com please."),
                           (204, "\n".join("MENU!! | NEWS!! | " + str(i) for i in range(30))), (None, body(5))]
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs],
                          "doc_id long, text string, lang string, source string, n_chars long"
                          ).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = now.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"out{i}"))
        now = spark.read.parquet(str(tmp_path / f"out{i}"))
        seen[name] = now
        assert name == "pack" or now.columns == columns
    ids = lambda name: {r.doc_id for r in seen[name].select("doc_id").collect()}
    everyone = {d for d, _ in docs}
    assert ids("quality_rules") == everyone - {201, 202, 204}
    assert ids("near_dedup") == ids("quality_rules") - {100 + i for i in range(8)}
    assert ids("decontaminate") == ids("near_dedup") - {200}
    texts = {r.doc_id: r.text for r in seen["replace_pii"].collect()}
    assert "eve@" not in texts[203] and texts[0] == clean[0][1] and None in texts
    want = sum(len(plain_ids("word_bpe_49k.json", t, 1)) for d, t in texts.items() if d is not None)
    assert seen["pack"].agg(F.sum("length")).first()[0] == want
