"""Merkle manifest, histogram shards and hard negatives against plain versions and odd inputs."""

from __future__ import annotations

import hashlib
import math
import os
import random
import sys
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from scenewright.llm import merkle, negatives, shards  # noqa: E402
from scenewright.session import get_spark  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["g", "pos", "n", "digest", "top", "path", "chunk", "key", "size", "row", "shard", "slot", "_salt", "_id", "part", "block"]


@pytest.fixture(scope="module")
def spark():
    session = get_spark("llm-new-tests", "4")
    session.sparkContext.setLogLevel("ERROR")
    return session


def documents(seed=5, n=90):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = "".join(rng.choices("ab é\n", k=rng.randint(0, 60)))
        lang = rng.choice(["en", "en", "en", "de", None, "", "ü"])
        rows.append((i, text, lang, rng.choice(["web", None]), rng.choice([len(text), None])))
    rows += [(200 + i, "one text for all", "en", "hot", 16) for i in range(60)]
    rows += [rows[3], rows[3], rows[70]]  # repeated rows
    rows += [(None, "no id", "en", "web", 5), (None, None, None, None, None), (-7, "negative", "de", "web", 8),
             (500, None, "en", "web", 0), (501, "", "lone", "web", 0), (502, "long " * 40_000, "de", "web", 200_000)]
    rng.shuffle(rows)
    return rows


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, n_chars):
    doc_id, text, lang, source, _ = row
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha(*("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def plain_tree(leaves, fanout):
    """Root and per leaf the list of (before, after), level by level."""
    paths, level, owners = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        above, held = [], []
        for at in range(0, len(level), fanout):
            run = level[at : at + fanout]
            for j in range(len(run)):
                for leaf in owners[at + j]:
                    paths[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(sha(*run))
            held.append([x for o in owners[at : at + fanout] for x in o])
        level, owners = above, held
    return level[0], paths


def plain_manifest(rows, fanout=2):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    inside = {}
    for name in names:
        members = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r, r[4])))
        inside[name] = (members, *plain_tree([plain_leaf(r, r[4]) for r in members], fanout))
    root, above = plain_tree([inside[name][1] for name in names], fanout)
    out = []
    for name, way in zip(names, above):
        members, subroot, paths = inside[name]
        for row, path in zip(members, paths):
            path = path + way
            drawn = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            h = plain_leaf(row, row[4] if row[4] is None else row[4] + drawn)
            for before, after in path:
                h = sha(before, h, after)
            out.append((row[0], plain_leaf(row, row[4]), subroot, root, sha(*(b + a for b, a in path)), h, h == root))
    return sorted(out, key=str)


def run_manifest(df, **options):
    drawn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.when(drawn, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = merkle.manifest(df, changes={"tampered": {"n_chars": more}}, **options)
    folded = merkle.fold(F.col("tampered"), F.col("path"))
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("p"), folded.alias("f"))
    return sorted((tuple(r) + (r["f"] == r["root"],) for r in found.collect()), key=str)


@pytest.mark.parametrize("fanout,height", [(2, 8), (2, 2), (3, 2)])
def test_manifest_equals_plain_tree(spark, fanout, height):
    rows = documents()
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in CLASH})
    want = plain_manifest(rows, fanout)
    assert run_manifest(df, fanout=fanout, height=height) == want
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)


def test_manifest_of_few_rows(spark):
    for rows in ([], documents()[:1], [(1, "a", "x", "s", 1), (2, "b", "y", "s", 1)]):
        assert run_manifest(spark.createDataFrame(rows, DOCS)) == (plain_manifest(rows) if rows else [])


def placed(df, **options):
    return [(r["row"]["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in
            shards.shard_documents(df, carry=["doc_id"], **options).collect()]


def check_shards(rows, found, n_shards, tolerance):
    assert sorted(f[:3] for f in found if f[0] is not None) == sorted(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows if r[0] is not None)
    assert len(found) == len(rows)
    by = defaultdict(list)
    for f in found:
        by[f[3]].append(f)
    assert set(by) <= set(range(n_shards))
    for members in by.values():
        assert sorted(m[4] for m in members) == list(range(len(members)))
    # bytes before each limit: as near to the target as the rows on both sides allow
    ordered = sorted(found, key=lambda f: (f[3], f[4]))
    one = sum(f[1] for f in found) / n_shards
    for limit in range(1, n_shards):
        before = [f for f in ordered if f[3] < limit]
        off = sum(f[1] for f in before) - one * limit
        beside = [f[1] for f in (before[-1:] + ordered[len(before) : len(before) + 1])]
        assert abs(off) <= max([one * tolerance, *(size / 2 for size in beside)])
    # equal texts lie side by side
    texts = [f[2] for f in ordered]
    assert sum(a != b for a, b in zip(texts, texts[1:])) + 1 == len(set(texts))


@pytest.mark.parametrize("n_shards", [1, 3, 8])
def test_shards_are_whole_gapless_and_near_equal(spark, n_shards):
    rows = documents()
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in CLASH})
    check_shards(rows, placed(df, shards=n_shards), n_shards, shards.TOLERANCE)


def test_shards_of_many_rows_meet_the_tolerance_and_keep_groups(spark):
    rng = random.Random(2)
    rows = [(i, f"{rng.random()}" * rng.randint(1, 6), "en", "s", 1) for i in range(6000)]
    rows += [(10_000 + i, f"copy {i % 300}", "en", "s", 1) for i in range(1500)]
    rows += [(20_000 + i, "a third of all rows " * 3, "en", "s", 1) for i in range(2500)]
    found = placed(spark.createDataFrame(rows, DOCS).repartition(7), shards=8, range_bytes=20_000)
    check_shards(rows, found, 8, shards.TOLERANCE)
    size = defaultdict(int)
    for f in found:
        size[f[3]] += f[1]
    assert max(size.values()) <= (1 + 2 * shards.TOLERANCE) * sum(size.values()) / 8
    copies = defaultdict(set)
    for f in found:
        if f[0] is not None and 10_000 <= f[0] < 20_000:
            copies[f[2]].add(f[3])
    assert all(len(s) == 1 for s in copies.values())


def test_shards_of_equal_rows_and_of_none(spark):
    rows = [(1, "same", "en", "s", 1)] * 400
    found = placed(spark.createDataFrame(rows, DOCS), shards=8)
    assert sorted(f[3] for f in found) == sorted(s for s in range(8) for _ in range(50))
    assert placed(spark.createDataFrame([], DOCS), shards=8) == []


def test_written_shards_hold_whole_rows(spark, tmp_path):
    rows = documents(n=40)
    shards.write_shards(spark.createDataFrame(rows, DOCS), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, (tuple(r["row"]) for r in back.collect()))) == sorted(map(str, rows))


def plain_negatives(rows, n_anchor=50, n_pos=5, n_neg=3):
    clean = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        new = (label, [math.floor(256 * x) for x in vector])
        clean[vec_id] = min(clean.get(vec_id, new), new)
    clean = {i: ((label + 1) % 10 if i % 7 == 0 else label, v) for i, (label, v) in clean.items()}
    out = []
    for a, (label, v) in clean.items():
        if a % n_anchor:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in clean.items() if i != a}
        ranked = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in ranked if clean[i][0] == label][:n_pos]:
            hard = [i for i in ranked if clean[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(hard[:n_neg])]
    return sorted(out)


def run_negatives(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("x") for c in CLASH})
    found = negatives.quantised(df)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    return sorted(map(tuple, negatives.hard_negatives(found.withColumn("label", moved), "vec_id % 50 = 0", **options).collect()))


def vectors(seed, n, dims, scale=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, scale) for _ in range(dims)] for _ in range(6)]
    hot = [round(rng.gauss(0, scale), 3) for _ in range(dims)]
    rows = []
    for i in range(n):
        centre = rng.choice(centres)
        vector = hot if i % 3 == 0 else [c + rng.gauss(0, scale) for c in centre]
        rows.append((i, vector, 1 if i % 3 == 0 and i % 2 else rng.randrange(10)))
    return rows


@pytest.mark.parametrize("dims,scale", [(8, 0.3), (3, 1.0), (16, 3000.0), (4, 1e6)])
def test_negatives_equal_brute_force(spark, dims, scale):
    rows = vectors(dims, 700, dims, scale)
    rows += [(1000, None, 3), (1001, [None] * dims, 3), (1002, [float("nan")] * dims, 2), (1003, [float("-inf")] * dims, 2),
             (None, [0.5] * dims, 1), (1004, [0.5] * dims, None), (1050, [0.0] * dims, 4), (1100, [], 4), (1005, [0.5], 4),
             rows[50], rows[50], (rows[51][0], [9.0] * dims, 9), (-50, [0.25] * dims, 1)]
    want = plain_negatives(rows)
    assert len(want) > 100
    assert run_negatives(spark, rows, block_rows=150, part_rows=6) == want
    assert run_negatives(spark, rows) == want


def test_negatives_with_ties_everywhere(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.75, 0.0], i % 4) for i in range(400)]
    assert run_negatives(spark, rows, block_rows=60) == plain_negatives(rows)


def test_negatives_of_few_rows(spark):
    for rows in ([], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 2)]):
        assert run_negatives(spark, rows) == plain_negatives(rows)


def test_reading_stops_early_on_separated_vectors():
    """The threshold does its work: few entries are read when some components dominate."""
    import numpy as np

    rng = np.random.default_rng(1)
    vectors_ = (rng.pareto(1.0, (20_000, 3)) * 100).astype(np.int64)
    block = negatives.Block(np.arange(20_000), np.zeros(20_000, np.int64), vectors_)
    block.prepare(np.float64)
    entry, score = block.best(np.array([3, 2, 1]), [(-np.inf, np.inf)], 5, np.ones(len(block.labels), bool))
    assert len(entry) < 5_000
    best = np.sort(vectors_ @ np.array([3, 2, 1]))[::-1][:5]
    assert score[:5].tolist() == best.tolist()
