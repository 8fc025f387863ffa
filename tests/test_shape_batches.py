"""Captions and phrase cells of whole batches say what the column expressions say, in bounded time."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scenewright.functions import grid as G
from scenewright.games import LADDER
from scenewright.games import PLATFORMER as P
from scenewright.operators import captioner as C
from scenewright.operators import ladder_captioner as LC
from scenewright.operators import shapes


def scenes(n, height=16, width=16, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        tiles = ["--" * 8 + "X", "---XS<>[]", "--oooXXBbE?Q", "-X", P.alphabet][i % 5]
        rows = ["".join(rng.choice(tiles) for _ in range(width)) for _ in range(height)]
        for r in rng.sample(range(height), 3):
            if rng.random() < 0.5:
                rows[r] = "".join(rng.choice("XXXXXXXXX-") for _ in range(width))
        if rng.random() < 0.3:
            rows[height - 2] = rows[height - 1]
        if rng.random() < 0.4:  # steps
            c, r = rng.randrange(width - 5), rng.randrange(2, height)
            for j in range(5):
                for k in range(max(0, r - j), height):
                    rows[k] = rows[k][: c + j] + "X" + rows[k][c + j + 1 :]
        if rng.random() < 0.4:  # a pipe
            c, r = rng.randrange(-1, width), rng.randrange(height - 1)
            for k in range(r, height):
                for j, ch in enumerate("<>" if k == r else "[]"):
                    if 0 <= c + j < width:
                        rows[k] = rows[k][: c + j] + ch + rows[k][c + j + 1 :]
            if rng.random() < 0.4:
                rows = [x.translate(str.maketrans("", "")) for x in rows[::-1]]
        out.append(rows)
    return out


def frame(spark, found):
    return spark.createDataFrame(list(enumerate(found)), "scene_id bigint, rows array<string>")


@pytest.mark.parametrize("absence", [False, True])
def test_captions_of_batches(spark, absence):
    df = frame(spark, scenes(600) + scenes(40, 11, 9) + scenes(40, 20, 30) + scenes(1))
    want = {r["scene_id"]: r["caption"] for r in C._placed_caption(df, absence, None, P, True).collect()}
    got = {r["scene_id"]: r["caption"] for r in C.platformer_caption(df, absence).collect()}
    assert got == want
    assert len(set(want.values())) > 500


def test_phrase_cells_of_batches(spark):
    df = frame(spark, scenes(300) + scenes(20, 11, 9))
    shaped = C.with_shapes(df)
    masks = {"floor": "floor_bits", "ceiling": "ceiling_bits", "coin line": "coin_run_bits", "platform": "platform_bits",
             "ascending staircase": "up_bits", "descending staircase": "down_bits"}
    loose = G.minus_rows(G.minus_rows(F.col("loose_bits"), F.col("claimed_bits")), F.col("block_bits"))
    want = {(r["scene_id"], t, r["row"], c) for r in shaped.select("scene_id", F.posexplode(F.arrays_zip(
        *[F.col(b).alias(t) for t, b in masks.items()], loose.alias("loose block"))).alias("row", "x")).collect()
        for t in [*masks, "loose block"] for c in range(30) if r["x"][t] >> c & 1}
    cells = C.phrase_cells(df)
    got = [tuple(r) for r in cells.collect()]
    assert len(got) == len(set(got))
    told = {*masks, "loose block"}
    assert {x for x in got if x[1] in told} == want
    boxes = shaped.select("scene_id", F.explode(F.concat(*[F.zip_with(boxes, kinds, lambda b, k: F.struct(
        k.alias("kind"), b["cells"].alias("n"))) for boxes, kinds in (("pipes", "pipe_kinds"), ("blocks", "block_kinds"))])
    ).alias("x")).groupBy("scene_id", "x.kind").agg(F.sum("x.n").alias("n"))
    sums = {}
    for scene, topic, _, _ in got:
        if topic in shapes.PIPE_KINDS + shapes.BLOCK_KINDS:
            sums[scene, topic] = sums.get((scene, topic), 0) + 1
    assert sums == {(r["scene_id"], r["kind"]): r["n"] for r in boxes.collect()}
    for topic, chars in (("enemy", "E"), ("question block", "Q?"), ("cannon", "B"), ("coin", "o")):
        assert {x[0::2] + x[3:] for x in got if x[1] == topic} == {
            (r["scene_id"], i, c) for r in df.collect() for i, row in enumerate(r["rows"])
            for c, ch in enumerate(row) if ch in chars}


def test_plans_hold_no_array_expressions(spark):
    """One function call a scene instead of hundreds of interpreted expressions, and scenes are read once."""
    df = frame(spark, scenes(5))
    plan = C.platformer_caption(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and plan.count("ArrowEvalPython") == 1
    plan = C.phrase_cells(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan


def test_slices_of_batches():
    rows = pa.array(scenes(50) + scenes(7, 11, 9) + scenes(50, seed=6), pa.list_(pa.string()))
    whole = shapes.captions(rows, P, True, True).to_pylist()
    assert shapes.captions(rows.slice(13, 60), P, True, True).to_pylist() == whole[13:73]
    assert shapes.captions(rows.slice(0, 0), P, True, True).to_pylist() == []
    shapes_seen = []
    shapes.by_shape(rows.slice(40, 20), lambda at, codes: shapes_seen.append((codes.shape[1:], len(at))))
    assert sorted(shapes_seen) == [((11, 9), 7), ((16, 16), 13)] and np.sum([n for _, n in shapes_seen]) == 20
    with pytest.raises(ValueError, match="ASCII"):
        shapes.captions(pa.array([["ü" * 8] * 16]), P, False, True)


@pytest.mark.parametrize("absence", [False, True])
def test_ladder_captions_of_batches(spark, absence):
    rng = random.Random(8)
    made = []
    for i in range(160):
        height, width = (32, 32) if i % 4 else (24 + i % 12, 18)
        tiles = ["." * 12 + "B", "BBb.", "...##", ".G-E", LADDER.alphabet][i % 5]
        rows = [[rng.choice(tiles) for _ in range(width)] for _ in range(height)]
        for _ in range(6):  # boxes, also empty ones with walls, and ladders
            r, c, h, w = rng.randrange(height), rng.randrange(width), rng.randrange(1, 12), rng.randrange(1, 9)
            wall = rng.choice("BBb#.-G")
            fill = rng.choice([wall, "."])
            for y in range(r, min(height, r + h)):
                for x in range(c, min(width, c + w)):
                    rows[y][x] = wall if y in (r, r + h - 1) or x in (c, c + w - 1) else fill
        made.append(["".join(r) for r in rows])
    df = frame(spark, made)
    want = {r["scene_id"]: r["caption"] for r in LC._placed_caption(df, absence, None, LADDER).collect()}
    found = LC.ladder_caption(df, absence)
    assert {r["scene_id"]: r["caption"] for r in found.collect()} == want
    assert len(set(want.values())) > 100 and any("chamber" in x for x in want.values())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and plan.count("ArrowEvalPython") == 1
