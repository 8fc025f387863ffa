"""Hand-made scenes and brute force over small fixtures."""

import random

from pyspark.sql import functions as F

from scenewright.functions import grid as G
from scenewright.functions import scenes as S
from scenewright.games import DIRECTIONAL, LADDER, PLATFORMER
from scenewright.operators.captioner import phrase_cells, platformer_caption
from scenewright.operators.components import component_labels
from scenewright.operators.directional_captioner import directional_caption
from scenewright.operators.ladder_captioner import ladder_caption
from scenewright.operators.windows import flip_scene, sliding_windows

EMPTY = ["-" * 16] * 15 + ["X" * 16]


def scene(changes):
    rows = [list(r) for r in EMPTY]
    for r, c, text in changes:
        rows[r][c:c + len(text)] = list(text)
    return ["".join(r) for r in rows]


def captions(spark, scenes, **options):
    df = spark.createDataFrame([(i, rows) for i, rows in enumerate(scenes)],
                               "scene_id bigint, rows array<string>")
    out = platformer_caption(df, **options).select("scene_id", "caption").collect()
    return [text for _, text in sorted(out)]


def test_platformer_by_hand(spark):
    cases = [
        (scene([]), "full floor."),
        (scene([(15, 3, "-")]), "floor with one gap."),
        (scene([(15, 3, "-"), (15, 6, "E")]), "floor with two gaps. one enemy."),
        (scene([(15, 0, "-" * 12)]), "giant gap with one chunk of floor."),
        (scene([(15, 0, "-" * 15 + "E")]), "giant gap with no chunks of floor. one enemy."),
        (scene([(15, 0, "-" * 16)]), ""),
        (scene([(14, 0, "X" * 16)]), "full floor."),
        (scene([(4, 0, "X" * 16)]), "full floor. full ceiling."),
        (scene([(3, 0, "X" * 16), (4, 0, "X" * 15)]), "full floor. full ceiling. one rectangular block cluster."),
        (scene([(1, 0, "X" * 16), (0, 0, "X" * 16)]), "full floor. full ceiling."),
        (scene([(8, 4, "oo"), (9, 9, "o")]), "full floor. a few coins. one coin line."),
        (scene([(8, 4, "XX")]), "full floor. one platform."),
        (scene([(8, 4, "X")]), "full floor. one loose block."),
        (scene([(12, 2, "<>"), (13, 2, "[]"), (14, 2, "[]")]), "full floor. one pipe."),
        (scene([(13, 0, ">"), (14, 0, "]")]), "full floor. one pipe."),
        (scene([(13, 15, "<"), (14, 15, "[")]), "full floor. one pipe."),
        (scene([(0, 6, "[]"), (1, 6, "[]"), (2, 6, "<>")]), "full floor. one upside down pipe."),
        (scene([(13, 6, "[]"), (14, 6, "[]")]), "full floor. one broken pipe."),
        (scene([(13, 2, "<><>"), (14, 2, "[][]")]), "full floor. two pipes."),
        (scene([(12, 5, "X"), (13, 5, "X"), (14, 5, "X")]), "full floor. one tower."),
        (scene([(6, 5, "XX"), (7, 5, "XX")]), "full floor. one rectangular block cluster."),
        (scene([(6, 5, "XXX"), (7, 5, "X")]), "full floor. one platform. two loose blocks."),
        (scene([(6, 5, "XXX"), (7, 5, "XX"), (8, 5, "XXX")]),
         "full floor. one irregular block cluster."),
        (scene([(13, 5, "B"), (14, 5, "b")]), "full floor. one cannon."),
        (scene([(14, 5, "b")]), "full floor. one broken cannon."),
        (scene([(14, 2, "X"), (13, 3, "X"), (14, 3, "X"), (12, 4, "X"), (13, 4, "X"), (14, 4, "X")]),
         "full floor. one ascending staircase."),
        (scene([(12, 2, "X"), (13, 2, "X"), (14, 2, "X"), (13, 3, "X"), (14, 3, "X"), (14, 4, "X")]),
         "full floor. one descending staircase."),
    ]
    got = captions(spark, [rows for rows, _ in cases])
    assert [(i, g, w) for i, (g, (_, w)) in enumerate(zip(got, cases)) if g != w] == []


def test_absence_and_places(spark):
    told = captions(spark, [scene([(8, 4, "oo")])], absence=True, where="coarse")[0]
    assert told.startswith("full floor. no ceiling. no enemies. no question blocks. no cannons. two coins.")
    assert "one coin line at left middle." in told
    assert "no upside down pipes." in told
    assert "upside down" not in captions(spark, [scene([])], absence=True, upside_down=False)[0]


def test_provenance_covers_floor(spark):
    df = spark.createDataFrame([(1, scene([(12, 2, "<>"), (13, 2, "[]"), (14, 2, "[]")]))],
                               "scene_id bigint, rows array<string>")
    cells = phrase_cells(df).groupBy("topic").count().collect()
    assert {r["topic"]: r["count"] for r in cells} == {"floor": 16, "pipe": 6}


def flood(cells, blocked=lambda a, b: False):
    """Components as sets, by plain search from row-major seeds."""
    left, out = set(cells), []
    for seed in sorted(cells):
        if seed not in left:
            continue
        group, edge = set(), {seed}
        while edge:
            group |= edge
            left -= edge
            edge = {(r + dr, c + dc) for r, c in edge for dr, dc in ((1, 0), (-1, 0), (0, 1), (0, -1))
                    if (r + dr, c + dc) in left and not blocked((r, c), (dr, dc))}
        out.append(group)
    return out


def test_component_labels_match_search(spark):
    rng = random.Random(3)
    grids = ["".join(rng.choice("--X<>[]") for _ in range(64)) for _ in range(200)]
    df = spark.createDataFrame(
        [(i, [g[k:k + 8] for k in range(0, 64, 8)]) for i, g in enumerate(grids)],
        "id int, rows array<string>")
    bits = lambda chars: G.class_bits(F.col("rows"), PLATFORMER, chars)
    got = df.select("id", component_labels(bits("<>[]"), 8, bits(">]"), bits("<[")).alias("l")).collect()
    for row in got:
        g = grids[row["id"]]
        cells = [(k // 8, k % 8) for k in range(64) if g[k] in "<>[]"]
        def blocked(at, step, g=g):
            ch = g[at[0] * 8 + at[1]]
            return (ch in ">]" and step == (0, 1)) or (ch in "<[" and step == (0, -1))
        want = [None] * 64
        for group in flood(cells, blocked):
            for r, c in group:
                want[r * 8 + c] = min(a * 8 + b for a, b in group)
        assert row["l"] == want


def words(n):
    return ("no", "one", "two", "a few", "a few", "several", "several", "several", "several",
            "several")[n] if n < 10 else "many"


def say(n, one, many, always=False):
    return "" if n == 0 and not always else f" {words(n)} {one if n == 1 else many}."


def ladder_by_search(rows):
    """Ladder caption from cell sets; written for the test only."""
    at = {(r, c): ch for r, line in enumerate(rows) for c, ch in enumerate(line)}
    pick = lambda chars: {k for k, ch in at.items() if ch in chars}
    last = rows[31]
    solid = sum(ch in "Bb" for ch in last)
    clear = sum(ch in ".-#GM" for ch in last)
    runs = lambda flags: sum(f and not (i and flags[i - 1]) for i, f in enumerate(flags))
    gaps, chunks = runs([ch not in "Bb" for ch in last]), runs([ch in "Bb" for ch in last])
    if solid == 32:
        out = "full floor."
    elif clear == 32:
        out = ""
    elif solid > clear:
        out = f"floor with {words(gaps)} gap{'' if gaps == 1 else 's'}."
    else:
        out = f"giant gap with {words(chunks)} chunk{'' if chunks == 1 else 's'} of floor."
    gold = pick("G")
    lined = {(r, c) for r, c in gold if r < 31 and {(r, c - 1), (r, c + 1)} & gold}
    starts = lambda cells: sum((r, c - 1) not in cells for r, c in cells)
    ladder = pick("#")
    tall = []
    for r, c in ladder:
        if (r - 1, c) not in ladder:
            h = 1
            while (r + h, c) in ladder:
                h += 1
            tall.append(h)
    pairs = {(r, c) for r, c in ladder if r < 31 and {(r, c - 1), (r, c + 1)} & ladder}
    out += say(len(pick("E")), "enemy", "enemies") + say(starts(lined), "gold line", "gold lines")
    out += say(len(gold - lined), "gold", "gold")
    out += say(starts({k for k in pick("-") if k[0] < 31}), "rope", "ropes")
    out += say(sum(bool(g & pairs) for g in flood(ladder)), "ladder cluster", "ladder clusters")
    out += say(tall.count(1), "lone ladder tile", "lone ladder tiles")
    out += say(sum(2 <= h <= 4 for h in tall), "short ladder", "short ladders")
    out += say(sum(h >= 5 for h in tall), "tall ladder", "tall ladders")
    kinds = {}
    for g in flood(pick("Bb")):
        rs, cs = [r for r, _ in g], [c for _, c in g]
        height, width = max(rs) - min(rs) + 1, max(cs) - min(cs) + 1
        if 1 not in rs and width <= 2 and height >= 3 and 30 in rs:
            continue
        kind = "rectangular" if len(g) == height * width else "irregular"
        kinds[kind] = kinds.get(kind, 0) + 1
    for kind, n in kinds.items():
        out += say(n, f"{kind} block cluster", f"{kind} block clusters")
    out += say(len(pick("B")), "solid ground", "solid ground")
    out += say(len(pick("b")), "diggable ground", "diggable ground")
    areas = flood({k for k in pick(".") if k[0] >= 10})
    rim = sum(any(r in (0, 31) or c in (0, 31) for r, c in g) for g in areas)
    out += say(len(areas) - rim, "chamber", "chambers")
    out += say(rim, "empty background area", "empty background areas")
    return out.strip()


def test_ladder_caption_matches_search(spark):
    rng = random.Random(5)
    scenes = []
    for k in range(60):
        palette = ["BBb....--#GEM", "Bb#........", "BBBBbb..#G-"][k % 3]
        rows = ["".join(rng.choice(palette) for _ in range(32)) for _ in range(32)]
        if k % 4 == 0:
            rows[31] = "B" * 32
        if k % 5 == 0:
            rows[12:16] = ["B" * 32, "B" + "." * 30 + "B", "B" + "." * 30 + "B", "B" * 32]
        scenes.append(rows)
    df = spark.createDataFrame(list(enumerate(scenes)), "scene_id bigint, rows array<string>")
    got = dict(ladder_caption(df).select("scene_id", "caption").collect())
    assert {i: got[i] for i in got} == {i: ladder_by_search(rows) for i, rows in enumerate(scenes)}


def test_directional_gate_and_water(spark):
    rows = ["@" * 16] * 2 + ["#" * 16] + ["~" * 16] * 5 + ["-" * 16] * 7 + ["#" * 16]
    df = spark.createDataFrame([(1, rows, "LEFT", "RIGHT")],
                               "scene_id int, rows array<string>, a string, b string")
    told = directional_caption(df, F.col("a"), F.col("b")).first()["caption"]
    assert told == "entrance direction left. exit direction right. half water. full floor. one platform."
    loose = directional_caption(df, F.col("a"), F.col("b"), strict_case=False).first()["caption"]
    assert "full ceiling. full floor" in loose and "platform" not in loose


def test_flip_is_its_own_inverse(spark):
    rng = random.Random(1)
    grid = [[rng.randrange(13) for _ in range(16)] for _ in range(16)]
    df = spark.createDataFrame([(grid,)], "scene array<array<int>>")
    back = df.select(flip_scene(flip_scene(F.col("scene"))).alias("s")).first()["s"]
    assert back == grid


def test_windows_and_validation(spark):
    level = ["X" * 20, "--" * 10]
    df = spark.createDataFrame([(1, level)], "id int, lines array<string>")
    cut = sliding_windows(df, ["id"], 4, 16, 2, "-").orderBy("x").collect()
    assert [r["x"] for r in cut] == [0, 1, 2]
    assert cut[0]["rows"] == ["-" * 16, "-" * 16, "X" * 16, "-" * 16]
    assert sliding_windows(df, ["id"], 4, 24).count() == 0
    good = ["M" + "." * 31, "G" + "." * 31] + ["." * 32] * 30
    cases = [good, good[:31], ["." * 32] * 32, [good[0]] + ["." * 32] * 31, good[:31] + ["."]]
    df = spark.createDataFrame(list(enumerate(cases)), "id int, rows array<string>")
    got = dict(df.select("id", S.invalid_reason(F.col("rows"))).collect())
    assert got == {0: None, 1: "wrong size", 2: "no spawn", 3: "no gold", 4: "not rectangular"}
    square = spark.createDataFrame([([[1, 2], [3, 4]],), ([[1, 2], [3]],)], "p array<array<int>>")
    assert [r[0] for r in square.select(S.is_square(F.col("p"), 2)).collect()] == [True, False]
    assert LADDER.alphabet == "#-.BEGMb" and DIRECTIONAL.alphabet[:3] == "P@-"
