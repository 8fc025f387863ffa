"""Scenes, captions and run logs derived from the given parquet tables.

Whole texts are read: a document is cut into as many scenes as it has room for
and the last one is padded with blanks. Every view also exists as DuckDB SQL so
that query results can be checked by an engine that shares no code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCENES_PER_DOCUMENT = 100000  # scene_id = doc_id * this + position

# How letters become tiles, per game and row band; every other character takes
# the default tile. Pairs are replaced first and keep their length.
PAIRS = {"platformer": [("th", "<>"), ("on", "[]")], "ladder": [], "directional": []}
KEPT = {"platformer": "<>[]", "ladder": "", "directional": ""}
SIZE = {"platformer": (16, 16), "ladder": (32, 32), "directional": (14, 16)}
BANDS = {
    "platformer": {
        "default": ("-", {"X": "orlg", "S": "duc", "?": "f", "Q": "w", "E": ",", "o": "sm",
                          "B": "b", "b": "y"}),
        2: ("X", {"-": " etnhi"}),
        4: ("X", {"-": " etn", "E": ","}),
        15: ("X", {"-": " ia", "S": "e", "E": ",", "o": "m"}),
    },
    "ladder": {
        "default": (".", {"B": " ", "b": "tdl", "#": "auh", "-": "ic", "G": "rm", "E": ",.",
                          "M": "z"}),
        31: ("B", {".": " ", "b": "ent", "E": ",", "#": "g"}),
    },
    "directional": {
        "default": ("-", {"~": "n", "#": "to", "|": "ah", "M": "i", "B": "r", "A": "s", "W": "d",
                          "H": "u", "a": "l", "C": "c", "p": ".", "q": "b", "t": "g"}),
        2: ("#", {"-": " etn"}),
        13: ("#", {"-": " ia", "H": "s", "~": "n"}),
    },
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when the input arrives in fewer splits than there are cores.

    Large inputs already have many splits and pass through untouched.
    """
    if df.isStreaming:
        return df
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def translation(game: str, band) -> tuple[str, str]:
    default, classes = BANDS[game][band]
    tile_of = {ch: tile for tile, chars in classes.items() for ch in chars}
    source = "".join(
        ch for ch in map(chr, range(32, 127)) if ch not in KEPT[game] and not ch.isupper()
    )
    return source, "".join(tile_of.get(ch, default) for ch in source)


def ascii_rows(text: Column, game: str) -> Column:
    """Whole text as one lower-case ASCII string with the pairs replaced."""
    out = F.lower(text)
    for pair, tiles in PAIRS[game]:
        out = F.replace(out, F.lit(pair), F.lit(tiles))
    return F.regexp_replace(out, "[^ -~]", "~")


def scenes_from_text(df: DataFrame, game: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(scene_id, key, rows ARRAY<STRING>)`` from the whole text column."""
    height, width = SIZE[game]
    cells = height * width
    chunks = df.select(
        key,
        F.posexplode(
            F.regexp_extract_all(ascii_rows(F.col(text), game), F.lit(".{1,%d}" % cells), F.lit(0))
        ).alias("k", "chunk"),
    )
    chunks = spread(chunks)
    lines = F.regexp_extract_all(F.rpad("chunk", cells, " "), F.lit(".{%d}" % width), F.lit(0))

    def tiles(line: Column, r: Column) -> Column:
        picked = F.translate(line, *translation(game, "default"))
        for band in BANDS[game]:
            if band != "default":
                picked = F.when(r == band, F.translate(line, *translation(game, band))).otherwise(
                    picked)
        return picked

    rows = F.transform(lines, tiles)
    if game == "directional":  # squared with null rows on top
        rows = F.concat(F.array_repeat(F.lit("@" * width), width - height), rows)
    return chunks.select(
        (F.col(key) * SCENES_PER_DOCUMENT + F.col("k")).alias("scene_id"),
        key,
        rows.alias("rows"),
    )


def scenes(spark: SparkSession, sf_dir: str, game: str = "platformer") -> DataFrame:
    return scenes_from_text(table(spark, sf_dir, "documents").select("doc_id", "text"), game)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def scene_sql(game: str = "platformer", table_name: str = "documents", key: str = "doc_id",
              prefix: str = "") -> str:
    """CTEs ``{prefix}fx_rows(scene_id, key, r, line)`` and
    ``{prefix}fx_cells(scene_id, r, c, ch)``; r is 0-based."""
    height, width = SIZE[game]
    cells = height * width
    text = "lower(text)"
    for pair, tiles in PAIRS[game]:
        text = f"replace({text}, '{pair}', '{tiles}')"
    text = f"regexp_replace({text}, '[^ -~]', '~', 'g')"
    bands = " ".join(
        f"WHEN {band} THEN translate(line, {_quoted(translation(game, band)[0])}, "
        f"{_quoted(translation(game, band)[1])})"
        for band in BANDS[game] if band != "default"
    )
    base = translation(game, "default")
    p = prefix
    pad = ""
    shift = 0
    if game == "directional":
        shift = width - height
        pad = (f" UNION ALL SELECT scene_id, {key}, pr AS r, repeat('@', {width}) AS line "
               f"FROM (SELECT DISTINCT scene_id, {key} FROM {p}fx_lines), range({shift}) t(pr)")
    return f"""
{p}fx_texts AS (SELECT {key}, {text} AS s FROM {table_name} WHERE length(text) > 0),
{p}fx_chunks AS (
  SELECT {key}, k, rpad(substr(s, CAST(k * {cells} + 1 AS BIGINT), {cells}), {cells}, ' ') AS chunk
  FROM {p}fx_texts, LATERAL (SELECT unnest(range(0, (length(s) + {cells - 1}) // {cells})) AS k)),
{p}fx_lines AS (
  SELECT {key} * {SCENES_PER_DOCUMENT} + k AS scene_id, {key}, r,
         substr(chunk, CAST(r * {width} + 1 AS BIGINT), {width}) AS line
  FROM {p}fx_chunks, range({height}) t(r)),
{p}fx_rows AS (
  SELECT scene_id, {key}, CAST(r + {shift} AS INT) AS r, CASE r {bands}
         ELSE translate(line, {_quoted(base[0])}, {_quoted(base[1])}) END AS line
  FROM {p}fx_lines{pad}),
{p}fx_cells AS (
  SELECT scene_id, r, CAST(c AS INT) AS c, substr(line, CAST(c + 1 AS BIGINT), 1) AS ch
  FROM {p}fx_rows, range({width}) t(c)),
{p}fx_grid AS (
  SELECT scene_id, string_agg(line, '' ORDER BY r) AS grid FROM {p}fx_rows GROUP BY scene_id)"""


# ------------------------------------------------------------------ captions
# Topic, letter whose count in the whole text picks the quantity, singular, plural.
CAPTION_TOPICS = [
    ("e", "ceiling", "ceilings"), ("n", "upside down pipe", "upside down pipes"),
    ("t", "pipe", "pipes"), ("h", "coin line", "coin lines"), ("a", "coin", "coins"),
    ("i", "platform", "platforms"), ("o", "tower", "towers"), ("r", "cannon", "cannons"),
    ("s", "ascending staircase", "ascending staircases"),
    ("d", "descending staircase", "descending staircases"),
    ("u", "rectangular block cluster", "rectangular block clusters"),
    ("l", "irregular block cluster", "irregular block clusters"),
    ("c", "question block", "question blocks"), ("g", "loose block", "loose blocks"),
    ("b", "enemy", "enemies"), ("f", "floor", "floors"), ("p", "broken pipe", "broken pipes"),
]
QUANTITIES = ["no", "one", "two", "a few", "several", "many"]
SPECIAL = {
    "ceiling": ["no ceiling", "full ceiling", "ceiling with one gap", "ceiling with two gaps",
                "ceiling with a few gaps", "ceiling with several gaps"],
    "floor": ["no floor", "full floor", "floor with one gap", "floor with two gaps",
              "giant gap with one chunk of floor", "floor with a few gaps"],
}


def _phrase(t: int, n: int) -> str:
    _, one, many = CAPTION_TOPICS[t]
    if one in SPECIAL:
        return SPECIAL[one][n]
    return f"{QUANTITIES[n]} {one if n == 1 else many}"


#: Letters are counted in pieces of so many bytes.
PIECE = 1 << 20
#: What the generated caption counts for a letter: the text's vowels change places.
SWAPPED = {"e": "a", "o": "e", "a": "o"}


def _letter_counts(texts: pa.Array) -> Iterator[np.ndarray | None]:
    """Number of every byte of each text, in one pass over it; a letter is one byte in UTF-8."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    for known, a, b in zip(texts.is_valid().to_pylist(), ends.tolist(), ends[1:].tolist()):
        yield sum((np.bincount(data[k : min(b, k + PIECE)], minlength=256) for k in range(a, b, PIECE)),
                  np.zeros(256, np.int64)) if known else None


def _caption(counts: np.ndarray | None, letters: list[int]) -> str:
    if counts is None:
        return ""
    said = []
    for t, n in enumerate((counts[letters] % 12).tolist()):
        if n < 6:
            said.append(((n * 7 + t * 5) % 17, t, n))
    return ". ".join(_phrase(t, n) for _, t, n in sorted(said)) + "." if said else ""


def captions_of(text: Column) -> Column:
    """``STRUCT<prompt, generated>``: captions that are functions of letter counts over the whole text.

    Topic ``t`` is mentioned when its letter count modulo 12 is below 6, with
    that number as quantity; exact copies of a text share their captions. The
    generated one counts the letters of ``translate(text, 'aeo', 'eoa')``.
    """
    letters = [ord(letter) for letter, _, _ in CAPTION_TOPICS]
    swapped = [ord(SWAPPED.get(letter, letter)) for letter, _, _ in CAPTION_TOPICS]

    @F.arrow_udf("struct<prompt:string,generated:string>")
    def both(texts: pa.Array) -> pa.Array:
        made = [(_caption(n, letters), _caption(n, swapped)) for n in _letter_counts(texts)]
        return pa.StructArray.from_arrays([pa.array([x[i] for x in made], pa.string()) for i in (0, 1)],
                                          ["prompt", "generated"])

    return both(text)


def pairs(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """``(sample_id, prompt, generated)``: two captions per document."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", *extra))
    made = docs.select(F.col("doc_id").alias("sample_id"), *extra, captions_of(F.lower("text")).alias("_c"))
    return made.select("sample_id", *extra, F.col("_c.prompt"), F.col("_c.generated"))


def known_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(item_id, caption)`` of the benchmark texts."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("s"))
    return items.select("item_id", captions_of(F.col("s"))["prompt"].alias("caption"))


def _topic_values() -> str:
    return ", ".join(
        f"({t}, '{letter}', {k}, '{_phrase(t, k)}')"
        for t, (letter, _, _) in enumerate(CAPTION_TOPICS) for k in range(6))


PAIRS_SQL = f"""
fx_topics AS (SELECT * FROM (VALUES {_topic_values()}) v(t, letter, k, phrase)),
fx_sides AS (
  SELECT doc_id AS id, 'p' AS side, lower(text) AS s FROM documents
  UNION ALL SELECT doc_id, 'g', translate(lower(text), 'aeo', 'eoa') FROM documents
  UNION ALL SELECT item_id, 'k', lower(text) FROM benchmark),
fx_letters AS (
  SELECT id, side, t, (length(s) - length(replace(s, letter, ''))) % 12 AS n
  FROM fx_sides, (SELECT DISTINCT t, letter FROM fx_topics)),
fx_said AS (
  SELECT id, side, l.t, phrase, (n*7 + l.t*5) % 17 AS pos
  FROM fx_letters l JOIN fx_topics f ON f.t = l.t AND f.k = l.n),
fx_text AS (
  SELECT s.id, s.side, coalesce(string_agg(phrase, '. ' ORDER BY pos, t) || '.', '') AS caption
  FROM fx_sides s LEFT JOIN fx_said f ON f.id = s.id AND f.side = s.side GROUP BY s.id, s.side),
fx_pairs AS (
  SELECT a.id AS sample_id, a.caption AS prompt, b.caption AS generated
  FROM fx_text a JOIN fx_text b ON a.id = b.id AND a.side = 'p' AND b.side = 'g'),
fx_known AS (SELECT id AS item_id, caption FROM fx_text WHERE side = 'k')"""


# ------------------------------------------------------------------ run logs
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(grp, run, epoch, ts, loss)``: one log per event type and user."""
    from scenewright.operators.ranking import group_rank

    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("grp"), F.col("user_id").alias("run"), "ts", "event_id",
        F.col("value").alias("loss"))
    return group_rank(events, ["grp", "run"], ["ts", "event_id"], "epoch")


def score_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(grp, run, line_no, epoch, score)`` with repeated epochs."""
    from scenewright.operators.ranking import group_rank

    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("grp"), (F.col("user_id") % 10).alias("run"), "ts", "event_id",
        (F.col("value") / 100.0).alias("score"))
    lines = group_rank(events, ["grp", "run"], ["ts", "event_id"], "line_no")
    return lines.withColumn("epoch", (F.col("line_no") % 50).cast("int"))


LOG_SQL = """
fx_run_log AS (
  SELECT event_type AS grp, user_id AS run, event_id, ts, value AS loss,
    row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS epoch FROM events),
fx_score_log AS (
  SELECT grp, run, line_no, CAST(line_no % 50 AS INT) AS epoch, score FROM (
    SELECT event_type AS grp, user_id % 10 AS run, value / 100.0 AS score,
      row_number() OVER (PARTITION BY event_type, user_id % 10 ORDER BY ts, event_id) - 1 AS line_no FROM events))"""
