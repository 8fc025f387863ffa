"""Encodings and checks of scenes and of small records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenewright.functions.binding import let
from scenewright.games import Game


def wrap_tiles(scene: Column, n: int) -> Column:
    return F.transform(scene, lambda row: F.transform(row, lambda t: F.pmod(t, F.lit(n))))


def one_hot(scene: Column, n: int) -> Column:
    return F.transform(scene, lambda row: F.transform(row, lambda t: F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (k == t).cast("float"))))


def decode_tiles(scores: Column) -> Column:
    """Id of the largest channel per cell; the first one on ties."""
    return F.transform(scores, lambda row: F.transform(
        row, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int")))


def _table(vectors: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in v]) for v in vectors])


def embed_tiles(scene: Column, vectors: list[list[float]]) -> Column:
    """The vector of every tile id; an id outside the table becomes null."""
    return let(_table(vectors), lambda t: F.transform(scene, lambda row: F.transform(row, lambda i: F.get(t, i))))


def nearest_tile(vector: Column, vectors: list[list[float]], digits: int = 9) -> Column:
    """Id of the tile whose vector has the largest cosine; the first one on ties.

    A vector without length is as far from all tiles: it becomes tile 0.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def choose(v: Column) -> Column:
        length = F.sqrt(dot(v, v))
        unit = [[x / (sum(y * y for y in t) ** 0.5 or 1.0) for x in t] for t in vectors]
        cosines = F.transform(_table(unit), lambda t: F.round(F.coalesce(dot(t, v) / F.nullif(length, F.lit(0.0)), F.lit(0.0)), digits))
        return let(cosines, lambda c: (F.array_position(c, F.array_max(c)) - 1).cast("int"))

    return let(F.transform(vector, lambda x: x.cast("double")), choose)


def decode_nearest(scene: Column, vectors: list[list[float]]) -> Column:
    """A scene of vectors as tile ids."""
    return F.transform(scene, lambda row: F.transform(row, lambda v: nearest_tile(v, vectors)))


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    powers = F.transform(values, lambda v: F.exp(v - top))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x))


def invalid_reason(rows: Column, size: int = 32) -> Column:
    """First reason a ladder scene is unusable, null when it is fine."""
    return (
        F.when(~F.forall(rows, lambda row: F.length(row) == F.length(rows[0])), "not rectangular")
        .when((F.size(rows) != size) | (F.length(rows[0]) != size), "wrong size")
        .when(~F.exists(rows, lambda row: row.contains("M")), "no spawn")
        .when(~F.exists(rows, lambda row: row.contains("G")), "no gold")
    )


def is_square(patch: Column, n: int) -> Column:
    return (F.size(patch) == n) & F.forall(patch, lambda row: F.size(row) == n)


def to_hours(df: DataFrame) -> DataFrame:
    """Divide every numeric column and numeric list by 3600."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NumericType):
            out[f.name] = F.col(f.name) / 3600.0
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType):
            out[f.name] = F.transform(f.name, lambda x: x / 3600.0)
    return df.withColumns(out)


def to_number(value: Column) -> Column:
    """Numbers as doubles, anything else null."""
    return value.try_cast("double")


def metric_lines(text: Column) -> Column:
    """``key: value`` lines as ``ARRAY<STRUCT<key, kind, value>>``; others are ignored."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains(":"))

    def parse(line: Column) -> Column:
        key = F.trim(F.substring_index(line, ":", 1))
        raw = F.trim(F.regexp_replace(line, "^[^:]*:", ""))
        kind = F.when(F.lower(raw).isin("true", "false"), "bool").when(
            raw.contains("."), "float").otherwise("int")
        value = F.when(F.lower(raw) == "true", 1.0).when(F.lower(raw) == "false", 0.0).otherwise(
            raw.try_cast("double"))
        return F.struct(key.alias("key"), kind.alias("kind"), value.alias("value"))

    return F.transform(lines, parse)


# Words that mark a line without a colon as an error; fixed values.
ERROR_WORDS = ["Invalid or corrupt jarfile", "Exception", "Error"]


def error_line(text: Column) -> Column:
    """Does a line without a colon report an error?"""
    words = F.array(*[F.lit(w) for w in ERROR_WORDS])
    return F.exists(F.split(text, "\n"), lambda x: ~x.contains(":") & F.exists(
        words, lambda w: x.contains(w)))


def experiment_spec(spec: Column) -> Column:
    """``prefix:runs[:pattern][:label][:style]`` as a struct with the runs expanded."""
    parts = F.split(spec, ":")
    runs = F.get(parts, F.lit(1))
    span = F.split(runs, "-")
    expanded = F.when(runs.contains("-"), F.sequence(F.get(span, F.lit(0)).cast("int"),
                                                     F.get(span, F.lit(1)).cast("int"))).otherwise(
        F.transform(F.split(runs, ","), lambda r: F.trim(r).cast("int")))
    return F.struct(
        F.get(parts, F.lit(0)).alias("prefix"), expanded.alias("runs"),
        F.coalesce(F.get(parts, F.lit(2)), F.lit("caption_score_log_*.jsonl")).alias("pattern"),
        F.get(parts, F.lit(3)).alias("label"),
        F.get(parts, F.lit(4)).try_cast("int").alias("style"))


def group_of(ch: Column, game: Game, enemies: str = "a", powerups: str = "l", empty: str = "-") -> Column:
    """Collapse all enemies, power-ups and dry empty tiles to one tile each."""
    return (
        F.when(F.instr(F.lit(game.having("enemy")), ch) > 0, enemies)
        .when(F.instr(F.lit(game.having("powerup")), ch) > 0, powerups)
        .when(F.instr(F.lit(game.having("empty", without=("water",))), ch) > 0, empty).otherwise(ch)
    )


def grouped_alphabet(game: Game) -> str:
    """Tiles of the collapsed set in id order: the untouched ones in code point
    order, then the enemy, power-up and empty representatives."""
    gone = game.having("enemy", "powerup") + game.having("empty", without=("water",))
    return "".join(c for c in sorted(game.tiles) if c not in gone) + "al-"
