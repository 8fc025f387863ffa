"""Counts in words, places in words, durations as clock text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenewright.functions.binding import let
from scenewright.games import Game


def quantity(n: Column) -> Column:
    """0 no, 1 one, 2 two, 3-4 a few, 5-9 several, 10 or more many."""
    return (
        F.when(n == 0, "no").when(n == 1, "one").when(n == 2, "two")
        .when(n < 5, "a few").when(n < 10, "several").otherwise("many")
    )


def size_word(n: Column) -> Column:
    return F.when(n <= 4, "small").otherwise("big")


def count_phrase(n: Column, one: str, many: str, absence: bool = False) -> Column:
    """``" two coins."``; with ``absence`` also ``" no coins."``."""
    return let(n, lambda k: F.when(
        k > 0,
        F.concat(F.lit(" "), quantity(k), F.lit(" "), F.when(k > 1, many).otherwise(one),
                 F.lit(".")),
    ).otherwise(F.lit(f" no {many}." if absence else "")))


def lines_phrase(n: Column, label: str, absence: bool = False) -> Column:
    """``" two platforms."``; plural for anything but one."""
    return let(n, lambda k: F.when(k == 0, F.lit(f" no {label}s." if absence else "")).otherwise(
        F.concat(F.lit(" "), quantity(k), F.lit(f" {label}"), F.when(k == 1, "").otherwise("s"),
                 F.lit("."))))


def location(x: Column, y: Column, game: Game) -> Column:
    """Thirds of the scene: left/center/right and top/middle/bottom."""
    left, right, top, bottom = game.thirds()
    return F.concat(
        F.when(x < left, "left").when(x < right, "center").otherwise("right"),
        F.lit(" "),
        F.when(y < top, "top").when(y < bottom, "middle").otherwise("bottom"),
    )


def describe_runs(runs: Column, label: str, game: Game, absence: bool = False,
                  where: str | None = None, vertical: bool = False) -> Column:
    """Sentence for an array of runs.

    ``where`` is ``None`` for a plain count, ``"coarse"`` to count per third of
    the scene (in order of first appearance) or ``"exact"`` to list lines.
    """
    if where is None:
        return lines_phrase(F.size(runs), label, absence)

    def place(run: Column) -> Column:
        middle = (run["first"] + run["last"]) / 2.0
        return location(run["line"], middle, game) if vertical else location(
            middle, run["line"], game)

    def by_third(places: Column) -> Column:
        def one_place(p: Column) -> Column:
            k = F.size(F.filter(places, lambda q: q == p))
            return F.concat(quantity(k), F.lit(f" {label}"), F.when(k > 1, "s").otherwise(""),
                            F.lit(" at "), p)

        return F.concat(F.lit(" "),
                        F.array_join(F.transform(F.array_distinct(places), one_place), ". "),
                        F.lit("."))

    axis, across = ("col", "rows") if vertical else ("row", "cols")

    def by_line(all_runs: Column) -> Column:
        n = F.size(all_runs)
        plural = F.when(n > 1, "s").otherwise("")
        parts = F.transform(
            all_runs,
            lambda run: F.concat(run["line"].cast("string"), F.lit(f" ({across} "),
                                 run["first"].cast("string"), F.lit("-"),
                                 run["last"].cast("string"), F.lit(")")),
        )
        return F.concat(F.lit(" "), quantity(n), F.lit(f" {label}"), plural, F.lit(f" at {axis}"),
                        plural, F.lit(" "), F.array_join(parts, ", "), F.lit("."))

    said = (lambda r: let(F.transform(r, place), by_third)) if where == "coarse" else by_line
    return let(runs, lambda r: F.when(
        F.size(r) == 0, F.lit(f" no {label}s." if absence else "")).otherwise(said(r)))


def clock(seconds: Column) -> Column:
    """``HH:MM:SS`` from float seconds, truncated; hours are not bounded."""
    whole = F.floor(seconds)
    return F.format_string(
        "%02d:%02d:%02d",
        F.floor(whole / 3600),
        F.floor(F.pmod(whole, F.lit(3600)) / 60),
        F.pmod(whole, F.lit(60)),
    )
