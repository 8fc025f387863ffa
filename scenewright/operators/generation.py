"""Random captions from the phrase tables of a game."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewright.functions.binding import let
from scenewright.functions.captions import join_phrases
from scenewright.games import Game
from scenewright.operators.similarity import known_keys, unknown
from scenewright.session import cut_lineage

MOST_DRAWS = 100_000_000  # an error beyond: the known captions then cover what can be drawn

# A topic that is only ever mentioned together with another one.
IMPLIED = {"coin line": "coin", "gold line": "gold"}


def _hash(*parts: Column) -> Column:
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def _with_implied(topics: Column, topic: str, other: str) -> Column:
    return let(topics, lambda w: F.when(
        F.array_contains(w, topic) & ~F.array_contains(w, other),
        F.array_append(w, F.lit(other))).otherwise(w))


def generate_captions(draws: DataFrame, key: str, game: Game, seed: int, absence: bool = False,
                      min_topics: int = 1, max_topics: int = 10,
                      upside_down: bool = True) -> DataFrame:
    """One caption per row of ``draws``: random topics, one random phrase each, shuffled.

    Every choice is a hash of seed, row key and topic, so a draw does not depend
    on partitioning or on other rows.
    """
    if not game.phrases:
        raise ValueError("this game has no phrase table to draw captions from")
    topics = [t for t in game.phrases if upside_down or t != "upside down pipe"]
    table = F.array(*[
        F.struct(F.lit(t).alias("topic"),
                 F.array(*[F.lit(p) for p in game.phrases[t]]).alias("phrases"),
                 F.lit(game.absent.get(t)).alias("absent")) for t in topics])
    salt = F.lit(seed)
    n = F.pmod(_hash(salt, F.col(key), F.lit("n")), F.lit(max_topics - min_topics + 1)) + min_topics
    scored = F.transform(table, lambda x: F.struct(
        _hash(salt, F.col(key), x["topic"]).alias("h"), x["topic"].alias("topic"),
        F.get(x["phrases"], F.pmod(_hash(salt, F.col(key), F.lit("phrase"), x["topic"]),
                                   F.size(x["phrases"])).cast("int")).alias("phrase"),
        x["absent"].alias("absent")))

    def sentence(picked: Column, every: Column) -> Column:
        used = F.transform(picked, lambda x: x["topic"])
        wanted = used
        for topic, other in IMPLIED.items():
            if other in topics:
                wanted = _with_implied(wanted, topic, other)

        def phrases(w: Column) -> Column:
            chosen = F.transform(F.filter(every, lambda x: F.array_contains(w, x["topic"])),
                                 lambda x: x["phrase"])
            if absence:
                chosen = F.concat(chosen, F.transform(
                    F.filter(every, lambda x: ~F.array_contains(w, x["topic"])
                             & x["absent"].isNotNull()), lambda x: x["absent"]))
            return chosen

        order = F.transform(let(wanted, phrases), lambda p: F.struct(
            _hash(salt, F.col(key), F.lit("order"), p).alias("h"), p.alias("p")))
        return join_phrases(F.transform(F.array_sort(order), lambda x: x["p"]))

    caption = let(F.array_sort(scored), lambda every: let(
        F.slice(every, F.lit(1), n.cast("int")), lambda picked: sentence(picked, every)))
    return draws.select(key, caption.alias("caption"))


def draw_until(known: DataFrame, n: int, game: Game, seed: int, caption: str = "caption", **options) -> DataFrame:
    """The first ``n`` draws ``(draw, caption)`` that match no known caption perfectly.

    Draws are numbered from 0. Rounds double until enough are new, so the result
    does not depend on the size of a round; the known keys are derived once.
    """
    spark = known.sparkSession
    keys = cut_lineage(known_keys(known, game, caption))
    size = 2 * n
    while True:
        draws = spark.range(size).withColumnRenamed("id", "draw")
        new = cut_lineage(unknown(generate_captions(draws, "draw", game, seed, **options), keys, game)
                          .orderBy("draw").limit(n))
        if new.count() == n:
            return new
        if size >= MOST_DRAWS:
            raise ValueError(f"fewer than {n} of {size} draws are new")
        size *= 4


def check_sql(game: Game, seed: int) -> str:
    """DuckDB SQL for one draw per document, without absence phrases."""
    values = ", ".join(f"('{t}', {i}, '{p}', {len(ps)})"
                       for t, ps in game.phrases.items() for i, p in enumerate(ps))
    h = lambda *parts: ("CAST('0x' || substr(md5(" + " || ':' || ".join(parts)
                        + "), 1, 8) AS BIGINT)")
    s = f"'{seed}'"
    return f"""WITH ph AS (SELECT * FROM (VALUES {values}) v(topic, i, phrase, n)),
tp AS (SELECT DISTINCT topic, n FROM ph),
draw AS (SELECT doc_id AS draw, {h(s, 'doc_id', "'n'")} % 10 + 1 AS k FROM documents),
ord AS (SELECT draw, k, topic, n, row_number() OVER (PARTITION BY draw ORDER BY {h(s, 'draw', 'topic')}, topic) AS rk
  FROM draw, tp),
used AS (SELECT draw, topic, n FROM ord WHERE rk <= k UNION
  SELECT a.draw, 'coin', tp.n FROM ord a, tp WHERE a.rk <= a.k AND a.topic = 'coin line' AND tp.topic = 'coin'),
pick AS (SELECT u.draw, phrase FROM used u JOIN ph ON ph.topic = u.topic
  AND ph.i = {h(s, 'u.draw', "'phrase'", 'u.topic')} % u.n)
SELECT draw, string_agg(phrase, '. ' ORDER BY {h(s, 'draw', "'order'", 'phrase')}, phrase) || '.' AS caption
FROM pick GROUP BY draw"""
