"""Best caption match by bounds: an index over topics that is walked only as far as a better match can lie.

A caption is its topic values, and a match loses something at every topic that
differs. The known captions form a trie whose levels are pieces of a few
topics. A search carries what it has lost so far from level to level, as a join
on the node and on which topics of the piece are present; what lost more than
the caption's budget is dropped. No pair outside the budget is built further.

The budget is the loss of a real match, found through equal pieces, and
searches start with a smaller one that grows for those which found nothing. So
the result is exact, ties included.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewright.functions.captions import topic_key
from scenewright.games import Game
from scenewright.operators.joins import lookup_join
from scenewright.session import cut_lineage

#: So many known keys (and 18 topics) are a few megabytes and go to every task; the work is then linear.
FEW = 4096
#: Topics of a level of the trie.
PIECE = 3
#: First budgets, in losses of a topic that only one side has; then a real match's loss.
BUDGETS = (1, 3)


class _Losses:
    """What a pair of topic values loses, in whole units."""

    def __init__(self, game: Game) -> None:
        steps = len(game.quantity_terms) - 1
        self.terms, self.topics = game.quantity_terms, len(game.topics)
        self.equal = 20 * steps // 4  # smallest whole unit of 1, 0.1 and a quantity step
        self.step = self.equal // steps
        self.absent, self.other = 2 * self.equal, self.equal - self.equal // 10

    def code(self, part: Column) -> Column:
        """-1 for nothing, the position of a quantity, the number of quantities for other phrases."""
        terms = F.array(*map(F.lit, self.terms))
        return F.when(part == "", -1).otherwise(
            F.coalesce(F.nullif(F.array_position(terms, part), F.lit(0).cast("bigint")) - 1, F.lit(len(self.terms)))).cast("int")

    def between(self, u: Column, v: Column, c: Column, d: Column) -> Column:
        n = len(self.terms)
        return (F.when(u == v, 0).when((c < 0) | (d < 0), self.absent)
                .when((c < n) & (d < n), F.abs(c - d) * self.step).otherwise(self.other))

    def of(self, a: Column, b: Column, topics: int) -> Column:
        """Loss of two pieces of so many topics."""
        return reduce(lambda x, y: x + y, [
            self.between(a["p"][i], b["p"][i], a["c"][i], b["c"][i]) for i in range(topics)])


def _search(open_: DataFrame, known: DataFrame, loss: _Losses, sizes: list[int]) -> DataFrame:
    """``(key, best: (loss, id), pairs)`` of the open keys that have a match within their ``budget``."""
    state = open_.withColumns({"lost": F.lit(0), "node": F.lit("")})
    for i, size in enumerate(sizes):
        end = i == len(sizes) - 1
        edges = known.select(F.col(f"n{i}").alias("node"), F.col(f"p{i}").alias("there"), F.col(f"n{i + 1}").alias("next"),
                             F.col(f"p{i}.mask").alias("mask"), *([F.col("id")] if end else []))
        edges = edges if end else edges.distinct()
        masks = F.filter(F.sequence(F.lit(0), F.lit((1 << size) - 1)), lambda m: F.col("lost") + F.lit(
            loss.absent) * F.bit_count(m.bitwiseXOR(F.col(f"p{i}.mask"))) <= F.col("budget"))
        probes = state.withColumn("mask", F.explode(masks))
        state = probes.join(edges, ["node", "mask"]).select(
            "key", "budget", (F.col("lost") + loss.of(F.col(f"p{i}"), F.col("there"), size)).alias("lost"),
            F.col("next").alias("node"), *[f"p{j}" for j in range(i + 1, len(sizes))],
            *([F.col("id")] if end else [])).where("lost <= budget")
    return state.groupBy("key").agg(F.min(F.struct("lost", "id")).alias("best"), F.count("*").alias("pairs"))


def _few(keys: DataFrame, known: DataFrame, loss: _Losses) -> DataFrame:
    """The same for at most ``FEW`` known keys: they travel with the tasks, and every key is compared with all of them."""
    rows = known.orderBy("id").collect()
    ids = np.array([r["id"] for r in rows], np.int64)
    n, topics = len(loss.terms), range(loss.topics)
    phrases = [np.array([t for j in range(-(-loss.topics // PIECE)) for t in r[f"p{j}"]["p"]], object) for r in rows]
    numbers = [{} for _ in topics]  # phrase -> number, per topic: quantities first, then other phrases
    for numbering in numbers:
        numbering.update({t: i for i, t in enumerate(["", *loss.terms])})
    there = np.array([[numbers[t].setdefault(x[t], len(numbers[t])) for t in topics] for x in phrases], np.int64) - 1

    def best(frames):
        for frame in frames:
            lost = np.zeros(len(frame), np.int64)
            match = np.zeros(len(frame), np.int64)
            parts = [k.split("|") for k in frame["key"]]
            here = np.array([[numbers[t].get(x[t], 1 << 40) for t in topics] for x in parts], np.int64) - 1
            for at in range(0, len(frame), 256):  # keeps the matrices small
                total = np.zeros((min(256, len(frame) - at), len(ids)), np.int64)
                for t in topics:
                    u, v = here[at:at + 256, t][:, None], there[:, t][None, :]
                    total += np.where(u == v, 0, np.where((u < 0) | (v < 0), loss.absent, np.where(
                        (u < n) & (v < n), np.abs(u - v) * loss.step, loss.other)))
                first = total.argmin(axis=1)
                lost[at:at + 256], match[at:at + 256] = total[np.arange(len(first)), first], ids[first]
            yield pd.DataFrame({"key": frame["key"], "lost": lost, "id": match})

    if not rows:
        return keys.select("key", F.struct(F.lit(0).alias("lost"), F.lit(0).cast("bigint").alias("id")).alias("best")).limit(0)
    return keys.select("key").mapInPandas(best, "key string, lost int, id bigint").select(
        "key", F.struct("lost", "id").alias("best"))


def closest_captions(left: DataFrame, right: DataFrame, game: Game) -> tuple[DataFrame, int]:
    """(``(id, match, score)`` of left captions without a perfect match, pairs of different keys compared as a whole).

    Inputs have ``id`` and ``caption``; a null caption counts as an empty one.
    The best score wins, then the smallest right id. Scores depend on the topic
    keys alone, so every key is searched once. Without right rows there are no
    matches.
    """
    loss = _Losses(game)
    starts = range(0, loss.topics, PIECE)
    sizes = [min(PIECE, loss.topics - a) for a in starts]
    names = [f"p{i}" for i in range(len(sizes))]

    def keyed(df: DataFrame) -> DataFrame:
        return df.select("id", topic_key(F.coalesce("caption", F.lit("")), game).alias("key"))

    def parsed(df: DataFrame) -> DataFrame:
        parts = df.withColumn("_p", F.split("key", r"\|", -1)).withColumn("_c", F.transform("_p", loss.code))

        def piece(a: int, n: int) -> Column:
            bits = [F.when(F.col("_c")[a + i] >= 0, 1 << i).otherwise(0) for i in range(n)]
            return F.struct(F.slice("_p", a + 1, n).alias("p"), F.slice("_c", a + 1, n).alias("c"),
                            reduce(lambda x, y: x + y, bits).alias("mask"))

        made = parts.withColumns({name: piece(a, n) for name, a, n in zip(names, starts, sizes)})
        return made.withColumns({f"n{i}": F.array_join(F.slice("_p", 1, min(i * PIECE, loss.topics)), "|")
                                 for i in range(len(sizes) + 1)}).drop("_p", "_c")

    asked = cut_lineage(keyed(left))
    known = cut_lineage(parsed(keyed(right).groupBy("key").agg(F.min("id").alias("id"))))
    rest = cut_lineage(parsed(asked.select("key").distinct().join(known, "key", "left_anti")).select("key", *names))
    top = loss.equal * loss.topics

    def answer(best: DataFrame) -> DataFrame:
        return asked.join(best, "key").select(
            "id", F.col("best.id").alias("match"), ((top - F.col("best.lost")) / float(top)).alias("score"))

    if known.limit(FEW + 1).count() <= FEW:
        return answer(_few(rest, known, loss)), rest.count() * known.count()

    # a real match for every key: of each of its pieces, some known key with an equal one; else any known key
    def each_piece(df: DataFrame, *more: str) -> DataFrame:
        return df.select("key", F.struct(*names).alias("k"), *more, F.explode(F.array(*[F.struct(
            F.lit(i).alias("i"), F.array_join(F.col(f"{n}.p"), "|").alias("text")) for i, n in enumerate(names)])).alias("piece"))

    same = each_piece(known, "id").groupBy("piece").agg(F.min_by("k", "id").alias("r"))
    anyone = known.agg(F.min_by(F.struct(*names), "id").alias("anyone"))  # one row
    met = lookup_join(each_piece(rest), same, ["piece"], "left").crossJoin(F.broadcast(anyone)).select(
        "key", "k", F.coalesce("r", "anyone").alias("r"))
    lost = reduce(lambda x, y: x + y, [loss.of(F.col(f"k.{n}"), F.col(f"r.{n}"), size) for n, size in zip(names, sizes)])
    bounds = met.select("key", lost.alias("lost")).groupBy("key").agg(F.min("lost").alias("bound"))
    open_ = cut_lineage(rest.join(bounds, "key"))
    found, compared = [], 0
    for most in (*(n * loss.absent for n in BUDGETS), None):
        budget = F.col("bound") if most is None else F.least("bound", F.lit(most))
        done = cut_lineage(_search(open_.withColumn("budget", budget), known, loss, sizes))
        compared += done.agg(F.sum("pairs")).head()[0] or 0
        found.append(done.select("key", "best"))
        if most is None:
            break
        open_ = cut_lineage(open_.join(done, "key", "left_anti"))
        if open_.isEmpty():
            break
    return answer(reduce(DataFrame.unionAll, found)), compared
