"""Caption text algebra as column expressions.

A caption is ``phrase. phrase. ... phrase.``; a *topic array* holds, per topic
of a game, the phrase that speaks about it or null.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from scenewright.functions.binding import let
from scenewright.games import BROKEN_TOPIC_COUNT, PLATFORMER, PLATFORMER_NEGATED, Game


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def split_phrases(caption: Column, separators: str = ".") -> Column:
    """Trimmed, non-empty phrases."""
    return F.filter(F.transform(F.split(caption, f"[{separators}]"), stripped), lambda p: p != "")


def join_phrases(phrases: Column, separator: str = ". ") -> Column:
    return F.concat(F.array_join(phrases, separator), F.lit("."))


def extract_topics(caption: Column, topics: list[str]) -> Column:
    """Topic array: each topic in turn takes the first unclaimed phrase that contains it.

    A first match that begins with "no " means absence and stays unclaimed, so
    it can hide a positive phrase about the same topic further on.
    """
    text = "array<string>"

    def take(phrases: Column) -> Column:
        def step(acc: Column, topic: Column) -> Column:
            first = F.get(F.filter(
                phrases,
                lambda p: p.contains(topic) & ~F.array_contains(acc["claimed"], p)), F.lit(0))
            return let(first, lambda m: F.when(
                m.isNull() | F.lower(m).startswith("no "),
                F.struct(acc["claimed"].alias("claimed"),
                         F.array_append(acc["found"], F.lit(None).cast("string")).alias("found")),
            ).otherwise(
                F.struct(F.array_append(acc["claimed"], m).alias("claimed"),
                         F.array_append(acc["found"], m).alias("found"))))

        empty = F.struct(F.array().cast(text).alias("claimed"), F.array().cast(text).alias("found"))
        return F.aggregate(_texts(topics), empty, step, lambda acc: acc["found"])

    return let(split_phrases(caption), take)


def normalize_plural(phrase: Column) -> Column:
    """Singular form word by word: enemies to enemy, a trailing s dropped unless ss."""
    return F.regexp_replace(F.replace(phrase, F.lit("enemies"), F.lit("enemy")),
                            r"(?<!s)s(?=\s|$)", "")


def quantity_index(phrase: Column, terms: list[str]) -> Column:
    """Position of the first quantity term contained in the phrase, else null."""
    out = F.lit(None).cast("int")
    for i, term in reversed(list(enumerate(terms))):
        out = F.when(phrase.contains(term), i).otherwise(out)
    return out


def quantity_score(a: Column, b: Column, terms: list[str]) -> Column:
    """1 for equal quantities down to 0 for the widest gap; 0.1 if one has none."""
    gap = F.abs(quantity_index(a, terms) - quantity_index(b, terms))
    return F.coalesce(1.0 - gap / float(len(terms) - 1), F.lit(0.1))


def topic_scores(found: Column, made: Column, terms: list[str]) -> Column:
    """Per topic: 1 both absent or equal, -1 one absent, else the quantity score."""

    def score(a: Column, b: Column) -> Column:
        return (
            F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), -1.0)
            .when(a == b, 1.0).otherwise(quantity_score(a, b, terms))
        )

    return F.zip_with(F.transform(found, normalize_plural), F.transform(made, normalize_plural),
                      score)


def mean_score(scores: Column, n_topics: int) -> Column:
    return F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + s) / float(n_topics)


BLANKS = " \t\n\x0b\f\r"
#: Captions and phrases whose topics a task remembers at most.
REMEMBERED = 20_000


class _Judge:
    """``extract_topics``, ``normalize_plural`` and ``topic_scores`` for one caption after the other."""

    def __init__(self, game: Game):
        self.topics, self.terms = list(game.topics), list(game.quantity_terms)
        self.plural = re.compile(r"(?<!s)s(?=\s|$)", re.ASCII)
        self.phrases: dict[str, tuple] = {}
        self.captions: dict[str | None, list] = {}

    def phrase(self, text: str) -> tuple[str, list[int], bool, str, int | None]:
        """(phrase, its topics, is it a denial, its singular form, its quantity)."""
        found = self.phrases.get(text)
        if found is None:
            one = self.plural.sub("", text.replace("enemies", "enemy"))
            quantity = next((i for i, term in enumerate(self.terms) if term in one), None)
            found = text, [t for t, topic in enumerate(self.topics) if topic in text], text[:3].lower() == "no ", one, quantity
            if len(self.phrases) >= REMEMBERED:
                self.phrases.clear()
            self.phrases[text] = found
        return found

    def extracted(self, caption: str | None) -> list[tuple | None]:
        """The phrase of each topic: the first unclaimed one that contains it, none if that is a denial."""
        found = self.captions.get(caption)
        if found is None:
            said = [self.phrase(p) for x in (caption or "").split(".") if (p := x.strip(BLANKS))]
            holding: dict[int, list[tuple]] = {}
            for p in said:
                for t in p[1]:
                    holding.setdefault(t, []).append(p)
            claimed: set[str] = set()
            found = [None] * len(self.topics)
            for t in sorted(holding):
                first = next((p for p in holding[t] if p[0] not in claimed), None)
                if first is not None and not first[2]:
                    claimed.add(first[0])
                    found[t] = first
            if len(self.captions) >= REMEMBERED:
                self.captions.clear()
            self.captions[caption] = found
        return found

    def scores(self, a: list, b: list) -> list[float]:
        widest = float(len(self.terms) - 1)

        def score(x: tuple | None, y: tuple | None) -> float:
            if x is None or y is None:
                return 1.0 if x is y else -1.0
            if x[3] == y[3]:
                return 1.0
            return 0.1 if x[4] is None or y[4] is None else 1.0 - abs(x[4] - y[4]) / widest

        return [score(x, y) for x, y in zip(a, b)]

    def mean(self, scores: list[float]) -> float:
        total = 0.0
        for s in scores:  # one after the other, as the mean is defined
            total += s
        return total / float(len(self.topics))


def compare_captions(reference: Column, generated: Column, game: Game = PLATFORMER) -> Column:
    """``STRUCT<score, exact, partial, excess>`` of a generated caption."""
    @F.arrow_udf("struct<score:double,exact:array<string>,partial:array<string>,excess:array<string>>")
    def judged(reference: pa.Array, generated: pa.Array) -> pa.Array:
        judge = _Judge(game)
        scores, kinds = [], ([], [], [])
        for a, b in zip(reference.to_pylist(), generated.to_pylist()):
            found, made = judge.extracted(a), judge.extracted(b)
            scores.append(judge.mean(judge.scores(found, made)))
            both = [(x, y) for x, y in zip(found, made) if x is not None and y is not None]
            kinds[0].append([y[0] for x, y in both if x[3] == y[3]])
            kinds[1].append([y[0] for x, y in both if x[3] != y[3]])
            kinds[2].append([y[0] for x, y in zip(found, made) if x is None and y is not None])
        return pa.StructArray.from_arrays(
            [pa.array(scores, pa.float64()), *[pa.array(k, pa.list_(pa.string())) for k in kinds]],
            ["score", "exact", "partial", "excess"])

    return judged(reference, generated)


def caption_score(reference: Column, generated: Column, game: Game = PLATFORMER) -> Column:
    @F.arrow_udf("double")
    def score(reference: pa.Array, generated: pa.Array) -> pa.Array:
        judge = _Judge(game)
        return pa.array([judge.mean(judge.scores(judge.extracted(a), judge.extracted(b)))
                         for a, b in zip(reference.to_pylist(), generated.to_pylist())], pa.float64())

    return score(reference, generated)


def topic_key(caption: Column, game: Game = PLATFORMER) -> Column:
    """Equal for two captions exactly when their score is 1.

    Per topic the quantity term, else the normalised phrase, else nothing: this
    turns "is there a perfect match" into an equi join.
    """
    terms = _texts(game.quantity_terms)

    def part(p: Column) -> Column:
        n = normalize_plural(p)
        return F.coalesce(F.get(terms, quantity_index(n, game.quantity_terms)), n, F.lit(""))

    return F.array_join(F.transform(extract_topics(caption, game.topics), part), "|")


def append_absence(prompt: Column, game: Game = PLATFORMER) -> Column:
    """Add "no X" for each topic without a word that starts with it.

    Topics of several words never match a single word, so they always count as
    absent; broken topics are never added.
    """
    noun = {"rectangular": "rectangular block clusters", "irregular": "irregular block clusters",
            "ceiling": "ceiling", "floor": "floor", "enem": "enemies"}
    wanted = [(t, "no " + noun.get(t, t + "s")) for t in game.topics if "broken" not in t]
    words = F.split(F.regexp_replace(F.lower(prompt), "[.,;]", " "), r"\s+")
    table = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(s).alias("s")) for t, s in wanted])

    def add(ws: Column) -> Column:
        missing = F.transform(
            F.filter(table, lambda x: ~F.exists(ws, lambda w: w.startswith(x["t"]))),
            lambda x: x["s"])
        return let(missing, lambda m: F.when(F.size(m) == 0, prompt).otherwise(
            F.concat(F.regexp_replace(prompt, "[ .]+$", ""), F.lit(". "), join_phrases(m))))

    return let(words, add)


def split_positive_negative(caption: Column, game: Game = PLATFORMER,
                            drop_upside_down: bool = False) -> Column:
    """``STRUCT<positive, negative, problem>``; ``problem`` is null when usable."""
    want = len(game.topics) - BROKEN_TOPIC_COUNT
    phrases = F.transform(F.filter(F.split(caption, "[.]"), lambda p: p != ""), stripped)

    def parts(ps: Column) -> Column:
        n = F.size(ps)
        denies = caption.contains("no ")
        unsaid = F.filter(_texts(game.topics), lambda t: ~caption.contains(t))
        negated = join_phrases(unsaid)
        for old, new in PLATFORMER_NEGATED:
            negated = F.replace(negated, F.lit(old), F.lit(new))
        kept = join_phrases(F.filter(ps, lambda p: ~p.contains("no ")))
        denied = join_phrases(F.transform(F.filter(ps, lambda p: p.contains("no ")),
                                          lambda p: F.replace(p, F.lit("no "), F.lit(""))))
        full, short = n == want, n < want
        negative = (F.when(full & ~denies, "").when(full & denies, denied)
                    .when(~denies & short, negated).otherwise(""))
        if drop_upside_down:
            negative = F.replace(negative, F.lit(" upside down pipes."), F.lit(""))
            negative = F.replace(negative, F.lit("upside down pipes. "), F.lit(""))
        return F.struct(
            F.when(full & denies, kept).when(~denies & (full | short), caption).otherwise("")
            .alias("positive"),
            negative.alias("negative"),
            F.when(denies & ~full, "with negative phrases every topic must be present")
            .when(~denies & ~full & ~short, "too many phrases").alias("problem"),
        )

    return let(phrases, parts)


def dedupe_phrases(caption: Column, topics: list[str]) -> Column:
    """One phrase per topic at its first position; a positive one beats "no X"."""

    def key(p: Column) -> Column:
        topic = F.get(F.filter(_texts(topics), lambda t: F.lower(p).contains(t)), F.lit(0))
        return F.struct(F.coalesce(F.concat(F.lit("t:"), topic), F.concat(F.lit("p:"), F.lower(p)))
                        .alias("k"), p.alias("p"), F.lower(p).startswith("no ").alias("no"))

    def choose(items: Column) -> Column:
        keys = F.array_distinct(F.transform(items, lambda x: x["k"]))
        return join_phrases(F.transform(keys, lambda k: F.coalesce(
            F.get(F.filter(items, lambda x: (x["k"] == k) & ~x["no"]), F.lit(0))["p"],
            F.get(F.filter(items, lambda x: x["k"] == k), F.lit(0))["p"])))

    return let(F.transform(split_phrases(caption), key), choose)


def _shuffled(phrases: Column, *salt: Column) -> Column:
    """Phrases in the order of a keyed hash, the same on every run and engine."""
    tagged = F.transform(phrases, lambda p: F.struct(
        F.md5(F.concat_ws(":", *salt, p).cast("binary")).alias("h"), p.alias("p")))
    return F.transform(F.array_sort(tagged), lambda x: x["p"])


def shuffle_phrases(caption: Column, key: Column, seed: int) -> Column:
    return join_phrases(_shuffled(split_phrases(caption), F.lit(str(seed)), key.cast("string")))


def permute_phrases(caption: Column, key: Column, limit: int = 5) -> Column:
    """Up to ``limit`` different orders of the phrases, from ``limit * 10`` tries.

    Permutations are joined with "." and no blank.
    """

    def tries(ps: Column) -> Column:
        orders = F.transform(
            F.sequence(F.lit(1), F.lit(limit * 10)),
            lambda k: join_phrases(_shuffled(ps, k.cast("string"), key.cast("string")), "."))
        return F.slice(F.array_distinct(orders), 1, limit)

    return let(split_phrases(caption), tries)


def phrase_topics(caption: Column, topics: list[str]) -> Column:
    """First topic contained in each phrase, null if none; blank phrases included."""
    phrases = F.transform(F.split(F.regexp_replace(caption, "^[.]+|[.]+$", ""), "[.]"), stripped)
    return F.transform(phrases, lambda p: F.get(
        F.filter(_texts(topics), lambda t: p.contains(t)), F.lit(0)))


def is_valid_caption(caption: Column, topics: list[str]) -> Column:
    """Every phrase has a topic and no topic is spoken of twice."""
    return let(phrase_topics(caption, topics), lambda ts: ~F.exists(
        ts, lambda t: t.isNull()) & (F.size(F.array_distinct(ts)) == F.size(ts)))


def bucket_phrase(phrase: Column, patterns: list[str]) -> Column:
    """First pattern contained in a phrase, else ``Other``; a tree is not a giant."""
    hit = F.get(F.filter(_texts(patterns), lambda t: phrase.contains(t) & ~(
        (t == "tree") & phrase.contains("giant"))), F.lit(0))
    return F.coalesce(hit, F.lit("Other"))


def pad_phrases(caption: Column, length: int, strict: bool = True) -> Column:
    """Phrases filled up with blanks; too many phrases are an error when strict."""

    def fill(ps: Column) -> Column:
        padded = F.concat(ps, F.array_repeat(F.lit(""), F.greatest(F.lit(0), length - F.size(ps))))
        if not strict:
            return padded
        return F.when(F.size(ps) > length, F.raise_error(F.lit(
            f"caption has more than {length} phrases")).cast("array<string>")).otherwise(padded)

    return let(split_phrases(caption), fill)


def strip_absence(caption: Column, feature: str) -> Column:
    """Remove the "no ... feature" wordings, plural before singular."""
    out = caption
    for lead in ("no broken ", "no ", "no upside down "):
        for tail in ("s", ""):
            out = F.replace(out, F.lit(f"{lead}{feature}{tail}"), F.lit(""))
    return stripped(out)


def entrance_direction(caption: Column) -> Column:
    return F.regexp_extract(caption, r"entrance direction ([^.]*)\.", 1)


def max_length(captions: Column) -> Column:
    """Aggregate: longest caption in words, periods counted, plus 5."""
    spaced = F.trim(F.regexp_replace(F.replace(captions, F.lit("."), F.lit(" .")), r"\s+", " "))
    return F.max(F.size(F.split(spaced, " "))) + 5
