"""Line-first cleaning, on DataFrame functions only.

Every line of a text is judged by rules on punctuation, navigation, boilerplate
and repetition. Failing lines go; a document that loses too much of its text, or
fails the document-level base rules, is rejected.

Line rules (a line without a word is neither good nor bad):

* navigation: at least two separators (``|``, arrows, bullets) and one to every six
  words, or symbols on at least a fifth of its words;
* punctuation: exclamation or question marks doubled on a third of its words, or
  (long lines) mostly capitals;
* boilerplate: phrases of menus, cookie notices and legal footers, one to every
  twelve words;
* repetition: a third of its words equal the word before, or the line is equal to
  an earlier line of the document.

Windows are compared by a 64-bit hash of their eight words. Everything is per
row: no shuffle, no Python.

All rules but that of two separators are shares of the line, so a long article on
one line is not lost for a phrase in it, and a menu of any length is.

Defined cases: null, empty and blank texts have no words, fail the base rules
and are rejected; very long texts are judged whole; repeated rows get the same
verdict each; a share that is met exactly fails the line; an empty table stays
empty; other columns stay as they are, also when they share names
with the statistics (those are in one struct).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewright.functions.binding import let

GAP = r"[\x20\x09-\x0D]"
SOLID = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: A document goes if its failing lines hold more than this share of its word characters.
MAX_LOST = 0.5
#: A line fails with at least one separator, or one phrase, to so many words.
WORDS_PER_SEPARATOR, WORDS_PER_PHRASE = 6, 12
SEPARATOR = r"[|•»→]"
SHOUT = r"(?:!!|\?\?|!\?)"
BOILERPLATE = (r"(?i)\b(?:all rights reserved|terms of (?:use|service)|privacy policy|cookie (?:policy|settings)|"
               r"accept (?:all )?cookies|enable javascript|skip to (?:main )?content|sign in|log in|subscribe now|"
               r"click here|share (?:this|on)|read more|back to top)\b")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP + "+", -1), lambda w: w != "")


def lines_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line: line.rlike(SOLID))


def _covered(hashes: Column) -> Column:
    """Words in windows that occur at least twice: positions by hash, then a sweep."""
    def repeated(rows: Column) -> Column:
        def twin(row: Column, i: Column) -> Column:
            before = (i > 0) & (F.get(rows, i - 1)["h"] == row["h"])
            after = (i < F.size(rows) - 1) & (F.get(rows, i + 1)["h"] == row["h"])
            return before | after
        return F.sort_array(F.transform(F.filter(rows, twin), lambda r: r["p"]))

    rows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    swept = F.aggregate(
        let(rows, repeated),
        F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(WINDOW), p - a["at"])).cast("long").alias("n")))
    return swept["n"]


def repeat_words(words: Column) -> Column:
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW),
                         lambda i: F.xxhash64(F.slice(words, i + 1, F.lit(WINDOW))))
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h))
               .otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) > WINDOW, some).otherwise(F.lit(0).cast("long"))


def failing(line: Column) -> Column:
    """The line's own rules, without repetition."""
    def stutters(w: Column) -> Column:
        return 3 * F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1)))) >= F.size(w)

    n = F.greatest(F.size(F.split(F.btrim(line), GAP + "+")), F.lit(1))
    count = lambda pattern: F.regexp_count(line, F.lit(pattern))
    capitals = (F.length(line) >= 20) & (2 * count(r"\p{Lu}") > count(r"\p{L}"))
    menu = let(count(SEPARATOR), lambda c: (c >= 2) & (WORDS_PER_SEPARATOR * c >= n))
    phrases = line.rlike(BOILERPLATE) & (WORDS_PER_PHRASE * count(BOILERPLATE) >= n)
    return (menu | (5 * count(SYMBOLS) >= n) | (3 * count(SHOUT) >= n) | capitals
            | phrases | let(words_of(line), stutters))


def statistics(text: Column) -> Column:
    """One struct with the base statistics and the verdict."""
    def body(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeat_words(words).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        def good(distinct: Column) -> Column:
            return F.filter(distinct, lambda line: ~failing(line))
        return let(F.array_distinct(lines), lambda distinct: F.struct(
            (F.size(lines) - F.size(distinct)).cast("long").alias("n_dup_lines"),
            F.size(lines).cast("long").alias("n_lines"),
            good(distinct).alias("good_lines")))

    symbols = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SYMBOLS)).cast("long")
    return F.struct(let(words_of(text), body).alias("w"), let(lines_of(text), of_lines).alias("l"),
                    symbols.alias("n_symbols"))


def clean_lines(docs: DataFrame, text: str = "text", into: str = "cleaning") -> DataFrame:
    """Add a struct: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean_text, n_lines,
    n_good_lines."""
    s = F.col("`_statistics`")
    solid = F.regexp_replace(F.array_join(s["l"]["good_lines"], ""), GAP, "")
    n, chars, repeats = s["w"]["n_words"], s["w"]["word_chars"], s["w"]["n_repeat_words"]
    base_failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
    kept = ~base_failed & (F.length(solid) >= (1 - MAX_LOST) * chars)
    return (docs.withColumn("_statistics", statistics(F.col(f"`{text}`")))
            .withColumn(into, F.struct(
                n.alias("n_words"), chars.alias("word_chars"), s["n_symbols"].alias("n_symbols"),
                s["l"]["n_dup_lines"].alias("n_dup_lines"), repeats.alias("n_repeat_words"),
                base_failed.alias("base_failed"), kept.alias("kept"),
                F.array_join(s["l"]["good_lines"], "\n").alias("clean_text"),
                s["l"]["n_lines"].alias("n_lines"), F.size(s["l"]["good_lines"]).cast("long").alias("n_good_lines")))
            .drop("_statistics"))
