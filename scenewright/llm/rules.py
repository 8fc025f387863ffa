"""Quality classifier: a sparse rule ensemble.

1. Statistics of every text are Spark column expressions.
2. Boosted shallow trees are grown on a bounded sample of labelled rows; every
   path from a root is a rule, a conjunction of bounds on statistics.
3. A logistic model with lasso penalty weighs the rules; most weights are zero.
4. The rules that are left are compiled to one column expression, which scores
   all rows inside the scan.

Bound: at most ``TRAIN_ROWS`` labelled rows, the first by a hash of their id, are
brought to the driver as a dozen numbers each. Rows whose crc32(doc_id) mod 3 is
1 are never among them. Labels, lang, source and doc_id are no inputs of a score.

Defined cases: null text counts as empty and is scored; rows with a null doc_id
are left out; without labelled rows every score is 0.5; several labels of one
document are several training rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewright.functions.binding import let
from scenewright.llm.corpus import id_and_text
from scenewright.llm.lines import lines_of, words_of

TRAIN_ROWS = 6000
TREES, DEPTH, BINS, SHRINK = 24, 3, 32, 0.3
LASSO, STEPS = 0.0015, 1500


def statistics(text: Column) -> Column:
    """A struct of doubles; every ratio of an empty text is 0."""
    text = F.coalesce(text, F.lit(""))
    per = lambda a, b: (a / F.greatest(b, F.lit(1))).cast("double")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    length = F.length(text)

    def of_words(w: Column) -> Column:
        n = F.size(w)
        return F.struct(
            F.log1p(n.cast("double")).alias("log_words"),
            per(length, n).alias("chars_per_word"),
            per(F.size(F.array_distinct(w)), n).alias("distinct_words"),
            per(F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1)))), n).alias("same_as_before"),
            per(count(r"[#*$%&|<>]"), n).alias("symbols"),
            per(count(r"[!?]"), n).alias("exclaims"),
            per(count(r"[.,;:]"), n).alias("stops"))

    def of_lines(lines: Column) -> Column:
        n = F.size(lines)
        return F.struct(
            per(F.size(w_all), n).alias("words_per_line"),
            per(n - F.size(F.array_distinct(lines)), n).alias("repeated_lines"),
            per(F.size(F.filter(lines, lambda x: x.rlike(r"[.!?][\s\"')]*$"))), n).alias("closed_lines"))

    w_all = words_of(text)
    return F.struct(
        let(w_all, of_words).alias("w"), let(lines_of(text), of_lines).alias("l"),
        per(count(r"\p{Lu}"), length).alias("capitals"), per(count(r"\p{Nd}"), length).alias("digits"))


NAMES = ["log_words", "chars_per_word", "distinct_words", "same_as_before", "symbols", "exclaims", "stops",
         "words_per_line", "repeated_lines", "closed_lines", "capitals", "digits"]


def with_statistics(docs: DataFrame) -> DataFrame:
    return (docs.withColumn("_s", statistics(F.col("text")))
            .select(*docs.columns, "_s.w.*", "_s.l.*", "_s.capitals", "_s.digits"))


def _tree(x, edges, gradient, hessian, depth):
    """Paths of one regression tree: (conditions, step) of every node; leaves move the score."""
    rules, step = [], np.zeros(len(x))

    def grow(rows, path, left):
        g, h = gradient[rows].sum(), hessian[rows].sum()
        best = (1e-6, None, None)
        if left:
            for f in range(x.shape[1]):
                bins = np.searchsorted(edges[f], x[rows, f], "left")  # bin b: value <= edges[b]
                gs = np.cumsum(np.bincount(bins, gradient[rows], len(edges[f]) + 1))[:-1]
                hs = np.cumsum(np.bincount(bins, hessian[rows], len(edges[f]) + 1))[:-1]
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(hs < 1) | (h - hs < 1)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), f, edges[f][int(gain.argmax())])
        _, f, cut = best
        if f is None:
            step[rows] = g / (h + 1)
            return
        for low in (True, False):
            part = rows[(x[rows, f] <= cut) == low]
            rules.append(path + ((f, low, float(cut)),))
            grow(part, rules[-1], left - 1)

    grow(np.arange(len(x)), (), depth)
    return rules, step


def holds(x: np.ndarray, rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, low, cut in rule:
        out &= (x[:, f] <= cut) == low
    return out


def learn(x: np.ndarray, y: np.ndarray):
    """(intercept, [(weight, rule)]) with rules as tuples of (statistic, at most, bound)."""
    if not len(y):
        return 0.0, []
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    prior = float(np.log(rate / (1 - rate)))
    if y.min() == y.max():
        return prior, []
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    score, rules = np.full(len(y), prior), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        paths, step = _tree(x, edges, y - p, p * (1 - p), DEPTH)
        rules.update(dict.fromkeys(tuple(sorted(r)) for r in paths))
        score += SHRINK * step
    rules = list(rules)
    a = np.stack([holds(x, r) for r in rules], axis=1).astype(float)
    # lasso by accelerated proximal gradient steps; the intercept is not penalised
    rate_l = 4 / (np.linalg.norm(a, 2) ** 2 / len(y) + 1)
    w = z = np.zeros(len(rules))
    b = prior
    t = 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(a @ z + b)))
        new = z - rate_l * (a.T @ (p - y) / len(y))
        new = np.sign(new) * np.maximum(np.abs(new) - rate_l * LASSO, 0)
        b -= rate_l * float((p - y).mean())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return float(b), [(float(k), r) for k, r in zip(w, rules) if k != 0]


def compiled(model) -> Column:
    """The score as one column expression over the statistics."""
    intercept, weighed = model
    total = F.lit(intercept)
    for weight, rule in weighed:
        met = F.lit(True)
        for f, low, cut in rule:
            met = met & ((F.col(NAMES[f]) <= cut) if low else (F.col(NAMES[f]) > cut))
        total = total + F.when(met, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = TRAIN_ROWS):
    """Learn from at most ``rows`` labelled documents that are not held out."""
    sample = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("double").alias("y"))
              .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out())
              .orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows))
    got = with_statistics(id_and_text(docs).join(F.broadcast(sample), "doc_id")).select("y", *NAMES).collect()
    data = np.array(sorted(tuple(r) for r in got), float).reshape(len(got), 1 + len(NAMES))
    return learn(data[:, 1:], (data[:, 0] > 0.5).astype(float))


def score_quality(docs: DataFrame, labels: DataFrame, target: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train(docs, labels, target)
    scored = with_statistics(id_and_text(docs)).withColumn("score", compiled(model))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
