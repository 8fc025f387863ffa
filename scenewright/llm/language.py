"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased; runs of one to three characters are hashed to 2**14
features. Inverse document frequencies come from all documents that may be
learned from; the classifier is trained by follow-the-regularised-leader
(FTRL-proximal) with L1 and L2 penalties on a bounded sample, at most
``PER_LANGUAGE`` documents a language, chosen by a hash of their id; a fifth of
the sample is kept back to fit the temperature of the scores. Rows whose
crc32(doc_id) mod 3 is 1 take no part in any of it.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
rows with a null doc_id are left out; with nothing to learn from everything is
``und``; ties go to the first language in order; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenewright.llm import arrays as A
from scenewright.llm.rules import held_out

BITS = 14
DIM = 1 << BITS
PER_LANGUAGE = 1000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.02, 3
UNKNOWN = "und"


def features(texts: pa.Array):
    """For each text its distinct features and their counts."""
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    for a, b, _, _ in A.slices(texts, 1 << 20):
        part = texts.slice(a, b - a).to_pylist()
        codes = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32).astype(np.uint64)
        one = codes * np.uint64(0x9E3779B97F4A7C15)
        two = (one[:-1] ^ (codes[1:] * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0xD6E8FEB86659FD93)
        three = (two[:-1] ^ (codes[2:] * np.uint64(0x165667B19E3779F9))) * np.uint64(0xFF51AFD7ED558CCD)
        grams = [(h >> np.uint64(64 - BITS)).astype(np.uint16) for h in (one, two, three)]
        at = 0
        for text in part:
            end = at + len(text)
            own = np.concatenate([g[at : max(at, end - n)] for n, g in enumerate(grams)])
            counts = np.bincount(own, minlength=DIM) if len(own) > DIM // 2 else None
            if counts is None:
                yield np.unique(own, return_counts=True)
            else:
                seen = np.flatnonzero(counts)
                yield seen.astype(np.uint16), counts[seen]
            at = end


def _frequencies(batches):
    total, n = np.zeros(DIM, np.int64), 0
    for batch in batches:
        for seen, _ in features(batch.column(0)):
            total[seen] += 1
            n += 1
    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.append(total, n).tobytes()], pa.binary())],
                                     ["part", "counts"])


def _add(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(b, np.int64) for b in table["counts"].to_pylist()], axis=0)
    return pa.table({"part": table["part"].slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def _sample(batches):
    for batch in batches:
        rows = [(s.astype("<u2").tobytes(), c.astype("<i4").tobytes()) for s, c in features(batch.column(2))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.binary()),
             pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "lang", "seen", "counts"])


def weigh(seen: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF with damped counts, at unit length."""
    x = (1 + np.log(counts)) * idf[seen]
    return x / max(1e-12, float(np.sqrt(x @ x)))


def _softmax(z):
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """FTRL-proximal with one weight vector per class; a bias is feature ``DIM``."""

    def __init__(self, classes: int):
        self.z, self.n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def step(self, at, x, label: int) -> None:
        w = self.weights(at)
        error = _softmax(x @ w)
        error[label] -= 1
        g = x[:, None] * error[None, :]
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fit(rows, idf):
    """(languages, weights, temperature) from (doc_id, lang, seen, counts) rows."""
    languages = sorted({r[1] for r in rows})
    data = []
    for _, lang, seen, counts in rows:
        seen = np.frombuffer(seen, "<u2").astype(np.int64)
        x = weigh(seen, np.frombuffer(counts, "<i4"), idf)
        data.append((np.append(seen, DIM), np.append(x, 0.1), languages.index(lang)))
    model = Ftrl(len(languages))
    back = data[::5] if len(data) >= 50 else data
    learn = [d for i, d in enumerate(data) if i % 5] if len(data) >= 50 else data
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(learn)):
            model.step(*learn[i])
    w = model.weights(slice(None))
    logits, label = np.array([x @ w[at] for at, x, _ in back]), np.array([d[2] for d in back])
    loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(label)), label] + 1e-12).mean()
    grid = np.exp(np.linspace(np.log(0.02), np.log(5), 60))
    return languages, w, float(min(grid, key=loss))


def _predict(batches, languages, w, temperature, idf):
    for batch in batches:
        texts = batch.column(2)
        lettered = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False))
        pred, score = [], []
        for ok, (seen, counts) in zip(lettered.tolist(), features(texts)):
            if not ok or not languages:
                pred.append(UNKNOWN)
                score.append(0.0)
                continue
            p = _softmax((weigh(seen, counts, idf) @ w[seen] + 0.1 * w[DIM]) / temperature)
            best = int(p.argmax())
            pred.append(languages[best])
            score.append(float(p[best]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()),
                                          pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE):
    """(languages, weights, temperature, idf) learned from rows (doc_id, text, lang) that are not held out."""
    learnable = docs.where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    got = (learnable.select("text").mapInArrow(_frequencies, "part int, counts binary")
           .groupBy("part").applyInArrow(_add, "part int, counts binary").collect())
    total = np.frombuffer(got[0]["counts"], np.int64) if got else np.zeros(DIM + 1, np.int64)
    idf = np.log((1 + total[DIM]) / (1 + total[:DIM])) + 1
    counts = learnable.groupBy("lang").count().collect()  # a row per language
    share = F.lit(0.0)
    for lang, n in counts:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    chosen = learnable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)
    rows = (chosen.select("doc_id", "lang", "text")
            .mapInArrow(_sample, "doc_id long, lang string, seen binary, counts binary").collect())
    rows = sorted((tuple(r) for r in rows), key=lambda r: (hash_order(r[0]), r[0]))
    languages, w, temperature = fit(rows, idf) if rows else ([], np.zeros((DIM + 1, 0)), 1.0)
    return languages, w.astype(np.float32), temperature, idf


def hash_order(doc_id: int) -> int:
    return (doc_id * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document of (doc_id, text, lang)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang")).where(F.col("doc_id").isNotNull())
    languages, w, temperature, idf = train(docs)
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        lambda batches: _predict(batches, languages, w, temperature, idf),
        "doc_id long, held_out boolean, lang_pred string, score double")
