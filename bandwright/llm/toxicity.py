"""Toxicity scores: FTRL-proximal logistic regression over hashed word features.

Features are the words of a text (runs of letters and digits, A-Z as a-z), their stems
(first STEMS bytes, for words with many endings), its pairs of neighbouring words and its
pairs one word apart, each hashed to one of 2**BITS coordinates; a text has a coordinate
or not, however often. The fit sees the coordinates
of one text at a time, with a learning rate of its own for each, and its L1 term leaves
few weights that are not 0; these are broadcast to score every text.

The fit takes labelled rows only, about FIT_ROWS of them at most (a hash of the id picks
them), in one task, in the order of their ids; it never sees held-out rows. Everything
else is one scan.

Null and empty texts get the score of the intercept. Rows without a label or id are not
fitted but scored. Without any labelled row every score is 0.25. Repeated rows count each
time. Input columns that carry a result's name are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.llm.frames import beside, extended, mapped, without
from bandwright.llm.words import NOT_ALNUM, mix, plain, slices, stem_hashes, window_hashes, words

BITS = 20
FIT_ROWS = 12_000
STEMS = (4, 5, 6, 7)
# Bytes of text whose features are held at once; they take about a hundred times as much.
FEATURE_BYTES = 1 << 18
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 1.0
FOLDS = 5
RESULTS = ["held_out", "score", "predicted"]


class Weights(NamedTuple):
    """The intercept and the coordinates whose weights are not 0."""

    intercept: float
    places: np.ndarray
    values: np.ndarray


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and coordinates of everything in the rows' texts, repeats included."""
    found = words(texts, NOT_ALNUM)
    h = found.hashes
    row = np.repeat(np.arange(len(texts)), np.diff(found.first))
    rows, places = [row], [mix(h)]
    for size in STEMS:
        longer, stems = stem_hashes(found, size)
        rows.append(row[longer])
        places.append(stems)
    if len(h) > 1:
        same = row[1:] == row[:-1]
        rows.append(row[1:][same])
        places.append(window_hashes(h, 2)[same])
    if len(h) > 2:
        same = row[2:] == row[:-2]
        rows.append(row[2:][same])
        # The pair one word apart: both words' hashes with the gap as a word of its own.
        places.append(mix(h[:-2] * np.uint64(3) + mix(h[2:]))[same])
    return np.concatenate(rows), (np.concatenate(places) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """State of the fit; the last coordinate is the intercept, which L1 leaves alone."""

    def __init__(self, positive: int, total: int):
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        share = (positive + 0.5) / (total + 2)
        self.prior = math.log(share / (1 - share))
        self.z0 = self.n0 = 0.0

    def _intercept(self) -> float:
        return self.prior - self.z0 / ((BETA + math.sqrt(self.n0)) / ALPHA + L2)

    def weights(self, places: np.ndarray) -> np.ndarray:
        z = self.z[places]
        free = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -free / ((BETA + np.sqrt(self.n[places])) / ALPHA + L2)

    def learn(self, places: np.ndarray, label: int) -> None:
        w, b = self.weights(places), self._intercept()
        g = _logistic(b + w.sum()) - label
        n = self.n[places]
        self.z[places] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[places] = n + g * g
        self.z0 += g - (math.sqrt(self.n0 + g * g) - math.sqrt(self.n0)) / ALPHA * (b - self.prior)
        self.n0 += g * g

    def result(self) -> Weights:
        places = np.flatnonzero(np.abs(self.z) > L1)
        return Weights(self._intercept(), places, self.weights(places))


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-min(max(x, -30.0), 30.0)))


def fit(texts: pa.Array, labels: list[int]) -> Weights:
    """Weights after EPOCHS passes over the rows in the given order."""
    model = Ftrl(sum(labels), len(labels))
    for _ in range(EPOCHS):
        for lo, hi in slices(texts, FEATURE_BYTES):
            rows, places = features(texts.slice(lo, hi - lo))
            keys = np.unique(rows << BITS | places)
            cuts = np.searchsorted(keys, np.arange(hi - lo + 1) << BITS)
            keys &= (1 << BITS) - 1
            for i in range(hi - lo):
                model.learn(keys[cuts[i]:cuts[i + 1]], labels[lo + i])
    return model.result()


def scores(texts: pa.Array, weights: Weights) -> np.ndarray:
    dense = np.zeros(1 << BITS)
    dense[weights.places] = weights.values
    known = dense != 0
    out = np.empty(len(texts))
    for lo, hi in slices(texts, FEATURE_BYTES):
        rows, places = features(texts.slice(lo, hi - lo))
        hit = known[places]
        keys = np.unique(rows[hit] << BITS | places[hit])
        sums = np.bincount(keys >> BITS, dense[keys & ((1 << BITS) - 1)], minlength=hi - lo)
        out[lo:hi] = 1 / (1 + np.exp(-np.clip(sums + weights.intercept, -30, 30)))
    return out


def fold(key: str) -> Column:
    """0 for held-out rows, else 1 to FOLDS - 1; ids are hashed as text."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text") -> Weights:
    """Weights fitted on the labelled rows that are not held out, about FIT_ROWS at most."""
    usable = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).dropna()
    # An id labelled more than once is toxic if one of its labels says so.
    usable = usable.where(fold("_key") != 0).groupBy("_key").agg(F.max("_label").alias("_label"))
    share = FIT_ROWS / max(FIT_ROWS, usable.count())
    chosen = usable.where(F.pmod(F.xxhash64("_key"), F.lit(1_000_000)) < int(share * 1_000_000))
    # At most about FIT_ROWS pairs of numbers.
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key")
    rows = _row_bound(rows)

    def task(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_key", "ascending"), ("_text", "ascending")])
        w = fit(plain(table["_text"]), table["_label"].to_pylist())
        return pa.table({"place": np.append(w.places, -1), "value": np.append(w.values, w.intercept)})

    found = rows.groupBy(F.lit(0).alias("_all")).applyInArrow(task, "place bigint, value double").collect()
    values = {r.place: r.value for r in found}
    intercept = values.pop(-1, math.log(0.25 / 0.75))
    places = np.array(sorted(values), np.int64)
    return Weights(intercept, places, np.array([values[p] for p in places.tolist()], float))


def _row_bound(rows: DataFrame) -> DataFrame:
    """The rows, where ids repeat so often that they pass the bound about FIT_ROWS different ones of them."""
    if rows.count() <= FIT_ROWS * 1.1:
        return rows
    different = rows.dropDuplicates(["_key", "_text"])
    share = FIT_ROWS / max(FIT_ROWS, different.count())
    return different.where(F.pmod(F.xxhash64("_key", "_text", F.lit(1)), F.lit(1_000_000)) < int(share * 1_000_000))


def score(docs: DataFrame, weights: Weights, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with held_out, score (0 to 1) and predicted (1 if score >= 0.5)."""
    docs = without(docs, RESULTS)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield beside(batch, {"score": pa.array(scores(plain(batch.column(text)), shared.value))})

    scored = mapped(docs, run, extended(docs, [("score", "double")]))
    return scored.withColumn("held_out", F.coalesce(fold(key) == 0, F.lit(False))).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def clean(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that the fitted model doesn't call toxic, with their own columns."""
    weights = train(docs, labels, label, key, text)
    own = docs.withColumnsRenamed({c: f"_own_{c}" for c in RESULTS})
    kept = score(own, weights, key if key not in RESULTS else f"_own_{key}", text).where("predicted = 0")
    return kept.drop(*RESULTS).withColumnsRenamed({f"_own_{c}": c for c in RESULTS})
