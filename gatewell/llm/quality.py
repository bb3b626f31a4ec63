"""Quality scores from preference pairs: Bradley-Terry ranking (operator 6).

Each labelled good document is preferred to each labelled poor one. The model gives a document the score w.x,
and a pair the log-odds w.(x_better - x_worse); w minimises the logistic loss over pairs. A threshold is set
at a quantile of the training documents' scores, and scores are mapped to 0..1 around it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewell.llm.common import bounded_sample, crc_mod, small_batches, table

#: Code points below 128: 0 other, 1 lower, 2 upper, 3 digit, 4 prose punctuation, 5 symbol, 6 space, 7 newline. Above: 1.
_CLASS = np.zeros(129, np.uint8)
for _i in range(128):
    _c = chr(_i)
    _CLASS[_i] = 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c in ".,;:?'\"()-" else 7 if _c == "\n" else 6 if _c.isspace() else 5 if 32 < _i < 127 else 0
_CLASS[128] = 1
FEATURES = ("bias", "log_words", "upper", "digits", "punctuation", "symbols", "other", "word_length", "distinct_words", "repeats", "top_word", "distinct_lines", "plain_words", "no_stops", "short_lines")


def features(text: str | None) -> list[float]:
    """The features of one whole text, each in 0..1; an empty or null text has the bias alone."""
    text = text or ""
    words = text.split()
    if not words:
        return [1.0] + [0.0] * (len(FEATURES) - 1)
    points = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 128)
    count = np.bincount(_CLASS[points], minlength=8)
    marks = max(1, len(points) - count[6] - count[7])
    n, distinct = len(words), len(set(words))
    lines = [x for x in text.split("\n") if x]
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    same = sum(map(str.__eq__, words, words[1:]))
    # a text repeats itself less by chance the shorter it is, so distinct words are held against what 3 in 4 new words would give at 100
    return [
        1.0,
        min(1.0, np.log1p(n) / 10),
        count[2] / marks,
        count[3] / marks,
        count[4] / marks,
        count[5] / marks,
        count[0] / marks,
        min(1.0, marks / n / 20),
        min(1.0, distinct / n * max(1.0, np.log1p(n) / 5)),
        same / n,
        max(seen.values()) / n,
        len(set(lines)) / max(1, len(lines)),
        sum(map(str.isalpha, words)) / n,
        float(text.count(".") * 40 < n),
        min(1.0, len(lines) / n * 5),
    ]


@dataclass
class Ranking:
    """Scores are w.x of standardised features; threshold and scale map them to 0..1."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0
    scale: float = 1.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.threshold) / self.scale, -30, 30)))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = 100_000, ridge: float = 1e-3, seed: int = 6) -> Ranking:
    """Newton's method on the logistic loss of feature differences, over at most `pairs` pairs of a good and a poor row.

    Without rows of both kinds nothing is learned: each score is then the share of good rows (one half without rows).
    """
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = x.shape[1]
    if not len(good) or not len(poor):
        out = Ranking(np.zeros(d), np.ones(d), np.zeros(d))
        out.threshold = 0.0 if not len(y) else -2.0 if len(good) else 2.0
        return out
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - mean) / spread, -8, 8)
    rng = np.random.default_rng(seed)
    n = min(pairs, len(good) * len(poor))
    a, b = good[np.resize(rng.permutation(len(good)), n)], poor[rng.integers(0, len(poor), n)]
    diff = z[a] - z[b]
    w = np.zeros(d)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        grad = -diff.T @ (1 - p) / n + ridge * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / n + ridge * np.eye(d)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    out = Ranking(mean, spread, w)
    s = out.raw(x)
    # the score quantile that tells most training rows right; of equal ones, the middle
    order = np.argsort(s, kind="stable")
    wrong = np.concatenate([[0], np.cumsum(y[order] == 1)]) + (y == 0).sum() - np.concatenate([[0], np.cumsum(y[order] == 0)])
    best = np.flatnonzero(wrong == wrong.min())
    k = int(best[len(best) // 2])
    edges = np.concatenate([[s.min() - 1], s[order], [s.max() + 1]])
    out.threshold = float((edges[k] + edges[k + 1]) / 2)
    out.scale = float(max(s.std(), 1e-6) / 2)
    return out


def _with_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(x, pa.list_(pa.float64()))], [*keep, "x"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{schema}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, rows: int = 20_000) -> Ranking:
    """Fits on at most `rows` labelled rows, a bounded sample by hash; rows held out (crc32 of doc_id modulo 3 is 1) teach nothing.

    Labels are 0 or 1; others and nulls are left out. Of the texts, only those of the sampled ids are read for features.
    """
    small_batches(docs.sparkSession)
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(crc_mod("doc_id", 3) != 1).groupBy("doc_id").agg(F.max("y").alias("y"))
    sample = bounded_sample(known, ["doc_id"], rows)  # at most `rows` pairs of numbers, so it may be broadcast
    found = _with_features(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), ["doc_id", "y"]).select("y", "x", "doc_id").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(found["x"].tolist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort([*x.T, found["doc_id"].to_numpy()])  # rows that share an id stand by their features, so that reruns agree
    return fit_pairs(x[order], found["y"].to_numpy(int)[order])


def score_quality(docs: DataFrame, model: Ranking) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; empty and null texts are scored as such, and a null doc_id isn't held out."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column("text").to_pylist()], float).reshape(-1, len(FEATURES))
            s = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 3) == 1).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Ranking) -> DataFrame:
    """The rows of docs whose score is at least one half, whole and with all their columns."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column("text").to_pylist()], float).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(shared.value.score(x) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
