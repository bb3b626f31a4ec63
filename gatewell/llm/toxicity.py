"""Toxicity by non-negative positive-unlabelled learning (operator 2).

Confirmed toxic documents (P) and unlabelled ones (U) train a linear classifier g. With the class prior pi and the
logistic loss l, the risk is pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)]): the second part is the risk
on true negatives, corrected for the toxic documents among U, and held from going below zero.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewell.llm.common import bounded_sample, crc_mod, small_batches, stored, table

_WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)


def word_features(word: str) -> list[str]:
    """A word, and its first letters: stems carry over to inflected and compound words."""
    return [word + "$", *(word[:k] for k in PREFIXES if len(word) >= k)]


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def document_features(text: str | None) -> set[str]:
    return {f for w in words_of(text) for f in word_features(w)}


def copy_keys(text: str | None) -> list[int]:
    """Two min-hashes of the five-word shingles; near copies share one of them as a rule."""
    words = (text or "").lower().split()
    hashes = [zlib.crc32(" ".join(words[i : i + 5]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 4))]
    return [min(hashes), min((h * 2654435761 + 1) & 0xFFFFFFFF for h in hashes)]


@dataclass
class Toxicity:
    """weights by feature; a document's logit is the bias and the weights of the features that it has."""

    weights: dict[str, float]
    bias: float

    def scores(self, texts: list[str | None], memo: dict[str, tuple[str, ...]], room: int = 500_000) -> np.ndarray:
        """The scores of whole texts; memo remembers which weighted features a word has, for up to `room` words at a time."""
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            held: set[str] = set()
            for w in words_of(text):
                has = memo.get(w)
                if has is None:
                    if len(memo) >= room:
                        memo.clear()
                    has = memo[w] = tuple(f for f in word_features(w) if f in self.weights)
                if has:
                    held.update(has)
            out[i] = self.bias + sum(self.weights[f] for f in sorted(held))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit_nnpu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk, by Adam over all rows; p and u are 0/1 feature matrices.

    Where the corrected negative risk is below zero, the step goes up its gradient instead, which undoes overfitting.
    """
    d = p.shape[1]
    theta, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    theta[d] = np.log(prior / (1 - prior))
    one = lambda x: np.hstack([x, np.ones((len(x), 1), x.dtype)])
    p, u = one(p.astype(np.float32)), one(u.astype(np.float32))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        gp, gu = p @ theta.astype(np.float32), u @ theta.astype(np.float32)
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        grad_positive = -prior * (p.T @ (1 - sigmoid(gp))) / len(p)
        grad_negative = u.T @ sigmoid(gu) / len(u) - prior * (p.T @ sigmoid(gp)) / len(p)
        grad = (grad_positive + grad_negative if negative >= 0 else -grad_negative) + ridge * np.append(theta[:d], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:d], float(theta[d])


def _features_of(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            fs, keys = [sorted(document_features(t)) for t in texts], [copy_keys(t) for t in texts]
            columns = [pa.array([k[i] for k in keys], pa.int64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("p"), pa.array(fs, pa.list_(pa.string())), *columns], ["doc_id", "p", "f", "k0", "k1"])

    found = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "p", "text").mapInArrow(run, "doc_id long, p int, f array<string>, k0 long, k1 long")
    for k in ("k0", "k1"):  # of near copies one stays, so that no group of copies teaches its own words
        first = found.groupBy("p", k).agg(F.min("doc_id").alias("doc_id"))
        found = found.join(first, ["p", k, "doc_id"], "left_semi").dropDuplicates(["p", k])
    return found.select("p", "f")


def train(docs: DataFrame, labels: DataFrame, rows: int = 2_500, features: int = 1_000, least_worth: float = 4.0) -> Toxicity:
    """Learns from at most `rows` confirmed toxic documents and four times as many unlabelled ones, bounded samples by hash.

    Labels are read only of rows whose crc32(doc_id as text) modulo 5 is not 0: the toxic ones among them are P, and
    their share is the class prior. U is taken from all documents, whatever their labels. The model looks at the
    `features` features that most tell P from U by the likelihood ratio, if that is over `least_worth`. Without toxic rows nothing is learned, and all scores are near 0.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(crc_mod("doc_id", 5) != 0)
    shares = known.agg(F.avg("y").alias("prior")).first()
    prior = min(0.9, max(1e-4, shares.prior or 0.0))
    p = bounded_sample(known.filter("y = 1").select("doc_id").distinct(), ["doc_id"], rows).withColumn("p", F.lit(1))
    u = bounded_sample(docs.filter("doc_id is not null").select("doc_id").distinct(), ["doc_id"], 4 * rows).withColumn("p", F.lit(0))
    chosen = F.broadcast(p.unionByName(u))  # at most 5 * rows pairs of numbers
    sample = stored(_features_of(docs.select("doc_id", "text").join(chosen, "doc_id")), "toxicity")
    size = {r.p: r.n for r in sample.groupBy("p").agg(F.count("*").alias("n")).collect()}
    if not size.get(1):
        return Toxicity({}, -10.0)
    rate_p, rate_u = F.col("np") / size[1], (F.col("nu") + 1) / (size.get(0, 0) + 2)
    counts = sample.select("p", F.explode("f").alias("f")).groupBy("f").agg(F.sum("p").alias("np"), F.sum(1 - F.col("p")).alias("nu"))
    worth = 2 * F.col("np") * F.log(rate_p / rate_u) + 2 * (size[1] - F.col("np")) * F.log((1 - rate_p + 1e-9) / (1 - rate_u + 1e-9))
    told = counts.filter("np >= 2").withColumn("worth", worth).filter(rate_p > 1.5 * rate_u).filter(F.col("worth") > least_worth).orderBy(F.desc("worth"), "f").limit(features).select("f").collect()
    names = [r.f for r in told]
    if not names:  # nothing tells the classes apart: the prior is all there is
        return Toxicity({}, float(np.log(prior / (1 - prior))))
    at = {f: i for i, f in enumerate(names)}
    x = {k: [] for k in (0, 1)}
    # of each sampled document the driver gets only which of the `features` features it has
    listed = F.array(*[F.lit(f) for f in names]).cast("array<string>")
    for r in sample.select("p", F.array_sort(F.array_intersect("f", listed)).alias("f")).collect():
        row = np.zeros(len(names), np.float32)
        row[[at[f] for f in r.f]] = 1
        x[r.p].append(row)
    order = lambda a: a[np.lexsort(a.T)] if a.size else a  # noqa: E731  so that reruns agree to the last bit
    xp, xu = (order(np.array(x[k], np.float32).reshape(-1, len(names))) for k in (1, 0))
    if not len(xu):
        return Toxicity({}, 0.0)
    w, bias = fit_nnpu(xp, xu, prior)
    return Toxicity({f: float(v) for f, v in zip(names, w, strict=True)}, bias)


def score_toxicity(docs: DataFrame, model: Toxicity) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; null texts count as empty, and a null doc_id isn't held out."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            s = shared.value.scores(batch.column("text").to_pylist(), memo)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 5) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
