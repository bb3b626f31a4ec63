"""Benchmark decontamination by BM25 with block-max pruning (operator 3).

An inverted index of the test items is built; every passage of every document is a query against it. Scores are
BM25 as shares of the score that an item has with itself, so one threshold holds for all items. Items stand in
blocks; each term has, for each block, the largest weight that it has in any of its items. A document, and then
a passage, is held against a block only if the sum of those largest weights reaches the threshold, which no item
of the block can reach otherwise. What is retrieved is verified by the overlap of question and answer.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewell.llm.common import small_batches, stored, table

_TOKEN = re.compile(r"[^\W_]+")
K1, B = 1.2, 0.75
#: One changed word takes three runs of three words, more than half of those of a part of under eight words.
TELLING = 8


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The tokens of an item's question and answer: its last sentence or line of at least three tokens is the answer; an item of one part is both."""
    parts = [p for p in (tokens(x) for x in re.split(r"(?<=[.!?])\s+|\n+", text)) if p]
    answer: list[str] = []
    while parts and len(answer) < 3:
        answer = parts.pop() + answer
    question = [t for p in parts for t in p]
    return question or answer, answer


def grams(ts: list[str], n: int = 3) -> set[tuple[str, ...]]:
    n = min(n, len(ts))
    return {tuple(ts[i : i + n]) for i in range(len(ts) - n + 1)} if n else set()


@dataclass
class Index:
    """Postings by term, in items' order: items and weights from starts[t] to starts[t + 1]; and the same by block, with the largest weights, and the first of a block's postings."""

    terms: dict[str, int]
    ids: list[int]
    starts: np.ndarray
    items: np.ndarray
    weights: np.ndarray
    block_starts: np.ndarray
    blocks: np.ndarray
    block_weights: np.ndarray
    block_firsts: np.ndarray
    block: int
    window: int
    parts: list[tuple[set, set, set, bool, bool]]
    bare: float


@dataclass
class Counts:
    """What BM25 needs of all items of a benchmark: items with tokens, their tokens and the tokens of the longest; and items by term, of these terms at least that are asked for."""

    items: int
    tokens: int
    longest: int
    df: dict[str, int]


def count(lists: Iterable[list[str]]) -> Counts:
    out = Counts(0, 0, 0, {})
    for ts in lists:
        if ts:
            out.items, out.tokens, out.longest = out.items + 1, out.tokens + len(ts), max(out.longest, len(ts))
            for t in set(ts):
                out.df[t] = out.df.get(t, 0) + 1
    return out


def build_index(items: list[tuple[int, str]], block: int = 8, counts: Counts | None = None) -> Index:
    """The index of (item_id, text). Items without tokens can't be found and are left out; equal texts keep their own ids.

    `counts` are those of the whole benchmark, if the items are only a part of it.
    """
    items = sorted((i, x) for i, x in ((i, text) for i, text in items if text) if tokens(x))
    lists = [tokens(x) for _, x in items]
    counts = counts or count(lists)
    n, mean = counts.items, counts.tokens / max(1, counts.items)
    terms = {t: k for k, t in enumerate(sorted({t for ts in lists for t in ts}))}
    idf = {t: math.log(1 + (n - c + 0.5) / (c + 0.5)) for t, c in ((t, counts.df[t]) for t in terms)}
    rows = []
    for i, ts in enumerate(lists):
        tf: dict[str, int] = {}
        for t in ts:
            tf[t] = tf.get(t, 0) + 1
        w = {t: idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(ts) / mean)) for t, c in tf.items()}
        own = sum(w.values())
        rows += [(terms[t], i, x / own) for t, x in w.items()]
    rows.sort()
    t, i, w = (np.array([r[k] for r in rows]) for k in range(3))
    t, i, w = t.astype(np.int64), i.astype(np.int64), w.astype(float)
    starts = np.searchsorted(t, np.arange(len(terms) + 1))
    first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (i[1:] // block != i[:-1] // block)])) if len(t) else np.empty(0, int)
    largest = np.maximum.reduceat(w, first) if len(t) else w
    window = 2 * max(1, counts.longest)
    split = [question_and_answer(x) for _, x in items]
    parts = [(grams(q), grams(a), grams(ts), len(q) >= TELLING, len(a) >= TELLING) for ts, (q, a) in zip(lists, split, strict=True)]
    return Index(terms, [k for k, _ in items], starts, i, w, np.searchsorted(t[first], np.arange(len(terms) + 1)), i[first] // block, largest, np.append(first, len(t)), block, window, parts, 0.0)


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [low, high), one range after the other."""
    count = high - low
    return np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())


def _bounds(index: Index, ts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block postings of terms ts, and the sum of their largest weights by block."""
    at = _ranges(index.block_starts[ts], index.block_starts[ts + 1])
    return at, np.bincount(index.blocks[at], index.block_weights[at], minlength=-(-len(index.ids) // index.block))


def search(index: Index, text: str | None, threshold: float) -> Iterator[tuple[int, float, int, int]]:
    """All items and passages of the text that reach the threshold with each other: item number, score, and the passage's first and last token.

    Passages are twice as long as the longest item, and begin every item length, so each run of tokens as long as an item is in one.
    """
    ts = tokens(text)
    get = index.terms.get
    ids = np.array([get(t, -1) for t in ts], np.int64)
    at = np.flatnonzero(ids >= 0)
    if not len(at) or (_bounds(index, np.unique(ids[at]))[1] < threshold).all():
        return
    step = index.window // 2
    for begin in range(0, max(1, len(ts) - step), step):
        here = at[np.searchsorted(at, begin) : np.searchsorted(at, begin + index.window)]
        if not len(here):
            continue
        held = np.unique(ids[here])
        lists, bound = _bounds(index, held)
        lists = lists[bound[index.blocks[lists]] >= threshold]
        if not len(lists):
            continue
        # only postings in blocks that may reach the threshold are looked at
        posts = _ranges(index.block_firsts[lists], index.block_firsts[lists + 1])
        score = np.bincount(index.items[posts], index.weights[posts], minlength=len(index.ids))
        for i in np.flatnonzero(score >= threshold):
            yield int(i), float(score[i]), begin, min(len(ts), begin + index.window)


def verify(index: Index, item: int, held: set[tuple[str, ...]], overlap: float, sure: float = 0.75) -> tuple[float, float, bool]:
    """The shares of the question's and of the answer's three-word runs that a passage holds, given its runs of up to three words; and whether it holds the item.

    It does if both shares reach `overlap`. Where a part has too few words to tell, as one changed word or its absence
    may take all its runs, it also does if it holds `overlap` of the whole item's runs and a high share, `sure`, of the
    other part's; if neither part tells, `sure` of the whole item's.
    """
    question, answer, whole, asks, answers = index.parts[item]
    share = lambda p: sum(g in held for g in p) / max(1, len(p))
    q, a = share(question), share(answer)
    if min(q, a) >= overlap or asks and answers:
        return q, a, min(q, a) >= overlap
    all_runs = share(whole)
    return q, a, all_runs >= overlap and (q if asks else a if answers else all_runs) >= sure


def verified(index: Index, text: str | None, threshold: float, overlap: float) -> Iterator[tuple[int, float, float, float]]:
    """Item number, score and both overlaps of each passage that reaches the threshold with an item and holds it."""
    ts, at, held = None, None, set()
    for i, score, begin, end in search(index, text, threshold) if index.ids else ():
        ts = ts or tokens(text)
        if at != begin:
            at, held = begin, set().union(*(grams(ts[begin:end], n) for n in (1, 2, 3)))
        q, a, holds = verify(index, i, held, overlap)
        if holds:
            yield i, score, q, a


def _counted(rows: DataFrame) -> DataFrame:
    """(shard, term, n) over rows (shard, text): items by term, in the shard. The null term of a shard comes with its items, tokens and longest item too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists: dict[int, list] = {}
            for k, text in zip(batch.column("shard").to_pylist(), batch.column("text").to_pylist(), strict=True):
                lists.setdefault(k, []).append(tokens(text))
            out = []
            for k, c in ((k, count(x)) for k, x in lists.items()):
                out += [(k, None, c.items, c.tokens, c.longest), *((k, t, m, 0, 0) for t, m in c.df.items())]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["shard", "term", "n", "tokens", "longest"])

    counted = rows.select("shard", "text").mapInArrow(run, "shard long, term string, n long, tokens long, longest long")
    return counted.groupBy("shard", "term").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"), F.max("longest").alias("longest"))


def indexes(benchmark: DataFrame, items_each: int = 20_000) -> Iterator[Index]:
    """The benchmark in indexes of at most about `items_each` items, each small enough to go to all tasks. All weigh terms, and cut passages, by the counts of the whole benchmark."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").distinct()
    shards = max(1, -(-rows.count() // items_each))
    if shards == 1:
        yield build_index([(r.item_id, r.text) for r in rows.collect()])
        return
    rows = stored(rows.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))), "items")
    by_shard = stored(_counted(rows), "terms")
    whole = by_shard.filter("term is null").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"), F.max("longest").alias("longest")).first()
    df = stored(by_shard.filter("term is not null").groupBy("term").agg(F.sum("n").alias("n")), "terms")
    for k in range(shards):
        mine = by_shard.filter((F.col("shard") == k) & F.col("term").isNotNull()).select("term").join(df, "term").collect()
        items = rows.filter(F.col("shard") == k).collect()
        yield build_index([(r.item_id, r.text) for r in items], counts=Counts(whole.n, whole.tokens, whole.longest, {r.term: r.n for r in mine}))


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.5, items_each: int = 20_000) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) for each document and item where a passage reaches the threshold, and both overlaps `overlap`.

    An item whose question or answer is too short to tell is found without that part by a high share of the rest (see `verify`).
    Every passage that reaches the threshold is verified; of those that pass, the one of the best score, then overlaps, is reported.
    Null and empty texts hold nothing; repeated rows are found each; with an empty benchmark or no documents there
    are no rows. A benchmark of more than `items_each` items is searched in shards, all documents against each; the rows are the same.
    """
    spark = docs.sparkSession
    small_batches(spark)
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for index in indexes(benchmark, items_each):
        found = rows.mapInArrow(_searcher(spark.sparkContext.broadcast(index), threshold, overlap, False), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _searcher(shared, threshold: float, overlap: float, keep_clean: bool):
    def leaks(index: Index, text: str | None) -> list[tuple]:
        best: dict[int, tuple] = {}
        for i, score, q, a in verified(index, text, threshold, overlap):
            best[i] = max(best.get(i, (0.0, 0.0, 0.0, 0.0)), (score, min(q, a), q, a))
        return [(index.ids[i], score, q, a) for i, (score, _, q, a) in sorted(best.items())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if keep_clean:
                yield batch.filter(pa.array([next(verified(index, t, threshold, overlap), None) is None for t in texts], pa.bool_()))
                continue
            found = [(d, *x) for d, t in zip(batch.column("doc_id").to_pylist(), texts, strict=True) for x in leaks(index, t)]
            columns = list(zip(*found, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item of the benchmark."""
    small_batches(docs.sparkSession)
    for index in indexes(benchmark):
        docs = docs.mapInArrow(_searcher(docs.sparkSession.sparkContext.broadcast(index), threshold, overlap, True), docs.schema)
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
