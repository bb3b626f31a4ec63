"""Blocks by source: a small source is met as well beside a large one, and words taken are those of a plain loop."""

import bisect
import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from gatewell.llm import mixing


@pytest.mark.parametrize("large", [10**5, 10**8])
def test_a_small_source_is_met_beside_a_large_one(spark, large):
    goal = {"a": Fraction(large), "b": Fraction(1000), "c": Fraction(30), None: Fraction(64_000)}
    turns = [(s, float(g / mixing.block_size(g))) for s, g in goal.items()]
    plan = mixing.schedule(spark, turns, math.ceil(sum(n for _, n in turns)))
    found = {r.source_no: r["count"] for r in plan.groupBy("source_no").count().collect()}
    for i, (s, g) in enumerate(goal.items()):
        assert abs(found[i] * mixing.block_size(g) - g) <= max(10, g / 100), s


def test_blocks_rest_on_the_source_alone():
    assert [mixing.block_size(Fraction(t)) for t in (0, 1, 999, 2000, 10_000, 64_000, 10**12)] == [1, 1, 1, 2, 10, 64, 64]


def test_taken_is_what_a_plain_loop_takes(spark):
    rows = [(i, "w " * (i * 37 % 211), "abc"[i % 3] if i % 7 else None) for i in range(160)] + [(3, "w " * 9, "a"), (None, "w w w", "b"), (200, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    documents, pieces = mixing.mix(docs, per_bucket=16)
    found = {(r.doc_id, r.row, r.source, r.size): r.taken for r in documents.collect()}
    sized = docs.select("doc_id", "source", mixing.size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("row")).withColumn("at", F.xxhash64(F.lit(10), "doc_id", "size")).collect()
    goal = mixing.targets([(s, sum(r.size for r in sized if r.source == s)) for s in {r.source for r in sized}])
    order = sorted(goal, key=lambda s: (s is None, s or ""))
    block = {s: mixing.block_size(goal[s]) for s in order}
    # the stream of each source, by ranges of the shuffle key
    buckets = -(-len(rows) // 16)
    streams = {s: sorted((r for r in sized if r.source == s), key=lambda r: ((r["at"] % (1 << 64) >> 24) % buckets, r["at"], (r.doc_id is not None, r.doc_id or 0), r.size, r.row)) for s in order}
    words = {s: [(r.doc_id, r.row, s, r.size) for r in streams[s] for _ in range(r.size)] for s in order}
    turns = [goal[s] / block[s] for s in order]
    edges = [round(mixing.CIRCLE * float(sum(float(t) for t in turns[: i + 1]) / sum(float(t) for t in turns))) for i in range(len(order))]
    taken, ranks = dict.fromkeys(found, 0), dict.fromkeys(order, 0)
    for slot in range(math.ceil(sum(turns))):
        s = order[bisect.bisect_right(edges[:-1], (slot + 1) * mixing.GOLDEN % mixing.CIRCLE)]
        at, ranks[s] = ranks[s] * block[s], ranks[s] + 1
        for i in range(at, min(at + block[s], 2 * len(words[s]))):
            taken[words[s][i % len(words[s])]] += 1
    assert found == taken and sum(taken.values()) == pieces.agg({"words": "sum"}).first()[0]
    assert all(t <= 2 * k[3] for k, t in taken.items())
