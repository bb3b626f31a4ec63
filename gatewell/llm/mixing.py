"""Mixing sources to target weights by a low-discrepancy schedule (operator 10).

Slot i of the schedule is the point frac(i * golden ratio), mapped through the cumulative targets to a
source, by how many blocks each needs. Each source's documents stand in a keyed random order as one stream of tokens, cut into
blocks that are equal within the source; the r-th slot of a source takes the r-th block of its stream, which starts anew at its end.
So any stretch of the schedule holds the sources in their proportions, and the whole is deterministic.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatewell.llm.common import stored, table

WORDS = r"[^\x20\x09-\x0D]+"
#: The golden ratio's part of a circle of 2^32 points.
GOLDEN, CIRCLE, HALF = 2_654_435_769, 1 << 32, 1 << 16


def point(slot: Column) -> Column:
    """(slot + 1) * GOLDEN modulo CIRCLE, by halves, so that no product leaves 64 bits whatever the slot. Points repeat after a whole circle, which holds each once."""
    i = (slot + 1) % CIRCLE
    return (F.floor(i / HALF) * GOLDEN % HALF * HALF + i % HALF * GOLDEN) % CIRCLE


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2) -> dict[str | None, Fraction]:
    """Each source's target. Sources by code point, null last, weigh as `weights` repeat; the excess over `most` times a source's size is reshared by weight until none is above.

    Taken by cap over weight, least first, a source gets its cap if its share of what is left is more, which settles all in one pass.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: Fraction(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    left, total, out = share * sum(n for _, n in order), sum(weight.values()), {}
    for s, n in sorted(order, key=lambda x: most * x[1] / weight[x[0]]):
        out[s] = min(Fraction(most * n), left * weight[s] / total)
        left, total = left - out[s], total - weight[s]
    return out


def schedule(spark: SparkSession, goals: list[tuple[str | None, float]], slots: int, chunk: int = 1 << 14) -> DataFrame:
    """slot, source number and rank: which block of its source a slot takes. Ranks come from counts by chunk, so no source's slots meet in one task."""
    total, edges, run = sum(g for _, g in goals), [], 0
    for _, g in goals:
        run += g
        edges.append(round(CIRCLE * (run / total)))
    points = spark.range(slots).select(F.col("id").alias("slot"), point(F.col("id")).alias("x"))
    chosen = points.select("slot", F.aggregate(F.array(*[F.lit(e) for e in edges[:-1]]).cast("array<long>"), F.lit(0), lambda a, e: a + (e <= F.col("x")).cast("int")).alias("source_no"))
    chosen = chosen.withColumn("chunk", F.floor(F.col("slot") / chunk))
    counts = chosen.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    before = counts.select("source_no", "chunk", F.coalesce(F.sum("n").over(Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("source_no", "chunk").orderBy("slot")
    return chosen.withColumn("nth", F.row_number().over(within)).join(before, ["source_no", "chunk"]).select("slot", "source_no", (F.col("before") + F.col("nth") - 1).alias("rank"))


def _streams(docs: DataFrame, dims: DataFrame, seed: int, per_bucket: int, rows: int) -> DataFrame:
    """Each document's place in its source's stream. Prefix sums go by ranges of the shuffle key, so that no source's rows meet in one task."""
    buckets = max(1, -(-rows // per_bucket))
    keyed = docs.withColumn("at", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn("bucket", F.pmod(F.shiftrightunsigned("at", 24), F.lit(buckets)))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = sums.select("source", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "bucket").orderBy("at", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = (placed["source"].eqNullSafe(before["source"])) & (placed["bucket"] == before["bucket"])
    placed = placed.join(before, same).select(placed["*"], (F.col("inside") + F.col("before")).alias("start"))
    return placed.join(F.broadcast(dims), placed["source"].eqNullSafe(dims["source"])).drop(dims["source"])


def block_size(target: Fraction, most: int = 64, least: int = 1000) -> int:
    """Words of a source's blocks: `most`, or fewer where its target would be under `least` blocks. It rests on the source alone, however large the others are."""
    return max(1, min(most, int(target) // least))


def mix(docs: DataFrame, block: int | None = None, seed: int = 10, per_bucket: int = 4096, max_sources: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces): each row of docs with its size, source_size, target and words taken; and the mix, one row for each piece
    of a document in a slot: slot, doc_id, row, from_word, words.

    A null text has size 0; a null source is a source of its own, last in order; null and repeated doc_ids count as
    documents of their own, told apart by `row`. An empty table, or one without words, gives a mix without pieces. Only doc_id, text
    and source are read. The sources' sizes, at most `max_sources` rows, pass through the driver, which sets the
    targets; a table with more sources is refused, as a weight for each is part of the recipe.
    """
    spark = docs.sparkSession
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("row"))
    sized = stored(sized, "sizes")  # texts are read once
    by_source = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).limit(max_sources + 1).collect()
    if len(by_source) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    goal = targets([(r.source, r.n) for r in by_source])
    order = [r for r in sorted(by_source, key=lambda r: (r.source is None, r.source or ""))]
    sizes = {s: block or block_size(g) for s, g in goal.items()}
    turns = [(r.source, goal[r.source] / sizes[r.source]) for r in order]  # how many slots a source needs
    slots = math.ceil(sum(n for _, n in turns))
    dims = spark.createDataFrame([(r.source, i, r.n, float(goal[r.source]), sizes[r.source]) for i, r in enumerate(order)], "source string, source_no int, source_size long, target double, block long")
    placed = _streams(sized, dims, seed, per_bucket, sum(r.rows for r in order))
    plan = schedule(spark, [(s, float(n)) for s, n in turns], slots) if slots else spark.createDataFrame([], "slot long, source_no int, rank long")
    # a slot's block is [rank * block, rank * block + block) of the source's stream repeated twice; beyond two rounds there is nothing to take
    lap = F.explode(F.array(F.lit(0), F.lit(1)))
    rounds = placed.filter("size > 0").select("doc_id", "row", "source_no", "size", lap.alias("lap"), "start", "source_size", "target", "block")
    rounds = rounds.withColumn("from", F.col("start") + F.col("lap") * F.col("source_size")).filter(F.col("from") < F.col("target") + 64 * F.col("block"))
    blocks = rounds.withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / F.col("block")), F.floor((F.col("from") + F.col("size") - 1) / F.col("block")))))
    taken = blocks.join(plan, ["source_no", "rank"])
    low = F.greatest(F.col("from"), F.col("rank") * F.col("block"))
    high = F.least(F.col("from") + F.col("size"), (F.col("rank") + 1) * F.col("block"))
    pieces = taken.select("slot", "doc_id", "row", "source_no", "start", (low - F.col("from")).alias("from_word"), (high - low).alias("words"))
    words = pieces.groupBy("source_no", "start").agg(F.sum("words").alias("taken"))
    documents = placed.join(words, (placed["source_no"] == words["source_no"]) & (placed["start"] == words["start"]) & (placed["size"] > 0), "left")
    documents = documents.select(placed["doc_id"], placed["source"], placed["row"], placed["size"], placed["source_size"], placed["target"], F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return documents, pieces.drop("source_no", "start")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = mix(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken", "source")
