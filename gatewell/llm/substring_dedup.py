"""Exact substring dedup by prefix-free parsing (operator 8).

Each text is parsed by triggers of a rolling hash: a 100-byte string belongs to the trigger of the least hash among its
32-byte windows, and the strings of one trigger, which start next to each other, make a phrase; phrases overlap by 99
bytes, so each 100-byte string is in exactly one. Equal strings have equal triggers at equal places, so they lie in
phrases of one trigger hash. The dictionary has each distinct phrase once, at its first place in the corpus: strings of
any later copy of a phrase are repeats. Among distinct phrases of one trigger hash a suffix array, to a depth of 100,
brings equal strings together, and the parse, that is the phrases' places, puts each group in corpus order. A trigger with
many distinct phrases, as at the edges of a passage that many documents share, has a second level: each string goes by its
own 128-bit hash, and a grouped minimum finds its first place, so no trigger's texts meet in one task.
Phrases whose trigger hash is nowhere else, which in most text are nearly all, are done with without their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewell.llm.common import partitions, small_batches, stored, table

LENGTH, GRAM = 100, 32
WINDOW = LENGTH - GRAM + 1
#: Distinct phrases of one trigger that are compared in one task; the strings of a trigger with more are compared by their own hashes.
HOT = 4096
#: Bytes of text that are parsed at a time; 26 bits hold a position within it.
BLOCK = 1 << 22
_BASES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1))
_INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        size = max(n, 1 << 16)
        run = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))])
        _POWERS[which] = run(_BASES[which]), run(_INVERSES[which])
    return tuple(x[:n] for x in _POWERS[which])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Prefixes:
    """Prefix polynomial hashes modulo 2^64 of a run of bytes."""

    def __init__(self, data: np.ndarray, which: int):
        up, self.down = _powers(which, len(data) + 1)
        self.h = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])])

    def spans(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (self.h[high] - self.h[low]) * self.down[low]


def phrases(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trigger hash, phrase hash, first and last start: at most 69 apart) of the phrases of one text's bytes; none if it has fewer than 100."""
    none = np.empty(0, np.int64)
    out = [(none, none, none, none)]
    n = len(data)
    for begin in range(0, max(0, n - LENGTH + 1), BLOCK):
        block = data[begin : min(n, begin + BLOCK + LENGTH - 1)]
        first, second = Prefixes(block, 0), Prefixes(block, 1)
        at = np.arange(len(block) - GRAM + 1)
        gram = _mix(first.spans(at, at + GRAM))
        # the least of 38 bits of the hash in each window, the leftmost of equal ones
        least = (gram >> np.uint64(26)) << np.uint64(26) | at.astype(np.uint64)
        width = 1
        while width * 2 <= WINDOW:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(least) - (WINDOW - width)], least[WINDOW - width :])
        trigger = (least & np.uint64((1 << 26) - 1)).astype(np.int64)
        low = np.flatnonzero(np.concatenate([[True], trigger[1:] != trigger[:-1]]))
        high = np.concatenate([low[1:] - 1, [len(trigger) - 1]])
        t = trigger[low]
        end = high + LENGTH
        key = _mix(first.spans(low, end) + (t - low).astype(np.uint64)) ^ second.spans(low, end) * np.uint64(3)
        # 44 bits of the trigger hash group phrases well enough; which of them are equal is for the other hash
        out.append(((gram[t] >> np.uint64(20)).view(np.int64), key.view(np.int64), low + begin, high + begin))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _bytes(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b"" if t is None else t.encode("utf-8", "surrogatepass"), np.uint8) for t in column.to_pylist()]


def _parse(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [phrases(b) for b in _bytes(batch.column("text"))]
            keys = np.repeat(batch.column("k").to_numpy(zero_copy_only=False), [len(x[0]) for x in found])
            t, p, low, high = (np.concatenate([x[i] for x in found]) if found else np.empty(0, np.int64) for i in range(4))
            at = low << 7 | (high - low)
            # of a phrase's places in a batch only the first may be its first place: the others are copies, which no trigger needs to gather
            order = np.lexsort((at, keys, p, t))
            copy = np.zeros(len(t), bool)
            copy[order[1:]] = (t[order][1:] == t[order][:-1]) & (p[order][1:] == p[order][:-1])
            yield pa.RecordBatch.from_arrays([pa.array(t, mask=copy), pa.array(p), pa.array(keys, pa.int64()), pa.array(at)], ["t", "p", "k", "at"])

    return docs.select("k", "text").mapInArrow(run, "t long, p long, k long, at long")


def _marked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (k, at, t), those of a t standing together, with `hot`: whether t has more than `most` rows. At most as many rows wait."""
    names = ("k", "at", "t")
    batch_of = lambda k, at, t, hot, known=None: pa.RecordBatch.from_arrays([pa.array(k), pa.array(at), pa.array(t, mask=known), pa.array(hot)], [*names, "hot"])
    waiting = [np.empty(0, np.int64)] * 3
    hot_t = None  # the trigger that was last found hot
    for batch in batches:
        known = batch.filter(batch.column("t").is_null())
        if known.num_rows:
            k, at = (known.column(c).to_numpy() for c in ("k", "at"))
            yield batch_of(k, at, np.zeros(len(k), np.int64), np.zeros(len(k), bool), np.ones(len(k), bool))
        batch = batch.filter(batch.column("t").is_valid())
        k, at, t = (np.concatenate([w, batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)]) for w, c in zip(waiting, names, strict=True))
        if not len(t):
            continue
        start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        count = np.diff(np.append(start, len(t)))
        hot = np.repeat((count > most) | (t[start] == hot_t if hot_t is not None else False), count)
        if hot[-1]:
            hot_t, end = t[-1], len(t)
        else:
            end = start[-1]
        yield batch_of(k[:end], at[:end], t[:end], hot[:end])
        waiting = [k[end:], at[end:], t[end:]]
    yield batch_of(*waiting, np.zeros(len(waiting[0]), bool))


def _compared(parsed: DataFrame, most: int) -> DataFrame:
    """Rows (k, at, t, hot) of phrases that matter: t null for a later copy of a phrase, all of whose strings are repeats; else the trigger
    hash, for the first of each phrase where several phrases have it, and whether more than `most` have. Rows come sorted, so only the
    last, and those of which this isn't known yet, are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row: t, p, k, at; and the first row of its trigger if that still waits for another phrase
        names = ("t", "p", "k", "at")
        for batch in batches:
            known = batch.filter(batch.column("t").is_null())
            if known.num_rows:
                yield known.select(["k", "at", "t"])
            batch = batch.filter(batch.column("t").is_valid())
            cols = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
            if held is not None:
                cols = [np.concatenate([[h], c]) for h, c in zip(held[0], cols, strict=True)]
            t, p, k, at = cols
            if not len(t):
                continue
            new_t = np.concatenate([[True], t[1:] != t[:-1]])
            new_p = new_t | np.concatenate([[True], p[1:] != p[:-1]])
            # the first phrase of a trigger counts once a second phrase is met
            group = np.cumsum(new_t) - 1
            several = np.bincount(group, new_p & ~new_t, minlength=group[-1] + 1) > 0
            waiting = held[1] if held is not None else None
            kind = np.where(~new_p, 1, np.where(~new_t | several[group], 2, 0))  # 1: a copy, 2: to be compared, 0: nothing
            out = kind > 0
            extra = []
            if held is not None:
                out[0] = False  # given out or waiting
                if several[0] and waiting is not None:
                    extra.append(waiting)
            take = np.flatnonzero(out)
            rows = [k[take], at[take], t[take]]
            rows = [np.concatenate([np.array([x[i] for x in extra], np.int64), r]) for i, r in enumerate(rows)]
            copy = np.concatenate([np.zeros(len(extra), bool), kind[take] == 1])
            last = group[-1]
            start = int(np.flatnonzero(group == last)[0])
            if several[last]:
                waiting = None
            elif start > 0 or held is None:
                waiting = (k[start], at[start], t[start])
            held = (tuple(c[-1] for c in cols), waiting)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2], mask=copy)], ["k", "at", "t"])

    dealt = parsed.repartition(partitions(parsed.sparkSession), F.coalesce("t", "k")).sortWithinPartitions("t", "p", "k", "at")
    return dealt.mapInArrow(lambda batches: _marked(run(batches), most), "k long, at long, t long, hot boolean")


def _with_text(texts: DataFrame, flags: DataFrame) -> DataFrame:
    """The phrases to be compared, with their bytes; flags has for each k the list of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, b, rows in zip(batch.column("k").to_pylist(), _bytes(batch.column("text")), batch.column("rows").to_pylist(), strict=True):
                out += [(r["t"], k, r["at"] >> 7, b[r["at"] >> 7 : (r["at"] >> 7) + (r["at"] & 127) + LENGTH].tobytes()) for r in rows]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["t", "k", "low", "e"])

    rows = flags.filter("t is not null").groupBy("k").agg(F.collect_list(F.struct("t", "at")).alias("rows"))
    return texts.join(rows, "k").select("k", "text", "rows").mapInArrow(run, "t long, k long, low int, e binary")


def _hot_repeats(texts: DataFrame, flags: DataFrame) -> DataFrame:
    """(k, low, more) of strings that start earlier as well, among the phrases in flags. Strings are told by 128 bits of their hashes.

    Each string goes by its own hash, in no task with the others of its trigger; of equal strings only a minimum is
    gathered, aggregated before the shuffle. Keys of the anti join are places, so a common string is no hot key there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, b, rows in zip(batch.column("k").to_pylist(), _bytes(batch.column("text")), batch.column("rows").to_pylist(), strict=True):
                for begin in range(0, len(rows), 1024):
                    h, g, low = [], [], []
                    for r in rows[begin : begin + 1024]:
                        at, more = r["at"] >> 7, r["at"] & 127
                        span = b[at : at + more + LENGTH]
                        here = np.arange(more + 1)
                        first, second = (Prefixes(span, i).spans(here, here + LENGTH) for i in (0, 1))
                        h.append(_mix(first))
                        g.append(_mix(second))
                        low.append(here + at)
                    h, g = (np.concatenate(x).view(np.int64) for x in (h, g))
                    low = np.concatenate(low).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), pa.array(np.full(len(h), k, np.int64)), pa.array(low)], ["h", "g", "k", "low"])

    rows = flags.groupBy("k").agg(F.collect_list("at").alias("at")).select("k", F.transform("at", lambda x: F.struct(x.alias("at"))).alias("rows"))
    strings = stored(texts.join(rows, "k").select("k", "text", "rows").mapInArrow(run, "h long, g long, k long, low int"), "strings")
    firsts = strings.groupBy("h", "g").agg(F.min(F.struct("k", "low")).alias("m")).select("h", "g", "m.k", "m.low")
    return strings.join(firsts, ["h", "g", "k", "low"], "left_anti").select("k", "low", F.lit(0).alias("more"))


def suffix_ranks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ranks of the 100-byte strings at `starts` in data, equal for equal strings: a suffix array cut at a depth of 100, by prefix doubling."""
    padded = np.concatenate([data, np.zeros(LENGTH, np.uint8)]).astype(np.uint64)
    rank = padded[:-3] << np.uint64(24) | padded[1:-2] << np.uint64(16) | padded[2:-1] << np.uint64(8) | padded[3:]
    depth = 4
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        m = len(rank) - step
        _, rank = np.unique(rank[:m] << np.uint64(32) | rank[step:], return_inverse=True)
        rank = rank.astype(np.uint64)
        depth += step
    return rank[starts]


def _repeats(compared: DataFrame) -> DataFrame:
    """(k, low, more) of runs of starts of strings that start earlier as well, among phrases with one trigger hash."""

    def settle(tab: pa.Table) -> pa.RecordBatch:
        t, k, low = (tab.column(c).to_numpy().astype(np.int64) for c in ("t", "k", "low"))
        es = tab.column("e").to_pylist()
        size = np.array([len(e) for e in es])
        data = np.frombuffer(b"".join(es), np.uint8)
        count = size - LENGTH + 1
        row = np.repeat(np.arange(len(es)), count)
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        rank = suffix_ranks(data, np.repeat(np.cumsum(size) - size, count) + inside)
        place = low[row] + inside
        order = np.lexsort((place, k[row], rank, t[row]))
        same = (rank[order][1:] == rank[order][:-1]) & (t[row][order][1:] == t[row][order][:-1])
        again = np.zeros(len(row), bool)
        again[order[1:][same]] = True
        # runs of repeats within a phrase
        edge = np.diff(np.concatenate([[0], again.astype(np.int8), [0]]))
        cut = np.flatnonzero(again[1:] & again[:-1] & (row[1:] != row[:-1])) + 1
        begin, end = np.sort(np.concatenate([np.flatnonzero(edge == 1), cut])), np.sort(np.concatenate([np.flatnonzero(edge == -1), cut]))
        return pa.RecordBatch.from_arrays([pa.array(k[row[begin]]), pa.array(place[begin].astype(np.int32)), pa.array((end - begin - 1).astype(np.int32))], ["k", "low", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            tab = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if not tab.num_rows:
                continue
            t = tab.column("t").to_numpy()
            last = int(np.searchsorted(t, t[-1]))  # rows are sorted by t, and the last group may go on
            rest = tab.slice(last)
            if last:
                yield settle(tab.slice(0, last))
        if rest is not None and rest.num_rows:
            yield settle(rest)

    dealt = compared.repartition(partitions(compared.sparkSession), "t").sortWithinPartitions("t")
    return dealt.mapInArrow(run, "k long, low int, more int")


def _cut(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of each text, without each byte that a run's strings cover."""

    def cut(b: np.ndarray, rows) -> tuple:
        edge = np.zeros(len(b) + 1, np.int32)
        for r in rows or ():
            edge[r["low"]] += 1
            edge[r["low"] + r["more"] + LENGTH] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        spans = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]]))) if len(b) else 0
        kept = b[~gone].tobytes()
        return len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [cut(b, rows) for b, rows in zip(_bytes(batch.column("text")), batch.column("rows").to_pylist(), strict=True)]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    rows = runs.groupBy("k").agg(F.collect_list(F.struct("low", "more")).alias("rows"))
    whole = texts.join(rows, "k", "left").select("doc_id", "text", "rows")
    return whole.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, most: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left) for each row.

    A null text counts as empty; texts under 100 bytes stay whole; matches never cross documents. Documents stand in order of doc_id;
    rows that share an id, and those of null ids, which come last, stand by their text, and equal rows as the input has them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select("doc_id")
    odd = ids.groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    if odd.isEmpty():
        keyed = docs.withColumn("k", F.col("doc_id"))
    else:  # places by a sort of all rows, as ids don't tell rows apart
        placed = docs.orderBy(F.col("doc_id").asc_nulls_last(), "text").rdd.zipWithIndex().map(lambda r: (r[0][0], r[0][1], r[1]))
        keyed = spark.createDataFrame(placed, "doc_id long, text string, k long")
    # texts are shuffled once; both joins take them from there
    texts = keyed.repartition(partitions(spark), "k")
    flags = stored(_compared(_parse(keyed), most), "flags")
    runs = _repeats(_with_text(texts, flags.filter("not hot"))).unionByName(flags.filter("t is null").selectExpr("k", "int(shiftright(at, 7)) low", "int(at & 127) more"))
    hot = flags.filter("hot")
    return _cut(texts, runs if hot.isEmpty() else runs.unionByName(_hot_repeats(texts, hot)))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
