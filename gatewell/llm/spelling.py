"""Spelling variants by full neighbourhood generation (operator 13).

Each word of the vocabulary emits all distinct words that one deletion, replacement or insertion over the observed alphabet
makes of it. Those that the vocabulary holds, found by a hash join, are its near words: no distance is computed. A word's form
is its near word of largest count, if that count is large enough beside its own; following forms to the last gives its root.

A word of L characters emits L deletions, and over an alphabet of A characters L (A - 1) replacements and (L + 1) A
insertions, less those that repeat others: about a thousand. Their hashes are made in numpy from prefix hashes; a filter of
the vocabulary's hashes, of a bounded size, drops nearly all that can't be words before they are spelt out and shuffled to the
join, which settles the rest by their letters. No word is emitted by more than some thousand others, so no key of the join is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewell.llm.common import partitions, stored, table

#: A word has at least so many code points and occurrences, and a form so many times the word's occurrences.
LENGTH, OCCURRENCES, TIMES = 7, 2, 10
#: The characters of words: 116, and 90 once A-Z are lower-cased.
CHARACTERS = "A-Za-z\\u00C0-\\u00FF"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One word in so many loses a character, when errors are planted.
PLANTED = 31


def occurrences(docs: DataFrame, planted: bool = False) -> DataFrame:
    """(word) of each occurrence in docs (doc_id, text); `planted` deletes the character h % length of a run if 31 divides h, the crc32 of `doc_id:run`."""
    # shorter runs can't become words; a run of LENGTH or more is matched as a whole
    runs = F.regexp_extract_all("text", F.lit(f"[{CHARACTERS}]{{{LENGTH},}}"), F.lit(0))
    word = F.translate("run", UPPER, LOWER)
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).select("id", word.alias("word"))
    if planted:
        h = F.crc32(F.concat("id", F.lit(":"), "word"))
        at = (h % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        found = found.select(F.when(h % PLANTED == 0, cut).otherwise(F.col("word")).alias("word"))
    return found.select("word").filter(F.length("word") >= LENGTH)


#: Slots of 64 bits of the filter: half as many as words, but not more than these (64 MB), and the slots of a part of it.
SLOTS, PART = 1 << 23, 1 << 13
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _bit(mixed: np.ndarray, i: int) -> np.ndarray:
    return np.uint64(1) << (mixed >> np.uint64(58 - 6 * i) & np.uint64(63))


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The words of each length, in pieces of a bounded size: their places, and their code points as rows."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(lengths) - lengths
    for n in np.unique(lengths[lengths > 0]).tolist():
        mine = np.flatnonzero(lengths == n)
        step = max(1, (1 << 16) // n)
        for i in range(0, len(mine), step):
            part = mine[i : i + step]
            yield part, points[starts[part][:, None] + np.arange(n)]


def _filter(words: DataFrame, slots: int) -> np.ndarray:
    """Of each word, four bits of one slot by its hash. Parts of the filter are made in tasks, and only they come to the driver: 64 MB at most."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, points in _by_length(batch.column("word").to_pylist()):
                mixed = _mixed((points * _powers(points.shape[1])).sum(axis=1, dtype=np.uint64))
                slot = (mixed & np.uint64(slots - 1)).astype(np.int64)
                mask = _bit(mixed, 0) | _bit(mixed, 1) | _bit(mixed, 2) | _bit(mixed, 3)
                yield pa.RecordBatch.from_arrays([pa.array(slot // PART), pa.array(slot % PART), pa.array(mask.view(np.int64))], ["part", "slot", "mask"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            part, slot, mask = (batch.column(c).to_numpy() for c in ("part", "slot", "mask"))
            for k in np.unique(part).tolist():
                np.bitwise_or.at(made.setdefault(k, np.zeros(PART, np.uint64)), slot[part == k], mask[part == k].view(np.uint64))
        for k, v in made.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([v.tobytes()])], ["part", "bits"])

    n = partitions(words.sparkSession)
    out = np.zeros(max(slots, PART), np.uint64)
    for r in words.select("word").mapInArrow(bits, "part long, slot long, mask long").repartition(n, "part").mapInArrow(parts, "part long, bits binary").toLocalIterator():
        out[r.part * PART : (r.part + 1) * PART] = np.frombuffer(r.bits, np.uint64)
    return out[:slots]


def neighbours(words: list[str], alphabet: list[str], known: np.ndarray) -> Iterator[tuple[np.ndarray, list[str]]]:
    """All distinct words one edit away of each of the words, but those that the filter `known` rules out: (places of the words, what they emit)."""
    last = np.uint64(len(known) - 1)

    def held(hashes: np.ndarray, emits: np.ndarray | bool) -> tuple[np.ndarray, np.ndarray]:
        mixed = _mixed(hashes)
        slots = known[mixed & last]
        row, at = np.nonzero((slots & _bit(mixed, 0) != 0) & emits)  # most end at the first bit
        mixed, slots = mixed[row, at], slots[row, at]
        mask = _bit(mixed, 1) | _bit(mixed, 2) | _bit(mixed, 3)
        good = slots & mask == mask
        return row[good], at[good]

    base = np.uint64(_BASE)
    for place, points in _by_length(words):
        n = points.shape[1]
        power = _powers(n + 1)
        terms = points * power[:n]
        before = np.concatenate([np.zeros((len(points), 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)
        whole = before[:, -1:]
        # of equal characters side by side only the first is deleted
        first = np.concatenate([np.ones((len(points), 1), bool), points[:, 1:] != points[:, :-1]], axis=1)
        down = np.uint64(pow(_BASE, -1, 1 << 64))
        row, at = held(before[:, :-1] + (whole - before[:, 1:]) * down, first)
        if len(row):
            yield place[row], [words[p][:i] + words[p][i + 1 :] for p, i in zip(place[row].tolist(), at.tolist(), strict=True)]
        rest, shifted = whole - terms, before + (whole - before) * base
        for c in alphabet:
            letter = np.uint64(ord(c))
            row, at = held(rest + letter * power[:n], points != letter)
            if len(row):
                yield place[row], [words[p][:i] + c + words[p][i + 1 :] for p, i in zip(place[row].tolist(), at.tolist(), strict=True)]
            # after the same character an insertion repeats the one before it
            emits = np.concatenate([np.ones((len(points), 1), bool), points != letter], axis=1)
            row, at = held(shifted + letter * power, emits)
            if len(row):
                yield place[row], [words[p][:i] + c + words[p][i:] for p, i in zip(place[row].tolist(), at.tolist(), strict=True)]


def emitted(words: DataFrame, alphabet: list[str]) -> DataFrame:
    """(word, near): all distinct neighbours of each word, less those that the filter of the vocabulary rules out; some of these are no words."""
    spark = words.sparkSession
    slots = 1
    while slots < min(SLOTS, words.count() // 2):
        slots *= 2
    known = spark.sparkContext.broadcast(_filter(words, slots))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.column("word").to_pylist()
            for place, near in neighbours(mine, alphabet, known.value):
                yield pa.RecordBatch.from_arrays([pa.array([mine[p] for p in place.tolist()]), pa.array(near)], ["word", "near"])

    # a word is a thousand hashes: the small table is dealt out first
    return words.select("word").repartition(partitions(spark), "word").mapInArrow(emit, "word string, near string")


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n), whose words are distinct.

    Near words differ by exactly one inserted, deleted or replaced code point. Ties of the largest count go to the least word
    in code-point order. A word without near words has n_near 0 and, like one whose near words are too rare, no form.
    An empty vocabulary gives no rows.
    """
    # at most 116 characters of words, whatever the vocabulary; other vocabularies bring the characters they have
    alphabet = sorted(r.c for r in words.select(F.explode(F.split("word", "")).alias("c")).filter("c != ''").distinct().collect())
    if not alphabet:
        return words.selectExpr("word", "word form", "word root", "n", "n n_near", "n form_n")
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = emitted(words, alphabet).join(known, "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    n = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    enough = F.col("form_n") >= TIMES * F.col("n")
    formed = stored(n.select("word", "n", "n_near", F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n")), "forms")
    # roots by doubling: counts grow by TIMES at each step, so 18 steps reach any long
    roots = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(5):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, planted: bool = False) -> DataFrame:
    """`variants` of the words that docs (doc_id, text) hold at least twice.

    A null text has no words; a null doc_id is written as nothing in the hash; repeated rows count again; an empty table, and
    one without words, gives no rows; other columns are ignored.
    """
    counted = occurrences(docs.select("doc_id", F.col("text").cast("string").alias("text")), planted).groupBy("word").agg(F.count("*").alias("n"))
    return variants(stored(counted.filter(F.col("n") >= OCCURRENCES), "words"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), planted=True)


#: crc32 bit by bit: a list of the data's bits, the least of each byte first, is folded into the register.
_CRC = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, strlen(t) + 1), lambda k:
    list_transform(range(0, 8), lambda j: (('0x' || hex(encode(t))[2 * k - 1 : 2 * k])::BIGINT >> j) & 1)))),
    lambda r, d: xor(r >> 1, 3988292384 * (xor(r, d) & 1))), 4294967295)"""

ORACLE_SQL = {
    "op13_spelling": f"""
WITH RECURSIVE runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') w FROM documents),
hashed AS (SELECT w, {_CRC} h FROM (SELECT w, coalesce(doc_id::VARCHAR, '') || ':' || w t FROM runs WHERE length(w) >= {LENGTH})),
cut AS (SELECT CASE WHEN h % {PLANTED} = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END word FROM hashed),
words AS MATERIALIZED (SELECT word, count(*) n FROM cut WHERE length(word) >= {LENGTH} GROUP BY word HAVING count(*) >= {OCCURRENCES}),
places AS (SELECT word, unnest(range(1, length(word) + 1)) i FROM words),
holes AS (SELECT DISTINCT word, left(word, (i - 1)::INT) a, substr(word, (i + 1)::INT) b FROM places),
near AS (
    SELECT x.word, y.word near FROM holes x JOIN holes y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
    UNION SELECT h.word, w.word FROM holes h JOIN words w ON w.word = h.a || h.b
    UNION SELECT w.word, h.word FROM holes h JOIN words w ON w.word = h.a || h.b),
ranked AS (SELECT near.word, near.near, v.n near_n, count(*) OVER (PARTITION BY near.word) n_near,
    row_number() OVER (PARTITION BY near.word ORDER BY v.n DESC, encode(near.near)) r FROM near JOIN words v ON v.word = near.near),
forms AS (SELECT w.word, w.n, coalesce(k.n_near, 0) n_near, CASE WHEN k.near_n >= {TIMES} * w.n THEN k.near END form, CASE WHEN k.near_n >= {TIMES} * w.n THEN k.near_n END form_n
    FROM words w LEFT JOIN ranked k ON k.word = w.word AND k.r = 1),
steps AS (SELECT word, word stop FROM forms UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.stop WHERE f.form IS NOT NULL)
SELECT f.word, f.form, s.stop root, f.n, f.n_near, f.form_n FROM forms f JOIN steps s USING (word) JOIN forms g ON g.word = s.stop AND g.form IS NULL"""
}
