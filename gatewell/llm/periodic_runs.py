"""Periodic runs of words (operator 11), found by block matching.

A run is a maximal stretch of words with smallest period q and at least max(12, 2 q) words. Whatever its period, a run holds
an aligned block of s words, s a power of two near q / 2 or q / 4, that occurs again q words later. So for each scale s the
aligned blocks are the keys of an automaton (pyahocorasick, integer sequences), the text is searched for them, and each
pair of an aligned block and an occurrence at a distance that fits the scale is a seed. A seed is extended to both sides,
exactly, as far as words q apart are equal; what is long enough is a run, of the least distance that gave it.

Documents are worked on in batches, each closed by a word of its own, which no stretch can pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewell.llm.common import small_batches, table

#: A run has at least so many words.
LEAST = 12
#: Words of a batch; a longer document is a batch of its own.
WORDS = 1 << 18


def scales(n: int) -> Iterator[tuple[int, int, int]]:
    """(block, least distance, greatest distance) such that every run among n words has a seed.

    Of a run of L words and period q, L - q >= max(q, 12 - q) words recur q words later; 2 s - 1 of them hold an aligned
    block of s words. Blocks of 4 serve periods to 5 and 7 to 14, blocks of 2 the period 6, blocks of s those from 2 s - 1.
    """
    yield 4, 1, 5
    yield 2, 6, 6
    yield 4, 7, 14
    s = 8
    while 2 * s - 1 <= n // 2:
        yield s, 2 * s - 1, 4 * s - 2
        s *= 2


def _next(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each key, and how far on the same key comes again (beyond the end if it doesn't)."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    names = np.empty(len(keys), np.int64)
    names[order] = np.cumsum(np.concatenate([[0], ~same])) if len(keys) else 0
    away = np.full(len(keys), 2 * len(keys) + 1, np.int64)
    away[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return names, away


def _join(names: np.ndarray, k: int) -> np.ndarray:
    """Keys of what is named at i and at i + k."""
    return names[:-k] * (int(names.max(initial=0)) + 1) + names[k:]


class _Runs:
    """The runs of one sequence of word numbers; none has more than `longest` words."""

    def __init__(self, ids: np.ndarray, longest: int):
        self.ids, self.n, self.longest = ids, len(ids), longest
        self.found: dict[tuple[int, int], int] = {}  # (start, end) -> least period

    def all(self) -> dict[tuple[int, int], int]:
        if self.longest < LEAST:
            return self.found
        pairs, two = _next(_join(self.ids, 1))
        four = _next(_join(pairs, 2))[1]
        two, four = (np.append(x, np.full(self.n - len(x), 2 * self.n)) for x in (two, four))
        for s, least, most in scales(self.longest):
            known = self._known(s)
            starts = self._blocks(s, most, two if s == 2 else four, known)
            if len(starts):
                blocks, distances = self._seeds(s, starts, least, most)
                new = known[blocks] < blocks + distances + s
                self._extend(s, blocks[new], distances[new])
        return self.found

    def _known(self, period: int) -> np.ndarray:
        """By word: the furthest end of the known runs around it whose period is at most `period`, else 0.

        A block of s words and its occurrence in one run of period p <= s are a multiple of p apart (its p words are no
        power of a shorter sequence), so such a seed only leads back to that run.
        """
        out = np.zeros(self.n + 1, np.int64)
        for (a, b), q in self.found.items():
            if q <= period:
                np.maximum(out[a:b], b, out=out[a:b])
        return out

    def _blocks(self, s: int, most: int, again: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Starts of the aligned blocks that may occur again within `most` words, for all their groups of four (or two) do, and not only in a known run."""
        m = self.n // s
        starts = np.flatnonzero(again[: m * s].reshape(m, s)[:, : s - min(s, 4) + 1].max(axis=1) <= most) * s
        return starts[known[starts] < np.minimum(starts + s + most, self.n)]

    def _seeds(self, s: int, starts: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Blocks and the distances from least to most at which the automaton meets them again.

        Only blocks and what lies within their reach are looked at. A key has four letters at most, each the name of a quarter
        of the block; the text is then searched once for each residue of the quarter's length. So a key is never deep,
        however long the block, and what the automaton costs doesn't grow with repeats in the text.
        """
        change = np.zeros(self.n + 1, np.int64)
        np.add.at(change, starts, 1)
        np.add.at(change, np.minimum(starts + most + s, self.n), -1)
        place = np.flatnonzero(np.cumsum(change[:-1]))
        quarter = max(1, s // 4)
        names, wide = _names(self.ids[place], quarter)
        letters = np.stack([names // wide, wide + names % wide], axis=1)  # no node has more children than the root of the names
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        kinds: dict[tuple, int] = {}
        parts = np.searchsorted(place, starts)[:, None] + np.arange(0, s, quarter)
        kind = np.array([kinds.setdefault(tuple(key), len(kinds)) for key in letters[parts].reshape(len(starts), -1).tolist()], np.int64)
        for key, k in kinds.items():
            automaton.add_word(key, k)
        automaton.make_automaton()
        hits = []
        for r in range(min(quarter, len(letters))):
            text = tuple(letters[r::quarter].ravel().tolist())
            hits += [(r + (end // 2 + 1 - s // quarter) * quarter, k) for end, k in automaton.iter(text)]
        at, there = np.array(hits, np.int64).reshape(-1, 2).T
        whole = at + s <= len(place)
        at, there = at[whole], there[whole]
        whole = place[at + s - 1] - place[at] == s - 1  # nothing left out in between
        at, there = place[at[whole]], there[whole]
        # pairs of a block and an occurrence of its key, by binary search in (key, place)
        step = 4 * self.n
        found = np.sort(there * step + at)
        low = np.searchsorted(found, kind * step + starts + least)
        many = np.searchsorted(found, kind * step + starts + most, side="right") - low
        pick = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        blocks = np.repeat(starts, many)
        return blocks, found[pick] % step - blocks

    def _extend(self, s: int, blocks: np.ndarray, distances: np.ndarray) -> None:
        """Seeds of one distance that a stretch of it already covers are passed over."""
        order = np.lexsort((blocks, distances))
        last, upto, ids = 0, -1, self.ids
        for a, q in zip(blocks[order].tolist(), distances[order].tolist(), strict=True):
            if q == last and a < upto:
                continue
            left = a - _reach(ids[:a][::-1], ids[: a + q][::-1])
            right = a + s + _reach(ids[a + s :], ids[a + s + q :])
            last, upto = q, right
            if right - left >= max(q, LEAST - q):
                key = left, right + q
                self.found[key] = min(q, self.found.get(key, q))


def _names(ids: np.ndarray, length: int) -> tuple[np.ndarray, int]:
    """A number for each stretch of `length` ids (a power of two), the same for equal stretches, and a bound of its root."""
    names, k = _next(ids)[0], 1
    while k < length:
        names, k = _next(_join(names, k))[0], 2 * k
    return names, int(np.sqrt(int(names.max(initial=0)))) + 2


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many first elements of a and b are equal; looked at in pieces that double."""
    n, at, step = min(len(a), len(b)), 0, 16
    while at < n:
        differ = np.flatnonzero(a[at : min(n, at + step)] != b[at : min(n, at + step)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 2 * step
    return n


def edited(words: list[bytes], h: int) -> list[bytes]:
    """The words with the repetition that the crc32 h of the document's id asks for."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def find_runs(documents: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """For each document its runs (start, length, period), by start, then period."""
    ids: list[int] = []
    bounds, base = [0], 0
    for words in documents:  # no number serves two documents, and none of a word the end of one
        numbers: dict[bytes, int] = {}
        ids += [numbers.setdefault(w, base + len(numbers)) for w in words]
        ids.append(base + len(numbers))
        base += len(numbers) + 1
        bounds.append(len(ids))
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    for (a, b), q in _Runs(np.array(ids, np.int64), max(map(len, documents), default=0)).all().items():
        d = int(np.searchsorted(bounds, a, side="right")) - 1
        out[d].append((a - bounds[d], b - a, q))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


_FIELDS = [("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def settle(ids: list, documents: list[list[bytes]]) -> pa.RecordBatch:
        out = []
        for doc_id, words, runs in zip(ids, documents, find_runs(documents), strict=True):
            start, length, q = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
            digest = hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest()
            kept = hashlib.sha256(b" ".join(collapse(words, runs))).hexdigest()
            out.append((doc_id, len(runs), start, length, q, None if q is None else 1000 * length // q, digest, kept))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), _FIELDS, strict=True)], [x for x, _ in _FIELDS])

    ids, documents, total = [], [], 0
    for batch in batches:
        for doc_id, text, h in zip(batch.column("doc_id"), batch.column("text"), batch.column("h"), strict=True):
            words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
            h = h.as_py()
            ids.append(doc_id.as_py())
            documents.append(words if h is None else edited(words, h))
            total += len(words)
            if total >= WORDS:
                yield settle(ids, documents)
                ids, documents, total = [], [], 0
    if ids:
        yield settle(ids, documents)


def periodic_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """For each row of docs (doc_id, text) its runs of words: their number, the longest, and digests of all and of the text without repeats.

    No shuffle: each document is worked on where it is read, whole. `planted` first repeats words of one document in ten, as
    the crc32 of its id says, so that there is something to find. A null or blank text has no words and no runs; a null
    doc_id stays null and is never edited; repeated rows each give their own; an empty table gives no rows; other columns are ignored.
    Of runs of equal length the first by start, then period, is the longest.
    """
    small_batches(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    h = F.crc32(doc_id.cast("string")) if planted else F.lit(None).cast("long")
    return docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h")).mapInArrow(_rows, _SCHEMA)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), planted=True)
