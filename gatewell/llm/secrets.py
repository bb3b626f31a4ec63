"""Secret scans by a linear-chain conditional random field (operator 5).

Three base patterns find the secrets of known forms. A CRF, trained on texts around them, tags each token of
each whole text as secret begin, inside or outside, from the token's shape, the words beside it and features
of its file, decoded by Viterbi. It adds spans of the kind `crf`; base spans always stay.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewell.llm.common import bounded_sample, small_batches, stored, table

KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the same as runs of one or more of which those of 24 or more are kept
_STEMS = ("passw", "secret", "token", "api")

_TOKEN = re.compile(r"[A-Za-z0-9+/_.-]+|[^\sA-Za-z0-9+/_.-]+")
LABELS = 3  # outside, begin, inside
DIM = 1 << 14


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start and then kind."""
    out = [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    low = text.lower()
    if any(s in low for s in _STEMS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % DIM


def shape_features(token: str) -> list[int]:
    """What a token looks like: its kinds of characters in order, length, share of digits, changes between kinds, and entropy."""
    if token.isalpha() and len(token) < 40:
        return [_slot(f"word {min(len(token), 24) // 4} {token.isupper()}")]
    runs, digits, before = 0, 0, ""
    for c in token:
        k = "a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else "."
        runs, digits, before = runs + (k != before), digits + (k == "9"), k
    kinds = "".join(sorted({"a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else c if ord(c) < 128 else "." for c in token}))[:12]
    n = len(token)
    entropy = -sum(k / n * math.log2(k / n) for k in (token.count(c) for c in set(token)))
    size, hexes = min(n, 48) // 4, all(c in "0123456789abcdefABCDEF" for c in token)
    return [_slot(f) for f in (f"kinds {kinds} {size}", f"size {size} {digits * 4 // n}", f"runs {min(runs, 24) // 3} {size}", f"entropy {int(entropy * 2)} {size}", f"hex {hexes} {size}", f"start {token[:4] if size > 3 else ''}")]


def beside_features(token: str, where: str) -> list[int]:
    """What a token says about its neighbour: itself if it is short, else that it is long."""
    return [_slot(f"{where} {token.lower() if len(token) < 12 else 'long'}"), _slot(f"{where} alpha {token.isalpha()}")]


def file_features(text: str) -> int:
    """Whether the file looks like code or settings: how many of its characters are signs of those."""
    n = sum(map(text.count, "=:{};\"_"))
    return _slot(f"file {min(4, n * 50 // max(1, len(text)))}")


@dataclass
class CRF:
    emit: np.ndarray  # DIM x LABELS
    move: np.ndarray  # LABELS x LABELS: from, to

    def slack(self) -> float:
        """By how much the neighbours can favour another label over outside: a token whose emissions favour outside by more is outside."""
        ways = self.move[:, :, None] + self.move[None, :, :]  # before, here, after
        return float(max((self.move.max(0)[y] + self.move.max(1)[y]) for y in (1, 2)) - ways[:, 0, :].min()) if LABELS else 0.0

    def viterbi(self, e: np.ndarray, before: int, after: int) -> list[int]:
        """The best labels of a run of tokens with emissions e, between labels before and after (-1: none)."""
        best = e[0] + (self.move[before] if before >= 0 else 0)
        back = []
        for row in e[1:]:
            ways = best[:, None] + self.move
            back.append(ways.argmax(0))
            best = ways.max(0) + row
        y = int((best + (self.move[:, after] if after >= 0 else 0)).argmax())
        out = [y]
        for b in reversed(back):
            y = int(b[y])
            out.append(y)
        return out[::-1]


class Tagger:
    """Emissions of tokens as sums of what their shape, their neighbours and their file give, remembered by token up to `room` tokens."""

    def __init__(self, crf: CRF, room: int = 400_000):
        self.crf, self.room, self.slack = crf, room, crf.slack()
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        # of each token, nine emissions (shape, next, last by label) and three largest margins over outside
        self.tables, self.margins = array("d"), array("d")
        self.words: dict[tuple[int, bool], list[float]] = {}
        self.rows = self.crf.emit.tolist()
        self.sides = [[self.rows[_slot(f"{where} alpha {alpha}")] for alpha in (False, True)] for where in ("next", "last")]

    def _number(self, token: str) -> int:
        k, alpha = len(self.at), token.isalpha()
        if alpha and len(token) < 40:  # most tokens are plain words, of a few shapes
            kind = min(len(token), 24) // 4, token.isupper()
            shape = self.words.get(kind)
            if shape is None:
                shape = self.words[kind] = self.crf.emit[shape_features(token)].sum(0).tolist()
        else:
            shape = self.crf.emit[shape_features(token)].sum(0).tolist()
        name = token.lower() if len(token) < 12 else "long"
        a, b, i = shape
        (c, d, j), (p, q, r) = self.rows[_slot(f"next {name}")], self.sides[0][alpha]
        (e, f, l), (x, y, z) = self.rows[_slot(f"last {name}")], self.sides[1][alpha]  # noqa: E741
        c, d, j, e, f, l = c + p, d + q, j + r, e + x, f + y, l + z  # noqa: E741
        self.tables.extend((a, b, i, c, d, j, e, f, l))
        self.margins.extend((max(b, i) - a, max(d, j) - c, max(f, l) - e))
        self.at[token] = k
        return k

    def numbers(self, ts: list[str]) -> np.ndarray:
        if len(self.at) + len(ts) > self.room:
            self.clear()
        get = self.at.get
        return np.array([k if (k := get(t)) is not None else self._number(t) for t in ts], np.int64)

    def emissions(self, ts: list[str], file: int) -> np.ndarray:
        ids = self.numbers(ts)
        t = np.frombuffer(self.tables).reshape(-1, 3, LABELS)
        e = t[ids, 0] + self.crf.emit[file]
        # what a token says of the one before it (it is its next) and after it (it is its last)
        e[:-1] += t[ids[1:], 1]
        e[1:] += t[ids[:-1], 2]
        return e

    def doubtful(self, ts: list[str], file: int) -> np.ndarray:
        """The tokens that may be other than outside: the sum of the largest margins of their parts is within what neighbours can make up for."""
        ids, o = self.numbers(ts), self.crf.emit[file]
        t = np.frombuffer(self.margins).reshape(-1, 3)
        m = t[ids, 0] + (max(o[1], o[2]) - o[0])
        m[:-1] += t[ids[1:], 1]
        m[1:] += t[ids[:-1], 2]
        return np.flatnonzero(m >= -self.slack - 1e-9)

    def spans(self, text: str) -> list[tuple[int, int]]:
        """The spans of begin and the insides that follow, over all tokens. Tokens that are outside on any best path cut the chain, which leaves the result of Viterbi as it is."""
        ts = _TOKEN.findall(text)
        if not ts:
            return []
        file = file_features(text)
        maybe = self.doubtful(ts, file)
        if not len(maybe):
            return []
        e = self.emissions(ts, file)
        runs = np.split(maybe, np.flatnonzero(np.diff(maybe) > 1) + 1)
        tagged = {}
        for run in runs:
            a, b = run[0], run[-1]
            ys = self.crf.viterbi(e[a : b + 1], 0 if a else -1, 0 if b + 1 < len(ts) else -1)
            tagged.update({a + i: y for i, y in enumerate(ys) if y})
        if not tagged:
            return []
        out: list[list[int]] = []
        for i, m in enumerate(_TOKEN.finditer(text)):
            y = tagged.get(i)
            if y == 2 and i - 1 in tagged:
                out[-1][1] = m.end()
            elif y:
                out.append([m.start(), m.end()])
        return [(a, b) for a, b in out]


#: What training puts for the word before a value, and the alphabets of the values that it makes up.
_NAMES = ("auth", "pwd", "key", "credential", "bearer", "access", "private", "client", "signing", "webhook", "session", "login", "conn", "cred", "jwt")
VARIANTS = 5
_ALPHABETS = tuple(a + b for a in ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for b in ("", "_-", "+/"))


def _made_up(rng: np.random.Generator) -> str:
    """A value of no certain form: random letters and digits, often after a short prefix, at times in parts."""
    chars = list(_ALPHABETS[rng.integers(len(_ALPHABETS))])
    some = lambda low, high: "".join(rng.choice(chars, rng.integers(low, high)))
    kind = rng.random()
    if kind < 0.4:
        return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 5))) + rng.choice(["_", "-"]) + (some(4, 8) + "_" if rng.random() < 0.3 else "") + some(20, 44)
    return ".".join((some(16, 40), some(20, 80), some(20, 48))) if kind < 0.5 else some(20, 56)


def _features(tokens: list[str], file: int, low: int, high: int) -> list[list[int]]:
    out = []
    for j in range(low, high):
        f = [*shape_features(tokens[j]), file]
        f += beside_features(tokens[j + 1], "next") if j + 1 < len(tokens) else []
        f += beside_features(tokens[j - 1], "last") if j else []
        out.append(f)
    return out


def _windows(texts: list[str], around: int = 15) -> list[tuple[list[list[int]], list[int]]]:
    """(features, labels) of token runs around base secrets, and of one run without any for each text.

    Each run around a secret comes as it is, and VARIANTS times with a made-up value under another name or none, so that the tagger learns shapes and neighbours and not the words and forms of the base patterns. In the runs
    without secrets, one word gets a name beside it, as a name alone makes no secret.
    """
    out = []
    for text in texts:
        rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
        spans = base_spans(text)
        # of an assignment the value is the secret
        values = [(m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6] + [(s, e) for s, e, k in spans if k != "assign"]
        found = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text)]
        if not found:
            continue
        tokens = [t for t, *_ in found]
        file, labels = file_features(text), [0] * len(found)
        for a, b in sorted(values):
            held = [i for i, (_, s, e) in enumerate(found) if s < b and e > a]
            for i in held:
                labels[i] = 1 if i == held[0] else 2
        hot = [i for i, y in enumerate(labels) if y == 1][:8]
        for i in [*hot, len(found) * 2 // 3]:
            low, high = max(0, i - around), min(len(found), i + around)
            out.append((_features(tokens, file, low, high), labels[low:high]))
        for i in hot * VARIANTS:
            end = i + 1
            while end < len(labels) and labels[end] == 2:
                end += 1
            low, high = max(0, i - around), min(len(found), end + around)
            if any(labels[low:i] + labels[end:high]):
                continue  # another secret is too near to be told apart
            name, sign = str(rng.choice(_NAMES)), [["="], [":"], ['="'], [":", '"'], ["=", "'"], [], []][rng.integers(7)]
            before = tokens[low:i]
            while before and (not before[-1].isalpha() or any(x in before[-1].lower() for x in _STEMS)):
                before.pop()  # the old name and its signs
            after = tokens[end:high]
            run = [*before, *([name] if sign else []), *sign, _made_up(rng), *(['"'] if sign and '"' in sign[-1] else []), *after]
            at = len(before) + bool(sign) + len(sign)
            out.append((_features(run, file, 0, len(run)), [int(j == at) for j in range(len(run))]))
        if not hot and len(tokens) > 4:
            i = int(rng.integers(0, len(tokens) - 1))
            run = [*tokens[max(0, i - 8) : i], str(rng.choice(_NAMES)), *([":"] if rng.random() < 0.5 else []), *tokens[i : i + 8]]
            out.append((_features(run, file, 0, len(run)), [0] * len(run)))
    return out


def fit_crf(windows: list, rounds: int = 60, rate: float = 0.2, ridge: float = 1e-3) -> CRF:
    """Weights by Adagrad on the log-likelihood of all windows at once; forward and backward run over them side by side."""
    crf = CRF(np.zeros((DIM, LABELS)), np.zeros((LABELS, LABELS)))
    if not windows:
        crf.emit[:] = [[1.0, 0.0, 0.0]]
        return crf
    n, t = len(windows), max(len(y) for _, y in windows)
    mask, y = np.zeros((n, t), bool), np.zeros((n, t), int)
    where, slots = [], []
    for i, (fs, ys) in enumerate(windows):
        mask[i, : len(ys)], y[i, : len(ys)] = True, ys
        for j, f in enumerate(fs):
            where += [i * t + j] * len(f)
            slots += f
    where, slots = np.array(where), np.array(slots)
    gold = np.zeros((n, t, LABELS))
    np.put_along_axis(gold, y[:, :, None], 1.0, 2)
    gold *= mask[:, :, None]
    pairs = mask[:, 1:] & mask[:, :-1]
    gold_move = np.einsum("nta,ntb->ab", gold[:, :-1] * pairs[:, :, None], gold[:, 1:])
    square, square_move = np.full(crf.emit.shape, 1e-8), np.full(crf.move.shape, 1e-8)
    for _ in range(rounds):
        e = np.stack([np.bincount(where, crf.emit[slots, k], minlength=n * t) for k in range(LABELS)], -1).reshape(n, t, LABELS)
        move = np.exp(crf.move)
        # scaled forward and backward; padding passes beliefs through unchanged
        pot = np.exp(e - e.max(-1, keepdims=True))
        a = np.zeros_like(e)
        a[:, 0] = pot[:, 0] / pot[:, 0].sum(-1, keepdims=True)
        for j in range(1, t):
            x = (a[:, j - 1] @ move) * pot[:, j]
            a[:, j] = np.where(mask[:, j, None], x / x.sum(-1, keepdims=True), a[:, j - 1])
        b = np.ones_like(e)
        for j in range(t - 2, -1, -1):
            x = (b[:, j + 1] * pot[:, j + 1]) @ move.T
            b[:, j] = np.where(mask[:, j + 1, None], x / x.sum(-1, keepdims=True), b[:, j + 1])
        p = a * b
        p = p / p.sum(-1, keepdims=True) * mask[:, :, None]
        joint = a[:, :-1, :, None] * move[None, None] * (pot[:, 1:] * b[:, 1:])[:, :, None, :]
        joint = joint / joint.sum((-1, -2), keepdims=True) * pairs[:, :, None, None]
        diff = (gold - p).reshape(n * t, LABELS)
        grad = np.stack([np.bincount(slots, diff[where, k], minlength=DIM) for k in range(LABELS)], -1) / n - ridge * crf.emit
        grad_move = (gold_move - joint.sum((0, 1))) / n - ridge * crf.move
        square, square_move = square + grad**2, square_move + grad_move**2
        crf.emit += rate * grad / np.sqrt(square)
        crf.move += rate * grad_move / np.sqrt(square_move)
    return crf


def train(docs: DataFrame, rows: int = 600) -> CRF:
    """Fits on at most `rows` texts that may hold a base pattern and as many others, bounded samples by hash of the whole table; equal texts count once."""
    small_batches(docs.sparkSession)
    text = docs.filter("text is not null").select("text", F.xxhash64("text").alias("h"))
    likely = F.col("text").rlike("[0-9a-f]{24}")
    for stem in ("AKIA", "password", "passwd", "secret", "token", "api"):
        likely |= F.col("text").contains(stem)
    hashes = stored(text.select("h", likely.alias("hit")).distinct(), "hits")
    chosen = bounded_sample(hashes.filter("hit"), ["h"], rows).unionByName(bounded_sample(hashes.filter("not hit"), ["h"], rows))
    # of a long text the driver gets what stands around its first secrets, or its first part
    found = text.join(F.broadcast(chosen), "h").dropDuplicates(["h"]).orderBy("h")
    return fit_crf(_pickled(found))


def _pickled(found: DataFrame) -> list:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [w for t in batch.column("text").to_pylist() for w in _windows([t])]
            features, labels = [[list(map(int, f)) for f in fs] for fs, _ in out], [ys for _, ys in out]
            yield pa.RecordBatch.from_arrays([pa.array(features, pa.list_(pa.list_(pa.int32()))), pa.array(labels, pa.list_(pa.int32()))], ["f", "y"])

    return sorted(([list(f) for f in r.f], list(r.y)) for r in found.select("text").mapInArrow(run, "f array<array<int>>, y array<int>").collect())


def scan_secrets(docs: DataFrame, crf: CRF) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_crf for each row; a null text counts as empty and has no spans."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                # a span of the CRF is news where no base span holds it
                more = [(a, b, "crf") for a, b in tagger.spans(text) if not any(s <= a and b <= e for s, e, _ in base)]
                join = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
                every = sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))
                counts = [sum(k == kind for _, _, k in every) for kind in KINDS]
                rows.append((*counts[:3], hashlib.sha256(join(base).encode()).hexdigest(), join(every), counts[3]))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_secrets(docs, train(docs))
