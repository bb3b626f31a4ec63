"""Document fingerprints from prefix polynomial hashes (operator 9).

For a text with code points c0..c(n-1), H[i] = sum of c[j] * B^j for j < i, modulo a prime. With H and the
inverse powers of B, the hash of any span [i, j) is (H[j] - H[i]) * B^-i: equal spans have equal hashes
wherever they stand, so span equality is one comparison and the longest common extension of two positions
is a binary search over lengths. A fingerprint is made of span hashes alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewell.llm.common import partitions, small_batches, table

#: Two primes below 2^31, so that products of residues fit 64 bits, and a base for each.
PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1_000_003, 998_244_353)
SPAN = 24
SLOTS = 64


class _Powers:
    """B^i and B^-i modulo a prime, grown by doubling as longer texts come."""

    def __init__(self, base: int, prime: int):
        self.prime = np.uint64(prime)
        self.base, self.inverse = base, pow(base, -1, prime)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, int(self.prime))) % self.prime])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, int(self.prime))) % self.prime])
        return self.up[:n], self.down[:n]


_POWERS = [_Powers(b, p) for b, p in zip(BASES, PRIMES, strict=True)]


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class PrefixHash:
    """Prefix polynomial hashes of one text."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.h = []
        for powers in _POWERS:
            up, _ = powers.upto(self.n + 1)
            terms = (points.astype(np.uint64) + np.uint64(1)) * up[: self.n] % powers.prime
            self.h.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms) % powers.prime]))

    def span(self, i: int, j: int) -> int:
        """The 62-bit hash of the span [i, j), the same wherever the span stands."""
        out = 0
        for powers, h in zip(_POWERS, self.h, strict=True):
            p = int(powers.prime)
            out = out << 31 | (int(h[j]) - int(h[i])) % p * int(powers.upto(i + 1)[1][i]) % p
        return out

    def spans(self, k: int) -> np.ndarray:
        """Hashes of all spans of k code points, by the first prime."""
        powers, h, m = _POWERS[0], self.h[0], self.n - k + 1
        return (h[k:] + powers.prime - h[:m]) % powers.prime * powers.upto(self.n + 1)[1][:m] % powers.prime

    def extension(self, i: int, other: PrefixHash, j: int) -> int:
        """The length of the longest common extension of position i here and position j there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(i, i + mid) == other.span(j, j + mid):
                low = mid
            else:
                high = mid - 1
        return low


def _sketch(hashed: PrefixHash) -> np.ndarray:
    """The least mixed span hash of each of SLOTS classes of spans; a text shorter than SPAN is one span. Slot of no span: the largest value."""
    out = np.full(SLOTS, 0xFFFFFFFF, np.uint64)
    if hashed.n == 0:
        return out
    spans = hashed.spans(min(SPAN, hashed.n))
    mixed = spans * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    low = np.sort(mixed >> np.uint64(26))  # the top 6 of 38 bits are the class
    classes = low >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))
    out[classes[first].astype(np.int64)] = np.minimum(low[first] & np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFE))
    return out


def fingerprint(hashed: PrefixHash) -> str:
    """Length, hash of the whole text, and the least span hash of each class, in hex."""
    return f"{hashed.n:x}-{hashed.span(0, hashed.n):016x}-" + _sketch(hashed).astype(">u4").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """The share of classes in which two fingerprints agree, of those that either one fills; 1 for equal texts, 0 if only one is empty."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rpartition("-")[2]), ">u4") for f in (a, b))
    filled = (x != 0xFFFFFFFF) | (y != 0xFFFFFFFF)
    return float(((x == y) & filled).sum() / max(1, filled.sum()))


_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix_edited long"
)


def _row(doc_id, text: str, mine: tuple[PrefixHash, str], after: str, theirs: tuple[PrefixHash, str]) -> tuple:
    n = len(text)
    edited = text[: n - n // 2] + after[: n // 2]
    hashed = PrefixHash(codepoints(edited))
    print_ = fingerprint(hashed)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, n, sha, mine[1], print_, likeness(mine[1], print_), likeness(mine[1], theirs[1]), mine[0].extension(0, hashed, 0)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket and order; a bucket's last row is its guest, the head of the next bucket."""
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    last = None
    for batch in batches:
        out = []
        for bucket, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "text")), strict=True):
            hashed = PrefixHash(codepoints(text))
            this = (hashed, fingerprint(hashed))
            if last and last[0] == bucket:
                out.append(_row(last[1], last[2], last[3], text, this))
            last = bucket, doc_id, text, this
        columns = list(zip(*out, strict=True)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints each text and its edited text, whose second half is the start of the next document's text.

    The next document has the next smaller doc_id (nulls last, equal ids by text); after the last comes the
    first. A null text counts as empty; an empty table gives no rows; other columns are ignored.

    Texts are shuffled once. Buckets are ranges of doc_id whose bounds are ids in the table, so the head of
    each bucket is known beforehand, and is sent to the bucket before it as well; no task needs another's rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.filter("doc_id is not null").select("doc_id")
    rows = ids.count()
    buckets = max(1, min(4 * partitions(spark), rows // 50))  # several to a partition, so that partitions are alike
    found = ids.selectExpr(f"percentile_approx(doc_id, array({', '.join(repr((i + 1) / buckets) for i in range(buckets))}), {20 * buckets}) b").first()
    bounds = sorted({*(found.b or [])}, reverse=True)  # the largest id is among them: it heads the first bucket
    if not bounds:
        bounds = [None]
    heads = spark.createDataFrame([(i, b) for i, b in enumerate(bounds)], "head int, bound long")
    # bucket i holds the ids from bounds[i] down to above bounds[i + 1]; nulls come last, in the last bucket
    up = F.array(*[F.lit(b) for b in reversed(bounds) if b is not None]).cast("array<long>")
    n = len(bounds)
    at = F.when(F.col("doc_id").isNull(), n - 1).otherwise(F.lit(n - 1) - F.size(F.filter(up, lambda x: x < F.col("doc_id"))))
    placed = docs.withColumn("bucket", F.greatest(at, F.lit(0)).cast("int"))
    # the first row of each bucket, by the order of rows: of rows with the bound's id, the one with the least text
    first = placed.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("bound"))).groupBy("head", "doc_id").agg(F.min("text").alias("text"))
    guests = first.select("doc_id", "text", ((F.col("head") + n - 1) % n).cast("int").alias("bucket"), F.lit(1).alias("guest"))
    both = placed.select("doc_id", "text", "bucket", F.lit(0).alias("guest")).unionByName(guests)
    dealt = both.repartition(partitions(spark), "bucket")
    ordered = dealt.sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "text")
    return ordered.select("bucket", "doc_id", "text").mapInArrow(_pairs, _SCHEMA)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_neighbours(table(spark, sf_dir, "documents"))
