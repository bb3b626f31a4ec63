"""SimHash near duplicates by multi-index hashing (operator 12).

Two fingerprints of 64 bits that differ in at most three bits differ in at most one bit of one of their halves. So each half
is a table: a fingerprint stands in it under its half, and asks it for all halves within one bit. As one of two halves that
differ in one bit has a zero there, it is enough to ask for the halves with one more bit set. What meets under a half is
verified by its complete distance.

Where more than `CROWD` fingerprints meet under a half, they are dealt again by the other half, of which at most three
bits differ, so that at most one does in one of its two quarters. Under a half and a quarter of the other stand at most
2^16 fingerprints, whatever the corpus. A meeting gives links that connect what is linked there, fewer than its members,
and the components of all links are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewell.llm.common import partitions, small_batches, stored, table
from gatewell.llm.graph import components

#: Fingerprints with at most so many differing bits are linked. The scheme of halves holds for 3.
BITS = 3
#: Words of a shingle.
WORDS = 3
#: Where more fingerprints meet under a half, they are dealt again by quarters of the other.
CROWD = 512
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 15


def simhash(text: bytes) -> int:
    """The fingerprint of a text: bit k is set if it is in over half the hashes of its shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(WORDS)))) if len(words) >= WORDS else [b" ".join(words)]  # noqa: B905 the last words begin none
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, 42) for s in shingles], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), AT_ONCE):
        ones += np.unpackbits(hashes[i : i + AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.array([simhash(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column("text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint's 64 bits as a signed number. A null or blank text has fingerprint zero."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _within_one_bit(key: Column, width: int) -> Column:
    """The key, and the keys with one more of its lowest `width` bits set."""
    return F.array_distinct(F.array(key, *[key.bitwiseOR(F.lit(1 << j)) for j in range(width)]))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (k, role, fp) in the order of k, links that connect what is at most BITS apart under a k."""
    rest = None
    for batch in batches:
        now = [batch.column(c).to_numpy() for c in ("k", "role", "fp")]
        rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
        cut = int(np.searchsorted(rest[0], rest[0][-1])) if len(rest[0]) else 0  # the last k may go on
        if cut:
            yield _forest(*(x[:cut] for x in rest))
            rest = [x[cut:] for x in rest]
    if rest is not None and len(rest[0]):
        yield _forest(*rest)


def _forest(k: np.ndarray, role: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    """Rows stand by k, those of role 2 or 3 first; the r-th of these is compared with all after it of its k, for all k at once.

    Two rows are compared if their roles together are 3. What is connected already needs no link.
    """
    fp = fp.view(np.uint64)
    opens = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    sizes = np.diff(np.append(opens, len(k)))
    asks = np.add.reduceat((role >= 2).astype(np.int64), opens)
    top = np.arange(len(k))
    a, b = [], []
    r = 0
    while len(opens):
        more = (asks > r) & (sizes > r + 1)
        opens, sizes, asks = opens[more], sizes[more], asks[more]
        many = sizes - r - 1
        one = np.repeat(opens + r, many)
        two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(many) - many, many)
        near = (role[one] | role[two] == 3) & (top[one] != top[two])
        one, two = one[near], two[near]
        near = np.bitwise_count(fp[one] ^ fp[two]) <= BITS
        for i, j in zip(one[near].tolist(), two[near].tolist(), strict=True):
            x, y = _root(top, i), _root(top, j)
            if x != y:
                top[max(x, y)] = min(x, y)
                a.append(i)
                b.append(j)
        if near.any():
            top = top[top]
        r += 1
    fp = fp.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(fp[np.array(x, np.int64)]) for x in (a, b)], ["a", "b"])


def _root(top: np.ndarray, i: int) -> int:
    while top[i] != i:
        top[i] = top[top[i]]
        i = top[i]
    return i


def links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints `prints` (fp) that connect all that are at most BITS bits apart.

    No pair of a crowd is written out: a meeting of m rows gives m - 1 links at most.
    """
    spark = prints.sparkSession
    small_batches(spark)
    low, high = (lambda x: x.bitwiseAND(F.lit((1 << 32) - 1))), (lambda x: F.shiftrightunsigned(x, 32))
    fp, k = F.col("fp"), F.col("k")
    # a table's key is its half, and which half it is, above its 32 bits
    each = prints.select("fp", F.explode(F.array(low(fp), high(fp).bitwiseOR(F.lit(1 << 32)))).alias("own"))
    asked = each.select("fp", F.explode(_within_one_bit(F.col("own"), 32)).alias("k"))
    there = each.select(F.col("own").alias("k")).distinct()
    met = stored(asked.join(there, "k", "left_semi"), "met")
    first = k.bitwiseAND(F.lit(1 << 32)) == 0
    mine = F.when(first, low(fp)).otherwise(high(fp)) == low(k)
    sizes = met.groupBy("k").agg(F.count("*").alias("size")).filter("size > 1")
    sized = met.join(sizes, "k").select("k", "fp", mine.alias("mine"), (F.col("size") > CROWD).alias("crowd"))
    calm = sized.filter("not crowd").select("k", F.when(F.col("mine"), 3).otherwise(1).alias("role"), "fp")
    other = F.when(first, high(fp)).otherwise(low(fp))
    base = F.shiftleft(k, 17).bitwiseOR(F.lit(1 << 62))
    quarters = F.array(base.bitwiseOR(other.bitwiseAND(F.lit(0xFFFF))), base.bitwiseOR(F.shiftright(other, 16)).bitwiseOR(F.lit(1 << 16)))
    dealt = sized.filter("crowd").select("fp", "mine", F.explode(quarters).alias("own")).select("fp", "mine", "own", F.explode(_within_one_bit(F.col("own"), 16)).alias("k"))
    crowd = dealt.select("k", (F.col("mine").cast("int") + F.when(F.col("k") == F.col("own"), 2).otherwise(0)).alias("role"), "fp")
    rows = calm.unionByName(crowd).repartition(partitions(spark), "k").sortWithinPartitions("k", F.col("role").desc())
    return rows.mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text).

    The component is the least doc_id reachable by links of at most three differing bits; null ids don't count for it, and a
    component of null ids alone has a null id. Null and blank texts have fingerprint zero and are linked like any other;
    repeated rows each give a row; an empty table gives none; other columns are ignored.
    """
    prints = stored(fingerprints(docs), "prints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(distinct.select("fp")))
    classed = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("class"))
    least = classed.groupBy("class").agg(F.min("least").alias("component_id"))
    known = classed.join(least, "class").select("fp", "component_id")
    return prints.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
