"""URL filtering by a Bloom filter cascade (operator 4).

Level 0 encodes the listed keys; level 1 the keys of the corpus that level 0 takes for listed though they are
not; level 2 the listed keys that level 1 takes for those; and so on, until a level has no false positives over
the complete key universe. A key of the corpus is listed if the first level that does not hold it has an odd
number. So membership is exact for each key of the corpus, and rows are judged by the filters alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewell.llm.common import stored, table

#: The rules: (host, path, verdict). A rule fits its host and all subdomains, if the path starts with its path; the longest wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: The listed domains, subdomains included.
LISTED = (
    "ads-track.example.com",
    "spam-farm.example.org",
    "casino-win.example.net",
    "adult-x.example.com",
    "cheap-pills.example.net",
    "cheap-pills.example.com",
    "free-bets.example.net",
)


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or no ://."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and the domains above it: a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), else null. Of rules of equal length, the one earlier in code point order."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _places(a: np.ndarray, b: np.ndarray, level: int, bits: int, hashes: int) -> list[np.ndarray]:
    """The bits of keys with hashes a and b at a level, by double hashing."""
    with np.errstate(over="ignore"):
        x = (a ^ np.uint64(level * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        return [(x + np.uint64(i) * (b | np.uint64(1))) % np.uint64(bits) for i in range(hashes)]


@dataclass
class Cascade:
    """The filters, from level 0 on: bits (a byte each eight) and the number of hashes."""

    levels: list[tuple[np.ndarray, int, int]] = field(default_factory=list)

    def nbytes(self) -> int:
        return sum(x.nbytes for x, _, _ in self.levels)

    def at(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        packed, bits, hashes = self.levels[level]
        held = np.ones(len(a), bool)
        for p in _places(a, b, level, bits, hashes):
            held &= packed[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1 == 1
        return held

    def listed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether keys of the universe with these hashes are listed."""
        out, left = np.zeros(len(a), bool), np.arange(len(a))
        for level in range(len(self.levels)):
            held = self.at(level, a[left], b[left])
            out[left[~held]] = level % 2 == 1
            left = left[held]
        out[left] = len(self.levels) % 2 == 1
        return out


def key_hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b")]


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.asarray(batch.column(c)).view(np.uint64) for c in ("a", "b"))


def _kept(keys: DataFrame, cascade: Cascade, level: int) -> DataFrame:
    """The keys that a level holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(cascade.at(level, *_arrays(batch))))

    return keys.mapInArrow(run, keys.schema)


def _level(keys: DataFrame, level: int, bits: int, hashes: int) -> np.ndarray:
    """The filter over keys. Each task sets bits of its own; they meet as (byte, or of bits), so the driver gets the filter, not the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(-(-bits // 8), np.uint8)
        for batch in batches:
            for p in _places(*_arrays(batch), level, bits, hashes):
                np.bitwise_or.at(mine, p >> np.uint64(3), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
        at = np.flatnonzero(mine)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(mine[at].astype(np.int32))], ["byte", "bits"])

    out = np.zeros(-(-bits // 8), np.uint8)
    parts = keys.mapInArrow(run, "byte long, bits int").groupBy("byte").agg(F.bit_or("bits").alias("bits")).toPandas()
    out[parts["byte"].to_numpy(np.int64)] = parts["bits"].to_numpy(np.uint8)
    return out


def build_cascade(universe: DataFrame, listed: DataFrame, max_bytes: int = 64 << 20) -> Cascade | None:
    """The cascade that tells listed keys from all others of the universe; both have columns a and b, without repeats.

    None if it would take more than max_bytes: then membership is for a join.
    """
    inside = stored(listed.join(universe, ["a", "b"], "left_semi"), "listed")
    outside = stored(universe.join(listed, ["a", "b"], "left_anti"), "unlisted")
    cascade, sets = Cascade(), [inside, outside]
    n, others = inside.count(), outside.count()
    while n:
        level = len(cascade.levels)
        # rates that keep the whole cascade small: at first as rare as the listed keys among the others, then one half
        rate = min(0.5, n * math.sqrt(0.5) / max(1, others)) if level == 0 else 0.5
        hashes = max(1, round(-math.log2(rate)))
        bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
        if cascade.nbytes() + bits / 8 > max_bytes:
            return None
        cascade.levels.append((_level(sets[0], level, bits, hashes), bits, hashes))
        wrong = stored(_kept(sets[1], cascade, level), f"level{level}")
        n, others, sets = wrong.count(), n, [wrong, sets[0]]
    return cascade


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES, max_bytes: int = 64 << 20) -> DataFrame:
    """Each page's host, path, rule and verdict; listed has a column host, and holds for subdomains too.

    A null url or one without :// has an empty host and path, fits no rule and is allowed; repeated pages are judged
    each; an empty table gives no rows; other columns are ignored. The universe is every domain at or above a
    host of the corpus. Filters go to all tasks up to max_bytes; a list beyond that is joined instead.
    """
    # a host of many pages is met as one key, counted where it is read
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = judged.select("host").distinct()
    universe = stored(hosts.select(F.explode(suffixes(F.col("host"))).alias("key")).filter("key != ''").distinct().select(*key_hashes(F.col("key"))), "universe")
    keys = listed.select(F.lower("host").alias("key")).filter("key is not null and key != ''").distinct().select(*key_hashes(F.col("key")))
    cascade = build_cascade(universe, keys, max_bytes)
    judged = judged.withColumn("rule_", rule_of(F.col("host"), F.col("path"), rules))
    if cascade is None:
        found = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("key")).select("host", *key_hashes(F.col("key"))).join(keys, ["a", "b"], "left_semi").select("host").distinct()
        judged = judged.join(found.withColumn("listed", F.lit(True)), "host", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    else:
        shared = pages.sparkSession.sparkContext.broadcast(cascade)

        @F.pandas_udf("boolean")
        def is_listed(a: pd.Series, b: pd.Series) -> pd.Series:
            counts = a.map(len).to_numpy()
            flat = [np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64).view(np.uint64) for x in (a, b)]
            held = np.concatenate([[0], np.cumsum(shared.value.listed(*flat))])
            ends = np.cumsum(counts)
            return pd.Series(held[ends] > held[ends - counts])

        parts = F.filter(suffixes(F.col("host")), lambda x: x != "")
        a, b = (F.transform(parts, f) for f in (lambda x: key_hashes(x)[0], lambda x: key_hashes(x)[1]))
        judged = judged.withColumn("listed", is_listed(a, b))
    verdict = F.coalesce(F.col("rule_.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("rule_.rule").alias("rule"), verdict.alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(h,) for h in LISTED], "host string")
    return judge_urls(table(spark, sf_dir, "pages"), listed)


def _sql() -> str:
    fits = "({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with(path, '{p}')"
    order = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    rule, verdict = (" ".join(f"WHEN {fits.format(host='host', h=h, p=p)} THEN '{out}'" for h, p, v in order for out in [h + p if k == 0 else v]) for k in range(2))
    listed = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in LISTED)
    return f"""
WITH parsed AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages)
SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule, CASE {verdict} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict
FROM parsed"""


ORACLE_SQL = {"op4_url_filter": _sql()}
