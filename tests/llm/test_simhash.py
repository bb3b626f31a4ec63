"""SimHash links against all pairs of small tables, and fingerprints against a plain count of bits."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from gatewell.llm import simhash

SF = "/root/testdata/sf0.001"


def plain_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(prints):
    """prints: fingerprint -> least id; the least id reachable."""
    top = {f: f for f in prints}

    def root(f):
        while top[f] != f:
            f = top[f]
        return f

    known = list(prints)
    for i, f in enumerate(known):
        for g in known[:i]:
            if (f ^ g).bit_count() <= 3:
                top[root(f)] = root(g)
    least = {}
    for f, i in prints.items():
        least[root(f)] = min((x for x in (least.get(root(f)), i) if x is not None), default=None)
    return {f: least[root(f)] for f in prints}


def expected(rows):
    prints = {}
    for i, t in rows:
        f = plain_print(t)
        prints[f] = min((x for x in (prints.get(f), i) if x is not None), default=None)
    found = components(prints)
    return sorted(((i, f"{plain_print(t):016x}", found[plain_print(t)]) for i, t in rows), key=repr)


def test_query_is_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, simhash.op12_simhash(spark, SF).collect()), key=repr) == expected(docs)


@pytest.mark.parametrize("crowd", [512, 8])
def test_links_of_planted_families(spark, monkeypatch, crowd):
    """Families around centres, differing in few bits, also where a whole half is shared; crowds are dealt by quarters."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    r = random.Random(3)
    prints = {0, (1 << 64) - 1}
    for _ in range(6):
        centre = r.getrandbits(64)
        weak = [r.sample(range(64), 9), r.sample(range(32), 9), r.sample(range(32, 64), 9)][r.randrange(3)]
        prints |= {centre ^ sum(1 << b for b in r.sample(weak, r.randint(0, 5))) for _ in range(60)}
        prints |= {centre & 0xFFFFFFFF | r.getrandbits(32) << 32 for _ in range(20)}
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(df).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    top = {p: p for p in prints}

    def root(p):
        while top[p] != p:
            p = top[p]
        return p

    for a, b in links:
        top[max(root(a), root(b))] = min(root(a), root(b))
    least = components({p: p for p in prints})
    assert {p: root(p) for p in prints} == least


def test_links_grow_with_the_rows_of_a_crowd(spark):
    """All 2^11 fingerprints over eleven weak bits: 2^11 x 232 / 2 pairs are linked, but few rows say so."""
    weak = [1, 5, 9, 33, 38, 40, 44, 50, 55, 60, 62]
    prints = [sum(1 << b for j, b in enumerate(weak) if i >> j & 1) for i in range(1 << 11)]
    links = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    assert links.count() < 120 * len(prints)


def test_odd_rows(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "a b c"), (None, None), (4, " \t"), (5, "word " * 70_000), (6, "é" * 50), (None, "q w e r"), (7, "A B C"), (9, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("fp", "k", "a", "component_id", "fingerprint")})
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=repr) == expected(rows)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
