"""Periodic runs against a plain search of every period."""

import hashlib
import random
import zlib

import pytest

from gatewell.llm import periodic_runs

SF = "/root/testdata/sf0.001"


def brute(words):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= max(q, 12 - q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def row(doc_id, text, planted):
    words = (text or "").encode().split()
    if planted and doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    longest = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    runs_sha = hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
    return (doc_id, len(runs), *(longest or (None,) * 3), longest and 1000 * longest[1] // longest[2], runs_sha, hashlib.sha256(kept).hexdigest())


def test_runs_of_random_words():
    r = random.Random(7)
    for _ in range(1200):
        documents = []
        for _ in range(r.randint(1, 5)):
            n, kinds = r.choice([0, 1, 11, 12, 13, 24, 31, 64, 130]), r.choice([1, 2, 3, 6, 50])
            words = [b"%d" % r.randrange(kinds) for _ in range(n)]
            documents.append(periodic_runs.edited(words, 10 * r.randrange(1 << 20)) if r.random() < 0.5 else words)
        assert periodic_runs.find_runs(documents) == [brute(w) for w in documents]


@pytest.mark.parametrize("q", [1, 2, 5, 6, 7, 14, 15, 30, 31, 32, 33, 63, 64, 127])
def test_least_runs_at_each_place(q):
    for at in range(0, 2 * q + 9, 1 + q // 8):
        for more in (0, 1):
            length = max(12, 2 * q) - 1 + more
            words = [b"a%d" % i for i in range(at)] + [b"p%d" % (i % q) for i in range(length)] + [b"z%d" % i for i in range(at % 5)]
            assert periodic_runs.find_runs([words]) == [[(at, length, q)] if more else []]


def test_a_word_repeated_without_end():
    words = [b"w"] * 200_000 + [b"x"] + [b"w"] * 100_000
    runs = periodic_runs.find_runs([words])[0]
    assert (0, 200_000, 1) in runs and (200_001, 100_000, 1) in runs and (99_999, 200_002, 100_001) not in runs


def test_query_is_the_plain_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = {tuple(r) for r in periodic_runs.op11_periodic_runs(spark, SF).collect()}
    short = [d for d in docs if len(d.text or "") < 9000]
    assert len(short) > 150 and len(found) == len(docs)
    assert {row(d.doc_id, d.text, True) for d in short} <= found


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b " * 9), (4, "x y z " * 5), (4, "x y z " * 5), (5, "é é " * 14), (6, "w " * 70_000), (7, "A a " * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'k' h", "'k' n_runs", "'k' start")
    for planted in (False, True):
        found = [tuple(r) for r in periodic_runs.periodic_runs(docs, planted).collect()]
        assert {row(i, t, planted) for i, t in rows if i != 6} <= set(found) and len(found) == len(rows)
    assert [tuple(r)[1:6] for r in periodic_runs.periodic_runs(docs.filter("doc_id = 6")).collect()] == [(1, 0, 70_000, 1, 70_000_000)]
    assert periodic_runs.periodic_runs(docs.limit(0)).collect() == []
