"""Spelling variants against distances between all pairs of words, and against their SQL."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from gatewell.llm import spelling
from tests.oracle import rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    by_length = collections.defaultdict(list)
    for w in counts:
        by_length[len(w)].append(w)
    out, forms = {}, {}
    for w, n in counts.items():
        others = [v for k in (-1, 0, 1) for v in by_length[len(w) + k] if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        if best and counts[best] >= 10 * n:
            forms[w] = best
        out[w] = len(others)

    def root(w):
        return root(forms[w]) if w in forms else w

    return sorted((w, forms.get(w), root(w), n, out[w], counts.get(forms.get(w))) for w, n in counts.items())


def words_of(rows, planted):
    out = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if planted and h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def columns(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_query_is_its_sql(spark):
    assert rows_of(spelling.op13_spelling(spark, SF)) == rows_of_sql(spelling.ORACLE_SQL["op13_spelling"], SF)


def test_query_is_the_plain_count(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert columns(spelling.op13_spelling(spark, SF)) == brute(words_of(docs, True))


@pytest.mark.parametrize("alphabet", ["ab", "abcÀÿ×"])
def test_variants_of_random_words(spark, alphabet):
    r = random.Random(len(alphabet))
    counts = {"".join(r.choice(alphabet) for _ in range(r.choice([1, 2, 6, 7, 8]))): r.choice([2, 3, 20, 30, 300, 5000, 10**12]) for _ in range(260)}
    assert columns(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == brute(counts)


def test_a_long_chain_of_forms(spark):
    counts = {"a" * (7 + i): 2 * 10**i for i in range(18)}
    found = {r.word: r.root for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert set(found.values()) == {"a" * 24}


def test_neighbourhood_is_whole_and_distinct():
    everything = np.full(4, ~np.uint64(0))  # a filter that rules nothing out
    for word, letters in (("aab", "abé"), ("a", "ab"), ("ééé", "é"), ("abcabca", "abc中")):
        got = [w for _, near in spelling.neighbours([word], list(letters), everything) for w in near]
        n = len(word)
        want = {word[:i] + word[i + 1 :] for i in range(n)} | {word[:i] + c + word[i + 1 :] for i in range(n) for c in letters} | {word[:i] + c + word[i:] for i in range(n + 1) for c in letters}
        assert sorted(got) == sorted(want - {word})


def test_filter_keeps_all_words_and_drops_most_others(spark):
    r = random.Random(1)
    words = sorted({"".join(r.choice("abcdeé") for _ in range(r.randint(7, 9))) for _ in range(4000)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    made = {(x.word, x.near) for x in spelling.emitted(df, list("abcdeé")).collect()}
    some = words[:150]
    assert {(a, b) for a in some for b in words if near(a, b)} <= made
    assert len(made) < 1.3 * sum(b in set(words) for _, b in made) + 4000


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "elephant Elephant"), (None, "elephant"), (3, "ELEPHANT Éléphants éléphants"), (3, "ELEPHANT elephanT"), (4, "elefant elefant elephants elephants"), (5, "anaconda " * 60_000), (6, "x" * 300 + " " + "x" * 300), (7, "中elephant中")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'k' word", "'k' n", "'k' run", "'k' id")
    for planted in (False, True):
        assert columns(spelling.spelling_variants(docs, planted)) == brute(words_of(rows, planted))
    assert spelling.spelling_variants(docs.limit(0)).collect() == []
    assert spelling.spelling_variants(docs.filter("doc_id < 3")).collect() == []
