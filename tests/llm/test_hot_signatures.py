"""Hot signatures of the n-gram join: nothing is lost, and what is dealt grows with the sets and not with their square."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewell.llm import ngram_join
from tests.llm.test_ops import frame, linked


def corpus(copies, other, seed=8):
    """Near copies of one text, and texts that have a passage in common and little else."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(copies):
        words = list(base)
        for at in rng.integers(0, 60, k % 3):
            words[at] = f"v{k}x{at}"
        rows.append((k, " ".join(words)))
    passage = [f"p{i}" for i in range(50)]
    for k in range(other):
        rows.append((10_000 + k, " ".join([*(f"q{k}x{i}" for i in range(25)), *passage, *(f"r{k}x{i}" for i in range(25))])))
        if k % 4 == 0:
            rows.append((20_000 + k, " ".join([*(f"q{k}x{i}" for i in range(25)), *passage, *(f"r{k}x{i}" for i in range(23)), "end", "of"])))
    return rows


@pytest.mark.parametrize("most", [4])
def test_hot_signatures_lose_no_link(spark, most):
    rows = corpus(40, 40)
    assert sorted(map(tuple, ngram_join.link_documents(frame(spark, rows), most=most, room=2000).collect())) == linked(rows)


def test_single_signatures_lose_no_similar_pair():
    rng = np.random.default_rng(9)
    for n in [*range(1, 40), 100, 317]:
        for _ in range(8):
            s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            gone, new = int(rng.integers(0, n // 5 + 1)), int(rng.integers(0, n // 5 + 1))
            t = np.unique(np.concatenate([rng.permutation(s)[gone:], rng.integers(0, 1 << 63, new, dtype=np.uint64)]))
            common = np.unique(rng.permutation(s)[: n // 3])
            level = rng.integers(1, 20, len(common))
            both = len(np.intersect1d(s, t))
            if both and 100 * both >= 80 * (len(s) + len(t) - both):
                assert np.intersect1d(ngram_join.single_signatures(s, common, level), ngram_join.single_signatures(t, common, level)).size


def test_rows_dealt_for_a_hot_signature_grow_in_proportion(spark):
    """One signature of 200 and of 400 sets, dealt in blocks of 10: each set goes to one block, and gives at most two edges."""
    rng = np.random.default_rng(10)
    for n in (200, 400):
        kinds = [rng.integers(0, 3, ngram_join.CLASSES).astype(np.uint8) for _ in range(6)]
        sets = [(u, int(kinds[u % 6].sum()), bytearray(kinds[u % 6].tobytes())) for u in range(n)]
        traits = spark.createDataFrame(sets, "u long, n long, k binary")
        shared = traits.select(F.lit(5).cast("long").alias("sig"), "u", F.lit(n).cast("long").alias("m"))
        edges = ngram_join._hot_families(shared, traits, 10).collect()
        assert n - 6 <= len(edges) <= 2 * n
        root = list(range(n))
        find = lambda x: x if root[x] == x else find(root[x])
        for e in edges:
            root[find(e.a)] = find(e.b)
        assert all(find(u) == find(u % 6) for u in range(n))
