"""Near-dedup by overlap finds every pair, not nearly every one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quellspan.llm import simhash


def test_no_pair_is_missed(spark):
    """3,000 pairs at overlap 0.8 itself (eight of ten shingles), of which MinHash bands and bounds on estimates miss a few."""
    rng, rows = random.Random(11), []
    for k in range(3000):
        words = [f"w{rng.randrange(10**9)}" for _ in range(13)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:12], "other"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()} == set(range(0, 6000, 2))


def sets_at(rng, size, overlap):
    """Two sets that just reach an overlap."""
    n, m = size, rng.randint(int(np.ceil(size * overlap)), size)
    both = int(np.ceil(overlap * (n + m) / (1 + overlap) - 1e-9))
    if both > m:
        return sets_at(rng, size, overlap)
    draw = np.unique(np.array([rng.getrandbits(64) for _ in range(n + m - both)], np.uint64))
    rng_ = np.random.default_rng(rng.getrandbits(32))
    draw = rng_.permutation(draw)
    return np.sort(draw[:n]), np.sort(np.concatenate([draw[:both], draw[n:]]))


@pytest.mark.parametrize("overlap", [0.5, 0.8, 0.9])
def test_bounds_hold_for_pairs_at_the_overlap(overlap):
    """The first shared shingle stands among the first of both, at the places that are asked for, and cells differ no more than sets."""
    rng = random.Random(3)
    for size in [*range(1, 60), 200, 1000, 5000]:
        a, b = sets_at(rng, size, overlap)
        both = len(np.intersect1d(a, b))
        assert both / (len(a) + len(b) - both) >= overlap
        union = np.union1d(a, b)
        for common in (union[:0], union[::2], union):
            ranks = np.random.default_rng(size).permutation(len(common))
            x, y = (simhash._prefix(s, common, ranks, overlap) for s in (a, b))
            shared = next(h for h in x.tolist() if h in set(y.tolist()))
            need = int(np.ceil((len(a) + len(b)) * (overlap / (1 + overlap)) - simhash.SLACK))
            assert x.tolist().index(shared) <= len(a) - need and y.tolist().index(shared) <= len(b) - need
        assert len(a) + len(b) - 2 * both <= len(a) + len(b) - 2 * need


def test_cells_differ_no_more_than_sets(spark):
    """Also where one set has twice the cells of the other, and where sets apart differ in so many that they are told apart."""
    rng, rows = random.Random(4), []
    for overlap in (0.5, 0.8, 0.9):
        for size in (1, 2, 10, 300, 513, 520, 560, 1030, 1100, 2049, 2100, 5000):
            a, b = sets_at(rng, size, overlap)
            c = np.array([rng.getrandbits(64) for _ in range(len(b))], np.uint64)
            for other in (b, c):
                differ = len(a) + len(other) - 2 * len(np.intersect1d(a, other))
                rows.append((simhash._parities(a).tolist(), simhash._parities(other).tolist(), differ, len(a) + len(other), other is c))
    docs = spark.createDataFrame(rows, "a array<long>, b array<long>, differ int, n int, strange boolean")
    found = docs.select("*", simhash._apart(F.col("a"), F.col("b")).alias("apart")).collect()
    assert any(len(r.a) == 2 * len(r.b) for r in found)
    assert all(r.apart <= r.differ for r in found)
    assert all(r.apart > r.n / 9 for r in found if r.strange and r.n > 100)


def test_common_shingles_change_no_result(spark, monkeypatch):
    """With nearly all shingles put last, the same texts stay."""
    rng, rows = random.Random(8), []
    phrase = [f"p{i}" for i in range(40)]
    for k in range(150):
        words = [*phrase, *(f"w{k // 3}x{i}" for i in range(60))]
        words[rng.randrange(100)] = f"c{k}"
        words[rng.randrange(100)] = f"d{k}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stay = {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()}
    monkeypatch.setattr(simhash, "COMMON_LEAST", 1)
    monkeypatch.setattr(simhash, "COMMON_OF", 1)
    assert {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()} == stay
    sets = [simhash.shingle_hashes(t.encode(), 5, 42) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if root[i] != root[j] and both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    assert stay == set(root)
