import numpy as np
import pytest
from pyspark.sql import functions as F

from quellspan.llm import queries, vectors

COLUMNS = "vec_id long, embedding array<double>, score string"


def plain(rows, answers, every=20):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = []
    for a, (i, v) in enumerate(ok):
        if i % every == 0:
            found = sorted((-float(w @ v), j) for b, (j, w) in enumerate(ok) if a != b and len(w) == len(v))[:answers]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return out


def recall(got, want):
    score = {}
    for i, r, _, s in want:
        score[i] = min(score.get(i, np.inf), s)
    hits = sum(s >= score[i] - 1e-9 for i, _, _, s in got)
    return hits / len(want)


def test_odd_rows_and_ties_are_exact_when_few(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(120)]
    rows += [(200 + i, [1.0] * 8) for i in range(60)] + [(40, [1.0] * 8), (40, [1.0] * 8)]
    rows += [(20, None), (60, []), (80, [0.0] * 8), (100, [1.0, None] + [0.0] * 6), (300, [float("nan")] + [1.0] * 7), (None, [1.0] * 8), (320, [1.0, 2.0, 3.0]), (321, [1.0, 0.0, 0.5])]
    got = [tuple(r) for r in vectors.nearest(spark.createDataFrame([(*r, "x") for r in rows], COLUMNS), F.col("id") % 20 == 0, answers=10).collect()]
    want = plain(rows, 10)
    key = lambda r: (r[0], r[1], r[2])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], abs=1e-12)


@pytest.mark.parametrize("shape", ["sphere", "lengths", "cluster"])
def test_recall(spark, shape):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 64))
    if shape == "lengths":
        x *= rng.lognormal(0, 0.5, (4000, 1))
    if shape == "cluster":
        x[:1500] = x[0] + rng.normal(size=(1500, 64)) * 0.05
    rows = list(enumerate(x.tolist()))
    got = [tuple(r) for r in vectors.nearest(spark.createDataFrame([(*r, "x") for r in rows], COLUMNS), F.col("id") % 20 == 0).collect()]
    want = plain(rows, 20)
    assert len(got) == len(want) and recall(got, want) >= 0.9


def test_graph_keeps_a_bounded_degree():
    x = vectors.lifted(np.random.default_rng(1).normal(size=(500, 16)))
    graph, entries = vectors.build_graph(x, 12, 32, 1.2)
    assert graph.shape == (501, 12) and len(entries) == vectors.ENTRIES
    assert all(len(set(g[g < 500])) == (g < 500).sum() and i not in g for i, g in enumerate(graph[:500]))


def test_empty_table(spark):
    assert vectors.nearest(spark.createDataFrame([], COLUMNS), F.col("id") % 20 == 0).count() == 0


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got, want = [tuple(r) for r in queries.op9_vectors(spark, sf_dir).collect()], plain(rows, 20)
    assert len(got) == len(want) and recall(got, want) >= 0.9
