import hashlib
import random
import re
from collections import Counter

import pytest

from quellspan.llm import mixing, queries

COLUMNS = "doc_id long, text string, lang string, source string"


def plain_mix(rows, powers, rounds=mixing.ROUNDS):
    topic = lambda t: next((n for n, mark in mixing.TOPICS if mark in t), "prose")
    docs = [(i, s or "", la or "", topic(t or ""), len(re.findall(mixing.WORD, t or ""))) for i, t, la, s in rows]
    cells = Counter()
    for _, s, la, t, n in docs:
        cells[s, la, t] += n
    total = sum(cells.values())
    share = []
    for k, d in enumerate(mixing.DIMENSIONS):
        own = Counter()
        for c, n in cells.items():
            own[c[k]] += n
        raw = {v: n ** powers[d] for v, n in own.items() if n}
        share.append({v: x / sum(raw.values()) for v, x in raw.items()})
    w = {c: n / total for c, n in cells.items() if n}
    for _ in range(rounds):
        for k in range(3):
            own = Counter()
            for c, x in w.items():
                own[c[k]] += x
            w = {c: x * share[k][c[k]] / own[c[k]] for c, x in w.items()}
    weight = {c: w.get(c, 0) * total / n if n else 0.0 for c, n in cells.items()}
    top = max(weight.values())
    out = []
    for i, s, la, t, n in docs:
        p = round(min(1.0, weight[s, la, t] / top), 6)
        u = int(hashlib.md5(f"{'' if i is None else i}:17".encode()).hexdigest()[:8], 16) / 2**32
        out.append((i, s, la, t, n, weight[s, la, t], p, u < p))
    return out, w, share


def fixture_rows():
    rng = random.Random(8)
    marks = ["", "", "", " | x", " license ", " a@b "]
    rows = [(i, " ".join(["word"] * rng.randint(1, 80)) + rng.choice(marks), rng.choice(["en", "en", "de", "fr"]), rng.choice(["hot", "hot", "hot", "s1", "s2"])) for i in range(600)]
    return rows + [(None, None, None, None), (7, "", "zz", "empty"), (8, "dup dup", "en", "s1"), (8, "dup dup", "en", "s1")]


def test_matches_brute_force(spark):
    rows = fixture_rows()
    want, w, share = plain_mix(rows, mixing.POWERS)
    got = [tuple(r) for r in mixing.mixed(spark.createDataFrame(rows, COLUMNS)).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    for g, x in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == x[:5] and g[5] == pytest.approx(x[5], abs=1e-5) and g[6] == pytest.approx(x[6], abs=2e-6) and g[7] == x[7]
    for k in range(3):
        for v, target in share[k].items():
            assert sum(x for c, x in w.items() if c[k] == v) == pytest.approx(target, rel=0.01)


def test_given_targets_and_kept_columns(spark):
    rows = fixture_rows()
    docs = spark.createDataFrame([(*r, 1.5) for r in rows], COLUMNS + ", weight double")
    even = {d: spark.createDataFrame([(v, 1.0) for v in values], "value string, share double") for d, values in (("source", ["hot", "s1", "s2"]), ("lang", ["en", "de", "fr"]), ("topic", ["prose", "table", "licence", "address"]))}
    got = mixing.mixed(docs, targets=even).collect()
    tokens = Counter()
    for r in got:
        tokens[r.source] += r.n_tokens * r.weight
    assert tokens["hot"] == pytest.approx(tokens["s1"], rel=0.02) and tokens["s1"] == pytest.approx(tokens["s2"], rel=0.02)
    assert {r.kept for r in got if r.source in ("", "empty")} == {False}
    kept = mixing.sample(docs, targets=even)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)


def test_empty_table(spark):
    assert mixing.mixed(spark.createDataFrame([], COLUMNS)).count() == 0


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    want, _, _ = plain_mix([tuple(r) for r in docs], mixing.POWERS)
    got = sorted(tuple(r) for r in queries.op8_mixing(spark, sf_dir).collect())
    assert [(g[0], g[7]) for g in got] == [(x[0], x[7]) for x in sorted(want)]
