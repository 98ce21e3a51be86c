import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quellspan.llm import kneser_ney as kn
from quellspan.llm import queries


def words(text):
    return (text or "").encode().lower().split()


class Plain:
    """The model from its definition, by dictionaries."""

    def __init__(self, texts):
        self.c = {3: Counter()}
        for t in texts:
            seq = ["<s>", "<s>", *words(t), "</s>"]
            self.c[3].update(zip(seq, seq[1:], seq[2:]))
        self.c[2] = Counter(g[1:] for g in self.c[3])
        self.c[1] = Counter(g[1:] for g in self.c[2])
        self.d = {k: self.cuts(c) for k, c in self.c.items()}
        self.by = {k: defaultdict(list) for k in self.c}
        for k, c in self.c.items():
            for g, n in c.items():
                self.by[k][g[:-1]].append(n)

    @staticmethod
    def cuts(counts):
        n = [sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)]
        if not all(n):
            return [0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        d = [k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)]
        return d if 0 < d[0] < 1 and 0 < d[1] < 2 and 0 < d[2] < 3 else [0.5, 1.0, 1.5]

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / (len(self.c[1]) + 1)
        off = lambda n: self.d[k][min(n, 3) - 1]
        seen = self.by[k].get(gram[:-1])
        if not seen:
            return self.p(gram[1:])
        n = self.c[k][gram]
        return ((n - off(n)) if n else 0) / sum(seen) + sum(map(off, seen)) / sum(seen) * self.p(gram[1:])

    def log10(self, text):
        seq = ["<s>", "<s>", *words(text), "</s>"]
        return sum(math.log10(self.p(g)) for g in zip(seq, seq[1:], seq[2:]))


def texts(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "Ünd", "the", "THE"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [" ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 3, 120])
def test_log_probabilities_match_the_definition(spark, n):
    train, other = texts(n), [*texts(30, 2), "", " \n\t ", "unseen words only", "x" * 60_000, None]
    plain = Plain(train)
    model = kn.fit(spark.createDataFrame([(t,) for t in train], "text string").repartition(3))
    sizes, logs = kn.log_probabilities(kn.lookup_tables(model), model["unknown"], pa.array(train + other))
    assert sizes.tolist() == [len(words(t)) + 1 for t in train + other]
    assert logs.tolist() == pytest.approx([plain.log10(t) for t in train + other], rel=1e-5)


def test_probabilities_add_up(spark):
    plain = Plain(texts(50))
    vocabulary = [g[0] for g in plain.c[1]]
    for context in [(b"w0", b"w1"), (b"w3", b"never"), ("<s>", "<s>")]:
        assert sum(plain.p((*context, w)) for w in vocabulary) + plain.p((*context, b"unk")) == pytest.approx(1)


def test_classify(spark):
    good = texts(400)
    rng = random.Random(3)
    junk = [" ".join(f"zz{rng.randint(0, 10**6)}" for _ in range(40)) for _ in range(20)]
    rows = [(i, t, "en" if i % 2 else "de", i) for i, t in enumerate(good)] + [(1000 + i, t, "en", 0) for i, t in enumerate(junk)]
    rows += [(2000, None, None, 0), (5, good[5], "en", 5), (None, "w0 w1 w2", "xx", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    trusted = spark.createDataFrame([(i,) for i in range(400)] + [(7,), (None,)], "doc_id long")
    got = kn.classify(docs, trusted, sample_rows=150).collect()
    assert len(got) == len(rows)
    assert not any(r.kept for r in got if r.doc_id is not None and 1000 <= r.doc_id < 2000)
    assert sum(not r.kept for r in got if r.doc_id is not None and r.doc_id < 400) <= 8


def test_no_trusted_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long")
    assert [r.kept for r in kn.classify(docs, none).collect()] == [True]
    assert kn.classify(docs.limit(0), none).count() == 0


def test_lookup_of_colliding_shards():
    keys = np.concatenate([np.arange(50, dtype=np.uint64), np.array([1 << 63, (1 << 64) - 1], np.uint64)])
    table = kn.Sums(keys, np.arange(52.0))
    assert table.get(keys).tolist() == list(range(52)) and np.isnan(table.get(keys + np.uint64(60))).any()


def test_query(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op3_kneser_ney(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert {d.doc_id: len(words(d.text)) + 1 for d in docs} == {k: r.n_tokens for k, r in got.items()}
    good = [got[d].kept for d in got if labels.get(d) == 1]
    assert sum(good) / len(good) > 0.95


def test_every_trusted_row_takes_part(spark):
    """Beyond the former sample of 4,096 rows and 20,000 characters: counts, perplexities and thresholds by the definition."""
    good = [*texts(4300, 4), " ".join(texts(900, 5))]
    assert len(good[-1]) > kn.LONGEST_SAMPLE
    rows = [(i, t, "de" if i % 3 else None) for i, t in enumerate(good)] + [(9000, None, "xx"), (9001, "", "xx"), (None, good[3], "en"), (9002, good[3], "en"), (9002, "never seen", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    trusted = spark.createDataFrame([(i,) for i in range(len(good))] + [(None,)], "doc_id long")
    share = {r.doc_id: r.s for r in trusted.select("doc_id", kn.share_of("doc_id").alias("s")).collect()}
    train = [i for i in range(len(good)) if share[i] < kn.TRAINS]
    assert len(train) > 3800
    plain, n = Plain([good[i] for i in train]), lambda t: len(words(t)) + 1
    of = {t: 10 ** (-plain.log10(t) / n(t)) for t in {t for _, t, _ in rows}}
    got = kn.classify(docs, trusted).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[3])
    want = [(i, lang or "", n(t), of[t]) for i, t, lang in rows]
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g[:3]) == w[:3] and g.perplexity == pytest.approx(w[3], rel=1e-6)
    others = {"de": [], "": []}
    for i in sorted(set(range(len(good))) - set(train)):
        others[rows[i][2] or ""].append(of[good[i]])
    cut = lambda x: sorted(x)[math.ceil(kn.QUANTILE * len(x)) - 1] * kn.SLACK
    for r in got:
        assert r.threshold == pytest.approx(cut(others[r.lang] if r.lang in others else sum(others.values(), [])), rel=1e-6)
        assert r.kept is (r.perplexity <= r.threshold)
