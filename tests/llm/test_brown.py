import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quellspan.llm import brown, queries


def tokens(text):
    return (text or "").encode().lower().split()


def in_training(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 != 2


def fixture_rows():
    rng = random.Random(5)
    nouns, verbs = [f"noun{i}" for i in range(30)], [f"verb{i}" for i in range(20)]
    rows = [(None, "noun1 verb1 noun2"), (1, None), (2, ""), (3, " \t\n"), (4, "x" * 90), (4, "x" * 90)]
    for i in range(5, 220):
        words = []
        for _ in range(rng.randint(0, 60)):
            words += [rng.choice(nouns), rng.choice(verbs)] + ([f"RARE{rng.randint(0, 400)}é"] if rng.random() < 0.2 else [])
        rows.append((i, " ".join(words)))
    return [(i, t, "clash") for i, t in rows]


def plain_scores(rows, fitted, classes, prior):
    """Straight from the definitions, given which class each word of the exchange has."""
    counts = Counter()
    for i, text, _ in rows:
        if in_training(i):
            counts.update(tokens(text) + [b""])
    total, types = sum(counts.values()), len(counts)
    head = fitted["head"].value
    exchanged = {w: int(c) for w, c in zip(head.words[: head.exchanged], fitted["assigned"])}
    end = classes + brown.SHAPES

    def class_of(w):
        return end if w == b"" else exchanged.get(w, classes + zlib.crc32(w[-2:]) % brown.SHAPES)

    moves, size, room = Counter(), Counter(), Counter()
    for i, text, _ in rows:
        if in_training(i):
            seq = [b"", *tokens(text), b""]
            moves.update((class_of(a), class_of(b)) for a, b in zip(seq, seq[1:]))
    for w, n in counts.items():
        if w:
            size[class_of(w)] += n
            room[class_of(w)] += 1
    n_classes = end + 1
    before, after, all_moves = Counter(), Counter(), sum(moves.values())
    for (a, b), n in moves.items():
        before[a] += n
        after[b] += n
    out = []
    for i, text, _ in rows:
        toks = [*tokens(text), b""]
        base = sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in toks)
        model = 0.0
        for a, w in zip([b"", *toks], toks):
            ca, cb = class_of(a), class_of(w)
            reach = (after[cb] + 1) / (all_moves + n_classes)
            model += math.log10((moves[ca, cb] + prior * reach) / (before[ca] + prior))
            if w in exchanged:
                model += math.log10(counts[w] / size[cb])
            elif w:
                model += math.log10((counts[w] + 1) / (size[cb] + room[cb] + 1))
        out.append((i, not in_training(i), len(toks), sum(counts[w] > 0 for w in toks), total, base, model))
    return out


def close(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[5])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g[:5]) == tuple(w[:5])
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


@pytest.mark.parametrize("head,exchanged", [(1 << 18, 4096), (60, 20), (0, 0)])
def test_matches_brute_force(spark, head, exchanged):
    rows = fixture_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(3)
    got = brown.score(docs, head=head, exchanged=exchanged, classes=8, rounds=5).collect()
    training = docs.where(~brown.held_out_column("doc_id")).select(F.col("text").cast("binary").alias("text"))
    fitted = brown.fit(training, head, exchanged, 8, 5)
    close(got, plain_scores(rows, fitted, 8, 4.0))


def test_gain_is_the_change_of_likelihood():
    rng = np.random.default_rng(1)
    words, classes = 12, 4
    pairs = rng.integers(0, 9, (words, words))
    cls = rng.integers(0, classes, words)

    def table(cls):
        m = np.zeros((classes, classes))
        np.add.at(m, (cls[:, None].repeat(words, 1), cls[None, :].repeat(words, 0)), pairs)
        return m

    value = lambda m: brown._f(m).sum() - brown._f(m.sum(1)).sum() - brown._f(m.sum(0)).sum()
    for w in range(words):
        s, p = np.bincount(cls, pairs[w], classes), np.bincount(cls, pairs[:, w], classes)
        to, gain = brown.best_class(s, p, pairs[w, w], cls[w], table(cls), classes)
        values = [value(table(np.where(np.arange(words) == w, b, cls))) for b in range(classes)]
        assert values[to] == pytest.approx(max(values)) and gain == pytest.approx(max(values) - value(table(cls)))


def test_exchange_beats_unigrams_on_held_out_text(spark):
    docs = spark.createDataFrame(fixture_rows(), "doc_id long, text string, word string")
    rows = [r for r in brown.score(docs, classes=8).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_empty_table(spark):
    assert brown.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text, None) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    counts = Counter()
    for i, text, _ in docs:
        if in_training(i):
            counts.update(tokens(text) + [b""])
    total, types = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in queries.op10_brown(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for i, text, _ in docs:
        toks = [*tokens(text), b""]
        assert got[i].held_out is (not in_training(i)) and got[i].n_tokens == len(toks) and got[i].train_tokens == total
        assert got[i].n_known == sum(counts[w] > 0 for w in toks)
        assert got[i].base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in toks), rel=1e-9)
    rows = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


@pytest.mark.parametrize("head", [1 << 18, 60])
def test_every_word_has_a_class_by_its_neighbours(spark, head):
    """Words beyond the rounds of exchange are placed where the likelihood gains most, and scored by that class."""
    rows, classes, prior = fixture_rows(), 8, 4.0
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(3)
    training = docs.where(~brown.held_out_column("doc_id")).select(F.col("text").cast("binary").alias("text"))
    fitted = brown.fit(training, head, 20, classes, 5)
    words = fitted["head"].value
    first = {w: int(c) for w, c in zip(words.words[: words.exchanged], fitted["assigned"])}
    end, m = classes + brown.SHAPES, fitted["table"]
    of = lambda w: end if w == b"" else first.get(w, classes + zlib.crc32(w[-2:]) % brown.SHAPES)
    counts, s, p = Counter(), {}, {}
    seqs = [[b"", *tokens(t), b""] for i, t, _ in rows if in_training(i)]
    for seq in seqs:
        counts.update(seq[1:])
        for a, b, c in zip(seq, seq[1:], seq[2:]):
            if b not in first:
                s.setdefault(b, np.zeros(len(m)))[of(c)] += 1
                p.setdefault(b, np.zeros(len(m)))[of(a)] += 1
    f = lambda x: x * np.log(np.maximum(x, 1))
    got = {bytes(r.word): (r.n, r["class"]) for r in brown.placed_words(training, fitted, classes).collect()}
    assert {w: n for w, (n, _) in got.items()} == {w: n for w, n in counts.items() if w and w not in first}
    for w, (_, to) in got.items():
        gains = []
        for b in range(classes):
            sums = m[b].sum(), m[:, b].sum(), counts[w]
            gains.append(sum(f(m[b] + s[w]) - f(m[b])) + sum(f(m[:, b] + p[w]) - f(m[:, b])) - sum(f(x + sums[2]) - f(x) for x in sums[:2]))
        a, sums = classes + zlib.crc32(w[-2:]) % brown.SHAPES, counts[w]
        stay = sum(f(m[a]) - f(m[a] - s[w])) + sum(f(m[:, a]) - f(m[:, a] - p[w])) - sum(f(x) - f(x - sums) for x in (m[a].sum(), m[:, a].sum()))
        more = max(gains) - stay - math.log(classes)
        assert abs(more) < 1e-6 or (to < classes) == (more > 0)
        assert to == a if to >= classes else gains[to] == pytest.approx(max(gains))
    assert any(to < classes for _, to in got.values()) and any(to >= classes for _, to in got.values())
    known = first | {w: to for w, (_, to) in got.items()}
    cls = lambda w: end if w == b"" else known.get(w, classes + zlib.crc32(w[-2:]) % brown.SHAPES)
    moves = Counter((cls(a), cls(b)) for seq in seqs for a, b in zip(seq, seq[1:]))
    before, after = Counter(), Counter()
    for (a, b), n in moves.items():
        before[a] += n
        after[b] += n
    total, types = sum(counts.values()), len(counts)
    size = Counter()
    for w, c in known.items():
        size[c] += counts[w] + (c >= classes)
    want = []
    for i, text, _ in rows:
        toks, model = [*tokens(text), b""], 0.0
        for a, w in zip([b"", *toks], toks):
            reach = (after[cls(w)] + 1) / (total + end + 1)
            model += math.log10((moves[cls(a), cls(w)] + prior * reach) / (before[cls(a)] + prior))
            if w:
                stays = cls(w) >= classes
                model += math.log10((counts[w] + stays) / (size[cls(w)] + stays))
        base = sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in toks)
        want.append((i, not in_training(i), len(toks), sum(counts[w] > 0 for w in toks), total, base, model))
    close(brown.score(docs, head=head, classes=classes, rounds=5, in_rounds=20).collect(), want)


def test_neighbours_travel_as_packed_rows(spark):
    """A word of a worker is one row of all its neighbours' classes, not a row for each of them, and batches may part a word's rows."""
    docs = spark.createDataFrame(fixture_rows(), "doc_id long, text string, word string").repartition(6)
    training = docs.where(~brown.held_out_column("doc_id")).select(F.col("text").cast("binary").alias("text"))
    fitted = brown.fit(training, 1 << 18, 20, 8, 2)
    rows = brown.neighbour_cells(training, fitted["head"], fitted["assigned"]).collect()
    per_word = Counter(bytes(r.word) for r in rows)
    assert max(per_word.values()) <= training.rdd.getNumPartitions() and len(rows) < sum(len(r.cells) // 4 for r in rows) / 3
    want = sorted(map(tuple, brown.placed_words(training, fitted, 8).collect()))
    assert {bytes(w): n for w, n, _ in want} == {w: sum(len(r.cells) // 4 for r in rows if bytes(r.word) == w) for w in per_word}
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    try:
        assert sorted(map(tuple, brown.placed_words(training, fitted, 8).collect())) == want
    finally:
        spark.conf.set(key, before)
