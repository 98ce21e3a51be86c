import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quellspan.llm import queries, toxicity


def bag(text):
    return Counter(w for s in text.split() for w in re.findall(r"\w+", s.lower()))


def plain_fit(rows, penalty=toxicity.PENALTY, least=toxicity.LEAST_TEXTS):
    """The same descent, word by word, over dictionaries. rows: (toxic, text)."""
    bags = [(y, bag(t)) for y, t in rows]
    n, others = len(bags), toxicity.others()
    held = Counter(k for _, b in bags for w in b for k in toxicity.features(w))
    known = {k for k, c in held.items() if c >= least}
    # the fit counts a feature once for each of a text's words that have it
    plain = lambda b, size: {w: 100 * c / (size + toxicity.PADDING) for w, c in b.items()}
    texts = [(y, plain(b, sum(b.values()))) for y, b in bags]
    moved = []
    for _, b in bags:
        named, size = [w for w in b if w in others], sum(b.values())
        for k in range(toxicity.SWAPS if named else 0):
            change = Counter()
            for w in named:
                change[w] -= b[w]
                change[others[w][k % len(others[w])]] += b[w]
            moved.append(plain(change, size))
    prior = (sum(y for y, _ in bags) + 0.5) / (n + 10)
    c, w, gained, fell = math.log(prior / (1 - prior)), dict.fromkeys(known, 0.0), dict.fromkeys(known, 1e-8), 1e-8
    weigh = lambda rates: sum(r * w[k] for x, r in rates.items() for k in toxicity.features(x) if k in known)
    for _ in range(toxicity.ROUNDS):
        slope = {k: toxicity.DECAY * v for k, v in w.items()}
        total = 0.0
        todo = [(rates, (1 / (1 + math.exp(-(weigh(rates) + c))) - y) / n) for y, rates in texts]
        total = sum(e for _, e in todo)
        if penalty:
            todo += [(rates, 2 * penalty / len(moved) * weigh(rates)) for rates in moved]
        for rates, e in todo:
            for x, r in rates.items():
                for k in toxicity.features(x):
                    if k in known:
                        slope[k] += r * e
        for k in known:
            gained[k] += slope[k] ** 2
            w[k] -= toxicity.STEP * slope[k] / math.sqrt(gained[k])
        fell += total**2
        c -= toxicity.STEP * total / math.sqrt(fell)
    return lambda text: 1 / (1 + math.exp(-(weigh(plain(bag(text), sum(bag(text).values()))) + c)))


def scorer(spark, rows, **options):
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (y, _) in enumerate(rows)], "doc_id long, toxic int")
    return toxicity.Scorer(*toxicity.trained(docs, labels, F.lit(True), **options))


def biased(seed=3):
    """Abuse that mostly names one group, beside neutral mentions of others."""
    rng = random.Random(seed)
    filler = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(240):
        toxic = int(i % 3 == 0)
        words = rng.choices(filler, k=25)
        if toxic:
            words += ["muslims"] + rng.choices(["scum", "worthless", "vermin"], k=2)
        elif i % 5 == 0:
            words += [rng.choice(["christians", "jews", "hindus"])]
        rng.shuffle(words)
        rows.append((toxic, " ".join(words)))
    return rows


def test_fit_equals_plain_descent(spark):
    rows = biased()[:90]
    own, plain = scorer(spark, rows, least=2), plain_fit(rows, least=2)
    texts = [t for _, t in rows] + ["", "Scum!", "the muslims, the hindus", "x" * 50]
    assert own.scores(pa.array(texts)).tolist() == pytest.approx([plain(t) for t in texts], abs=1e-7)


def test_neutral_mentions_keep_their_score(spark):
    rows = biased()
    said = pa.array([" ".join(["word1 word2 word3 word4"] * 4 + [g]) for g in ("muslims", "christians")])
    fair, unfair = (scorer(spark, rows, penalty=p).scores(said) for p in (toxicity.PENALTY, 0.0))
    assert unfair[0] - unfair[1] > 0.2 and unfair[0] >= toxicity.THRESHOLD
    assert abs(fair[0] - fair[1]) < 0.05 and fair[0] < toxicity.THRESHOLD
    abuse = scorer(spark, rows).scores(pa.array(["word1 word2 word5 word9 scum word7 worthless word8"]))
    assert abuse[0] >= toxicity.THRESHOLD


def test_edges(spark):
    """Null ids, null, empty and very long texts, repeated rows, several labels, clashing columns; no table, no labels."""
    rows = [(i, t) for i, (_, t) in enumerate(biased())] + [(None, None), (None, "scum"), (900, ""), (901, " ".join(f"word{i}" for i in range(60)) * 4000), (5, biased()[5][1]), (5, biased()[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("own"), "toxic": F.lit(3), "place": F.lit(1), "words": F.lit("own")})
    labels = spark.createDataFrame([(i, y) for i, (y, _) in enumerate(biased())] + [(0, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    out = toxicity.classified(docs, labels).collect()
    assert len(out) == len(rows) and {r["words"] for r in out} == {"own"} and {r["toxic"] for r in out} == {3}
    nulls = {r["text"]: r for r in out if r["doc_id"] is None}
    empty = next(r for r in out if r["doc_id"] == 900)
    assert not nulls[None]["held_out"] and nulls[None]["score"] == empty["score"] and nulls["scum"]["score"] > empty["score"]
    assert len({r["score"] for r in out if r["doc_id"] == 5}) == 1
    assert next(r for r in out if r["doc_id"] == 901)["predicted"] == 0
    assert toxicity.classified(docs.limit(0), labels).count() == 0
    alone = toxicity.classified(docs, labels.limit(0)).select("score", "predicted").distinct().collect()
    assert len(alone) == 1 and alone[0]["predicted"] == 0


def test_labels_of_held_out_rows_are_not_read(spark):
    rows = biased()
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(len(rows))]
    labels = lambda turn: spark.createDataFrame([(i, 1 - y if turn and held[i] else y) for i, (y, _) in enumerate(rows)], "doc_id long, toxic int")
    a, b = (sorted(tuple(r) for r in toxicity.classified(docs, labels(t)).select("doc_id", "held_out", "score").collect()) for t in (False, True))
    assert a == b and [r[1] for r in a] == held


def test_query(spark, sf_dir):
    """The whole query against the plain descent."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    score = plain_fit([(r["toxic"], docs[r["doc_id"]]) for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["doc_id"] in docs])
    out = queries.op13_toxicity(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(docs)
    for r in out:
        assert r["score"] == pytest.approx(score(docs[r["doc_id"]] or ""), abs=1e-6)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3)


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    out = queries.op13_toxicity(spark, sf_dir).where("held_out").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    toxic, clean = ([r["predicted"] for r in out if r["toxic"] == y] for y in (1, 0))
    assert sum(clean) <= 0.03 * len(clean) and sum(toxic) >= 0.88 * len(toxic)
