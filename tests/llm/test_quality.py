import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quellspan.llm import quality, queries

SPACES = "[\x20\x09-\x0d]+"


def plain_stats(text):
    words = [w for w in re.split(SPACES, text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(quality.SYMBOLS, text or "")), len(lines) - len(set(lines)), len(covered), len(lines))


def texts():
    rng = random.Random(4)
    out = [None, "", " \n\t", "a", "x" * 50_000, "#$ %", "same\nsame\n \n \nsame", "a b c d e f g h " * 3, "a b c d e f g a b c d e f g a b c d e f g a", "one two three " * 2000]
    for _ in range(150):
        words = [rng.choice(["alpha", "βeta", "γ", "x#y", "q|", "e f"]) for _ in range(rng.randint(1, 120))]
        out.append("".join(w + rng.choice([" ", "\n", "\t ", "\r\n", "\x0b"]) for w in words))
    return out


def test_stats_match_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    got = quality.with_stats(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    for r in got:
        assert tuple(r[c] for c in quality.STATS) == plain_stats(rows[r.doc_id][1]), rows[r.doc_id][1]


def test_buckets_are_ordered_and_close(spark):
    values = [0, 1, 255, 256, 257, 511, 512, 1000, 123_456, 10**6, 10**12, (1 << 62) + 12345]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.bucket(F.col("v")).alias("b")).select("v", "b", quality.bucket_floor(F.col("b")).alias("f")).collect()
    for r in got:
        assert r.f <= r.v <= r.f * (1 + 1 / 128)
    assert [r.b for r in got] == sorted(r.b for r in got)


def test_fences_follow_their_group(spark):
    """The same text is odd in one source and usual in another; a small source takes its language's fences."""
    rng = random.Random(9)
    plain = lambda: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit"]) + str(rng.randint(0, 9)) for _ in range(40))
    rows = [(i, plain(), "en", "prose") for i in range(400)] + [(i, plain().replace(" ", " | "), "en", "tables") for i in range(400, 700)]
    odd = plain().replace(" ", " | ")
    rows += [(900, odd, "en", "prose"), (901, odd, "en", "tables"), (902, plain(), "en", None), (903, "too short", "xx", "prose"), (904, None, None, None)]
    kept = {r.doc_id for r in quality.keep(spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")).collect()}
    assert kept == set(range(700)) | {901, 902}


def test_keep_leaves_columns_alone_and_empty_tables(spark):
    text = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, "en", "s", 7, True), (1, text, "en", "s", 7, True), (2, "x", "en", "s", 1, None)], "doc_id long, text string, lang string, source string, n_words long, kept boolean")
    out = quality.keep(docs)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [tuple(r) for r in docs.limit(2).collect()]
    assert quality.keep(docs.limit(0)).count() == 0


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op6_quality(spark, sf_dir).collect():
        n, chars, symbols, dup, rep, _ = plain_stats(docs[r.doc_id])
        assert tuple(r)[:7] == (r.doc_id, n, chars, symbols, dup, rep, n < 20 or 100 * rep > 30 * n)
        assert not (r.base_failed and r.kept)
