"""Word cover, sequences and surprise of values against plain versions."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quellspan.operators import words

WORDS = ["pass", "word", "password", "summer", "sum", "merry", "tree", "straße", "the", "there", "rest"]
VALUES = ["P4$$w0rd", "summertree", "summerry", "there", "therest", "q7Rt9zLx2Vb4Km8W", "1234abcd", "Qwerty12", "12345", "", "Straße99", "x", "therestsummer", "p4ssw0rd123", "thetheth"]


def fold(v):
    low = v.lower()
    return low.translate(str.maketrans("".join(a for a, _ in words.PAIRS), "".join(b for _, b in words.PAIRS))) if re.search(r"[^\W\d_]", low) else low


def cover(v):
    best = [0]
    for i in range(1, len(v) + 1):
        best.append(max([best[-1], *(best[i - len(w)] + len(w) for w in WORDS if i >= len(w) and v[i - len(w) : i] == w)]))
    return best[-1]


def test_cover_equals_plain_search(spark):
    out = words.covers(spark.createDataFrame([(v,) for v in [*VALUES, None, "there"]], "value string"), spark.createDataFrame([(w,) for w in [*WORDS, "Tree", None]], "word string"))
    assert {r["value"]: (r["letters"], r["covered"]) for r in out.collect()} == {v: (len(re.sub(r"[\W\d_]", "", fold(v))), cover(fold(v))) for v in VALUES}


def test_surprise_equals_plain_counts(spark):
    mark = lambda w: re.sub("[^a-z]", ".", w.lower())
    pairs = Counter(mark(w)[i : i + 2] for w in WORDS for i in range(len(w) - 1))
    letters = "abcdefghijklmnopqrstuvwxyz."
    bits = {a + b: round(-math.log2((pairs[a + b] + 0.5) / sum(pairs[a + c] + 0.5 for c in letters)), 6) for a in letters for b in letters}
    out = words.surprises(spark.createDataFrame([(v,) for v in VALUES], "value string"), spark.createDataFrame([(w,) for w in WORDS], "word string"))
    for r in out.collect():
        own = [bits[mark(r["value"])[i : i + 2]] for i in range(len(r["value"]) - 1)]
        assert r["surprise"] == (pytest.approx(sum(own) / len(own), abs=1e-4) if own else None)


def test_verdicts(spark):
    out = words.judged(spark.createDataFrame([(v,) for v in VALUES], "value string"), spark.createDataFrame([(w,) for w in WORDS], "word string"))
    got = {r["value"]: r["verdict"] for r in out.collect()}
    assert {v: got[v] for v in ("P4$$w0rd", "summertree", "q7Rt9zLx2Vb4Km8W", "1234abcd", "Qwerty12")} == {
        "P4$$w0rd": "words", "summertree": "words", "q7Rt9zLx2Vb4Km8W": "random", "1234abcd": "sequence", "Qwerty12": "sequence"}
    share = {r["v"]: r["s"] for r in spark.createDataFrame([(v,) for v in VALUES], "v string").select("v", words.sequence_share(F.col("v")).alias("s")).collect()}
    assert share["1234abcd"] == 1.0 and share["summertree"] == 0.0 and share[""] == 0.0
