"""Terms of a dictionary against a search word by word; labels on lines above their values."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quellspan.operators import lookups, records, terms

TERMS = [("A", "acme corp", False), ("A", "acme", False), ("B", "Project-Blue Sky", False), ("C", "one two three four five six seven eight", False), ("D", "encrypt key", True), ("E", "a b c d e f g h i", False), ("F", "--", False), ("B", "été", False)]


def stem(w):
    return re.sub(rf"^([^\W\d_]{{4,}}?)(?:{terms.ENDINGS})$", r"\1", w)


def plain(text):
    words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", text)]
    out = set()
    for label, term, stems in TERMS:
        own = [m.lower() for m in re.findall(r"[^\W_]+", term)]
        if not 1 <= len(own) <= 8:
            continue
        fold = stem if stems else (lambda w: w)
        for i in range(len(words) - len(own) + 1):
            if [fold(w[2]) for w in words[i : i + len(own)]] == [fold(w) for w in own]:
                out.add((label, words[i][0], words[i + len(own) - 1][1]))
    return out


def test_equals_a_search_word_by_word(spark, monkeypatch):
    rng = random.Random(3)
    parts = ["acme", "Corp", "project", "blue", "sky", "été", "encrypted", "keys", "encrypting", "key", *"one two three four five six seven eight".split()]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "-", ", ", "\n"]) for _ in range(rng.randint(0, 25))) for _ in range(120)] + [None, "", "one two three four five six seven eight"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    listed = spark.createDataFrame([*TERMS, ("A", "ACME", None), (None, "acme", False), ("A", None, False)], "label string, term string, stems boolean")
    for most in (terms.MOST_SENT, 0):
        monkeypatch.setattr(terms, "MOST_SENT", most)
        got = {}
        for r in terms.hits(df, "k", "text", listed).collect():
            got.setdefault(r["k"], set()).add((r["label"], r["start"], r["end"]))
        assert got == {k: plain(t) for k, t in enumerate(texts) if t and plain(t)}


def test_merged_runs(spark):
    found = spark.createDataFrame([(1, "A", 0, 4), (1, "A", 5, 9), (1, "A", 8, 12), (1, "A", 20, 22), (1, "B", 9, 12), (2, "A", 4, 5)], "k int, label string, start int, end int")
    got = sorted((r["k"], r["label"], r["start"], r["end"], r["hits"]) for r in terms.merged(found, "k").collect())
    assert got == [(1, "A", 0, 12, 3), (1, "A", 20, 22, 1), (1, "B", 9, 12, 1), (2, "A", 4, 5, 1)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Phone:\n+1 212 555 0123\n", [("PHONE", "+1 212 555 0123")]),
        ("**Full name**:\r\n\r\n\r\n  Anna Okafor\r\n", [("NAME", "Anna Okafor")]),
        ("Phone:\n" + "\n" * 50 + "+1 212 555 0123", []),
        ("Phone:\nAddress:\n12 Harbor Street\n", [("ADDRESS", "12 Harbor Street")]),
        ("Phone:\nsee below\n+1 212 555 0123\n", []),
        ("Telefon =\n030 1234567", [("PHONE", "030 1234567")]),
        ("note:\n+1 212 555 0123", []),
        ("", []),
    ],
)
def test_labels_above_values(spark, text, want):
    rows = records.labelled_lines(spark.createDataFrame([(1, text), (2, None)], "k int, text string"), "k").collect()
    assert [(r["type"], r["value"]) for r in rows] == want and all(text[r["start"] : r["end"]] == r["value"] for r in rows)


def test_words_are_cut_to_stems_only_where_a_term_asks(spark, monkeypatch):
    df, cut, calls = spark.createDataFrame([(1, "the acme corp")], "k int, t string"), terms.stem, []
    monkeypatch.setattr(terms, "stem", lambda w: calls.append(w) or cut(w))
    for by, times in ((False, 1), (True, 2)):  # once for the terms themselves
        calls.clear()
        listed = spark.createDataFrame([("A", "acme corp", by)], "label string, term string, stems boolean")
        assert [tuple(r) for r in terms.hits(df, "k", "t", listed).collect()] == [(1, "A", 4, 13)]
        assert len(calls) == times


def test_runs_of_words_begin_where_a_term_can(spark):
    df = spark.createDataFrame([(1, "One of the few of the de la"), (2, None)], "k int, t string")
    listed = spark.createDataFrame([("F", "of the"), ("F", "de la"), ("G", "few"), ("N", None)], "label string, term string")
    assert sorted(map(tuple, lookups.term_hits(df, "k", "t", listed, 2).collect())) == [(1, "F", 1), (1, "F", 4), (1, "F", 6), (1, "G", 3)]
    bits = terms.first_words(listed.select(F.substring_index("term", " ", 1).alias("first")).where("first IS NOT NULL"))
    assert lookups.word_grams(df, "k", "t", 2, bits).count() <= 8 < lookups.word_grams(df, "k", "t", 2).count()
