"""Known values in texts, against a search value by value."""

import random
import re

from pyspark.sql import functions as F

from quellspan.operators import known


def plain(text, values):
    """All places of all values, whole; the longest first, then the first."""
    letter = lambda c: re.fullmatch(r"[^\W_]", c) is not None
    hits = []
    for value, kind in values:
        at = text.find(value)
        while at >= 0:
            end = at + len(value)
            if not (at and letter(value[0]) and letter(text[at - 1])) and not (end < len(text) and letter(value[-1]) and letter(text[end])):
                hits.append((-len(value), at, end, kind, value))
            at = text.find(value, at + 1)
    taken = []
    for h in sorted(hits):
        if all(h[2] <= t[1] or t[2] <= h[1] for t in taken):
            taken.append(h)
    return sorted(t[1:] for t in taken)


def test_equals_a_search_value_by_value(spark, monkeypatch):
    rng = random.Random(8)
    parts = ["ab", "key", "-", "_", " ", "é", "42", "🙂", "ab-42", "key 42", ".", "\n"]
    values = [("ab-42", "T1"), ("42", "T2"), ("key 42", "T3"), ("é", "T4"), ("-key-", "T5"), ("ab-42 key", "T6"), ("🙂", "T7"), ("ab ab", "T8")]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(150)] + [(900, None), (901, "")]
    rows += [(902, "x " * 3000 + "ab-42 " * 2000)]
    registry = spark.createDataFrame([*values, ("ab-42", "T9"), (None, "T1"), ("--", "T0")], "value string, type string")
    df = spark.createDataFrame(rows, "k int, text string")
    searched = [v for v in values if re.search(r"[^\W_]", v[0])]
    want = {k: plain(t or "", searched) for k, t in rows}
    for most in (known.MOST_SENT, 0):  # broadcast, and joined
        monkeypatch.setattr(known, "MOST_SENT", most)
        got = {r["k"]: [tuple(x) for x in r["hits"]] for r in known.with_hits(df, "k", registry).collect()}
        assert got == want
    out = {r["k"]: r["masked"] for r in known.redacted(df, "k", registry).collect()}
    for k, text in rows:
        said, at = "", 0
        for start, end, kind, _ in want[k]:
            said, at = f"{said}{(text or '')[at:start]}⟦{kind}⟧", end
        assert out[k] == said + (text or "")[at:]


def test_candidate_tokens(spark):
    df = spark.createDataFrame([(1, "see (token=abc%2Fdef12) and short x=1 https://h.example/p"), (2, None)], "k int, text string")
    got = sorted((r["start"], r["end"], r["token"]) for r in known.candidate_tokens(df, "k").collect())
    assert got == [(5, 22, "token=abc/def12"), (11, 22, "abc/def12"), (38, 57, "https://h.example/p")]


def test_an_empty_registry(spark):
    df = spark.createDataFrame([(1, "text")], "k int, text string")
    assert known.redacted(df, "k", spark.createDataFrame([], "value string, type string")).select("masked", F.size("hits")).first()[:] == ("text", 0)
