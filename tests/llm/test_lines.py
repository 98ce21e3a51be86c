import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quellspan.llm import lines, queries


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def changed(rng, s, n):
    for _ in range(n):
        i = rng.randrange(len(s) + 1)
        s = rng.choice([s[:i] + rng.choice("abé🙂 ") + s[i:], s[:i] + s[i + 1 :], s[:i] + rng.choice("xyz") + s[i + 1 :]])
    return s


def third_alike(a, b):
    """Of two lines within two edits, one holds the first, middle or last third of the other, so no such pair is lost."""
    n = len(a) // 3
    return a[:n] in b or a[n : 2 * n] in b or a[2 * n :] in b


def plain_removed(docs, threshold, min_chars, may_be_near=lambda a, b: True):
    first = {}
    for d, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        for n, x in enumerate((t or "").split("\n")):
            if x.strip(" \t\n\v\f\r"):
                first[x] = min(first.get(x, (d is not None, d or 0, n)), (d is not None, d or 0, n))
    near, by_length = set(), defaultdict(list)
    for x in first:
        if len(x) >= min_chars:
            by_length[len(x)].append(x)
    for x in first:
        if len(x) < min_chars:
            continue
        for size in range(len(x) - threshold, len(x) + threshold + 1):
            if any(y != x and first[y] < first[x] and may_be_near(x, y) and edits(x, y) <= threshold for y in by_length[size]):
                near.add(x)
    out = set()
    for d, t in docs:
        for n, x in enumerate((t or "").split("\n")):
            if x in first and (x in near or first[x] != (d is not None, d or 0, n)):
                out.add((d, n, first[x] == (d is not None, d or 0, n)))
    return out


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(spark, threshold):
    rng = random.Random(threshold)
    rows = []
    for _ in range(400):
        a = "".join(rng.choice("ab c🙂") for _ in range(rng.randint(threshold + 1, 70)))
        b = changed(rng, a, rng.randint(0, threshold + 2))
        if abs(len(a) - len(b)) <= threshold and min(len(a), len(b)) > threshold:
            rows.append(tuple(sorted((a, b), key=len)))
    df = spark.createDataFrame(rows, "a string, b string").withColumns({"x": F.split("a", ""), "y": F.split("b", "")})
    for r in df.withColumn("d", lines.banded_distance(F.col("x"), F.col("y"), threshold)).collect():
        want = edits(r.a, r.b)
        assert r.d == want if want <= threshold else r.d > threshold, (r.a, r.b)


@pytest.mark.parametrize("threshold, hot", [(1, 256), (2, 256), (2, 1), (1, 3)])
def test_matches_brute_force(spark, threshold, hot):
    """hot: with few lines to a segment, segments take second ones; the result is the same."""
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefg hé") for _ in range(rng.randint(10, 60))) for _ in range(40)]
    docs = [(None, base[0]), (3, None), (4, ""), (5, "\n\n"), (6, "short\nshort"), (7, "x" * 9000 + "\n" + "x" * 9001)]
    for d in range(10, 90):
        docs.append((d, "\n".join(changed(rng, rng.choice(base), rng.randint(0, 3)) for _ in range(rng.randint(1, 5)))))
    docs.append(docs[-1])
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in docs], "doc_id long, text string, line string, left int, gone int")
    got = {tuple(r) for r in lines.removed_lines(df, threshold=threshold, min_chars=12, hot=hot).collect()}
    want = plain_removed([d for d in docs if d[0] != 7], threshold, 12) | {(7, 1, True)}
    assert got == want
    kept = {r.doc_id: r.text for r in lines.deduplicated(df, threshold=threshold, min_chars=12, hot=hot).collect()}
    for d, t in docs:
        gone = {n for x, n, _ in want if x == d}
        left = [x for n, x in enumerate((t or "").split("\n")) if n not in gone]
        if gone and not "".join(left).strip():
            assert d not in kept
        else:
            assert kept[d] == (t if not gone else "\n".join(left))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n int")
    assert lines.report(docs).count() == 0 and lines.deduplicated(docs).columns == docs.columns


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = plain_removed(docs, lines.THRESHOLD, lines.MIN_CHARS, third_alike)
    got = queries.op4_lines(spark, sf_dir).collect()
    assert len(got) == len(docs)
    assert {(r.doc_id, n) for r in got for n in r.removed} == {(d, n) for d, n, _ in want}
    assert sum(r.n_near for r in got) == sum(near for _, _, near in want)


def test_ids_must_be_whole_numbers(spark):
    with pytest.raises(TypeError):
        lines.report(spark.createDataFrame([("a", "x")], "doc_id string, text string"))

