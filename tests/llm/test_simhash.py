import random

import numpy as np
import pytest
import xxhash

from quellspan.llm import queries, simhash

SPACE = " \t\n\x0b\x0c\r"


def plain_fingerprint(text, k, seed=42):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACE:
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(rows, most):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= most:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, f"{fp:016x}", least[find(i)]) for i, (doc, fp) in enumerate(rows))


def texts():
    rng = random.Random(7)
    words = ["Alpha", "beta", "GAMMA", "δέλτα", "épsilon", "zeta eta", "theta"] + [f"w{i}" for i in range(60)]
    long = " ".join(rng.choice(words) for _ in range(900))
    out = [None, "", " \n\t ", "one", "One", "two words", "a b c", long, long.upper(), long.replace("w7", "w8", 1)]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(1, 400))]
        out.append(rng.choice([" ", "\n", " \t"]).join(base))
        near = list(base)
        near[rng.randrange(len(near))] = "changed"
        out.append(" ".join(near))
    return out


@pytest.mark.parametrize("k", [3, 5])
def test_matches_brute_force(spark, k):
    rows = [(i * 3 + 1, t, "x") for i, t in enumerate(texts())] + [(1, None, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(tuple(r) for r in simhash.near_duplicates(docs, shingle_words=k).collect())
    assert got == plain_components([(d, plain_fingerprint(t, k)) for d, t, _ in rows], 2)


def test_links_of_crowded_fingerprints(spark):
    """A dense cloud of fingerprints: chains, long buckets and a ring of close values."""
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 63))
    fps = {base}
    for _ in range(300):
        fps.add(random.Random(len(fps)).choice(sorted(fps)) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(8))))
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 200)}
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    signed = [(f - (1 << 64) if f >= 1 << 63 else f,) for _, f in rows]
    from quellspan.llm.graph import components

    found = {r.node: r.root for r in components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()}
    want = plain_components(rows, 2)
    groups, expected = {}, {}
    for (_, f), (s,) in zip(rows, signed):
        groups.setdefault(found.get(s, s), set()).add(f)
    for doc, hexed, least in want:
        expected.setdefault(least, set()).add(int(hexed, 16))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_empty_table_and_one_of_each(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    docs = spark.createDataFrame([(3, "a b c d e f"), (1, "A b c d e f"), (2, "other words stand in here now"), (1, "A b c d e f")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == [1, 2]


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, plain_fingerprint(r.text, 3)) for r in docs.collect()]
    assert sorted(tuple(r) for r in queries.op7_simhash(spark, sf_dir).collect()) == plain_components(rows, 2)


def test_deduplicate_null_and_repeated_ids(spark):
    """Rows without an id and rows that share one are judged by their own texts."""
    base = " ".join(f"w{i}" for i in range(300))
    rows = [
        (None, "alone without an id in this table"),
        (None, base),
        (1, base),
        (2, "first text of the second id here"),
        (2, "quite another text of that same id"),
        (None, "pair of rows without any id"),
        (None, "pair of rows without any id"),
        (3, "first text of the second id here"),
        (4, base),
        (4, "words that only the fourth id has"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in simhash.deduplicate(docs).collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[3], rows[4], rows[5], rows[9]], key=str)
