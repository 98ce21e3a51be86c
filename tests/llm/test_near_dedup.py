import random

import corpus_pipeline


def plain_jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def edited(rng, words, least, most):
    """A copy with words changed in places until its overlap with the original lies between two bounds."""
    while True:
        near = list(words)
        for _ in range(rng.randint(1, len(words) // 15)):
            near[rng.randrange(len(near))] = f"changed{rng.randrange(10**6)}"
        if least <= plain_jaccard(" ".join(words), " ".join(near)) < most:
            return " ".join(near)


def test_planted_pairs_from_08_to_095(spark):
    """Every planted near copy at overlap 0.8 to 0.95 goes, and pairs below 0.8 stay."""
    rng, rows, copies, apart = random.Random(5), [], set(), set()
    for k in range(120):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(100, 400))]
        least, most = ((0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.6, 0.78))[k % 4]
        rows += [(2 * k, " ".join(words), "x"), (2 * k + 1, edited(rng, words, least, most), "x")]
        (copies if least >= 0.8 else apart).add(2 * k + 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    left = {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()}
    assert left == {d for d, _, _ in rows} - copies and apart <= left


def test_groups_against_brute_force(spark):
    """Large groups, whose members are not all near each other, join as all pairs of 0.8 or more join them."""
    rng, rows = random.Random(6), []
    for g in range(3):
        words = [f"g{g}w{rng.randrange(3000)}" for _ in range(150)]
        for _ in range(40):
            rows.append((len(rows), edited(rng, words, 0.8, 0.99)))
    root = list(range(len(rows)))
    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if root[i] != root[j] and plain_jaccard(a, rows[j][1]) >= 0.8:
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()} == set(root)
