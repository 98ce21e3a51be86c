import hashlib
import random

import pytest

from quellspan.operators import phrases

#: 2,048 made-up words in order, standing in for a published list.
WORDS = [a + b + c for a in "bcdfghjklmnprstv" for b in ("ba", "de", "fi", "go", "lu", "ma", "ne", "ri") for c in ("lk", "mt", "nd", "rs", "st", "sh", "ck", "ft", "lp", "mb", "ng", "nk", "pt", "rd", "rk", "th")]
rng = random.Random(11)


def made(n):
    drawn = rng.randbytes(n * 4 // 3)
    bits = "".join(f"{b:08b}" for b in drawn) + f"{hashlib.sha256(drawn).digest()[0]:08b}"[: n // 3]
    return [WORDS[int(bits[i : i + 11], 2)] for i in range(0, len(bits), 11)]


def closes(words):
    bits = "".join(f"{WORDS.index(w):011b}" for w in words)
    cut = len(words) * 32 // 3
    return f"{hashlib.sha256(int(bits[:cut], 2).to_bytes(cut // 8, 'big')).digest()[0]:08b}"[: len(words) // 3] == bits[cut:]


def plain(words):
    """First and last word and longest size of the windows that close."""
    got = [(a, a + k, k) for a in range(len(words)) for k in phrases.SIZES if a + k <= len(words) and closes(words[a : a + k])]
    return (min(a for a, _, _ in got), max(b for _, b, _ in got), max(k for _, _, k in got)) if got else None


def rows_of(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(4)
    return sorted(map(tuple, phrases.phrases(df, "i", words=WORDS).collect()))


@pytest.mark.parametrize("gap", [" ", "\n", ", ", "  \r\n"])
def test_phrases_of_every_size_at_their_places(spark, gap):
    all_ = [made(n) for n in phrases.SIZES]
    texts = [f"Ünder Wallet: {gap.join(p)}. End" for p in all_]
    want = [(i, *(texts[i].index(gap.join(p)) + x for x in (0, len(gap.join(p)))), len(p), True) for i, p in enumerate(all_)]
    got = rows_of(spark, texts)
    assert [(i, e, n, t) for i, _, e, n, t in got] == [(i, e, n, t) for i, _, e, n, t in want]
    assert all(g[1] >= w[1] for g, w in zip(got, want)) and [g[1] for g in got] == [w[1] for w in want]


def test_random_runs_equal_a_plain_search(spark):
    runs = [[rng.choice(WORDS) for _ in range(rng.randrange(12, 60))] for _ in range(60)]
    texts = ["é " + " ".join(r) for r in runs]
    want = []
    for i, r in enumerate(runs):
        hit = plain(r) if len(r) <= phrases.LONGEST_RUN else None
        if hit:
            a, b, k = hit
            want.append((i, 2 + len(" ".join(r[:a])) + (a > 0), 2 + len(" ".join(r[:b])), k, False))
    assert len(want) > 20
    assert rows_of(spark, texts) == want


def test_broken_runs_word_lists_and_empty_texts(spark):
    p = made(24)
    other = [" ".join(p[:11]), " ".join(made(12))[:-1] + "X", " - ".join(p), " ".join(WORDS[:2048]), " ".join(p[:6] + ["hello"] + p[6:11]), "", None, "\n\n".join(p), "A" + " ".join(p[:12])]
    assert rows_of(spark, other) == []
    assert phrases.told(phrases.phrases(spark.createDataFrame([(0, " ".join(made(15)))], "i int, text string"), "i", words=WORDS)).count() == 1


def test_the_list_is_checked(spark):
    with pytest.raises(ValueError, match="2048 distinct"):
        phrases.phrases(spark.createDataFrame([("a",)], "text string"), words=["a"])
