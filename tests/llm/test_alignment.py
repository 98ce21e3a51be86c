import random
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quellspan.llm import alignment, queries

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    byte = Tokenizer.from_file(PATHS[0])
    byte.encode_special_tokens = True
    return byte, SentencePieceProcessor(model_file=PATHS[1])


def spans(text, libraries):
    """(id, start, end) of both tokenizers over the bytes of whole space+text; empty where bytes are lost."""
    byte, piece = libraries
    chars = alignment.byte_of()
    a = [(i, bytes(chars[c] for c in byte.id_to_token(i))) for i in byte.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(piece.id_to_piece(i)[3:5], 16)]) if piece.is_byte(i) else piece.id_to_piece(i).replace("▁", " ").encode()) for i in piece.encode(text)]
    out = []
    for side in (a, b):
        if b"".join(x for _, x in side) != (" " + text).encode():
            return [], []
        at, own = 0, []
        for i, x in side:
            own.append((i, at, at + len(x)))
            at += len(x)
        out.append(own)
    return out


def plain(rows, libraries):
    """What op12 returns, by comparing all tokens of a text with each other."""
    told = []
    for doc, text in rows:
        a, b = spans(text, libraries) if text else ([], [])
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        said = ";".join("|".join(",".join(str(t[0]) for t in side if lo <= t[1] < hi) for side in (a, b)) for lo, hi in zip([0, *cuts], cuts))
        told.append((doc, a, b, cuts, links, said))
    counts = Counter(x for t in told for x in t[4])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted(
        repr((doc, len(a), len(b), len(cuts), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha256(said.encode()).hexdigest() if a else ""))
        for doc, a, b, cuts, links, said in told
    )


def odd_texts():
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\t", " ", "　", "a", "Ab", "'s", "é", "7", "42", "1000000", ".", "…", "漢字", "🙂", "<|endoftext|>", "</s>", "<0x41>", "don't", "\r\n", "x  y", "unbelievable", "Straße", "▁", "ﬁ", "\x00", "\x1c"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(400)]


TEXTS = [None, "", " ", "  ", " a", "a ", "\n", "same same same", "same same same", "Ünïcödé wörds", "ab" * 3000, "▁", "x▁y", *odd_texts()]


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("own"), "pairs": F.lit(1), "batch": F.lit(2)})
    return sorted(repr(tuple(r)) for r in alignment.aligned(docs, *PATHS).collect())


def test_equals_all_comparisons(spark, libraries):
    rows = [*enumerate(TEXTS), (3, "same id"), (3, "same id"), (None, "no id"), (None, None)]
    assert run(spark, rows) == plain(rows, libraries)
    assert run(spark, []) == []


def test_many_batches(spark, libraries, monkeypatch):
    """Counts are of the corpus, however it is cut into batches."""
    rows = [(i, f"word{i % 7} tokenizer overlaps {t}") for i, t in enumerate(odd_texts()[:60])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(repr(tuple(r)) for r in alignment.aligned(docs, *PATHS).collect()) == plain(rows, libraries)


def test_galloping():
    rng = np.random.default_rng(2)
    table = np.concatenate([np.sort(rng.choice(10_000, n, replace=False)) for n in (1, 2, 3, 100, 3000)])
    edges = np.cumsum([0, 1, 2, 3, 100, 3000])
    for a, b in zip(edges, edges[1:]):
        keys = np.concatenate([rng.integers(0, table[b - 1] + 1, 200), table[a:b]])
        got = alignment.galloped(keys, table, np.full(len(keys), a), np.full(len(keys), b))
        assert np.array_equal(got - a, np.searchsorted(table[a:b], keys))


def test_groups(spark, libraries):
    rows = [(i, t) for i, t in enumerate(TEXTS[:60])]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("text", alignment.groups(F.col("text"), *PATHS).alias("g"))
    for text, found in df.collect():
        a, b = spans(text, libraries) if text else ([], [])
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        want = [(lo, hi, [t[0] for t in a if lo <= t[1] < hi], [t[0] for t in b if lo <= t[1] < hi]) for lo, hi in zip([0, *cuts], cuts)]
        assert [tuple(g) for g in found] == want


def test_query(spark, sf_dir, libraries):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r["text"] or "") < 3000]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(repr(tuple(r)) for r in alignment.aligned(docs, *PATHS).collect()) == plain(rows, libraries)
    out = queries.op12_alignment(spark, sf_dir).collect()
    assert len(out) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"] for r in out)
