import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quellspan.llm import queries, tokens
from quellspan.session import work_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library():
    return Tokenizer.from_file(PATH)


def plain(rows):
    """Ids of the library's encoding of whole texts, in ascending order of ids."""
    t, start, out = library(), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def odd_texts():
    rng = random.Random(11)
    parts = [" ", "  ", "\n", "\t", " ", " ", "\x1c", "a", "Ab", "'s", "é", "7", "42", ".", "…", "漢字", "🙂", "<|endoftext|>", "don't", "\r\n", "x  y"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(1500)]


def test_encoder_equals_the_library():
    texts = odd_texts() + ["", " ", "  ", " a", "a ", "a  ", "\n \n b", " \n b", "word " * 5000]
    want = [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]
    encoder = tokens.Encoder(PATH)
    for _ in range(2):
        for end in (b"", np.array([2], encoder.dtype).tobytes()):
            raw, counts = encoder.encode(pa.array([*texts, None, "last"])[:-1], end)
            got = np.split(np.frombuffer(raw, encoder.dtype), np.cumsum(counts)[:-1])
            assert [x.tolist() for x in got] == [w + [2] * bool(end) for w in [*want, []]]
    assert [len(x) for x in tokens.slices(pa.array(["a" * (9 << 20), None, "b", "c" * (9 << 20), "d"]))] == [1, 3, 1]


@pytest.mark.parametrize("n", [0, 1, 2, 65, 5000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n)).view(np.uint64)
    words, sizes = tokens.build_hash(keys)
    assert sorted(tokens.slots(words, sizes, keys).tolist()) == list(range(len(keys)))


def test_round_trip_with_repeats_and_nulls(spark):
    rows = [(i // 2 if i % 7 else None, t if i % 11 else None) for i, t in enumerate(odd_texts()[:300])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int").repartition(3).cache()
    docs.count()
    path = work_path(spark, "tokens-test")
    manifest = tokens.write(docs, path, PATH, 2).collect()
    got = tokens.read(spark, path, manifest).collect()
    assert sorted((r.id is not None, r.id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((d is not None, d or 0, n, c) for d, _, n, c in plain(rows))
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.concatenate([[0], np.cumsum([r.n_tokens for r in ordered])[:-1]]).tolist()
    ids = [-1 if r.id is None else r.id for r in ordered]
    assert ids == sorted(ids)
    t = library()
    for key in (1, 77, 149):
        want = sorted(t.encode(x or "", add_special_tokens=False).ids + [2] for d, x in rows if d == key)
        assert sorted(x.tolist() for x in tokens.lookup(path, manifest, key)) == want
    assert tokens.lookup(path, manifest, 10**9) == []


def test_empty_table(spark):
    assert tokens.encoded(spark.createDataFrame([], "doc_id long, text string"), PATH, 2).count() == 0


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op5_tokens(spark, sf_dir).collect()) == plain(rows)
