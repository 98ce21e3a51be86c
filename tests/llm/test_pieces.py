import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from quellspan.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")


def odd_texts(n=800):
    rng = random.Random(3)
    parts = [" ", "  ", "   ", "\n", "\t", "a", "The", "ing", "é", "漢字", "🙂", "\0", "don't", "12", "=", "    def", "word", "\r\n", "ſ", "ﬁ", "<s>", "<unk>", "<0x41>"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(n)] + ["x" * 3000, " ", "     ", "a ", " a", "word " * 3000]


def one(encoder, text, key=b"1"):
    raw, counts = encoder.encode(pa.array(["before it", text]), [b"0", key])
    return np.frombuffer(raw, encoder.model.dtype)[counts[0] :].tolist()


def plain_segments(model, stretch, key, dropout):
    """The rule itself: of all neighbours that form a piece and weren't skipped, the best and leftmost merges, until none is left."""
    symbols = [(i, c) for i, c in enumerate([pieces.SPACE, *[{pieces.SPACE: pieces.LITERAL, " ": pieces.SPACE}.get(c, c) for c in stretch]])]
    limit, never = int(dropout * 2**64), set()
    while True:
        open_ = [(model.known[a + b], i, n) for n, ((i, a), (_, b)) in enumerate(zip(symbols, symbols[1:])) if a + b in model.known and (i, a + b) not in never]
        if not open_:
            return [s for _, s in symbols]
        _, i, n = min(open_)
        pair = symbols[n][1] + symbols[n + 1][1]
        x = (key + i * 0x9E3779B97F4A7C15 + model.ids[pair] * 0xD1B54A32D192ED03) % 2**64
        x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD % 2**64
        x = (x ^ x >> 29) * 0xC4CEB9FE1A85EC53 % 2**64
        if x ^ x >> 32 < limit:
            never.add((i, pair))
        else:
            symbols[n : n + 2] = [(i, pair)]


def plain_ids(model, text, name, dropout=0.1, seed=20240229):
    """All stretches of a text, keyed by seed, row and place: cut before each space, spaces but the last of a run stay with what follows."""
    from xxhash import xxh64_intdigest

    base, out = xxh64_intdigest(name, seed), []
    for place, stretch in enumerate(pieces.Encoder.cuts(text)):
        x = (base + place + seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        for s in plain_segments(model, stretch, x ^ x >> 31, dropout):
            out += [model.ids[s]] if s in model.ids else [int.from_bytes(model.byte[x], "little") for x in s.replace(pieces.LITERAL, pieces.SPACE).encode()]
    return out


def test_both_agendas_agree():
    model, rng = pieces.Model.of(PATH), random.Random(1)
    for _ in range(400):
        symbols = [rng.choice("▁▁theinationsé") for _ in range(rng.randint(1, 40))]
        for limit in (0, 1 << 61, 1 << 63):
            skip = pieces.skipping(rng.getrandbits(64), limit)
            assert model.merged(list(symbols), skip)[0] == model.merged_long(list(symbols), skip)


def test_side_by_side_agrees():
    model, rng = pieces.Model.of(PATH), random.Random(2)
    rows = [[rng.choice("▁theinations") for _ in range(rng.randint(1, 30))] for _ in range(600)]
    keys, limit = np.random.default_rng(3).integers(0, 1 << 64, 600, dtype=np.uint64), int(0.3 * 2**64)
    cells = np.array([[model.ids[c] for c in r] + [-1] * (30 - len(r)) for r in rows], np.int32)
    got = model.side_by_side(cells, np.array([len(r) for r in rows]), keys, limit)
    for r, k, out in zip(rows, keys.tolist(), got):
        assert [model.ids[x] for x in model.merged_long(list(r), pieces.skipping(k, limit))] == out[out >= 0].tolist()


def test_skips_are_independent():
    """No correlation between pieces or places that lie close together, and the asked rate."""
    keys, limit = np.random.default_rng(1).integers(0, 1 << 64, 40_000, dtype=np.uint64), int(0.1 * 2**64)
    base = pieces.skipped(keys, np.uint64(pieces.salt(3, 500)), limit)
    assert abs(base.mean() - 0.1) < 0.01
    for other in ((3, 501), (3, 502), (4, 500), (5, 500), (1, 500)):
        both = pieces.skipped(keys, np.uint64(pieces.salt(*other)), limit)
        assert abs(np.corrcoef(base, both)[0, 1]) < 0.03
    assert [pieces.skipping(int(k), limit)(3, 500) for k in keys[:200]] == base[:200].tolist()


def test_without_dropout_equals_the_library():
    library = SentencePieceProcessor(model_file=PATH)
    encoder = pieces.Encoder(PATH, 0.0, 1)
    for t in odd_texts():
        assert one(encoder, t) == library.encode(t), repr(t)


def test_dropout_is_lossless_seeded_and_varied():
    texts = [*odd_texts(), "a▁b ▁▁c", "▁", "internationalization of tokenizers " * 40]
    a, again, other = pieces.Encoder(PATH, 0.1, 5), pieces.Encoder(PATH, 0.1, 5), pieces.Encoder(PATH, 0.1, 6)
    raw, counts = a.encode(pa.array(texts), [b"1"] * len(texts))
    assert [x.tolist() for x in np.split(np.frombuffer(raw, a.model.dtype), np.cumsum(counts)[:-1])] == [one(again, t) for t in texts]
    ids = one
    for t in texts:
        assert a.model.decode(ids(a, t)) == t
        assert ids(a, t) == ids(again, t)
        if len(t) < 2000:
            assert ids(a, t) == plain_ids(a.model, t, b"1", 0.1, 5)
    last = texts[-1]
    assert ids(a, last) != ids(other, last) and ids(a, last) != ids(a, last, b"2")
    assert len({tuple(ids(a, "internationalization", str(k).encode())) for k in range(200)}) > 3
    lengths = [len(ids(pieces.Encoder(PATH, p, 5), last)) for p in (0.0, 0.1, 0.5)]
    assert lengths[0] < lengths[1] < lengths[2]
    everything = pieces.Encoder(PATH, 1.0, 5)
    assert ids(everything, "ab cd") == [everything.model.ids[c] for c in "▁ab▁cd"]


def test_columns(spark):
    rows = [(None, None, "x"), (1, "", "x"), (2, "clean  text ", "x"), (2, "clean  text ", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pieces string")
    got = pieces.with_pieces(docs, PATH).withColumn("back", pieces.decode(F.col("pieces"), PATH)).collect()
    assert [r.back for r in got] == ["", "", "clean  text ", "clean  text "] and got[2].pieces == got[3].pieces
    assert pieces.with_pieces(docs.limit(0), PATH).count() == 0


def test_query(spark, sf_dir):
    """Against the rule itself, on every document, whole."""
    model = pieces.Model.of(PATH)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op1_pieces(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = np.array(plain_ids(model, docs[r.doc_id] or "", str(r.doc_id).encode()))
        assert r.lossless and (r.n_pieces, r.ids_crc32) == (len(ids), zlib.crc32(ids.astype("<u4").tobytes()))


def test_every_occurrence_draws_its_own():
    """One word over many rows and many times in a row has far more than a few segmentations, each by its own key alone."""
    encoder, model = pieces.Encoder(PATH, 0.1, 5), pieces.Model.of(PATH)
    word = "internationalization"
    over_rows = {tuple(one(encoder, word, str(k).encode())) for k in range(2000)}
    assert len(over_rows) > 16
    raw, counts = encoder.encode(pa.array([word] * 300 + [" ".join([word] * 300), "  x".join([word] * 300)]), [str(k).encode() for k in range(302)])
    assert len({tuple(x) for x in np.split(np.frombuffer(raw, model.dtype), np.cumsum(counts)[:-1])[:300]}) > 16
    texts = [*odd_texts(200), "the word and the word", "x" * 300 + " y"]
    keys = [str(k % 7).encode() for k in range(len(texts))]
    raw, counts = encoder.encode(pa.array(texts), keys)
    want = b""
    for t, k in zip(texts, keys):
        cut = encoder.cuts(t)
        want += b"".join(model.segment(p, pieces.skipping(d, encoder.limit)) for p, d in zip(cut, encoder.draw(np.array([len(cut)]), [k]).tolist()))
    assert raw == want
