from collections import Counter

import corpus_pipeline
import public_tokenizers
from test_lines import plain_removed, third_alike
from test_mixing import plain_mix
from test_near_dedup import plain_jaccard
from test_pieces import plain_ids
from test_quality import plain_stats

from quellspan.llm import lines, pieces, quality
from quellspan.session import written


def test_stages_against_brute_force(spark, sf_dir):
    """Each stage on its own input, then the whole."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, sf_dir), "stage")
        seen.append((name, docs.collect(), out.collect()))
        assert name.startswith("SentencePiece") or out.columns == columns
        docs = out
    (_, before, after) = seen[0]
    judged = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(before, spark.read.parquet(f"{sf_dir}/documents.parquet").schema), keep_text=False).collect()}
    assert sorted(r.doc_id for r in after) == sorted(d for d, k in judged.items() if k)
    for r in before:
        n, _, _, _, rep, _ = plain_stats(r.text)
        assert not ((n < 20 or 100 * rep > 30 * n) and judged[r.doc_id])

    (_, before, after) = seen[1]
    gone = {(d, n) for d, n, _ in plain_removed([(r.doc_id, r.text) for r in before], lines.THRESHOLD, lines.MIN_CHARS, third_alike)}
    want = {r.doc_id: "\n".join(x for n, x in enumerate(r.text.split("\n")) if (r.doc_id, n) not in gone) for r in before}
    assert {r.doc_id: r.text for r in after} == {d: t for d, t in want.items() if t.strip()}

    (_, before, after) = seen[2]
    root = {r.doc_id: r.doc_id for r in before}
    rows = [(r.doc_id, r.text) for r in before]
    for i, (d, a) in enumerate(rows):
        for e, b in rows[:i]:
            if root[d] != root[e] and plain_jaccard(a, b) >= 0.8:
                least, most = sorted((root[d], root[e]))
                root = {x: least if y == most else y for x, y in root.items()}
    assert Counter(r.doc_id for r in after) == Counter(set(root.values()))

    (_, before, after) = seen[3]
    mix, _, _ = plain_mix([(r.doc_id, r.text, r.lang, r.source) for r in before], corpus_pipeline.POWERS)
    assert sorted(r.doc_id for r in after) == sorted(m[0] for m in mix if m[7])

    (_, before, after) = seen[4]
    model = pieces.Model.of(public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in before}
    assert len(after) == len(before)
    for r in after:
        assert r.lossless and r.pieces == plain_ids(model, texts[r.doc_id], str(r.doc_id).encode())

    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, tuple(r.pieces)) for r in whole) == sorted((r.doc_id, tuple(r.pieces)) for r in after)


def test_columns_with_clashing_names(spark):
    words = " ".join(f"word{i} and some more of it" for i in range(12))
    rows = [(1, words, "en", "s", 1, 5, "x"), (2, words + " again", "en", "s", 1, 5, "y"), (3, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, place string")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == columns
    left = [r.doc_id for r in docs.collect()]
    assert len(left) <= 1 and set(left) <= {1}, "the second text is a near copy of the first, the third has no words"


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
