"""What a worker of op5 holds at once."""

import pyarrow as pa

from quellspan.llm import tokens


def test_slices_are_bounded_and_whole():
    texts = pa.array(["x" * (1 << 20)] * 12 + [None, "", "y"])
    runs = list(tokens.slices(texts))
    assert sum(map(len, runs)) == len(texts) and pa.concat_arrays(runs).equals(texts)
    assert max(sum(len(t or "") for t in r.to_pylist()) for r in runs) <= 5 << 20


def test_pieces_kept_are_bounded():
    assert tokens.MOST_CACHED <= 600_000
