import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from quellspan.llm import merkle, queries

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(nodes):
    """All levels of a tree, by the plain rule."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        first = i // 8 * 8
        out.append((level[first:i], level[i + 1 : first + 8]))
        i //= 8
    return out


def plain(rows):
    """What op11 returns, from the whole table in memory."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = own, levels([leaf(r) for r in own])
    top = levels([trees[g][1][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        own, tree = trees[g]
        for i, r in enumerate(own):
            path = siblings(tree, i) + siblings(top, k)
            shown = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                shown = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            node = leaf(shown)
            for left, right in path:
                node = digest(*left, node, *right)
            out.append((r[0], leaf(r), tree[-1][0], top[-1][0], digest(*[x for left, right in path for x in (*left, *right)]), node, node == top[-1][0]))
    return sorted(map(repr, out))


def run(spark, rows, extra=()):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for name in extra:
        df = df.withColumn(name, F.lit("own"))
    shown = {"text": F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.lowered(F.col("text"))).otherwise(F.col("text"))}
    out = merkle.manifest(df, FIELDS, shown=shown).drop("log_position")
    return sorted(repr(tuple(r)) for r in out.collect())


@pytest.mark.parametrize("leaves", [1, 2, 7, 8, 9, 63, 64, 65, 200, 511, 512])
def test_places_in_the_log(leaves):
    """The closed form names each node's place in what the builder appended."""
    nodes = [f"{i:064d}".encode() for i in range(leaves)]
    log, tree = merkle.appended(nodes, merkle.height(leaves)), levels([n.decode() for n in nodes])
    assert len(log) == sum(map(len, tree))
    for level, own in enumerate(tree):
        places = merkle.position(level, np.arange(len(own)), leaves, merkle.height(leaves))
        assert [log[p].decode() for p in places] == own


@pytest.mark.parametrize("leaves", [513, 4096, 4097])
def test_places_ascend_over_blocks(leaves):
    """In a tree of several blocks the places of all nodes are the numbers from 0 on, each once."""
    high = merkle.height(leaves)
    places = np.concatenate([merkle.position(m, np.arange(-(-leaves // 8**m)), leaves, high) for m in range(high + 1)])
    assert np.array_equal(np.sort(places), np.arange(len(places)))


def test_equals_the_plain_rule(spark):
    """Trees of several tiers, of one leaf, null and empty fields, repeated ids and rows, clashing columns."""
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i} Ä") for i in range(1300)]
    rows += [(i, None, "de", None, None if i % 2 else "") for i in range(5000, 5065)]
    rows += [(7, "s", "fr", 1, "ONE")] + [(9, "s", None, 1, "Null group"), (None, "s", None, 2, "No Id")]
    rows += [(3, "x", "", 1, "Twice")] * 2 + [(3, "y", "", 1, "other"), (8, "s", "Ü", 3, "Z" * 300_000)]
    assert run(spark, rows, ("tree", "rank", "leaves", "digest", "members", "id", "block")) == plain(rows)


def test_many_groups(spark):
    """More groups than a builder takes: the tree of roots has tiers of its own."""
    rows = [(i, "s", f"g{i % 600}", i, "A") for i in range(700)]
    assert run(spark, rows) == plain(rows)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(3, "s", "en", 1, "Only")]) == plain([(3, "s", "en", 1, "Only")])


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS).collect()]
    out = queries.op11_merkle(spark, sf_dir)
    assert sorted(repr(tuple(r)) for r in out.drop("log_position").collect()) == plain(rows)
