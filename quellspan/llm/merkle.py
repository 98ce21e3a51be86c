"""Merkle manifest of a table as a postorder append log, with proofs addressed in closed form.

Rows are leaves; a tree holds the leaves of one group (a language) in order of their id, and every run of eight neighbours
of a level becomes their parent. The groups' roots are the leaves of one more tree, whose root stands for the table.

An aligned builder takes the 512 leaves below one node three levels up and appends nodes as they are completed: a leaf, then
every parent whose run is full, so its segment of the log is in postorder. Builders know nothing of each other; the nodes
they end with are the leaves of the next tier of builders, so a tree of n leaves takes log(n) / log(512) tiers and no task
ever holds more than one block. Where a node stands in the log follows from the sizes of the subtrees before it
(:func:`position`); proofs read a leaf's siblings at such places in one segment per tier, from the root down.

What rows are taken as: a null field is ``-``, another is its length in UTF-8 bytes, ``:`` and its text; so null and empty
differ, and texts of any length are hashed whole. Null groups form a tree of their own, which comes first; null ids come
first in their tree. Repeated ids are leaves of their own, in order of their digests, and repeated rows equal leaves. An
empty table has no rows here. Columns besides the given fields take no part, whatever their names.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quellspan.session import written

#: Children of a node, and levels that one builder completes.
ARITY, DIGITS = 8, 3
WIDTH = ARITY**DIGITS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "array<struct<left:string,right:string>>"


def leaf(*fields: Column) -> Column:
    """The digest of a row, 32 bytes."""
    said = [F.when(f.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string"))) for f in fields]
    return F.unhex(F.sha2(F.concat(*said), 256))


# ---- the log ------------------------------------------------------------------------------------------------------------


def height(leaves: int) -> int:
    """Levels above the leaves."""
    levels = 0
    while ARITY**levels < leaves:
        levels += 1
    return levels


def position(level, index, leaves: int, levels: int):
    """Where node ``index`` of a level stands in the postorder log of a tree of ``leaves`` with ``levels`` above them.

    Before it, and with it, are complete: of its own level and those below all nodes up to its last leaf, and of those above
    the ones that end before its first.
    """
    index = np.asarray(index, np.int64)
    first, last = index * ARITY**level, np.minimum((index + 1) * ARITY**level, leaves)
    below = sum(-(-last // ARITY**m) for m in range(level + 1))
    return below + sum(first // ARITY**m for m in range(level + 1, levels + 1)) - 1


def appended(leaves: list[bytes], levels: int) -> list[bytes]:
    """The nodes of a builder in completion order, as hex texts."""
    log, unfinished = [], [[] for _ in range(levels + 1)]
    for n, node in enumerate(leaves, 1):
        log.append(node)
        unfinished[0].append(node)
        for level in range(levels):
            run = unfinished[level]
            if len(run) < ARITY and n < len(leaves):
                break
            node = sha256(b"".join(run)).hexdigest().encode()
            log.append(node)
            unfinished[level] = []
            unfinished[level + 1].append(node)
    return log


def own_levels(leaves: int) -> int:
    """Levels of a builder in a tree of so many leaves."""
    return height(leaves) if leaves <= WIDTH else DIGITS


def _built(batches):
    for batch in batches:
        nodes, roots = [], []
        for members, leaves in zip(batch.column("members"), batch.column("leaves").to_pylist()):
            log = appended([d.hex().encode() for d in members.values.field("digest").to_pylist()], own_levels(leaves))
            nodes.append(bytes.fromhex(b"".join(log).decode()))
            roots.append(nodes[-1][-32:])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.binary()), pa.array(roots, pa.binary())], [*batch.schema.names, "nodes", "root"])


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows(tree, ...)`` with ``rank``, from 0 in each tree in the given order, and ``leaves``, how many its tree has.

    Ranks are places inside ranges of (tree, order) plus what of the tree lies in earlier ranges: no task holds a whole tree.
    """
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranged = written(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "manifest-ranked")
    counts = ranged.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    own = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("tree").alias("_tree"), F.col("_part").alias("_of"), "_first", before.alias("_before"), F.sum("_n").over(own).alias("leaves"))
    out = ranged.join(counts, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("_part") == F.col("_of")))
    return out.select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("rank"), "leaves")


def log(rows: DataFrame) -> list[DataFrame]:
    """The log of ``rows(tree, rank, leaves, digest, ...)``, tier by tier from the leaves, as written tables.

    A segment is a row: tree, block, leaves (of its tier), members (what it was built from, in order), nodes (32 bytes each,
    in postorder) and root.
    """
    kind = {c: rows.schema[c].dataType.simpleString() for c in rows.columns}
    tiers, extra = [], [c for c in rows.columns if c not in ("tree", "rank", "leaves", "digest")]
    while True:
        member = F.struct("rank", "digest", *extra)
        blocks = rows.groupBy("tree", F.floor(F.col("rank") / WIDTH).alias("block"), "leaves").agg(F.sort_array(F.collect_list(member)).alias("members"))
        fields = ",".join(f"{c}:{kind[c]}" for c in ("rank", "digest", *extra))
        schema = f"tree {kind['tree']}, block long, leaves long, members array<struct<{fields}>>, nodes binary, root binary"
        tiers.append(written(blocks.mapInArrow(_built, schema), "manifest-log"))
        upper = tiers[-1].where(F.col("leaves") > WIDTH)
        if upper.isEmpty():
            return tiers
        rows, extra = upper.select("tree", F.col("block").alias("rank"), F.ceil(F.col("leaves") / WIDTH).alias("leaves"), F.col("root").alias("digest")), []


def roots(tiers: list[DataFrame]) -> DataFrame:
    """``(tree, digest)``: what remains of each tree."""
    tops = [t.where(F.col("leaves") <= WIDTH).select("tree", F.col("root").alias("digest")) for t in tiers]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


# ---- proofs -------------------------------------------------------------------------------------------------------------


def _runs(nodes: bytes, count: int, leaves: int) -> list[list[bytes]]:
    """The runs of each level of a segment, as hex texts, read at their places in the log."""
    text, levels = np.frombuffer(nodes.hex().encode(), "S64"), own_levels(leaves)
    out = []
    for level in range(levels):
        places = position(level, np.arange(-(-count // ARITY**level)), count, levels)
        raw = text[places].tobytes()
        out.append([raw[i : i + 64 * ARITY] for i in range(0, len(raw), 64 * ARITY)])
    return out


def steps(runs: list[list[bytes]], i: int) -> list[tuple[bytes, bytes]]:
    """What stands left and right of leaf ``i``'s ancestors in their runs, level by level."""
    out = []
    for level in runs:
        i, slot = divmod(i, ARITY)
        out.append((level[i][: 64 * slot], level[i][64 * (slot + 1) :]))
    return out


def folded(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        node = sha256(left + node + right).hexdigest().encode()
    return node


def _path(above) -> list[tuple[bytes, bytes]]:
    return [(s["left"].encode(), s["right"].encode()) for s in above]


def _descended(batches):
    """The paths of all leaves of segments."""
    for batch in batches:
        for row in batch.to_pylist():
            count, runs = len(row["members"]), _runs(row["nodes"], len(row["members"]), row["leaves"])
            paths = [[{"left": a.decode(), "right": b.decode()} for a, b in steps(runs, i)] + row["above"] for i in range(count)]
            first = row["block"] * WIDTH
            names = [f.name for f in batch.schema if f.name not in ("block", "leaves", "members", "nodes", "root", "above")]
            columns = [pa.array([row[c]] * count, batch.schema.field(c).type) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(range(first, first + count), pa.int64()), pa.array(paths, batch.schema.field("above").type)], [*names, "index", "above"])


def paths(tiers: list[DataFrame], start: DataFrame | None = None) -> DataFrame:
    """The lowest tier's segments with ``above``: what the roots of their blocks are folded with, and the columns of ``start``.

    start: ``(tree, above, ...)``, what the root of each tree is folded with; nothing where it is None.
    """
    upper = None
    for tier in reversed(tiers):
        top = tier.where(F.col("leaves") <= WIDTH)
        if start is None:
            met = top.withColumn("above", F.array().cast(STEP))
        else:
            met = top.join(start.withColumnRenamed("tree", "_tree"), F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")
        if upper is not None:
            below = tier.where(F.col("leaves") > WIDTH)
            own = upper.withColumnRenamed("tree", "_tree").withColumnRenamed("index", "_block")
            met = met.unionByName(below.join(own, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block"))).drop("_tree", "_block"))
        if tier is tiers[0]:
            return met
        upper = descended(met)
    raise ValueError("a log has a tier")


def descended(segments: DataFrame) -> DataFrame:
    """``(tree, ..., index, above)`` of every leaf of segments with ``above``."""
    names = [c for c in segments.columns if c not in ("block", "leaves", "members", "nodes", "root", "above")]
    schema = ", ".join(f"`{c}` {segments.schema[c].dataType.simpleString()}" for c in names)
    return segments.mapInArrow(_descended, f"{schema}, index long, above {STEP}")


def _proved(batches):
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "log_position"]
    for batch in batches:
        for row in batch.to_pylist():
            members, above = row["members"], _path(row["above"])
            runs, rest, top = _runs(row["nodes"], len(members), row["leaves"]), b"".join(a + b for a, b in above), row["top"].hex()
            own, proofs, found = [], [], []
            for i, m in enumerate(members):
                path = steps(runs, i)
                own.append(m["digest"].hex())
                proofs.append(sha256(b"".join(a + b for a, b in path) + rest).hexdigest())
                found.append(folded(folded(m["shown"].hex().encode(), path), above).decode())
            places = position(0, np.fromiter((m["rank"] for m in members), np.int64, len(members)), row["leaves"], height(row["leaves"]))
            n, subroot = len(members), row["subroot"].hex()
            yield pa.RecordBatch.from_arrays(
                [pa.array([m["id"] for m in members], batch.schema.field("members").type.value_type.field("id").type), *map(pa.array, (own, [subroot] * n, [top] * n, proofs, found, [f == top for f in found], places))],
                names,
            )


def manifest(docs: DataFrame, fields: tuple[str, ...], id_col: str = "doc_id", tree_col: str = "lang", shown: dict[str, Column] | None = None) -> DataFrame:
    """Every row's leaf, roots, the digest of its proof, and whether the row as shown folds to the root.

    shown: columns put in place of the fields of that name in the leaf that is checked; without them rows show themselves.
    Columns: the id, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (of all siblings from the leaf's level up, left to right),
    ``folded_root``, ``verified`` and ``log_position`` (the leaf's place in the log of its tree).
    """
    plain = [F.col(f) for f in fields]
    rows = docs.select(F.col(tree_col).alias("tree"), F.col(id_col).alias("id"), leaf(*plain).alias("digest"), leaf(*[(shown or {}).get(f, F.col(f)) for f in fields]).alias("other") if shown else F.lit(None).cast("binary").alias("other"))
    rows = rows.select("tree", "id", "digest", F.coalesce("other", "digest").alias("shown"))
    trees = log(ranked(written(rows, "manifest-leaves"), "id", "digest", "shown"))
    tops = written(roots(trees), "manifest-roots")
    forest = log(ranked(tops.select(F.lit(0).alias("tree"), F.col("tree").alias("name"), "digest"), "name"))
    top = roots(forest).select("digest").first()
    members = written(paths(forest).select("block", "leaves", "nodes", "above", "members", "tree", "root"), "manifest-top")
    above = descended(members).select("index", "above")
    named = members.select(F.explode("members").alias("m")).select(F.col("m.rank").alias("rank"), F.col("m.name").alias("tree"), F.col("m.digest").alias("subroot"))
    start = named.join(above, F.col("rank") == F.col("index")).select("tree", "above", "subroot", F.lit(bytes(top["digest"]) if top else None).cast("binary").alias("top"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, log_position long"
    return paths(trees, written(start, "manifest-start")).mapInArrow(_proved, schema).withColumnRenamed("id", id_col)


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case and all else as it is."""
    return F.translate(text, UPPER, LOWER)
