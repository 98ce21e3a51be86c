"""SimHash near-duplicates: fingerprints of word shingles, linked at a few differing bits.

Candidates: the 64 bits are cut into ``max_distance + 3`` blocks. Two fingerprints that differ in at most ``max_distance``
bits agree on at least three blocks, so they share a bucket of some three blocks. Inside a bucket a pivot table holds the
Hamming distance of each fingerprint to many reference fingerprints. By the triangle inequality a pair whose largest
coordinate difference exceeds ``max_distance`` cannot be linked; only survivors are verified bit by bit.

Exact copies fold into one fingerprint before any pair is looked at, and a bucket emits a spanning star of each of its
linked parts, never its pairs.

A bound on the overlap of the shingles (:func:`overlapping`) is a far wider radius: at Jaccard similarity 0.8 two fingerprints
differ in about ten bits, where blocks of bits no longer tell pairs apart. There, what fingerprints link is only looked at first,
and the rest is found by bounds that no pair of that overlap can break: two such sets share a shingle among the first ones of
both in any one order, and the parities of their cells differ in no more bits than the sets differ in shingles. The shingles
themselves decide. So every pair is found, whatever the fingerprints.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quellspan.llm.graph import components
from quellspan.session import scratch, written

LONG_RUN = 64
BLOCK = 512
#: Cells of a small set's parities: bit i tells whether an odd number of its shingles fall into cell i. A set has as many cells
#: as shingles at least, a power of two, so that sets apart differ in far more of them than sets of that overlap may.
CELLS = 512
#: Rounds of an open bucket, by the part of the allowed differences: first the nearest pairs, of which many link. They join the
#: parts that most of the wider pairs lie in, and pairs inside a part need no verification.
ROUNDS = (0.75, 1.0)
#: Shingles put last when sets are ordered: of those in this many texts or more of one in so many, at most so many. They only
#: keep buckets small; every order gives the same pairs.
COMMON_LEAST, COMMON_OF, COMMON_MOST = 8, 16, 65_536
#: Bounds on whole numbers are told from products of floats; this is far above their error and far below one.
SLACK = 1e-6


def fingerprint(text: bytes | None, shingle_words: int, seed: int) -> int:
    """Unsigned fingerprint of one text: bit i is set where more than half of the shingles' XXH64 values have it set."""
    from xxhash import xxh64_digest

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[min(shingle_words, len(words)) - 1 :]
    first = np.concatenate([[0], ends + 1])[: len(last)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(last), 65536):
        cut = zip(first[at : at + 65536].tolist(), last[at : at + 65536].tolist())
        hashes = np.frombuffer(b"".join([xxh64_digest(joined[a:b], seed) for a, b in cut]), np.uint8)
        ones += np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(last)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, seed: int = 42) -> DataFrame:
    """``(id, fp)`` per row; fp is the fingerprint as a signed long. Null texts count as texts without words: fp 0."""

    def run(batches):
        for batch in batches:
            values = np.fromiter((fingerprint(x, shingle_words, seed) for x in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def block_masks(max_distance: int) -> list[int]:
    """Masks that keep three of the ``max_distance + 3`` blocks of 64 bits, as signed longs."""
    edges = np.linspace(0, 64, max_distance + 4).round().astype(int)
    blocks = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(edges, edges[1:])]
    masks = [sum(x) for x in combinations(blocks, 3)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def reference_fingerprints(count: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 64, count, dtype=np.uint64)


def _linked(a: np.ndarray, b: np.ndarray, fps: np.ndarray, table: np.ndarray, most: int) -> np.ndarray:
    """Which pairs of positions are linked: the pivot table discards, the bits decide."""
    near = np.flatnonzero(np.abs(table[a] - table[b]).max(axis=1) <= most)
    kept = np.zeros(len(a), bool)
    kept[near] = np.bitwise_count(fps[a[near]] ^ fps[b[near]]) <= most
    return kept


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable position of each of n positions."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _bucket_stars(bucket: np.ndarray, fps: np.ndarray, pivots: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links of whole buckets; rows come sorted by bucket."""
    n = len(fps)
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.append(start, n))
    table = np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)
    found = []
    left = np.repeat(size, size) - (np.arange(n) - np.repeat(start, size)) - 1
    left[np.repeat(size > LONG_RUN, size)] = 0
    rows, lag = np.flatnonzero(left >= 1), 1
    while len(rows):
        ok = _linked(rows, rows + lag, fps, table, most)
        found.append((rows[ok], rows[ok] + lag))
        lag += 1
        rows = rows[left[rows] >= lag]
    for at, m in zip(start[size > LONG_RUN], size[size > LONG_RUN]):
        order = at + np.argsort(table[at : at + m, 0], kind="stable")
        first = table[order, 0]
        for i in range(0, m, BLOCK):
            own = order[i : i + BLOCK]
            upto = np.searchsorted(first, first[min(i + BLOCK, m) - 1] + most, side="right")
            for j in range(i, upto, BLOCK):
                a, b = np.meshgrid(own, order[j : min(j + BLOCK, upto)], indexing="ij")
                a, b = a.ravel(), b.ravel()
                ok = _linked(a, b, fps, table, most)
                found.append((a[ok], b[ok]))
    if not found:
        return fps[:0], fps[:0]
    a, b = (np.concatenate(x) for x in zip(*found))
    root = _roots(n, a, b)
    member = np.flatnonzero(root != np.arange(n))
    return fps[member], fps[root[member]]


def links(distinct: DataFrame, max_distance: int = 2, pivots: int = 16) -> DataFrame:
    """``(a, b)``: links between the distinct values of ``distinct(fp)`` that connect the same fingerprints as all links do."""
    refs = reference_fingerprints(pivots)
    masks = F.array(*[F.struct(F.lit(i).alias("combo"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(block_masks(max_distance))])
    keyed = (
        distinct.select("fp", F.explode(masks).alias("k"))
        .select("fp", "k.combo", "k.bits")
        .repartition("combo", "bits")
        .sortWithinPartitions("combo", "bits")
    )

    def run(batches):
        """Streams over sorted rows; the last bucket of a batch waits for the next one."""
        wait = []
        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if not len(rows[0]):
                continue
            if wait:
                same = (rows[1] == wait[-1][1][-1]) & (rows[2] == wait[-1][2][-1])
                if same.all():
                    wait.append(rows)
                    continue
                cut = int(np.argmin(same))
                yield from stars([*wait, [x[:cut] for x in rows]])
                rows, wait = [x[cut:] for x in rows], []
            tail = int(np.argmax((rows[1] == rows[1][-1]) & (rows[2] == rows[2][-1])))
            if tail:
                yield from stars([[x[:tail] for x in rows]])
            wait = [[x[tail:] for x in rows]]
        if wait:
            yield from stars(wait)

    def stars(parts):
        fps, combo, bits = (np.concatenate(x) for x in zip(*parts))
        if len(fps) < 2:
            return
        bucket = np.cumsum(np.concatenate([[0], (combo[1:] != combo[:-1]) | (bits[1:] != bits[:-1])]))
        a, b = _bucket_stars(bucket, fps.astype(np.int64).view(np.uint64), refs, max_distance)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return keyed.mapInArrow(run, "a long, b long").distinct()


def _rooted(marked: DataFrame, max_distance: int, pivots: int) -> DataFrame:
    """``(fp, root, least)`` per fingerprint of ``marked(id, fp)``: the smallest fingerprint that links reach, and its own smallest id."""
    with scratch(marked.sparkSession):
        distinct = written(marked.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
        linked = written(components(links(distinct, max_distance, pivots), "simhash"), "simhash-roots")
        rooted = distinct.join(linked, distinct.fp == linked.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
        return written(rooted, "simhash-rooted", keep=True)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, max_distance: int = 2, seed: int = 42, pivots: int = 16
) -> DataFrame:
    """``(id, fingerprint, component_id)`` per row of ``docs``; component_id is the smallest id that links reach, its own included.

    Links join fingerprints at ``max_distance`` or fewer differing bits. Null and wordless texts have fingerprint 0 and link
    like any other; repeated rows give repeated result rows; other columns are not read.
    """
    marked = written(fingerprints(docs, id_col, text_col, shingle_words, seed), "simhash")
    with scratch(docs.sparkSession):
        rooted = _rooted(marked, max_distance, pivots)
        least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
        named = written(rooted.join(least, "root").select("fp", "component_id"), "simhash-named", keep=True)
    return marked.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _row_key(id_col: str, text_col: str):
    """Digest of a row's id and text, nulls told from empty values. Rows that share it are copies, so always of one group."""
    parts = [F.coalesce(F.concat(F.lit("+"), F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in (id_col, text_col)]
    return F.md5(F.concat(*parts))


def shingle_hashes(text: bytes | None, shingle_words: int, seed: int) -> np.ndarray:
    """The distinct shingles of a text as sorted XXH64 values; a text of fewer words is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    count = max(1, len(words) - shingle_words + 1)
    return np.unique(np.fromiter((xxh64_intdigest(b" ".join(words[i : i + shingle_words]), seed) for i in range(count)), np.uint64, count))


def _common(rows: DataFrame, shingle_words: int, seed: int) -> np.ndarray:
    """Shingles of many texts, the rarest first, counted over the distinct ones of a sixteenth of the texts."""

    def run(batches):
        for batch in batches:
            found = [shingle_hashes(x, shingle_words, seed).view(np.int64) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], ["hash"])

    some = rows.select(F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("_key")).where(F.pmod("_key", F.lit(COMMON_OF)) == 0)
    counted = some.dropDuplicates(["_key"]).select("text").mapInArrow(run, "hash long").groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    most = counted.where(F.col("n") >= COMMON_LEAST).orderBy(F.desc("n"), "hash").limit(COMMON_MOST).collect()
    return np.array([r["hash"] for r in reversed(most)], np.int64).view(np.uint64)


def _prefix(hashes: np.ndarray, common: np.ndarray, ranks: np.ndarray, overlap: float) -> np.ndarray:
    """The first shingles of a set, in the order of their hashes and common ones last, of which another set of that overlap has
    one at least: it has ``overlap`` of them all, so all but these would be too few. common: ascending, with their ranks."""
    keep = len(hashes) - int(np.ceil(overlap * len(hashes) - SLACK)) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        last = common[at] == hashes
        hashes = np.concatenate([hashes[~last], hashes[last][np.argsort(ranks[at[last]])]])
    return hashes[:keep]


def _parities(hashes: np.ndarray) -> np.ndarray:
    """For each cell a bit: whether an odd number of shingles fall into it."""
    cells = max(CELLS, 1 << (len(hashes) - 1).bit_length())
    odd = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % cells, minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sketched(rows: DataFrame, overlap: float, shingle_words: int, seed: int) -> DataFrame:
    """``(row, node, n, fp, cells, prefix)`` per row of ``rows(row, text)``: a hash of its set of shingles, their number,
    fingerprint, parities of cells and first shingles."""
    from xxhash import xxh64_intdigest

    last = _common(rows, shingle_words, seed)
    ranks = np.argsort(last, kind="stable")
    common = last[ranks]

    def run(batches):
        for batch in batches:
            nodes, sizes, fps, cells, prefixes = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes(text, shingle_words, seed)
                ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
                nodes.append(xxh64_intdigest(hashes.tobytes(), seed) if len(hashes) else 0)
                sizes.append(len(hashes))
                fps.append(int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big"))
                cells.append(_parities(hashes))
                prefixes.append(_prefix(hashes, common, ranks, overlap).view(np.int64) if len(hashes) else hashes.view(np.int64))
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps)]
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *x]))) for x in (cells, prefixes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), signed[0], pa.array(sizes, pa.int32()), signed[1], *lists], ["row", "node", "n", "fp", "cells", "prefix"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.select("row", F.col("text").cast("binary")).mapInArrow(run, f"row {kind}, node long, n int, fp long, cells array<long>, prefix array<long>")


def _needed(n, m, overlap: float):
    """How many shingles two sets of ``n`` and ``m`` share at least, if they overlap by ``overlap``."""
    return F.ceil((n + m) * F.lit(overlap / (1 + overlap)) - F.lit(SLACK))


def _apart(a, b):
    """In how many cells two columns of :func:`_parities` differ, at most the number of shingles that only one set has. Of twice as
    many cells the upper half falls onto the lower; where they are more than that, nothing is told."""
    size, most = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    folded = [F.when(F.size(c) > size, F.zip_with(F.slice(c, 1, size), F.slice(c, size + 1, size), lambda x, y: x.bitwiseXOR(y))).otherwise(c) for c in (a, b)]
    told = F.aggregate(F.zip_with(*folded, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    return F.when(most > size * 2, F.lit(0)).otherwise(told)


def _near(a: str, b: str, overlap: float, part: float = 1.0):
    """Whether two sets can overlap that much, told by bounds: by their sizes, by the places of the first shingle that they share
    (all shared ones stand there or later), and by their cells, at most ``part`` of the allowed differences apart."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    need = _needed(n, m, overlap)
    sizes = F.least(n, m) >= F.greatest(n, m) * F.lit(overlap) - F.lit(SLACK)
    places = (F.col(f"{a}.at") <= n - need) & (F.col(f"{b}.at") <= m - need)
    apart = _apart(F.col(f"{a}.cells"), F.col(f"{b}.cells"))
    return (F.col(f"{a}.node") != F.col(f"{b}.node")) & sizes & places & (apart <= (n + m - need * 2) * F.lit(part))


def _pairs(rows: DataFrame, x: str = "x.node", y: str = "y.node") -> DataFrame:
    return rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _by_fingerprint(distinct: DataFrame, max_distance: int, pivots: int) -> DataFrame:
    """Pairs of sets of equal or linked fingerprints, a star for each fingerprint and each linked part of a bucket."""
    heads = written(distinct.groupBy("fp").agg(F.min("node").alias("head")), "simhash-fps")
    same = distinct.join(heads, "fp").where("node <> head").select("node", "head")
    ends = links(heads.select("fp"), max_distance, pivots)
    ends = ends.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("node")), "a").join(heads.select(F.col("fp").alias("b"), "head"), "b")
    return _pairs(same.unionByName(ends.select("node", "head")), "node", "head")


def _shared(distinct: DataFrame, overlap: float) -> DataFrame:
    """``(bucket, x)`` for the first shingles of sets that another set has among its own, if one of them is of a size to overlap."""
    by_size = Window.partitionBy("bucket").orderBy("n")
    banded = distinct.select("node", "n", F.posexplode("prefix").alias("at", "bucket"))
    banded = banded.withColumns({"_less": F.lag("n").over(by_size), "_more": F.lead("n").over(by_size)})
    smaller = F.col("_less") >= F.col("n") * F.lit(overlap) - F.lit(SLACK)
    larger = (F.col("n") >= F.col("_more") * F.lit(overlap) - F.lit(SLACK)) & (F.col("at") <= F.col("n") - _needed(F.col("n"), F.col("_more"), overlap))
    held = written(banded.where(smaller | larger).select("bucket", "node", "at"), "simhash-held")
    return held.join(distinct.select("node", "n", "cells"), "node").select("bucket", F.struct("node", "n", "at", "cells").alias("x"))


def _verified(pairs: DataFrame, rows: DataFrame, distinct: DataFrame, overlap: float, shingle_words: int, seed: int) -> DataFrame:
    """The pairs of nodes whose shingles overlap by ``overlap`` or more, told from the texts of those nodes alone."""

    def run(batches):
        for batch in batches:
            sets = [shingle_hashes(x, shingle_words, seed).view(np.int64) for x in batch.column(1).to_pylist()]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["node", "hashes"])

    with scratch(rows.sparkSession):
        asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        asked = written(distinct.join(asked, "node").select("node", F.col("least.key").alias("key")), "simhash-asked")
        texts = rows.select(F.col("row.key").alias("key"), F.col("text").cast("binary").alias("text")).join(asked, "key").dropDuplicates(["node"])
        sets = written(texts.select("node", "text").mapInArrow(run, "node long, hashes array<long>"), "simhash-sets")
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("left")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("right")), "b")
        shared = both.select("a", "b", F.size(F.array_intersect("left", "right")).alias("both"), (F.size("left") + F.size("right")).alias("all"))
        return written(shared.where(F.col("both") / (F.col("all") - F.col("both")) >= overlap).select("a", "b"), "simhash-verified", keep=True)


def overlapping(rows: DataFrame, overlap: float, shingle_words: int = 5, seed: int = 42, max_distance: int = 2, pivots: int = 16) -> DataFrame:
    """``(root, least)`` per set of shingles in ``rows(row, text)``: its group, and the smallest row that has this set.

    Sets that share ``overlap`` of their union link, and groups are what links reach; no such pair is missed. First what
    fingerprints link (:func:`links`) is verified. Then sets meet in buckets, one for each of their first shingles
    (:func:`_prefix`): each is held against the smallest of its bucket, so a large group of near copies costs a star a bucket;
    then the pairs of a bucket whose parts are still apart, the nearest first (``ROUNDS``).
    """
    with scratch(rows.sparkSession):
        with scratch(rows.sparkSession):
            marked = written(_sketched(rows, overlap, shingle_words, seed), "simhash")
            distinct = written(marked.groupBy("node").agg(F.min("row").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), *[F.first(c).alias(c) for c in ("cells", "prefix")]), "simhash-distinct", keep=True)
        bucket = Window.partitionBy("bucket")
        shared = written(_shared(distinct, overlap), "simhash-shared")
        stars = shared.withColumn("y", F.min("x").over(bucket)).where(_near("x", "y", overlap))
        first = written(_pairs(stars).unionByName(_by_fingerprint(distinct, max_distance, pivots)).distinct(), "simhash-first")
        linked = _verified(first, rows, distinct, overlap, shingle_words, seed)
        asked = first
        for part in ROUNDS:
            roots = written(components(linked, "simhash-parts"), "simhash-near")
            parts = shared.select("bucket", "x").join(roots, F.col("x.node") == F.col("node"), "left").select("bucket", "x", F.coalesce("root", "x.node").alias("part"))
            open_ = written(parts.withColumns({"_a": F.min("part").over(bucket), "_b": F.max("part").over(bucket)}).where("_a < _b").drop("_a", "_b"), "simhash-open")
            other = open_.select(F.col("bucket").alias("_bucket"), F.col("x").alias("y"), F.col("part").alias("_part"))
            rest = open_.join(other, (F.col("bucket") == F.col("_bucket")) & (F.col("part") < F.col("_part")) & _near("x", "y", overlap, part))
            further = written(_pairs(rest).join(asked, ["a", "b"], "left_anti"), "simhash-further")
            linked = linked.unionByName(_verified(further, rows, distinct, overlap, shingle_words, seed))
            asked = asked.unionByName(further)
        linked = written(components(linked, "simhash"), "simhash-roots").withColumnRenamed("node", "_node")
        rooted = distinct.join(linked, F.col("node") == F.col("_node"), "left").select(F.coalesce("root", "node").alias("root"), "least")
        return written(rooted, "simhash-rooted", keep=True)


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, max_distance: int = 2, seed: int = 42, pivots: int = 16, overlap: float | None = None
) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id, null ids last (of equal ids, the smallest text hash).

    Groups are of rows, not of ids: rows with a null id, or of one id with different texts, stay or go by their own texts.
    overlap: link all texts that share at least this part of their shingles, and only these (see :func:`overlapping`);
    ``max_distance`` then only tells which pairs are looked at first.
    """
    row = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), _row_key(id_col, text_col).alias("key"))
    own = docs.select(row.alias("row"), F.col(text_col).alias("text"))
    with scratch(docs.sparkSession):
        if overlap is None:
            rooted = _rooted(written(fingerprints(own, "row", "text", shingle_words, seed), "simhash"), max_distance, pivots)
        else:
            rooted = overlapping(own, overlap, shingle_words, seed, max_distance, pivots)
        heads = written(rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.key").alias("head")), "simhash-heads", keep=True)
    # the row travels as one value, so that no column of its own can clash
    kept = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), _row_key(id_col, text_col).alias("key"))
    # sorted on both sides at every size: rows move once, for the join and for the repeats
    kept = kept.join(heads.hint("merge"), F.col("key") == F.col("head"), "left_semi")
    once = Window.partitionBy("key").orderBy(F.lit(1))
    return kept.withColumn("n", F.row_number().over(once)).where("n = 1").select(*[F.col("row")[c].alias(c) for c in docs.columns])
