"""Line dedup across documents: exact repeats, and lines within a small edit distance. DataFrame functions only.

A line goes if the same line stands earlier, or if another line within ``threshold`` edits first stands earlier; earlier means
a smaller document id, then a smaller line number. Lines without a word always stay. Every other line may go as a repeat;
near lines are told from ``min_chars`` code points on, where the threshold is a tenth of the line or less.

Near lines meet in a segment-partition join. A line of length l is cut into threshold + 1 even segments, each filed under
(l, segment number, text). Of two lines within the threshold the longer holds some segment of the shorter unchanged, at a
place that the edits before and after it allow; only those places are probed, for every length the shorter may have. A
segment under which very many lines are filed takes a second one: what is left of both lines around it is within the
threshold as well, so it is cut and probed in the same way.

Candidates are told apart inside the join by their letter counts, and verified by a banded bit-parallel edit distance: the
2 * threshold + 1 cells around the diagonal are two bit vectors of vertical steps, and one column of the table costs a few
word operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quellspan.session import scratch, written

THRESHOLD, MIN_CHARS = 2, 20
#: Letters whose counts bound the edit distance from below.
COUNTED = "eantirsold"
#: A segment with about this many filed lines takes a second one. It decides how pairs are found, not which.
HOT, SAMPLED = 256, 16
SPACES = " \t\n\v\f\r"


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(line, check, place, doc, number, text)`` of the lines that may go; line, check: hashes of the text; place: orders (doc, number)."""
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must be a whole number, as it says which line is earlier")
    cut = docs.select(F.col(id_col).cast("long").alias("doc"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("number", "text"))
    place = F.coalesce("doc", F.lit(-(1 << 62))).cast("decimal(38,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col("number")
    return cut.where(F.ltrim("text", F.lit(SPACES)) != "").select(F.xxhash64("text").alias("line"), F.hash("text").alias("check"), place.cast("decimal(38,0)").alias("place"), "doc", "number", "text")


# ---- segments -----------------------------------------------------------------------------------------------------------


def _segment(length: Column, number: Column, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and length of a segment; the last ones take the remainder."""
    longer = length % parts
    base, short = ((length - longer) / parts).cast("int"), F.lit(parts) - longer
    return base * number + F.greatest(number - short, F.lit(0)), base + F.when(number >= short, 1).otherwise(0)


def filed(threshold: int) -> list[tuple[int, int, int]]:
    """Segment number, gap and shift of the segments under which a line is filed."""
    return [(i, 0, 0) for i in range(threshold + 1)]


def probed(threshold: int) -> list[tuple[int, int, int]]:
    """The same of the segments under which lines ``gap`` shorter, and within the threshold of this one, may be filed."""
    shifts = lambda i, gap: range(max(-i, gap - (threshold - i)), min(i, gap + threshold - i) + 1)
    return [(i, gap, shift) for gap in range(threshold + 1) for i in range(threshold + 1) for shift in shifts(i, gap)]


def _cut(rows: DataFrame, segments: list[tuple[int, int, int]], parts: int, *within: str) -> DataFrame:
    """``rows(text, length, ...)`` times the segments, with the segment's ``key`` and its place ``at`` and ``size`` in the line.

    The segments are a constant array, and one small expression makes the key of each: a list of such expressions would grow
    beyond what the JVM compiles. within: columns that belong to the key as well.
    """
    number, gap, shift = (F.col("s")[x] for x in ("number", "gap", "shift"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("number"), F.lit(g).alias("gap"), F.lit(d).alias("shift")) for i, g, d in segments]))
    out = rows.withColumn("s", each).withColumns({"of": F.col("length") - gap, "number": number, "shift": shift})
    start, size = _segment(F.col("of"), F.col("number"), parts)
    out = out.withColumns({"at": start + F.col("shift"), "size": size}).where((F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("length")))
    return out.withColumn("key", F.xxhash64(*within, "number", "of", F.col("text").substr(F.col("at") + 1, F.col("size")))).drop("s", "of", "number", "shift")


def _side(sized: DataFrame, segments: list[tuple[int, int, int]], parts: int, hot: DataFrame | None) -> DataFrame:
    """``(line, letters, key)`` of one side of the join; a key in ``hot(key)`` is replaced by those of a second segment."""
    first = _cut(sized, segments, parts)
    if hot is None:
        return first.select("line", "letters", "key")
    met = first.join(hot.select(F.col("key").alias("busy")), F.col("key") == F.col("busy"), "left")
    around = F.concat(F.col("text").substr(F.lit(1), F.col("at")), F.col("text").substr(F.col("at") + F.col("size") + 1, F.col("length")))
    once = met.where("busy IS NULL").select("line", "letters", "key")
    rest = met.where("busy IS NOT NULL").select("line", "letters", "busy", around.alias("text"), (F.col("length") - F.col("size")).alias("length"))
    return once.unionByName(_cut(rest, segments, parts, "busy").select("line", "letters", "key"))


# ---- verification -------------------------------------------------------------------------------------------------------


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def banded_distance(short: Column, long: Column, threshold: int) -> Column:
    """Edit distance of two texts of more than ``threshold`` code points whose lengths differ by at most it, if it is at most
    ``threshold``; else something larger. ``short``, ``long``: columns with their code points as arrays.

    Bit k of a vector is row j - threshold + k of column j. ``d`` follows the lowest diagonal of the band until the last
    row is reached, then that row.
    """
    width, full = 2 * threshold + 1, (1 << (2 * threshold + 1)) - 1
    m, big = F.size(short), lambda x: F.lit(x).cast("bigint")
    bit = lambda v, k: F.call_function("shiftright", v, k).bitwiseAND(big(1))

    def step(s, j):
        same = big(0)
        for k in range(width):
            row = j - threshold + k
            there = (row >= 1) & (row <= m)
            same = same + F.when(there & (F.get(short, F.greatest(row - 1, F.lit(0))) == F.get(long, j - 1)), big(1 << k)).otherwise(big(0))

        def zero(x):
            d0 = x.bitwiseAND(s["vp"]) + s["vp"]
            return d0.bitwiseXOR(s["vp"]).bitwiseOR(x).bitwiseOR(s["vn"]).bitwiseAND(big(full))

        def horizontal(d0):
            hp = s["vn"].bitwiseOR(F.bitwise_not(d0.bitwiseOR(s["vp"])).bitwiseAND(big(full)))
            return F.struct(d0.alias("d0"), hp.alias("hp"), d0.bitwiseAND(s["vp"]).alias("hn"))

        def vertical(h):
            down = F.call_function("shiftright", h["d0"], F.lit(1))
            vp = h["hn"].bitwiseOR(F.bitwise_not(down.bitwiseOR(h["hp"])).bitwiseAND(big(full)))
            on_row = F.greatest(m - j + threshold, F.lit(0))
            d = s["d"] + F.when(j <= m - threshold, 1 - bit(h["d0"], F.lit(width - 1))).otherwise(bit(h["hp"], on_row) - bit(h["hn"], on_row))
            return F.struct(vp.alias("vp"), down.bitwiseAND(h["hp"]).alias("vn"), d.alias("d"))

        return _let(same, lambda x: _let(zero(x), lambda d0: _let(horizontal(d0), vertical)))

    start = F.struct(big(((1 << (threshold + 1)) - 1) << threshold).alias("vp"), big(0).alias("vn"), big(threshold).alias("d"))
    return F.aggregate(F.sequence(F.lit(1), F.size(long)), start, step, lambda s: s["d"])


def letters(text: Column) -> Column:
    """How many characters are each counted letter, and how many there are, modulo 16, four bits each."""
    packed = F.lit(0).cast("bigint")
    for k, c in enumerate(COUNTED):
        # in bytes, which need not be counted
        n = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
        packed = packed.bitwiseOR(F.shiftleft(n.cast("bigint").bitwiseAND(F.lit(15)), 4 * k))
    return packed.bitwiseOR(F.shiftleft(F.length(text).cast("bigint").bitwiseAND(F.lit(15)), 4 * len(COUNTED)))


def _count(packed: Column, k: int) -> Column:
    return F.shiftright(packed, 4 * k).bitwiseAND(F.lit(15))


def letters_apart(a: Column, b: Column) -> Column:
    """The sum of the differences of two counts, each on the circle of 16; an edit changes it by two at most.

    A replaced character changes two letters, an added one a letter and the length.
    """
    total = F.lit(0).cast("bigint")
    for k in range(len(COUNTED) + 1):
        gap = F.abs(_count(a, k) - _count(b, k))
        total = total + F.least(gap, 16 - gap)
    return total


def _common(a: Column, b: Column, most: Column) -> Column:
    """How many characters two texts begin with alike, ``most`` at most: found in steps of halves."""

    def step(n, k):
        fits = (n + k <= most) & (a.substr(n + 1, k) == b.substr(n + 1, k))
        return n + F.when(fits, k).otherwise(0)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), F.lit(0), step)


def _begin(a: Column, b: Column, most: Column) -> Column:
    """:func:`_common` with its texts bound, so that no step makes them anew."""
    return _let(a, lambda x: _let(b, lambda y: _let(most, lambda n: _common(x, y, n))))


def _differing(met: DataFrame, threshold: int) -> DataFrame:
    """``met(short, long)`` without what both begin and end with, but for a few characters that the verification needs."""
    room = F.length("short") - threshold - 1
    met = met.withColumn("head", _begin(F.col("short"), F.col("long"), room))
    met = met.withColumn("tail", _begin(F.reverse("short"), F.reverse("long"), F.length("short") - threshold - 1 - F.col("head")))
    inner = lambda c: F.col(c).substr(F.col("head") + 1, F.length(c) - F.col("head") - F.col("tail"))
    return met.withColumns({"short": inner("short"), "long": inner("long")}).drop("head", "tail")


def near_pairs(distinct: DataFrame, threshold: int, hot: int = HOT) -> DataFrame:
    """``(place_a, place_b, line_a, line_b, check_a, check_b)``: distinct lines within the threshold of each other.

    distinct: ``(line, check, place, text, length, letters)``.
    """
    sized, parts, every = distinct.select("line", "text", "length", "letters"), threshold + 1, min(SAMPLED, hot)
    drawn = _cut(sized.where(F.pmod("line", F.lit(every)) == 0), filed(threshold), parts)
    busy = written(drawn.groupBy("key").count().where(F.col("count") >= hot // every).select("key"), "lines-hot")
    busy = None if busy.isEmpty() else busy
    index = _side(sized, filed(threshold), parts, busy).select(F.col("line").alias("a"), F.col("letters").alias("of_a"), "key")
    probes = _side(sized, probed(threshold), parts, busy).select(F.col("line").alias("b"), F.col("letters").alias("of_b"), "key")
    # lines that share a segment but differ in more letters than the threshold allows are told apart inside the join; two of
    # one length probe each other, and once is enough
    other_length = _count(F.col("of_a"), len(COUNTED)) != _count(F.col("of_b"), len(COUNTED))
    alike = (index["key"] == probes["key"]) & (letters_apart(F.col("of_a"), F.col("of_b")) <= 2 * threshold)
    pairs = index.join(probes, alike & ((F.col("a") < F.col("b")) | (other_length & (F.col("a") != F.col("b"))))).select("a", "b").distinct()
    pairs = written(pairs, "lines-pairs")
    # the texts of the lines in pairs alone; the join is broadcast where that list is small
    asked = written(pairs.select(F.explode(F.array("a", "b")).alias("line")).distinct(), "lines-asked")
    texts = written(distinct.join(asked, "line").select("line", "check", "place", "text"), "lines-texts", "zstd")
    side = lambda x: texts.select(*[F.col(c).alias(f"{c}_{x}") for c in texts.columns])
    met = pairs.join(side("a"), F.col("a") == F.col("line_a")).join(side("b"), F.col("b") == F.col("line_b")).drop("a", "b")
    swap = F.length("text_b") < F.length("text_a")
    met = met.withColumns({"short": F.when(swap, F.col("text_b")).otherwise(F.col("text_a")), "long": F.when(swap, F.col("text_a")).otherwise(F.col("text_b"))})
    met = _differing(met.drop("text_a", "text_b").where(F.length("long") - F.length("short") <= threshold), threshold)
    # written, as a filter would pull all of this into itself once for every use
    met = written(met, "lines-differing", "zstd")
    # the code points are bound first: an expression inside a lambda is evaluated at each of its steps
    edits = _let(F.split("short", ""), lambda s: _let(F.split("long", ""), lambda t: banded_distance(s, t, threshold)))
    return met.withColumn("edits", edits).where(F.col("edits") <= threshold).drop("edits", "short", "long")


# ---- operator -----------------------------------------------------------------------------------------------------------


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, hot: int = HOT) -> DataFrame:
    """``(doc, number, near)`` of every line that goes; numbers start at 0; near: it goes only for an earlier near line.

    Rows with one id are one document for the order of lines: an equal line at an equal number of theirs is the same line.
    Ids are whole numbers; null ids come first. Null and empty texts have no lines that go. ``min_chars`` must exceed twice
    the threshold. Other columns are not read. Lines are told apart by their texts, and named by two hashes of 96 bits.
    """
    lines, spark = lines_of(docs, id_col, text_col), docs.sparkSession
    own = ["line", "check"]
    with scratch(spark):
        distinct = lines.groupBy(*own, "text").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"))
        distinct = written(distinct.withColumns({"length": F.length("text"), "letters": letters(F.col("text"))}), "lines-distinct", "zstd")
        pairs = written(near_pairs(distinct.where(F.col("length") >= min_chars), threshold, hot), "lines-near")
        b_later = (F.col("place_a") < F.col("place_b")) | ((F.col("place_a") == F.col("place_b")) & (F.col("line_a") < F.col("line_b")))
        near = pairs.select(*[F.when(b_later, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).alias(c) for c in own]).distinct()
        near = written(near.withColumn("near", F.lit(True)), "lines-later")
        known = distinct.select(*own, "place", "n").join(near, own, "left").where("n > 1 OR near")
        known = written(known.select(*own, F.col("place").alias("first"), F.coalesce("near", F.lit(False)).alias("near")), "lines-known", keep=True)
    met = lines.drop("text").join(known.hint("merge"), own).where("near OR place <> first")
    return met.select("doc", "number", (F.col("near") & (F.col("place") == F.col("first"))).alias("near"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: id, n_lines, n_exact and n_near (lines that go), kept_lines, removed (their numbers, ascending)."""
    with scratch(docs.sparkSession):
        gone = removed_lines(docs, id_col, text_col, **options).distinct()
        per_doc = gone.groupBy("doc").agg(
            F.sum(F.when(F.col("near"), 0).otherwise(1)).alias("exact"), F.sum(F.when(F.col("near"), 1).otherwise(0)).alias("nearly"), F.sort_array(F.collect_list("number")).alias("removed")
        )
        per_doc = written(per_doc, "lines-gone", keep=True)
    rows = docs.select(F.col(id_col), F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).cast("long").alias("n_lines"))
    met = rows.join(per_doc, rows[id_col].eqNullSafe(per_doc["doc"]), "left")
    zero = F.lit(0).cast("long")
    return met.select(
        rows[id_col],
        "n_lines",
        F.coalesce("exact", zero).alias("n_exact"),
        F.coalesce("nearly", zero).alias("n_near"),
        (F.col("n_lines") - F.coalesce(F.size("removed"), F.lit(0))).alias("kept_lines"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the lines that go; a row that had text and keeps no line with a word goes as a whole.

    Rows without lines that go stay as they are, null and empty texts among them. Repeated rows lose the same lines.
    """
    with scratch(docs.sparkSession):
        gone = removed_lines(docs, id_col, text_col, **options).distinct()
        per_doc = written(gone.groupBy("doc").agg(F.collect_set("number").alias("gone")), "lines-gone", keep=True)
    # the row travels as one value, so that no column of its own can clash
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    met = own.join(per_doc.hint("merge"), F.col(f"row.{id_col}").eqNullSafe(F.col("doc")), "left")
    text = F.col(f"row.{text_col}")
    left = _let(F.split(text, "\n"), lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")), lambda i: F.get(x, i)))
    met = met.withColumn("left", F.when(F.col("gone").isNull(), text).otherwise(F.array_join(left, "\n"))).where(F.col("gone").isNull() | (F.ltrim("left", F.lit(SPACES)) != ""))
    return met.select(*[(F.col("left") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
