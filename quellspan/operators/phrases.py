"""Seed phrases: runs of words of a given list whose last bits are the head of a hash of the others.

The list is a parameter (2,048 words in order, as wallets publish them per language). Only the look-up of words runs in an
Arrow function, of a few lines; runs, bits, hashes and places are columns, so that nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quellspan.functions.spans import between, blocks, let, marked, measured, spans, starts, unmarked

LIST_SIZE = 2048
#: The sizes of phrases, and of how many words a run may be before it is a word list.
SIZES, LONGEST_RUN = (12, 15, 18, 21, 24), 48
#: A phrase of fewer words passes by chance once in 16 and needs a word that names it.
SURE = 15
NEAR = ("seed", "phrase", "mnemonic", "recovery", "wallet", "backup", "bip39", "passphrase")
JOINED = r"[^\p{L}\p{N}_'-]"
BEFORE, RUN, WORD = rf"(?:^|{JOINED})", r"[a-z][a-z, \t\r\n]{45,}", "[a-z]+"
GAP = r"^(,?[ \t]{1,3}|[ \t]*\r?\n[ \t]*)\z"
CONTEXT_BEFORE, CONTEXT_AFTER = 80, 40


def _looked_up(words: Sequence[str]):
    listed = pa.array(list(words), pa.string())

    @F.arrow_udf("array<int>")
    def index(said: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(said), 0).cast(pa.int32())
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes)])
        return pa.ListArray.from_arrays(offsets, pc.index_in(pc.list_flatten(said).cast(pa.string()), value_set=listed))

    return index


def _bits(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: F.lpad(F.bin(i), 11, "0")), "")


def _proven(bits: Column, at: Column, size: Column) -> Column:
    """Whether the ``size`` words from word ``at`` close: a third as many bits as words are the head of SHA-256 of the rest."""
    own = bits.substr(at * 11 + 1, size * 11)
    drawn, tail = F.left(own, F.floor(size * 32 / 3).cast("int")), F.right(own, F.floor(size / 3).cast("int"))
    bytes_ = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(size / 3).cast("int") - 1), lambda k: F.lpad(F.conv(drawn.substr(k * 32 + 1, F.lit(32)), 2, 16), 8, "0")), "")
    head = F.lpad(F.conv(F.left(F.sha2(F.unhex(bytes_), 256), F.lit(2)), 16, 2), 8, "0")
    return F.left(head, F.length(tail)) == tail


def phrases(df: DataFrame, *keep: str, words: Sequence[str], text_col: str = "text", near: tuple[str, ...] = NEAR) -> DataFrame:
    """``(keep, start, end, words, named)``: seed phrases of each text, ``words`` the longest size that closes.

    Words are told by single gaps (up to three blanks, a comma, a line break). In a run of 12 to 48 listed words the span goes
    from the first window that closes to the end of the last, as a listed word beside a phrase may close by chance. ``named``:
    one of ``near`` stands in the 80 characters before or the 40 behind; short phrases count only then (:func:`told`). Null
    and empty texts have none; a text of any length costs in proportion to its runs of small letters.
    """
    if len(words) != LIST_SIZE or len(set(words)) != LIST_SIZE:
        raise ValueError(f"a list of {LIST_SIZE} distinct words is needed")
    text = F.col("_text")
    edge = lambda cut: lambda x: F.struct(
        x["start"].alias("start"), x["value"].alias("value"), between(cut, F.greatest(x["start"] - CONTEXT_BEFORE, F.lit(0)), x["start"]).alias("before"), between(cut, x["end"], x["end"] + CONTEXT_AFTER).alias("after")
    )
    runs = F.when(text.rlike(RUN), let(blocks(text), lambda cut: F.transform(measured(marked(text, BEFORE, RUN)), edge(cut))))
    rows = df.withColumn("_text", unmarked(F.col(text_col))).select(*keep, F.explode_outer(runs).alias("_run")).where("_run IS NOT NULL")

    def split(x):
        every = lambda p, odd: F.transform(F.sequence(F.lit(0), F.floor(F.size(p) / 2).cast("int") - 1), lambda k: F.get(p, 2 * k + odd))
        return let(marked(x, "", WORD), lambda p: F.struct(every(p, 1).alias("said"), every(p, 0).alias("gap"), let(starts(F.transform(p, F.length)), lambda b: every(b, 1)).alias("at")))

    rows = rows.withColumn("_w", split(F.col("_run.value"))).withColumn("_id", _looked_up(words)(F.col("_w.said")))

    def flag(i, k):
        cut_off = (k == F.size("_id") - 1) & F.col("_run.value").rlike(r"[a-z]\z") & (F.length("_run.after") > 0) & ~F.left("_run.after", F.lit(1)).rlike(JOINED)
        linked = (k > 0) & F.get(F.col("_id"), k - 1).isNotNull() & F.rlike(F.get(F.col("_w.gap"), k), F.lit(GAP))
        return F.when(i.isNull() | cut_off, "x").when(linked, "l").otherwise("b")

    rows = rows.withColumn("_runs", spans(F.array_join(F.transform("_id", flag), ""), "", f"bl{{{SIZES[0] - 1},}}"))

    def closed(run):
        n = (run["end"] - run["start"]).cast("int")

        def windows(bits):
            sized = lambda a: F.transform(F.filter(F.array(*map(F.lit, SIZES)), lambda k: (a + k <= n) & _proven(bits, a, k)), lambda k: F.struct(a.alias("a"), (a + k).alias("b"), k.alias("k")))
            return F.flatten(F.transform(F.sequence(F.lit(0), n - SIZES[0]), sized))

        def placed(found):
            first, last = run["start"].cast("int") + F.get(found, F.lit(0))["a"], run["start"].cast("int") + F.array_max(F.transform(found, lambda x: x["b"])) - 1
            at = F.col("_w.at")
            end = F.get(at, last) + F.length(F.get(F.col("_w.said"), last))
            return F.when(F.size(found) > 0, F.struct(F.get(at, first).alias("start"), end.alias("end"), F.array_max(F.transform(found, lambda x: x["k"])).alias("words")))

        return let(let(_bits(F.slice("_id", run["start"].cast("int") + 1, n)), windows), placed)

    short = F.filter("_runs", lambda r: r["end"] - r["start"] <= LONGEST_RUN)
    rows = rows.withColumn("_found", F.when(F.size("_runs") > 0, F.transform(short, closed)))
    rows = rows.select(*keep, "_run", F.explode_outer("_found").alias("_x")).where("_x IS NOT NULL")
    cut, s, e = blocks(F.col("_run.value")), F.col("_x.start"), F.col("_x.end")
    before = F.right(F.concat("_run.before", between(cut, F.greatest(s - CONTEXT_BEFORE, F.lit(0)), s)), F.lit(CONTEXT_BEFORE))
    after = F.left(F.concat(between(cut, e, e + CONTEXT_AFTER), F.col("_run.after")), F.lit(CONTEXT_AFTER))
    named = F.lower(F.concat(before, F.lit(" "), after)).rlike(f"(?:^|[^a-z])(?:{'|'.join(near)})(?:[^a-z]|$)")
    origin = F.col("_run.start")
    return rows.select(*keep, (origin + s).alias("start"), (origin + e).alias("end"), F.col("_x.words").cast("long").alias("words"), named.alias("named"))


def told(found: DataFrame) -> DataFrame:
    """Phrases that count: long enough to be no chance, or named by a word near them."""
    return found.where((F.col("words") >= SURE) | F.col("named"))
