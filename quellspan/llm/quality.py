"""Quality rules with thresholds that adapt to each language and source. DataFrame functions only.

Each text's statistics are counted inside its row. Three of them, as whole millionths, go into quantile sketches: counts per
bucket of fixed relative width, per language and source. Sketches merge by adding counts, so those of a language and of the
whole are sums of those of its sources. The quartiles of a group set its fences; a group of few rows takes its
language's, a language of few rows takes the whole's. Rows then meet their fences in a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quellspan.session import written

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
MILLION = 1_000_000
SUB = 7
#: Fewest rows that give a group its own fences, and the width of the fences in quartile distances.
LEAST_ROWS, WIDTH = 200, 6


@dataclass(frozen=True)
class Rule:
    """A ratio of two statistics; ``slack``: the least quartile distance, in millionths; ``low``: whether small values fail too."""

    name: str
    part: str
    of: str
    slack: int
    low: bool = False


RULES = (
    Rule("symbols", "n_symbols", "word_chars", 5_000),
    Rule("word_length", "word_chars", "n_words", 100_000, True),
    Rule("dup_lines", "n_dup_lines", "n_lines", 60_000),
)


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the statistics of each whole text; a null text counts as empty. Columns of these names are replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    out = docs.withColumn("_words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).withColumn("_lines", lines)
    out = out.withColumn("_codes", F.transform("_words", lambda w: F.xxhash64(w)))
    windows = F.transform(
        F.sequence(F.lit(0), F.size("_codes") - WINDOW), lambda i: F.xxhash64(*[F.get("_codes", i + k) for k in range(WINDOW)])
    )
    out = out.withColumn("_windows", F.when(F.size("_codes") >= WINDOW, windows))
    placed = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), placed))
    twice = F.filter(
        "_sorted",
        lambda x, j: (x["h"] == F.get("_sorted", j - 1)["h"]) | F.coalesce(x["h"] == F.get("_sorted", j + 1)["h"], F.lit(False)),
    )
    out = out.withColumn("_twice", F.array_sort(F.transform(twice, lambda x: x["i"])))
    spans = F.transform("_twice", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_twice", j + 1) - p, F.lit(WINDOW))))
    covered = F.when(F.col("_twice").isNull(), F.lit(0)).otherwise(F.aggregate(spans, F.lit(0), lambda a, x: a + x))
    stats = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": covered,
        "n_lines": F.size("_lines"),
    }
    out = out.withColumns({k: v.cast("long") for k, v in stats.items()})
    return out.drop("_words", "_lines", "_codes", "_windows", "_sorted", "_twice")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _ratio(rule: Rule) -> Column:
    return F.floor(F.expr(f"{rule.part} * {MILLION} div greatest({rule.of}, 1)")).cast("long")


def bucket(value: Column) -> Column:
    """The bucket of a whole number of 0 or more: itself below 256, else its leading eight bits and their shift."""
    shift = F.greatest(F.length(F.bin(value)) - (SUB + 1), F.lit(0))
    return (shift * (1 << SUB) + F.call_function("shiftright", value, shift)).cast("long")


def bucket_floor(index: Column) -> Column:
    """The least value of a bucket."""
    shift = F.greatest(F.floor(index / (1 << SUB)).cast("int") - 1, F.lit(0))
    return F.call_function("shiftleft", index - shift * (1 << SUB), shift)


def sketches(stats: DataFrame) -> DataFrame:
    """``(grp_lang, grp_source, rule, bucket, n)`` over the rows that the base rules keep."""
    points = F.array(*[F.struct(F.lit(r.name).alias("rule"), bucket(_ratio(r)).alias("bucket")) for r in RULES])
    rows = stats.where(~base_failed()).select("grp_lang", "grp_source", F.explode(points).alias("p"))
    return rows.groupBy("grp_lang", "grp_source", "p.rule", "p.bucket").agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """One row per language and source: low and high fence of each rule."""
    groups = sketch.select("grp_lang", "grp_source").distinct()
    levels = [
        sketch.select("grp_lang", "grp_source", F.lit(2).alias("level"), "rule", "bucket", "n"),
        sketch.select("grp_lang", F.lit("").alias("grp_source"), F.lit(1).alias("level"), "rule", "bucket", "n"),
        sketch.select(F.lit("").alias("grp_lang"), F.lit("").alias("grp_source"), F.lit(0).alias("level"), "rule", "bucket", "n"),
    ]
    key = ["level", "grp_lang", "grp_source", "rule"]
    merged = levels[0].unionByName(levels[1]).unionByName(levels[2]).groupBy(*key, "bucket").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*key)
    upto = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    counted = merged.withColumns({"below": F.sum("n").over(upto), "rows": F.sum("n").over(whole)})
    quartile = lambda k: bucket_floor(F.min(F.when(F.col("below") * 4 >= F.col("rows") * k, F.col("bucket"))))
    quartiles = counted.groupBy(*key).agg(F.max("rows").alias("rows"), quartile(1).alias("q1"), quartile(3).alias("q3"))
    slack = F.lit(0)
    for r in RULES:
        slack = F.when(F.col("rule") == r.name, r.slack).otherwise(slack)
    reach = WIDTH * F.greatest(F.col("q3") - F.col("q1"), slack)
    fence = quartiles.where((F.col("level") == 0) | (F.col("rows") >= LEAST_ROWS)).select(*key, (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))
    sides = [F.first(F.when(F.col("rule") == r.name, F.col(side)), ignorenulls=True).alias(f"{r.name}_{side}") for r in RULES for side in ("low", "high")]
    wide = written(fence.groupBy("level", "grp_lang", "grp_source").agg(*sides), "quality-levels")
    names = [f"{r.name}_{side}" for r in RULES for side in ("low", "high")]
    at = lambda n, *on: wide.where(F.col("level") == n).select(*on, *[F.col(c).alias(f"{c}{n}") for c in names])
    joined = groups.join(at(2, "grp_lang", "grp_source"), ["grp_lang", "grp_source"], "left").join(at(1, "grp_lang"), "grp_lang", "left")
    whole_row = wide.where("level = 0").first() or {c: None for c in names}
    last = {c: F.lit(whole_row[c]).cast("long") for c in names}
    return joined.select("grp_lang", "grp_source", *[F.coalesce(f"{c}2", f"{c}1", last[c]).alias(c) for c in names])


def judged(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep_text: bool = True) -> DataFrame:
    """``docs`` with the statistics, base_failed and kept; without ``text_col`` unless ``keep_text``.

    A null language or source counts as the empty one. A row of a group in which no row passes the base rules fails them
    itself. Repeated rows are judged, and counted, once each. Columns named like the statistics are replaced.
    """
    label = lambda c: F.coalesce(F.col(c), F.lit(""))
    stats = with_stats(docs, text_col).withColumns({"grp_lang": label(lang_col), "grp_source": label(source_col)})
    stats = written(stats if keep_text else stats.drop(text_col), "quality-stats", "zstd")
    limits = written(fences(written(sketches(stats), "quality-sketches")), "quality-fences")
    inside = F.lit(True)
    for r in RULES:
        inside &= _ratio(r) <= F.col(f"{r.name}_high")
        if r.low:
            inside &= _ratio(r) >= F.col(f"{r.name}_low")
    out = stats.join(limits, ["grp_lang", "grp_source"], "left")
    out = out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))
    return out.drop("grp_lang", "grp_source", *[f"{r.name}_{side}" for r in RULES for side in ("low", "high")])


def keep(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its own columns."""
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"))
    packed = judged(whole, "_text", "_lang", "_source", keep_text=False)
    return packed.where("kept").select("_row.*")
