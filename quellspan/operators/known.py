"""Exact redaction: many known values searched at once in many texts.

A value is filed under its anchor, its longest run of letters and digits. Where a value stands, and isn't part of a longer
run, its anchor is a whole run of the text; so the runs of the texts, with their places, are joined to the anchors, and what
meets is compared whole with the text at its place. The work is linear in the texts and in what meets; a registry is only
broadcast after its rows are counted, larger ones meet in a shuffled join whose large partitions Spark splits.

Of values that overlap the longest is taken, then the first. Null texts have no hits; values without a letter or digit and
null values aren't searched; a value given twice under several types has its first type. Texts of any length are searched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quellspan.functions.spans import between, blocks, let, marked, measured, resolve, unmarked
from quellspan.operators.masking import masked
from quellspan.session import written

RUN = r"[\p{L}\p{N}]+"
HIT = "array<struct<priority:bigint,start:bigint,end:bigint,type:string,value:string>>"
#: Rows of a registry that may be broadcast: some tens of megabytes at most for values of up to a few hundred characters.
MOST_SENT, LONGEST_SENT = 50_000, 512


def runs(text: Column) -> Column:
    """The runs of letters and digits of a text, as spans."""
    return measured(marked(text, "", RUN))


def candidate_tokens(df: DataFrame, *keep: str, text_col: str = "text", least: int = 8) -> DataFrame:
    """What may be a value: stretches without white space and brackets of ``least`` characters or more, and what stands in
    them behind an equals sign or a colon; percent signs decoded. Columns: ``keep``, start, end, token."""
    whole = measured(marked(unmarked(F.col(text_col)), "", r"[^\s\"'`<>()\[\]{},;]+"))
    tail = lambda x: F.regexp_extract(x["value"], r"^[^=:]{1,64}[=:]([^=:/].*)$", 1)
    both = lambda x: F.array(x, F.when(tail(x) != "", F.struct((x["end"] - F.length(tail(x))).alias("start"), x["end"].alias("end"), tail(x).alias("value"))))
    rows = df.select(*keep, F.explode(F.filter(F.flatten(F.transform(whole, both)), lambda x: x.isNotNull())).alias("x"))
    token = F.when(F.col("x.value").rlike("%[0-9A-Fa-f]{2}"), F.coalesce(F.try_url_decode(F.replace("x.value", F.lit("+"), F.lit("%2B"))), F.col("x.value"))).otherwise(F.col("x.value"))
    return rows.select(*keep, "x.start", "x.end", token.alias("token")).where(F.length("token") >= least)


def filed(registry: DataFrame) -> DataFrame:
    """``(anchor, lead, value, type)`` of ``registry(value, type)``; lead: what stands in the value before its anchor."""
    one = registry.where(F.col("value").rlike(RUN)).groupBy("value").agg(F.min("type").alias("type"))
    longest = F.array_sort(runs(F.col("value")), lambda a, b: F.when(F.length(a["value"]) > F.length(b["value"]), -1).when(F.length(a["value"]) < F.length(b["value"]), 1).otherwise((a["start"] - b["start"]).cast("int")))
    return one.withColumn("a", F.get(longest, F.lit(0))).select(F.col("a.value").alias("anchor"), F.col("a.start").alias("lead"), "value", "type")


def with_hits(df: DataFrame, key: str, registry: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``hits``, an array of (start, end, type, value) in order; ``key`` names a row and is no null."""
    values = written(filed(registry), "known-values")
    size = values.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("value")).alias("longest")).first()
    small = size["n"] <= MOST_SENT and (size["longest"] or 0) <= LONGEST_SENT
    places = df.select(F.col(key).alias("_key"), F.explode_outer(runs(unmarked(F.col(text_col)))).alias("x")).where("x IS NOT NULL").select("_key", F.col("x.value").alias("anchor"), F.col("x.start").alias("at"))
    met = places.join(F.broadcast(values) if small else values, "anchor").where("at >= lead").select("_key", (F.col("at") - F.col("lead")).alias("start"), "value", "type")
    met = met.groupBy("_key").agg(F.collect_list(F.struct("start", "value", "type")).alias("_met"))  # of one text
    text = F.col("_text")

    def verified(m, cut):
        letter = lambda a, b: F.coalesce(between(cut, a, b).rlike(RUN), F.lit(False))
        inner = lambda x, n: F.rlike(F.substring(x["value"], n, 1), F.lit(RUN))

        def stands(x):
            end = x["start"] + F.length(x["value"])
            apart = ~(inner(x, 1) & (x["start"] > 0) & letter(x["start"] - 1, x["start"])) & ~(inner(x, -1) & letter(end, end + 1))
            return (between(cut, x["start"], end) == x["value"]) & apart

        hit = lambda x: F.struct((-F.length(x["value"])).cast("bigint").alias("priority"), x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("end"), x["type"].alias("type"), x["value"].alias("value"))
        return resolve(F.transform(F.filter(m, stands), hit), HIT)

    out = df.join(met, F.col(key) == F.col("_key"), "left").withColumn("_text", unmarked(F.col(text_col)))
    found = F.when(F.col("_met").isNotNull(), let(F.struct(F.col("_met").alias("m"), blocks(text).alias("cut")), lambda s: verified(s["m"], s["cut"]))).otherwise(F.array().cast(HIT))
    plain = lambda x: F.struct(*[x[c].alias(c) for c in ("start", "end", "type", "value")])
    return out.withColumn("hits", F.sort_array(F.transform(found, plain))).drop("_met", "_key", "_text")


def redacted(df: DataFrame, key: str, registry: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``hits`` and ``masked``: the text with each known value's type in its place."""
    out = with_hits(df, key, registry, text_col)
    return out.withColumn("masked", masked(F.coalesce(F.col(text_col), F.lit("")), F.col("hits")))
