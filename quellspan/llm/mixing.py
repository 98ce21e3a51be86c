"""Mixing sources to target weights by iterative proportional fitting. DataFrame functions only.

Token counts are summed per cell of source, language and topic. Raking scales the cells to the target share of each source,
then of each language, then of each topic, round after round. A cell's weight is its raked share over its own share. The
sampling probability of a document is its cell's weight over the largest weight, so expected tokens have the target shares;
a keyed hash of its id against that probability decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quellspan.session import written

WORD = r"[^\x20\x09-\x0D]+"
DIMENSIONS = ("source", "lang", "topic")
#: A share is proportional to the tokens to this power: 1 leaves a dimension as it is, 0 makes it even.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
ROUNDS, ROUNDS_A_TABLE = 12, 3
#: The topic of a text: the first mark it holds.
TOPICS = (("table", " | "), ("licence", "icense"), ("address", "@"))


def topic_of(text: Column) -> Column:
    topic = F.lit("prose")
    for name, mark in reversed(TOPICS):
        topic = F.when(text.contains(mark), name).otherwise(topic)
    return F.coalesce(topic, F.lit("prose"))


def powered_targets(cells: DataFrame, powers: dict) -> dict[str, DataFrame]:
    """``(value, share)`` per dimension from the cells' own tokens."""
    out = {}
    for d in DIMENSIONS:
        own = cells.groupBy(d).agg(F.sum("tokens").alias("n")).select(F.col(d).alias("value"), F.when(F.col("n") > 0, F.pow(F.col("n").cast("double"), F.lit(float(powers[d])))).otherwise(0.0).alias("share"))
        out[d] = written(own, f"mixing-{d}")
    return out


def raked(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """``cells(source, lang, topic, tokens)`` with weight: its raked share over its own.

    Target shares are taken over the values that have tokens and a positive target, and scaled to add up to one; a cell of
    any other value gets weight 0.
    """
    for d in DIMENSIONS:
        cells = cells.join(targets[d].select(F.col("value").alias(d), F.col("share").alias(f"t_{d}")), d, "left").fillna(0.0, [f"t_{d}"])
    cells = written(cells.withColumn("w", F.when((F.col("tokens") > 0) & (F.least(*[f"t_{d}" for d in DIMENSIONS]) > 0), F.col("tokens").cast("double")).otherwise(0.0)), "mixing-cells")
    sums = cells.agg(*[F.sum("w").alias("w")], F.sum("tokens").alias("tokens")).first()
    shares = {d: cells.where("w > 0").groupBy(d, f"t_{d}").agg(F.lit(1)).agg(F.sum(f"t_{d}")).first()[0] or 1.0 for d in DIMENSIONS}
    cells = cells.withColumn("w", F.col("w") / F.lit(sums.w or 1.0))
    for n in range(rounds):
        for d in DIMENSIONS:
            own = F.sum("w").over(Window.partitionBy(d))
            cells = cells.withColumn("w", F.when(own > 0, F.col("w") * F.col(f"t_{d}") / F.lit(shares[d]) / own).otherwise(0.0))
        if n % ROUNDS_A_TABLE == ROUNDS_A_TABLE - 1:
            cells = written(cells, "mixing-round")
    weight = F.when(F.col("tokens") > 0, F.col("w") * F.lit(float(sums.tokens or 1)) / F.col("tokens")).otherwise(0.0)
    return written(cells.select(*DIMENSIONS, "tokens", weight.alias("weight")), "mixing-weights")


def chance(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) from a keyed hash of the id."""
    hexed = F.substring(F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 8)
    return F.conv(hexed, 16, 10).cast("double") / F.lit(float(1 << 32))


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    powers: dict | None = None,
    targets: dict[str, DataFrame] | None = None,
    seed: int = 17,
    rounds: int = ROUNDS,
    carry: str | None = None,
) -> DataFrame:
    """Per row: id, source, lang, topic, n_tokens, weight, probability and kept (and the column ``carry``, as it is).

    targets: ``(value, share)`` per dimension; where none are given they follow from ``powers``. A null source or language
    counts as the empty one; a text without words has no tokens and is kept with its cell. A cell without any tokens has
    weight 0. Repeated ids share one draw.
    """
    label = lambda c: F.coalesce(F.col(c), F.lit("")).alias
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        label(source_col)("source"),
        label(lang_col)("lang"),
        topic_of(F.col(text_col)).alias("topic"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"),
        *([F.col(carry)] if carry else []),
    )
    rows = written(rows, "mixing-rows", "zstd")
    cells = written(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "mixing-counts")
    weights = raked(cells, targets or powered_targets(cells, powers or POWERS), rounds)
    top = weights.agg(F.max("weight")).first()[0] or 1.0
    out = rows.join(weights.drop("tokens"), list(DIMENSIONS), "left").withColumn("probability", F.round(F.least(F.lit(1.0), F.col("weight") / F.lit(top)), 6))
    return out.select(
        F.col("id").alias(id_col),
        *DIMENSIONS,
        "n_tokens",
        F.round("weight", 6).alias("weight"),
        "probability",
        (chance(F.col("id"), seed) < F.col("probability")).alias("kept"),
        *([carry] if carry else []),
    )


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` that the mix keeps, with its own columns."""
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(source_col).alias("_source"), F.col(lang_col).alias("_lang"))
    return mixed(whole, "_id", "_text", "_source", "_lang", carry="_row", **options).where("kept").select("_row.*")
