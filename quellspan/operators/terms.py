"""A dictionary of terms of up to eight words, found in texts with their places.

A text's words become candidates only where the dictionary has a term that begins so: the first words of all terms are a
bitmap of 65,536 bits, tested in the text's own row, so what is exploded and joined follows the hits, not the words. The terms
themselves meet in a join; they are only broadcast after they are counted. A term may be listed by its stems: then words
count that differ in their endings. Hits of one label that overlap or follow each other are merged to one.

Words are runs of letters and digits in lower case; terms are cut the same way, so signs between words don't matter. Terms of
no word or of more than ``MOST_WORDS`` aren't searched, a term listed twice is found once per label; null texts have no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quellspan.functions.spans import let, marked, measured, unmarked

WORD = r"[\p{L}\p{N}]+"
MOST_WORDS, BITS = 8, 65_536
#: Terms that may be broadcast, of eight words at most.
MOST_SENT = 200_000
#: Endings that a stem leaves off, the longest first; a stem keeps four letters.
ENDINGS = "ations|ation|ungen|ingly|ings|ness|ment|ción|tion|ung|ing|ies|ers|est|ed|es|er|en|em|ly|s|e|n"


def stem(word: Column) -> Column:
    return F.regexp_replace(word, rf"^(\p{{L}}{{4,}}?)(?:{ENDINGS})$", "$1")


def spans_of_words(text: Column) -> Column:
    """The words of a text as spans, in lower case."""
    return F.transform(measured(marked(text, "", WORD)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lower(x["value"]).alias("value")))


def listed(terms: DataFrame) -> DataFrame:
    """``(label, gram, words, first)`` of ``terms(label, term, stems)``; the words of a term by stems are marked with ``~``."""
    words = F.transform(F.regexp_extract_all("term", F.lit(WORD), F.lit(0)), F.lower)
    said = F.when(F.coalesce("stems", F.lit(False)), F.transform(words, lambda w: F.concat(F.lit("~"), stem(w)))).otherwise(words)
    out = terms.where(F.col("term").isNotNull() & F.col("label").isNotNull()).select("label", said.alias("w")).where(F.size("w").between(1, MOST_WORDS))
    return out.select("label", F.array_join("w", " ").alias("gram"), F.size("w").alias("words"), F.get("w", F.lit(0)).alias("first")).distinct()


def _bit(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BITS)).cast("int")


def begins(bits: Column, word: Column) -> Column:
    """Whether a term may begin with this word, told from the bitmap of :func:`first_words`."""
    return let(_bit(word), lambda h: F.bit_get(F.get(bits, F.floor(h / 64).cast("int")), F.pmod(h, F.lit(64))) == 1)


def first_words(index: DataFrame) -> Column:
    """The bitmap of the terms' first words, 1,024 numbers of 64 bits."""
    at = index.select(_bit(F.col("first")).alias("h")).distinct()
    rows = at.groupBy(F.floor(F.col("h") / 64).cast("int").alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, h % 64)")).alias("bits")).collect()
    slots = {r["slot"]: r["bits"] for r in rows}  # 1,024 rows at most
    return F.expr(f"array({', '.join(f'{slots.get(i, 0)}L' if slots.get(i, 0) != -(1 << 63) else '(-9223372036854775807L - 1)' for i in range(BITS // 64))})")


def hits(df: DataFrame, key: str, text_col: str, terms: DataFrame) -> DataFrame:
    """``(key, label, start, end)`` of every term that stands in a text."""
    index = listed(terms)
    size = index.agg(F.count(F.lit(1)).alias("n"), F.max("words").alias("longest"), *[F.coalesce(F.bool_or(F.col("first").startswith("~") == by), F.lit(False)).alias(k) for k, by in (("plain", False), ("stems", True))]).first()
    longest = size["longest"] or 0

    def grams(words, said, bits):
        def run(i, n):
            whole = F.concat_ws(" ", *[F.get(said, i + k) for k in range(n)])  # by places: a slice would copy the text's words
            return F.struct(F.when(i + n <= F.size(said), whole).alias("gram"), F.get(words, i)["start"].alias("start"), F.get(words, i + n - 1)["end"].alias("end"))

        def at(w, i):
            return F.when(begins(bits, w), F.array(*[run(i, n) for n in range(1, max(longest, 1) + 1)]))

        return F.flatten(F.filter(F.transform(said, at), lambda x: x.isNotNull()))

    rows = df.select(F.col(key).alias("_key"), spans_of_words(unmarked(F.col(text_col))).alias("_words"))
    rows = rows.withColumn("_bits", first_words(index)).withColumn("_said", F.transform("_words", lambda w: w["value"]))
    # words are cut to stems, which costs more than all else, only where a term asks for it
    asked = [grams(F.col("_words"), F.col("_said"), F.col("_bits"))] if size["plain"] or not size["stems"] else []
    if size["stems"]:
        asked.append(let(F.transform("_said", lambda w: F.concat(F.lit("~"), stem(w))), lambda stems: grams(F.col("_words"), stems, F.col("_bits"))))
    found = rows.withColumn("_grams", F.filter(F.concat(*asked), lambda g: g["gram"].isNotNull())).select("_key", F.explode_outer("_grams").alias("g"))
    found = found.where("g IS NOT NULL").select("_key", "g.*")  # a filter before the explosion would cut the words anew for every gram
    met = found.join(F.broadcast(index.drop("words", "first")) if size["n"] <= MOST_SENT else index.drop("words", "first"), "gram")
    return met.select(F.col("_key").alias(key), "label", "start", "end").distinct()


def merged(found: DataFrame, key: str, gap: int = 1) -> DataFrame:
    """Hits of one label in a text that overlap, or have at most ``gap`` characters between them, as one."""
    own = Window.partitionBy(key, "label").orderBy("start", "end")
    before = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("_new", F.coalesce((F.col("start") > before + gap).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(own))
    return runs.groupBy(key, "label", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("hits")).drop("_run")
