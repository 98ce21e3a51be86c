"""Judgements of values by words and characters: how much of a value is words, how random its characters are.

A value is folded first: lower case, and what is written for letters (4 for a, 0 for o, $ for s) read as these. Its word cover
is the most letters that words beside each other can account for, found by dynamic programming over the value's places; words
come from a table of any size, so pieces of values meet words in a join, and only what matched returns to a value's row. How
random a value reads is its characters' mean surprise under a model of neighbouring letters, counted on a table of words.

Null values have no row; values of no letters have a cover of 0 and no surprise; a value given twice has one row. Values
longer than ``LONGEST`` characters are judged by their first ones: none that a person chose is longer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quellspan.functions.checks import SEQUENCES
from quellspan.session import written

LONGEST, SHORTEST_WORD, LONGEST_WORD = 128, 3, 16
#: What is written for letters.
PAIRS = (("4", "a"), ("@", "a"), ("3", "e"), ("1", "i"), ("!", "i"), ("|", "i"), ("0", "o"), ("5", "s"), ("$", "s"), ("7", "t"), ("+", "t"))


def folded(value: Column) -> Column:
    """The value in lower case with letters in place of what is written for them; only inside or beside letters."""
    low = F.lower(F.substring(value, 1, LONGEST))
    read = F.translate(low, "".join(a for a, _ in PAIRS), "".join(b for _, b in PAIRS))
    return F.when(low.rlike(r"\p{L}"), read).otherwise(low)


def sequence_share(value: Column) -> Column:
    """The share of a value that runs along an alphabet or a row of keys, in runs of four."""
    size = F.length(value)
    return F.round((size - F.length(F.regexp_replace(value, SEQUENCES, ""))) / F.greatest(size, F.lit(1)), 6)


def covers(values: DataFrame, words: DataFrame) -> DataFrame:
    """``(value, letters, covered)`` of ``values(value)``: letters of the folded value, and how many of them the words of
    ``words(word)`` account for at most, none used twice."""
    own = values.where("value IS NOT NULL").select("value").distinct().withColumn("read", folded(F.col("value")))
    size = F.length("read")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.transform(F.sequence(F.lit(SHORTEST_WORD), F.lit(LONGEST_WORD)), lambda n: F.struct(i.alias("at"), n.alias("n")))))
    fit = F.filter(spans, lambda s: s["at"] + s["n"] - 1 <= size)
    pieces = own.select("value", "read", F.explode_outer(fit).alias("s")).select("value", "read", F.col("s.at").alias("at"), F.substring("read", F.col("s.at"), F.col("s.n")).alias("word"))
    known = words.select(F.lower("word").alias("word")).where(F.length("word").between(SHORTEST_WORD, LONGEST_WORD) & F.col("word").rlike(r"^\p{L}+$")).distinct().withColumn("known", F.lit(True))
    met = pieces.join(known, "word", "left").groupBy("value", "read").agg(F.collect_list(F.when(F.col("known"), F.struct((F.col("at") + F.length("word") - 1).alias("end"), F.length("word").alias("n")))).alias("found"))

    # best[i]: what the first i characters can have covered
    def step(best, i):
        ends = F.transform(F.filter("found", lambda f: f["end"] == i), lambda f: F.get(best, i - f["n"]) + f["n"])
        return F.concat(best, F.array(F.greatest(F.element_at(best, -1), F.coalesce(F.array_max(ends), F.lit(0)))))

    best = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length("read"), F.lit(1))), F.array(F.lit(0)), step, lambda b: F.element_at(b, -1))
    letters = F.length(F.regexp_replace("read", r"[^\p{L}]", ""))
    return met.select("value", letters.cast("long").alias("letters"), best.cast("long").alias("covered"))


def letter_pairs(words: DataFrame) -> DataFrame:
    """``(a, b, surprise)``: bits of a letter after another one, of a-z and ``.`` for all else; a pair not seen counts half a time."""
    low = F.regexp_replace(F.lower("word"), "[^a-z]", ".")
    pair = F.transform(F.sequence(F.lit(1), F.length(low) - 1), lambda i: F.substring(low, i, F.lit(2)))
    seen = words.where(F.length("word") > 1).select(F.explode(pair).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    letters = [chr(c) for c in range(97, 123)] + ["."]
    every = words.sparkSession.createDataFrame([(a, b) for a in letters for b in letters], "a string, b string")
    counted = every.join(seen, F.concat("a", "b") == F.col("pair"), "left").select("a", "b", (F.coalesce("n", F.lit(0)) + 0.5).alias("n"))
    rows = counted.groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("of"))
    return counted.join(rows, F.col("a") == F.col("c")).select("a", "b", F.round(-F.log2(F.col("n") / F.col("of")), 6).alias("surprise"))


def surprises(values: DataFrame, words: DataFrame) -> DataFrame:
    """``(value, surprise)``: the mean bits of a value's letter pairs under :func:`letter_pairs`; null for one character."""
    own = values.where("value IS NOT NULL").select("value").distinct()
    low = F.regexp_replace(F.lower(F.substring("value", 1, LONGEST)), "[^a-z]", ".")
    pairs = F.when(F.length("value") > 1, F.transform(F.sequence(F.lit(1), F.length(low) - 1), lambda i: F.substring(low, i, F.lit(2))))
    met = own.select("value", F.explode_outer(pairs).alias("pair")).join(letter_pairs(words), F.col("pair") == F.concat("a", "b"), "left")
    return met.groupBy("value").agg(F.round(F.avg("surprise"), 4).alias("surprise"))


def judged(values: DataFrame, words: DataFrame, most_words: float = 0.7, least_surprise: float = 5.0) -> DataFrame:
    """``(value, letters, covered, surprise, sequences, verdict)``: ``sequence`` where half of it or more runs along keys,
    ``words`` where words cover most of its letters and it has no digits that letters don't explain, ``random`` where its
    letters surprise or it mixes cases and digits, else ``unclear``."""
    own = written(values.where("value IS NOT NULL").select("value").distinct(), "judged-values")
    out = covers(own, words).join(surprises(own, words), "value").withColumn("sequences", sequence_share(F.col("value")))
    mixes = F.col("value").rlike("[0-9]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]")
    verdict = (
        F.when(F.col("sequences") >= 0.5, "sequence")
        .when((F.col("letters") > 0) & (F.col("covered") >= most_words * F.col("letters")) & ~F.col("value").rlike("[0-9]{3}"), "words")
        .when((F.col("surprise") >= least_surprise) | mixes, "random")
        .otherwise("unclear")
    )
    return out.select("value", "letters", "covered", "surprise", "sequences", verdict.alias("verdict"))
