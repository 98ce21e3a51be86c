"""Cleaned copies of texts: without what a terminal or a renderer hides, and with a map back to the original.

A value may be split or disguised by terminal escapes, invisible characters, entities, full-width letters, or a label by
Markdown's stars. :func:`cleaned` removes these and keeps runs beside the text: which stretch of the copy stands for which
stretch of the original. A finding of the copy is told at its place in the original, with whatever was hidden inside it.
The copy's findings are merged with the text's own: a whole span takes the place of the parts of it that were found.

Null texts are empty; texts that nothing is hidden in are not scanned twice.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quellspan.functions.spans import CLOSE, OPEN, let, mapped, scanned, unmarked
from quellspan.operators import detect
from quellspan.operators.rules import CATALOG
from quellspan.session import written

RUNS = "array<struct<at:bigint,source:bigint,size:bigint,width:bigint>>"
#: The escape character, as it is or as an entity.
ESC = r"(?:\x1b|&#0?27;|&#[xX]1[bB];)"
#: Fixed values of ECMA-48: control sequences, operating system commands, and escapes of one character.
ESCAPES = rf"{ESC}\[[0-?]*[ -/]*[@-~]|{ESC}\][^\x07\x1b]*(?:\x07|\x1b\\)|{ESC}[@-Z\\^_]"
#: Characters that take no room: soft hyphen, zero width, directions, joiners, byte order mark.
INVISIBLE = "­​-‏‪-‮⁠-⁤⁦-⁩﻿"
ENTITY = "&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
HIDDEN = f"{ESCAPES}|[{INVISIBLE}]+|{ENTITY}"
#: Stars or lines around a label: before it, and behind it where a colon or an equals sign stands at the label's end.
STARS = (
    r"(?<![*\w])\*\*(?=\p{L}[^*\n:]{0,48}(?::\*\*[ \t]|\*\*[ \t]{0,3}[:=]))|(?<=\*\*\p{L}[^*\n:]{0,48}:)\*\*(?=[ \t])|(?<=\*\*\p{L}[^*\n:]{0,48})\*\*(?=[ \t]{0,3}[:=])"
    r"|(?<![_\w])__(?=\p{Lu}[^_*\n:]{0,48}(?::__[ \t]|__[ \t]{0,3}:[ \t]))|(?<=__\p{Lu}[^_*\n:]{0,48}:)__(?=[ \t])|(?<=__\p{Lu}[^_*\n:]{0,48})__(?=[ \t]{0,3}:[ \t])"
)
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
#: The same two patterns, asked only where a match can begin: looking back from every character costs many times the rest.
HIDDEN_HERE, STARS_HERE = rf"(?=[\x1b&{INVISIBLE}])(?:{HIDDEN})", rf"(?=\*\*|__)(?:{STARS})"


def _named() -> Column:
    """The named entities of HTML 4, as the language's own table has them."""
    return mapped({name: chr(code) for name, code in name2codepoint.items()})


def entity(piece: Column) -> Column:
    """The character of an entity; one that has none stays as it is."""
    digits = F.regexp_extract(piece, "^&#([0-9]+);$", 1)
    hexes = F.regexp_extract(piece, "^&#[xX]([0-9A-Fa-f]+);$", 1)
    code = F.when(digits != "", F.try_to_number(digits, F.lit("9999999")).cast("int")).when(hexes != "", F.conv(hexes, 16, 10).cast("int"))
    valid = code.between(1, 0xD7FF) | code.between(0xE002, 0x10FFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    of_map = F.try_element_at(_named(), F.regexp_extract(piece, "^&([A-Za-z][A-Za-z0-9]*);$", 1))
    return F.coalesce(F.when(valid, char), of_map, piece)


def unhidden(piece: Column) -> Column:
    """What stands in the copy for a hidden piece: nothing, or an entity's character if that is shown."""
    char = entity(piece)
    return F.when(piece.rlike(f"^{ENTITY}$") & ~char.rlike(f"^(?:[{INVISIBLE}]|\\x1b)$"), char).otherwise(F.lit(""))


def unstarred(piece: Column, before: Column) -> Column:
    """Opening stars inside a line become a space, so that a value before them ends there."""
    return F.when(F.coalesce(before, F.lit("")).rlike(r"[^\n*_:]\z") & before.rlike(r"\s\z"), F.lit(" ")).otherwise(F.lit(""))


def rewritten(text: Column, pattern: str, put) -> Column:
    """``struct<text, runs>``: each match of the pattern replaced by ``put(match, what stands before it)``.

    A run says that ``size`` characters from ``at`` on in the new text stand for ``width`` from ``source`` on in the old.
    """
    pieces = F.split(F.regexp_replace(text, f"({pattern})", f"{OPEN}$1{CLOSE}"), f"[{OPEN}{CLOSE}]")

    def both(p):
        put_in = F.transform(p, lambda x, i: F.when(i % 2 == 1, put(x, F.get(p, i - 1))).otherwise(x))

        def placed(new):
            begin = lambda v: scanned(F.transform(v, F.length), F.lit(0), lambda a, x: a + x)
            run = lambda at, source: F.transform(p, lambda x, i: F.struct(F.get(at, i).alias("at"), F.get(source, i).alias("source"), F.length(F.get(new, i)).cast("bigint").alias("size"), F.length(x).cast("bigint").alias("width")))
            runs = let(begin(new), lambda at: let(begin(p), lambda source: F.filter(run(at, source), lambda r: r["size"] > 0)))
            return F.struct(F.array_join(new, "").alias("text"), runs.alias("runs"))

        return let(put_in, placed)

    plain = F.struct(text.alias("text"), F.array(F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("source"), F.length(text).cast("bigint").alias("size"), F.length(text).cast("bigint").alias("width"))).alias("runs"))
    return F.when(text.rlike(pattern), let(pieces, both)).otherwise(plain)


def original(runs: Column, start: Column, end: Column) -> Column:
    """``struct<start, end>`` in the old text of a span of the new one."""
    of = lambda at: F.element_at(F.filter(runs, lambda r: r["at"] <= at), -1)
    same = lambda r: r["size"] == r["width"]
    first = lambda r: F.when(same(r), r["source"] + start - r["at"]).otherwise(r["source"])
    last = lambda r: F.when(same(r), r["source"] + end - r["at"]).otherwise(r["source"] + r["width"])
    return F.struct(let(of(start), first).alias("start"), let(of(end - 1), last).alias("end"))


def cleaned(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``clean``, the copy, and ``inner`` and ``outer``, the runs of its two steps, for :func:`back`."""
    out = df.withColumn("_shown", rewritten(unmarked(F.col(text_col)), HIDDEN_HERE, lambda piece, _: unhidden(piece)))
    out = out.withColumn("_bare", rewritten(F.translate(F.col("_shown.text"), WIDE, NARROW), STARS_HERE, unstarred))
    return out.withColumns({"clean": F.col("_bare.text"), "inner": F.col("_shown.runs"), "outer": F.col("_bare.runs")}).drop("_shown", "_bare")


def back(inner: Column, outer: Column, start: Column, end: Column) -> Column:
    """The span of the original text under a span of its copy."""
    return let(original(outer, start, end), lambda x: original(inner, x["start"], x["end"]))


def changed(text: Column) -> Column:
    """Whether a copy may differ from the text."""
    return F.coalesce(text.rlike(f"{HIDDEN_HERE}|[{WIDE[0]}-{WIDE[-1]}]|{STARS_HERE}"), F.lit(False))


def copy_findings(df: DataFrame, *keep: str, text_col: str = "text", rules=CATALOG) -> DataFrame:
    """Findings of the copies of texts, at their places in the original; ``value``: what the original holds there."""
    rows = cleaned(df.select(*keep, F.col(text_col).alias("_text")).where(changed(F.col("_text"))), "_text")
    found = detect.with_findings(rows, "clean", rules).select(*keep, "_text", "inner", "outer", F.explode_outer("findings").alias("x")).where("x IS NOT NULL")
    found = found.withColumn("y", back(F.col("inner"), F.col("outer"), F.col("x.start"), F.col("x.end")))
    value = F.substring(F.col("_text"), (F.col("y.start") + 1).cast("int"), (F.col("y.end") - F.col("y.start")).cast("int"))
    return found.select(*keep, "y.start", "y.end", "x.rule", "x.type", value.alias("value"))


def merged(found: DataFrame, copies: DataFrame, *key: str) -> DataFrame:
    """Findings of texts and of their copies without overlaps.

    A copy's finding is taken if all findings that it overlaps lie inside it and it isn't one of them; they give way to it.
    """
    f, c = found.alias("f"), copies.alias("c")
    same = [F.col(f"f.{k}") == F.col(f"c.{k}") for k in key]
    meet = [*same, F.col("f.start") < F.col("c.end"), F.col("c.start") < F.col("f.end")]
    out_of = (F.col("f.start") < F.col("c.start")) | (F.col("f.end") > F.col("c.end")) | ((F.col("f.start") == F.col("c.start")) & (F.col("f.end") == F.col("c.end")))
    taken = written(c.join(f, [*meet, out_of], "left_anti"), "copies-taken")
    return f.join(taken.alias("c"), meet, "left_anti").unionByName(taken)


def findings(df: DataFrame, *key: str, text_col: str = "text", rules=CATALOG) -> DataFrame:
    """Findings of texts and of what is hidden in them: the key, start, end, rule, type and value."""
    found = written(detect.findings(df, *key, text_col=text_col, rules=rules), "copies-found")
    return merged(found, copy_findings(df, *key, text_col=text_col, rules=rules), *key)
