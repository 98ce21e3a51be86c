"""Records inside texts: lines, key-value pairs, pipe tables, JSON leaves, HTML text; labels on the line before a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quellspan.functions.spans import let, mapped, scanned, starts, unmarked
from quellspan.operators.grids import TYPES, column_kind, fits

#: The entities that texts of web pages use most.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def line_rows(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """``(key, number, line)``; numbers start at 0."""
    return df.select(key, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("number", "line"))


def next_line_values(df: DataFrame, key: str, text_col: str, label: str) -> DataFrame:
    """``(key, number, value)``: a line that ends in a label, and the next line that isn't blank."""
    rows = line_rows(df, key, text_col).where(F.trim("line") != "")
    after = F.lead("line").over(Window.partitionBy(key).orderBy("number"))
    return rows.withColumn("value", F.trim(after)).where(F.col("line").rlike(label) & F.col("value").isNotNull()).select(key, "number", "value")


def labelled_lines(df: DataFrame, *keep: str, text_col: str = "text", back: int = 40) -> DataFrame:
    """Values on a line of their own under a label: the columns ``keep``, start, end, rule, type, value.

    A label is a line that names a personal column and ends in a colon or an equals sign; its value is the first line with
    anything on it among the ``back`` lines below, if it holds what the label names. Lines stay in their text's row: the last
    label above each line is a running maximum of line numbers.
    """
    lines = F.split(unmarked(F.col(text_col)), "\n")

    def found(own):
        name = lambda x: F.regexp_extract(x, r"^\s*(\S.{0,62}?)\s*[:=]\s*$", 1)
        kinds = F.transform(own, lambda x: F.when(name(x) != "", column_kind(name(x))))
        begin = starts(F.transform(own, lambda x: F.length(x) + 1))
        filled = F.transform(own, lambda x, i: F.when(F.trim(F.translate(x, "\r\t", "  ")) != "", i).otherwise(-1))
        last = scanned(filled, F.lit(-1), lambda a, x: F.greatest(a, x))

        def told(s):
            def value(x, i):
                lead = F.length(F.regexp_extract(x, r"^\s*", 0))
                said = F.regexp_replace(x, r"^\s+|\s+$", "")
                above = F.get(s["last"], i).cast("int")
                kind = F.when((above >= 0) & (i - above <= back), F.get(s["kinds"], above))
                start = F.get(s["begin"], i) + lead
                row = F.struct(start.alias("start"), (start + F.length(said)).alias("end"), F.lit("label-line-above").alias("rule"), F.coalesce(F.try_element_at(mapped(TYPES), kind), kind).alias("type"), said.alias("value"))
                return F.when((said != "") & kind.isNotNull() & fits(kind, said), row)

            return F.filter(F.transform(own, value), lambda x: x.isNotNull())

        return let(F.struct(kinds.alias("kinds"), begin.alias("begin"), last.alias("last")), told)

    out = df.select(*keep, lines.alias("_lines")).withColumn("_found", let(F.col("_lines"), found))
    return out.select(*keep, F.explode_outer("_found").alias("x")).where("x IS NOT NULL").select(*keep, "x.*")


def pipe_cells(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """``(key, number, position, cell)`` of the lines that are rows of a pipe table."""
    rows = line_rows(df, key, text_col).where(F.col("line").contains(" | "))
    return rows.select(key, "number", F.posexplode(F.transform(F.split("line", r" \| "), lambda cell: F.trim(cell))).alias("position", "cell"))


def key_value_pairs(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """``(key, number, name, value)`` of lines like ``name: value`` or ``name = value``."""
    pattern = r"^\s*([A-Za-z][A-Za-z0-9_ -]{0,40}?)\s*[:=]\s*(\S[^\n]*)$"
    rows = line_rows(df, key, text_col).where(F.col("line").rlike(pattern))
    return rows.select(key, "number", F.lower(F.regexp_extract("line", pattern, 1)).alias("name"), F.regexp_extract("line", pattern, 2).alias("value"))


def json_leaves(df: DataFrame, key: str, json_col: str) -> DataFrame:
    """``(key, name, value)`` of the top fields of JSON objects; texts that are none give nothing."""
    return df.select(key, F.explode(F.from_json(json_col, "map<string,string>")).alias("name", "value"))


def html_text(html: Column) -> Column:
    """The text of a page: no scripts, styles, comments and tags; entities decoded, white space folded."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    for old, new in ENTITIES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def sql_html_text(html: str) -> str:
    out = f"regexp_replace({html}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    for old, new in ENTITIES:
        out = f"replace({out}, '{old}', '{new.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({out}, '[ \\t\\r\\n]+', ' ', 'g'))"


def without_hidden(text: Column) -> Column:
    """The text without terminal escapes and invisible characters, full-width forms folded."""
    out = F.regexp_replace(text, "\x1b\\[[0-9;]*[A-Za-z]", "")
    out = F.regexp_replace(out, "[​-‏⁠-⁤﻿­]", "")
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    return F.translate(out, wide, "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)))


def decoded_runs(text: Column) -> Column:
    """The readable texts behind base64 runs of 24 characters or more."""
    runs = F.regexp_extract_all(text, F.lit("[A-Za-z0-9+/]{24,}={0,2}"), F.lit(0))
    decoded = F.transform(runs, lambda r: F.try_to_binary(r, F.lit("base64")).cast("string"))
    return F.filter(decoded, lambda d: d.isNotNull() & F.is_valid_utf8(d) & d.rlike(r"^[\x20-\x7e\s]{8,}$"))
