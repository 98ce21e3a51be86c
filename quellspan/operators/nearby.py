"""Findings that others within reach decide: the numbers of a company's address are no personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellspan.functions.spans import between, blocks, let, measured, marked, unmarked
from quellspan.operators import detect
from quellspan.operators.rules import CATALOG, Rule
from quellspan.session import written

#: A German postcode and the place behind it; only for texts whose region is known, so it is in no catalog.
POSTCODE = Rule("de-postcode", "DE_PLZ", r"(?:0[1-9]|[1-9][0-9])[0-9]{3} \p{Lu}[\pL-]{1,40}", before=r"(?:^|[\s,;])(?:D-)?", band="regional", region="de")
#: Legal forms of companies that are persons of their own (a sole trader's is none).
FORMS = r"(?:GmbH(?: & Co\. KG)?|AG|SE|KG|OHG|UG|Ltd\.?|Inc\.?|LLC|PLC)"
_GAP = r"[ \t]{0,3}(?:,|\r?\n)[ \t]{0,3}"
_STREET = r"\p{Lu}[\pL.-]{1,40}(?: \pL[\pL.-]{0,30}){0,3} [0-9]{1,4}[a-z]?"
_PLACE = r"(?:D-)?[0-9]{5} \p{Lu}[\pL-]{1,40}"
_TAX = rf"(?:{_GAP}(?:USt-?Id(?:-?Nr)?|VAT(?: ID| No)?|Umsatzsteuer-ID)\.?[:=]? ?)?"
COMPANY = r"\p{Lu}[\pL0-9&.-]{0,40} "
ADDRESS = rf"{FORMS}{_GAP}{_STREET}{_GAP}{_PLACE}{_TAX}"
#: In front of a company they make its address that of someone who works there.
EMPLOYED = "(?i)employ|arbeitgeber|works? (?:at|for)|angestellt|beschäftigt"
REACH, PARAGRAPH, EMPLOYED_BEFORE = 800, 160, 60
NUMBERS = ("DE_PLZ", "DE_VAT_ID")


def within(left: DataFrame, right: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Pairs of a left row and a right row of the same keys that begins at most ``reach`` before it or at its place.

    Both have the keys and ``start``; columns of the right take the prefix ``other_``. A range join over stretches of
    ``reach``: right rows are filed under their own stretch and the next, so a text with many rows is many small groups.
    Null keys or starts meet nothing.
    """
    right = right.select(*keys, *[F.col(c).alias(f"other_{c}") for c in right.columns if c not in keys])
    right = right.withColumn("_stretch", F.explode(F.transform(F.array(F.lit(0), F.lit(1)), lambda i: F.floor(F.col("other_start") / reach) + i)))
    left = left.withColumn("_stretch", F.floor(F.col("start") / reach))
    return left.join(right, [*keys, "_stretch"]).where(F.col("other_start").between(F.col("start") - reach, F.col("start"))).drop("_stretch")


def _companies(text, cut):
    """Addresses behind a legal form: start (of the form), end (behind the label of a tax number, if one follows), and from
    where in front of it a person's name counts."""

    def one(x):
        head = between(cut, F.greatest(x["start"] - PARAGRAPH, F.lit(0)), x["start"])
        broken = F.position(F.lit("\n\n"), F.reverse(head))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), (x["start"] - F.when(broken > 0, broken - 1).otherwise(F.length(head))).alias("since"))

    free = lambda x: ~F.rlike(between(cut, F.greatest(x["start"] - EMPLOYED_BEFORE, F.lit(0)), x["start"]), F.lit(EMPLOYED))
    return F.transform(F.filter(measured(marked(text, COMPANY, ADDRESS)), free), one)


def released(df: DataFrame, key: str, text_col: str = "text", rules=(*CATALOG, POSTCODE)) -> DataFrame:
    """``(key, start, end, rule, type, value, released)``: findings, and whether a company's address releases them.

    A postcode inside the address and a VAT number right behind it are the company's, unless a person's name stands in the
    paragraph, up to 160 characters before the legal form, or between it and the number; a name that ends right before the
    form is the company's own. ``key`` must be unique. Each text is scanned once; the rest are joins over short stretches.
    """
    text = F.col("_text")
    found = detect.with_findings(df.select(key, text_col).withColumn("_text", unmarked(F.col(text_col))), text_col, rules, "_found")
    firms = let(F.when(text.rlike(FORMS), blocks(text)).otherwise(F.array().cast("array<string>")), lambda cut: F.when(F.size(cut) > 0, _companies(text, cut)))
    kind = "array<struct<start:bigint,end:bigint,rule:string,type:string,value:string,since:bigint>>"
    hits = F.transform("_found", lambda x: F.struct(x["start"], x["end"], x["rule"], x["type"], x["value"], F.lit(None).cast("bigint"))).cast(kind)
    blank = F.lit(None).cast("string")
    anchors = F.transform(firms, lambda x: F.struct(x["start"], x["end"], blank, F.lit("company"), blank, x["since"])).cast(kind)
    marks = found.select(key, F.explode_outer(F.concat(hits, F.coalesce(anchors, F.array().cast(kind)))).alias("x")).where("x IS NOT NULL").select(key, "x.*")
    marks = written(marks, "marks", keep=True)
    numbers = marks.where(F.col("type").isin(*NUMBERS))
    firm = marks.where("type = 'company'").select(key, "start", "end", "since")
    names = marks.where("type = 'NAME'").select(key, "start", "end")
    inside = F.when(F.col("type") == "DE_PLZ", F.col("end") <= F.col("other_end")).otherwise(F.col("start") == F.col("other_end"))
    held = within(numbers, firm, [key], REACH).where(inside).groupBy(key, "start", "end").agg(F.max("other_start").alias("form"), F.max("other_since").alias("since"))
    person = (F.col("other_start") >= F.col("since")) & (F.col("other_end") < F.col("form") - 1)
    person = person | (F.col("other_start") >= F.col("form"))
    kept = within(held, names, [key], REACH + PARAGRAPH).where(person).select(key, "start", "end").distinct()
    free = held.select(key, "start", "end").join(kept, [key, "start", "end"], "left_anti").withColumn("released", F.lit(True))
    return marks.where("type <> 'company'").drop("since").join(free, [key, "start", "end"], "left").withColumn("released", F.coalesce("released", F.lit(False)))
