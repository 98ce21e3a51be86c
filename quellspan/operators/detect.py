"""Rules to columns: candidates of each text, checks, context words, overlaps resolved by priority."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quellspan.functions.spans import between, blocks, marked, measured, resolve, unmarked
from quellspan.operators.rules import CATALOG, RUN, Rule, priority

FINDING = "array<struct<priority:int,start:bigint,end:bigint,rule:string,type:string,value:string>>"
BEFORE, AFTER = 80, 40


def gate(rule: Rule, text: Column, low: Column | None = None) -> Column:
    """Whether the text can hold the rule's value: one of its keywords occurs. ``low``: the text in lower case."""
    low = F.lower(text) if low is None else low
    held = F.lit(not (rule.keywords or rule.folded))
    for k in rule.keywords:
        held = held | text.contains(k)
    for k in rule.folded:
        held = held | low.contains(k)
    return held


def hints(text: Column) -> Column:
    """What most rules ask of a text, told once for all of them: whether it has a digit, and a run without white space."""
    return F.struct(text.rlike("[0-9]").alias("digit"), F.concat(F.lit(" "), text).rlike(rf"\s\S{{{RUN}}}").alias("long"))


def opened(rule: Rule, text: Column, low: Column | None = None, has: Column | None = None) -> Column | None:
    """The text's hints ``has``, the gate and the rule's gist; null where the rule asks nothing before its own pattern."""
    asks = [has[k] for k in ("digit", "long") if has is not None and getattr(rule, k)]
    asks += ([gate(rule, text, low)] if rule.keywords or rule.folded else []) + ([text.rlike(rule.gist)] if rule.gist else [])
    return reduce(and_, asks) if asks else None


def window(cut: Column, start: Column, end: Column) -> Column:
    """What stands around a span of a text in blocks, lower case, without the value."""
    return F.lower(F.concat(between(cut, F.greatest(start - BEFORE, F.lit(0)), start), F.lit(" "), between(cut, end, end + AFTER)))


def _text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def cut_by(rule: Rule, order: int, text: Column, low: Column | None = None, has: Column | None = None) -> Column:
    """What the rule asks of a span, as data, and the text cut at the rule's values."""
    near = f"(?:^|[^a-z])(?:{'|'.join(rule.near)})(?:[^a-z]|$)" if rule.near else ""
    ask = F.expr(f"named_struct('priority', {order}, 'rule', {_text(rule.id)}, 'type', {_text(rule.type)}, 'after', {_text(rule.after)}, 'near', {_text(near)})")
    pieces, open_ = marked(text, rule.before, rule.value), opened(rule, text, low, has)
    return F.struct(ask.alias("ask"), (pieces if open_ is None else F.when(open_, pieces).otherwise(F.array().cast("array<string>"))).alias("pieces"))


def with_candidates(df: DataFrame, text_col: str = "text", rules=CATALOG, into: str = "candidates") -> DataFrame:
    """Adds every rule's spans as one array, overlaps included. One pass over the text, no shuffle.

    Rules differ in patterns only; measuring spans, the character behind, context words and checks are written once for all.
    """
    order, text = priority(rules), F.col("_clean")
    out = df.withColumn("_clean", unmarked(F.col(text_col)))
    out = out.withColumn("_low", F.lower(text)).withColumn("_has", hints(text))
    out = out.withColumn("_cut", F.filter(F.array(*[cut_by(r, order[r.id], text, F.col("_low"), F.col("_has")) for r in rules]), lambda r: F.size(r["pieces"]) > 1))
    out = out.withColumn("_blocks", F.when(F.size("_cut") > 0, blocks(text)))
    cut = F.col("_blocks")
    asked = {c: [r.id for r in rules if c in r.checks] for c in dict.fromkeys(c for r in rules for c in r.checks)}

    def spans_of(r):
        def candidate(x):
            return F.struct(*[r["ask"][k].alias(k) if k in ("priority", "rule", "type") else x[k].alias(k) for k in ("priority", "start", "end", "rule", "type", "value")])

        def fits(x):
            ok = (r["ask"]["after"] == "") | ~F.rlike(between(cut, x["end"], x["end"] + 1), r["ask"]["after"])
            return ok & ((r["ask"]["near"] == "") | F.rlike(window(cut, x["start"], x["end"]), r["ask"]["near"]))

        return F.transform(F.filter(measured(r["pieces"]), fits), candidate)

    found = F.flatten(F.transform("_cut", spans_of))
    if asked:
        found = F.filter(found, lambda x: reduce(and_, [~x["rule"].isin(ids) | check.column(x["value"]) for check, ids in asked.items()]))
    return out.withColumn(into, found).drop("_clean", "_low", "_has", "_cut", "_blocks")


def with_findings(df: DataFrame, text_col: str = "text", rules=CATALOG, into: str = "findings") -> DataFrame:
    """Adds the findings of each text: no two overlap, and the rule of the earlier band owns a span."""
    return with_candidates(df, text_col, rules, into).withColumn(into, F.sort_array(F.transform(resolve(F.col(into), FINDING), _by_start)))


def _by_start(x: Column) -> Column:
    return F.struct(*[x[k].alias(k) for k in ("start", "end", "rule", "type", "value")])


def findings(df: DataFrame, *keep: str, text_col: str = "text", rules=CATALOG) -> DataFrame:
    """One row per finding: the columns ``keep``, start, end, rule, type, value.

    Exploded as outer and filtered behind: a filter on the array's size before it would evaluate every pattern twice.
    """
    return with_findings(df, text_col, rules).select(*keep, F.explode_outer("findings").alias("x")).where("x IS NOT NULL").select(*keep, "x.*")


def candidate_rows(df: DataFrame, *keep: str, text_col: str = "text", rules=CATALOG) -> DataFrame:
    return with_candidates(df, text_col, rules).select(*keep, F.explode_outer("candidates").alias("x")).where("x IS NOT NULL").select(*keep, "x.*")


def without_values(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """Findings whose value is on no allow list: ``allowed(digest)`` holds sha256 digests."""
    return rows.withColumn("_digest", F.sha2("value", 256)).join(allowed.select(F.col("digest").alias("_digest")), "_digest", "left_anti").drop("_digest")
