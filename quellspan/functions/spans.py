"""Spans of pattern matches as columns: offsets in code points, end exclusive, no Python on the way."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE = "\ue000", "\ue001"
SPAN = "array<struct<start:bigint,end:bigint,value:string>>"


def unmarked(text: Column) -> Column:
    """The text with the two marks of :func:`spans` replaced, its length unchanged; null is empty."""
    text = F.coalesce(text, F.lit(""))
    clean = F.translate(text, OPEN + CLOSE, "\ufffd\ufffd")
    return F.when(text.contains(OPEN) | text.contains(CLOSE), clean).otherwise(text)


def marked(text: Column, before: str, value: str) -> Column:
    """The text cut at the marks around each value: every second piece is one. Empty where nothing matches.

    A match is ``before`` followed by ``value``; both must have no capturing groups.
    """
    pieces = F.split(F.regexp_replace(text, f"({before})({value})", f"$1{OPEN}$2{CLOSE}"), f"[{OPEN}{CLOSE}]")
    return F.when(text.rlike(f"(?:{before})(?:{value})"), pieces).otherwise(F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """``body(value)``, the value computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mapped(pairs: dict[str, str]) -> Column:
    """A map of texts as one literal."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr(f"map({', '.join(quoted(x) for pair in sorted(pairs.items()) for x in pair)})")


def scanned(values: Column, first: Column, join) -> Column:
    """For each value what joins all before it, beginning with ``first``, as ``array<bigint>``.

    Carried over runs of about sqrt(n) values, so that no array of n results is copied n times.
    """
    push = lambda acc, x: F.concat(acc, F.array(join(F.element_at(acc, -1), x)))
    begin_ = F.array(first.cast("bigint"))

    def in_runs(v):
        long = F.greatest(F.ceil(F.sqrt(F.size(v))), F.lit(1)).cast("int")
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / long).cast("int")), lambda j: F.slice(v, j * long + 1, long))

        def joined(r):
            begins = F.aggregate(r, begin_, lambda acc, run: F.concat(acc, F.array(F.aggregate(run, F.element_at(acc, -1), join))))
            return let(begins, lambda begin: F.flatten(F.transform(r, lambda run, j: F.slice(F.aggregate(run, F.array(F.get(begin, j)), push), F.lit(1), F.size(run)))))

        return F.when(F.size(v) > 0, let(runs, joined)).otherwise(F.array().cast("array<bigint>"))

    return let(values, in_runs)


def starts(sizes: Column) -> Column:
    """Where each of the pieces of these sizes begins when they stand one after the other."""
    return scanned(sizes, F.lit(0), lambda a, x: a + x)


def measured(pieces: Column) -> Column:
    """The spans of the values among the pieces of :func:`marked`."""

    def at(p):
        one = lambda begin: lambda k: F.struct(F.get(begin, 2 * k + 1).alias("start"), F.get(begin, 2 * k + 2).alias("end"), F.get(p, 2 * k + 1).alias("value"))
        return let(starts(F.transform(p, F.length)), lambda begin: F.transform(F.sequence(F.lit(0), F.floor(F.size(p) / 2).cast("int") - 1), one(begin)))

    return let(pieces, lambda p: F.when(F.size(p) > 1, at(p)).otherwise(F.array().cast(SPAN)))


BLOCK = 256


def blocks(text: Column) -> Column:
    """The text in blocks of 256 code points, so that a place in it is reached without a walk from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def between(cut: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` up to ``end`` of a text in blocks."""
    first = F.floor(start / BLOCK).cast("int")
    run = F.array_join(F.slice(cut, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
    return run.substr((start - first * BLOCK + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def spans(text: Column, before: str, value: str) -> Column:
    """Every match of ``before`` followed by ``value``, as the span of the value."""
    return measured(marked(text, before, value))


def resolve(candidates: Column, kind: str) -> Column:
    """Candidates without overlaps: in order of their sort, one is taken if it overlaps none taken before. ``kind``: their type.

    Only what overlaps is compared: by start, candidates fall into clusters, each beginning where all before it have ended.
    """
    overlap = lambda acc, x: F.exists(acc, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    greedy = lambda own: F.aggregate(F.array_sort(own), F.array().cast(kind), lambda acc, x: F.when(overlap(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    by_start = F.array_sort(candidates, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))

    def clustered(s):
        reach = scanned(F.transform(s, lambda x: x["end"]), F.lit(-1), lambda a, x: F.greatest(a, x))
        begins = lambda r: F.filter(F.transform(s, lambda x, i: F.when(x["start"] >= F.get(r, i), i)), lambda i: i.isNotNull())
        cluster = lambda b: lambda at, k: let(F.coalesce(F.get(b, k + 1), F.size(s)) - at, lambda n: F.when(n == 1, F.array(F.get(s, at))).otherwise(greedy(F.slice(s, at + 1, n))))
        return let(let(reach, begins), lambda b: F.flatten(F.transform(b, cluster(b))))

    return let(by_start, clustered)


def sql_spans(text: str, before: str, value: str) -> str:
    """The same spans as a list of structs in DuckDB SQL."""
    quote = lambda x: x.replace("'", "''")
    pieces = f"string_split_regex(regexp_replace({text}, '({quote(before)})({quote(value)})', '\\1' || chr(57344) || '\\2' || chr(57345), 'g'), '[' || chr(57344) || chr(57345) || ']')"
    chars = "list_sum(list_transform(p[1:{}], lambda x: length(x)))"
    one = f"lambda i: {{'start': CAST({chars.format('i - 1')} AS BIGINT), 'end': CAST({chars.format('i')} AS BIGINT), 'value': p[i]}}"
    return f"(SELECT list_transform(range(2, len(p) + 1, 2), {one}) FROM (SELECT {pieces} AS p))"
