"""Nested leaves of JSON texts with path and place, scanned as texts of their own.

A small scanner reads a record's leaves with the places of their characters in the JSON text; what is escaped there is decoded
as columns, with runs that lead back. So a finding of a leaf is told at its place in the record's text, escapes included.
Within a record, leaves of the same label and value are scanned once and their findings copied to each place. Text nodes of
one container form a sentence: it is scanned joined, beside its nodes, and its findings are cut into the nodes they cover.

Texts that are null or no JSON have no leaves. Leaves at any depth are read with the scanner's own stack; of keys that are given
twice both stand. No record is shuffled: grouping happens inside its row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quellspan.functions.spans import let, mapped, scanned
from quellspan.operators import detect
from quellspan.operators.cleaning import original, rewritten
from quellspan.operators.rules import CATALOG
from quellspan.session import written

TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[{}\[\]:,]|[^\s{}\[\]:,"]+', re.S)
#: Fixed values of RFC 8259: escapes, and what the short ones stand for.
PAIR = r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}"
ESCAPED = rf"{PAIR}|\\u[0-9a-fA-F]{{4}}|\\[\"\\/bfnrt]"
SHORT = {'\\"': '"', "\\\\": "\\", "\\/": "/", "\\b": "\b", "\\f": "\f", "\\n": "\n", "\\r": "\r", "\\t": "\t"}
#: Lists whose text nodes are parts of one sentence.
INLINE = frozenset({"content"})

_PLACE = pa.struct({"path": pa.list_(pa.string()), "start": pa.int64(), "end": pa.int64()})
_LEAF = pa.struct({"label": pa.string(), "kind": pa.string(), "raw": pa.string(), "places": pa.list_(_PLACE)})
_NODE = pa.struct({"path": pa.list_(pa.string()), "start": pa.int64(), "end": pa.int64(), "raw": pa.string()})
LEAF = "struct<label:string,kind:string,raw:string,places:array<struct<path:array<string>,start:bigint,end:bigint>>>"
NODE = "struct<path:array<string>,start:bigint,end:bigint,raw:string>"


def scan(text: str | None) -> Iterator[tuple[tuple[str, ...], str, int, int]]:
    """(path, kind, start, end) of each leaf of a JSON text, a string's without its quotes; nothing of other texts."""
    try:
        json.loads(text or "")
    except (ValueError, RecursionError):
        return
    stack: list[list] = []  # of open containers: the key or index of what comes next, and whether a key is due
    for m in TOKEN.finditer(text):
        token = m[0]
        if token in "{[":
            stack.append(["", True] if token == "{" else [0, False])
        elif token in "}]":
            stack.pop()
        elif token == ",":
            stack[-1] = ["", True] if isinstance(stack[-1][0], str) else [stack[-1][0] + 1, False]
        elif token == ":":
            stack[-1][1] = False
        elif stack and stack[-1][1]:
            stack[-1][0] = json.loads(token)
        else:
            string = token[0] == '"'
            yield tuple(str(s[0]) for s in stack), "string" if string else "literal", m.start() + string, m.end() - string


def label(path: tuple[str, ...]) -> str:
    """The nearest name above a leaf."""
    return next((p for p in reversed(path) if not p.isdigit()), "")


def _leaf_arrays(texts: pa.Array) -> pa.Array:
    out = []
    for text in texts.to_pylist():
        own: dict = {}
        for path, kind, start, end in scan(text):
            own.setdefault((label(path), kind, text[start:end]), []).append({"path": list(path), "start": start, "end": end})
        out.append([{"label": k[0], "kind": k[1], "raw": k[2], "places": places} for k, places in own.items()])
    return pa.array(out, pa.list_(_LEAF))


def _sentence_arrays(texts: pa.Array) -> pa.Array:
    out = []
    for text in texts.to_pylist():
        own: dict = {}
        for path, kind, start, end in scan(text):
            if kind == "string" and len(path) >= 3 and path[-1] == "text" and path[-2].isdigit() and path[-3] in INLINE:
                own.setdefault(path[:-2], []).append({"path": list(path), "start": start, "end": end, "raw": text[start:end]})
        out.append([nodes for nodes in own.values() if sum(1 for n in nodes if n["raw"].strip()) >= 2])
    return pa.array(out, pa.list_(pa.list_(_NODE)))


def _leaves(text: Column) -> Column:
    return F.arrow_udf(_leaf_arrays, f"array<{LEAF}>")(text)


def _sentences(text: Column) -> Column:
    return F.arrow_udf(_sentence_arrays, f"array<array<{NODE}>>")(text)


def unescaped(raw: Column) -> Column:
    """``struct<text, runs>`` of the characters of a JSON string, runs as of :func:`rewritten`; a lone surrogate is U+FFFD."""

    def put(x, _):
        unit = lambda at: F.conv(F.substring(x, at, 4), 16, 10).cast("int")
        code = F.when(F.length(x) == 12, (unit(3) - 0xD800) * 1024 + unit(9) - 0xDC00 + 0x10000).otherwise(unit(3))
        char = F.when(code.between(0xD800, 0xDFFF), "�").otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.when(F.length(x) == 2, F.try_element_at(mapped(SHORT), x)).otherwise(char)

    return rewritten(raw, ESCAPED, put)


def leaf_rows(df: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    """The columns ``keep``, path, kind, start and end in the JSON text, and value, of every leaf."""
    rows = df.select(*keep, F.explode(_leaves(F.col(text_col))).alias("x"))
    value = F.when(F.col("x.kind") == "string", unescaped(F.col("x.raw"))["text"]).otherwise(F.col("x.raw"))
    rows = rows.withColumn("_value", value)  # a step of its own: beside a generator the names of structs would be lost
    return rows.select(*keep, "x.kind", F.col("_value").alias("value"), F.explode("x.places").alias("p")).select(*keep, "p.path", "kind", "p.start", "p.end", "value")


def findings(df: DataFrame, *keep: str, text_col: str = "text", rules=CATALOG) -> DataFrame:
    """Findings of the string leaves of JSON texts: the columns ``keep``, path, start and end in the JSON text, rule, type, value."""
    rows = df.select(*keep, F.explode(_leaves(F.col(text_col))).alias("x")).where("x.kind = 'string'")
    rows = rows.withColumn("said", unescaped(F.col("x.raw"))).select(*keep, F.col("x.places").alias("places"), F.col("said.text").alias("_leaf"), F.col("said.runs").alias("_runs"))
    found = detect.with_findings(rows, "_leaf", rules).select(*keep, "places", "_runs", F.explode_outer("findings").alias("x")).where("x IS NOT NULL")
    found = found.withColumn("y", original(F.col("_runs"), F.col("x.start"), F.col("x.end"))).select(*keep, "x", "y", F.explode("places").alias("p"))
    return found.select(*keep, "p.path", (F.col("p.start") + F.col("y.start")).alias("start"), (F.col("p.start") + F.col("y.end")).alias("end"), "x.rule", "x.type", "x.value")


def sentence_findings(df: DataFrame, *keep: str, text_col: str = "text", rules=CATALOG) -> DataFrame:
    """Findings of sentences whose parts stand in several leaves, cut into these: the columns of :func:`findings`."""
    rows = df.select(*keep, F.explode(_sentences(F.col(text_col))).alias("nodes"))
    rows = rows.withColumn("said", F.transform("nodes", lambda n: unescaped(n["raw"])))
    rows = rows.withColumn("_at", scanned(F.transform("said", lambda s: F.length(s["text"])), F.lit(0), lambda a, x: a + x))
    rows = rows.withColumn("_whole", F.array_join(F.transform("said", lambda s: s["text"]), ""))
    found = detect.with_findings(rows, "_whole", rules).select(*keep, F.arrays_zip("nodes", "said", "_at").alias("n"), F.explode_outer("findings").alias("x")).where("x IS NOT NULL")
    found = found.select(*keep, "x", F.explode("n").alias("n"))
    start, end = F.greatest("x.start", "n._at") - F.col("n._at"), F.least(F.col("x.end"), F.col("n._at") + F.length("n.said.text")) - F.col("n._at")
    cut = found.withColumn("a", start).withColumn("b", end).where("a < b").withColumn("y", original(F.col("n.said.runs"), F.col("a"), F.col("b")))
    base, value = F.col("n.nodes.start"), F.substring(F.col("n.said.text"), (F.col("a") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int"))
    return cut.select(*keep, F.col("n.nodes.path").alias("path"), (base + F.col("y.start")).alias("start"), (base + F.col("y.end")).alias("end"), "x.rule", "x.type", value.alias("value"))


def object_findings(df: DataFrame, *key: str, text_col: str = "text", rules=CATALOG) -> DataFrame:
    """Findings of leaves, and of sentences over several of them where no leaf's own finding says the same."""
    own = written(findings(df, *key, text_col=text_col, rules=rules), "leaf-findings")
    over = sentence_findings(df, *key, text_col=text_col, rules=rules)
    return own.unionByName(over.join(own.select(*key, "path", "start", "end", "type"), [*key, "path", "start", "end", "type"], "left_anti").select(*own.columns))
