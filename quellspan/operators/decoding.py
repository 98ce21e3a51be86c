"""Texts behind encoded runs: Base64, its form for addresses, hex, and gzip inside them, one inside the other.

A run of a text that decodes to readable text is scanned as that text, and a finding there takes the whole run in the original,
since no part of a run stands for a part of what it hides. What a text may cost has fixed bounds, counted in work, never in
time, so the same text always decodes the same way. Null texts and runs that hold no text have no rows.
"""

from __future__ import annotations

import base64
import gzip
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quellspan.operators import detect
from quellspan.operators.rules import CATALOG

#: The shortest runs, the longest, what one text may spend, and how deep runs lie in runs.
LEAST_BASE64, LEAST_HEX, LONGEST, RUNS, BYTES, DEPTH = 24, 32, 16_384, 64, 65_536, 2
READABLE = 0.9
RUN = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{22,}={0,2}(?![A-Za-z0-9+/=_-])")
HEX = re.compile(r"(?:[0-9a-fA-F]{2})+")
KIND = "array<struct<start:bigint,end:bigint,text:string>>"


class Purse:
    """What one text may still spend."""

    def __init__(self, runs: int = RUNS, size: int = BYTES):
        self.runs, self.size = runs, size

    def pays(self, raw: bytes) -> bool:
        if self.runs < 1 or len(raw) > self.size:
            return False
        self.runs, self.size = self.runs - 1, self.size - len(raw)
        return True


def raw_bytes(run: str) -> bytes | None:
    """The bytes of a run; None where it is neither hex nor one alphabet of Base64."""
    if len(run) >= LEAST_HEX and HEX.fullmatch(run):
        return bytes.fromhex(run)
    body = run.rstrip("=")
    both = set(body) & set("+/") and set(body) & set("-_")
    if len(run) < LEAST_BASE64 or both or len(body) % 4 == 1:
        return None
    return base64.urlsafe_b64decode(body.translate(str.maketrans("+/", "-_")) + "=" * (-len(body) % 4))


def readable(raw: bytes) -> str | None:
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    shown = sum(c.isprintable() or c in "\t\r\n" for c in text)
    return text if text and shown >= READABLE * len(text) else None


def inflated(raw: bytes, most: int) -> bytes | None:
    try:
        return gzip.GzipFile(fileobj=io.BytesIO(raw)).read(most + 1)
    except (OSError, EOFError):
        return None


def decode(run: str, purse: Purse, depth: int = DEPTH) -> str | None:
    """The text of a run, with the runs inside it decoded too."""
    raw = raw_bytes(run) if len(run) <= LONGEST else None
    if raw is None or not purse.pays(raw):
        return None
    if depth > 1 and raw[:2] == b"\x1f\x8b":
        inner = inflated(raw, purse.size)
        return readable(inner) if inner is not None and purse.pays(inner) else None
    text = readable(raw)
    if text is None or depth == 1:
        return text
    return RUN.sub(lambda m: decode(m[0], purse, depth - 1) or m[0], text)


def runs_of(text: str) -> Iterator[dict]:
    purse = Purse()
    for m in RUN.finditer(text):
        said = decode(m[0], purse)
        if said is not None:
            yield {"start": m.start(), "end": m.end(), "text": said}


def _decoded(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64(), "text": pa.string()}))
    return pa.array([list(runs_of(t or "")) for t in texts.to_pylist()], kind)


def decoded(text: Column) -> Column:
    """The runs of a text that hide text: where each stands, and what it says."""
    return F.arrow_udf(_decoded, KIND)(text)


def findings(df: DataFrame, *keep: str, text_col: str = "text", rules=CATALOG) -> DataFrame:
    """Findings behind the encoded runs of texts: the columns ``keep``, start and end of the run, rule, type, value."""
    rows = df.select(*keep, F.explode_outer(decoded(F.col(text_col))).alias("_run")).where("_run IS NOT NULL")
    rows = rows.select(*keep, F.col("_run.start").alias("_start"), F.col("_run.end").alias("_end"), F.col("_run.text").alias("_said"))
    found = detect.with_findings(rows, "_said", rules).select(*keep, "_start", "_end", F.explode_outer("findings").alias("x")).where("x IS NOT NULL")
    return found.select(*keep, F.col("_start").alias("start"), F.col("_end").alias("end"), "x.rule", "x.type", "x.value")
