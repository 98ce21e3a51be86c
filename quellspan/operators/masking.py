"""Masking: texts with references in place of values, stable reference numbers, partial displays, restoring."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quellspan.functions.spans import between, blocks, let
from quellspan.session import written


def masked(text: Column, findings: Column) -> Column:
    """The text with ``⟦TYPE⟧`` in place of each finding; findings are in order of start and don't overlap."""

    def joined(own):
        def whole(cut):
            tag = lambda x, k: F.concat(between(cut, F.coalesce(F.get(own, k - 1)["end"], F.lit(0)), x["start"]), F.lit("⟦"), x["type"], F.lit("⟧"))
            return F.concat(F.array_join(F.transform(own, tag), ""), between(cut, F.element_at(own, -1)["end"], F.length(text)))

        return F.when(F.size(own) > 0, let(blocks(text), whole)).otherwise(text)

    return let(findings, joined)


def base64_line(raw: Column) -> Column:
    """Base64 without the line breaks that long values are given."""
    return F.regexp_replace(F.base64(raw), "[\r\n]", "")


def derived(value: Column) -> Column:
    """The forms under which a value may stand elsewhere, as ``(form, value)``: Base64, hex and percent-encoded."""
    raw = F.encode(value, "UTF-8")
    forms = {"base64": base64_line(raw), "hex": F.lower(F.hex(raw)), "percent": F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))}
    return F.array(*[F.struct(F.lit(k).alias("form"), v.alias("value")) for k, v in forms.items()])


def padded(key: str) -> tuple[bytes, bytes]:
    """The inner and the outer block of RFC 2104 for SHA-256."""
    raw = key.encode()
    block = (sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    return bytes(x ^ 0x36 for x in block), bytes(x ^ 0x5C for x in block)


def fingerprint(value: Column, key: str) -> Column:
    """HMAC-SHA-256 of a value; the value can't be told from it without the key."""
    inner, outer = padded(key)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(value, "UTF-8")), 256))), 256)


def numbered(values: DataFrame, key: str) -> DataFrame:
    """``(type, fingerprint, number, uses)`` of ``values(type, value, doc_id, start)``: the same value, the same number.

    Numbers count up per type in order of first occurrence. They are ranks inside ranges of (type, place) plus how many of
    the type lie in earlier ranges, so no task holds a whole type.
    """
    first = values.groupBy("type", "value").agg(F.min(F.struct("doc_id", "start")).alias("place"), F.count(F.lit(1)).alias("uses"))
    ranged = written(first.repartitionByRange("type", "place", "value").sortWithinPartitions("type", "place", "value").withColumn("part", F.spark_partition_id()), "references")
    own = Window.partitionBy("part", "type").orderBy("place", "value")
    counts = ranged.groupBy("type", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("type").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("type", "part", "before")
    out = ranged.withColumn("rank", F.row_number().over(own)).join(before, ["type", "part"])
    return out.select("type", fingerprint(F.col("value"), key).alias("fingerprint"), (F.col("before") + F.col("rank")).alias("number"), "uses")


def restored(findings: DataFrame, registry: DataFrame, key: str, allowed: Column) -> DataFrame:
    """References of findings whose registry row a policy allows; others keep null."""
    return findings.withColumn("fingerprint", fingerprint(F.col("value"), key)).join(registry, ["type", "fingerprint"], "left").withColumn("value", F.when(allowed, F.col("value")))


def displayed(type: Column, value: Column) -> Column:
    """A readable part of a value: first letter and domain of an address, last digits of a number."""
    dots = F.lit("•••")
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(type == "EMAIL", F.concat(F.substring(value, 1, 2), dots, F.lit("@"), F.substring_index(value, "@", -1)))
        .when(type == "PHONE", F.concat(F.lit("+"), F.substring(digits, 1, 1), dots, F.right(digits, F.lit(2))))
        .when(type == "CARD", F.concat(dots, F.right(digits, F.lit(4))))
        .when(type == "IP", F.concat(F.substring_index(value, ".", 2), F.lit(".•.•")))
        .when(type == "IBAN", F.concat(F.substring(value, 1, 4), dots, F.right(value, F.lit(2))))
        .otherwise(dots)
    )
