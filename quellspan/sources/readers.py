"""Readers of transcripts, term lists, value imports and user rules."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellspan.operators.rules import Rule


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of sessions: role, text and channel; lines that are no JSON object keep their text in ``rejected``."""
    lines = spark.read.text(path)
    record = F.from_json("value", "role string, type string, content string, text string")
    out = lines.select("value", record.alias("r"), F.json_object_keys("value").isNotNull().alias("ok"))
    role = F.coalesce("r.role", "r.type", F.lit(""))
    channel = F.when(role == "user", "prompt").otherwise("tool")
    return out.select(role.alias("role"), F.coalesce("r.content", "r.text", F.lit("")).alias("text"), channel.alias("channel"), F.when(~F.col("ok"), F.col("value")).alias("rejected"))


def terms(spark: SparkSession, path: str) -> DataFrame:
    """``(label, term)`` of lines ``LABEL  variant | variant``; blank lines and comments are left out."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    cut = lines.select(F.regexp_extract("value", r"^(\S+)\s{2,}(.*)$", 1).alias("label"), F.explode(F.split(F.regexp_extract("value", r"^(\S+)\s{2,}(.*)$", 2), r"\|")).alias("term"))
    return cut.select("label", F.lower(F.trim("term")).alias("term")).where("label <> '' AND term <> ''")


def imported_values(spark: SparkSession, path: str, least: int = 6) -> DataFrame:
    """``(value, type, reason)`` of JSON lines; reason says why a value isn't taken."""
    rows = spark.read.schema("value string, type string").json(path)
    reason = F.when(F.col("value").isNull(), "no value").when(F.length("value") < least, "too short").when(F.col("value").rlike(r"^\s|\s$"), "white space at an end")
    return rows.select("value", F.coalesce("type", F.lit("SECRET")).alias("type"), reason.alias("reason"))


def user_rule(text: str) -> Rule:
    """A rule from its JSON: id, type, regex without capturing groups, keywords. Raises ValueError where it is unsafe."""
    given = json.loads(text)
    pattern = given["regex"]
    if len(pattern) > 300 or re.search(r"\((?!\?)|[+*}]\)[+*{]", pattern):
        raise ValueError("a user rule needs a pattern of at most 300 characters, without groups that capture or nested repeats")
    re.compile(pattern)
    return Rule(given["id"], given.get("type", "SECRET"), pattern, keywords=tuple(given.get("keywords", ())), band="user")
