"""Reports over findings: counts, conflicts, scores, verdicts, limits in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _micros(ts: str):
    """Microseconds of a time stamp without zone, or of one with zone at the session's clock."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', CAST({ts} AS timestamp_ntz))")


def conflicts(candidates: DataFrame, key: str) -> DataFrame:
    """Pairs of overlapping candidates of one text by rule: the one that owns the span and the one that yields."""
    left, right = candidates.alias("a"), candidates.alias("b")
    overlap = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")) & (F.col("a.priority") < F.col("b.priority"))
    return left.join(right, overlap).groupBy(F.col("a.rule").alias("owner"), F.col("b.rule").alias("yields")).agg(F.count(F.lit(1)).alias("n"))


def scored(found: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Per type: exact, partial and missed true spans and false findings. Both have the key, start, end and type."""
    at = [key, "type"]
    pairs = truth.alias("t").join(found.alias("f"), [*[F.col(f"t.{c}") == F.col(f"f.{c}") for c in at], F.col("f.start") < F.col("t.end"), F.col("t.start") < F.col("f.end")], "left")
    per_span = pairs.groupBy(F.col("t.type"), F.col(f"t.{key}"), F.col("t.start"), F.col("t.end")).agg(
        F.max(F.when((F.col("f.start") == F.col("t.start")) & (F.col("f.end") == F.col("t.end")), 2).when(F.col("f.start").isNotNull(), 1).otherwise(0)).alias("hit")
    )
    hits = per_span.groupBy("type").agg(*[F.sum(F.when(F.col("hit") == k, 1).otherwise(0)).alias(n) for k, n in ((2, "exact"), (1, "partial"), (0, "missed"))])
    wrong = found.alias("f").join(truth.alias("t"), [*[F.col(f"t.{c}") == F.col(f"f.{c}") for c in at], F.col("f.start") < F.col("t.end"), F.col("t.start") < F.col("f.end")], "left_anti")
    wrong = wrong.groupBy("type").agg(F.count(F.lit(1)).alias("false_findings"))
    zero = F.lit(0).cast("long")
    return hits.join(wrong, "type", "full").select("type", *[F.coalesce(c, zero).alias(c) for c in ("exact", "partial", "missed", "false_findings")])


def rates(scores: DataFrame, least: int = 30) -> DataFrame:
    """Precision, recall and F1 of :func:`scored` rows; null for types of fewer than ``least`` true spans, which tell too little."""
    hit, true = F.col("exact") + F.col("partial"), F.col("exact") + F.col("partial") + F.col("missed")
    told = F.when(true >= least, F.lit(1.0))
    precision, recall = F.try_divide(hit * told, hit + F.col("false_findings")), F.try_divide(hit * told, true)
    return scores.select("type", true.alias("spans"), precision.alias("precision"), recall.alias("recall")).withColumn("f1", F.try_divide(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall")))


def spread(findings: DataFrame, key: str, *over: str) -> DataFrame:
    """Per value digest and type: uses, texts, the first and last text, and how many of each column of ``over`` hold it."""
    counts = [F.count_distinct(c).alias(f"n_{c}") for c in (key, *over)]
    return findings.groupBy(F.sha2("value", 256).alias("digest"), "type").agg(F.count(F.lit(1)).alias("uses"), *counts, F.min(key).alias("first_text"), F.max(key).alias("last_text"))


def verdicts(findings: DataFrame, strong: tuple[str, ...]) -> DataFrame:
    """Per value digest: uses, texts, sources and a class: REAL by a strong rule, SPREAD in several texts, else SINGLE."""
    per = findings.groupBy(F.sha2("value", 256).alias("digest"), "type").agg(
        F.count(F.lit(1)).alias("uses"), F.count_distinct("doc_id").alias("texts"), F.count_distinct("source").alias("sources"), F.max(F.col("rule").isin(*strong)).alias("strong")
    )
    return per.select("digest", "type", "uses", "texts", "sources", F.when(F.col("strong"), "REAL").when(F.col("texts") > 1, "SPREAD").otherwise("SINGLE").alias("verdict"))


def rate_limited(events: DataFrame, user: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """Events with how many of their user lie in the ``seconds`` up to them, and whether that passes the limit.

    A user's events are dealt by stretches of ``seconds``; each stretch sees the times of the one before, so a hot user is
    split. Null users are a user; a user's events without a time count each other.
    """
    span = seconds * 1_000_000
    rows = events.withColumn("_at", _micros(ts)).withColumn("_stretch", F.floor(F.col("_at") / span)).withColumn("_own", F.lit(True))
    before = rows.where("_at IS NOT NULL").select(user, "_at", (F.col("_stretch") + 1).alias("_stretch"), F.lit(False).alias("_own"))
    near = Window.partitionBy(user, "_stretch").orderBy("_at").rangeBetween(-span, 0)
    counted = rows.unionByName(before, allowMissingColumns=True).withColumn("uses", F.count(F.lit(1)).over(near)).where("_own")
    return counted.drop("_at", "_stretch", "_own").withColumn("limited", F.col("uses") > limit)


def expired(events: DataFrame, user: str, ts: str, seconds: int) -> DataFrame:
    """Per user the last use, and whether it lies more than ``seconds`` before the last event of all."""
    last = events.groupBy(user).agg(F.max(_micros(ts)).alias("last_use"), F.count(F.lit(1)).alias("uses"))
    now = events.agg(F.max(_micros(ts)).alias("now")).first()["now"]
    return last.withColumn("expired", F.lit(now) - F.col("last_use") > seconds * 1_000_000)
