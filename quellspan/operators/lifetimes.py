"""Values in time: lives that uses renew, distinct values per session, incidents.

A key may hold a third of all rows. Rows are therefore dealt by key and stretch of time, and what one stretch must know of
its neighbour is one row sent there, not a join; only rows per key and stretch meet in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quellspan.operators.reports import _micros
from quellspan.session import scratch, written

SECOND = 1_000_000
DAY = 86_400


def ttl_of(type_: Column, ttls: dict[str, int], default: int) -> Column:
    """Seconds that a value of this type lives without use."""
    out = F.lit(default)
    for name, seconds in ttls.items():
        out = F.when(type_ == name, seconds).otherwise(out)
    return out


def sessions(rows: DataFrame, keys: list[str], stretch: int) -> DataFrame:
    """``(keys, first, last, uses, days)``: runs of uses of a key of which none comes more than ``_gap`` after the one before.

    ``rows`` have the keys, ``_at`` in microseconds and ``_gap``, in microseconds too, at most ``stretch`` and the same for all
    rows of a key. Null keys are keys. A run is first told inside each stretch; of a key, a stretch holds a few partial runs.
    """
    rows = rows.select(*keys, "_at", "_gap").withColumn("_stretch", F.floor(F.col("_at") / stretch)).withColumn("_own", F.lit(True))
    before = rows.groupBy(*keys, "_stretch").agg(F.max("_at").alias("_at"), F.first("_gap").alias("_gap"))
    both = rows.unionByName(before.withColumn("_stretch", F.col("_stretch") + 1).withColumn("_own", F.lit(False)))
    inside = Window.partitionBy(*keys, "_stretch").orderBy("_at", "_own")
    last = F.lag("_at").over(inside)
    both = both.withColumn("_begin", F.when(F.col("_own") & (last.isNull() | (F.col("_at") - last > F.col("_gap"))), F.col("_at")))
    part = both.withColumn("_part", F.max("_begin").over(inside.rowsBetween(Window.unboundedPreceding, 0))).where("_own")
    day = F.floor(F.col("_at") / (DAY * SECOND))
    parts = part.groupBy(*keys, "_stretch", "_part").agg(
        F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.count(F.lit(1)).alias("_uses"), F.collect_set(day).alias("_days")
    )
    run = F.max("_part").over(Window.partitionBy(*keys).orderBy("_first").rowsBetween(Window.unboundedPreceding, 0))
    merged = parts.withColumn("_run", run).groupBy(*keys, "_run").agg(
        F.min("_first").alias("first"), F.max("_last").alias("last"), F.sum("_uses").alias("uses"), F.size(F.array_distinct(F.flatten(F.collect_list("_days")))).cast("long").alias("days")
    )
    return merged.drop("_run")


def lives(uses: DataFrame, keys: list[str], ts: str, ttl: Column, longest: int, cap: int) -> DataFrame:
    """``(keys, first, last, uses, expires)`` in microseconds: each life of a value.

    A use renews a value for ``ttl`` seconds (the same for all uses of a key, at most ``longest``), but no life lasts beyond
    ``cap`` seconds after its first use. A use after the expiry begins the next life; one at the very expiry renews. Uses
    without a time are left out, null keys are keys, repeated rows are uses of their own.

    Runs without a gap come from :func:`sessions`; those longer than the cap are cut one life a round, so there are as many
    rounds as caps in the longest run.
    """
    spark = uses.sparkSession
    rows = uses.where(F.col(ts).isNotNull()).select(*keys, _micros(ts).alias("_at"), (ttl.cast("long") * SECOND).alias("_gap"))
    with scratch(spark):
        rows = written(rows, "uses", keep=True)
        runs = written(sessions(rows, keys, longest * SECOND).drop("days"), "runs", keep=True)
        long = F.col("last") - F.col("first") > cap * SECOND
        done = [runs.where(~long)]
        same = lambda a, b, names: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in names]
        within = F.col("u._at").between(F.col("r.first"), F.col("r.last"))
        rest = rows.alias("u").join(runs.where(long).alias("r"), [*same("u", "r", keys), within]).select(*[F.col(f"u.{k}") for k in keys], F.col("r.first").alias("_run"), F.col("u._at"))
        rest = written(rest, "long", keep=True)
        named = [*keys, "_run"]
        while not rest.isEmpty():
            begins = rest.groupBy(*named).agg(F.min("_at").alias("first"))
            held = rest.alias("u").join(begins.alias("b"), same("u", "b", named)).select(*[F.col(f"u.{k}") for k in named], "_at", "first")
            held = written(held.withColumn("_in", F.col("_at") <= F.col("first") + cap * SECOND), "round", keep=True)
            done.append(held.where("_in").groupBy(*named, "first").agg(F.max("_at").alias("last"), F.count(F.lit(1)).alias("uses")).drop("_run"))
            rest = held.where("NOT _in").select(*named, "_at")
    out = done[0].select(*keys, "first", "last", "uses")
    for more in done[1:]:
        out = out.unionByName(more.select(*keys, "first", "last", "uses"))
    return out.withColumn("expires", F.least(F.col("last") + (ttl.cast("long") * SECOND), F.col("first") + cap * SECOND))


def incidents(events: DataFrame, by: list[str], ts: str, gap: int) -> DataFrame:
    """``(by, first, last, uses, days)``: events of one kind without ``gap`` seconds of quiet between them are one incident.

    ``days`` are the distinct days (UTC) with an event. Events without a time are left out.
    """
    rows = events.where(F.col(ts).isNotNull()).select(*by, _micros(ts).alias("_at"), F.lit(gap * SECOND).cast("long").alias("_gap"))
    return sessions(rows, by, gap * SECOND)


def keys_in_session(uses: DataFrame, session: str, key: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """Adds ``keys``, how many distinct keys the session has used in the ``seconds`` up to each use, and ``limited``.

    Each use counts from its time until the key's next use or until it is too old, so that a running sum of steps up and down
    is the number of distinct keys: no set is kept. Uses without a time count nothing and are not limited; a null session is a
    session, a null key a key.
    """
    span = seconds * SECOND
    timed = uses.where(F.col(ts).isNotNull()).select(F.col(session).alias("_session"), F.col(key).alias("_key"), _micros(ts).alias("_at"), F.struct("*").alias("_row"))
    timed = timed.withColumn("_stretch", F.floor(F.col("_at") / span))
    after = timed.groupBy("_session", "_key", "_stretch").agg(F.min("_at").alias("_at")).withColumn("_stretch", F.col("_stretch") - 1)
    both = timed.withColumn("_own", F.lit(True)).unionByName(after.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    following = F.lead("_at").over(Window.partitionBy("_session", "_key", "_stretch").orderBy("_at", F.desc("_own")))
    end = F.least(F.coalesce(following, F.col("_at") + span + 1), F.col("_at") + span + 1)
    told = both.withColumn("_end", end).where("_own")
    up = told.select("_session", "_stretch", "_at", F.lit(1).alias("_step"), "_row")
    down = told.select("_session", F.floor(F.col("_end") / span).alias("_stretch"), F.col("_end").alias("_at"), F.lit(-1).alias("_step"))
    steps = up.unionByName(down, allowMissingColumns=True)
    sums = steps.groupBy("_session", "_stretch").agg(F.sum("_step").alias("_sum"))
    held = F.sum("_sum").over(Window.partitionBy("_session").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    begin = sums.withColumn("_step", held).where("_step <> 0").select("_session", "_stretch", (F.col("_stretch") * span).alias("_at"), F.col("_step"))
    running = Window.partitionBy("_session", "_stretch").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    out = steps.unionByName(begin, allowMissingColumns=True).withColumn("keys", F.sum("_step").over(running)).where("_row IS NOT NULL")
    untimed = uses.where(F.col(ts).isNull()).withColumn("keys", F.lit(0).cast("long"))
    return out.select("_row.*", "keys").unionByName(untimed).withColumn("limited", F.col("keys") > limit)
