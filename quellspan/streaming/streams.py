"""Streams: findings of arriving texts, rate limits over windows, values that expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellspan.operators import detect
from quellspan.operators.rules import CATALOG


def finding_stream(texts: DataFrame, *keep: str, text_col: str = "text", rules=CATALOG) -> DataFrame:
    """Findings of a stream of texts; stateless, the same plan as for a table."""
    return detect.findings(texts, *keep, text_col=text_col, rules=rules)


def uses_per_window(events: DataFrame, user: str, ts: str, window: str = "1 hour", slide: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Uses per user in sliding windows; events later than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window, slide), user).agg(F.count(F.lit(1)).alias("uses"))


def expiring(uses: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """One row when a key is first used and one when it has not been used for ``seconds`` of event time."""

    def step(own, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"key": [str(own[0])], "event": ["expired"], "at": [last]})
            return
        last = max(int(b["at"].max()) for b in batches)
        if state.exists:
            last = max(last, state.get[0])
        else:
            yield pd.DataFrame({"key": [str(own[0])], "event": ["first use"], "at": [last]})
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    rows = uses.withWatermark(ts, "1 minute").select(F.col(key).alias("key"), F.col(ts), F.unix_micros(ts).alias("at"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, event string, at long", "last long", "append", "EventTimeTimeout")


def lifetimes(uses: DataFrame, key: str, type_col: str, ts: str, ttls: dict[str, int], default: int, cap: int, late: str = "1 minute") -> DataFrame:
    """One row ``(key, type, first, last, uses, expires)`` per life of a value, when the watermark has passed its expiry.

    A use renews a value for its type's time to live, never beyond ``cap`` seconds after the first; a life is stored anew by
    the use after its expiry. Uses that the watermark has not passed wait in the state, as earlier ones may still come; those
    later than the watermark are dropped. What has not expired when the stream stops is in the state, not in the rows.
    """
    names = ["key", "type", "first", "last", "uses", "expires"]
    types = "key string, type string, first long, last long, uses long, expires long"

    def step(own, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ttl = ttls.get(own[1], default) * 1_000_000
        life, waiting = (state.get[:3], list(state.get[3])) if state.exists else ((0, 0, 0), [])
        first, last, count = life
        passed = state.getCurrentWatermarkMs() * 1000
        for b in batches:
            waiting += [int(x) for x in b["at"]]
        waiting.sort()
        ended = []
        end = lambda: min(last + ttl, first + cap * 1_000_000)
        while waiting and waiting[0] <= passed:
            at = waiting.pop(0)
            if count and at > end():
                ended.append((own[0], own[1], first, last, count, end()))
                count = 0
            first, last, count = (first if count else at), at, count + 1
        if count and end() < passed and not (waiting and waiting[0] <= end()):
            ended.append((own[0], own[1], first, last, count, end()))
            count = 0
        if count or waiting:
            state.update((first, last, count, waiting))
            due = min(([end()] if count else []) + waiting[:1])
            state.setTimeoutTimestamp(max(due // 1000, state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(ended, columns=names)

    rows = uses.withWatermark(ts, late).select(F.col(key).cast("string").alias("key"), F.col(type_col).alias("type"), F.col(ts), F.unix_micros(ts).alias("at"))
    return rows.groupBy("key", "type").applyInPandasWithState(step, types, "first long, last long, uses long, waiting array<long>", "append", "EventTimeTimeout")
