import random
from datetime import datetime, timedelta, timezone

import pytest

from quellspan.operators import lifetimes, reports
from quellspan.streaming import streams
from pyspark.sql import functions as F

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
HOUR = 3600


def micros(t):
    return (t - START) // timedelta(microseconds=1) + int(START.timestamp()) * 1_000_000


def plain_lives(uses, ttl, cap):
    out = {}
    for key, at in sorted(((k, micros(t)) for k, t in uses), key=lambda x: x[1]):
        own = out.setdefault(key, [])
        if own and at <= min(own[-1][1] + ttl * 10**6, own[-1][0] + cap * 10**6):
            own[-1] = [own[-1][0], at, own[-1][2] + 1]
        else:
            own.append([at, at, 1])
    return sorted((k, *life, min(life[1] + ttl * 10**6, life[0] + cap * 10**6)) for k, all_ in out.items() for life in all_)


def frame(spark, rows):
    return spark.createDataFrame([(k, t) for k, t in rows], "value string, ts timestamp")


def random_uses(n, keys, days, seed=3):
    rng = random.Random(seed)
    return [(rng.choice(keys), START + timedelta(seconds=rng.randrange(days * 86400))) for _ in range(n)]


def test_lives_of_a_hot_value_are_cut_at_the_cap(spark):
    uses = random_uses(900, ["hot"] * 6 + ["b", "c"], 25)
    got = lifetimes.lives(frame(spark, uses), ["value"], "ts", F.lit(6 * HOUR), 6 * HOUR, 60 * HOUR)
    assert sorted(map(tuple, got.collect())) == plain_lives(uses, 6 * HOUR, 60 * HOUR)


def test_a_use_at_the_expiry_renews_and_one_behind_it_does_not(spark):
    at = lambda s: START + timedelta(seconds=s)
    uses = [("a", at(0)), ("a", at(100)), ("a", at(201)), ("b", at(0)), ("b", at(90)), ("b", at(150)), ("b", at(151)), ("a", at(201))]
    got = lifetimes.lives(frame(spark, uses), ["value"], "ts", F.lit(100), 100, 150).collect()
    assert sorted((r["value"], r["uses"]) for r in got) == [("a", 2), ("a", 2), ("b", 1), ("b", 3)]


def test_lives_of_null_keys_null_times_and_no_rows(spark):
    uses = frame(spark, [(None, START), (None, START + timedelta(seconds=5)), ("a", None)])
    got = lifetimes.lives(uses, ["value"], "ts", F.lit(10), 10, 3).collect()
    assert [(r["value"], r["uses"]) for r in got] == [(None, 1), (None, 1)]
    assert lifetimes.lives(uses.where("false"), ["value"], "ts", F.lit(10), 10, 20).collect() == []


def test_time_to_live_by_type(spark):
    types = spark.createDataFrame([("CARD",), ("EMAIL",), (None,)], "t string")
    assert [r[0] for r in types.select(lifetimes.ttl_of(F.col("t"), {"CARD": 3600}, 86400)).collect()] == [3600, 86400, 86400]


@pytest.mark.parametrize("keys", [["a"], list("abcdefgh")])
def test_distinct_keys_equal_sets_of_the_last_hour(spark, keys):
    rng = random.Random(5)
    rows = [(i, rng.choice(["s", "s", "s", None]), rng.choice(keys + [None]), START + timedelta(seconds=rng.randrange(6 * HOUR // 60) * 60)) for i in range(300)]
    rows.append((300, "s", "a", None))
    df = spark.createDataFrame(rows, "keys_id int, session string, key string, ts timestamp")
    got = {r["keys_id"]: (r["keys"], r["limited"]) for r in lifetimes.keys_in_session(df, "session", "key", "ts", HOUR, 4).collect()}
    for i, s, _, t in rows:
        seen = {k for _, s2, k, u in rows if t and u and s2 == s and t - timedelta(hours=1) <= u <= t}
        assert got[i] == (len(seen), len(seen) > 4)
    assert len(got) == len(rows)


def test_incidents_end_where_a_gap_begins(spark):
    at = lambda h: START + timedelta(hours=h)
    rows = [("disk", at(0)), ("disk", at(20)), ("disk", at(30)), ("disk", at(60)), ("net", at(3)), ("net", None)]
    got = lifetimes.incidents(frame(spark, rows), ["value"], "ts", 24 * HOUR).collect()
    assert sorted((r["value"], r["uses"], r["days"]) for r in got) == [("disk", 1, 1), ("disk", 3, 2), ("net", 1, 1)]


def test_the_stream_of_lifetimes_equals_the_table(spark, tmp_path):
    uses = sorted(random_uses(400, ["a", "b", "c"], 20), key=lambda x: x[1])
    rng = random.Random(1)
    last = START + timedelta(days=90)
    for i in range(4):
        part = uses[i * 100 : i * 100 + 100]
        rng.shuffle(part)
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frame(spark, [("end", last)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    texts = spark.readStream.schema("value string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streams.lifetimes(texts.withColumn("type", F.lit("x")), "value", "type", "ts", {"x": 6 * HOUR}, 60, 40 * HOUR)
    q = out.writeStream.format("memory").queryName("lives").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    got = sorted((r["key"], r["first"], r["last"], r["uses"], r["expires"]) for r in spark.table("lives").collect())
    assert got == plain_lives(uses, 6 * HOUR, 40 * HOUR)


def test_uses_of_a_hot_user_equal_a_plain_count(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["hot"] * 5 + ["b", None]), START + timedelta(seconds=rng.randrange(0, 5 * HOUR, 60))) for i in range(300)]
    rows += [(300, "b", None), (301, "b", None)]
    df = spark.createDataFrame(rows, "n int, who string, ts timestamp")
    got = {r["n"]: (r["uses"], r["limited"]) for r in reports.rate_limited(df, "who", "ts", HOUR, 20).collect()}
    for n, who, t in rows:
        uses = sum(w == who and ((u is None) if t is None else (u is not None and t - timedelta(hours=1) <= u <= t)) for _, w, u in rows)
        assert got[n] == (uses, uses > 20)
    assert len(got) == len(rows)
