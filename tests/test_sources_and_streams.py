import json
import time

import pytest

from quellspan.operators import detect
from quellspan.operators.rules import chosen
from quellspan.sources import readers
from quellspan.streaming import streams


def test_readers(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"role":"user","content":"hi"}\nnot json\n{"type":"tool","text":"out"}\n')
    got = [(r.role, r.text, r.channel, r.rejected) for r in readers.transcripts(spark, str(tmp_path / "t.jsonl")).collect()]
    assert ("user", "hi", "prompt", None) in got and ("tool", "out", "tool", None) in got and got[1][3] == "not json"
    (tmp_path / "terms").write_text("# comment\n\nACME  Acme Corp | acme\n")
    assert sorted((r.label, r.term) for r in readers.terms(spark, str(tmp_path / "terms")).collect()) == [("ACME", "acme"), ("ACME", "acme corp")]
    (tmp_path / "v.jsonl").write_text('{"value":"abc"}\n{"value":"longer-value","type":"KEY"}\n')
    assert [(r.type, r.reason) for r in readers.imported_values(spark, str(tmp_path / "v.jsonl")).collect()] == [("SECRET", "too short"), ("KEY", None)]


def test_user_rules(spark):
    rule = readers.user_rule(json.dumps({"id": "own", "regex": "ACME-[0-9]{6}", "keywords": ["ACME-"]}))
    df = spark.createDataFrame([("see ACME-123456",)], "text string")
    assert [r.value for r in detect.candidate_rows(df, rules=(rule,)).collect()] == ["ACME-123456"]
    for bad in ("(a)b", "(?:a+)+b"):
        with pytest.raises(ValueError):
            readers.user_rule(json.dumps({"id": "x", "regex": bad}))


def test_finding_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, "call +1 (212) 555-0188"), (2, "nothing")], "id int, text string")
    df.write.parquet(str(tmp_path / "in"))
    rules = chosen(ids=["phone"])
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streams.finding_stream(stream, "id", rules=rules).writeStream.format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("found").collect() == detect.findings(df, "id", rules=rules).collect()


def test_expiry_stream(spark, tmp_path):
    schema = "user long, ts timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path))
    q = streams.expiring(stream, "user", "ts", 60).writeStream.format("memory").queryName("expiry").outputMode("append").start()
    for n, rows in enumerate([[(1, "2024-01-01T00:00:00Z")], [(2, "2024-01-01T00:30:00Z")], [(2, "2024-01-01T00:31:00Z")]]):
        (tmp_path / f"{n}.json").write_text("\n".join(json.dumps({"user": u, "ts": t}) for u, t in rows))
        time.sleep(1.1)
        q.processAllAvailable()
    q.stop()
    got = [(r.key, r.event) for r in spark.table("expiry").collect()]
    assert ("1", "first use") in got and ("1", "expired") in got and ("2", "first use") in got
