import json
import random

import pytest
from pyspark.sql import functions as F

from quellspan.llm import chat, queries

PARTS = ["\\", "\\\\", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<\\s>", "<", "[", "\n", "é", "🙂", "a b", "%0A", "$1", "user\n"]


def odd(rng):
    return "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 8)))


def test_layouts_map_to_canonical_turns(spark):
    cases = [
        ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": None}], "id": 3}, "messages", [("system", "s"), ("user", "")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations", [("user", "q"), ("assistant", "a")]),
        ({"dialogue": [{"speaker": "bot", "text": "hi"}], "turns": 4}, "dialogue", [("assistant", "hi")]),
        ({"prompt": "p", "completion": "c"}, "completion", [("user", "p"), ("assistant", "c")]),
        ({"prompt": "p", "completion": None, "formatted": "clash"}, "completion", [("user", "p"), ("assistant", "")]),
        ({"prompt": "p", "response": "c", "system": "be kind"}, "response", [("system", "be kind"), ("user", "p"), ("assistant", "c")]),
        ({"instruction": "do", "input": "x", "output": "y"}, "instruction", [("user", "do\n\nx"), ("assistant", "y")]),
        ({"instruction": "do", "input": "", "output": "y"}, "instruction", [("user", "do"), ("assistant", "y")]),
        ({"question": "q", "answer": "a"}, "question", [("user", "q"), ("assistant", "a")]),
        ({"messages": []}, "messages", []),
        ({"messages": [], "prompt": "both"}, None, None),
        ({"unknown": 1}, None, None),
    ]
    rows = [(i, json.dumps(c)) for i, (c, _, _) in enumerate(cases)] + [(98, "no json"), (99, None)]
    got = {r.id: r for r in chat.format_json(spark.createDataFrame(rows, "id int, turns string"), "turns").collect()}
    for i, (_, layout, turns) in enumerate(cases):
        assert got[i].layout == layout
        assert (None if turns is None else [tuple(t) for t in got[i].turns]) == turns
    assert got[98].layout is None and got[99].formatted is None


def test_fingerprints_are_of_field_paths(spark):
    assert len({f for m in chat.MAPPINGS for f in chat.fingerprints_of(m)}) == sum(len(chat.fingerprints_of(m)) for m in chat.MAPPINGS)
    record, keys = chat.from_json_text(F.col("j"))
    df = spark.createDataFrame([('{"prompt":"a","completion":"b","other":{"role":1}}',)], "j string")
    assert df.select(chat.schema_fingerprint(record, chat.record_type().names, keys)).first()[0] == chat.fingerprint_of(["prompt", "completion"])


def test_round_trip(spark):
    rng = random.Random(2)
    convs = {i: [(rng.choice(["user", "assistant", "system", "to<|ol\n%", ""]), odd(rng)) for _ in range(rng.randint(1, 6))] for i in range(300)}
    convs[300] = [("assistant", "x" * 200_000)]
    rows = [(c, t, r, x) for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_records(chat.gathered(df)).withColumns({"back": chat.read_back(F.col("formatted")), "loss": chat.trained_text(F.col("formatted"), F.col("mask"))})
    for r in out.collect():
        assert [tuple(t) for t in r.back] == convs[r.conv_id]
        assert r.loss == "".join(x for role, x in convs[r.conv_id] if role == "assistant")
        assert sum(m.before + m.trained + m.after for m in r["mask"]) == len(r.formatted)
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == len(convs[r.conv_id])
        assert not any(c in r.formatted for c in chat.CONTROL[2:])


def test_repeated_rows_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "user", "a"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [t.text for t in r.turns] for r in chat.format_records(chat.gathered(df)).collect()}
    assert got == {None: [""], 1: ["a", "a", "a", "b"]}
    assert chat.format_records(chat.gathered(df.limit(0))).count() == 0


def test_query(spark, sf_dir):
    import hashlib

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    convs = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3] or "")):
        convs.setdefault(c, []).append((r, x or ""))
    got = {r.conv_id: r for r in queries.op2_chat(spark, sf_dir).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
