"""Encoded runs: what they say, how deep they are read, what one text may spend."""

import base64
import gzip

import pytest

from quellspan.operators import decoding
from quellspan.operators.rules import chosen

PHONE = "call +1 (212) 555-0123 today\n"
b64 = lambda x: base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()
RULES = chosen(ids=("phone",))

CASES = {
    "base64": (b64(PHONE), PHONE),
    "for addresses": (base64.urlsafe_b64encode(("ÿþ?>" + PHONE).encode()).decode().rstrip("="), "ÿþ?>" + PHONE),
    "hex": (PHONE.encode().hex(), PHONE),
    "twice": (b64("say " + b64(PHONE) + " end"), f"say {PHONE} end"),
    "three times": (b64(b64(b64(PHONE))), b64(PHONE)),
    "gzip": (b64(gzip.compress(PHONE.encode(), mtime=0)), PHONE),
    "not readable": (b64(bytes(range(128, 200))), None),
    "short": (b64("call me"), None),
    "two alphabets": ("ab+cd-ef" * 5, None),
    "too long": (b64("x " * 10_000), None),
    "broken gzip": (b64(b"\x1f\x8b" + b"0" * 40), None),
}


@pytest.mark.parametrize("name", CASES)
def test_runs(name):
    run, said = CASES[name]
    text = f"🙂 see {run}, and more"
    want = [] if said is None else [{"start": 6, "end": 6 + len(run), "text": said}]
    assert list(decoding.runs_of(text)) == want


def test_what_a_text_may_spend():
    assert len(list(decoding.runs_of(" ".join([b64(PHONE)] * 100)))) == decoding.RUNS
    big = b64("word " * 2000)
    assert len(list(decoding.runs_of(" ".join([big] * 20)))) == decoding.BYTES // 10_000


def test_findings_take_the_whole_run(spark):
    texts = [f"a {CASES[n][0]} b" for n in ("base64", "hex", "twice", "gzip", "short")] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = sorted((r["k"], r["start"], r["end"], r["value"]) for r in decoding.findings(df, "k", rules=RULES).collect())
    assert got == [(k, 2, len(texts[k]) - 2, "+1 (212) 555-0123") for k in range(4)]
