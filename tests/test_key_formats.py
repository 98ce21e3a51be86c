import hashlib
import random

import duckdb
import pytest

from quellspan.functions import checks
from quellspan.operators import detect
from pyspark.sql import functions as F


def base58(payload, spoil=b""):
    tail = hashlib.sha256(hashlib.sha256(payload + spoil).digest()).digest()[:4]
    n, out = int.from_bytes(payload + tail, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = checks.BASE58[r] + out
    return out


def swapped(s, i):
    return s[:i] + s[i + 1] + s[i] + s[i + 2 :]


rng = random.Random(7)
KEY = [rng.randbytes(32) for _ in range(8)]
WIFS = [base58(v + k + tail) for v in (b"\x80", b"\xef") for k in KEY for tail in (b"", b"\x01")]
HEAD = b"\x03" + bytes(4) + rng.randbytes(37)
XPRVS = [base58(bytes.fromhex(v) + HEAD[:41] + b"\0" + KEY[0]) for v in checks.XPRV_VERSIONS]
OVER = bytes.fromhex(checks.SECP256K1)
#: Printed examples: of the format's wiki page and of BIP-32's first test vector.
PRINTED = {
    "wif": "5HueCGU8rMjxEXxiPuD5BDku4MkFqeZyd4dZ1jvhTVqvbTLvyTJ",
    "xprv": "xprv9s21ZrQH143K3QTDL4LXw2F7HEK3wJUD2nW2nRk4stbPy6cq3jPPqjiChkVvvNKmPGJxWUtg6LnF5kejMRNNU3TGtRBeJgk33yuGBxrMPHi",
}
GOOD = {"wif": [*WIFS, PRINTED["wif"]], "xprv": [*XPRVS, PRINTED["xprv"]]}
BAD = {
    "wif": [base58(b"\x80" + KEY[0], b"x"), base58(b"\x80" + OVER), base58(b"\x80" + bytes(32)), base58(b"\x81" + KEY[1]), base58(b"\x80" + KEY[1] + b"\x02"), swapped(WIFS[3], 20), WIFS[0][:-1] + "l", "", "5" * 51],
    "xprv": [base58(bytes.fromhex("0488b21e") + HEAD[:41] + b"\0" + KEY[0]), base58(bytes.fromhex("0488ade4") + HEAD[:41] + b"\1" + KEY[0]), base58(bytes.fromhex("0488ade4") + HEAD[:41] + b"\0" + OVER), swapped(XPRVS[0], 50), XPRVS[0][:-1], ""],
}
CHECKS = {"wif": checks.WIF, "xprv": checks.XPRV}


@pytest.mark.parametrize("kind", ["wif", "xprv"])
def test_good_keys_pass_and_near_misses_do_not_in_both_engines(spark, kind):
    values = list(dict.fromkeys(GOOD[kind] + BAD[kind]))
    want = {v: v in GOOD[kind] for v in values}
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert {r["v"]: r["ok"] for r in df.select("v", CHECKS[kind].column(F.col("v")).alias("ok")).collect()} == want
    con = duckdb.connect()
    con.execute("CREATE TABLE t (v VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [(v,) for v in values])
    assert dict(con.execute(f"SELECT v, {CHECKS[kind].sql('v')} FROM t").fetchall()) == want


def test_the_rules_find_keys_in_text(spark):
    texts = [(0, f"import {WIFS[0]}, then"), (1, f"key={XPRVS[3]}\n"), (2, f"typo {swapped(WIFS[0], 9)}"), (3, f"a{WIFS[0]}")]
    df = spark.createDataFrame(texts, "i int, text string")
    got = {(r["i"], r["rule"], r["value"]) for r in detect.findings(df, "i").collect()}
    assert {x for x in got if x[1].startswith("crypto")} == {(0, "crypto-wif-private-key", WIFS[0]), (1, "crypto-extended-private-key", XPRVS[3])}
