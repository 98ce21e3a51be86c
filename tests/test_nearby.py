import random

import pytest

from quellspan.operators import nearby
from quellspan.operators.rules import chosen

RULES = (*chosen(ids=("de-vat-id", "name-after-german-title")), nearby.POSTCODE)
VAT = "DE136695976"


def rows(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return {(r["i"], r["type"], r["value"]): r["released"] for r in nearby.released(df, "i", rules=RULES).collect() if r["type"] in nearby.NUMBERS}


@pytest.mark.parametrize("head, free", [("", True), ("Rechnung an\n", True), ("Frau Dr. Anna Weiß, ", False), ("Frau Dr. Anna Weiß\n\n", True), ("Arbeitgeber: ", False)])
def test_a_company_address_releases_its_numbers(spark, head, free):
    got = rows(spark, [f"{head}Nordwind Handel GmbH, Am Hafen 12, 20095 Hamburg, USt-IdNr.: {VAT}"])
    assert got == {(0, "DE_PLZ", "20095 Hamburg"): free, (0, "DE_VAT_ID", VAT): free}


def test_what_is_no_company_address_keeps_its_numbers(spark):
    texts = [
        "Anna, Am Hafen 12, 20095 Hamburg",
        f"Nordwind Handel GmbH, Am Hafen 12, 20095 Hamburg, Konto 7, USt-IdNr.: {VAT}",
        "Nordwind GmbH hat geschrieben. Am Hafen 12, 20095 Hamburg",
        "",
        None,
    ]
    got = rows(spark, texts)
    assert got == {(0, "DE_PLZ", "20095 Hamburg"): False, (1, "DE_PLZ", "20095 Hamburg"): True, (1, "DE_VAT_ID", VAT): False, (2, "DE_PLZ", "20095 Hamburg"): False}


def test_the_range_join_equals_all_pairs_in_reach(spark):
    rng = random.Random(2)
    left = [(rng.randrange(3), rng.randrange(4000)) for _ in range(200)]
    right = [(rng.randrange(3), rng.randrange(4000), i) for i in range(200)] + [(None, 5, 900), (1, None, 901)]
    got = nearby.within(spark.createDataFrame(left, "k int, start long"), spark.createDataFrame(right, "k int, start long, id int"), ["k"], 300)
    want = sorted((k, s, o, i) for k, s in left for k2, o, i in right if k == k2 and o is not None and s - 300 <= o <= s)
    assert sorted((r["k"], r["start"], r["other_start"], r["other_id"]) for r in got.collect()) == want
