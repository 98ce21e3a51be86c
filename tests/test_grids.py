"""Tables inside texts: places of cells against plain parsers, and the policy of personal columns."""

import csv
import io
import random

import pytest

from quellspan.operators import grids

HEADER = ["full_name", "phone", "notes", "customer_id"]


def written_csv(rows, sep=",", end="\n"):
    """The CSV text of rows and each cell's place, written cell by cell."""
    text, places = "", []
    for row in rows:
        for i, value in enumerate(row):
            quote = any(c in value for c in f'{sep}"\n') or value.startswith(" ")
            said = value.replace('"', '""') if quote else value
            start = len(text) + quote
            places.append((start, start + len(said)))
            text += ('"' + said + '"' if quote else said) + (sep if i < len(row) - 1 else end)
    return text, places


@pytest.mark.parametrize(("sep", "end"), [(",", "\n"), (";", "\r\n"), ("\t", "\n")])
def test_csv_cells(spark, sep, end):
    rng = random.Random(9)
    parts = ["a", "B c", '"', '""', sep, "\n", "é🙂", "1", "  x", "'", "|"]
    texts, want = [], {}
    for k in range(25):
        rows = [HEADER] + [["".join(rng.choice(parts) for _ in range(rng.randint(0, 5))).strip(" \n") for _ in HEADER] for _ in range(rng.randint(1, 12))]
        text, places = written_csv(rows, sep, end)
        assert [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep)] == rows
        texts.append((k, text))
        want[k] = [(n // 4 - 1, HEADER[n % 4], *p) for n, p in enumerate(places)][4:]
    got = {k: [] for k in want}
    for r in grids.cells(spark.createDataFrame(texts, "k int, text string"), "k", rows=grids.csv_rows).collect():
        got[r["k"]].append((r["row"], r["name"], r["start"], r["end"]))
    # a row that is empty but for separators stays a row; places of empty cells are where they would begin
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def found(spark, text, **options):
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "no table, here")], "k int, text string")
    return sorted((r["start"], r["end"], r["type"], r["value"]) for r in grids.findings(df, "k", **options).where("k = 1").collect()), grids.findings(df, "k", **options).where("k > 1").count()


def spans(text, *values):
    out = []
    for kind, value in values:
        at = text.index(value)
        out.append((at, at + len(value), kind, value))
    return sorted(out)


CASES = {
    "csv": (
        'before\n\nfull_name,phone,street_address,dob\nDana Okafor,+1 212 555 0123,"12 Harbor Street, Unit ""B""\nRear",1984-02-29\nFront Desk Team,12,somewhere,soon\n\nafter,all\n',
        [("NAME", "Dana Okafor"), ("PHONE", "+1 212 555 0123"), ("ADDRESS", '12 Harbor Street, Unit ""B""\nRear'), ("BIRTH_DATE", "1984-02-29")],
    ),
    "csv of depots": ("name;address\nDepot;12 Harbor Street\nStore;14 Harbor Street\n", []),
    "csv of products": ("name,price\nRed Chair,12.00\n", []),
    "semicolons": ("vorname;nachname;telefon\nAnna;Schmidt;030 1234567\n", [("NAME", "Anna"), ("NAME", "Schmidt"), ("PHONE", "030 1234567")]),
    "accounts": ("| Product | Account Number |\n|---|---|\n| Loan | 12345678 90 |\n", [("ID_NUMBER", "12345678 90")]),
    "pipes": (
        "text\n\n| **Full Name** | Date of Birth | Phone Number |\n| --- | --- | --- |\n| Dana Okafor | 02/03/1984 | **212-555-0123** |\n| n/a | - | 5 |\nplain\n",
        [("NAME", "Dana Okafor"), ("BIRTH_DATE", "02/03/1984"), ("PHONE", "212-555-0123")],
    ),
    "insert": (
        "x; INSERT INTO `people` (id, full_name, street, dob) VALUES (1, 'Dana O''Neil', '12 Harbor, (rear) Street', '1984-02-29'),\n (2, 'Ann Lee', NULL, '1990-12-01'); select 1",
        [("NAME", "Dana O''Neil"), ("ADDRESS", "12 Harbor, (rear) Street"), ("BIRTH_DATE", "1984-02-29"), ("NAME", "Ann Lee"), ("BIRTH_DATE", "1990-12-01")],
    ),
    "html": (
        "<p>x</p><TABLE class='a'><tr><th>Full name</th><th>Phone</th><th>E-mail</th></tr><tr><td> <b>Dana Okafor</b> </td><td><a href='tel:1'>212 555 0123</a></td><td>x</td></tr><tr><td>Ann <i>Lee</i></td><td>212 555 0199</td><td>y</td></tr></table>",
        [("NAME", "Dana Okafor"), ("PHONE", "212 555 0123")],
    ),
    "passwords": ("host,username,password\ndb1,dana,Tr0ub4dor-3x\n", [("SECRET", "Tr0ub4dor-3x")]),
    "width changes": ("full_name,phone\nDana Okafor,212 555 0123\nAnn Lee,212 555 0199,more\nJo Mei,212 555 0177\n", [("NAME", "Dana Okafor"), ("PHONE", "212 555 0123")]),
}


@pytest.mark.parametrize("name", CASES)
def test_policy(spark, name):
    text, values = CASES[name]
    got, others = found(spark, text)
    assert got == spans(text, *values) and others == 0


def test_long_cells_and_tables(spark):
    """A quoted cell of 200,000 characters, and 5,000 rows, in one text."""
    rows = [["full_name", "phone", "notes"], ["Dana Okafor", "212 555 0123", "a,b " * 50_000]] + [["Ann Lee", f"212 555 {i:04}", "x"] for i in range(1, 5000)]
    text, _ = written_csv(rows)
    got, _ = found(spark, text, rules=("csv-personal-column",))
    assert len(got) == 10_000 - 2 * 0 and all(text[a:b] == v for a, b, _, v in got)
