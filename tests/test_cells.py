"""Cells of tables: numbers of one digit repeated, and cells far to the right."""

import pytest

from quellspan.operators import grids, records

TABLES = {
    "csv-personal-column": "full_name,customer_id\nAnna Rossi,{0}\nBoris Jensen,700001\n",
    "sql-insert-personal-column": "INSERT INTO p (full_name, customer_id) VALUES ('Anna Rossi', '{0}'), ('Boris Jensen', '700001');",
    "html-table-personal-column": "<table><tr><th>full_name</th><th>customer_id</th></tr><tr><td>Anna Rossi</td><td>{0}</td></tr><tr><td>Boris Jensen</td><td>700001</td></tr></table>",
}


@pytest.mark.parametrize("rule", TABLES)
def test_a_number_of_one_digit_repeated_is_a_number_and_zeros_are_none(spark, rule):
    df = spark.createDataFrame([(n, TABLES[rule].format(n)) for n in ("777777", "1111111", "000000")], "n string, text string")
    found = {(r["n"], r["value"]) for r in grids.findings(df, "n", rules=(rule,)).where("type = 'ID_NUMBER'").collect()}
    assert found == {("777777", "777777"), ("1111111", "1111111"), *((n, "700001") for n in ("777777", "1111111", "000000"))}


def test_a_label_line_takes_such_a_number(spark):
    df = spark.createDataFrame([(1, "Customer id =\n  999999\n")], "i int, text string")
    assert [r["value"] for r in records.labelled_lines(df, "i").collect()] == ["999999"]


def test_cells_keep_the_digits_of_their_place(spark):
    line = " | ".join([*"abcdef", "6 of 6", "x", "y", "z", "1 x 10 ", "1x11"])
    df = spark.createDataFrame([(1, line)], "doc_id int, text string")
    got = [r["cell"] for r in records.pipe_cells(df, "doc_id", "text").orderBy("position").collect()]
    assert got == [*"abcdef", "6 of 6", "x", "y", "z", "1 x 10", "1x11"]
