"""Texts that are derived from the given tables, for operators that documents hold too few values for: tables of persons
made from customers, and documents in which values are disguised. The SQL beside each says the same in DuckDB, and where
every cell must be found: by adding up the lengths of what is written, not by parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellspan.operators.masking import base64_line

FIRST = ("Anna", "Boris", "Clara", "David", "Elena", "Farid", "Greta", "Henry")
LAST = ("Okafor", "Schmidt", "Moreau", "Castillo", "O'Neil", "Jensen", "Rossi")
ROWS_PER_TEXT = 100
FIELDS = ("full_name", "phone", "address", "customer_id")

#: By format: the head of a text, what stands before, between and behind the cells of a row, and the end of a text.
FORMATS = {
    "csv": ("full_name,phone,address,customer_id\n", ("", ",", ",", ",", "\n"), ""),
    "insert": ("INSERT INTO people (full_name, phone, address, customer_id) VALUES ", ("('", "', '", "', '", "', ", "), "), ";"),
    "html": (
        "<p>people</p><table><tr><th>full_name</th><th>phone</th><th>address</th><th>customer_id</th></tr>",
        ("<tr><td>", "</td><td><b>", "</b></td><td>", "</td><td class='id'>", "</td></tr>"),
        "</table>",
    ),
    "form": ("Members\n\n", ("Full name:\n", "\n\nPhone:\n\n", "\nNote:\n", "\nCustomer id =\n  ", "\n\n"), ""),
}


def people(customers: DataFrame) -> DataFrame:
    """``(k, full_name, phone, address, customer_id)``; every eleventh has no name."""
    k = F.col("c_custkey")
    pick = lambda words: F.get(F.array(*[F.lit(w) for w in words]), (k % len(words)).cast("int"))
    number = (k % 900 + 10).cast("string")
    address = F.when(k % 3 == 0, F.concat(number, F.lit(' Harbor Street, Unit "'), F.col("c_mktsegment"), F.lit('"'))).when(k % 3 == 1, F.concat(number, F.lit(" Mill Road\nRear"))).otherwise(F.concat(number, F.lit(" Elm Avenue")))
    return customers.select(
        k.alias("k"),
        F.when(k % 11 == 0, "n/a").otherwise(F.concat(pick(FIRST), F.lit(" "), pick(LAST))).alias("full_name"),
        F.concat(F.lit("+1 212 555 "), F.lpad((k % 10000).cast("string"), 4, "0")).alias("phone"),
        address.alias("address"),
        (k + 700000).cast("string").alias("customer_id"),
    )


def tables(customers: DataFrame, kind: str) -> DataFrame:
    """``(text_id, text)``: a table of up to a hundred persons each."""
    head, marks, end = FORMATS[kind]
    said = {f: F.col(f) for f in FIELDS}
    if kind == "csv":
        said["address"] = F.when(F.col("address").rlike('[,"\n]'), F.concat(F.lit('"'), F.replace("address", F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col("address"))
    if kind == "insert":
        said["full_name"] = F.replace("full_name", F.lit("'"), F.lit("''"))
    row = F.concat(F.lit(marks[0]), *[x for f, mark in zip(FIELDS, marks[1:]) for x in (said[f], F.lit(mark))])
    rows = people(customers).select(F.floor(F.col("k") / ROWS_PER_TEXT).alias("text_id"), F.struct("k", row.alias("row")).alias("x"))
    grouped = rows.groupBy("text_id").agg(F.array_sort(F.collect_list("x")).alias("rows"))  # of a hundred rows at most
    return grouped.select("text_id", F.concat(F.lit(head), F.array_join(F.transform("rows", lambda x: x["row"]), ""), F.lit(end)).alias("text"))


def _text(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def tables_sql(kind: str, rule: str, types: tuple[str, ...] = ("NAME", "PHONE", "ADDRESS", "ID_NUMBER")) -> str:
    """Where the cells of these types of :func:`tables` stand."""
    head, marks, _ = FORMATS[kind]
    pick = lambda words: f"[{', '.join(map(_text, words))}][k % {len(words)} + 1]"
    name, address, quoted = "full_name", "address", "0"
    if kind == "csv":
        quoted = "CAST(contains(address, ',') OR contains(address, '\"') OR contains(address, chr(10)) AS INTEGER)"
        address = f"replace(address, '\"', repeat('\"', 1 + {quoted}))"
    if kind == "insert":
        name = "replace(full_name, '''', '''''')"
    widths = ["length(name)", "length(phone)", "length(home) + 2 * quoted", "length(customer_id)"]
    before = [f"{sum(map(len, marks[: i + 1]))} + {' + '.join(widths[:i]) or '0'}" for i in range(4)]
    cells = [("NAME", "name", before[0], "full_name <> 'n/a'"), ("PHONE", "phone", before[1], "TRUE"), ("ADDRESS", "home", f"{before[2]} + quoted", "TRUE"), ("ID_NUMBER", "customer_id", before[3], "TRUE")]
    union = " UNION ALL ".join(f"SELECT text_id, begin + {at} AS \"start\", begin + {at} + length({v}) AS \"end\", '{t}' AS type, {v} AS value FROM placed WHERE {ok}" for t, v, at, ok in cells if t in types)
    return f"""WITH keyed AS (SELECT c_custkey AS k, c_mktsegment FROM customer),
people AS (SELECT k, CASE WHEN k % 11 = 0 THEN 'n/a' ELSE {pick(FIRST)} || ' ' || {pick(LAST)} END AS full_name, '+1 212 555 ' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') AS phone,
CASE k % 3 WHEN 0 THEN (k % 900 + 10) || ' Harbor Street, Unit "' || c_mktsegment || '"' WHEN 1 THEN (k % 900 + 10) || ' Mill Road' || chr(10) || 'Rear' ELSE (k % 900 + 10) || ' Elm Avenue' END AS address, CAST(k + 700000 AS VARCHAR) AS customer_id FROM keyed),
said AS (SELECT k, k // {ROWS_PER_TEXT} AS text_id, full_name, {name} AS name, phone, {address} AS home, {quoted} AS quoted, customer_id FROM people),
sized AS (SELECT *, {sum(map(len, marks))} + {' + '.join(widths)} AS size FROM said),
placed AS (SELECT *, {len(head)} + coalesce(sum(size) OVER (PARTITION BY text_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM sized)
SELECT text_id, CAST("start" AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end", '{rule}' AS rule, type, value FROM ({union})"""


#: What disguises values: a pattern, and what stands after its match, or in its place.
DISGUISES = (
    (r'(token = "[0-9a-f]{9})', 1, "​"),
    (r"(\+1 \([0-9]{2})", 1, "\x1b[1m"),
    (r"([0-9]{8})", 1, "⁠"),
    ("@", 0, "&#64;"),
)


def disguised(documents: DataFrame) -> DataFrame:
    """``(doc_id, text)``: documents whose tokens, phone and card numbers and addresses are split or written as entities."""
    text = F.coalesce("text", F.lit(""))
    for pattern, group, put in DISGUISES:
        text = F.regexp_replace(text, pattern, ("$1" if group else "") + put)
    return documents.select("doc_id", text.alias("text"))


def disguised_sql(text: str = "text") -> str:
    out = f"coalesce({text}, '')"
    for pattern, group, put in DISGUISES:
        out = f"regexp_replace({out}, '{pattern}', '{chr(92) + '1' if group else ''}{put}', 'g')"
    return out


def records(documents: DataFrame) -> DataFrame:
    """``(doc_id, text)``: documents as JSON: the text as a field, in two nodes of a list of content, and once more."""
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    nodes = F.array(*[F.struct(x.alias("text")) for x in (F.substring(text, F.lit(1), half), text.substr(half + 1, F.length(text)))])
    record = F.struct(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("source"), text.alias("body"), nodes.alias("content"), F.struct(text.alias("body")).alias("again"))
    return documents.select("doc_id", F.to_json(record).alias("text"))


def dialogues(conversations: DataFrame) -> DataFrame:
    """``(conv_id, text)``: each conversation as a JSON object of its turns, in order."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    said = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return rows.withColumn("turns", said).select("conv_id", F.to_json(F.struct(F.col("conv_id").alias("conv"), "turns")).alias("text"))


def escaped_sql(x: str) -> str:
    for plain, put in (("'\\'", "'\\\\'"), ("'\"'", "'\\\"'"), ("chr(10)", "'\\n'"), ("chr(9)", "'\\t'"), ("chr(13)", "'\\r'")):
        x = f"replace({x}, {plain}, {put})"
    return x


def dialogues_sql() -> str:
    """The leaves of :func:`dialogues`: the places by adding up what stands before."""
    turn = f"""'{{"role":"' || {escaped_sql("role")} || '","text":"' || {escaped_sql("text")} || '"}}'"""
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
placed AS (SELECT *, row_number() OVER w - 1 AS i, length('{{"conv":' || conv_id || ',"turns":[') + coalesce(sum(length({turn}) + 1) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
cells AS (SELECT conv_id, 'turns.' || i || '.role' AS path, begin + 9 AS s, length({escaped_sql("role")}) AS n, role AS value FROM placed
UNION ALL SELECT conv_id, 'turns.' || i || '.text', begin + 9 + length({escaped_sql("role")}) + 10, length({escaped_sql("text")}), text FROM placed
UNION ALL SELECT DISTINCT conv_id, 'conv', 8, length(CAST(conv_id AS VARCHAR)), CAST(conv_id AS VARCHAR) FROM t)
SELECT conv_id, path, CAST(s AS BIGINT) AS "start", CAST(s + n AS BIGINT) AS "end", sha256(value) AS digest FROM cells"""


def records_sql(findings) -> str:
    """Findings of :func:`records`: those of the text and of its halves, moved to where their characters are written.
    ``findings(table, key)``: a query of the findings of a table's column ``body``."""
    esc = lambda part: f"length({escaped_sql(part)})"
    at = lambda base, text, n: f"{base} + {esc(f'substr({text}, 1, CAST({n} AS BIGINT))')}"
    return f"""WITH docs AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS body, length(coalesce(text, '')) // 2 AS half FROM documents),
halves AS (SELECT doc_id, 0 AS node, substr(body, 1, half) AS body FROM docs UNION ALL SELECT doc_id, 1, substr(body, half + 1) FROM docs),
b1 AS (SELECT *, length('{{"id":' || doc_id || ',"source":"') + {esc("source")} + 10 AS base FROM docs),
b2 AS (SELECT *, base + {esc("body")} + 22 AS base0 FROM b1),
b3 AS (SELECT *, base0 + {esc("substr(body, 1, half)")} + 12 AS base1 FROM b2),
bases AS (SELECT *, base1 + {esc("substr(body, half + 1)")} + 21 AS base2 FROM b3),
whole AS ({findings("docs", "doc_id")}),
parts AS ({findings("halves", "doc_id, node")}),
own AS (SELECT doc_id, node, "start" AS s, "end" AS e, rule, type FROM parts),
over AS (SELECT doc_id, node, greatest("start", lo) - lo AS s, least("end", hi) - lo AS e, rule, type FROM (SELECT w.*, 0 AS node, 0 AS lo, half AS hi FROM whole w JOIN docs USING (doc_id) UNION ALL SELECT w.*, 1, half, length(body) FROM whole w JOIN docs USING (doc_id)) WHERE greatest("start", lo) < least("end", hi)),
nodes AS (SELECT * FROM own UNION ALL SELECT * FROM over o WHERE NOT EXISTS (SELECT 1 FROM own p WHERE p.doc_id = o.doc_id AND p.node = o.node AND p.s = o.s AND p.e = o.e AND p.type = o.type)),
moved AS (SELECT doc_id, 'body' AS path, {at("base", "body", '"start"')} AS s, {at("base", "body", '"end"')} AS e, rule, type FROM whole JOIN bases USING (doc_id)
UNION ALL SELECT doc_id, 'again.body', {at("base2", "body", '"start"')}, {at("base2", "body", '"end"')}, rule, type FROM whole JOIN bases USING (doc_id)
UNION ALL SELECT n.doc_id, 'content.' || n.node || '.text', CASE n.node WHEN 0 THEN base0 ELSE base1 END + {esc("substr(h.body, 1, CAST(n.s AS BIGINT))")}, CASE n.node WHEN 0 THEN base0 ELSE base1 END + {esc("substr(h.body, 1, CAST(n.e AS BIGINT))")}, rule, type FROM nodes n JOIN bases USING (doc_id) JOIN halves h ON h.doc_id = n.doc_id AND h.node = n.node)
SELECT doc_id, path, CAST(s AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end", rule, type FROM moved"""


#: Characters of a document that are encoded: fewer bytes than the longest run that is decoded, also when encoded twice.
ENCODED = 300


def encoded(documents: DataFrame) -> DataFrame:
    """``(doc_id, text)``: the start of each document in Base64, in hex, and in Base64 twice."""
    start = F.substring(F.coalesce("text", F.lit("")), 1, ENCODED)
    once = base64_line(F.encode(start, "UTF-8"))
    return documents.select("doc_id", F.concat(F.lit("a "), once, F.lit(" b "), F.lower(F.hex(F.encode(start, "UTF-8"))), F.lit(" c "), base64_line(F.encode(once, "UTF-8"))).alias("text"))


def encoded_sql(findings) -> str:
    """The findings of those starts, each told of all three runs."""
    return f"""WITH starts AS (SELECT doc_id, substr(coalesce(text, ''), 1, {ENCODED}) AS body FROM documents),
sizes AS (SELECT doc_id, length(to_base64(encode(body))) AS one, 2 * octet_length(encode(body)) AS two, length(to_base64(encode(to_base64(encode(body))))) AS three FROM starts WHERE octet_length(encode(body)) >= 18),
found AS ({findings("starts", "doc_id")}),
places AS (SELECT doc_id, 2 AS s, 2 + one AS e FROM sizes UNION ALL SELECT doc_id, 5 + one, 5 + one + two FROM sizes UNION ALL SELECT doc_id, 8 + one + two, 8 + one + two + three FROM sizes)
SELECT doc_id, CAST(s AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end", rule, type FROM found JOIN places USING (doc_id)"""


#: Lines of letters: companies with their numbers, with a person in front, an employer's, a person's, and one of no company.
LETTERS = (
    ("Nordwind-", " GmbH, Hafenstraße 7, 20095 Hamburg, USt-IdNr.: DE136695976"),
    ("Frau Dr. Anna Weiß, Nordwind-", " AG, Am Hafen 7, 20097 Hamburg, USt-IdNr.: DE136695976"),
    ("Arbeitgeber: Nordwind-", " KG, Hafenstraße 7, 20099 Hamburg"),
    ("Herr Otto Brandt\nKunde ", ", Hafenstraße 8, 10115 Berlin"),
    ("Nordwind-", " Ltd.\nAn der Alster 9\n80331 München"),
    ("Konto ", " mit USt-IdNr.: DE136695976 von heute"),
)
LETTERS_PER_TEXT = 40


def letters(customers: DataFrame) -> DataFrame:
    """``(text_id, text)``: forty such paragraphs each, one per customer."""
    k = F.col("c_custkey")
    of = lambda at: F.get(F.array(*[F.lit(x[at]) for x in LETTERS]), (k % len(LETTERS)).cast("int"))
    rows = customers.select(F.floor(k / LETTERS_PER_TEXT).alias("text_id"), F.struct(k.alias("k"), F.concat(of(0), k.cast("string"), of(1)).alias("row")).alias("x"))
    grouped = rows.groupBy("text_id").agg(F.array_sort(F.collect_list("x")).alias("rows"))  # of forty rows at most
    return grouped.select("text_id", F.array_join(F.transform("rows", lambda x: x["row"]), "\n\n").alias("text"))


def letters_sql() -> str:
    of = lambda at: f"[{', '.join(_text(x[at]) for x in LETTERS)}][c_custkey % {len(LETTERS)} + 1]"
    return f"SELECT c_custkey // {LETTERS_PER_TEXT} AS text_id, string_agg({of(0)} || CAST(c_custkey AS VARCHAR) || {of(1)}, chr(10) || chr(10) ORDER BY c_custkey) AS text FROM customer GROUP BY ALL"
