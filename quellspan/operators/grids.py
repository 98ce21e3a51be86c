"""Tables inside texts: CSV, pipe tables, SQL INSERTs and HTML tables, with the place of every cell, and one policy for all.

A text is cut into tokens by one expression per format that has the format's states in it (inside quotes, doubled quotes,
line breaks in cells), so that the tokens together are the text; where each begins is a running sum of their lengths. Tokens
become cells, cells rows, and rows belong to the last header above them while their width stays. Each row then is a list of
column names and cells, whatever its format, and the policy reads those: personal columns are told by their names, cells by
checks of their type, and a row counts only if it holds a person: an address list of depots has none.

All of it happens inside the row of a text: no shuffle and no Python. Null texts have no cells. Positions are in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quellspan.functions.spans import let, mapped, marked, measured, scanned, starts, unmarked

CELL = "struct<start:bigint,end:bigint,value:string>"
GRID = f"array<struct<names:array<string>,cells:array<{CELL}>>>"

#: How columns of personal data are named, by type; the names are compared in lower case, words joined by ``_``.
COLUMNS = {
    "NAME": "name full_name fullname customer_name client_name employee_name patient_name contact_name member_name student_name vollstandiger_name nombre_completo nom_complet",
    "FIRST_NAME": "first_name firstname given_name forename vorname nombre prenom fname",
    "LAST_NAME": "last_name lastname surname family_name nachname familienname apellido apellidos nom_de_famille lname",
    "USERNAME": "username user_name login_name user benutzername usuario",
    "ADDRESS": "address street street_address home_address billing_address shipping_address mailing_address postal_address adresse anschrift strasse direccion",
    "BIRTH_DATE": "dob date_of_birth birth_date birthdate birthday geburtsdatum fecha_de_nacimiento date_de_naissance",
    "PHONE": "phone phone_number telephone telephone_number mobile mobile_phone mobile_number cell_phone telefon telefono telefonnummer",
    "ID_NUMBER": "ssn social_security_number national_id tax_id passport_number passport_no driver_license_number mrn medical_record_number patient_id member_id customer_id employee_id",
    "ACCOUNT": "account_number account_no bank_account_number acct_number kontonummer iban",
    "SECRET": "password passwd pwd passwort contrasena mot_de_passe secret api_key",
}
NAMES = {name: kind for kind, names in COLUMNS.items() for name in names.split()}
STRONG = ("ADDRESS", "BIRTH_DATE", "PHONE", "ID_NUMBER")
WEAK = ("NAME", "FIRST_NAME", "LAST_NAME", "USERNAME")
#: What a finding of a column is called, where it isn't the column's own type.
TYPES = {"FIRST_NAME": "NAME", "LAST_NAME": "NAME", "ACCOUNT": "ID_NUMBER"}
NOT_A_CELL = ("", "null", "none", "n/a", "na", "-", "true", "false", "nan", "unknown")
DATE = r"(?:(?:19|20)[0-9]{2}[-/.](?:0?[1-9]|1[0-2])[-/.](?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[-/.](?:0?[1-9]|1[0-2]|[12][0-9]|3[01])[-/.](?:19|20)[0-9]{2})"
NAME_WORD = r"\p{Lu}[\p{L}'’-]+"


def column_kind(header: Column) -> Column:
    """What a column of this name holds; null where it isn't personal."""
    name = F.regexp_replace(F.lower(F.trim(F.regexp_replace(header, r"\([^)]*\)\s*$|[*`_'\"]+$|^[*`_'\"]+", ""))), r"[\s/.\\-]+", "_")
    name = F.translate(F.translate(name, "áàâäéèêíóôöúüñ", "aaaaeeeiooouun"), "ß", "s")
    return F.try_element_at(mapped(NAMES), name)


def fits(kind: Column, value: Column) -> Column:
    """Whether a cell holds what its column names."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    same = value.rlike(r"^[^0-9]*([0-9])(?:[^0-9]*\1)*[^0-9]*$")
    ok = (
        F.when(kind == "PHONE", (digits >= 7) & ~same)
        .when(kind == "BIRTH_DATE", value.rlike(f"^{DATE}$"))
        .when(kind == "ADDRESS", (digits >= 1) & (F.length(value) >= 8) & value.rlike(r"\s") & value.rlike(r"\p{L}{3}") & ~value.rlike(r"://|:[0-9]{2,5}\b|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b"))
        .when(kind == "NAME", value.rlike(rf"^{NAME_WORD}(?: (?:\p{{Lu}}\.|{NAME_WORD}))* {NAME_WORD}$"))
        .when(kind.isin("FIRST_NAME", "LAST_NAME"), value.rlike(rf"^{NAME_WORD}(?:[ -]{NAME_WORD})?$"))
        .when(kind == "USERNAME", value.rlike(r"^\S{2,64}$") & ~value.rlike(r"(?i)^(?:no-?reply|support|info|admin|root|git|bot|ci|build|deploy|test\w*|dummy\w*|sample\w*)$"))
        .when(kind == "ACCOUNT", value.rlike(r"^[A-Z]{0,2}[0-9][0-9A-Z -]*$") & digits.between(8, 30) & ~same)
        .when(kind == "SECRET", value.rlike(r"^\S{6,}$") & ~value.rlike(r"^[*x•]+$"))
        .otherwise((digits >= 5) & value.rlike("[1-9]"))  # numbers given out in turn come to 777777 as well
    )
    return ~F.lower(value).isin(*NOT_A_CELL) & ok


# ---- formats to rows -------------------------------------------------------------------------------------------------------

#: Tokens: a cell and what ends it. A quoted cell may hold anything, quotes doubled; a cell that isn't ends at the line's end.
_CSV = r'(?:[ ]*+"[^"]*+(?:""[^"]*+)*+"[ ]*+\r?|[^{0}\n]*+)(?:{0}|\n|\z)'
_PIPE = r"(?:[^|\n\\]|\\.|\\(?=\n))*+(?:\||\n|\z)"
_TUPLE = r"\((?:[^'()]++|'[^']*+(?:''[^']*+)*+')*+\)"
_INSERT = r"(?i)insert\s+into\s+[\w.`\"\[\]]{1,128}\s*\([^()]{1,2000}\)\s*values\s*" + rf"{_TUPLE}(?:\s*+,\s*+{_TUPLE})*+"
_INSERT_CELL = r"\s*+,?\s*+\(?\s*+(?:'[^']*+(?:''[^']*+)*+'|[^',()]*+)\s*+(?:,(?!\s*\()|\)|\z)"
_TABLE = r"(?is)<table\b[^>]*+>.*?</table>"
_HTML = r"(?is)<t[hd]\b[^>]*+>.*?</t[hd]\s*>|</tr\s*>|<[^>]*+>|[^<]++|<"


def _spans(tokens: Column, offset: Column, body) -> Column:
    """Cells of tokens that stand one after the other from ``offset`` on; ``body``: (lead, value) of a token, as strings."""

    def cells(t):
        def cell(at):
            def one(x, i):
                lead, value = body(x)
                start = offset + F.get(at, i) + F.length(lead)
                return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))

            return F.transform(t, one)

        return let(starts(F.transform(t, F.length)), cell)

    return let(tokens, cells)


def _rows(cells: Column, last: Column) -> Column:
    """Cells as rows; ``last``: whether each is its row's last."""

    def cut(c):
        ends = F.filter(F.transform(c, lambda x, i: F.when(F.get(last, i) | (i == F.size(c) - 1), i)), lambda i: i.isNotNull())
        return let(ends, lambda e: F.transform(e, lambda at, k: let(F.coalesce(F.get(e, k - 1) + 1, F.lit(0)), lambda a: F.slice(c, a + 1, at - a + 1))))

    return let(cells, cut)


def _headed(rows: Column, header) -> Column:
    """Rows with the names of the last header above them, while their width stays; ``header``: whether a row is one."""

    def under(r):
        heads = F.transform(r, lambda row, i: F.when(header(row), i).otherwise(-1))
        turns = F.transform(r, lambda row, i: F.when(F.size(row) != F.coalesce(F.size(F.get(r, i - 1)), F.lit(-1)), i).otherwise(-1))
        latest = lambda v: scanned(v, F.lit(-1), lambda a, x: F.greatest(a, x))

        def told(h):
            def row(i, top, turn, cells):
                holds = (top >= 0) & (F.greatest(turn, F.get(h["turns"], i)) <= top) & (F.get(h["heads"], i) < 0)
                return F.when(holds, F.struct(F.transform(F.get(r, top.cast("int")), lambda c: c["value"]).alias("names"), cells.alias("cells")))

            both = F.arrays_zip(latest(h["heads"]).alias("top"), latest(h["turns"]).alias("turn"), r.alias("cells"))
            return F.filter(F.transform(both, lambda x, i: row(i, x["top"], x["turn"], x["cells"])), lambda x: x.isNotNull())

        return let(F.struct(heads.alias("heads"), turns.alias("turns")), told)

    return let(rows, under)


def _named(row: Column, spaces: bool) -> Column:
    """Whether a row is a header: two cells or more, each a name without digits at its start, one of them personal."""
    shape = r"^\s*[*`_]*\p{L}[\p{L}\p{N} _./()'-]{0,64}[*`_]*\s*$|^\s*$" if spaces else r"^[\p{L}_][\p{L}\p{N}_.-]{0,64}$"
    return (F.size(row) >= 2) & F.forall(row, lambda c: c["value"].rlike(shape)) & F.exists(row, lambda c: column_kind(c["value"]).isNotNull())


def _csv(text: Column, sep: str) -> Column:
    """Rows of a text with this separator."""
    token = _CSV.replace("{0}", sep)

    def body(x):
        cell = F.regexp_replace(x, rf"\r?(?:{sep}|\n)?\z", "")
        quoted = cell.rlike(r'(?s)^ *"(?:[^"]|"")*+" *$')
        lead = F.when(quoted, F.regexp_extract(cell, '^ *"', 0)).otherwise(F.regexp_extract(cell, "^ *", 0))
        return lead, F.when(quoted, F.regexp_extract(cell, r'(?s)^ *"(.*)" *$', 1)).otherwise(F.trim(cell))

    def rows(t):
        return _rows(_spans(t, F.lit(0).cast("bigint"), body), F.transform(t, lambda x: x.endswith("\n") & ~x.rlike(rf"{sep}\z")))

    return _headed(let(F.regexp_extract_all(text, F.lit(token), F.lit(0)), rows), lambda row: _named(row, False))


def _gated(text: Column, sep: str, rows: Column) -> Column:
    """Rows of texts in which a personal column's name stands beside the separator; others aren't cut at all."""
    name = "|".join(sorted(n.replace("_", "[_ -]") for n in NAMES))
    return F.when(text.rlike(rf"(?i)(?:(?:^|\n|{sep})[ \t\"*`]*(?:{name})[ \t\"*`]*{sep}|{sep}[ \t\"*`]*(?:{name})[ \t\"*`]*(?:\r?\n|{sep}))"), rows).otherwise(F.array().cast(GRID))


def csv_rows(text: Column) -> Column:
    """Rows of CSV tables with commas, semicolons or tabs, cells with their places."""
    return F.concat(*[_gated(text, sep, _csv(text, sep)) for sep in (",", ";", "\t")])


def pipe_rows(text: Column) -> Column:
    """Rows of pipe tables; names of columns may hold spaces and marks of emphasis."""

    def body(x):
        cell = F.regexp_replace(x, r"\r?[|\n]?\z", "")
        return F.regexp_extract(cell, r"^[\s*`]*", 0), F.regexp_replace(cell, r"^[\s*`]+|[\s*`]+$", "")

    def rows(t):
        return _rows(_spans(t, F.lit(0).cast("bigint"), body), F.transform(t, lambda x: x.endswith("\n")))

    return _gated(text, r"\|", _headed(let(F.regexp_extract_all(text, F.lit(_PIPE), F.lit(0)), rows), lambda row: _named(row, True)))


def insert_rows(text: Column) -> Column:
    """Rows of SQL INSERTs with a list of columns."""

    def body(x):
        cell = F.regexp_replace(x, r"\s*[,)]?\z", "")
        lead = F.regexp_extract(cell, r"^\s*,?\s*\(?\s*'?", 0)
        return lead, F.regexp_replace(cell.substr(F.length(lead) + 1, F.length(cell)), r"'\z", "")

    def of(s):
        head = F.regexp_extract(s["value"], r"(?is)^(.*?\)\s*values\s*)\(", 1)
        names = F.transform(F.split(F.regexp_extract(s["value"], r"\(([^()]*)\)", 1), ","), lambda c: F.regexp_replace(F.trim(c), r"[`\"\[\]]", ""))
        tokens = F.regexp_extract_all(s["value"].substr(F.length(head) + 1, F.length(s["value"])), F.lit(_INSERT_CELL), F.lit(0))
        tokens = F.filter(tokens, lambda x: x != "")
        rows = let(tokens, lambda t: _rows(_spans(t, s["start"] + F.length(head), body), F.transform(t, lambda x: x.endswith(")"))))
        return F.transform(F.filter(rows, lambda r: F.size(r) == F.size(names)), lambda r: F.struct(names.alias("names"), r.alias("cells")))

    found = F.flatten(F.transform(measured(marked(text, "", _INSERT)), of))
    return F.when(text.rlike("(?i)insert"), found).otherwise(F.array().cast(GRID))


def html_rows(text: Column) -> Column:
    """Rows of HTML tables under a row of ``th`` cells; a cell of several stretches of text has none."""

    def body(x):
        lead = F.regexp_extract(x, r"(?is)^<t[hd]\b[^>]*>", 0)
        said = F.regexp_replace(F.regexp_replace(x, "<[^>]*>", ""), r"^\s+|\s+$", "")
        rest = x.substr(F.length(lead) + 1, F.length(x))
        at = F.position(said, rest)
        alone = (at > 0) & ~rest.rlike("(?i)<table")
        return F.when(alone, F.substring(x, F.lit(1), F.length(lead) + at - 1)).otherwise(lead), F.when(alone, said).otherwise(F.lit(""))

    def of(s):
        def rows(t):
            cells = let(_spans(t, s["start"], body), lambda c: F.transform(c, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), F.lower(F.substring(F.get(t, i), 1, 3)).alias("tag"))))
            whole = _rows(cells, F.transform(t, lambda x: F.lower(x).startswith("</tr")))
            return F.transform(whole, lambda row: F.filter(row, lambda c: c["tag"].isin("<td", "<th")))

        tokens = F.regexp_extract_all(s["value"], F.lit(_HTML), F.lit(0))
        header = lambda row: (F.size(row) > 0) & F.forall(row, lambda c: c["tag"] == "<th")
        headed = _headed(F.filter(let(tokens, rows), lambda r: F.size(r) > 0), header)
        bare = lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"))
        return F.transform(F.filter(headed, lambda r: F.forall(r["cells"], lambda c: c["tag"] == "<td")), lambda r: F.struct(r["names"].alias("names"), F.transform(r["cells"], bare).alias("cells")))

    return F.when(text.rlike("(?i)<table"), F.flatten(F.transform(measured(marked(text, "", _TABLE)), of))).otherwise(F.array().cast(GRID))


# ---- the policy ------------------------------------------------------------------------------------------------------------


def personal_cells(rows: Column, rule: str, anchors: tuple[str, ...] = ("NAME", "FIRST_NAME", "LAST_NAME", "ID_NUMBER")) -> Column:
    """Findings among rows of ``(names, cells)``: cells that hold what their personal column names.

    Accounts and secrets count in every row. The others count in rows with a value of a strong column beside one of an anchor:
    a row that names a person.
    """

    def of(row):
        told = F.transform(F.arrays_zip(row["names"].alias("name"), row["cells"].alias("cell")), lambda x: F.struct(column_kind(x["name"]).alias("kind"), x["cell"].alias("cell")))
        good = F.filter(told, lambda x: x["kind"].isNotNull() & x["cell"].isNotNull() & fits(x["kind"], x["cell"]["value"]))

        def chosen(g):
            strong, anchor = F.exists(g, lambda x: x["kind"].isin(*STRONG)), F.exists(g, lambda x: x["kind"].isin(*anchors))
            person = F.filter(g, lambda x: x["kind"].isin("ACCOUNT", "SECRET") | (strong & anchor))
            kind = mapped(TYPES)
            name = lambda x: F.when(x["kind"] == "SECRET", "secret-under-password-column").otherwise(rule)
            return F.transform(person, lambda x: F.struct(x["cell"]["start"].alias("start"), x["cell"]["end"].alias("end"), name(x).alias("rule"), F.coalesce(F.try_element_at(kind, x["kind"]), x["kind"]).alias("type"), x["cell"]["value"].alias("value")))

        return let(good, chosen)

    return F.flatten(F.transform(rows, of))


#: Rules by format: rows of a text, and what makes a row a person's.
FORMATS = {
    "csv-personal-column": (csv_rows, ("NAME", "FIRST_NAME", "LAST_NAME", "BIRTH_DATE", "ID_NUMBER")),
    "md-table-personal-column": (pipe_rows, ("NAME", "FIRST_NAME", "LAST_NAME", "ID_NUMBER")),
    "sql-insert-personal-column": (insert_rows, ("NAME", "FIRST_NAME", "LAST_NAME", "ID_NUMBER")),
    "html-table-personal-column": (html_rows, ("NAME", "FIRST_NAME", "LAST_NAME", "ID_NUMBER")),
}


def findings(df: DataFrame, *keep: str, text_col: str = "text", rules: tuple[str, ...] = tuple(FORMATS)) -> DataFrame:
    """One row per finding of a table's cells: the columns ``keep``, start, end, rule, type, value."""
    out = df.select(*keep, unmarked(F.col(text_col)).alias("_text"))
    for i, rule in enumerate(rules):
        rows, anchors = FORMATS[rule]
        out = out.withColumn(f"_rows{i}", rows(F.col("_text"))).withColumn(f"_cells{i}", personal_cells(F.col(f"_rows{i}"), rule, anchors)).drop(f"_rows{i}")
    found = F.concat(*[F.col(f"_cells{i}") for i in range(len(rules))])
    return out.select(*keep, F.explode_outer(found).alias("x")).where("x IS NOT NULL").select(*keep, "x.*")


def cells(df: DataFrame, *keep: str, rows, text_col: str = "text") -> DataFrame:
    """Every cell under a header: the columns ``keep``, the row's number, the column's name, start, end and value."""
    out = df.select(*keep, F.posexplode(rows(unmarked(F.col(text_col)))).alias("row", "r"))
    return out.select(*keep, "row", F.explode(F.arrays_zip(F.col("r.names").alias("name"), F.col("r.cells").alias("cell"))).alias("x")).select(*keep, "row", "x.name", "x.cell.start", "x.cell.end", "x.cell.value")
