"""Chat formatting: heterogeneous records to canonical turns, and turns to a marked text with a loss mask.

The nested field paths that a record holds are hashed into its schema fingerprint; the fingerprint selects a declarative
mapping that says where roles and texts lie. The template marks each turn and puts a backslash into every control string
inside a text, so markers can only be the template's and reading back restores the text exactly. DataFrame functions only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"
CONTROL = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    required, optional: nested field paths; ``messages[]`` is a list and ``messages[].role`` a field of its items. A list
    layout names the list, its role and text fields and the roles' canonical names; a flat layout lists (role, fields), the
    fields of a turn joined by a blank line.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()
    flat: tuple[tuple[str, tuple[str, ...]], ...] = ()


SHARED = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
MAPPINGS = (
    Mapping("messages", ("messages[]",), ("messages[].role", "messages[].content"), "messages", "role", "content"),
    Mapping("conversations", ("conversations[]",), ("conversations[].from", "conversations[].value"), "conversations", "from", "value", SHARED),
    Mapping("dialogue", ("dialogue[]",), ("dialogue[].speaker", "dialogue[].text"), "dialogue", "speaker", "text", SHARED),
    Mapping("completion", ("prompt", "completion"), ("system",), flat=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("response", ("prompt", "response"), ("system",), flat=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), flat=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("question", ("question", "answer"), ("context",), flat=(("user", ("context", "question")), ("assistant", ("answer",)))),
)


def field_paths(mappings=MAPPINGS) -> list[str]:
    return sorted({p for m in mappings for p in (*m.required, *m.optional)})


def fingerprint_of(paths) -> str:
    """The schema fingerprint of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def fingerprints_of(mapping: Mapping) -> list[str]:
    return [fingerprint_of((*mapping.required, *x)) for n in range(len(mapping.optional) + 1) for x in combinations(mapping.optional, n)]


def record_type(mappings=MAPPINGS) -> T.StructType:
    """One struct type that holds every field path of the mappings."""
    top: dict[str, list[str]] = {}
    for p in field_paths(mappings):
        head, _, item = p.partition("[]")
        top.setdefault(head, [])
        if item:
            top[head].append(item[1:])
    lists = {p[:-2] for p in field_paths(mappings) if p.endswith("[]")}
    kind = lambda k: T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in top[k]])) if k in lists else T.StringType()
    return T.StructType([T.StructField(k, kind(k)) for k in top])


def from_json_text(text: Column, mappings=MAPPINGS) -> tuple[Column, Column]:
    """The record of a JSON text and the names of its top fields; both null where the text is no JSON object."""
    return F.from_json(text, record_type(mappings)), F.json_object_keys(text)


def schema_fingerprint(record: Column, held, keys: Column | None = None, mappings=MAPPINGS) -> Column:
    """Fingerprint of the mapped field paths that a record holds; other fields don't count.

    held: the top fields that ``record`` has as a struct. keys: names of its top fields where a null field counts as held.
    """

    def holds(path: str) -> Column:
        top, _, item = path.partition("[]")
        if top not in held:
            return F.lit(False)
        if item:
            return F.exists(record[top], lambda x: x[item[1:]].isNotNull())
        return F.array_contains(keys, top) if keys is not None else record[top].isNotNull()

    found = [F.when(holds(p), F.lit(p)) for p in field_paths(mappings)]
    return F.sha2(F.concat_ws("\n", *found), 256)


def _turns(record: Column, held, mapping: Mapping) -> Column:
    if mapping.items:
        if mapping.items not in held:
            return F.lit(None).cast(TURNS)

        def turn(x):
            role = F.coalesce(x[mapping.role], F.lit(""))
            named = role
            for old, new in mapping.roles:
                named = F.when(role == old, new).otherwise(named)
            return F.struct(named.alias("role"), F.coalesce(x[mapping.text], F.lit("")).alias("text"))

        return F.transform(record[mapping.items], turn)
    turns = []
    for role, fields in mapping.flat:
        own = [record[f] for f in fields if f in held]
        needed = any(f in mapping.required for f in fields)
        text = F.concat_ws("\n\n", *[F.when(c != "", c) for c in own]) if own else F.lit("")
        there = F.lit(True) if needed else (F.coalesce(*own).isNotNull() if own else F.lit(False))
        turns.append(F.when(there, F.struct(F.lit(role).alias("role"), text.alias("text"))))
    return F.filter(F.array(*turns), lambda x: x.isNotNull())


def canonical_turns(record: Column, held, keys: Column | None = None, mappings=MAPPINGS) -> tuple[Column, Column]:
    """The canonical turns of a record and its layout's name, both null where no mapping has the record's fingerprint."""
    mark = schema_fingerprint(record, held, keys, mappings)
    turns, layout = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    for m in reversed(mappings):
        if {p.partition("[]")[0] for p in m.required} <= set(held):
            own = mark.isin(fingerprints_of(m))
            turns, layout = F.when(own, _turns(record, held, m)).otherwise(turns), F.when(own, m.name).otherwise(layout)
    return turns, layout


# ---- template -----------------------------------------------------------------------------------------------------------


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _escape_role(role: Column) -> Column:
    for old, new in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(old), F.lit(new))
    return role


def _unescape_role(role: Column) -> Column:
    for old, new in (("%3C", "<"), ("%0A", "\n"), ("%25", "%")):
        role = F.replace(role, F.lit(old), F.lit(new))
    return role


def render(turns: Column) -> tuple[Column, Column]:
    """The formatted text and its loss mask: per turn, in code points, what goes before, what is trained on, what follows."""
    text = F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END))), "")

    def runs(t):
        head = F.length(_escape_role(t["role"])).cast("long") + len(START) + 1
        body = F.length(escape(t["text"])).cast("long")
        trained = F.when(t["role"] == "assistant", body).otherwise(F.lit(0))
        return F.struct((head + body - trained).alias("before"), trained.alias("trained"), F.lit(len(END)).cast("long").alias("after"))

    return text, F.transform(turns, runs)


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")

    def turn(p):
        role = F.substring_index(p, "\n", 1)
        skip = F.length(role) + 1
        return F.struct(_unescape_role(role).alias("role"), unescape(F.substring(p, skip + 1, F.length(p) - skip - len(END))).alias("text"))

    return F.transform(pieces, turn)


def trained_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")
    cut = F.zip_with(pieces, mask, lambda p, m: unescape(F.substring(p, (m["before"] - len(START) + 1).cast("int"), m["trained"].cast("int"))))
    return F.array_join(cut, "")


def format_records(records: DataFrame, record_col: str = "record", keys: Column | None = None, mappings=MAPPINGS) -> DataFrame:
    """Adds layout, turns, formatted and mask to records held as a struct column.

    A record whose fingerprint no mapping has keeps null in all four. Null roles and texts become empty. Columns of the
    same names are replaced, all others stay.
    """
    held = [f.name for f in records.schema[record_col].dataType.fields]
    turns, layout = canonical_turns(F.col(record_col), held, keys, mappings)
    out = records.withColumns({"layout": layout, "turns": turns})
    text, mask = render(F.col("turns"))
    return out.withColumns({"formatted": text, "mask": mask})


def format_json(records: DataFrame, json_col: str, mappings=MAPPINGS) -> DataFrame:
    """:func:`format_records` for records that are JSON texts."""
    record, keys = from_json_text(F.col(json_col), mappings)
    return format_records(records.withColumns({"record": record, "keys": keys}), "record", F.col("keys"), mappings).drop("record", "keys")


def gathered(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One record in the message layout per id of a table of rows by turn; equal turns go by role and text."""
    item = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    items = F.sort_array(F.collect_list(item))
    messages = F.transform(items, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return rows.groupBy(id_col).agg(F.struct(messages.alias("messages")).alias("record"))
