"""DuckDB twins of the detection operators, built from the same rules."""

from __future__ import annotations

from html.entities import name2codepoint

from quellspan.functions.spans import sql_spans
from quellspan.operators import cleaning
from quellspan.operators.detect import AFTER, BEFORE
from quellspan.operators.rules import Rule, priority


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def rule_sql(rule: Rule, order: int, table: str, key: str) -> str:
    """Candidate rows of one rule: key, priority, start, end, rule, type, value."""
    gate = " OR ".join(f"contains(body, {quoted(k)})" for k in rule.keywords) or "TRUE"
    ok = [c.sql("value") for c in rule.checks]
    if rule.after:
        ok.append(f"NOT regexp_matches(substr(body, x.end + 1, 1), {quoted(rule.after)})")
    if rule.near:
        around = f"lower(substr(body, greatest(x.start - {BEFORE}, 0) + 1, x.start - greatest(x.start - {BEFORE}, 0)) || ' ' || substr(body, x.end + 1, {AFTER}))"
        ok.append(f"regexp_matches({around}, {quoted(f'(?:^|[^a-z])(?:{chr(124).join(rule.near)})(?:[^a-z]|$)')})")
    return f"""SELECT {key}, {order} AS priority, x.start AS "start", x.end AS "end", '{rule.id}' AS rule, '{rule.type}' AS type, value
FROM (SELECT *, x.value AS value FROM (SELECT {key}, body, unnest({sql_spans("body", rule.before, rule.value)}) AS x FROM {table} WHERE {gate}))
WHERE {" AND ".join(ok) or "TRUE"}"""


def candidates_sql(rules, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """CTEs ``source`` and ``candidates`` over a table."""
    order = priority(rules)
    union = "\nUNION ALL\n".join(rule_sql(r, order[r.id], "source", key) for r in rules)
    return f"source AS (SELECT *, translate(coalesce({text}, ''), chr(57344) || chr(57345), chr(65533) || chr(65533)) AS body FROM {table}),\ncandidates AS ({union})"


def findings_sql(rules, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """CTEs up to ``findings``: candidates taken in priority order where they overlap none taken before."""
    taken = "lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.start < x[1].end AND x[1].start < y.end)) > 0 THEN acc ELSE list_concat(acc, x) END"
    return f"""{candidates_sql(rules, table, key, text)},
resolved AS (
    SELECT {key}, list_reduce(list_transform(list(c ORDER BY c.priority, c.start, c.end), lambda c: [c]), {taken}) AS kept
    FROM (SELECT {key}, {{'priority': priority, 'start': "start", 'end': "end", 'rule': rule, 'type': type, 'value': value}} AS c FROM candidates) GROUP BY {key}
),
findings AS (SELECT {key}, x.start AS "start", x.end AS "end", x.rule AS rule, x.type AS type, x.value AS value FROM (SELECT {key}, unnest(kept) AS x FROM resolved))"""


_CUT = "string_split_regex(regexp_replace({0}, '{1}', {2}, 'g'), '[' || chr(57344) || chr(57345) || ']')"


def copies_sql(rules, raw: str) -> str:
    """CTEs up to ``merged``: findings of documents' texts ``raw`` and of their cleaned copies, written for this purpose.

    Entities are looked up in a table, stars matched with the label between them, places told by window sums, and a copy's
    finding placed by joins with the runs that hold its ends.
    """
    entities = ", ".join(f"('{name}', {code})" for name, code in sorted(name2codepoint.items()))
    hidden = _CUT.format("raw", f"({quoted(cleaning.HIDDEN)[1:-1]})", "chr(57344) || '\\1' || chr(57345)")
    mark = "' || chr(57344) || '{0}' || chr(57345) || '"
    bold, line = mark.format("**"), mark.format("__")
    steps = [
        (r"(^|[^*\w])\*\*(\pL[^*\n:]{0,48}:)\*\*([ \t])", f"\\1{bold}\\2{bold}\\3"),
        (r"(^|[^*\w])\*\*(\pL[^*\n:]{0,48})\*\*([ \t]{0,3}[:=])", f"\\1{bold}\\2{bold}\\3"),
        (r"(^|[^_\w])__(\p{Lu}[^_*\n:]{0,48}:)__([ \t])", f"\\1{line}\\2{line}\\3"),
        (r"(^|[^_\w])__(\p{Lu}[^_*\n:]{0,48})__([ \t]{0,3}:[ \t])", f"\\1{line}\\2{line}\\3"),
    ]
    starred = "shown"
    for pattern, put in steps:
        starred = f"regexp_replace({starred}, '{pattern}', '{put}', 'g')"
    number = "coalesce(TRY_CAST(nullif(regexp_extract(old, '^&#([0-9]+);$', 1), '') AS INTEGER), TRY_CAST('0x' || nullif(regexp_extract(old, '^&#[xX]([0-9A-Fa-f]+);$', 1), '') AS INTEGER))"
    char = f"coalesce(CASE WHEN {number} BETWEEN 1 AND 55295 OR {number} BETWEEN 57346 AND 1114111 THEN chr({number}) END, chr(code), old)"
    runs = "SELECT doc_id, i, old, new, sum(length(new)) OVER w - length(new) AS at, sum(length(old)) OVER w - length(old) AS source, length(new) AS size, length(old) AS width FROM {0} WINDOW w AS (PARTITION BY doc_id ORDER BY i)"
    place = """SELECT h.doc_id, CASE WHEN a.size = a.width THEN a.source + h."start" - a.at ELSE a.source END AS "start", CASE WHEN b.size = b.width THEN b.source + h."end" - b.at ELSE b.source + b.width END AS "end", h.rule, h.type
FROM {0} h JOIN {1} a ON a.doc_id = h.doc_id AND a.at <= h."start" AND h."start" < a.at + a.size JOIN {1} b ON b.doc_id = h.doc_id AND b.at < h."end" AND h."end" <= b.at + b.size"""
    meets = 'f.doc_id = c.doc_id AND f."start" < c."end" AND c."start" < f."end"'
    outside = '(f."start" < c."start" OR f."end" > c."end" OR (f."start" = c."start" AND f."end" = c."end"))'
    return f"""WITH given AS (SELECT doc_id, translate({raw}, chr(57344) || chr(57345), chr(65533) || chr(65533)) AS raw FROM documents),
entities AS (SELECT * FROM (VALUES {entities}) AS t(name, code)),
pieces AS (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, {hidden} AS p FROM given WHERE raw IS NOT NULL)),
parts AS (SELECT doc_id, i, p[i] AS old, code FROM pieces LEFT JOIN entities ON i % 2 = 0 AND p[i] = '&' || name || ';'),
chars AS (SELECT *, {char} AS c FROM parts),
replaced AS (SELECT doc_id, i, old, CASE WHEN i % 2 = 1 THEN old WHEN regexp_full_match(old, '{cleaning.ENTITY}') AND NOT regexp_full_match(c, '[{cleaning.INVISIBLE}]|\x1b') THEN c ELSE '' END AS new FROM chars),
inner_runs AS ({runs.format("replaced")}),
shown AS (SELECT doc_id, translate(string_agg(new, '' ORDER BY i), '{cleaning.WIDE}', '{quoted(cleaning.NARROW)[1:-1]}') AS shown FROM inner_runs GROUP BY doc_id),
bare AS (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split_regex({starred}, '[' || chr(57344) || chr(57345) || ']') AS p FROM shown)),
unstarred AS (SELECT doc_id, i, p[i] AS old, CASE WHEN i % 2 = 1 THEN p[i] WHEN regexp_matches(p[i - 1], '[^\\n*_:]$') AND regexp_matches(p[i - 1], '\\s$') THEN ' ' ELSE '' END AS new FROM bare),
outer_runs AS ({runs.format("unstarred")}),
copy AS (SELECT doc_id, string_agg(new, '' ORDER BY i) AS clean FROM outer_runs GROUP BY doc_id),
found AS (WITH {findings_sql(rules, "given", "doc_id", "raw")} SELECT * FROM findings),
hits AS (WITH {findings_sql(rules, "copy", "doc_id", "clean")} SELECT * FROM findings),
outer_hits AS ({place.format("hits", "outer_runs")}),
copies AS ({place.format("outer_hits", "inner_runs")}),
taken AS (SELECT * FROM copies c WHERE NOT EXISTS (SELECT 1 FROM found f WHERE {meets} AND {outside})),
merged AS (SELECT doc_id, "start", "end", rule, type FROM found f WHERE NOT EXISTS (SELECT 1 FROM taken c WHERE {meets})
UNION ALL SELECT doc_id, CAST("start" AS BIGINT), CAST("end" AS BIGINT), rule, type FROM taken)"""
