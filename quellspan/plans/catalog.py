"""The registered queries of the detection engine and their SQL twins."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from quellspan.functions import checks
from quellspan.functions.spans import sql_spans
from quellspan.operators import cleaning, decoding, detect, grids, known, leaves, lifetimes, lookups, masking, nearby, phrases, records, reports, terms, words
from quellspan.operators.rules import CATALOG, EMAIL_SHAPE, LABELLED, PERSONAL, REGIONAL, TOKENS, chosen
from quellspan.plans import oracle, planted
from quellspan.session import spread, table, written

FLAGSHIP = "all_findings_resolved"
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def _spans_query(name: str, rules, source: str = "documents", key: str = "doc_id", text: str = "text") -> None:
    sql = f'WITH {oracle.candidates_sql(rules, source, key, text)} SELECT {key}, "start", "end", rule, type, value FROM candidates'

    @query(name, sql)
    def run(spark, sf_dir):
        return detect.candidate_rows(spread(table(spark, sf_dir, source).select(key, text)), key, text_col=text, rules=rules).drop("priority")


by_id = lambda *ids: chosen(ids=ids)
_spans_query("phone_findings", by_id("phone"))
_spans_query("ipv4_public_findings", by_id("ipv4"))
_spans_query("card_luhn_findings", by_id("card"))
_spans_query("iban_findings", by_id("iban"))
_spans_query("token_assignment_findings", by_id("token-assignment"))
_spans_query("email_candidates", (EMAIL_SHAPE,))
_spans_query("email_findings", by_id("email"))
_spans_query("page_email_candidates", (EMAIL_SHAPE,), "pages", "page_id", "html")
_spans_query("vendor_token_findings", TOKENS)
_spans_query("labelled_secret_findings", LABELLED)
_spans_query("regional_number_findings", REGIONAL)
_spans_query("personal_findings", PERSONAL)

_FOUND = f"WITH {oracle.findings_sql(CATALOG)}"


@query(FLAGSHIP, f'{_FOUND} SELECT doc_id, "start", "end", rule, type FROM findings')
def all_findings_resolved(spark, sf_dir):
    """Every rule over every document; no values leave the query."""
    return detect.findings(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id").drop("value")


# ---- queries over the findings of the core rules -----------------------------------------------------------------------

CORE = (*by_id("token-assignment", "card", "ipv4", "phone"), EMAIL_SHAPE)
_CORE = f"WITH {oracle.findings_sql(CORE)}"
_CANDIDATES = f"WITH {oracle.candidates_sql(CORE)}"


def _documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"))


def _core(spark, sf_dir, *keep):
    return detect.findings(_documents(spark, sf_dir), "doc_id", *keep, rules=CORE)


@query("findings_by_type", f"{_FOUND} SELECT type, rule, count(*) AS n, count(DISTINCT doc_id) AS texts FROM findings GROUP BY type, rule")
def findings_by_type(spark, sf_dir):
    return detect.findings(_documents(spark, sf_dir), "doc_id").groupBy("type", "rule").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("texts"))


@query("findings_by_lang_source", f"{_CORE} SELECT lang, source, type, count(*) AS n FROM findings JOIN documents USING (doc_id) GROUP BY lang, source, type")
def findings_by_lang_source(spark, sf_dir):
    return _core(spark, sf_dir, "lang", "source").groupBy("lang", "source", "type").agg(F.count(F.lit(1)).alias("n"))


@query("findings_joined_labels", f"{_CORE} SELECT quality, toxic, type, count(*) AS n FROM findings JOIN labels USING (doc_id) GROUP BY quality, toxic, type")
def findings_joined_labels(spark, sf_dir):
    return _core(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic", "type").agg(F.count(F.lit(1)).alias("n"))


_DIGITS = replace(PERSONAL[0], id="long-number", type="ID_NUMBER", value="[0-9]{9,}", checks=(), band="literal")
_CLASH = (*CORE, _DIGITS)


@query(
    "rule_priority_conflicts",
    f'WITH {oracle.candidates_sql(_CLASH)} SELECT a.rule AS owner, b.rule AS yields, count(*) AS n FROM candidates a JOIN candidates b ON a.doc_id = b.doc_id AND a.start < b."end" AND b.start < a."end" AND a.priority < b.priority GROUP BY ALL',
)
def rule_priority_conflicts(spark, sf_dir):
    return reports.conflicts(detect.candidate_rows(_documents(spark, sf_dir), "doc_id", rules=_CLASH), "doc_id")


_NEAR = replace(_DIGITS, id="number-near-a-word", near=("call", "phone", "number", "card", "the", "der", "de"))
_spans_query("context_window_filter", (_NEAR,))


@query("keyword_gate_selectivity", " UNION ALL ".join(f"SELECT '{r.id}' AS rule, count(*) FILTER ({' OR '.join(f'contains(text, {oracle.quoted(k)})' for k in r.keywords) or 'TRUE'}) AS passed, count(*) AS texts FROM documents" for r in CORE))
def keyword_gate_selectivity(spark, sf_dir):
    text = F.col("text")
    rows = _documents(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(r.id).alias("rule"), detect.gate(r, text).alias("open")) for r in CORE])).alias("g"))
    return rows.groupBy("g.rule").agg(F.sum(F.when(F.col("g.open"), 1).otherwise(0)).alias("passed"), F.count(F.lit(1)).alias("texts"))


_LABEL = r"(?:the|de|der|and|of)\.?$"


@query(
    "keyword_next_line",
    f"""WITH l AS (SELECT doc_id, i - 1 AS number, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
n AS (SELECT *, trim(lead(line) OVER (PARTITION BY doc_id ORDER BY number)) AS value FROM l WHERE trim(line) <> '')
SELECT doc_id, CAST(number AS INTEGER) AS number, value FROM n WHERE regexp_matches(line, '{_LABEL}') AND value IS NOT NULL""",
)
def keyword_next_line(spark, sf_dir):
    return records.next_line_values(_documents(spark, sf_dir), "doc_id", "text", _LABEL)


@query("entropy_by_token", f"{_CORE} SELECT doc_id, \"start\", round({checks.sql_entropy('value')}, 6) AS entropy FROM findings WHERE type = 'SECRET'")
def entropy_by_token(spark, sf_dir):
    return _core(spark, sf_dir).where("type = 'SECRET'").select("doc_id", "start", F.round(checks.entropy(F.col("value")), 6).alias("entropy"))


@query(
    "masked_documents",
    f"""{_FOUND},
cut AS (SELECT doc_id, body, "start", type, "end", lag("end", 1, 0) OVER (PARTITION BY doc_id ORDER BY "start") AS before FROM findings JOIN source USING (doc_id)),
out AS (SELECT doc_id, string_agg(substr(body, before + 1, "start" - before) || '⟦' || type || '⟧', '' ORDER BY "start") || substr(any_value(body), max("end") + 1) AS masked, count(*) AS n FROM cut GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(length(coalesce(masked, text)) AS BIGINT) AS chars, sha256(coalesce(masked, text)) AS digest FROM documents LEFT JOIN out USING (doc_id)""",
)
def masked_documents(spark, sf_dir):
    out = detect.with_findings(_documents(spark, sf_dir)).withColumn("masked", masking.masked(F.col("text"), F.col("findings")))
    return out.select("doc_id", F.size("findings").cast("long").alias("n"), F.length("masked").cast("long").alias("chars"), F.sha2("masked", 256).alias("digest"))


_SQL_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"


@query(
    "display_masks",
    f"""{_CORE} SELECT doc_id, "start", CASE type WHEN 'EMAIL' THEN substr(value, 1, 2) || '•••@' || string_split(value, '@')[-1] WHEN 'PHONE' THEN '+' || substr({_SQL_DIGITS}, 1, 1) || '•••' || right({_SQL_DIGITS}, 2)
WHEN 'CARD' THEN '•••' || right({_SQL_DIGITS}, 4) WHEN 'IP' THEN string_split(value, '.')[1] || '.' || string_split(value, '.')[2] || '.•.•' WHEN 'IBAN' THEN substr(value, 1, 4) || '•••' || right(value, 2) ELSE '•••' END AS shown FROM findings""",
)
def display_masks(spark, sf_dir):
    return _core(spark, sf_dir).select("doc_id", "start", masking.displayed(F.col("type"), F.col("value")).alias("shown"))


_KEY = "quellspan-demo-key"


@query(
    "reference_assignment",
    f"""{_CORE}, f AS (SELECT type, value, min({{'d': doc_id, 's': "start"}}) AS place, count(*) AS uses FROM findings GROUP BY type, value)
SELECT type, sha256(unhex('{masking.padded(_KEY)[1].hex()}') || unhex(sha256(unhex('{masking.padded(_KEY)[0].hex()}') || encode(value)))) AS fingerprint, row_number() OVER (PARTITION BY type ORDER BY place, value) AS number, uses FROM f""",
)
def reference_assignment(spark, sf_dir):
    return masking.numbered(_core(spark, sf_dir), _KEY)


@query("allow_list_anti_join", f"{_CORE} SELECT doc_id, \"start\", type FROM findings WHERE sha256(value) NOT IN (SELECT sha256(value) FROM findings JOIN labels USING (doc_id) WHERE quality = 1)")
def allow_list_anti_join(spark, sf_dir):
    """Values of documents that are labelled good are allowed everywhere."""
    found = written(_core(spark, sf_dir), "allow-list")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    allowed = found.join(good, "doc_id", "left_semi").select(F.sha2("value", 256).alias("digest")).distinct()
    return detect.without_values(found, allowed).select("doc_id", "start", "type")


@query("audit_verdicts", f"""{_CORE} SELECT sha256(value) AS digest, type, count(*) AS uses, count(DISTINCT doc_id) AS texts, count(DISTINCT source) AS sources,
CASE WHEN bool_or(rule IN ('token-assignment', 'card')) THEN 'REAL' WHEN count(DISTINCT doc_id) > 1 THEN 'SPREAD' ELSE 'SINGLE' END AS verdict FROM findings JOIN documents USING (doc_id) GROUP BY sha256(value), type""")
def audit_verdicts(spark, sf_dir):
    return reports.verdicts(_core(spark, sf_dir, "source"), ("token-assignment", "card"))


_LOOSE = replace(_DIGITS, id="loose-card", type="CARD", value="[0-9][0-9 -]{11,21}[0-9]", before="(?:^|[^0-9])", after="[0-9]", band="personal")
_CARD = by_id("card")


_SCORES = f"""WITH truth AS (WITH {oracle.findings_sql(_CARD)} SELECT * FROM findings), loose AS (WITH {oracle.findings_sql((_LOOSE,))} SELECT * FROM findings),
per AS (SELECT t.type, max(CASE WHEN f.start = t.start AND f."end" = t."end" THEN 2 WHEN f.start IS NOT NULL THEN 1 ELSE 0 END) AS hit FROM truth t LEFT JOIN loose f ON t.doc_id = f.doc_id AND t.type = f.type AND f.start < t."end" AND t.start < f."end" GROUP BY t.type, t.doc_id, t.start, t."end"),
hits AS (SELECT type, count(*) FILTER (hit = 2) AS exact, count(*) FILTER (hit = 1) AS partial, count(*) FILTER (hit = 0) AS missed FROM per GROUP BY type),
wrong AS (SELECT type, count(*) AS false_findings FROM loose f WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.doc_id = f.doc_id AND t.type = f.type AND f.start < t."end" AND t.start < f."end") GROUP BY type)
SELECT type, coalesce(exact, 0) AS exact, coalesce(partial, 0) AS partial, coalesce(missed, 0) AS missed, coalesce(false_findings, 0) AS false_findings FROM hits FULL JOIN wrong USING (type)"""


@query("span_scoring", _SCORES)
def span_scoring(spark, sf_dir):
    """Any run of digits of a card's length, scored against the card numbers that pass their check."""
    docs = _documents(spark, sf_dir)
    truth = written(detect.findings(docs, "doc_id", rules=_CARD), "scoring-truth")
    found = written(detect.findings(docs, "doc_id", rules=(_LOOSE,)), "scoring-found")
    return reports.scored(found, truth, "doc_id")


@query(
    "span_rates",
    f"""SELECT *, precision * recall * 2 / nullif(precision + recall, 0) AS f1 FROM (SELECT type, spans, CASE WHEN spans >= 10 THEN CAST(hit AS DOUBLE) / nullif(hit + false_findings, 0) END AS precision, CASE WHEN spans >= 10 THEN CAST(hit AS DOUBLE) / nullif(spans, 0) END AS recall
FROM (SELECT *, exact + partial AS hit, exact + partial + missed AS spans FROM ({_SCORES})))""",
)
def span_rates(spark, sf_dir):
    """Rates of the same scores, told from ten true spans on."""
    return reports.rates(span_scoring(spark, sf_dir), 10)


@query("value_spread", f"""{_FOUND} SELECT sha256(value) AS digest, type, count(*) AS uses, count(DISTINCT doc_id) AS n_doc_id, count(DISTINCT lang) AS n_lang, count(DISTINCT source) AS n_source, min(doc_id) AS first_text, max(doc_id) AS last_text FROM findings JOIN documents USING (doc_id) GROUP BY sha256(value), type""")
def value_spread(spark, sf_dir):
    """Where each value of the whole catalog occurs."""
    return reports.spread(detect.findings(_documents(spark, sf_dir), "doc_id", "lang", "source"), "doc_id", "lang", "source")


@query(
    "derived_forms",
    f"""{_FOUND} SELECT doc_id, "start", type, form, sha256(v) AS digest FROM (SELECT doc_id, "start", type, unnest(['base64', 'hex', 'percent']) AS form, unnest([to_base64(encode(value)), lower(hex(encode(value))), url_encode(value)]) AS v FROM findings)""",
)
def derived_forms(spark, sf_dir):
    found = detect.findings(_documents(spark, sf_dir), "doc_id")
    return found.select("doc_id", "start", "type", F.explode(masking.derived(F.col("value"))).alias("x")).select("doc_id", "start", "type", "x.form", F.sha2("x.value", 256).alias("digest"))


# ---- other tables and records -------------------------------------------------------------------------------------------


@query("channel_routing", f"""WITH {oracle.candidates_sql(CORE, "conversations", "conv_id, turn, role")} SELECT CASE WHEN role = 'user' THEN 'prompt' ELSE 'tool' END AS channel, rule, count(*) AS n FROM candidates GROUP BY ALL""")
def channel_routing(spark, sf_dir):
    rows = detect.candidate_rows(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", rules=CORE)
    return rows.groupBy(F.when(F.col("role") == "user", "prompt").otherwise("tool").alias("channel"), "rule").agg(F.count(F.lit(1)).alias("n"))


_TERMS = (("LICENCE", "licensed under"), ("LICENCE", "public license"), ("LICENCE", "cc by"), ("FUNCTION", "of the"), ("FUNCTION", "de la"))
_GRAMS = " UNION ALL ".join(f"SELECT doc_id, array_to_string(w[i:i + {n - 1}], ' ') AS gram, i - 1 AS position FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM words)" for n in (1, 2))


@query(
    "term_dictionary_hits",
    f"""WITH words AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{lookups.WORD}'), lambda x: lower(x)) AS w FROM documents),
grams AS ({_GRAMS}), terms AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _TERMS)}) AS t(label, term))
SELECT doc_id, label, CAST(position AS INTEGER) AS position FROM grams JOIN terms ON gram = term""",
)
def term_dictionary_hits(spark, sf_dir):
    return lookups.term_hits(_documents(spark, sf_dir), "doc_id", "text", spark.createDataFrame(list(_TERMS), "label string, term string"), 2)


@query("imported_value_hits", f"{_CORE} SELECT doc_id, \"start\", type FROM findings WHERE value IN (SELECT value FROM findings JOIN labels USING (doc_id))")
def imported_value_hits(spark, sf_dir):
    """Values of the labelled documents, imported, found in all of them."""
    found = written(_core(spark, sf_dir), "imported")
    values = found.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("value")
    return lookups.value_hits(found, values).select("doc_id", "start", "type")


_LETTER = r"[\p{L}\p{N}]"


@query(
    "known_value_redaction",
    f"""WITH core AS ({_CORE} SELECT doc_id, type, value FROM findings),
registry AS (SELECT value, min(type) AS type FROM (
SELECT type, value FROM core JOIN labels USING (doc_id)
UNION ALL SELECT 'PASSAGE', trim(unnest(string_split_regex(text, '[.\n]'))) FROM benchmark) WHERE length(value) >= 8 AND regexp_matches(value, '{_LETTER}') GROUP BY value),
source AS (SELECT doc_id, text, coalesce(text, '') AS body FROM documents),
cut AS (SELECT doc_id, body, type, value, string_split(body, value) AS p FROM source JOIN registry ON contains(body, value)),
placed AS (SELECT doc_id, body, type, value, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(value) AS BIGINT) AS s FROM (SELECT *, unnest(range(1, len(p))) AS i FROM cut)),
whole AS (SELECT *, s + length(value) AS e FROM placed WHERE NOT (regexp_matches(value, '^{_LETTER}') AND s > 0 AND regexp_matches(substr(body, s, 1), '{_LETTER}')) AND NOT (regexp_matches(value, '{_LETTER}$') AND regexp_matches(substr(body, s + length(value) + 1, 1), '{_LETTER}'))),
kept AS (SELECT doc_id, list_reduce(list_transform(list(c ORDER BY c.p, c.s), lambda c: [c]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.s < x[1].e AND x[1].s < y.e)) > 0 THEN acc ELSE list_concat(acc, x) END) AS k
FROM (SELECT doc_id, {{'p': -length(value), 's': s, 'e': e, 'type': type}} AS c FROM whole) GROUP BY doc_id),
hits AS (SELECT doc_id, body, h.s AS s, h.e AS e, h.type AS type, lag(h.e, 1, 0) OVER (PARTITION BY doc_id ORDER BY h.s) AS before FROM (SELECT doc_id, unnest(k) AS h FROM kept) JOIN source USING (doc_id)),
out AS (SELECT doc_id, string_agg(substr(body, before + 1, s - before) || '⟦' || type || '⟧', '' ORDER BY s) || substr(any_value(body), max(e) + 1) AS masked, count(*) AS n FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(length(coalesce(masked, body)) AS BIGINT) AS chars, sha256(coalesce(masked, body)) AS digest FROM source LEFT JOIN out USING (doc_id)""",
)
def known_value_redaction(spark, sf_dir):
    """Values found in labelled documents, and the sentences of the benchmark, masked in all documents."""
    docs = _documents(spark, sf_dir)
    values = _core(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select("value", "type")
    sentences = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "[.\n]")).alias("value"), F.lit("PASSAGE").alias("type")).withColumn("value", F.trim("value"))
    out = known.redacted(docs.select("doc_id", "text"), "doc_id", values.unionByName(sentences).where(F.length("value") >= 8))
    return out.select("doc_id", F.size("hits").cast("long").alias("n"), F.length("masked").cast("long").alias("chars"), F.sha2("masked", 256).alias("digest"))


@query(
    "pipe_table_cells",
    """WITH l AS (SELECT doc_id, i - 1 AS number, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
c AS (SELECT doc_id, number, string_split(line, ' | ') AS cells FROM l WHERE contains(line, ' | '))
SELECT doc_id, CAST(number AS INTEGER) AS number, CAST(i - 1 AS INTEGER) AS position, trim(cells[i]) AS cell FROM (SELECT *, unnest(range(1, len(cells) + 1)) AS i FROM c)""",
)
def pipe_table_cells(spark, sf_dir):
    return records.pipe_cells(_documents(spark, sf_dir), "doc_id", "text")


@query("json_leaf_values", "SELECT event_id, k AS name, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_leaf_values(spark, sf_dir):
    return records.json_leaves(table(spark, sf_dir, "events"), "event_id", "props")


@query("object_leaf_places", planted.dialogues_sql())
def object_leaf_places(spark, sf_dir):
    """Every leaf of conversations written as nested JSON, at its place in the JSON text."""
    out = leaves.leaf_rows(spread(planted.dialogues(table(spark, sf_dir, "conversations"))), "conv_id")
    return out.select("conv_id", F.array_join("path", ".").alias("path"), "start", "end", F.sha2("value", 256).alias("digest"))


@query("object_scan_findings", planted.records_sql(lambda source, key: f'WITH {oracle.findings_sql(CATALOG, source, key, "body")} SELECT {key}, "start", "end", rule, type FROM findings'))
def object_scan_findings(spark, sf_dir):
    """Findings of documents written as nested records, over leaves and the sentences that two leaves make."""
    out = leaves.object_findings(spread(planted.records(table(spark, sf_dir, "documents"))), "doc_id")
    return out.select("doc_id", F.array_join("path", ".").alias("path"), "start", "end", "rule", "type")


_PAIR = "regexp_replace(lower({0}), '[^a-z]', '.', 'g')"


@query(
    "judged_url_parts",
    f"""WITH RECURSIVE vals AS (SELECT DISTINCT v FROM (SELECT unnest(string_split_regex(url, '[/.?=&:]')) AS v FROM pages) WHERE length(v) >= 5),
words AS (SELECT w FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '\\pL+'))) AS w FROM documents) GROUP BY w HAVING count(*) >= 10),
folded AS (SELECT v, CASE WHEN regexp_matches(lower(v), '\\pL') THEN translate(lower(v), '{"".join(a for a, _ in words.PAIRS)}', '{"".join(b for _, b in words.PAIRS)}') ELSE lower(v) END AS r FROM vals),
pieces AS (SELECT v, r, i, unnest(range({words.SHORTEST_WORD}, {words.LONGEST_WORD} + 1)) AS n FROM (SELECT v, r, unnest(range(0, length(r))) AS i FROM folded)),
steps AS (SELECT v, i, n, n AS m FROM pieces WHERE i + n <= length(r) AND substr(r, i + 1, n) IN (SELECT w FROM words WHERE length(w) BETWEEN {words.SHORTEST_WORD} AND {words.LONGEST_WORD}) UNION ALL SELECT v, unnest(range(0, length(r))), 1, 0 FROM folded),
reach AS (SELECT v, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS c FROM folded UNION SELECT v, reach.i + n, c + m FROM reach JOIN steps USING (v) WHERE steps.i = reach.i),
cover AS (SELECT v, max(c) AS covered FROM reach JOIN folded USING (v) WHERE i = length(r) GROUP BY v),
seen AS (SELECT substr(p, k, 2) AS pair, count(*) AS n FROM (SELECT p, unnest(range(1, length(p))) AS k FROM (SELECT {_PAIR.format("w")} AS p FROM words WHERE length(w) > 1)) GROUP BY ALL),
letters AS (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz.', '')) AS c),
model AS (SELECT a.c || b.c AS pair, round(-log2((coalesce(n, 0) + 0.5) / sum(coalesce(n, 0) + 0.5) OVER (PARTITION BY a.c)), 6) AS bits FROM letters a, letters b LEFT JOIN seen ON pair = a.c || b.c),
surprise AS (SELECT v, round(avg(bits), 4) AS surprise FROM (SELECT v, p, unnest(range(1, length(p))) AS k FROM (SELECT v, {_PAIR.format("v")} AS p FROM vals)) JOIN model ON pair = substr(p, k, 2) GROUP BY v),
told AS (SELECT v AS value, CAST(length(regexp_replace(r, '[^\\pL]', '', 'g')) AS BIGINT) AS letters, covered, surprise, round((length(v) - length(regexp_replace(v, '{checks.SEQUENCES}', '', 'g'))) / length(v), 6) AS sequences FROM folded JOIN cover USING (v) JOIN surprise USING (v))
SELECT *, CASE WHEN sequences >= 0.5 THEN 'sequence' WHEN letters > 0 AND covered >= 0.7 * letters AND NOT regexp_matches(value, '[0-9]{{3}}') THEN 'words'
WHEN surprise >= 5.0 OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')) THEN 'random' ELSE 'unclear' END AS verdict FROM told""",
)
def judged_url_parts(spark, sf_dir):
    """Parts of pages' addresses judged by the words of ten documents or more."""
    parts = table(spark, sf_dir, "pages").select(F.explode(F.split("url", "[/.?=&:]")).alias("value")).where(F.length("value") >= 5)
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}+"), F.lit(0)))
    known = _documents(spark, sf_dir).select(F.explode(found).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 10").select("word")
    return words.judged(parts, written(known, "known-words"))


@query("label_line_findings", planted.tables_sql("form", "label-line-above", ("NAME", "PHONE", "ID_NUMBER")))
def label_line_findings(spark, sf_dir):
    """Values under labels on lines of their own, in forms made of customers."""
    return records.labelled_lines(spread(planted.tables(table(spark, sf_dir, "customer"), "form")), "text_id")


_RUN_WORDS = 5


@query(
    "benchmark_term_runs",
    f"""WITH source AS (SELECT doc_id, translate(coalesce(text, ''), chr(57344) || chr(57345), chr(65533) || chr(65533)) AS body FROM documents),
items AS (SELECT 'item ' || item_id AS label, list_transform(regexp_extract_all(coalesce(text, ''), '{terms.WORD}'), lambda x: lower(x)) AS w FROM benchmark),
index AS (SELECT DISTINCT label, array_to_string(w[i:i + {_RUN_WORDS - 1}], ' ') AS gram FROM (SELECT label, w, unnest(range(1, len(w) - {_RUN_WORDS - 2})) AS i FROM items)),
words AS (SELECT doc_id, {sql_spans("body", "", terms.WORD)} AS w FROM source),
grams AS (SELECT doc_id, array_to_string(list_transform(w[i:i + {_RUN_WORDS - 1}], lambda x: lower(x.value)), ' ') AS gram, w[i].start AS s, w[i + {_RUN_WORDS - 1}]."end" AS e FROM (SELECT doc_id, w, unnest(range(1, len(w) - {_RUN_WORDS - 2})) AS i FROM words)),
hits AS (SELECT DISTINCT doc_id, label, s, e FROM grams JOIN index USING (gram)),
turns AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY doc_id, label ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS new FROM hits),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, label ORDER BY s, e) AS run FROM turns)
SELECT doc_id, label, min(s) AS "start", max(e) AS "end", count(*) AS hits FROM runs GROUP BY doc_id, label, run""",
)
def benchmark_term_runs(spark, sf_dir):
    """Every five words in a row of the benchmark as terms of a dictionary, found in documents and merged to passages."""
    said = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(terms.WORD), F.lit(0)), F.lower)
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item "), "item_id").alias("label"), said.alias("w")).where(F.size("w") >= _RUN_WORDS)
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - (_RUN_WORDS - 1)), lambda i: F.array_join(F.slice("w", i, _RUN_WORDS), " "))
    listed = items.select("label", F.explode(runs).alias("term")).withColumn("stems", F.lit(False))
    return terms.merged(terms.hits(_documents(spark, sf_dir), "doc_id", "text", listed), "doc_id")


@query("html_entity_text", f"SELECT page_id, CAST(length(t) AS BIGINT) AS chars, sha256(t) AS digest FROM (SELECT page_id, {records.sql_html_text('html')} AS t FROM pages)")
def html_entity_text(spark, sf_dir):
    out = table(spark, sf_dir, "pages").select("page_id", records.html_text(F.col("html")).alias("t"))
    return out.select("page_id", F.length("t").cast("long").alias("chars"), F.sha2("t", 256).alias("digest"))


_HIDDEN_COLUMNS = 'doc_id, "start", "end", rule, type'


@query("normalised_hits", f"{oracle.copies_sql(CATALOG, 'text')} SELECT {_HIDDEN_COLUMNS} FROM merged")
def normalised_hits(spark, sf_dir):
    """Findings of documents and of their cleaned copies, at their places in the original."""
    return cleaning.findings(_documents(spark, sf_dir).select("doc_id", "text"), "doc_id").drop("value")


@query("disguised_hits", f"{oracle.copies_sql(CATALOG, planted.disguised_sql())} SELECT {_HIDDEN_COLUMNS} FROM merged")
def disguised_hits(spark, sf_dir):
    """The same where values are split by invisible characters and escapes, or written as entities."""
    return cleaning.findings(spread(planted.disguised(table(spark, sf_dir, "documents"))), "doc_id").drop("value")


def _grid_query(name: str, kind: str, rule: str) -> None:
    @query(name, planted.tables_sql(kind, rule))
    def run(spark, sf_dir):
        return grids.findings(spread(planted.tables(table(spark, sf_dir, "customer"), kind)), "text_id", rules=(rule,))


_grid_query("csv_column_findings", "csv", "csv-personal-column")
_grid_query("insert_column_findings", "insert", "sql-insert-personal-column")
_grid_query("html_column_findings", "html", "html-table-personal-column")


@query("decoded_run_hits", planted.encoded_sql(lambda source, key: f'WITH {oracle.findings_sql(CATALOG, source, key, "body")} SELECT {key}, rule, type FROM findings'))
def decoded_run_hits(spark, sf_dir):
    """Findings behind encoded runs, told of the runs: documents' starts in Base64, in hex, and in Base64 twice."""
    return decoding.findings(spread(planted.encoded(table(spark, sf_dir, "documents"))), "doc_id").drop("value")


@query("session_rate_limit", "SELECT event_id, uses, uses > 20 AS limited FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS uses FROM events)")
def session_rate_limit(spark, sf_dir):
    return reports.rate_limited(table(spark, sf_dir, "events"), "user_id", "ts", 3600, 20).select("event_id", "uses", "limited")


@query("ttl_expiry", "SELECT user_id, max(epoch_us(ts)) AS last_use, count(*) AS uses, (SELECT max(epoch_us(ts)) FROM events) - max(epoch_us(ts)) > 86400000000 AS expired FROM events GROUP BY user_id")
def ttl_expiry(spark, sf_dir):
    return reports.expired(table(spark, sf_dir, "events"), "user_id", "ts", 86_400)


_USES = "SELECT user_id, event_type, epoch_us(ts) AS t, CASE WHEN event_type = 'error' THEN 43200000000 ELSE 172800000000 END AS ttl FROM events WHERE ts IS NOT NULL"


@query(
    "value_lives",
    f"""WITH RECURSIVE uses AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t) AS n FROM ({_USES})),
steps AS (SELECT user_id, event_type, n, t AS first, t AS last, ttl FROM uses WHERE n = 1 UNION ALL
SELECT user_id, event_type, u.n, CASE WHEN u.t > least(last + u.ttl, first + 432000000000) THEN u.t ELSE first END, u.t, u.ttl FROM steps s JOIN uses u USING (user_id, event_type) WHERE u.n = s.n + 1)
SELECT user_id, event_type, first, max(last) AS "last", count(*) AS uses, least(max(last) + any_value(ttl), first + 432000000000) AS expires FROM steps GROUP BY user_id, event_type, first""",
)
def value_lives(spark, sf_dir):
    """A user's events of one type as uses of a value: renewed for two days, errors for half a day, at most five days in all."""
    ttl = lifetimes.ttl_of(F.col("event_type"), {"error": 43_200}, 172_800)
    return lifetimes.lives(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", ttl, 172_800, 432_000)


@query(
    "session_key_limit",
    "SELECT event_id, CAST(len(list_distinct(k)) AS BIGINT) AS keys, len(list_distinct(k)) > 40 AS limited FROM (SELECT event_id, list(user_id) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW) AS k FROM events)",
)
def session_key_limit(spark, sf_dir):
    """Distinct users of each type of event in the six hours up to each event."""
    out = lifetimes.keys_in_session(table(spark, sf_dir, "events"), "event_type", "user_id", "ts", 21_600, 40)
    return out.select("event_id", "keys", "limited")


@query(
    "error_incidents",
    """WITH e AS (SELECT user_id, ts, epoch_us(ts) AS t FROM events WHERE event_type = 'error'),
b AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 86400000000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT user_id, min(t) AS first, max(t) AS last, count(*) AS uses, count(DISTINCT CAST(ts AS DATE)) AS days FROM r GROUP BY user_id, run""",
)
def error_incidents(spark, sf_dir):
    """Errors of a user with less than a day between them."""
    return lifetimes.incidents(table(spark, sf_dir, "events").where("event_type = 'error'"), ["user_id"], "ts", 86_400)


_LISTED = "length(w) BETWEEN 3 AND 8"


@query(
    "seed_phrase_windows",
    rf"""WITH source AS (SELECT doc_id, translate(coalesce(text, ''), chr(57344) || chr(57345), chr(65533) || chr(65533)) AS body FROM documents),
listed AS (SELECT w AS word, row_number() OVER (ORDER BY w) - 1 AS id FROM (SELECT w FROM (SELECT unnest(regexp_extract_all(body, '[a-z]+')) AS w FROM source) WHERE {_LISTED} GROUP BY w ORDER BY count(*) DESC, w LIMIT {phrases.LIST_SIZE})),
runs AS (SELECT doc_id, body, x.start AS s, x."end" AS e, x.value AS run FROM (SELECT doc_id, body, unnest({sql_spans("body", phrases.BEFORE, phrases.RUN)}) AS x FROM source)),
said AS (SELECT doc_id, s, run, w, unnest(range(1, len(w) + 1)) AS i, regexp_matches(run, '[a-z]$') AND regexp_matches(substr(body, e + 1, 1), '[\p{{L}}\p{{N}}_''-]') AS broken FROM (SELECT *, {sql_spans("run", "", phrases.WORD)} AS w FROM runs)),
known AS (SELECT doc_id, s, i, w[i].start AS begins, w[i]."end" AS until, CASE WHEN broken AND i = len(w) THEN NULL ELSE id END AS id, i > 1 AND regexp_full_match(substr(run, w[i - 1]."end" + 1, w[i].start - w[i - 1]."end"), ',?[ \t]{{1,3}}|[ \t]*\r?\n[ \t]*') AS near FROM said LEFT JOIN listed ON word = w[i].value),
isles AS (SELECT *, sum(CASE WHEN id IS NULL OR NOT near OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, s ORDER BY i) AS isle FROM (SELECT *, lag(id) OVER (PARTITION BY doc_id, s ORDER BY i) AS before FROM known)),
sized AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s, isle) AS n FROM isles WHERE id IS NOT NULL) WHERE n BETWEEN 12 AND {phrases.LONGEST_RUN}),
windows AS (SELECT a.doc_id, a.s, a.isle, a.i, k, any_value(a.begins) AS begins, max(b.until) AS until, string_agg(lpad(bin(b.id), 11, '0'), '' ORDER BY b.i) AS bits, count(*) AS n FROM (SELECT *, unnest([12, 15, 18, 21, 24]) AS k FROM sized) a JOIN sized b ON b.doc_id = a.doc_id AND b.s = a.s AND b.isle = a.isle AND b.i BETWEEN a.i AND a.i + k - 1 GROUP BY a.doc_id, a.s, a.isle, a.i, k),
proven AS (SELECT * FROM windows WHERE n = k AND left(lpad(bin(CAST('0x' || left(sha256(unbin(left(bits, k * 32 // 3))), 2) AS INTEGER)), 8, '0'), k // 3) = right(bits, k // 3))
SELECT doc_id, min(s + begins) AS "start", max(s + until) AS "end", CAST(max(k) AS BIGINT) AS words FROM proven GROUP BY doc_id, s, isle""",
)
def seed_phrase_windows(spark, sf_dir):
    """Runs of the documents' 2,048 most frequent short words that close like a seed phrase of that list."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    said = docs.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-z]+"), F.lit(0))).alias("w")).where(F.length("w").between(3, 8))
    top = said.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(phrases.LIST_SIZE)
    listed = sorted(r["w"] for r in top.select("w").collect())  # a list of fixed size
    return phrases.phrases(docs, "doc_id", words=listed).drop("named")


_FIRM_RULES = (*chosen(ids=("de-vat-id", "name-after-german-title")), nearby.POSTCODE)


@query(
    "company_number_release",
    f"""WITH letters AS ({planted.letters_sql()}), {oracle.findings_sql(_FIRM_RULES, "letters", "text_id")},
firms AS (SELECT text_id, x.start AS form, x."end" AS until, greatest(x.start - {nearby.PARAGRAPH}, 0) AS head, substr(body, greatest(x.start - {nearby.PARAGRAPH}, 0) + 1, x.start - greatest(x.start - {nearby.PARAGRAPH}, 0)) AS lead, body FROM (SELECT text_id, body, unnest({sql_spans("body", nearby.COMPANY, nearby.ADDRESS)}) AS x FROM source)),
free AS (SELECT text_id, form, until, form - length(list_last(string_split(lead, chr(10) || chr(10)))) AS since FROM firms WHERE NOT regexp_matches(substr(body, greatest(form - {nearby.EMPLOYED_BEFORE}, 0) + 1, form - greatest(form - {nearby.EMPLOYED_BEFORE}, 0)), '{nearby.EMPLOYED}')),
held AS (SELECT f.text_id, f."start", f."end", max(form) AS form, max(since) AS since FROM findings f JOIN free USING (text_id) WHERE f.type IN {nearby.NUMBERS} AND form BETWEEN f."start" - {nearby.REACH} AND f."start" AND CASE WHEN f.type = 'DE_PLZ' THEN f."end" <= until ELSE f."start" = until END GROUP BY ALL),
gone AS (SELECT text_id, "start", "end" FROM held h WHERE NOT EXISTS (SELECT 1 FROM findings n WHERE n.text_id = h.text_id AND n.type = 'NAME' AND n."start" <= h."start" AND n."start" >= since AND (n."start" >= form OR n."end" < form - 1)))
SELECT f.text_id, f."start", f."end", f.rule, f.type, g.text_id IS NOT NULL AS released FROM findings f LEFT JOIN gone g ON g."start" = f."start" AND g."end" = f."end" AND g.text_id = f.text_id""",
)
def company_number_release(spark, sf_dir):
    """Postcodes, tax numbers and names of letters made of customers, and which numbers a company's address releases."""
    letters = spread(planted.letters(table(spark, sf_dir, "customer")))
    return nearby.released(letters, "text_id", rules=_FIRM_RULES).drop("value")
