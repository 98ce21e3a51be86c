"""Registered queries of the training-data operators, each over its whole table, and their SQL twins where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellspan.llm import alignment, brown, chat, kneser_ney, lines, merkle, mixing, pieces, quality, simhash, tokens, toxicity, vectors
from quellspan.session import table


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.with_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), "ids_crc32", "lossless")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    out = chat.format_records(chat.gathered(rows)).select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("back"), chat.trained_text(F.col("formatted"), F.col("mask")).alias("loss"))
    whole = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_sql() -> str:
    text = "replace(text, '\\', '\\\\')"
    for c in chat.CONTROL:
        text = f"replace({text}, '{c}', '{c[0]}\\{c[1:]}')"
    role = "replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C')"
    return f"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss, {len(chat.START) + 1 + len(chat.END)} + length({role}) + length({text}) AS chars FROM said)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(sum(length(loss)) AS BIGINT) AS loss_chars,
    sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id"""


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return kneser_ney.classify(table(spark, sf_dir, "documents"), trusted)


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(table(spark, sf_dir, "documents"), keep_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_sql(rows: str = "documents") -> str:
    """The statistics by unnested windows, the sketches and fences by grouped counts."""
    space, million, sub = r"[\x20\x09-\x0D]", quality.MILLION, 1 << quality.SUB
    ratio = {r.name: f"{r.part} * {million} // greatest({r.of}, 1)" for r in quality.RULES}
    shift = lambda v: f"greatest(length(bin({v})) - {quality.SUB + 1}, 0)"
    points = " UNION ALL ".join(f"SELECT grp_lang, grp_source, '{k}' AS rule, CAST({v} AS BIGINT) AS v FROM judged WHERE NOT base_failed" for k, v in ratio.items())
    floor = lambda b: f"(({b} - greatest({b} // {sub} - 1, 0) * {sub}) << CAST(greatest({b} // {sub} - 1, 0) AS INTEGER))"
    slack = " ".join(f"WHEN rule = '{r.name}' THEN {r.slack}" for r in quality.RULES)
    pick = lambda r, side: f"coalesce((SELECT {side} FROM fence f WHERE f.level = 2 AND f.rule = '{r}' AND f.grp_lang = g.grp_lang AND f.grp_source = g.grp_source), (SELECT {side} FROM fence f WHERE f.level = 1 AND f.rule = '{r}' AND f.grp_lang = g.grp_lang), (SELECT {side} FROM fence f WHERE f.level = 0 AND f.rule = '{r}'))"
    limits = ", ".join(f"{pick(r.name, side)} AS {r.name}_{side}" for r in quality.RULES for side in ("low", "high"))
    inside = " AND ".join(f"{ratio[r.name]} <= {r.name}_high" + (f" AND {ratio[r.name]} >= {r.name}_low" if r.low else "") for r in quality.RULES)
    return rf"""
WITH numbered AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS body, coalesce(lang, '') AS grp_lang, coalesce(source, '') AS grp_source FROM {rows}),
cut AS (
    SELECT *, list_filter(string_split_regex(body, '{space}+'), lambda w: w <> '') AS words,
        list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines
    FROM numbered
),
windows AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS gram FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM cut WHERE len(words) >= 8)),
twice AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS c FROM windows) WHERE c > 1),
covered AS (SELECT rid, sum(least(8, coalesce(following - i, 8))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS following FROM twice) GROUP BY rid),
stats AS (
    SELECT cut.*, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines
    FROM cut LEFT JOIN covered USING (rid)
),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM stats),
points AS ({points}),
sketch AS (SELECT grp_lang, grp_source, rule, {shift("v")} * {sub} + (v >> CAST({shift("v")} AS INTEGER)) AS bucket, count(*) AS n FROM points GROUP BY ALL),
levels AS (
    SELECT 2 AS level, grp_lang, grp_source, rule, bucket, n FROM sketch
    UNION ALL SELECT 1, grp_lang, '', rule, bucket, n FROM sketch UNION ALL SELECT 0, '', '', rule, bucket, n FROM sketch
),
merged AS (SELECT level, grp_lang, grp_source, rule, bucket, sum(n) AS n FROM levels GROUP BY ALL),
counted AS (
    SELECT *, sum(n) OVER (PARTITION BY level, grp_lang, grp_source, rule ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS below,
        sum(n) OVER (PARTITION BY level, grp_lang, grp_source, rule) AS total
    FROM merged
),
quarters AS (
    SELECT level, grp_lang, grp_source, rule, max(total) AS total, min(CASE WHEN below * 4 >= total THEN bucket END) AS b1, min(CASE WHEN below * 4 >= total * 3 THEN bucket END) AS b3
    FROM counted GROUP BY ALL
),
quartiles AS (SELECT *, {floor("b1")} AS q1, {floor("b3")} AS q3 FROM quarters WHERE level = 0 OR total >= {quality.LEAST_ROWS}),
fence AS (SELECT *, q1 - {quality.WIDTH} * greatest(q3 - q1, CASE {slack} END) AS low, q3 + {quality.WIDTH} * greatest(q3 - q1, CASE {slack} END) AS high FROM quartiles),
fences AS (SELECT grp_lang, grp_source, {limits} FROM (SELECT DISTINCT grp_lang, grp_source FROM sketch) g)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({inside}, TRUE) AS kept
FROM judged LEFT JOIN fences USING (grp_lang, grp_source)"""


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, max_distance=2, seed=42)


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, answers=20)


def op10_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op8_sql() -> str:
    topic = " ".join(f"WHEN contains(text, '{mark}') THEN '{name}'" for name, mark in mixing.TOPICS)
    space = r"[\x20\x09-\x0D]+"
    steps, last = [], "w0"
    for n in range(mixing.ROUNDS):
        for d in mixing.DIMENSIONS:
            step = f"w{n + 1}_{d}"
            steps.append(f"{step} AS (SELECT * REPLACE (w * t_{d} / sum(w) OVER (PARTITION BY {d}) AS w) FROM {last})")
            last = step
    shares = ", ".join(f"t{d} AS (SELECT {d}, pow(sum(tokens), {mixing.POWERS[d]}) AS share FROM cells GROUP BY {d})" for d in mixing.DIMENSIONS)
    given = ", ".join(f"share_{d} / (SELECT sum(share) FROM t{d}) AS t_{d}" for d in mixing.DIMENSIONS)
    joins = " ".join(f"JOIN (SELECT {d}, share AS share_{d} FROM t{d}) USING ({d})" for d in mixing.DIMENSIONS)
    return rf"""
WITH labelled AS (
    SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE {topic} ELSE 'prose' END AS topic,
        CAST(len(list_filter(string_split_regex(coalesce(text, ''), '{space}'), lambda w: w <> '')) AS BIGINT) AS n_tokens
    FROM documents
),
counts AS (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM labelled GROUP BY ALL),
cells AS (SELECT * FROM counts WHERE tokens > 0),
{shares},
w0 AS (SELECT source, lang, topic, tokens, CAST(tokens AS DOUBLE) / (SELECT sum(tokens) FROM cells) AS w, {given} FROM cells {joins}),
{", ".join(steps)},
weights AS (SELECT source, lang, topic, w * (SELECT sum(tokens) FROM cells) / tokens AS weight FROM {last}),
drawn AS (
    SELECT *, round(least(1.0, coalesce(weight, 0.0) / (SELECT max(weight) FROM weights)), 6) AS probability,
        CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':17'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS chance
    FROM labelled LEFT JOIN weights USING (source, lang, topic)
)
SELECT doc_id, source, lang, topic, n_tokens, round(coalesce(weight, 0.0), 6) AS weight, probability, chance < probability AS kept FROM drawn"""


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, id_ = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    tampered = F.when(F.crc32(id_) % 3 == 0, merkle.lowered(F.col("text"))).otherwise(F.col("text"))
    return merkle.manifest(docs, ("doc_id", "source", "lang", "n_chars", "text"), shown={"text": tampered})


def op11_sql(levels: int = 12) -> str:
    """The same trees level by level, for up to 8 ** levels leaves; each row's proof is gathered and folded on the way up."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    ctes = [
        # lower() would fold other letters too: A-Z one by one
        f"rows_ AS (SELECT row_number() OVER () AS rid, *, CASE WHEN ({_crc32_sql('CAST(doc_id AS VARCHAR)')}) % 3 = 0 THEN translate(text, '{merkle.UPPER}', '{merkle.LOWER}') ELSE text END AS shown FROM documents)",
        f"hashed AS (SELECT rid, doc_id, lang, {leaf('text')} AS leaf, {leaf('shown')} AS other FROM rows_)",
        "p0 AS (SELECT rid, lang AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, other AS fold, '' AS proof FROM hashed)",
        "n0 AS (SELECT lang AS tree, i, leaf AS d, n FROM hashed JOIN p0 USING (rid))",
    ]

    def climb(name: str, first: int) -> None:
        """Levels of nodes n and of paths p; a tree of one node stays as it is."""
        for k in range(first, first + levels):
            ctes.append(f"r{k} AS (SELECT tree, i, d, n, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM n{k} WINDOW w AS (PARTITION BY tree, i // 8 ORDER BY i))")
            ctes.append(f"n{k + 1} AS (SELECT tree, i // 8 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d, (any_value(n) + 7) // 8 AS n FROM n{k} GROUP BY tree, i // 8)")
            ctes.append(f"p{k + 1} AS (SELECT rid, p.tree, p.i // 8 AS i, CASE WHEN r.n > 1 THEN sha256(l || fold || r) ELSE fold END AS fold, CASE WHEN r.n > 1 THEN proof || l || r ELSE proof END AS proof FROM p{k} p JOIN r{k} r ON p.tree IS NOT DISTINCT FROM r.tree AND p.i = r.i)")

    climb("tree", 0)
    top = levels + 1
    ctes.append(f"n{top} AS (SELECT '' AS tree, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS i, d, count(*) OVER () AS n, tree AS of FROM n{levels})")
    ctes.append(f"p{top} AS (SELECT rid, '' AS tree, i, fold, proof, d AS subroot FROM (SELECT rid, tree, fold, proof FROM p{levels}) p JOIN (SELECT of, i, d FROM n{top}) t ON p.tree IS NOT DISTINCT FROM t.of)")
    climb("forest", top)
    end = top + levels
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, leaf, subroot, d AS root, sha256(p.proof) AS proof_sha256, p.fold AS folded_root, p.fold = d AS verified, CAST(log_position AS BIGINT) AS log_position
FROM hashed JOIN p{end} p USING (rid) JOIN p{top} q USING (rid) CROSS JOIN n{end}
JOIN (SELECT rid, {" + ".join(f"(i // CAST(pow(8, {m}) AS BIGINT)) * CAST(n > CAST(pow(8, {m - 1}) AS BIGINT) AS BIGINT)" if m else "i" for m in range(levels + 1))} AS log_position FROM p0) USING (rid)"""


def _crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a short text of one-byte characters, bit by bit."""
    bits = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    codes = f"list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda a, b: ({bits})), 4294967295)"


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op4_lines": op4_lines, "op3_kneser_ney": op3_kneser_ney, "op9_vectors": op9_vectors, "op8_mixing": op8_mixing, "op1_pieces": op1_pieces, "op6_quality": op6_quality, "op2_chat": op2_chat, "op5_tokens": op5_tokens, "op10_brown": op10_brown, "op7_simhash": op7_simhash, "op11_merkle": op11_merkle, "op12_alignment": op12_alignment, "op13_toxicity": op13_toxicity}
ORACLE_SQL: dict[str, str] = {"op2_chat": op2_sql(), "op6_quality": op6_sql(), "op8_mixing": op8_sql(), "op11_merkle": op11_sql()}
