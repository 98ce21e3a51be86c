"""Quality by perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

Trusted rows are labelled ones. All of them take part: nine of ten, told by a hash of their ids, train the model, the others
set the thresholds. Counts, continuation counts and contexts are grouped by n-gram and meet in joins. A text's log probability
then is a sum of one number per n-gram: what an n-gram adds to what its shorter ones gave, and the weight that it leaves to
shorter ones as a context. Every text's n-grams meet these numbers in a join, so no process ever holds the model.

With ``sample_rows`` a bounded number of trusted rows, drawn by hash evenly over the languages, trains instead. Then the numbers
are sent to the tasks, their number checked against a bound, and looked up there.

A row is kept if its perplexity is at most its language's quantile over the trusted rows that did not train the model.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellspan.llm.tokens import mixed, slices
from quellspan.session import scratch, written

LONGEST_SAMPLE = 20_000
#: The part of the trusted rows that trains; the rest sets the thresholds.
TRAINS = 0.9
#: Texts meet the model in so many parts, told by their hash, so that the n-grams of one part only lie on disk at a time.
PASSES = 4
#: The quantile of the trusted rows' perplexity, and how far above it a row may still lie.
QUANTILE, SLACK = 0.99, 1.25
MOST_ENTRIES = 12_000_000
SLICE = 2 << 20
START, STOP = np.int64(1), np.int64(2)


# ---- words --------------------------------------------------------------------------------------------------------------


def sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, two starts before and one stop after each, and the row of each place."""
    from xxhash import xxh64_intdigest

    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    own = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    words = lists.flatten().dictionary_encode()
    known = words.dictionary.to_pylist()
    hashes = np.fromiter((xxh64_intdigest(w) for w in known), np.uint64, len(known)).view(np.int64)
    filled = np.fromiter((w != "" for w in known), bool, len(known))
    place = words.indices.to_numpy(zero_copy_only=False)
    keep = filled[place] if len(known) else np.zeros(0, bool)
    hashed, own = hashes[place[keep]] if len(known) else np.zeros(0, np.int64), own[keep]
    counts = np.bincount(own, minlength=len(texts))
    begin = np.cumsum(counts + 3) - (counts + 3)
    seq = np.full(int((counts + 3).sum()), START)
    seq[begin + counts + 2] = STOP
    seq[begin[own] + 2 + np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)] = hashed
    return seq, np.repeat(np.arange(len(texts)), counts + 3)


def key_of(*parts: np.ndarray) -> np.ndarray:
    """One hash of an n-gram or context of word hashes; its length takes part."""
    key = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        key = mixed(key ^ p.astype(np.int64).view(np.uint64), 7)
    return key


# ---- model --------------------------------------------------------------------------------------------------------------


def word_hashes(texts: DataFrame) -> np.ndarray:
    """The distinct word hashes of the sample ``texts(text string)``, in order; a word's number is its place here."""

    def run(batches):
        for batch in batches:
            for cut in slices(batch.column(0), SLICE):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(sequences(cut)[0]))], ["word"])

    found = texts.mapInArrow(run, "word long").distinct().limit(MOST_ENTRIES + 1).toArrow().column(0).to_numpy()
    return np.sort(found)


def trigram_counts(texts: DataFrame, words: np.ndarray | None) -> DataFrame:
    """``(u, v, w, n)`` over ``texts(text string)``, by the words' numbers or, without ``words``, by their hashes."""
    sent = None if words is None else texts.sparkSession.sparkContext.broadcast(words)
    kind = "long" if words is None else "int"

    def run(batches):
        for batch in batches:
            for cut in slices(batch.column(0), SLICE):
                seq, own = sequences(cut)
                if sent is not None:
                    seq = np.searchsorted(sent.value, seq).astype(np.int32)
                at = np.flatnonzero((own[2:] == own[:-2])) + 2
                grams, n = np.unique(np.column_stack([seq[at - 2], seq[at - 1], seq[at]]), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(grams[:, i]) for i in range(3)), pa.array(n, pa.int64())], ["u", "v", "w", "n"])

    return texts.mapInArrow(run, f"u {kind}, v {kind}, w {kind}, n long").groupBy("u", "v", "w").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame, col: str) -> tuple[float, float, float]:
    """The three discounts from how many n-grams occur once to four times; halves of the counts where one would not lie between."""
    many = {r[0]: r[1] for r in counts.where(F.col(col) <= 4).groupBy(col).agg(F.count(F.lit(1)).alias("grams")).collect()}
    n = [many.get(k, 0) for k in (1, 2, 3, 4)]
    y = n[0] / max(n[0] + 2 * n[1], 1)
    found = tuple(k + 1 - (k + 2) * y * n[k + 1] / max(n[k], 1) for k in range(3))
    return found if all(0 < d < k + 1 for k, d in enumerate(found)) else (0.5, 1.0, 1.5)


def _off(col: str, d) -> F.Column:
    return F.when(F.col(col) == 1, d[0]).when(F.col(col) == 2, d[1]).otherwise(d[2])


def _contexts(counts: DataFrame, col: str, d, *keys: str) -> DataFrame:
    """Per context: the total and the weight it leaves to shorter n-grams."""
    return counts.groupBy(*keys).agg(F.sum(col).alias("total"), (F.sum(_off(col, d)) / F.sum(col)).alias("rest"))


def fit(texts: DataFrame, numbered: bool = True) -> dict:
    """The model of ``texts(text)``: per order a table of n-grams with log10 probabilities, per context its log10 weight.

    numbered: words go by numbers that the driver gives them, which bounds their number; else by their hashes.
    """
    words = word_hashes(texts) if numbered else None
    three = written(trigram_counts(texts, words), "kn-3")
    two = written(three.groupBy("v", "w").agg(F.count(F.lit(1)).alias("n")), "kn-2")
    one = written(two.groupBy("w").agg(F.count(F.lit(1)).alias("n")), "kn-1")
    d3, d2, d1 = discounts(three, "n"), discounts(two, "n"), discounts(one, "n")
    total, types, rest = one.agg(F.sum("n"), F.count(F.lit(1)), F.sum(_off("n", d1))).first()
    if not total:
        return {"unknown": 0.0, "words": words, "tables": []}
    unknown = rest / total / (types + 1)
    p1 = one.select("w", ((F.col("n") - _off("n", d1)) / total + unknown).alias("p1"))
    c2 = written(_contexts(two, "n", d2, "v"), "kn-contexts-2")
    p2 = two.join(c2, "v").join(p1, "w").select("v", "w", "p1", "rest", ((F.col("n") - _off("n", d2)) / F.col("total") + F.col("rest") * F.col("p1")).alias("p2"))
    p2 = written(p2, "kn-p2")
    c3 = written(_contexts(three, "n", d3, "u", "v"), "kn-contexts-3")
    p3 = three.join(c3, ["u", "v"]).join(p2.select("v", "w", "p2"), ["v", "w"])
    p3 = p3.select("u", "v", "w", F.log10(((F.col("n") - _off("n", d3)) / F.col("total") + F.col("rest") * F.col("p2")) / (F.col("rest") * F.col("p2"))).alias("add"))
    return {
        "unknown": float(np.log10(unknown)),
        "words": words,
        "tables": [
            (("w",), p1.select("w", F.log10(F.col("p1") / unknown).alias("add"))),
            (("v", "w"), p2.select("v", "w", F.log10(F.col("p2") / (F.col("rest") * F.col("p1"))).alias("add"))),
            (("u", "v", "w"), p3),
            (("v",), c2.select("v", F.log10("rest").alias("add"))),
            (("u", "v"), c3.select("u", "v", F.log10("rest").alias("add"))),
        ],
    }


class Sums:
    """Numbers by n-gram hash, in shards by its leading bits; a number that isn't there is NaN."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.__setstate__((keys[order], values[order].astype(np.float32)))

    def __getstate__(self):
        """Where the shards begin isn't sent, but found again."""
        return self.keys, self.values

    def __setstate__(self, state):
        self.keys, self.values = state
        self.bits = max(1, len(self.keys).bit_length() - 1)
        starts = np.searchsorted(self.keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))
        self.begin = np.append(starts, len(self.keys)).astype(np.int32)

    def get(self, keys: np.ndarray) -> np.ndarray:
        shard = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.begin[shard], self.begin[shard + 1]
        out, left = np.full(len(keys), np.nan, np.float32), np.flatnonzero(at < end)
        while len(left):
            hit = self.keys[at[left]] == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


def lookup_tables(model: dict) -> list[Sums]:
    """Words' numbers, then the model's, n-grams of order 1 to 3 and contexts of order 2 and 3, on the driver: the sample bounds them."""
    words = model["words"]
    out, held = [Sums(key_of(words), np.arange(len(words)))], len(words)
    for names, df in model["tables"]:
        rows = df.select(*names, "add").toArrow().combine_chunks()
        held += rows.num_rows
        if held > MOST_ENTRIES:
            raise ValueError(f"the model has more than {MOST_ENTRIES} entries; lower sample_rows")
        parts = [rows.column(n).to_numpy() for n in names]
        out.append(Sums(key_of(*parts) if rows.num_rows else np.zeros(0, np.uint64), rows.column("add").to_numpy()))
    return out


def log_probabilities(tables: list[Sums], unknown: float, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (stop included) and the log10 probability of each text."""
    n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    row = 0
    for cut in slices(texts, SLICE):
        seq, own = sequences(cut)
        at = np.flatnonzero(own[2:] == own[:-2]) + 2
        size = np.bincount(own[at], minlength=len(cut))
        logs = np.full(len(at), unknown)
        if len(tables) > 1:
            words, grams, pairs, triples, after_one, after_two = tables
            numbers = np.nan_to_num(words.get(key_of(seq)), nan=-1).astype(np.int64)
            u, v, w = numbers[at - 2], numbers[at - 1], numbers[at]
            add = grams.get(key_of(w))
            logs += np.nan_to_num(add)
            rest = after_one.get(key_of(v))
            logs += np.nan_to_num(rest)
            some = np.flatnonzero(~np.isnan(add) & ~np.isnan(rest))
            pair = np.full(len(at), np.nan, np.float32)
            pair[some] = pairs.get(key_of(v[some], w[some]))
            logs += np.nan_to_num(pair)
            # a context of two words was seen only if its second word was seen after its first
            some = np.flatnonzero(~np.isnan(rest))
            rest = after_two.get(key_of(u[some], v[some]))
            logs[some] += np.nan_to_num(rest)
            some = some[~np.isnan(rest) & ~np.isnan(pair[some])]
            logs[some] += np.nan_to_num(triples.get(key_of(u[some], v[some], w[some])))
        n[row : row + len(cut)] = size
        total[row : row + len(cut)] = np.bincount(own[at], logs, len(cut))
        row += len(cut)
    return n, total


# ---- by joins -----------------------------------------------------------------------------------------------------------


def gram_numbers(model: dict) -> DataFrame:
    """``(gram, add)``: what each n-gram's hash brings to a text, as a word in its place and as a context of the next."""

    def run(batches):
        for batch in batches:
            parts = [batch.column(i).to_numpy() for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(key_of(*parts).view(np.int64)), batch.column(batch.num_columns - 1)], ["gram", "add"])

    tables = [df.select(*names, "add").mapInArrow(run, "gram long, add double") for names, df in model["tables"]]
    every = tables[0]
    for df in tables[1:]:
        every = every.unionByName(df)
    return every.groupBy("gram").agg(F.sum("add").alias("add"))


def text_grams(texts: DataFrame) -> DataFrame:
    """``(doc, gram, n)``: how often each n-gram of order 1 to 3 stands in each of ``texts(doc long, text string)``.

    The starts before a text count as its words: they are contexts, and the two of them stand once in each text.
    """

    def run(batches):
        for batch in batches:
            at_row = 0
            for cut in slices(batch.column(1), SLICE):
                seq, own = sequences(cut)
                two, three = (np.flatnonzero(own[k:] == own[:-k]) + k for k in (1, 2))
                keys = np.concatenate([key_of(seq[two]), key_of(seq[two - 1], seq[two]), key_of(seq[three - 2], seq[three - 1], seq[three])])
                row = np.concatenate([own[two], own[two], own[three]])
                order = np.lexsort((keys, row))
                keys, row = keys[order], row[order]
                first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])]))
                n = np.diff(np.append(first, len(keys))).astype(np.int32)
                doc = batch.column(0).slice(at_row, len(cut)).to_numpy()[row[first]]
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(keys[first].view(np.int64)), pa.array(n)], ["doc", "gram", "n"])
                at_row += len(cut)

    return texts.mapInArrow(run, "doc long, gram long, n int")


def scored_by_joins(rows: DataFrame, model: dict) -> DataFrame:
    """``(id, lang, n_tokens, perplexity)`` per row of ``rows(id, lang, text)``; equal texts, told by their hash, share their sums."""

    def run(batches):
        for batch in batches:
            counts = [np.zeros(0, np.int64)]
            for cut in slices(batch.column(3), SLICE):
                lists = pc.ascii_split_whitespace(cut)
                own = np.repeat(np.arange(len(cut)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                counts.append(np.bincount(own[pc.binary_length(lists.flatten()).to_numpy() > 0], minlength=len(cut)) + 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(np.concatenate(counts))], ["id", "lang", "doc", "n_tokens"])

    kind = rows.schema["id"].dataType.simpleString()
    keyed = rows.select("id", "lang", F.xxhash64("text").alias("doc"), "text")
    sized = keyed.mapInArrow(run, f"id {kind}, lang string, doc long, n_tokens long")
    if not model["tables"]:
        return sized.select("id", "lang", "n_tokens", F.lit(1.0).alias("perplexity"))
    starts = int(key_of(np.array([START]), np.array([START])).view(np.int64)[0])
    numbers, sums = written(gram_numbers(model), "kn-numbers"), None
    for k in range(PASSES):
        own = keyed.where(F.pmod("doc", F.lit(PASSES)) == k).select("doc", "text")
        # each text has the two starts once, and any model has them
        met = text_grams(own).join(numbers, "gram").groupBy("doc")
        part = met.agg(F.sum(F.col("n") * F.col("add")).alias("adds"), F.sum(F.when(F.col("gram") == starts, F.col("n"))).alias("copies"))
        part = written(part, "kn-sums")
        sums = part if sums is None else sums.unionByName(part)
    logs = F.col("n_tokens") * model["unknown"] + F.col("adds") / F.col("copies")
    return sized.join(sums, "doc").select("id", "lang", "n_tokens", F.pow(F.lit(10.0), -logs / F.col("n_tokens")).alias("perplexity"))


# ---- operator -----------------------------------------------------------------------------------------------------------


def share_of(col) -> F.Column:
    """A number in [0, 1) from the hash of an id."""
    return F.pmod(F.xxhash64(col, F.lit("trusted")), F.lit(1 << 30)) / float(1 << 30)


def classify(
    docs: DataFrame,
    trusted_ids: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_rows: int | None = None,
    quantile: float = QUANTILE,
    slack: float = SLACK,
) -> DataFrame:
    """Per row: id, lang, n_tokens, perplexity, threshold, kept. ``trusted_ids`` holds the ids of trusted rows in its first column.

    A null text is empty; a null language counts as the empty one. Every trusted row trains the model or sets thresholds, whatever
    its length. sample_rows: a bound on the rows that train instead; then those of more than LONGEST_SAMPLE characters don't. A language without trusted rows left takes the quantile of all of them; without any, every row is kept.
    Repeated rows are judged once each.
    """
    trusted = trusted_ids.select(F.col(trusted_ids.columns[0]).alias("id")).where("id is not null").distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if sample_rows is None:
        chosen = trusted.where(share_of("id") < TRAINS)
        with scratch(docs.sparkSession):
            model = fit(rows.join(chosen, "id", "left_semi").select("text"), numbered=False)
            scored = written(scored_by_joins(rows, model), "kn-scored", keep=True)
        return _judged(docs, id_col, scored, trusted, chosen, quantile, slack)
    marked = written(rows.select("id", "lang", (F.length("text") <= LONGEST_SAMPLE).alias("short")).join(trusted, "id"), "kn-trusted")
    per_lang = {r["lang"]: r.n for r in marked.where("short").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(sample_rows).collect()}
    quota, rate = sample_rows / max(len(per_lang), 1), F.lit(0.0)
    for lang, n in per_lang.items():
        rate = F.when(F.col("lang") == lang, min(1.0, quota / n, 0.5)).otherwise(rate)
    # half of the trusted rows at most, so that the quantiles have rows of their own
    drawn = marked.where(F.col("short") & (share_of("id") < rate)).select("id").distinct()
    ids = [r.id for r in drawn.limit(2 * sample_rows + 1000).collect()]
    if len(ids) >= 2 * sample_rows + 1000:
        raise ValueError("more trusted rows were drawn than the bound allows")
    spark = docs.sparkSession
    chosen = written(spark.createDataFrame([(i,) for i in ids], f"id {docs.schema[id_col].dataType.simpleString()}"), "kn-chosen")
    model = fit(rows.join(F.broadcast(chosen), "id").select("text"))
    sent = spark.sparkContext.broadcast((lookup_tables(model), model["unknown"]))

    def run(batches):
        for batch in batches:
            n, logs = log_probabilities(*sent.value, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(10.0 ** (-logs / n))], ["id", "lang", "n_tokens", "perplexity"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = written(rows.mapInArrow(run, f"id {kind}, lang string, n_tokens long, perplexity double"), "kn-scored")
    return _judged(docs, id_col, scored, trusted, F.broadcast(chosen), quantile, slack)


def _judged(docs: DataFrame, id_col: str, scored: DataFrame, trusted: DataFrame, chosen: DataFrame, quantile: float, slack: float) -> DataFrame:
    """The scored rows with their thresholds, which the trusted rows set that did not train."""
    left = scored.join(trusted, "id", "left_semi").join(chosen, "id", "left_anti")
    cut = F.percentile_approx("perplexity", quantile, 10_000)
    own = written(left.groupBy("lang").agg((cut * slack).alias("own")), "kn-quantiles")
    every = left.agg(cut).first()[0]
    out = scored.join(own, "lang", "left").withColumn("threshold", F.coalesce("own", F.lit(None if every is None else every * slack).cast("double")))
    return out.select(
        F.col("id").alias(id_col), "lang", "n_tokens", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept")
    )
