"""Toxicity by a linear classifier that is held to the same score when groups of people are swapped.

A text is taken as the rates of its words and their beginnings: how often each stands in 100 words, the text counted as 20
words longer, so that a short text isn't judged by one unlucky word. The logistic model is fitted on labelled rows with a
penalty on what a swap changes: wherever a labelled text names a group of people, counterfactual texts name others of the
same kind in its place, and the squared difference of the two scores is added to the loss. A group that abusive texts
happen to name more often thus can't carry weight of its own, and neutral mentions of it aren't taken for abuse.

The fit reads a bounded sample: about ``sample_rows`` labelled rows, drawn by a hash of their ids, whole texts; it is the
one thing computed on the driver, and what it reads doesn't grow with the corpus. Every row is scored, in the tasks, whole.

Rows: null and empty texts have the score of a text without words. Very long texts are read in slices and whole. Repeated
rows have equal scores; in the fit a repeated (id, text) counts once, and an id with several labels is toxic if one says
so. Null ids have no label and are never held out. Without any labelled row every score is the same, and low. An empty table
has no rows here. Columns of the table that are named like the added ones give way to them; all others stay.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quellspan.llm.tokens import slices
from quellspan.session import written

SAMPLE_ROWS = 20_000
#: Lengths of beginnings, words that a text is counted longer by, and labelled texts that must hold a feature.
SHORTEST, LONGEST, PADDING, LEAST_TEXTS = 3, 9, 20, 8
#: The fit: rounds, step, weight decay and the weight of the counterfactual penalty; swaps tried for each mention.
ROUNDS, STEP, DECAY, PENALTY, SWAPS = 150, 0.5, 3e-3, 1.0, 2
#: Features of the model, the heaviest; so it has a bound.
MOST_FEATURES = 1 << 17
THRESHOLD = 0.3
MOST_CACHED = 1_000_000

#: Words that name groups of people, by kind; each may stand for the others of its line.
IDENTITIES = tuple(
    tuple(line.split())
    for line in """
women men
woman man
girls boys
girl boy
muslims christians jews hindus buddhists sikhs atheists catholics protestants
muslim christian jewish hindu buddhist sikh atheist catholic protestant
gay lesbian straight bisexual transgender queer heterosexual
blacks whites asians latinos arabs
black white asian latino arab hispanic
americans mexicans germans chinese indians africans turks russians europeans
american mexican german indian african turkish russian european
immigrants refugees foreigners natives migrants
immigrant refugee foreigner native migrant
disabled deaf blind autistic
frauen männer
frau mann
mädchen jungen
muslime christen juden hindus buddhisten atheisten katholiken protestanten
muslimisch christlich jüdisch katholisch evangelisch
schwule lesben heteros transsexuelle
schwarze weiße asiaten araber
deutsche türken polen russen franzosen afrikaner amerikaner
ausländer einheimische flüchtlinge einwanderer migranten
mujeres hombres
mujer hombre
musulmanes cristianos judíos budistas ateos católicos
gays lesbianas heterosexuales bisexuales
negros blancos asiáticos árabes latinos
españoles mexicanos alemanes chinos africanos americanos
inmigrantes refugiados extranjeros nativos
femmes hommes
femme homme
musulmans chrétiens juifs bouddhistes athées catholiques
homosexuels lesbiennes hétérosexuels bisexuels
noirs blancs asiatiques arabes
français allemands turcs chinois africains américains
immigrés réfugiés étrangers
""".strip().splitlines()
)
WORD = re.compile(r"\w+")


@cache
def others() -> dict[str, tuple[str, ...]]:
    """The words that may stand in place of each; a word of several kinds has those of its first."""
    out: dict[str, tuple[str, ...]] = {}
    for kind in IDENTITIES:
        for i, term in enumerate(kind):
            out.setdefault(term, kind[i + 1 :] + kind[:i])
    return out


def features(word: str) -> list[str]:
    """The word and its beginnings."""
    return [f"{word}$", *(word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1))]


def occurrences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The row and the stretch of each occurrence, and the distinct stretches between white space."""
    lists = pc.utf8_split_whitespace(texts.fill_null(""))
    own = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    stretches = lists.flatten().dictionary_encode()
    return own, stretches.indices.to_numpy(zero_copy_only=False).astype(np.int64), stretches.dictionary.to_pylist()


# ---- the fit --------------------------------------------------------------------------------------------------------------


def _bags(batches):
    for batch in batches:
        for cut in slices(batch.column("text")):
            own, place, distinct = occurrences(cut)
            words = [WORD.findall(s.lower()) for s in distinct]
            table = pa.array([w for ws in words for w in ws], pa.string()).dictionary_encode()
            many = np.fromiter(map(len, words), np.int64, len(words))
            at, number = np.cumsum(many) - many, table.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            reach = many[place] if len(place) else np.zeros(0, np.int64)
            spread = np.repeat(at[place], reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
            size = max(len(table.dictionary), 1)
            cells, counts = np.unique(np.repeat(own, reach) * size + number[spread], return_counts=True)
            edges = np.searchsorted(cells, np.arange(len(cut) + 1) * size)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(edges, pa.int32()), x) for x in (table.dictionary.take(pa.array(cells % size)), pa.array(counts, pa.int32()))], ["words", "counts"])


def _rows(batches):
    """The bags beside the rows' other columns."""
    for batch in batches:
        found = pa.Table.from_batches(list(_bags([batch])), pa.schema({"words": pa.list_(pa.string()), "counts": pa.list_(pa.int32())})).combine_chunks()
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("toxic"), *(c.combine_chunks() for c in found.columns)], ["place", "toxic", "words", "counts"])


def class_of(word: str, kept: set[str]) -> str:
    """What the fit takes a word for: words of the same kept features are alike. Itself, if it is kept or names a group of
    people, else its longest kept beginning (shorter beginnings are in no fewer texts); empty if there is none."""
    if f"{word}$" in kept or word in others():
        return f"{word}$"
    return next((word[:n] for n in range(min(len(word), LONGEST), SHORTEST - 1, -1) if word[:n] in kept), "")


def parts(name: str) -> list[str]:
    """The features of a class of words."""
    return features(name[:-1]) if name.endswith("$") else [name[:n] for n in range(SHORTEST, len(name) + 1)]


def kept_features(bags: DataFrame, least: int) -> list[str]:
    """The features that stand in at least so many texts, a text counted once for each of its words."""
    word = F.col("word")
    begins = F.when(F.length(word) >= SHORTEST, F.transform(F.sequence(F.lit(SHORTEST), F.least(F.length(word), F.lit(LONGEST))), lambda n: F.substring(word, F.lit(1), n))).otherwise(F.array())
    words = bags.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("texts"))
    found = words.select(F.explode(F.concat(F.array(F.concat(word, F.lit("$"))), begins)).alias("feature"), "texts").groupBy("feature").agg(F.sum("texts").alias("texts"))
    return sorted(found.where(F.col("texts") >= least).select("feature").toArrow().column(0).to_pylist())


def _classed(kept: list[str], names: dict[str, int]):
    def run(batches):
        known, cache = set(kept), {}
        for batch in batches:
            lists, rows = batch.column("words"), {"size": [], "classes": [], "counts": []}
            for words, counts in zip(lists.to_pylist(), batch.column("counts").to_pylist()):
                own: dict[int, int] = {}
                for w, c in zip(words, counts):
                    if w not in cache:
                        cache[w] = names.get(class_of(w, known), -1)
                    if cache[w] >= 0:
                        own[cache[w]] = own.get(cache[w], 0) + c
                rows["size"].append(sum(counts))
                rows["classes"].append(list(own))
                rows["counts"].append(list(own.values()))
            kinds = {"size": pa.int64(), "classes": pa.list_(pa.int32()), "counts": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("toxic"), *(pa.array(v, kinds[k]) for k, v in rows.items())], ["place", "toxic", *rows])

    return run


def swaps(own: np.ndarray, place: np.ndarray, count: np.ndarray, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What swapping changes: the pair, its row, and the classes whose counts rise and fall, with by how much.

    Each row that names groups gives ``SWAPS`` counterfactual texts; in the k-th every term has become the k-th after it.
    """
    named = {number[f"{t}$"]: alike for t, alike in others().items()}
    hits = np.flatnonzero(np.isin(place, np.fromiter(named, np.int64, len(named))))
    out = []
    for k in range(SWAPS):
        for h in hits.tolist():
            alike = named[int(place[h])]
            for name, c in ((int(place[h]), -count[h]), (number[f"{alike[k % len(alike)]}$"], count[h])):
                out.append((int(own[h]) * SWAPS + k, int(own[h]), name, int(c)))
    return tuple(np.array(out, np.int64).reshape(-1, 4).T)


def fit(bags: pa.Table, kept: list[str], names: dict[str, int], penalty: float = PENALTY) -> tuple[dict[str, float], float]:
    """Weights by feature and the constant, of ``(toxic, size, classes, counts)``; names: the number of each class."""
    y = bags["toxic"].to_numpy().astype(float)
    n, lists = len(y), bags["classes"].combine_chunks()
    prior = (y.sum() + 0.5) / (n + 10)
    constant = float(np.log(prior / (1 - prior)))
    if not n or not kept:
        return {}, constant
    own = np.repeat(np.arange(n, dtype=np.int32), pc.list_value_length(lists).to_numpy())
    place, count = lists.flatten().to_numpy(), bags["counts"].combine_chunks().flatten().to_numpy()
    per = 100 / (bags["size"].to_numpy() + PADDING)
    rate = count * per[own]
    pair, row, moved, change = swaps(own, place, count, names)
    pair_of = np.unique(pair, return_inverse=True)[1]
    pairs, shift = int(pair_of.max(initial=-1)) + 1, change * per[row]

    of = {k: i for i, k in enumerate(kept)}
    held = [[of[k] for k in parts(name) if k in of] for name in names]
    class_, key = np.repeat(np.arange(len(held)), [len(x) for x in held]), np.array([k for x in held for k in x], np.int64)
    weight, gained, fell = np.zeros(len(kept)), np.full(len(kept), 1e-8), 1e-8
    for _ in range(ROUNDS):
        by_class = np.bincount(class_, weight[key], len(names))
        wrong = (1 / (1 + np.exp(-np.clip(np.bincount(own, rate * by_class[place], n) + constant, -60, 60))) - y) / n
        pull = np.bincount(place, rate * wrong[own], len(names))
        if pairs and penalty:
            apart = np.bincount(pair_of, shift * by_class[moved], pairs)
            pull += np.bincount(moved, shift * (2 * penalty / pairs * apart)[pair_of], len(names))
        slope = np.bincount(key, pull[class_], len(kept)) + DECAY * weight
        gained += slope**2
        weight -= STEP * slope / np.sqrt(gained)
        fell += wrong.sum() ** 2
        constant -= STEP * wrong.sum() / np.sqrt(fell)
    heaviest = np.argsort(-np.abs(weight), kind="stable")[:MOST_FEATURES]
    return {kept[i]: float(weight[i]) for i in heaviest.tolist() if weight[i]}, float(constant)


def sample(docs: DataFrame, labels: DataFrame, train: Column, rows: int, id_col: str, text_col: str) -> DataFrame:
    """``(place, toxic, text)`` of about ``rows`` labelled rows at most; ``train``: which ids may be read, of the column ``id``."""
    told = labels.select(F.col(id_col).alias("id"), "toxic").where(F.col("toxic").isNotNull() & train).groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"))
    told = written(told.withColumn("draw", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30))), "toxicity-labels")
    share = min(1.0, rows / max(told.count(), 1))
    drawn = F.broadcast(told.where(F.col("draw") < share * (1 << 30)).select("id", "toxic"))  # about ``rows`` ids at most
    met = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(drawn, "id").withColumn("place", F.xxhash64("id", "text"))
    met = written(met.dropDuplicates(["id", "place"]).select("place", "toxic", "text"), "toxicity-sample")
    n = met.count()  # one id may have very many texts
    return met if n <= 2 * rows else met.where(F.pmod(F.col("place"), F.lit(n)) < rows)


def trained(docs: DataFrame, labels: DataFrame, train: Column, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY, least: int = LEAST_TEXTS) -> tuple[dict[str, float], float]:
    """The model of labelled rows."""
    rows = sample(docs, labels, train, sample_rows, id_col, text_col)
    bags = written(rows.mapInArrow(_rows, "place long, toxic int, words array<string>, counts array<int>"), "toxicity-bags")
    kept = kept_features(bags, least)
    names = {k: i for i, k in enumerate(dict.fromkeys([*kept, *(f"{t}$" for t in others())]))}
    schema = "place long, toxic int, size long, classes array<int>, counts array<int>"
    return fit(bags.mapInArrow(_classed(kept, names), schema).toArrow().sort_by([("place", "ascending"), ("toxic", "ascending")]), kept, names, penalty)


# ---- scores ---------------------------------------------------------------------------------------------------------------


class Scorer:
    """The weights of stretches; each distinct one is looked at once per worker."""

    def __init__(self, weights: dict[str, float], constant: float):
        self.weights, self.constant, self.cache = weights, constant, {}

    def _weigh(self, stretch: str) -> tuple[float, int]:
        words = WORD.findall(stretch.lower())
        return sum(self.weights.get(k, 0.0) for w in words for k in features(w)), len(words)

    def scores(self, texts: pa.Array) -> np.ndarray:
        if len(self.cache) > MOST_CACHED:
            self.cache.clear()
        own, place, distinct = occurrences(texts)
        for s in distinct:
            if s not in self.cache:
                self.cache[s] = self._weigh(s)
        table = np.array([self.cache[s] for s in distinct], float).reshape(-1, 2)
        sums, words = (np.bincount(own, table[place, i], len(texts)) for i in (0, 1))
        return 1 / (1 + np.exp(-np.clip(self.constant + sums * 100 / (words + PADDING), -60, 60)))


def score(text: Column, model: tuple[dict[str, float], float], spark) -> Column:
    """The toxicity of each text from 0 to 1."""
    sent, own = spark.sparkContext.broadcast(model), []  # at most MOST_FEATURES short texts

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        if not own:
            own.append(Scorer(*sent.value))
        found = [own[0].scores(cut) for cut in slices(texts.fill_null(""))]
        return pa.array(np.concatenate(found) if found else np.zeros(0))

    return run(text)


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, folds: int = 4, held: int = 2) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``; rows of the fold ``held`` by crc32 of the id lend no labels."""
    fold = lambda id_: F.crc32(id_.cast("string")) % folds
    model = trained(docs, labels, fold(F.col("id")) != held, sample_rows, id_col, text_col)
    rest = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    out = docs.select(*rest, F.coalesce(fold(F.col(id_col)) == held, F.lit(False)).alias("held_out"), score(F.col(text_col), model, docs.sparkSession).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
