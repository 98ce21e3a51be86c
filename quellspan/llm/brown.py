"""Brown class-based bigram model: exchange clustering, class transitions and word emissions.

The log10 probability of a text is the sum over its tokens of P(class | class before) * P(token | class).

* Words are counted over all training rows. The most frequent ones (at most ``exchanged``) are assigned to ``classes``
  classes by exchange: a word moves to the class that raises the likelihood of the class bigrams most. Every other word
  belongs to a shape class, a function of its last two bytes; the end of a text is a class of its own.
* Unless ``exchanged`` bounds the words with a class, every other training word then moves out of its shape class to the
  class that it fits best by all its neighbours, if the log likelihood gains more than it costs to name one of the classes
  (:func:`placed_words`), and class bigrams are counted anew over all training rows.
* Bigrams are counted over all training rows between units: exchanged words, shape classes and the end. A unit's counts
  stay in one row of a block, so a round of exchange is one Spark job over the blocks against a snapshot of the class
  counts; a third of the words may move in each round, and the best assignment seen is used.
* Counts of at most ``head`` frequent words of at most ``LONGEST`` bytes go to the tasks as a bounded dictionary; all
  other words of the texts meet their counts in a join.
"""

from __future__ import annotations

import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellspan.llm.tokens import slices
from quellspan.session import written

LONGEST = 64
SHAPES = 32
BLOCKS = 64
MOST_WORDS = 400_000
#: Words outside the exchange whose neighbours a worker gathers before it passes them on.
HELD = 800_000
#: Bytes of text that are cut to words at once; each distinct word among them is looked up once.
SLICE = 8 << 20


def shape(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SHAPES


def held_out_column(id_col: str, folds: int = 7, fold: int = 2):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(folds)) == fold


def values(column: pa.Array) -> list:
    """The values of a column of binary or lists (those as arrays); ``to_pylist`` makes a scalar of each first, which takes some ten times as long."""
    return column.to_numpy(zero_copy_only=False).tolist()


def cut_to_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of binary texts, one after another (some of them empty), and how many each text has of them."""
    # a view: bytes need not be UTF-8, only ASCII is looked at
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null(b"").view(pa.string())))
    return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, n)`` over all rows of ``texts(text binary)``; the end of a text counts as the empty word."""

    def run(batches):
        from collections import Counter

        counts = Counter()

        def out():
            words = list(counts)
            for at in range(0, len(words), 50_000):
                cut = words[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary()), pa.array([counts[w] for w in cut], pa.int64())], ["word", "n"])
            counts.clear()

        for batch in batches:
            for text in values(batch.column(0)):
                counts.update((text or b"").lower().split())
                counts[b""] += 1
                if len(counts) > MOST_WORDS:
                    yield from out()
        yield from out()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def cut_for(vocabulary: DataFrame, most: int) -> int:
    """The least count so that at most ``most`` words have it or more."""
    kept, cut = 0, None
    per_count = vocabulary.where(f"length(word) between 1 and {LONGEST}").groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    upper = per_count.orderBy(F.desc("n")).limit(most + 1).collect()
    for row in upper:
        if kept + row.words > most:
            return row.n + 1
        kept, cut = kept + row.words, row.n
    return cut or 1


class Head:
    """The frequent words with their counts; a dictionary of bounded size."""

    def __init__(self, words: list[bytes], counts: np.ndarray, exchanged: int):
        self.words, self.counts, self.exchanged = words, counts, exchanged
        self._index = None

    def __getstate__(self):
        return self.words, self.counts, self.exchanged

    def __setstate__(self, state):
        self.__init__(*state)

    @property
    def units(self) -> int:
        return self.exchanged + SHAPES + 1

    def read(self, texts: pa.Array):
        """Per text: each word's place in the head (-1: none), where those without one stand, these words, and the units of all
        words with the end before and after."""
        if self._index is None:
            self._index = dict(zip(self.words, range(len(self.words))))
        for cut in slices(texts, SLICE):
            flat, counts = cut_to_words(cut)
            coded = flat.dictionary_encode()
            known = values(coded.dictionary.view(pa.binary()))
            place = np.fromiter(map(self._index.get, known, repeat(-1)), np.int64, len(known))
            unit = place.copy()
            for i in np.flatnonzero((place < 0) | (place >= self.exchanged)).tolist():
                unit[i] = self.exchanged + shape(known[i])
            filled = np.fromiter(map(len, known), np.int64, len(known)) > 0
            number = coded.indices.to_numpy(zero_copy_only=False)
            keep = filled[number] if len(known) else np.zeros(0, bool)
            ends = np.append(0, np.cumsum(np.bincount(np.repeat(np.arange(len(cut)), counts)[keep], minlength=len(cut))))
            number = number[keep]
            for a, b in zip(ends.tolist(), ends[1:].tolist()):
                own = number[a:b]
                places = place[own]
                units = np.full(b - a + 2, self.units - 1, np.int64)
                units[1:-1] = unit[own]
                rest = np.flatnonzero(places < 0)
                yield places, rest, [known[i] for i in own[rest].tolist()], units


def unit_blocks(texts: DataFrame, head) -> DataFrame:
    """One row per block of units: the counts of all bigrams that start (succ) and end (pred) in one of its units.

    A unit's block is its number modulo BLOCKS, so frequent words are spread. Each is kept as units * BLOCKS counts at most.
    """
    n_units = head.value.units
    wide = n_units // BLOCKS + 1

    def count(batches):
        for batch in batches:
            h = head.value
            pairs = []
            for _, _, _, units in h.read(batch.column(0)):
                pairs.append(units[:-1] * n_units + units[1:])
            if not pairs:
                continue
            keys, n = np.unique(np.concatenate(pairs), return_counts=True)
            sides = (keys // n_units, keys % n_units)
            out = []
            for way, (own, other) in enumerate((sides, sides[::-1])):
                cell = own // BLOCKS * n_units + other
                order = np.lexsort((cell, own % BLOCKS))
                edges = np.searchsorted((own % BLOCKS)[order], np.arange(BLOCKS + 1))
                for b in range(BLOCKS):
                    at = order[edges[b] : edges[b + 1]]
                    if len(at):
                        out.append((b, way, cell[at].astype(np.int32).tobytes(), n[at].astype(np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["block", "way", "cell", "n"]
            )

    def merge(batches):
        held, now = None, None
        for batch in batches:
            for b, way, cell, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if now != b:
                    if now is not None:
                        yield packed(now, held)
                    now, held = b, np.zeros((2, wide * n_units), np.int64)
                held[way][np.frombuffer(cell, np.int32)] += np.frombuffer(n, np.int64)
        if now is not None:
            yield packed(now, held)

    def packed(b, held):
        row = [b]
        for side in held:
            cell = np.flatnonzero(side)
            row += [cell.astype(np.int32).tobytes(), side[cell].tobytes()]
        kinds = (pa.int32(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], ["block", "succ", "succ_n", "pred", "pred_n"])

    parts = texts.mapInArrow(count, "block int, way int, cell binary, n binary")
    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, succ binary, succ_n binary, pred binary, pred_n binary")


def _f(x):
    return x * np.log(np.maximum(x, 1))


def best_class(s: np.ndarray, p: np.ndarray, self_n: float, a: int, table: np.ndarray, classes: int) -> tuple[int, float]:
    """The class that a word of class ``a`` should move to and the gain in log likelihood.

    s, p: counts of the classes after and before the word; table: class bigram counts.
    """
    s, p, m = s.copy(), p.copy(), table.copy()
    rows, cols, n_s, n_p = m.sum(1), m.sum(0), s.sum(), p.sum()
    rows[a] -= n_s
    cols[a] -= n_p
    m[a] -= s
    m[:, a] -= p
    m[a, a] += self_n
    s[a] -= self_n
    p[a] -= self_n
    gain_row = _f(m + s[None, :]) - _f(m)
    gain_col = _f(m + p[:, None]) - _f(m)
    own = np.arange(len(m))
    own_cell = m[own, own]
    gain = gain_row.sum(1) - gain_row[own, own] + gain_col.sum(0) - gain_col[own, own] + _f(own_cell + s + p + self_n) - _f(own_cell)
    gain -= _f(rows + n_s) - _f(rows) + _f(cols + n_p) - _f(cols)
    b = int(np.argmax(gain[:classes]))
    return b, float(gain[b] - gain[a])


def exchange(blocks: DataFrame, exchanged: int, classes: int = 64, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Class of each unit and the class bigram counts under it. The class table and the assignment have a fixed size."""
    spark = blocks.sparkSession
    n_units = exchanged + SHAPES + 1
    n_classes = classes + SHAPES + 1
    fixed = classes + np.arange(SHAPES + 1)

    def job(assigned, table, turn):
        sent = spark.sparkContext.broadcast((assigned, table))

        def run(batches):
            cls, m = sent.value
            for batch in batches:
                moved, total = [], np.zeros((n_classes, n_classes))
                for b, succ, succ_n, pred, pred_n in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    wide = n_units // BLOCKS + 1
                    by = []
                    for cell, n in ((succ, succ_n), (pred, pred_n)):
                        cell, n = np.frombuffer(cell, np.int32), np.frombuffer(n, np.int64)
                        own, other = cell // n_units * BLOCKS + b, cell % n_units
                        by.append(np.bincount(cell // n_units * n_classes + cls[other], n, wide * n_classes).reshape(wide, n_classes))
                        if len(by) == 1:
                            itself = np.bincount(cell // n_units, np.where(own == other, n, 0), wide)
                            np.add.at(total, (cls[own], cls[other]), n)
                    for k in range(wide):
                        w = k * BLOCKS + b
                        if w < exchanged and turn is not None and w % 3 == turn % 3:
                            to, gain = best_class(by[0][k], by[1][k], itself[k], int(cls[w]), m, classes)
                            if gain > 1e-9 and to != cls[w]:
                                moved.append((w, to))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([total.tobytes()], pa.binary()), pa.array([[w for w, _ in moved]], pa.list_(pa.int32())), pa.array([[c for _, c in moved]], pa.list_(pa.int32()))],
                    ["total", "word", "to"],
                )

        total, new = np.zeros((n_classes, n_classes)), assigned.copy()
        for row in blocks.mapInArrow(run, "total binary, word array<int>, to array<int>").collect():
            total += np.frombuffer(row.total).reshape(n_classes, n_classes)
            new[row.word] = row.to
        sent.unpersist()
        return total, new

    assigned = np.concatenate([np.arange(exchanged) % classes, fixed])
    table, _ = job(assigned, np.zeros((n_classes, n_classes)), None)
    value = lambda m: _f(m).sum() - _f(m.sum(1)).sum() - _f(m.sum(0)).sum()
    best = (value(table), assigned, table)
    for turn in range(rounds if exchanged else 0):
        _, assigned = job(assigned, table, turn)
        table, _ = job(assigned, table, None)
        if value(table) > best[0]:
            best = (value(table), assigned, table)
    return best[1], best[2]


def fit(training: DataFrame, head: int, exchanged: int, classes: int, rounds: int) -> dict:
    """The model of ``training(text binary)``: vocabulary table, broadcast head, class of each unit, class bigram counts.

    room: per shape class, its tokens and word types and one unknown type, the denominator of its add-one emissions.
    """
    spark = training.sparkSession
    vocabulary = written(word_counts(training), "brown-words")
    vocabulary = vocabulary.withColumn("shape", F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(SHAPES)).cast("int"))
    n_end, total, types = vocabulary.agg(F.sum(F.when(F.length("word") == 0, F.col("n"))), F.sum("n"), F.count(F.lit(1))).first()
    cut, cut_exchanged = cut_for(vocabulary, head), cut_for(vocabulary, exchanged)
    in_head = (F.length("word") > 0) & (F.length("word") <= LONGEST) & (F.col("n") >= cut)
    rows = vocabulary.where(in_head).select("word", "n").toArrow()
    words, counts = rows.column(0).to_pylist(), rows.column(1).to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
    counts = counts[order]
    sent = spark.sparkContext.broadcast(Head([words[i] for i in order], counts, int((counts >= cut_exchanged).sum())))
    blocks = written(unit_blocks(training, sent), "brown-blocks")
    assigned, table = exchange(blocks, sent.value.exchanged, classes, rounds)
    open_words = vocabulary.where((F.length("word") > 0) & ((F.length("word") > LONGEST) | (F.col("n") < cut_exchanged)))
    room = np.ones(SHAPES)
    for row in open_words.groupBy("shape").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect():
        room[row["shape"]] += row.n + row.types
    return {"vocabulary": vocabulary, "in_head": in_head, "head": sent, "cut": cut, "total": total or 0, "types": types, "n_end": n_end or 0, "assigned": assigned, "table": table, "room": room}


def neighbour_cells(texts: DataFrame, head, assigned: np.ndarray) -> DataFrame:
    """``(word, cells)`` of words outside the exchange, several rows a word: for each occurrence, as packed int16, the class
    behind it and (plus the classes' number) the class before it. A row holds what one worker gathered at a time."""
    sent, n_classes = texts.sparkSession.sparkContext.broadcast(assigned), int(assigned.max()) + 1

    def run(batches):
        h, cls = head.value, sent.value
        own, ids, behind, before, held = {}, [], [], [], 0

        def out():
            known, every = list(own), np.concatenate(ids)
            order = np.argsort(every, kind="stable")
            every = every[order]
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            words = [h.words[i] if i < len(h.words) else known[i - len(h.words)] for i in every[first].tolist()]
            cells = np.column_stack([np.concatenate(behind)[order], n_classes + np.concatenate(before)[order]]).astype(np.int16)
            ends = pa.py_buffer(np.append(first, len(every)).astype(np.int32) * np.int32(4))
            lists = pa.Array.from_buffers(pa.binary(), len(first), [None, ends, pa.py_buffer(cells)])
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), lists], ["word", "cells"])

        for batch in batches:
            for place, rest, words, units in h.read(batch.column(0)):
                place[rest] = [len(h.words) + own.setdefault(w, len(own)) for w in words]
                at, c = np.flatnonzero(place >= h.exchanged), cls[units]
                ids.append(place[at].astype(np.int32))
                behind.append(c[at + 2])
                before.append(c[at])
                held += len(at)
                if held > HELD:
                    yield out()
                    own, ids, behind, before, held = {}, [], [], [], 0
        if held:
            yield out()

    return texts.mapInArrow(run, "word binary, cells binary")


class Fit:
    """Which class words fit best by the counts of their neighbours, against one table of class bigrams."""

    def __init__(self, table: np.ndarray, classes: int):
        self.table, self.classes = table, classes
        # a row per cell: the counts with each class of the class behind, then of that before
        self.was = np.concatenate([table[:classes].T, table[:, :classes]])
        self.f = _f(self.was)
        self.once_or_twice = np.concatenate([_f(self.was + k) - self.f for k in (1, 2)])

    def classes_of(self, own: np.ndarray, cell: np.ndarray, n: np.ndarray, now: np.ndarray) -> np.ndarray:
        """The class of each word, numbered in order by ``own``, that raises the likelihood of the class bigrams most by its counts;
        the one it has ``now`` where no other gains the cost of a name beyond what the word adds there."""
        table, classes = self.table, self.classes
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        behind, other = cell < len(table), cell % len(table)
        few, more = np.flatnonzero(n <= 2), np.flatnonzero(n > 2)
        asked = np.zeros((len(first), len(self.once_or_twice)))
        asked[own[few], cell[few] + (n[few] - 1) * len(self.was)] = 1
        gain = asked @ self.once_or_twice
        if len(more):
            begin = np.flatnonzero(np.concatenate([[True], own[more[1:]] != own[more[:-1]]]))
            gain[own[more[begin]]] += np.add.reduceat(_f(self.was[cell[more]] + n[more, None]) - self.f[cell[more]], begin)
        held = np.where(behind, table[now[own], other], table[other, now[own]])
        stays = np.add.reduceat(_f(held) - _f(held - n), first)
        for side, sums in ((behind, table.sum(1)), (~behind, table.sum(0))):
            count = np.add.reduceat(n * side, first)
            gain -= _f(sums[None, :classes] + count[:, None]) - _f(sums)[None, :classes]
            stays -= _f(sums[now]) - _f(sums[now] - count)
        return np.where(gain.max(axis=1) - stays > np.log(classes), gain.argmax(axis=1), now)


def placed_words(training: DataFrame, fitted: dict, classes: int) -> DataFrame:
    """``(word, n, class)`` of every training word outside the exchange: its count, and the class that it fits best, its shape class included.

    Words are held against the table that the exchange left, each by itself, so they are placed side by side. A word's rows
    come one after another, sorted; a task keeps the counts of the last word of a batch, never a word's rows.
    """
    sent = training.sparkSession.sparkContext.broadcast(fitted["table"])
    wide = 2 * len(fitted["table"])

    def run(batches):
        fit = Fit(sent.value, classes)

        def placed(words, own, cell, n):
            """own: the place in ``words`` of each count."""
            edges = np.searchsorted(own, np.arange(0, len(words) + 1000, 1000))
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                cut = words[1000 * k : 1000 * (k + 1)]
                now = np.array([classes + shape(w) for w in cut])
                to = fit.classes_of(own[a:b] - 1000 * k, cell[a:b], n[a:b], now)
                count = np.bincount(own[a:b] - 1000 * k, n[a:b] * (cell[a:b] < wide // 2), len(cut)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary()), pa.array(count), pa.array(to.astype(np.int32))], ["word", "n", "class"])

        last, kept = None, np.zeros(wide, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, lists = values(batch.column(0)), values(batch.column(1))
            place, words = [], [] if last is None else [last]
            for w in rows:
                if not words or w != words[-1]:
                    words.append(w)
                place.append(len(words) - 1)
            sizes = np.fromiter(map(len, lists), np.int64, len(lists)) // 2
            keys, n = np.unique(np.repeat(np.array(place), sizes) * wide + np.frombuffer(b"".join(lists), np.int16), return_counts=True)
            if last is not None:
                own = keys < wide
                kept[keys[own]] += n[own]
                cell = np.flatnonzero(kept)
                keys, n = np.concatenate([cell, keys[~own]]), np.concatenate([kept[cell], n[~own]])
            own, end = keys // wide, int(np.searchsorted(keys, (len(words) - 1) * wide))
            if end:
                yield from placed(words[:-1], own[:end], keys[:end] % wide, n[:end])
            last, kept = words[-1], np.zeros(wide, np.int64)
            kept[keys[end:] % wide] = n[end:]
        if last is not None:
            cell = np.flatnonzero(kept)
            yield from placed([last], np.zeros(len(cell), np.int64), cell, kept[cell])

    cells = neighbour_cells(training, fitted["head"], fitted["assigned"]).repartition("word").sortWithinPartitions("word")
    return cells.mapInArrow(run, "word binary, n long, class int")


def _sequence(classes: bytes, at, to) -> np.ndarray:
    """The classes of a text, the ends included, with those put in that a join found."""
    c = np.frombuffer(classes, np.int16).astype(np.int64)
    if at is not None and len(at):
        c[at] = to
    return c


def _placed_score(texts: DataFrame, fitted: dict, classes: int, prior: float) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, base_score, score)`` where every training word has one of ``classes`` classes."""
    spark = texts.sparkSession
    h, n_classes = fitted["head"], len(fitted["table"])
    placed = written(placed_words(texts.where(~F.col("held_out")).select("text"), fitted, classes), "brown-placed")
    in_head = (F.length("word") <= LONGEST) & (F.col("n") >= fitted["cut"])
    class_of = np.zeros(len(h.value.words), np.int64)
    class_of[: h.value.exchanged] = fitted["assigned"][: h.value.exchanged]
    rows = placed.where(in_head).toArrow()
    index = {w: i for i, w in enumerate(h.value.words)}
    class_of[[index[w] for w in rows.column(0).to_pylist()]] = rows.column(2).to_numpy()
    counts = h.value.counts
    model = spark.sparkContext.broadcast((class_of.astype(np.int16), np.log10(counts + 1), np.log10(counts + (class_of >= classes))))
    norm, end_known, end_log = float(np.log10(fitted["total"] + fitted["types"] + 1)), int(fitted["n_end"] > 0), float(np.log10(fitted["n_end"] + 1))

    def read(batches):
        of_head, more, plain = model.value
        for batch in batches:
            out = [[] for _ in range(7)]
            for place, rest, words, units in h.value.read(batch.column(2)):
                known, tokens = place[place >= 0], len(place) + 1
                c = np.full(tokens + 1, n_classes - 1, np.int16)
                if len(of_head):
                    c[1:-1] = of_head[place]
                c[1 + rest] = classes + units[1 + rest] - h.value.exchanged
                for x, value in zip(out, (tokens, len(known) + end_known, float(more[known].sum()) + end_log - tokens * norm, float(plain[known].sum()), c.tobytes(), words, (1 + rest).tolist())):
                    x.append(value)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, t) for x, t in zip(out, kinds)]], ["id", "held_out", "n_tokens", "n_known", "base", "plain", "classes", "rest", "at"])

    kind = texts.schema["id"].dataType.simpleString()
    partly = texts.mapInArrow(read, f"id {kind}, held_out boolean, n_tokens long, n_known long, base double, plain double, classes binary, rest array<binary>, at array<int>")
    partly = written(partly.withColumn("row", F.monotonically_increasing_id()), "brown-rows")
    rare = partly.select("row", F.explode(F.arrays_zip("at", "rest")).alias("x")).select("row", "x.at", F.col("x.rest").alias("word"))
    met = rare.join(placed.where(~in_head), "word").groupBy("row").agg(
        F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("logs"), F.sum(F.log10(F.col("n") + (F.col("class") >= classes).cast("long"))).alias("plain_logs"), F.collect_list(F.struct("at", "class")).alias("put")
    )  # of one text
    full = partly.drop("rest", "at").join(met, "row", "left")
    full = written(
        full.select("id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), (F.col("base") + F.coalesce("logs", F.lit(0.0))).alias("base_score"),
                    (F.col("plain") + F.coalesce("plain_logs", F.lit(0.0))).alias("plain"), "classes", F.col("put.at").alias("at"), F.col("put.class").alias("to")),
        "brown-classes",
    )

    def count(batches):
        for batch in batches:
            total = np.zeros(n_classes * n_classes, np.int64)
            for x in zip(*(values(batch.column(i)) for i in range(3))):
                c = _sequence(*x)
                total += np.bincount(c[:-1] * n_classes + c[1:], minlength=n_classes * n_classes)
            cell = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], ["cell", "n"])

    table = np.zeros(n_classes * n_classes)
    for row in full.where("not held_out").select("classes", "at", "to").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        table[row["cell"]] = row["n"]
    table = table.reshape(n_classes, n_classes)
    reached = (table.sum(0) + 1) / (table.sum() + n_classes)
    size = np.bincount(fitted["assigned"][: h.value.exchanged], counts[: h.value.exchanged], n_classes).astype(float)
    for row in placed.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect():
        size[row["class"]] += row["n"] + (row["types"] if row["class"] >= classes else 0)
    size[classes : classes + SHAPES] += 1  # one unknown word
    size = np.log10(np.maximum(size, 1))
    last = spark.sparkContext.broadcast((np.log10((table + prior * reached[None, :]) / (table.sum(1)[:, None] + prior)), size))

    def run(batches):
        move, size = last.value
        for batch in batches:
            out = []
            for plain, *x in zip(batch.column(5).to_pylist(), *(values(batch.column(i)) for i in range(6, 9))):
                c = _sequence(*x)
                out.append(float(move[c[:-1], c[1:]].sum() + plain - size[c].sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(out, pa.float64())], ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return full.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 7,
    held_out_fold: int = 2,
    head: int = 1 << 18,
    exchanged: int | None = None,
    classes: int = 64,
    rounds: int = 12,
    prior: float = 4.0,
    in_rounds: int = 4096,
) -> DataFrame:
    """Scores every row of ``docs`` with a model of the rows outside the held-out fold of crc32(id).

    Columns: the id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score (class bigrams), both
    log10. A null text is empty and scores as its end alone; a null id counts as the empty text in the fold; repeated rows
    are scored, and counted, once each. Without training rows every probability is that of one unknown token.

    Every training word has its own class: the ``in_rounds`` most frequent by rounds of exchange, all others by their
    neighbours. exchanged: a bound instead, beyond which words keep their shape classes.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), held_out_column(id_col, folds, held_out_fold).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    fitted = fit(texts.where(~F.col("held_out")).select("text"), head, in_rounds if exchanged is None else exchanged, classes, rounds)
    if exchanged is None:
        named = F.lit(fitted["total"]).cast("long").alias("train_tokens")
        return _placed_score(texts, fitted, classes, prior).select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", named, "base_score", "score")
    vocabulary, sent, in_head, total, types, n_end = (fitted[k] for k in ("vocabulary", "head", "in_head", "total", "types", "n_end"))
    assigned, table, room, counts = fitted["assigned"], fitted["table"], fitted["room"], sent.value.counts
    own = sent.value.exchanged
    emit = np.log10(counts + 1)
    emit[:own] = np.log10(counts[:own]) - np.log10(np.bincount(assigned[:own], counts[:own], len(table))[assigned[:own]])
    spare = np.zeros(len(table))
    spare[classes : classes + SHAPES] = -np.log10(room)
    reached = (table.sum(0) + 1) / (table.sum() + len(table))
    move = np.log10((table + prior * reached[None, :]) / (table.sum(1)[:, None] + prior))
    model = spark.sparkContext.broadcast((assigned, np.log10(counts + 1), emit, spare, move))
    norm, end_known, end_log = float(np.log10(total + types + 1)), int(n_end > 0), float(np.log10(n_end + 1))

    def run(batches):
        cls, log_count, emit, spare, move = model.value
        for batch in batches:
            out = [[], [], [], [], []]
            for place, _, words, units in sent.value.read(batch.column(2)):
                known = place[place >= 0]
                c = cls[units]
                out[0].append(len(place) + 1)
                out[1].append(len(known) + end_known)
                out[2].append(float(log_count[known].sum()) + end_log - (len(place) + 1) * norm)
                out[3].append(float(move[c[:-1], c[1:]].sum() + emit[known].sum() + spare[c[1:]].sum()))
                out[4].append(words)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(x, t) for x, t in zip(out, kinds)]], ["id", "held_out", "n_tokens", "n_known", "base", "model", "rest"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    partly = texts.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, base double, model double, rest array<binary>")
    partly = written(partly.withColumn("row", F.monotonically_increasing_id()), "brown-rows")
    rare = vocabulary.where((F.length("word") > 0) & ~in_head).select("word", "n")
    rare_words = partly.select("row", F.explode("rest").alias("word"))
    met = rare_words.join(rare, "word").groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("logs"))
    return partly.join(met, "row", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0))).alias("base_score"),
        (F.col("model") + F.coalesce("logs", F.lit(0.0))).alias("score"),
    )
