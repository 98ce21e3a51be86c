"""Alignment of two tokenizers' tokens over the bytes of the same texts, and how often their ids meet in a corpus.

Both tokenizers' tokens cut a text, with the space that one of them puts before it, into bytes; where tokens of both end,
the text falls into groups. The ends are met by galloping: of each pair of end lists the shorter drives, and every one of its
ends is searched in the longer one with doubling steps from where the list begins, then by halving inside the last step; all
ends of a slice of texts take their steps side by side. An end that is found is a common one and closes a group; the places
found are ranks, and their differences say which tokens of the other list a token overlaps: these are its links.

Neither tokenizer joins what stands before a single space to what follows it, so a text's alignment is that of its stretches
one after the other, and each distinct stretch is encoded and aligned once in a worker. A text in which a space touches other
white space is one stretch.

What ids meet is counted over the corpus in joins. A batch (the texts of about 4 MB) keeps the number of each pair of ids it
holds, these are summed over all batches, and each batch gets back the counts of its own pairs; so what is shuffled follows
the distinct pairs of batches, not the tokens, and no task needs the whole table of counts. Nor does a task's memory grow with
the table: a worker gets a few MB of texts or one batch at a time, and batches, of some 6 MB each, are written in row groups of a few.

Rows: texts that are null, empty, or that one of the tokenizers does not keep byte by byte (such as those with a literal
U+2581) have no tokens and no links. Special tokens' strings are text like any other. Texts of any length are taken whole;
repeated rows and ids are rows of their own, and null ids stay null. Ties for the best partner all count. An empty table
gives no rows. Only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import ctypes
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quellspan.llm.tokens import slices
from quellspan.session import LARGE_ROWS, arrow_batches, scratch, written

#: Stretches that a worker takes over from one batch to the next; a batch of 4 MB has some 150,000 of its own.
MOST_CACHED = 100_000
#: Text of a batch, of the slices in which it is read, and bytes of what Spark hands to a worker at once.
BATCH_BYTES, CUT_BYTES, ARROW_CUT = 4 << 20, 1 << 18, 2 << 20


def byte_of() -> dict[str, int]:
    """The bytes that the characters of byte-level entries stand for: printable ones for themselves, the rest in order from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


def galloped(keys: np.ndarray, table: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each key the first place of ``table[low:high]`` that holds no less; ``table`` ascends there, and its last holds no less.

    Steps of 1, 2, 4 and so on from ``low`` bracket the place, halving finds it.
    """
    low, high = low.copy(), high - 1
    begin, open_, reach = low.copy(), np.arange(len(keys)), 1
    while len(open_):
        probe = np.minimum(begin[open_] + reach - 1, high[open_])
        less = table[probe] < keys[open_]
        high[open_[~less]] = probe[~less]
        open_, probe = open_[less], probe[less]
        low[open_] = probe + 1
        reach *= 2
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        less = table[middle] < keys[open_]
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]
        open_ = open_[low[open_] < high[open_]]
    return low


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each first on, so many of them."""
    return np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def released() -> None:
    """Freed memory goes back to the system. By itself the C library keeps what lies between live blocks, as much again as is used."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def joined_bytes(values: pa.Array) -> bytes:
    """The bytes of all values one after the other."""
    return values.buffers()[2].to_pybytes() if len(values) and values.buffers()[2] else b""


class Store:
    """Alignments one after the other: tokens of either tokenizer, groups, the tokens in the order of the groups' text, and
    the linked pairs. ``at``: where those of each alignment begin."""

    def __init__(self, counts, said, pairs):
        self.counts, self.said, self.pairs = counts, said, pairs
        self.sizes = [counts[0] + counts[1], counts[0] + counts[1] - counts[2]]
        self.at = [np.cumsum(x) - x for x in self.sizes]

    @classmethod
    def empty(cls) -> Store:
        return cls(np.zeros((3, 0), np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))

    def joined(self, other: Store) -> Store:
        return Store(np.concatenate([self.counts, other.counts], axis=1), np.concatenate([self.said, other.said]), np.concatenate([self.pairs, other.pairs]))

    def said_by(self, places: np.ndarray) -> np.ndarray:
        return self.said[spread(self.at[0][places], self.sizes[0][places])]

    def linked_by(self, places: np.ndarray) -> np.ndarray:
        return self.pairs[spread(self.at[1][places], self.sizes[1][places])]


class Aligner:
    """Two vocabularies, and the alignments of the stretches seen so far; number 0 is of those whose bytes are lost."""

    _kept: dict = {}

    @classmethod
    def of(cls, *paths: str) -> Aligner:
        if paths not in cls._kept:
            cls._kept[paths] = cls(*paths)
        return cls._kept[paths]

    def __init__(self, byte_path: str, piece_path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.byte, self.piece = Tokenizer.from_file(byte_path), SentencePieceProcessor(model_file=piece_path)
        self.byte.encode_special_tokens = True
        of, size = byte_of(), self.byte.get_vocab_size()
        entries = [self.byte.id_to_token(i) or "" for i in range(size)]
        raw = [bytes(of[c] for c in e) if all(c in of for c in e) else e.encode() for e in entries]
        pieces = [self.piece.id_to_piece(i) for i in range(self.piece.vocab_size())]
        own = [bytes([int(p[3:5], 16)]) if self.piece.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece spans a space; texts can't be cut before spaces")
        self.opens = np.array([e.startswith("Ġ") for e in entries])
        self.raw = [pa.array(x, pa.large_binary()) for x in (raw, own)]
        self.length = [np.array([len(b) for b in x], np.int64) for x in (raw, own)]
        self.sizes = len(entries), len(pieces)
        # how tokens read in the groups' text: in turn with what follows inside a group, and what follows the group's last
        self.shown = pa.array([f"{i}{end}" for ends, n in ((",|", size), (",;", len(pieces))) for i in range(n) for end in ends], pa.large_string()).cast(pa.large_binary())
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.store = Store.empty().joined(Store(np.zeros((3, 1), np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)))

    # ---- encoding ---------------------------------------------------------------------------------------------------------

    def _byte_ids(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches, each with the space before it, and how many each has. Those without white space are encoded together."""
        whole = np.fromiter((" " in s or s[0].isspace() or s[-1].isspace() for s in stretches), bool, len(stretches))
        joined = "".join([f" {s}" for s, w in zip(stretches, whole.tolist()) if not w])
        ids = np.array(self.byte.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int64) if joined else np.zeros(0, np.int64)
        at = np.flatnonzero(self.opens[ids])
        if len(at) != len(stretches) - whole.sum():  # a token that opens with a space in another place
            whole[:], ids, at = True, ids[:0], at[:0]
        alone = [np.array(e.ids, np.int64) for e in self.byte.encode_batch_fast([f" {s}" for s, w in zip(stretches, whole.tolist()) if w], add_special_tokens=False)]
        count, begin = np.zeros(len(stretches), np.int64), np.zeros(len(stretches), np.int64)
        count[~whole], begin[~whole] = np.diff(np.append(at, len(ids))), at
        count[whole] = [len(x) for x in alone]
        begin[whole] = len(ids) + np.cumsum(count[whole]) - count[whole]
        return np.concatenate([ids, *alone])[spread(begin, count)], count

    def _piece_ids(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.piece.encode(stretches, num_threads=1) if stretches else []
        return np.array(list(chain.from_iterable(found)), np.int64), np.fromiter(map(len, found), np.int64, len(found))

    def _kept_bytes(self, side: int, ids: np.ndarray, count: np.ndarray, want: list[bytes]) -> np.ndarray:
        """Whether the tokens' bytes are each stretch's."""
        ends = np.append(0, np.cumsum(self.length[side][ids]))[np.append(0, np.cumsum(count))]
        raw = joined_bytes(self.raw[side].take(pa.array(ids)))
        if raw == b"".join(want) and np.array_equal(np.diff(ends), [len(w) for w in want]):
            return np.ones(len(want), bool)
        edges = ends.tolist()
        return np.fromiter((raw[a:b] == w for a, b, w in zip(edges, edges[1:], want)), bool, len(want))

    # ---- alignment --------------------------------------------------------------------------------------------------------

    def align(self, stretches: list[str]) -> tuple[np.ndarray, Store]:
        """Whether no bytes of a stretch are lost, and the alignments of those."""
        both = [self._byte_ids(stretches), self._piece_ids(stretches)]
        want = [f" {s}".encode() for s in stretches]
        right = self._kept_bytes(0, *both[0], want) & self._kept_bytes(1, *both[1], want)
        (a, na), (b, nb) = [(ids[np.repeat(right, n)], n[right]) for ids, n in both]
        ids = np.concatenate([a, b])
        ends = np.concatenate([np.cumsum(self.length[0][a]), np.cumsum(self.length[1][b])])
        begins = [np.cumsum(na) - na, len(a) + np.cumsum(nb) - nb]

        # the shorter list of each stretch drives
        turned = na > nb
        pick = lambda x, y: np.where(turned, y, x)
        n, m, begin, other = pick(na, nb), pick(nb, na), pick(*begins), pick(*begins[::-1])
        driver, of = spread(begin, n), np.repeat(np.arange(len(n)), n)
        rank = galloped(ends[driver], ends, other[of], (other + m)[of])
        common = ends[rank] == ends[driver]

        # a token's links reach from behind what ended with or before the token before it up to what holds its end
        first = np.append(0, (rank + common)[:-1])[: len(rank)]
        first[np.cumsum(n) - n] = other
        reach = rank - first + 1
        left, right_ = np.repeat(ids[driver], reach), ids[spread(first, reach)]
        swap = np.repeat(turned[of], reach)
        pairs = np.where(swap, right_, left) * self.sizes[1] + np.where(swap, left, right_)

        # the order of the groups' text: of each group the first tokenizer's tokens, then the other's
        last = np.zeros(len(ids), bool)
        last[driver[common]] = last[rank[common]] = True
        one, two = last[: len(a)], last[len(a) :]
        at = [np.append(0, np.flatnonzero(x) + 1) for x in (one, two)]
        said = np.empty(len(ids), np.int32)
        said[np.arange(len(a)) + at[1][np.cumsum(one) - one]] = 2 * a + one
        said[np.arange(len(b)) + at[0][np.cumsum(two) - two + 1]] = 2 * (self.sizes[0] + b) + two
        groups = np.bincount(np.repeat(np.arange(len(na)), na), one, len(na)).astype(np.int64)
        return right, Store(np.stack([na, nb, groups]), said, pairs)

    def stretches(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The row and the stretch of each occurrence, in order, and the distinct stretches; null and empty texts have none."""
        lists, n = pc.split_pattern(texts.fill_null(""), " "), len(texts)
        own = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        table = lists.flatten().dictionary_encode()
        place, distinct = table.indices.to_numpy(zero_copy_only=False).astype(np.int64), table.dictionary.to_pylist()
        odd = pc.not_equal(pc.utf8_trim_whitespace(table.dictionary), table.dictionary)
        odd = pc.or_(odd, pc.equal(table.dictionary, "")).to_numpy(zero_copy_only=False).astype(bool)
        whole = np.zeros(n, bool)
        whole[own[odd[place]]] = True
        keep, alone = ~whole[own], np.flatnonzero(whole)
        said = [texts[i].as_py() or "" for i in alone.tolist()]
        full = np.fromiter((s != "" for s in said), bool, len(said))
        used, place = np.unique(place[keep], return_inverse=True)
        own = np.concatenate([own[keep], alone[full]])
        place = np.concatenate([place, len(used) + np.arange(full.sum())])
        order = np.argsort(own, kind="stable")
        return own[order], place[order], [distinct[i] for i in used.tolist()] + [s for s in said if s]

    def found(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The row and the alignment's number in the store of each stretch, and which rows have lost bytes."""
        own, place, distinct = self.stretches(texts)
        new = [s for s in distinct if s not in self.number]
        right, store = self.align(new)
        numbers = np.where(right, len(self.store.counts[0]) + np.cumsum(right) - 1, 0)
        self.number.update(zip(new, numbers.tolist()))
        self.store = self.store.joined(store)
        at = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))[place]
        lost = np.zeros(len(texts), bool)
        lost[own[at == 0]] = True
        keep = ~lost[own]
        return own[keep], at[keep], lost

    def summed(self, texts: pa.Array) -> dict:
        """What a batch of texts keeps: counts and the groups' digest by row, and the links by row, stretch and pair."""
        if len(self.number) > MOST_CACHED:
            self.clear()
        counts, digests, sizes, places = [], [], [], []
        for cut in slices(texts, CUT_BYTES):
            own, at, _ = self.found(cut)
            n, said = len(cut), self.store.said_by(at)
            shown = self.shown.take(pa.array(said))
            tokens = np.bincount(own, self.store.sizes[0][at], n).astype(np.int64)
            edges = np.frombuffer(shown.buffers()[1], np.int64, len(shown) + 1)[np.append(0, np.cumsum(tokens))].tolist() if len(said) else [0] * (n + 1)
            raw = memoryview(shown.buffers()[2]) if len(said) else b""
            digests += [sha256(raw[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(edges, edges[1:])]
            counts.append(np.stack([np.bincount(own, x[at], n) for x in self.store.counts]).astype(np.int64))
            sizes.append(np.bincount(own, minlength=n))
            places.append(at)
        numbers, place = np.unique(np.concatenate([*places, np.zeros(0, np.int64)]), return_inverse=True)
        pairs, links = np.unique(self.store.linked_by(numbers), return_inverse=True)
        reach = self.store.sizes[1][numbers]
        uses = np.bincount(links, np.repeat(np.bincount(place, minlength=len(numbers)), reach), len(pairs)).astype(np.int64)
        by_row = np.concatenate([*counts, np.zeros((3, 0), np.int64)], axis=1)
        return {"counts": by_row, "digests": digests, "sizes": np.concatenate([*sizes, np.zeros(0, np.int64)]), "places": place, "reach": reach, "links": links, "pairs": pairs, "uses": uses}


# ---- over tables ----------------------------------------------------------------------------------------------------------

_PACKED = ("sizes", "places", "reach", "links")


def gathered(parts):
    """Arrow batches of any size as batches of about BATCH_BYTES of text; rows stay whole."""
    held, size = [], 0
    for part in parts:
        at = 0
        for texts in slices(part.column("text"), CUT_BYTES):
            held.append(part.slice(at, len(texts)))
            at, size = at + len(texts), size + (pc.sum(pc.binary_length(texts)).as_py() or 0)
            if size >= BATCH_BYTES:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def batches(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The batches of a table: their rows with counts and digests (as one Arrow batch), their links, and the pairs' numbers."""

    def run(parts):
        from pyspark import TaskContext

        own, number = Aligner.of(byte_path, piece_path), TaskContext.get().partitionId() << 32
        for part in gathered(parts):
            x = own.summed(part.column("text"))
            rows = pa.RecordBatch.from_arrays([part.column("id"), *map(pa.array, x["counts"]), pa.array(x["digests"], pa.string())], ["id", "n_a", "n_b", "n_groups", "groups_sha256"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as stream:
                stream.write_batch(rows)
            packed = [pa.array([x[c].astype("<u4").tobytes()], pa.binary()) for c in _PACKED]
            lists = [pa.array([x[c]], pa.list_(pa.int64())) for c in ("pairs", "uses")]
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), *packed, *lists], ["batch", "rows", *_PACKED, "pairs", "uses"])
            number += 1
            del part, x, rows, sink, packed, lists
            released()
        own.clear()  # the worker lives on beside the joins that follow
        released()

    schema = "batch long, rows binary, sizes binary, places binary, reach binary, links binary, pairs array<long>, uses array<long>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pair_counts(parts: DataFrame, size: int) -> DataFrame:
    """``(pair, n, best)`` over the corpus: how many links hold a pair, and whether no other of its second id has more."""
    counted = parts.select(F.explode(F.arrays_zip("pairs", "uses")).alias("x")).where("x.uses > 0").groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.uses").alias("n"))
    counted = written(counted.withColumn("b", F.col("pair") % size), "alignment-pairs")
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    return counted.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _scored(parts):
    for part in parts:
        for i in range(part.num_rows):
            (row,) = part.slice(i, 1).to_pylist()
            sizes, places, reach, links = (np.frombuffer(row[c], "<u4").astype(np.int64) for c in _PACKED)
            told = row["told"] or {"pos": [], "n": [], "best": []}
            n, best = np.zeros(len(row["pairs"]), np.int64), np.zeros(len(row["pairs"]), np.int64)
            n[told["pos"]], best[told["pos"]] = told["n"], told["best"]
            found = []
            for value in (np.ones(len(links), np.int64), best[links], n[links]):  # sums of stretches, then of rows
                for count, at in ((reach, None), (sizes, places)):
                    value = value if at is None else value[at]
                    sums, ends = np.append(0, np.cumsum(value)), np.cumsum(count)
                    value = sums[ends] - sums[ends - count]
                found.append(pa.array(value))
            rows = pa.ipc.open_stream(row["rows"]).read_next_batch()
            names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
            yield pa.RecordBatch.from_arrays([*rows.columns[:4], *found, rows.column("groups_sha256")], names)
        released()


def aligned(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, tokens of either tokenizer, groups, links, links that are a second id's most frequent, the sum of the
    links' counts, and the digest of the groups."""
    spark = docs.sparkSession
    with scratch(spark), arrow_batches(spark, ARROW_CUT):
        parts = written(batches(docs, byte_path, piece_path, id_col, text_col), "alignment-batches", options=LARGE_ROWS)
        return written(_told(parts, docs.schema[id_col].dataType.simpleString(), Aligner.of(byte_path, piece_path).sizes[1]), "alignment", keep=True).withColumnRenamed("id", id_col)


def _told(parts: DataFrame, kind: str, size: int) -> DataFrame:
    """The rows of all batches with their links judged."""
    judged = pair_counts(parts, size)
    told = parts.select("batch", F.posexplode("pairs").alias("pos", "pair")).join(judged, "pair")
    told = told.groupBy("batch").agg(F.collect_list(F.struct("pos", "n", "best")).alias("t"))
    told = told.select("batch", F.struct(*[F.col("t")[c].alias(c) for c in ("pos", "n", "best")]).alias("told"))
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return parts.drop("uses").join(told, "batch", "left").mapInArrow(_scored, schema)


def groups(text: Column, byte_path: str, piece_path: str) -> Column:
    """The groups of each text in order: where they begin and end, in bytes of the text with a space before it, and the ids of either."""

    @F.arrow_udf("array<struct<start:int,end:int,a:array<int>,b:array<int>>>")
    def run(texts: pa.Array) -> pa.Array:
        own, out = Aligner.of(byte_path, piece_path), []
        for cut in slices(texts):
            rows, at, _ = own.found(cut)
            edges = np.searchsorted(rows, np.arange(len(cut) + 1)).tolist()
            for a, b in zip(edges, edges[1:]):
                one, group, begin = [], ([], []), 0
                for code in own.store.said_by(at[a:b]).tolist():
                    token, last = divmod(code, 2)
                    side = int(token >= own.sizes[0])
                    group[side].append(token - side * own.sizes[0])
                    if side and last:
                        end = begin + int(own.length[0][group[0]].sum())
                        one.append({"start": begin, "end": end, "a": group[0], "b": group[1]})
                        group, begin = ([], []), end
                out.append(one)
        return pa.array(out, pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32(), "a": pa.list_(pa.int32()), "b": pa.list_(pa.int32())})))

    return run(text)
