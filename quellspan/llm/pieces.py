"""Merge-type subword pieces with seeded merge-dropout, and their lossless decoding.

A text is cut before its spaces; no piece of a merge-type vocabulary spans such a cut. Inside a stretch, neighbours that
form a piece wait in an agenda, best score first and leftmost first on ties. A candidate that comes up is skipped when the
keyed hash of (occurrence, place, piece), 64 bits mixed in full, falls below ``dropout``; an occurrence is named by the seed,
the row's key and the stretch's place in the text. So every occurrence is segmented by draws of its own, the same way on
every run.

Only candidates that come up decide. The run that skips nothing is the library's, and a piece of it was merged in the same
way wherever it stands, so what came up in that run is known without repeating it. Whether an occurrence skips any of that is
computed for all occurrences at once; most don't and take the library's pieces. The agendas of the others are run side by
side: in each step the first candidate of every agenda comes up. Long stretches have a heap of their own as the agenda.

What is in no piece becomes byte pieces. A literal U+2581 becomes bytes too, so that it isn't read back as a space. Texts
of any length are encoded whole; null and empty texts have no pieces; equal texts under equal keys have equal pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quellspan.llm.tokens import mixed, slices

SPACE = "▁"
LITERAL = "\0" + SPACE
#: Occurrences of stretches with more merges are run without a look at the library's.
MASKED = 64
#: Symbols of the longest stretch that is run side by side with others, cells of such a run, and the rank of no candidate.
SHORT, CELLS, NEVER = 64, 1 << 19, float("inf")
LAST = np.int32((1 << 31) - 1)
MASK = (1 << 64) - 1
#: Odd factors that tell places and pieces apart, and those of the mix.
PLACE, PIECE, MIX = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)

Skip = Callable[[int, int], bool]


def salt(place: int, piece: int) -> int:
    return (place * PLACE + piece * PIECE) & MASK


def skipping(key: int, limit: int) -> Skip:
    """Whether the occurrence ``key`` skips a candidate: its hash lies below the limit."""

    def skip(place: int, piece: int) -> bool:
        x = (key + place * PLACE + piece * PIECE) & MASK
        x = ((x ^ (x >> 33)) * MIX[0]) & MASK
        x = ((x ^ (x >> 29)) * MIX[1]) & MASK
        return x ^ (x >> 32) < limit

    return skip


def skipped(keys: np.ndarray, salts: np.ndarray, limit: int) -> np.ndarray:
    """:func:`skipping` of arrays; ``limit`` below 2 ** 64."""
    x = keys + salts
    x ^= x >> np.uint64(33)
    x *= np.uint64(MIX[0])
    x ^= x >> np.uint64(29)
    x *= np.uint64(MIX[1])
    x ^= x >> np.uint64(32)
    return x < np.uint64(limit)


class Model:
    """The vocabulary of a merge-type model file with byte pieces."""

    _kept: dict = {}

    @classmethod
    def of(cls, path: str) -> Model:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        own = self.library = SentencePieceProcessor(model_file=path)
        self.dtype = np.dtype("<u2" if own.vocab_size() <= 1 << 16 else "<u4")
        self.ids, self.known, self.byte = {}, {}, [b""] * 256
        self.raw: list[bytes] = []
        for i in range(own.vocab_size()):
            piece = own.id_to_piece(i)
            if own.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte[value] = i.to_bytes(self.dtype.itemsize, "little")
                self.raw.append(bytes([value]))
            elif own.is_control(i) or own.is_unknown(i) or own.is_unused(i):
                self.raw.append(b"")
            else:
                self.ids[piece] = i
                self.known[piece] = -own.get_score(i)
                self.raw.append(piece.replace(SPACE, " ").encode())
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece spans a space; texts can't be cut before spaces")
        self.table = pa.array(self.raw, pa.large_binary())
        self.longest = max(map(len, self.ids))
        self.packed = {p: i.to_bytes(self.dtype.itemsize, "little") for p, i in self.ids.items()}
        # how many places a piece takes; of a character's byte pieces the first stands for all
        self.places = np.ones(own.vocab_size(), np.int64)
        for piece, i in self.ids.items():
            self.places[i] = len(piece)
        for value in range(0x80, 0xC0):
            self.places[int.from_bytes(self.byte[value], "little")] = 0
        never = lambda place, piece: False
        made = {i: self.merged(list(piece), never)[1] for piece, i in self.ids.items() if len(piece) > 1}
        self.merges = np.array([len(made.get(i, ())) for i in range(own.vocab_size())])
        self.merge_at = np.cumsum(self.merges) - self.merges
        self.merge_salts = np.array([salt(*c) for i in range(own.vocab_size()) for c in made.get(i, ())], np.uint64)

        # ranks in order, ties kept; the piece of each single character; and every pair of pieces that is a piece
        self.ranks = np.full(own.vocab_size() + 1, LAST, np.int32)
        order = {r: n for n, r in enumerate(sorted(set(self.known.values())))}
        for piece, i in self.ids.items():
            self.ranks[i] = order[self.known[piece]]
        self.single = np.full(0x110000, -1, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.single[ord(piece)] = i
        pairs = {self.ids[p[:k]] << 32 | self.ids[p[k:]]: i for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
        self._file(np.fromiter(pairs, np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))

    def _file(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open hash table of pairs."""
        self.bits = max(4, int(len(keys) * 6).bit_length())
        self.slots, self.values = np.full((1 << self.bits) + len(keys), MASK, np.uint64), np.full((1 << self.bits) + len(keys), -1, np.int32)
        at, left, self.tries = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.tries += 1
            free = self.slots[at[left]] == np.uint64(MASK)
            slot, first = np.unique(at[left[free]], return_index=True)
            own = left[free][first]
            self.slots[slot], self.values[slot] = keys[own], values[own]
            left = np.setdiff1d(left, own, assume_unique=True)
            at[left] += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(PLACE)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of two pieces next to each other; -1 where there is none."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = self._slot(key)
        out = np.where(self.slots[at] == key, self.values[at], np.int32(-1))
        for k in range(1, self.tries):
            open_ = np.flatnonzero((out < 0) & (self.slots[at + k - 1] != np.uint64(MASK)))
            if not len(open_):
                break
            hit = open_[self.slots[at[open_] + k] == key[open_]]
            out[hit] = self.values[at[hit] + k]
        return out

    def side_by_side(self, symbols: np.ndarray, length: np.ndarray, keys: np.ndarray, limit: int) -> np.ndarray:
        """The pieces of many stretches, each by the draws of its key; ``symbols``: a row of single pieces for each, and behind
        its length and where a piece was merged into the one before it -1."""
        n, width = symbols.shape
        sym, rows = symbols.ravel().copy(), np.arange(n) * width
        place = np.tile(np.arange(width), n)
        after = np.where(place + 1 < np.repeat(length, width), np.arange(n * width) + 1, -1)
        before = np.where((place > 0) & (sym >= 0), np.arange(n * width) - 1, -1)
        agenda = np.full(n * width, LAST, np.int32)
        piece = np.full(n * width, -1, np.int32)

        def wait(at):
            """What each symbol and the one after it form."""
            piece[at] = found = self.pair(sym[at], sym[after[at]])
            agenda[at] = self.ranks[found]

        wait(np.flatnonzero(after >= 0))
        ranks, running = agenda.reshape(n, width), np.arange(n)
        while len(running):
            own = ranks if len(running) == n else ranks[running]
            column = own.argmin(axis=1)
            up = own[np.arange(len(running)), column] < LAST
            running, column = running[up], column[up]
            at = rows[running] + column
            with np.errstate(over="ignore"):
                salts = column.astype(np.uint64) * np.uint64(PLACE) + piece[at].astype(np.uint64) * np.uint64(PIECE)
                gone = skipped(keys[running], salts, limit)
            agenda[at[gone]] = LAST
            at = at[~gone]
            gap = after[at]
            sym[at], sym[gap], agenda[gap], agenda[at] = piece[at], -1, LAST, LAST
            after[at] = after[gap]
            more = at[after[at] >= 0]
            before[after[more]] = more
            wait(more)
            wait(before[at[before[at] >= 0]])
        return sym.reshape(n, width)

    def whole(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of stretches without dropout, how many each has, the salts of all merges made, and how many each has of those."""
        ids = self.library.encode(stretches, num_threads=1)
        for n, stretch in enumerate(stretches):
            if SPACE in stretch or not stretch.strip(" "):
                ids[n] = np.frombuffer(self.segment(stretch, lambda place, piece: False), self.dtype).tolist()
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(count.sum()))
        taken = self.places[flat]
        before = np.cumsum(taken) - taken
        first = np.cumsum(count) - count
        own = np.repeat(np.arange(len(ids)), count)
        place = before - np.append(before, 0)[first][own]
        merges = self.merges[flat]
        within = np.arange(merges.sum()) - np.repeat(np.cumsum(merges) - merges, merges)
        with np.errstate(over="ignore"):
            salts = self.merge_salts[np.repeat(self.merge_at[flat], merges) + within] + np.repeat(place, merges).astype(np.uint64) * np.uint64(PLACE)
        return flat, count, salts, np.bincount(own, merges, len(ids)).astype(np.int64)

    def segment(self, stretch: str, skip: Skip) -> bytes:
        """Raw ids of one stretch: leading spaces (one more than it shows, for the cut) and what follows them."""
        symbols = self.symbols(stretch)
        return self._packed(self.merged(symbols, skip)[0] if len(symbols) <= SHORT else self.merged_long(symbols, skip))

    def _packed(self, symbols: list[str]) -> bytes:
        try:
            return b"".join([self.packed[s] for s in symbols])
        except KeyError:
            return b"".join([self.packed[s] if s in self.packed else self._bytes(s) for s in symbols])

    def symbols(self, stretch: str) -> list[str]:
        body = stretch.lstrip(" ")
        symbols = [SPACE] * (len(stretch) - len(body) + 1)
        symbols += [c if c != SPACE else LITERAL for c in body] if SPACE in body else body
        return symbols

    def _bytes(self, symbol: str) -> bytes:
        return b"".join([self.byte[x] for x in (SPACE if symbol == LITERAL else symbol).encode()])

    def merged(self, symbols: list[str], skip: Skip) -> tuple[list[str], list[tuple[int, int]]]:
        """The symbols after all merges, and place and piece of those that were made, in order. The agenda is a list of the
        neighbours' ranks: the least and leftmost comes up. For the pieces of the model, once."""
        rank, at, made = self.known.get, list(range(len(symbols))), []
        agenda = [rank(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            least = min(agenda)
            if least == NEVER:
                break
            i = agenda.index(least)
            pair = symbols[i] + symbols[i + 1]
            candidate = (at[i], self.ids[pair])
            if skip(*candidate):
                agenda[i] = NEVER
                continue
            made.append(candidate)
            symbols[i] = pair
            del symbols[i + 1], at[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = rank(pair + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + pair, NEVER)
        return symbols, made

    def merged_long(self, symbols: list[str], skip: Skip) -> list[str]:
        """The same with a heap as the agenda, for long stretches."""
        n, rank = len(symbols), self.known.get
        before, after, agenda = list(range(-1, n - 1)), [*range(1, n), -1], []

        def wait(left, right):
            pair = symbols[left] + symbols[right]
            if (r := rank(pair)) is not None:
                heapq.heappush(agenda, (r, left, right, len(pair)))

        for i in range(n - 1):
            wait(i, i + 1)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size:
                continue
            if skip(left, self.ids[symbols[left] + symbols[right]]):
                continue
            symbols[left], symbols[right] = symbols[left] + symbols[right], ""
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
                wait(left, after[left])
            if before[left] >= 0:
                wait(before[left], left)
        return [s for s in symbols if s]

    def decoded(self, flat: np.ndarray, edges: list[int]) -> list[bytes]:
        """The UTF-8 texts of runs of ids."""
        out = self.table.take(pa.array(flat))
        at, raw = np.frombuffer(out.buffers()[1], np.int64, len(out) + 1)[edges].tolist(), out.buffers()[2].to_pybytes() if len(out) else b""
        return [raw[a + 1 : b] for a, b in zip(at, at[1:])]

    def decode(self, ids) -> str:
        """The text of its pieces; the space before the first stretch isn't the text's."""
        return b"".join(map(self.raw.__getitem__, ids))[1:].decode()


class Encoder:
    _kept: dict = {}

    @classmethod
    def of(cls, path: str, dropout: float, seed: int) -> Encoder:
        given = (path, dropout, seed)
        if given not in cls._kept:
            cls._kept[given] = cls(*given)
        return cls._kept[given]

    def __init__(self, path: str, dropout: float, seed: int):
        self.model, self.seed, self.limit = Model.of(path), seed, min(int(dropout * (1 << 64)), MASK)

    def draw(self, count: np.ndarray, keys: list[bytes]) -> np.ndarray:
        """The key of each stretch of texts of ``count`` stretches; ``keys`` name the texts."""
        from xxhash import xxh64_intdigest

        base = np.repeat(np.fromiter((xxh64_intdigest(k, self.seed) for k in keys), np.uint64, len(keys)), count)
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        with np.errstate(over="ignore"):
            return mixed(within.astype(np.uint64) + base, self.seed)

    def _skips(self, keys: np.ndarray, own: np.ndarray, size: np.ndarray, salts: np.ndarray) -> np.ndarray:
        """Whether each occurrence skips any of its stretch's ``salts``; own: its stretch, size: how many salts each has."""
        at, many = np.cumsum(size) - size, size[own]
        order = np.argsort(-many, kind="stable")
        many, keys, first = many[order], keys[order], at[own[order]]
        any_ = np.zeros(len(own), bool)
        with np.errstate(over="ignore"):
            for b in range(int(many[0]) if len(many) else 0):
                m = int(np.searchsorted(-many, -b, side="left"))
                any_[:m] |= skipped(keys[:m], salts[first[:m] + b], self.limit)
        out = np.empty(len(own), bool)
        out[order] = any_
        return out

    @staticmethod
    def cuts(text: str) -> list[str]:
        """The stretches of a text in which spaces follow each other."""
        cut, spaces = [], 0
        for p in text.split(" ") if text else ():
            if p:
                cut.append(" " * spaces + p)
            spaces = 0 if p else spaces + 1
        if spaces:
            cut.append(" " * (spaces - 1))
        return cut

    def _segmented(self, place: np.ndarray, drawn: np.ndarray, distinct: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Values, and which of them each occurrence has; place: its stretch among ``distinct``."""
        flat, count, salts, size = self.model.whole(distinct)
        values = [self._values(flat, count)]
        if not self.limit:
            return values[0], place
        # occurrences of stretches with very many merges nearly always skip one
        short = size <= MASKED
        salts, size = salts[np.repeat(short, size)], np.where(short, size, 0)
        rows, index, done = np.flatnonzero(self._skips(drawn, place, size, salts) | ~short[place]), place.copy(), len(distinct)
        asked, own = np.unique(place[rows], return_inverse=True)
        shown = [SPACE + distinct[p].replace(" ", SPACE) for p in asked.tolist()]
        length = np.fromiter(map(len, shown), np.int64, len(shown))
        symbols = self.model.single[np.frombuffer("".join(shown).encode("utf-32-le"), np.uint32)]
        at = np.cumsum(length) - length
        odd = np.bincount(np.repeat(np.arange(len(shown)), length), symbols < 0, len(shown)) > 0 if len(shown) else np.zeros(0, bool)
        odd |= (length > SHORT) | np.fromiter((SPACE in distinct[p] for p in asked.tolist()), bool, len(asked))
        order = np.argsort(length[own], kind="stable")
        order = order[~odd[own[order]]]
        while len(order):
            # the longest of the next rows says how many fit into a run
            width = int(length[own[order[min(len(order), CELLS // int(length[own[order[0]]])) - 1]]])
            now, order = order[: max(1, CELLS // width)], order[max(1, CELLS // width) :]
            width = int(length[own[now[-1]]])
            inside = np.arange(width) < length[own[now]][:, None]
            cells = np.where(inside, symbols[np.minimum(at[own[now]][:, None] + np.arange(width), len(symbols) - 1)], np.int32(-1))
            cells = self.model.side_by_side(cells, length[own[now]], drawn[rows[now]], self.limit)
            values.append(self._values(cells[cells >= 0], (cells >= 0).sum(axis=1)))
            index[rows[now]] = done + np.arange(len(now))
            done += len(now)
        extra = []
        for row in rows[odd[own]].tolist():
            index[row] = done + len(extra)
            extra.append(self.model.segment(distinct[place[row]], skipping(int(drawn[row]), self.limit)))
        return pa.concat_arrays([*values, pa.array(extra, pa.large_binary())]), index

    def _values(self, flat: np.ndarray, count: np.ndarray) -> pa.Array:
        """Raw ids, so many for each value."""
        edges = np.concatenate([[0], np.cumsum(count * self.model.dtype.itemsize)]).astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(edges), pa.py_buffer(flat.astype(self.model.dtype))])

    def encode(self, texts: pa.Array, keys: list[bytes]) -> tuple[bytes, np.ndarray]:
        """Raw ids of all texts one after the other, and how many each has."""
        n, lists = len(texts), pc.split_pattern(texts, " ")
        count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        own = np.repeat(np.arange(n), count)
        apart = np.zeros(n, bool)
        apart[own[pc.equal(flat, "").to_numpy(zero_copy_only=False)]] = True
        cut = [self.cuts(texts[i].as_py()) for i in np.flatnonzero(apart).tolist()]
        count[apart] = [len(c) for c in cut]
        stretches = pa.concat_arrays([flat.filter(pa.array(~apart[own])), pa.array([p for c in cut for p in c], flat.type)]).dictionary_encode()
        place, distinct = stretches.indices.to_numpy(zero_copy_only=False).astype(np.int64), stretches.dictionary.to_pylist()
        single = np.repeat(apart, count)
        drawn = self.draw(count, keys)
        values, found = self._segmented(place, np.concatenate([drawn[~single], drawn[single]]), distinct)
        order, plain = np.empty(len(place), np.int64), int((~single).sum())
        order[~single], order[single] = found[:plain], found[plain:]
        out = values.take(pa.array(order))
        at = np.frombuffer(out.buffers()[1], np.int64, len(out) + 1)[np.concatenate([[0], np.cumsum(count)])]
        return out.buffers()[2].to_pybytes()[at[0] : at[-1]] if len(out) else b"", np.diff(at) // self.model.dtype.itemsize


def encoded(text: Column, key: Column, model: str, dropout: float = 0.1, seed: int = 20240229) -> Column:
    """``struct<pieces array<int>, ids_crc32 long, lossless boolean>`` of each text; a null text is empty.

    key: what names the rows' occurrences, such as the id; a null key is the empty one. ids_crc32: of the ids as little-endian
    32-bit numbers. lossless: whether the ids were decoded to the very text. One function gives all three, so that a text is
    encoded once.
    """

    @F.arrow_udf("struct<pieces:array<int>,ids_crc32:bigint,lossless:boolean>")
    def run(texts: pa.Array, keys: pa.Array) -> pa.Array:
        encoder, at = Encoder.of(model, dropout, seed), 0
        names, ids, counts, crc, same = [(k or "").encode() for k in keys.to_pylist()], [], [np.zeros(1, np.int64)], [], []
        for cut in slices(texts.fill_null("")):
            payload, count = encoder.encode(cut, names[at : at + len(cut)])
            flat, edges = np.frombuffer(payload, encoder.model.dtype).astype(np.int32), np.concatenate([[0], np.cumsum(count)]).tolist()
            crc += [zlib.crc32(flat[a:b]) for a, b in zip(edges, edges[1:])]
            same += [d == t for d, t in zip(encoder.model.decoded(flat, edges), cut.cast(pa.binary()).to_pylist())]
            at += len(cut)
            ids.append(flat)
            counts.append(count)
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)), pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
        return pa.StructArray.from_arrays([lists, pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["pieces", "ids_crc32", "lossless"])

    return run(text, key.cast("string"))


def decode(ids: Column, model: str) -> Column:
    """The text of each row's piece ids; null ids give null."""

    @F.arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        edges = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False))]).tolist()
        texts = Model.of(model).decoded(rows.flatten().to_numpy(zero_copy_only=False), edges)
        return pa.array([t.decode() if v else None for t, v in zip(texts, rows.is_valid().to_pylist())], pa.string())

    return run(ids)


def with_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the columns ``pieces``, ``ids_crc32`` and ``lossless``, in place of any of those names; all others stay."""
    added = ("pieces", "ids_crc32", "lossless")
    # the row travels as one value, so that no column of its own can clash
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), encoded(F.col(text_col), F.col(id_col), model, **options).alias("made"))
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in added], *[F.col("made")[c].alias(c) for c in added])
