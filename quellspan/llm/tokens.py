"""Token ids in binary shards, with a minimal perfect hash index from document key to place in the shard.

A shard file holds, one after the other:

* the raw ids of its documents, little-endian, two bytes an id where the vocabulary fits and four otherwise;
* the index: the document ids in order, where each document's ids begin, and a minimal perfect hash of the distinct keys
  with one stored fingerprint and one document ordinal per slot;
* a JSON header of the arrays and its length.

Documents are dealt to shards by ranges of (id, place in the input), so shards in order hold ascending ids, a frequent id
may span shards, and no task holds more than a range.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellspan.session import work_path

MOST_CACHED = 600_000
SLICE_BYTES = 4 << 20


# ---- encoding ---------------------------------------------------------------------------------------------------------


class Encoder:
    """Ids of whole texts from the tokenizers library; each distinct stretch between spaces is encoded once per worker.

    The pre-tokenizer never joins what stands before a single space to what follows it, so a text may be cut there. Texts in
    which a space touches other white space, or that hold a special token's string, are encoded in one piece.
    """

    _kept: dict = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.cache: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        """Raw ids of one text, from the library."""
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Ids of pieces, each with the space before it; encoded together and cut where a token opens with a space."""
        raw = self._ids(" " + " ".join(pieces)) if pieces else b""
        at = (np.flatnonzero(self.opens[np.frombuffer(raw, self.dtype)]) * self.dtype.itemsize).tolist()
        if len(at) == len(pieces):
            self.cache.update((p, raw[i:j]) for p, i, j in zip(pieces, at, [*at[1:], len(raw)]))
        else:
            self.cache.update((p, self._ids(" " + p)) for p in pieces)

    def encode(self, texts: pa.Array, end: bytes = b"") -> tuple[bytes, np.ndarray]:
        """Raw ids of all texts one after the other, ``end`` after each, and how many ids each text has, ``end`` included.

        The pieces of all texts are told apart once; each distinct piece is looked up, or learned, once.
        """
        if len(self.cache) > MOST_CACHED:
            self.cache.clear()
        lists = pc.split_pattern(texts.fill_null(""), " ")
        pieces = lists.flatten().dictionary_encode()
        place, distinct = pieces.indices.to_numpy(zero_copy_only=False).astype(np.int64), pieces.dictionary.to_pylist()
        n, edges = len(texts), np.cumsum(np.concatenate([[0], pc.list_value_length(lists).to_numpy(zero_copy_only=False)]))
        first = np.zeros(len(place), bool)
        first[edges[:-1]] = True
        own = np.repeat(np.arange(n), np.diff(edges))
        values, used = list(map(self.cache.get, distinct)), np.zeros(len(distinct), bool)
        used[place[~first]] = True
        new = [distinct[i] for i in np.flatnonzero(used).tolist() if values[i] is None]
        odd = [p for p in new if not p or p[0].isspace() or p[-1].isspace() or any(s in p for s in self.special)]
        self._learn(list(set(new).difference(odd)))
        self.cache.update(dict.fromkeys(odd, b""))  # at an empty value a text can't be cut
        values = [v if v is not None or not u else self.cache[p] for p, v, u in zip(distinct, values, used.tolist())]
        blocked = np.fromiter((v == b"" for v in values), bool, len(values))
        whole = np.zeros(n, bool)
        whole[own[blocked[place] & ~first]] = True
        for s in self.special:
            whole |= pc.match_substring(texts.fill_null(""), s).to_numpy(zero_copy_only=False)
        heads = [self._ids(texts[i].as_py()) if whole[i] else self._ids(distinct[place[at]]) for i, at in enumerate(edges[:-1].tolist())]
        place[first] = len(distinct) + np.arange(n)
        kept = first | ~whole[own]
        counts = np.bincount(own[kept], minlength=n)
        table = pa.array([*(v or b"" for v in values), *heads, end], pa.large_binary())
        order = np.insert(place[kept], np.cumsum(counts), len(values) + n)
        out = table.take(pa.array(order))
        at = np.frombuffer(out.buffers()[1], np.int64, len(out) + 1)[np.concatenate([[0], np.cumsum(counts + 1)])]
        return out.buffers()[2].to_pybytes()[at[0] : at[-1]] if n else b"", np.diff(at) // self.dtype.itemsize


def slices(texts: pa.Array, size: int = SLICE_BYTES):
    """Runs of rows of about ``size`` bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cell = (np.cumsum(sizes) - sizes) // size
    starts = np.flatnonzero(np.diff(cell, prepend=-1)).tolist()
    for a, b in zip(starts, [*starts[1:], len(texts)]):
        yield texts.slice(a, b - a)


# ---- minimal perfect hash -----------------------------------------------------------------------------------------------


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of each key under a seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 977) >> np.uint64(32)).astype(np.uint32)


def build_hash(keys: np.ndarray, room: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Levels of bit arrays: a key belongs to the first level where nobody else hits its bit; its slot is that bit's rank.

    Returns the words of all levels and each level's number of words. Keys must be distinct.
    """
    words, sizes, level = [], [], 0
    while len(keys):
        size = max(1, int(np.ceil(len(keys) * room / 64)))
        at = mixed(keys, level) % np.uint64(size * 64)
        alone = np.bincount(at.astype(np.int64), minlength=size * 64)[at.astype(np.int64)] == 1
        bits = np.zeros(size * 64, np.uint8)
        bits[at[alone].astype(np.int64)] = 1
        words.append(np.packbits(bits, bitorder="little").view("<u8"))
        sizes.append(size)
        keys, level = keys[~alone], level + 1
    return np.concatenate(words) if words else np.zeros(0, "<u8"), np.array(sizes, "<i8")


def slots(words: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 where no level has it. A key outside the set may get some slot: compare fingerprints."""
    rank = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
    out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        if not len(left):
            break
        at = (mixed(keys[left], level) % np.uint64(size * 64)).astype(np.int64)
        word, bit = base + at // 64, (at % 64).astype(np.uint64)
        hit = (words[word] >> bit) & np.uint64(1) == 1
        below = np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
        out[left[hit]] = (rank[word] + below)[hit]
        left, base = left[~hit], base + size
    return out


# ---- shard files --------------------------------------------------------------------------------------------------------


def open_fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def index_bytes(ids: np.ndarray, nulls: int, lengths: np.ndarray, dtype: np.dtype) -> bytes:
    """The index of a shard whose first ``nulls`` documents have no id; the others' ids ascend and may repeat."""
    distinct, first = np.unique(ids[nulls:], return_index=True)
    keys = distinct.view(np.uint64)
    words, sizes = build_hash(keys)
    slot = slots(words, sizes, keys)
    prints, ordinal = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<i8")
    prints[slot], ordinal[slot] = fingerprints(keys), first + nulls
    arrays = {"ids": ids.astype("<i8"), "begin": np.concatenate([[0], np.cumsum(lengths)]).astype("<i8"), "words": words, "sizes": sizes, "prints": prints, "ordinal": ordinal}
    header = json.dumps({"dtype": dtype.str, "nulls": nulls, "arrays": [[k, v.dtype.str, len(v)] for k, v in arrays.items()]}).encode()
    return b"".join(v.tobytes() for v in arrays.values()) + header + len(header).to_bytes(8, "little")


class Shard:
    """A shard in memory or in a file: documents by ordinal, and by key in constant time."""

    def __init__(self, source):
        self.source = source if hasattr(source, "read_at") else pa.BufferReader(source)
        end = self.source.size()
        n = int.from_bytes(self.source.read_at(8, end - 8), "little")
        header = json.loads(bytes(self.source.read_at(n, end - 8 - n)))
        self.dtype, self.nulls = np.dtype(header["dtype"]), header["nulls"]
        at = end - 8 - n - sum(np.dtype(d).itemsize * size for _, d, size in header["arrays"])
        for name, d, size in header["arrays"]:
            setattr(self, name, np.frombuffer(self.source.read_at(np.dtype(d).itemsize * size, at), d))
            at += np.dtype(d).itemsize * size

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ordinal of the first document with each key, -1 where the shard has none."""
        keys = np.asarray(keys, np.int64)
        slot = slots(self.words, self.sizes, keys.view(np.uint64))
        found = slot >= 0
        found[found] = self.prints[slot[found]] == fingerprints(keys[found].view(np.uint64))
        out = np.full(len(keys), -1, np.int64)
        out[found] = self.ordinal[slot[found]]
        return out

    def read(self, ordinal: int) -> np.ndarray:
        size = self.dtype.itemsize
        a, b = int(self.begin[ordinal]), int(self.begin[ordinal + 1])
        return np.frombuffer(self.source.read_at((b - a) * size, a * size), self.dtype)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, ``end_id`` after each, into shards under ``path``; returns the manifest, a row per shard.

    Null texts are empty (their only id is the end). Rows without id come first, then ascending ids; rows of one id stay in
    input order. Ids must be integers. Other columns are not read. A shard is written beside its place and moved there, so a task that runs again
    leaves the same file.
    """

    def run(batches):
        from pyspark import TaskContext

        encoder = Encoder.of(tokenizer)
        fs, folder = open_fs(path)
        context, end = TaskContext.get(), np.array([end_id], encoder.dtype).tobytes()
        name = f"{folder}/shard-{context.partitionId():07d}"
        part, sink, ids, nulls, lengths = f"{name}.{context.taskAttemptId()}.part", None, [], 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                fs.create_dir(folder, recursive=True)
                sink = fs.open_output_stream(part)
            nulls += batch.column(0).null_count
            ids.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            for texts in slices(batch.column(1)):
                payload, counts = encoder.encode(texts, end)
                sink.write(payload)
                lengths.append(counts)
        if sink is None:
            return
        ids = np.concatenate(ids).astype(np.int64)
        lengths = np.concatenate(lengths)
        sink.write(index_bytes(ids, nulls, lengths, encoder.dtype))
        sink.close()
        fs.move(part, f"{name}.qids")
        row = (context.partitionId(), len(ids), int(lengths.sum()), int(ids[0]) if not nulls else None, int(ids[-1]) if nulls < len(ids) else None)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], ["shard", "n_docs", "n_ids", "first_id", "last_id"])

    placed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("place"))
    ranged = placed.repartitionByRange("id", "place").sortWithinPartitions("id", "place").select("id", "text")
    return ranged.mapInArrow(run, "shard long, n_docs long, n_ids long, first_id long, last_id long")


def read(spark: SparkSession, path: str, manifest: list) -> DataFrame:
    """Every document of the shards, each found through its shard's index: id, start, n_tokens, ids_crc32.

    start: ids of all documents before it. manifest: the rows of :func:`write`, one per shard.
    """
    base, before = {}, 0
    for row in sorted(manifest, key=lambda r: r.shard):
        base[row.shard], before = before, before + row.n_ids

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(content.as_buffer())
                number = int(name.rsplit("shard-", 1)[1].split(".")[0])
                ordinal = np.arange(len(shard.ids))
                own = shard.ids[shard.nulls :]
                at = shard.find(own)
                if len(own) and not (shard.ids[at] == own).all():
                    raise ValueError(f"the index of {name} does not find its own documents")
                run_start = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.zeros(0, bool)
                ordinal[shard.nulls :] = at + np.arange(len(own)) - np.maximum.accumulate(np.where(run_start, np.arange(len(own)), 0)) if len(own) else at
                crc = [zlib.crc32(shard.read(i).astype("<u4").tobytes()) for i in ordinal.tolist()]
                starts, lengths = base[number] + shard.begin[ordinal], shard.begin[ordinal + 1] - shard.begin[ordinal]
                ids = pa.array(shard.ids, pa.int64(), mask=np.arange(len(shard.ids)) < shard.nulls)
                yield pa.RecordBatch.from_arrays([ids, pa.array(starts), pa.array(lengths), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    if not base:
        return spark.createDataFrame([], "id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.qids").load(path)
    return files.select("path", "content").mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def lookup(path: str, manifest: list, key: int) -> list[np.ndarray]:
    """The ids of each document with this key; reads only the index of the shards whose range holds the key, and its ids."""
    fs, folder = open_fs(path)
    out = []
    for row in sorted(manifest, key=lambda r: r.shard):
        if row.last_id is None or row.last_id < key or (row.first_id is not None and row.first_id > key):
            continue
        with fs.open_input_file(f"{folder}/shard-{row.shard:07d}.qids") as source:
            shard = Shard(source)
            at = int(shard.find(np.array([key]))[0])
            while 0 <= at < len(shard.ids) and shard.ids[at] == key:
                out.append(shard.read(at))
                at += 1
    return out


def encoded(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ``docs`` to shards in the shared folder and reads them back."""
    spark = docs.sparkSession
    path = work_path(spark, "tokens")
    manifest = write(docs, path, tokenizer, end_id, id_col, text_col).collect()
    return read(spark, path, manifest).withColumnRenamed("id", id_col)
