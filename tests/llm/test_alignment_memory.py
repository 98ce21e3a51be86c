"""What a task of op12 holds at once, in its worker and in Spark."""

import re
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quellspan.llm import alignment
from quellspan.session import LARGE_ROWS, arrow_batches, written
from tests.llm.test_alignment import PATHS


def test_batches_do_not_follow_what_arrow_hands_over():
    texts = ["x" * 400_000] * 30 + [None, "", "y" * (6 << 20), "z"]
    table = pa.table({"id": range(len(texts)), "text": texts})
    for rows in (1, 7, 1000):
        found = list(alignment.gathered(table.to_batches(rows)))
        assert pa.Table.from_batches(found).equals(table)
        sizes = [sum(len(t or "") for t in b.column("text").to_pylist()) for b in found]
        assert all(alignment.BATCH_BYTES <= s for s in sizes[:-1]) and max(sizes) < (4 << 20) + (6 << 20)
    assert list(alignment.gathered([])) == []


def test_a_worker_keeps_the_stretches_of_one_batch():
    own = alignment.Aligner(*PATHS)
    for k in range(3):
        own.summed(pa.array([" ".join(f"w{k}x{i}y{j}" for j in range(1200)) for i in range(100)]))
        assert len(own.number) <= 120_000


def test_workers_get_few_bytes_at_once(spark):
    docs = spark.range(0, 24, 1, 1).select("id", F.repeat(F.lit("a"), 1 << 20).alias("text"))
    with arrow_batches(spark, alignment.ARROW_CUT):
        rows = docs.mapInArrow(lambda parts: (pa.RecordBatch.from_pydict({"n": [p.num_rows]}) for p in parts), "n long").collect()
    assert sum(r.n for r in rows) == 24 and max(r.n for r in rows) <= 3


def test_row_groups_hold_a_few_batches(spark, tmp_path):
    big = spark.range(0, 24, 1, 1).select("id", F.unhex(F.repeat(F.sha2(F.col("id").cast("string"), 512), 1 << 15)).alias("rows"))
    path = written(big, "large", "uncompressed", options=LARGE_ROWS).inputFiles()[0]
    found = pq.ParquetFile(path.removeprefix("file:")).metadata
    assert max(found.row_group(i).total_byte_size for i in range(found.num_row_groups)) <= 24 << 20


def test_a_worker_gives_memory_back():
    """Live blocks between freed ones: the system gets the freed ones back."""

    def held():
        return sum(int(x) for x in re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())) / 1024

    before = held()
    blocks = [bytearray(100_000) for _ in range(2000)]
    kept = blocks[::100]
    del blocks
    alignment.released()
    assert len(kept) == 20 and held() - before < 60
