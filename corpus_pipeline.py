"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellspan.llm import lines, mixing, pieces, quality, simhash
from quellspan.session import scratch, table, written

#: Mixing in the pipeline bends shares only gently, so that most tokens stay.
POWERS = {"source": 0.9, "lang": 0.95, "topic": 0.95}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier, alike or nearly, go; so does a document of which no words are left."""
    return lines.deduplicated(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: texts that share 0.8 or more of their shingles of five words."""
    return simhash.deduplicate(docs, shingle_words=5, overlap=0.8)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that sources, languages and topics reach their target shares."""
    return mixing.sample(docs, powers=POWERS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids with merge-dropout; ``lossless``: they decode to the very text."""
    out = pieces.with_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "lang", "source", "pieces", F.size("pieces").cast("long").alias("n_pieces"), "lossless")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mixing sources to target weights", mixing_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: Merge-dropout and fingerprints have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name.split()[0].lower(), "zstd", keep=True)
    return docs
