"""From documents to packed training sequences.

Five stages, each an operator of ``articlelake.llm`` over all rows that the one before kept:
low-quality documents go, then exact copies, then near copies; sources are mixed to target
weights, so a document may come twice or not at all; what is drawn is packed into
sequences. All stages but the last return the columns of ``documents``.

Null texts count as empty and null doc_ids as a doc_id of their own in each stage; an empty
table passes through. Columns beside those that a stage reads are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from articlelake.llm import byte_network, mixing, ngram_join, packing, quotient_filter
from articlelake.llm.tables import prepare, read, stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return byte_network.keep_quality(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return quotient_filter.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar word shingles, the one with the smallest doc_id."""
    return ngram_join.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, a row each time one is taken."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    found = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return packing.pack(stored(found, "pieces"))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

# Scores, shingle links and token ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
