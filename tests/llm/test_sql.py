"""Queries that SQL can express, against their SQL on the whole smallest tables."""

import pytest

from articlelake.llm.queries import ORACLES, QUERIES
from oracle import difference

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, FOLDER), FOLDER, ORACLES[name]) is None


def test_pipeline_packs_what_the_stages_keep(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    packed = corpus_pipeline.run(spark, FOLDER).select("doc_id", "sequence_id").collect()
    assert packed and {r["doc_id"] for r in packed} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
