import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import assert_same, connect  # noqa: E402

import corpus_pipeline  # noqa: E402
from tallyforge.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE_SQL[name])


def test_pipeline_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns
        ids = {r.doc_id for r in kept.collect()}
        assert ids <= {r.doc_id for r in before.collect()}
        if name == "language_id":
            assert len(ids) >= 0.99 * docs.count()
        if name == "line_dedup":
            assert len(ids) == before.count()
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()} == ids
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == ids
