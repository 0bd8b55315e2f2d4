"""Registered queries against their SQL, and the pipeline stage by stage."""

import duckdb
import pytest

import corpus_pipeline
from ledgerloom.llm.catalog import ORACLE, QUERIES
from ledgerloom.llm.common import staged, table

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    frame, answer = QUERIES[name](spark, FOLDER), duck.execute(ORACLE[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(frame.columns)
    assert sorted(map(str, map(tuple, frame.select(*columns).collect()))) == sorted(map(str, answer.fetchall()))


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, FOLDER), name)
        assert docs.columns == columns
        kept.append(docs.count())
    assert all(a > b for a, b in zip(kept, kept[1:]))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == kept[-1]


def test_stages_on_empty_table(spark):
    docs = table(spark, FOLDER, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0
        docs = table(spark, FOLDER, "documents").limit(0)
