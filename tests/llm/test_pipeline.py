"""The pipeline against its parts, and the queries against their SQL."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from eavista.llm.queries import ORACLE, QUERIES
from eavista.llm.shared import stored, table

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF_DIR, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF_DIR), "stage")
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] <= sizes[4]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    found = QUERIES[name](spark, SF_DIR).toPandas()
    with duckdb.connect() as base:
        for view in ("documents", "embeddings", "conversations"):
            base.execute(f"CREATE VIEW {view} AS SELECT * FROM '{SF_DIR}/{view}.parquet'")
        wanted = base.execute(ORACLE[name]).df()
    columns = sorted(wanted.columns)
    rows = [sorted(map(str, frame[columns].itertuples(index=False, name=None))) for frame in (found, wanted)]
    assert rows[0] == rows[1]
