"""Queries without SQL run, and their results keep the rules that hold whatever the data."""

import pytest

import __spark_entry__ as entry
from docweave.plans import registry

FREE = sorted(set(registry.QUERIES) - set(registry.SQL))


@pytest.mark.parametrize("name", FREE)
def test_runs(spark, small, name):
    df = registry.QUERIES[name](spark, small)
    rows = df.toPandas()
    if "rank" in rows and "query_id" in rows:
        assert not rows.duplicated(["query_id", "chunk_id"]).any()
        assert (rows.groupby("query_id")["rank"].min() >= 1).all()


def test_stream_ingest_equals_batch(spark, small):
    from pyspark.sql import functions as F

    from docweave.operators.chunking import build_chunks
    from docweave.plans import io_queries
    from docweave.sources import views as V

    docs = V.table(spark, small, "documents").selectExpr("doc_id as document_id", "source as kb_id", "'txt' as file_type", "text")
    kbs = docs.select("kb_id").distinct().selectExpr("kb_id", "500 as chunk_size", "50 as chunk_overlap")
    batch = build_chunks(docs, kbs).groupBy("kb_id").agg(F.count(F.lit(1)).alias("n"), F.sum("char_count").alias("c"))
    stream = io_queries.ss01_stream_ingest(spark, small).groupBy("kb_id").agg(F.sum("n_chunks").alias("n"), F.sum("n_chars").alias("c"))
    assert {tuple(r) for r in stream.collect()} == {tuple(r) for r in batch.collect()}


def test_entry(spark, small):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
