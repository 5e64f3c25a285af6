"""Upserts of documents whose vectors are near each other without being equal, against the SQL."""

import random

import duckdb

from docweave.plans import registry
from tests.test_oracles import plain


def test_near_vectors_are_held_as_in_sql(spark, tmp_path):
    rng = random.Random(3)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(3)], 0) for i in range(200)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    docs = [(i, f"text of {i}", f"src{i % 2}") for i in range(90)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    for t in ("embeddings", "documents"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    ours = registry.QUERIES["ss01b_stream_upsert"](spark, str(tmp_path)).toPandas()
    theirs = duck.sql(registry.SQL["ss01b_stream_upsert"]).df()
    assert plain(ours) == plain(theirs)
    # some are refused as conflicts, so they are neither indexed nor held as duplicates
    assert (ours.n_indexed + ours.n_held < ours.n_documents).any() and len(ours) == 2
