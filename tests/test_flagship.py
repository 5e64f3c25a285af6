"""The flagship query counts relevant chunks that the search does not return."""

from pyspark.sql import functions as F

from docweave.plans.flagship import evaluate_search


def test_relevant_chunks_beyond_the_hits_count(spark, tmp_path):
    passage = "silver rivers carry quiet stones beneath seven old bridges every spring"
    spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit(passage + " note "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(80).alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    row = evaluate_search(spark, str(tmp_path)).first().asDict()
    print(row)
    recall = [v for k, v in row.items() if "recall" in k and v is not None]
    assert recall and all(v <= 5 / 40 + 1e-6 for v in recall)
