"""One evaluation end to end: documents to chunks, postings, searched questions, reranked results and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import chunking, evaluation, ranking, search
from docweave.operators.common import materialised
from docweave.sources.views import table


def quoting_chunks(items: DataFrame, parts: DataFrame, words: int = 8) -> DataFrame:
    """query_id, chunk_id: every chunk that holds the first words of a question, met by the hash of word windows.

    Of questions with fewer words, all are looked for. Windows travel as hashes; the words themselves are compared for
    the chunks that met.
    """
    split = lambda c: F.filter(F.split(F.col(c), r"\s+"), lambda w: w != "")
    opening = items.select("query_id", F.slice(split("question"), 1, words).alias("opening")).where("size(opening) > 0")
    opening = opening.withColumn("key", F.xxhash64("opening"))
    sizes = opening.agg(F.collect_set(F.size("opening")).alias("sizes"))  # one row of ``words`` numbers at most
    hashes = F.expr("flatten(transform(sizes, n -> if(size(w) >= n, transform(sequence(1, size(w) - n + 1), i -> xxhash64(slice(w, i, n))), array())))")
    keys = parts.select("chunk_id", split("content").alias("w")).crossJoin(F.broadcast(sizes)).select("chunk_id", F.explode(F.array_distinct(hashes)).alias("key"))
    met = keys.join(opening, "key").select("query_id", "chunk_id", "opening").distinct()
    held = met.join(parts.select("chunk_id", split("content").alias("w")), "chunk_id")
    return held.where(F.expr("exists(sequence(1, greatest(size(w) - size(opening) + 1, 1)), i -> slice(w, i, size(opening)) = opening)")).select("query_id", "chunk_id")


def evaluate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the benchmark's texts as questions; relevant is every chunk of the documents that quote the text."""
    docs = table(spark, sf_dir, "documents")
    parts = chunking.chunk_paragraphs(docs).select(F.xxhash64("doc_id", "chunk_index").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.lit("all").alias("kb_id"), "content", F.lit(True).alias("is_active"))
    parts = materialised(parts)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(None).cast("string").alias("kb_id"), F.col("text").alias("question"))
    found = materialised(search.bm25_search(items, materialised(search.build_postings(parts))))
    rows = found.join(parts.select("chunk_id", "document_id", "content"), "chunk_id").join(items.select("query_id", "question"), "query_id")
    ranked = ranking.term_overlap_rerank(rows.withColumns({"rrf_score": 1 / (60.0 + F.col("rank")), "model_score": F.lit(None).cast("double")}))
    kept = ranking.ranked(ranking.post_retrieval_filter(ranked).drop("rank"), most=5)
    run = kept.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("retrieved"))
    quoted = quoting_chunks(items, parts).groupBy("query_id").agg(F.collect_set("chunk_id").alias("relevant"))
    empty = F.array().cast("array<bigint>")
    samples = items.select("query_id").join(run, "query_id", "left").join(quoted, "query_id", "left")
    samples = samples.select(F.lit("fact").alias("q_type"), F.coalesce("retrieved", empty).alias("retrieved"), F.coalesce("relevant", empty).alias("relevant"), F.lit(None).cast("map<bigint,string>").alias("grades"))
    return evaluation.aggregate(evaluation.retrieval_metrics(samples)).drop("avg_retrieve_ms", "avg_generate_ms", "answer_relevancy_mean", "llm_judge_faithfulness_mean", "faithfulness_mean")
