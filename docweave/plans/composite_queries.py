"""Queries over chunking and composed searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import chunking as K
from docweave.operators import composite as C
from docweave.operators import search, stats
from docweave.operators.common import materialised
from docweave.plans import chunk_sql, composite_sql
from docweave.sources import views as V
from docweave.sources.views import AS_OF


def _chunks(spark, d):
    return V.chunks(spark, d, counted=False)


def _vectors(spark, d):
    """The chunks' vectors, without their texts: those of the embeddings of the same number."""
    e = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return V.chunks(spark, d, content=False, counted=False).select("chunk_id", "kb_id").join(e, "chunk_id")


def _postings(spark, d):
    return materialised(search.build_postings(_chunks(spark, d)))


def _queries(spark, d):
    e = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return V.questions(spark, d).join(e, "query_id", "left")


def _quality(spark, d):
    q = stats.recalculate_quality(V.chunks(spark, d, content=False), stats.feedback_counts(V.feedback(spark, d)), AS_OF)
    return q.withColumns({"dislike_count": F.col("dislike_count") % 4, "needs_review": F.col("chunk_id") % 5 == 0, "quality_score": F.col("quality_score") + 0.3})


def _finder(spark, d, postings=None):
    chunks, stored, quality = _chunks(spark, d), _vectors(spark, d), _quality(spark, d)
    postings = _postings(spark, d) if postings is None else postings
    return lambda q, k: C.hybrid_search(q, chunks, postings, quality, k, stored=stored)


def _templated(spark, d):
    b = V.table(spark, d, "benchmark")
    text = "case item_id % 3 when 0 then concat('「', substr(text, 1, 16), '」和「', substr(text, 18, 16), '」之间有什么联系') when 1 then concat(substr(text, 1, 30), '；', substr(text, 32, 30)) else substr(text, 1, 100) end"
    e = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return b.selectExpr("item_id as query_id", "concat('src', cast(item_id % 20 as string)) as kb_id", f"{text} as question").join(e, "query_id", "left")


def _short(df):
    return df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("content")).alias("n_chars"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "|")).alias("content_md5"))


def tx01_chunk_fixed(spark, d):
    return _short(K.chunk_fixed(V.table(spark, d, "documents")))


def tx02_chunk_markdown(spark, d):
    """Every tenth line a heading."""
    docs = V.table(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 10 == 0, F.concat(F.lit("## "), F.substring(x, 1, 20), F.lit("\n"), x)).otherwise(x)), "\n").alias("text"))
    return _short(K.chunk_markdown(docs))


def tx03_chunk_paragraphs(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return _short(K.chunk_paragraphs(docs))


def tx04_chunk_pages(spark, d):
    pages = V.table(spark, d, "documents").select(F.expr("doc_id div 4").alias("doc_id"), (F.col("doc_id") % 4).alias("page_no"), "text")
    return _short(K.chunk_pages(pages))


def tx06_build_chunks(spark, d):
    docs = V.table(spark, d, "documents").selectExpr("doc_id as document_id", "source as kb_id", "case when doc_id % 2 = 0 then 'md' else 'txt' end as file_type", "text")
    kbs = docs.select("kb_id").distinct().selectExpr("kb_id", "400 as chunk_size", "40 as chunk_overlap")
    return K.build_chunks(docs, kbs).select("kb_id", "document_id", "chunk_index", "char_count", "chunk_id")


def sr04_hybrid_search(spark, d):
    return _finder(spark, d)(_queries(spark, d), 5).select("query_id", "chunk_id", "score", "rank")


def sr06_multi_hop_search(spark, d):
    postings = _postings(spark, d)
    return C.multi_hop_search(_templated(spark, d), _finder(spark, d, postings), postings, _chunks(spark, d))


def sr07_sub_query_search(spark, d):
    return C.sub_query_search(_templated(spark, d), _finder(spark, d))


def sr07b_coverage(spark, d):
    q = _templated(spark, d)
    return C.coverage(q, _finder(spark, d)(q, 5), _chunks(spark, d))


def sr08_retrieval_abstain(spark, d):
    q = _templated(spark, d)
    return C.retrieval_abstain(q, _finder(spark, d)(q, 5), _chunks(spark, d)).select("query_id", "chunk_id", "rank")


def sr09_sufficiency(spark, d):
    q = _templated(spark, d)
    return C.sufficiency(q, _finder(spark, d)(q, 5), _chunks(spark, d)).select("query_id", "route", "sufficient", "sufficiency")


def sr20_two_round_search(spark, d):
    return C.two_round_search(_templated(spark, d), _finder(spark, d), _chunks(spark, d))


def _relations(spark, d):
    """Triples between the two spans that every third question quotes, and from the second to a name of its own, in chunks spread over all."""
    b = V.table(spark, d, "benchmark").where("item_id % 3 = 0").selectExpr("item_id", "concat('src', cast(item_id % 20 as string)) as kb_id", "trim(substr(text, 1, 16)) as one", "trim(substr(text, 18, 16)) as two")
    n = V.table(spark, d, "documents").agg(F.max("doc_id").alias("last"))
    rows = b.crossJoin(F.broadcast(n)).selectExpr("kb_id", "inline(array(struct((item_id * 37 + 1) % last as chunk_id, one as subject, '关联' as predicate, two as object_entity), struct((item_id * 53 + 2) % last as chunk_id, two as subject, '属于' as predicate, concat('group ', cast(item_id as string)) as object_entity)))")
    return rows.where("length(subject) >= 2 and subject <> object_entity")


def sr22_routed_search(spark, d):
    """Questions routed to the hybrid search alone or beside the entity graph."""
    return C.routed_search(_templated(spark, d), _finder(spark, d), _relations(spark, d), _chunks(spark, d))


def sr21_strict_vs_relaxed(spark, d):
    relations = _relations(spark, d)
    return C.strict_vs_relaxed(_templated(spark, d), _chunks(spark, d), _postings(spark, d), _quality(spark, d), relations, stored=_vectors(spark, d))


SQL: dict[str, str] = chunk_sql.SQL | composite_sql.SQL
QUERIES = {k: v for k, v in globals().items() if k[:2] in ("tx", "sr") and callable(v)}
