"""Deterministic views that feed the knowledge-base jobs from the generic tables.

Each is a DataFrame over the tables in a folder and, for oracles, the same view in DuckDB SQL.
A knowledge base (kb) is a tenant; here the source of a document names it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The instants that stand for "now".
AS_OF = "2024-02-01 00:00:00"
AS_OF_MESSAGES = "2024-02-06 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _before(days: str) -> str:
    return f"timestampadd(DAY, -cast({days} as int), TIMESTAMP_NTZ '{AS_OF}')"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id as document_id", "source as kb_id", "concat('doc-', cast(doc_id as string), '.txt') as filename",
        "case when doc_id % 17 = 0 then 'processing' else 'completed' end as status", "n_chars as char_count", f"{_before('doc_id % 400')} as created_at",
    )


def chunks(spark: SparkSession, sf_dir: str, content: bool = True, counted: bool = True, first: int | None = None) -> DataFrame:
    """Document-level chunks; the hit count of a chunk is the number of views and clicks of the user of that number.

    Without ``counted`` there is no hit count, and texts need not be shuffled to meet the events. With ``first`` the content is that many characters of the
    text, cut off before anything is shuffled: for previews.
    """
    hits = table(spark, sf_dir, "events").where("event_type in ('view', 'click') and user_id % 3 <> 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("hits"))
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("text", F.substring("text", 1, first)) if first else docs
    joined = docs.join(hits, docs["doc_id"] == hits["user_id"], "left") if counted else docs
    return joined.selectExpr(
        "doc_id as chunk_id", "doc_id as document_id", "source as kb_id", *(["text as content"] if content else []), "doc_id % 10 as chunk_index", "n_chars as char_count",
        "doc_id % 13 <> 0 as is_active", *(["coalesce(hits, 0L) as hit_count"] if counted else []), f"{_before('doc_id % 400')} as created_at",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = (
        "case when role = 'assistant' and (conv_id + turn) % 5 <> 0 then concat('[{\"chunk_id\":', cast(conv_id * 7 + turn as string), ',\"score\":0.5},"
        "{\"chunk_id\":', cast(conv_id * 3 + turn as string), ',\"score\":0.25}]') end as sources"
    )
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id * 100 + turn as message_id", "conv_id as conversation_id", "concat('src', cast(conv_id % 20 as string)) as kb_id", "role", "text as content", sources,
        "timestampadd(MINUTE, conv_id * 60 + turn, TIMESTAMP_NTZ '2024-02-01 00:00:00') as created_at",
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "case event_type when 'purchase' then 'like' when 'error' then 'dislike' else 'correction' end as feedback_type"
    return table(spark, sf_dir, "events").where("event_type in ('purchase', 'error', 'signup')").selectExpr("event_id as feedback_id", "user_id as chunk_id", kind, "ts as created_at")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples with names of one length, so that no name is part of another."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_linenumber as kb_id", "l_orderkey as chunk_id", "concat('P', lpad(cast(l_partkey as string), 7, '0')) as subject", "l_returnflag as predicate", "concat('S', lpad(cast(l_suppkey as string), 7, '0')) as object_entity"
    )


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as suggestion_id", "o_custkey % 20 as kb_id",
        "case substr(o_orderpriority, 1, 1) when '1' then 'duplicate' when '2' then 'cold_stale' when '3' then 'high_quality_zero_hit' when '4' then 'low_quality' else 'archive_candidate' end as suggestion_type",
        "case o_orderkey % 6 when 0 then 'pending' when 1 then 'approved' when 2 then 'dismissed' when 3 then 'executed' when 4 then 'verified' else 'pending' end as status", "o_orderdate as created_at",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").selectExpr("item_id as query_id", "concat('src', cast(item_id % 20 as string)) as kb_id", "substr(text, 1, 120) as question")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (sample, relevant id); negatives have a null id. Every vector is a sample, relevant are the others of its label among its hundred neighbours in number."""
    e = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "label", "vec_id div 100 as block")
    q, r = e.alias("q"), e.alias("r")
    pair = (F.col("r.block") == F.col("q.block")) & (F.col("r.label") == F.col("q.label")) & (F.col("r.vec_id") != F.col("q.vec_id")) & (F.col("q.label") != 9)
    return q.join(r, pair, "left").selectExpr(
        "q.vec_id as sample_id", "case when q.label = 9 then 'negative' when q.label % 3 = 0 then 'fact' when q.label % 3 = 1 then 'concept' else 'multi_hop' end as q_type",
        "r.vec_id as relevant_id", "case when r.vec_id % 3 = 0 then 'primary' when r.vec_id % 3 = 1 then 'supporting' else 'tangential' end as grade",
    )


#: The views in DuckDB SQL, as common table expressions.
SQL = {
    "fx_documents": f"SELECT doc_id AS document_id, source AS kb_id, concat('doc-', CAST(doc_id AS VARCHAR), '.txt') AS filename, CASE WHEN doc_id % 17 = 0 THEN 'processing' ELSE 'completed' END AS status, n_chars AS char_count, (TIMESTAMP '{AS_OF}' - to_days(CAST(doc_id % 400 AS INTEGER))) AS created_at FROM documents",
    "fx_chunks": f"SELECT d.doc_id AS chunk_id, d.doc_id AS document_id, d.source AS kb_id, d.text AS content, d.doc_id % 10 AS chunk_index, d.n_chars AS char_count, d.doc_id % 13 <> 0 AS is_active, coalesce(h.hits, 0) AS hit_count, (TIMESTAMP '{AS_OF}' - to_days(CAST(d.doc_id % 400 AS INTEGER))) AS created_at FROM documents d LEFT JOIN (SELECT user_id, count(*) AS hits FROM events WHERE event_type IN ('view','click') AND user_id % 3 <> 0 GROUP BY user_id) h ON h.user_id = d.doc_id",
    "fx_messages": "SELECT conv_id * 100 + turn AS message_id, conv_id AS conversation_id, concat('src', CAST(conv_id % 20 AS VARCHAR)) AS kb_id, role, text AS content, CASE WHEN role = 'assistant' AND (conv_id + turn) % 5 <> 0 THEN concat('[{\"chunk_id\":', CAST(conv_id * 7 + turn AS VARCHAR), ',\"score\":0.5},{\"chunk_id\":', CAST(conv_id * 3 + turn AS VARCHAR), ',\"score\":0.25}]') END AS sources, (TIMESTAMP '2024-02-01 00:00:00' + to_minutes(CAST(conv_id * 60 + turn AS BIGINT))) AS created_at FROM conversations",
    "fx_sources": "SELECT conv_id * 100 + turn AS message_id, conv_id AS conversation_id, concat('src', CAST(conv_id % 20 AS VARCHAR)) AS kb_id, p.pos AS pos, CASE p.pos WHEN 0 THEN conv_id * 7 + turn ELSE conv_id * 3 + turn END AS chunk_id, CASE p.pos WHEN 0 THEN 0.5 ELSE 0.25 END AS score FROM conversations, (SELECT 0 AS pos UNION ALL SELECT 1) p WHERE role = 'assistant' AND (conv_id + turn) % 5 <> 0",
    "fx_feedback": "SELECT event_id AS feedback_id, user_id AS chunk_id, CASE event_type WHEN 'purchase' THEN 'like' WHEN 'error' THEN 'dislike' ELSE 'correction' END AS feedback_type, ts AS created_at FROM events WHERE event_type IN ('purchase','error','signup')",
    "fx_relations": "SELECT l_linenumber AS kb_id, l_orderkey AS chunk_id, concat('P', lpad(CAST(l_partkey AS VARCHAR), 7, '0')) AS subject, l_returnflag AS predicate, concat('S', lpad(CAST(l_suppkey AS VARCHAR), 7, '0')) AS object_entity FROM lineitem",
    "fx_suggestions": "SELECT o_orderkey AS suggestion_id, o_custkey % 20 AS kb_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'duplicate' WHEN '2' THEN 'cold_stale' WHEN '3' THEN 'high_quality_zero_hit' WHEN '4' THEN 'low_quality' ELSE 'archive_candidate' END AS suggestion_type, CASE o_orderkey % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' WHEN 2 THEN 'dismissed' WHEN 3 THEN 'executed' WHEN 4 THEN 'verified' ELSE 'pending' END AS status, o_orderdate AS created_at FROM orders",
    "fx_questions": "SELECT item_id AS query_id, concat('src', CAST(item_id % 20 AS VARCHAR)) AS kb_id, substr(text, 1, 120) AS question FROM benchmark",
    "fx_samples": "SELECT q.vec_id AS sample_id, CASE WHEN q.label = 9 THEN 'negative' WHEN q.label % 3 = 0 THEN 'fact' WHEN q.label % 3 = 1 THEN 'concept' ELSE 'multi_hop' END AS q_type, r.vec_id AS relevant_id, CASE WHEN r.vec_id % 3 = 0 THEN 'primary' WHEN r.vec_id % 3 = 1 THEN 'supporting' ELSE 'tangential' END AS grade FROM embeddings q LEFT JOIN embeddings r ON r.label = q.label AND q.label <> 9 AND r.vec_id // 100 = q.vec_id // 100 AND r.vec_id <> q.vec_id",
}


def with_views(sql: str, *more: str) -> str:
    """``sql`` with the views that it names in front; ``more`` are further common table expressions."""
    body = " ".join([*more, sql])
    used = [f"{name} AS ({text})" for name, text in SQL.items() if name in body]
    parts = used + list(more)
    return f"WITH {', '.join(parts)} {sql}" if parts else sql
