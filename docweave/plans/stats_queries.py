"""Queries over the usage and quality aggregates, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import stats as S
from docweave.sources import views as V
from docweave.sources.views import AS_OF, AS_OF_MESSAGES, with_views


def _chunks(spark, d):
    return V.chunks(spark, d, content=False)


def _quality(spark, d):
    return S.recalculate_quality(_chunks(spark, d), S.feedback_counts(V.feedback(spark, d)), AS_OF)


def _tags(spark, d):
    return V.table(spark, d, "documents").selectExpr("doc_id as document_id", "source as kb_id", "doc_id % 7 as tag_id")


def _gate(spark, d):
    return V.table(spark, d, "documents").selectExpr("doc_id % 500 as document_id", "n_chars as char_count", "case when doc_id % 11 = 0 then 'duplicate' when doc_id % 5 = 0 then 'conflict' else 'allow' end as gate_status")


def fl01_active_chunks(spark, d):
    return _chunks(spark, d).where("kb_id = 'src3' and is_active").select("chunk_id", "kb_id", "hit_count")


def fl05_cold_chunks(spark, d):
    return S.cold_chunks(_chunks(spark, d), AS_OF).select("chunk_id", "kb_id", "created_at")


def fl06_stuck_documents(spark, d):
    return S.stuck_documents(V.documents(spark, d), AS_OF).select("document_id", "kb_id", "filename")


def ag01_hit_distribution(spark, d):
    return S.hit_distribution(_chunks(spark, d))


def ag02_kb_stats(spark, d):
    return S.kb_stats(V.documents(spark, d), _chunks(spark, d))


def ag03_stats_overview(spark, d):
    return S.stats_overview(V.documents(spark, d), _chunks(spark, d))


def ag04_kb_summary(spark, d):
    return S.kb_summary(V.documents(spark, d), V.messages(spark, d), _chunks(spark, d), _tags(spark, d))


def ag05_cite_counts(spark, d):
    return S.cite_counts(V.messages(spark, d))


def ag06_activity_heatmap(spark, d):
    return S.activity_heatmap(V.messages(spark, d), AS_OF_MESSAGES)


def ag07_hit_trend(spark, d):
    return S.hit_trend(V.messages(spark, d), AS_OF_MESSAGES).withColumn("day", F.col("day").cast("string"))


def ag08_cold_knowledge(spark, d):
    return S.cold_knowledge(_chunks(spark, d), AS_OF)


def ag09_rag_sankey(spark, d):
    return S.rag_sankey(V.messages(spark, d))


def ag10_suggestion_status_counts(spark, d):
    return S.suggestion_status_counts(V.suggestions(spark, d))


def ag11_kb_health(spark, d):
    gaps = V.messages(spark, d).where("role = 'user'").selectExpr("kb_id", "case message_id % 4 when 0 then 'pending' when 1 then 'suggested' when 2 then 'ignored' else 'resolved' end as status")
    conflicts = V.table(spark, d, "documents").where("doc_id % 9 = 0").selectExpr("source as kb_id", "case doc_id % 2 when 0 then 'pending' else 'resolved' end as status")
    return S.kb_health(_chunks(spark, d), _quality(spark, d), gaps, conflicts, AS_OF)


def ag12_document_rollup(spark, d):
    return S.document_rollup(_gate(spark, d))


def ag13_feedback_counts(spark, d):
    return S.feedback_counts(V.feedback(spark, d))


def ag13b_feedback_by_message(spark, d):
    """Feedback that names a message counts for every chunk the message cites."""
    fb = V.messages(spark, d).where("role = 'assistant'").selectExpr("message_id", "cast(null as bigint) as chunk_id", "case message_id % 3 when 0 then 'like' when 1 then 'dislike' else 'correction' end as feedback_type")
    return S.feedback_counts(fb, V.messages(spark, d))


def ag14_hit_counts(spark, d):
    found = S.exploded_sources(V.messages(spark, d)).select("chunk_id")
    return S.hit_counts(_chunks(spark, d).select("chunk_id", "kb_id", "hit_count"), found)


def ag15_recalculate_quality(spark, d):
    return _quality(spark, d)


def ag22_gate_stats(spark, d):
    return S.gate_stats(_gate(spark, d))


def jn04_messages_by_kb(spark, d):
    m = V.messages(spark, d).select("message_id", "conversation_id", "role")
    owners = V.messages(spark, d).select("conversation_id", "kb_id").distinct()
    return m.join(owners, "conversation_id").groupBy("kb_id", "role").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("conversation_id").alias("n_conversations"))


def jn05_previous_user_message(spark, d):
    return S.previous_user_message(V.messages(spark, d)).select("message_id", "question_id", F.md5("question").alias("question_md5"))


def jn06_immediately_previous_user(spark, d):
    return S.immediately_previous_user(V.messages(spark, d)).select("message_id", "question_id", F.md5("question").alias("question_md5"))


def wn07_top_chunks(spark, d):
    return S.top_chunks(_chunks(spark, d))


def wn07b_cite_vs_hit(spark, d):
    return S.cite_vs_hit(V.chunks(spark, d), S.cite_counts(V.messages(spark, d)))


def wn08_low_quality_top(spark, d):
    return S.low_quality_top(_chunks(spark, d), _quality(spark, d))


def wn10_conversation_title(spark, d):
    return S.conversation_title(V.messages(spark, d))


def wn11_compress_history(spark, d):
    return S.compress_history(V.messages(spark, d))


def wn13_metric_trend(spark, d):
    runs = V.table(spark, d, "orders").selectExpr("o_orderkey as run_id", "concat('v', cast(o_custkey % 2 as string)) as dataset_version", "o_orderdate as created_at", "concat('{\"recall\":', cast(o_custkey % 100 / 100.0D as string), ',\"mrr\":0.5}') as aggregate_json")
    return S.metric_trend(runs, "context_recall", 20, "v1").select("run_id", "value")


def wn14_recent_turn(spark, d):
    return S.recent_turn(V.messages(spark, d)).select("conversation_id", F.md5("user_text").alias("user_md5"), F.md5("assistant_text").alias("assistant_md5"))


_COUNTS = "fb AS (SELECT chunk_id, CAST(sum(CASE WHEN feedback_type = 'like' THEN 1 ELSE 0 END) AS BIGINT) AS like_count, CAST(sum(CASE WHEN feedback_type = 'dislike' THEN 1 ELSE 0 END) AS BIGINT) AS dislike_count, CAST(sum(CASE WHEN feedback_type = 'correction' THEN 1 ELSE 0 END) AS BIGINT) AS correction_count FROM fx_feedback GROUP BY 1)"
_QUALITY = f"""q0 AS (SELECT c.chunk_id, c.kb_id, c.is_active, CAST(c.hit_count AS DOUBLE) AS h, coalesce(like_count, 0) AS like_count, coalesce(dislike_count, 0) AS dislike_count, coalesce(correction_count, 0) AS correction_count,
 date_diff('day', c.created_at, TIMESTAMP '{AS_OF}') AS days FROM fx_chunks c LEFT JOIN fb ON fb.chunk_id = c.chunk_id),
quality AS (SELECT chunk_id, kb_id, is_active, like_count, dislike_count, correction_count, round(greatest(0.0, least(1.0, CAST(0.4 AS DOUBLE) * least(h / 20.0, 1.0) + CAST(0.3 AS DOUBLE) * CASE WHEN like_count + dislike_count > 0 THEN CAST(like_count AS DOUBLE) / (like_count + dislike_count) ELSE 0.5 END
 - CAST(0.2 AS DOUBLE) * least(CAST(correction_count AS DOUBLE) / greatest(h, 1), 1.0) + CAST(0.1 AS DOUBLE) * greatest(0.0, 1 - days / 365.0))), 4) AS quality_score FROM q0),
reviewed AS (SELECT *, quality_score < 0.25 OR dislike_count >= 3 AS needs_review FROM quality)"""
_GATE = "gate AS (SELECT doc_id % 500 AS document_id, n_chars AS char_count, CASE WHEN doc_id % 11 = 0 THEN 'duplicate' WHEN doc_id % 5 = 0 THEN 'conflict' ELSE 'allow' END AS gate_status FROM documents)"
_N = "CAST(sum(CASE WHEN {0} THEN 1 ELSE 0 END) AS BIGINT)"
_COLD = f"created_at <= TIMESTAMP '{AS_OF}' - to_days(90)"


def _n(condition: str) -> str:
    return _N.format(condition)


SQL = {
    "fl01_active_chunks": with_views("SELECT chunk_id, kb_id, hit_count FROM fx_chunks WHERE kb_id = 'src3' AND is_active"),
    "fl05_cold_chunks": with_views(f"SELECT chunk_id, kb_id, created_at FROM fx_chunks WHERE hit_count = 0 AND {_COLD}"),
    "fl06_stuck_documents": with_views(f"SELECT document_id, kb_id, filename FROM fx_documents WHERE status = 'processing' AND created_at < TIMESTAMP '{AS_OF}' - to_minutes(3)"),
    "ag01_hit_distribution": with_views("SELECT c.kb_id, b.bucket, " + _n("CASE b.bucket WHEN '0' THEN hit_count <= 0 WHEN '1-5' THEN hit_count BETWEEN 1 AND 5 WHEN '6-20' THEN hit_count BETWEEN 6 AND 20 ELSE hit_count > 20 END") + " AS n FROM fx_chunks c, (SELECT '0' AS bucket UNION ALL SELECT '1-5' UNION ALL SELECT '6-20' UNION ALL SELECT '>20') b GROUP BY 1, 2"),
    "ag02_kb_stats": with_views("SELECT d.kb_id, d.n AS n_documents, c.n AS n_chunks, c.h AS hits FROM (SELECT kb_id, count(*) AS n FROM fx_documents GROUP BY 1) d JOIN (SELECT kb_id, count(*) AS n, CAST(sum(hit_count) AS BIGINT) AS h FROM fx_chunks GROUP BY 1) c ON c.kb_id = d.kb_id"),
    "ag03_stats_overview": with_views("SELECT d.kb_id, count(DISTINCT d.document_id) AS n_documents, count(DISTINCT c.chunk_id) AS n_chunks, (SELECT count(*) FROM fx_documents) AS total_documents, (SELECT count(*) FROM fx_chunks) AS total_chunks FROM fx_documents d LEFT JOIN fx_chunks c ON c.document_id = d.document_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8"),
    "ag04_kb_summary": with_views("SELECT d.kb_id, d.n AS n_documents, coalesce(m.c, 0) AS n_conversations, coalesce(m.n, 0) AS n_messages, coalesce(t.n, 0) AS n_tags, coalesce(h.n, 0) AS hits FROM (SELECT kb_id, count(*) AS n FROM fx_documents GROUP BY 1) d LEFT JOIN (SELECT kb_id, count(DISTINCT conversation_id) AS c, count(*) AS n FROM fx_messages GROUP BY 1) m ON m.kb_id = d.kb_id LEFT JOIN (SELECT source AS kb_id, count(DISTINCT doc_id % 7) AS n FROM documents GROUP BY 1) t ON t.kb_id = d.kb_id LEFT JOIN (SELECT kb_id, CAST(sum(hit_count) AS BIGINT) AS n FROM fx_chunks GROUP BY 1) h ON h.kb_id = d.kb_id"),
    "ag05_cite_counts": with_views("SELECT chunk_id, count(*) AS n_cites FROM fx_sources GROUP BY 1"),
    "ag06_activity_heatmap": with_views(f"SELECT CAST(isodow(created_at) - 1 AS BIGINT) AS weekday, CAST(hour(created_at) AS BIGINT) AS hour, count(*) AS n FROM fx_messages WHERE created_at >= TIMESTAMP '{AS_OF_MESSAGES}' - to_days(30) AND created_at <= TIMESTAMP '{AS_OF_MESSAGES}' GROUP BY 1, 2"),
    "ag07_hit_trend": with_views(f"SELECT CAST(c.day AS VARCHAR) AS day, count(m.message_id) AS n FROM (SELECT CAST(TIMESTAMP '{AS_OF_MESSAGES}' - to_days(CAST(i AS INTEGER)) AS DATE) AS day FROM range(7) t(i)) c LEFT JOIN fx_messages m ON CAST(m.created_at AS DATE) = c.day AND m.role = 'assistant' AND m.sources IS NOT NULL GROUP BY c.day"),
    "ag08_cold_knowledge": with_views(f"SELECT kb_id, {_n('hit_count = 0 AND ' + _COLD)} AS cold_old, {_n('hit_count = 0')} AS cold_total FROM fx_chunks GROUP BY ROLLUP (kb_id)"),
    "ag09_rag_sankey": with_views("""SELECT kb_id, source, target, greatest(sum(value), CAST(0.1 AS DOUBLE)) AS value FROM (SELECT kb_id, concat('q', question_id) AS source, concat('c', chunk_id) AS target, CAST(1 AS DOUBLE) AS value FROM flows WHERE question_id IS NOT NULL UNION ALL SELECT kb_id, concat('c', chunk_id), concat('a', message_id), CAST(score AS DOUBLE) FROM flows) x GROUP BY 1, 2, 3""",
        "recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kb_id ORDER BY created_at DESC, message_id DESC) AS rn FROM fx_messages WHERE role = 'assistant' AND sources IS NOT NULL) r WHERE rn <= 15)",
        "flows AS (SELECT r.kb_id, r.message_id, s.chunk_id, s.score, (SELECT max(u.message_id) FROM fx_messages u WHERE u.conversation_id = r.conversation_id AND u.role = 'user' AND u.created_at < r.created_at) AS question_id FROM recent r JOIN fx_sources s ON s.message_id = r.message_id)"),
    "ag10_suggestion_status_counts": with_views("SELECT kb_id, " + ", ".join(f"{_n(f'status = {chr(39)}{s}{chr(39)}')} AS {s}" for s in ("pending", "approved", "dismissed", "executed", "verified")) + " FROM fx_suggestions GROUP BY 1"),
    "ag11_kb_health": with_views("SELECT b.*, CASE WHEN attention_score = 0 THEN 'healthy' WHEN attention_score < 10 THEN 'attention' ELSE 'critical' END AS level FROM b", _COUNTS, _QUALITY,
        f"b AS (SELECT c.kb_id, c.total_chunks, c.active_chunks, c.cold, coalesce(g.n, 0) AS open_gaps, coalesce(f.n, 0) AS pending_conflicts, r.n AS review, c.cold + coalesce(g.n, 0) + coalesce(f.n, 0) + r.n AS attention_score FROM (SELECT kb_id, count(*) AS total_chunks, {_n('is_active')} AS active_chunks, {_n('hit_count = 0 AND ' + _COLD)} AS cold FROM fx_chunks GROUP BY 1) c LEFT JOIN (SELECT kb_id, count(*) AS n FROM fx_messages WHERE role = 'user' AND message_id % 4 IN (0, 1) GROUP BY 1) g ON g.kb_id = c.kb_id LEFT JOIN (SELECT source AS kb_id, count(*) AS n FROM documents WHERE doc_id % 9 = 0 AND doc_id % 2 = 0 GROUP BY 1) f ON f.kb_id = c.kb_id JOIN (SELECT kb_id, {_n('needs_review')} AS n FROM reviewed GROUP BY 1) r ON r.kb_id = c.kb_id)"),
    "ag12_document_rollup": f"WITH {_GATE} SELECT document_id, {_n(chr(103) + 'ate_status = ' + chr(39) + 'allow' + chr(39))} AS chunk_count, CAST(sum(CASE WHEN gate_status = 'allow' THEN char_count ELSE 0 END) AS BIGINT) AS char_count, {_n('gate_status = ' + chr(39) + 'duplicate' + chr(39))} AS duplicate_count, {_n('gate_status = ' + chr(39) + 'conflict' + chr(39))} AS conflict_count, 'completed' AS status FROM gate GROUP BY 1",
    "ag13_feedback_counts": with_views("SELECT * FROM fb", _COUNTS),
    "ag13b_feedback_by_message": with_views(f"SELECT chunk_id, {_n('message_id % 3 = 0')} AS like_count, {_n('message_id % 3 = 1')} AS dislike_count, {_n('message_id % 3 = 2')} AS correction_count FROM fx_sources GROUP BY 1"),
    "ag14_hit_counts": with_views("SELECT c.chunk_id, c.kb_id, c.hit_count + coalesce(s.n, 0) AS hit_count FROM fx_chunks c LEFT JOIN (SELECT chunk_id, count(*) AS n FROM fx_sources GROUP BY 1) s ON s.chunk_id = c.chunk_id"),
    "ag15_recalculate_quality": with_views("SELECT chunk_id, quality_score, needs_review, like_count, dislike_count, correction_count FROM reviewed", _COUNTS, _QUALITY),
    "ag22_gate_stats": f"WITH {_GATE} SELECT document_id, " + ", ".join(f"{_n(f'gate_status = {chr(39)}{s}{chr(39)}')} AS {n}" for s, n in (("allow", "allow"), ("duplicate", "duplicate"), ("conflict", "conflict"))) + " FROM gate GROUP BY 1",
    "jn04_messages_by_kb": with_views("SELECT kb_id, role, count(*) AS n, count(DISTINCT conversation_id) AS n_conversations FROM fx_messages GROUP BY 1, 2"),
    "jn05_previous_user_message": with_views("SELECT a.message_id, u.message_id AS question_id, md5(u.content) AS question_md5 FROM (SELECT a.message_id, (SELECT max(u.message_id) FROM fx_messages u WHERE u.conversation_id = a.conversation_id AND u.role = 'user' AND u.created_at < a.created_at) AS qid FROM fx_messages a WHERE role = 'assistant') a LEFT JOIN fx_messages u ON u.message_id = a.qid"),
    "jn06_immediately_previous_user": with_views("SELECT message_id, CASE WHEN r = 'user' THEN i END AS question_id, CASE WHEN r = 'user' THEN md5(c) END AS question_md5 FROM (SELECT message_id, role, lag(role) OVER w AS r, lag(message_id) OVER w AS i, lag(content) OVER w AS c FROM fx_messages WINDOW w AS (PARTITION BY conversation_id ORDER BY created_at, message_id)) x WHERE role = 'assistant'"),
    "wn07_top_chunks": with_views("SELECT * FROM (SELECT kb_id, chunk_id, hit_count, row_number() OVER (PARTITION BY kb_id ORDER BY hit_count DESC, chunk_id) AS rank FROM fx_chunks WHERE hit_count > 0) x WHERE rank <= 10"),
    "wn07b_cite_vs_hit": with_views("SELECT c.chunk_id, substr(c.content, 1, 24) AS label, c.hit_count, coalesce(s.n, 0) AS n_cites FROM fx_chunks c LEFT JOIN (SELECT chunk_id, count(*) AS n FROM fx_sources GROUP BY 1) s ON s.chunk_id = c.chunk_id WHERE hit_count > 0 ORDER BY c.hit_count DESC, c.created_at DESC, c.chunk_id LIMIT 10"),
    "wn08_low_quality_top": with_views("SELECT * FROM (SELECT kb_id, chunk_id, quality_score, row_number() OVER (PARTITION BY kb_id ORDER BY quality_score, chunk_id) AS rank FROM reviewed WHERE needs_review) x WHERE rank <= 20", _COUNTS, _QUALITY),
    "wn10_conversation_title": with_views("SELECT conversation_id, substr(trim(translate(content, chr(10) || chr(13), '  ')), 1, 30) AS title FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, message_id) AS rn FROM fx_messages WHERE role = 'user') x WHERE rn = 1"),
    "wn11_compress_history": with_views("""SELECT conversation_id, n_older, coalesce(summary, '') AS summary, recent, round(greatest(0.0, 1 - CAST(length(coalesce(summary, '')) + length(recent) AS DOUBLE) / greatest(total, 1)), 4) AS savings_ratio FROM (SELECT conversation_id, total, n_older, CASE WHEN length(s) > 600 THEN concat(substr(s, 1, 600), '…') ELSE s END AS summary, recent FROM agg) y""",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, message_id DESC) AS rn, count(*) OVER (PARTITION BY conversation_id) AS n FROM fx_messages)",
        "agg AS (SELECT conversation_id, CAST(sum(length(content)) AS BIGINT) AS total, CAST(sum(CASE WHEN rn > 4 THEN 1 ELSE 0 END) AS BIGINT) AS n_older, string_agg(CASE WHEN rn > 4 THEN concat(role, ': ', substr(replace(content, chr(10), ' '), 1, CASE WHEN n - 4 > 8 THEN 50 ELSE 80 END)) END, chr(10) ORDER BY rn DESC) AS s, string_agg(CASE WHEN rn <= 4 THEN concat(role, ': ', content) END, chr(10) ORDER BY rn DESC) AS recent FROM ranked GROUP BY 1)"),
    "wn13_metric_trend": "SELECT o_orderkey AS run_id, CAST(o_custkey % 100 / 100.0 AS DOUBLE) AS value FROM orders WHERE o_custkey % 2 = 1 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20",
    "wn14_recent_turn": with_views("SELECT conversation_id, max(CASE WHEN role = 'user' THEN md5(content) END) AS user_md5, max(CASE WHEN role = 'assistant' THEN md5(content) END) AS assistant_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id, role ORDER BY created_at DESC, message_id DESC) AS rr FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, message_id DESC) AS rn FROM fx_messages) x WHERE rn <= 2) y WHERE rr = 1 GROUP BY 1"),
}
QUERIES = {k: v for k, v in globals().items() if k[:2] in ("fl", "ag", "jn", "wn") and callable(v)}
