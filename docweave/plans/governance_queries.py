"""Queries over governance, queues, joins and dataset jobs, with their DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators import dataset as D
from docweave.operators import governance as G
from docweave.operators import stats, vectors
from docweave.plans import more_sql as M
from docweave.sources import views as V
from docweave.sources.views import AS_OF, with_views


def _quality(spark, d):
    return stats.recalculate_quality(V.chunks(spark, d, content=False), stats.feedback_counts(V.feedback(spark, d)), AS_OF)


def _suggestions(spark, d):
    return V.suggestions(spark, d).withColumn("chunk_ids", F.array(F.expr("suggestion_id div 15"), F.expr("suggestion_id div 22"), F.lit(-1).cast("long")))


def _tags(spark, d):
    bridge = V.table(spark, d, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("document_id"), F.explode(F.array(F.col("doc_id") % 5, F.col("doc_id") % 4)).alias("tag_id"))
    tags = V.table(spark, d, "nation").selectExpr("cast(n_nationkey as bigint) as tag_id", "n_name as name")
    return bridge, tags


def jn01_chunk_refs(spark, d):
    ids = _suggestions(spark, d).select(F.explode("chunk_ids").alias("chunk_id"))
    return G.chunk_refs(ids, V.chunks(spark, d, counted=False), V.documents(spark, d))


def jn02_explode_refs(spark, d):
    s = _suggestions(spark, d)
    refs = G.chunk_refs(s.select(F.explode("chunk_ids").alias("chunk_id")), V.chunks(spark, d, counted=False), V.documents(spark, d))
    return G.explode_refs(s, refs).select("suggestion_id", F.array_join(F.transform("refs", lambda r: r["filename"]), ",").alias("files"))


def jn03_tag_map(spark, d):
    bridge, tags = _tags(spark, d)
    return G.tag_map(V.documents(spark, d), bridge, tags).select("document_id", F.array_join("tags", ",").alias("tags"))


def jn07_missing_relevant(spark, d):
    return D.missing_relevant_chunks(V.samples(spark, d), V.chunks(spark, d, content=False).where("chunk_id % 2 = 0"))


def jn07b_backfill_needed(spark, d):
    return D.backfill_needed(V.chunks(spark, d, content=False), V.relations(spark, d).where("chunk_id % 3 = 0"))


def _uuid(key: str) -> str:
    m = f"md5(cast({key} as string))"
    return "concat(" + ", '-', ".join(f"substr({m}, {at}, {n})" for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + ")"


def jn09_resolve_kb_id(spark, d):
    """Ids in the form of a UUID, and references of none to all of their characters, some with blanks around, some of no id."""
    kbs = V.table(spark, d, "customer").selectExpr(f"{_uuid('c_custkey')} as kb_id")
    refs = V.table(spark, d, "orders").selectExpr(f"concat(if(o_orderkey % 5 = 0, '  ', ''), if(o_orderkey % 11 = 0, 'x', ''), substr({_uuid('o_custkey')}, 1, cast(o_orderkey % 37 as int)), if(o_orderkey % 3 = 0, ' ', '')) as ref")
    return G.resolve_kb_id(refs, kbs)


#: The nine tables that hold a kb id: name, its column, the table and key that stand for it.
KB_TABLES = [
    ("knowledge_gaps", "kb_id", "events", "event_id"), ("conversations", "knowledge_base_id", "conversations", "conv_id"), ("documents", "knowledge_base_id", "documents", "doc_id"),
    ("chunks", "knowledge_base_id", "documents", "doc_id * 3"), ("kg_relations", "knowledge_base_id", "lineitem", "l_orderkey"), ("knowledge_conflicts", "knowledge_base_id", "labels", "doc_id"),
    ("tags", "knowledge_base_id", "nation", "n_nationkey"), ("chunk_feedback", "kb_id", "events", "user_id"), ("kb_folder_watches", "knowledge_base_id", "supplier", "s_suppkey"),
]


def jn09b_rewrite_kb_ids(spark, d):
    """Beginnings of ids become full ids in all tables that hold one; rows by table and id afterwards."""
    kbs = V.table(spark, d, "customer").selectExpr(f"{_uuid('c_custkey')} as kb_id")
    tables = {name: (V.table(spark, d, t).selectExpr(f"substr({_uuid(f'1 + ({key}) % 100')}, 1, cast(1 + ({key}) % 36 as int)) as {column}"), column) for name, column, t, key in KB_TABLES}
    done = G.rewrite_kb_ids(tables, kbs)
    return reduce(DataFrame.unionByName, [done[name].groupBy(F.col(column).alias("kb_id")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "kb_id", "n") for name, column, _, _ in KB_TABLES])


def jn13_duplicate_open_rows(spark, d):
    rows = V.messages(spark, d).where("role = 'user'").selectExpr("kb_id", "content as query", "message_id")
    stored = V.messages(spark, d).where("role = 'user' and message_id % 3 = 0").selectExpr("kb_id", "content as query", "case when message_id % 2 = 0 then 'pending' else 'resolved' end as status")
    return G.new_only(rows, stored, ["kb_id", "query"], ["pending"])


def fl08_filter_queue(spark, d):
    return G.filter_queue(V.suggestions(spark, d), "pending", "duplicate", limit=25, offset=10).select("suggestion_id", "kb_id", "total")


def fl09_rel_overlap(spark, d):
    """Question and content of CJK characters, made from digits of the data."""
    from docweave.operators.search import rel_overlap_ok

    cjk = lambda c: F.translate(c.cast("string"), "0123456789", "零一二三四五六七八九")
    o = V.table(spark, d, "orders").select("o_orderkey", cjk(F.col("o_orderkey") * 7 + F.col("o_custkey")).alias("q"), cjk(F.col("o_custkey") * 1009).alias("c"))
    return o.select("o_orderkey", rel_overlap_ok(F.col("q"), F.col("c")).alias("ok"))


def st01_scan_suggestions(spark, d):
    e = V.table(spark, d, "embeddings").selectExpr("vec_id as chunk_id", "label as kb_id", "embedding", f"timestampadd(DAY, -cast(vec_id % 300 as int), TIMESTAMP_NTZ '{AS_OF}') as created_at")
    pairs = vectors.near_duplicate_pairs(e, most=0.8).withColumn("kb_id", F.col("kb_id").cast("string"))
    found = G.scan_suggestions(V.chunks(spark, d, first=G.PREVIEW), V.documents(spark, d), _quality(spark, d), pairs, AS_OF)
    return found.withColumn("chunk_ids", F.array_join("chunk_ids", ",")).select("kb_id", "type", "chunk_ids", "title", "action", "severity", F.md5("preview").alias("preview_md5"))


def st02_new_suggestions(spark, d):
    s = V.suggestions(spark, d).selectExpr("kb_id", "suggestion_type as type", "array(suggestion_id % 50) as chunk_ids", "status", "suggestion_id")
    fresh = G.new_suggestions(s.select("kb_id", "type", "chunk_ids", "suggestion_id"), s.where("suggestion_id % 3 = 0"))
    return fresh.select("kb_id", "type", F.element_at("chunk_ids", 1).alias("chunk"), "suggestion_id")


def st03_replaced_chunks(spark, d):
    c = V.chunks(spark, d, content=False).select("chunk_id", "document_id", "kb_id", "char_count")
    changed = V.documents(spark, d).where("document_id % 10 = 0")
    fresh = changed.select((F.col("document_id") + 1_000_000).alias("chunk_id"), "document_id", "kb_id", (F.col("char_count") + 1).alias("char_count"))
    return G.replaced_chunks(c, changed, fresh)


def _events(spark, d):
    step = "case l_linenumber % 5 when 0 then 'approve' when 1 then 'approve' when 2 then 'execute' when 3 then 'verify' else case when l_partkey % 2 = 0 then 'rollback' else 'dismiss' end end"
    return V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("suggestion_id"), "l_linenumber").agg(F.min("l_partkey").alias("l_partkey")).selectExpr("suggestion_id", "l_linenumber as seq", f"{step} as event")


def qu05_apply_transitions(spark, d):
    out = G.apply_transitions(V.suggestions(spark, d), _events(spark, d))
    return out.select("suggestion_id", "status", F.array_join("audit", ";").alias("audit"))


def _executed(spark, d):
    return V.suggestions(spark, d).where("status = 'executed'").selectExpr("case suggestion_type when 'duplicate' then 'merge' when 'cold_stale' then 'archive' when 'low_quality' then 'deactivate' when 'high_quality_zero_hit' then 'boost_faq' else 'archive' end as action", "array(suggestion_id div 15) as chunk_ids")


def qu06_apply_actions(spark, d):
    chunks, quality = G.apply_actions(V.chunks(spark, d, content=False), _quality(spark, d), _executed(spark, d))
    return chunks.select("chunk_id", "is_active").join(quality.select("chunk_id", "quality_score", "needs_review"), "chunk_id")


def _conflicts(spark, d):
    docs = V.table(spark, d, "documents").where("doc_id % 4 = 0")
    conflicts = docs.selectExpr("doc_id as conflict_id", "source as kb_id", "doc_id + 1 as existing_chunk_id", "text as new_content", "case when doc_id % 3 = 0 then 'dismissed' else 'pending' end as status", "case when doc_id % 8 = 0 then doc_id end as source_document_id")
    decisions = docs.selectExpr("doc_id as conflict_id", "case doc_id % 5 when 0 then 'resolved_keep_new' when 1 then 'resolved_keep_old' when 2 then 'dismissed' when 3 then 'nonsense' else 'resolved_keep_new' end as decision")
    return G.resolve_conflicts(conflicts, decisions, V.chunks(spark, d, content=False))


def qu07_resolve_conflicts(spark, d):
    return _conflicts(spark, d)[0].select("conflict_id", "status", "resolved_chunk_id")


def qu07b_conflict_chunks(spark, d):
    return _conflicts(spark, d)[1].select("chunk_id", "document_id", "kb_id", "char_count")


def qu08_toggle_documents(spark, d):
    changes = V.documents(spark, d).where("document_id % 6 = 0").selectExpr("document_id", "document_id % 12 = 0 as active")
    docs, chunks = G.toggle_documents(V.documents(spark, d).withColumn("is_active", F.lit(True)), V.chunks(spark, d, content=False), changes)
    (left,) = G.delete_documents(V.documents(spark, d).where("document_id % 9 = 0"), chunks)
    return left.select("chunk_id", "is_active").join(docs.select(F.col("document_id").alias("chunk_id"), F.col("is_active").alias("document_active")), "chunk_id")


def qu09_consistency(spark, d):
    cjk = lambda c: F.translate(c.cast("string"), "0123456789", "零一二三四五六七八九")
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("pair_id"), F.when(F.col("o_orderkey") % 7 != 0, cjk(F.col("o_custkey"))).alias("answer_a"), F.when(F.col("o_orderkey") % 5 == 0, cjk(F.col("o_custkey"))).otherwise(cjk(F.col("o_orderkey"))).alias("answer_b"), cjk(F.col("o_orderkey") % 100).alias("answer_param"))
    return G.consistency_shortcuts(o)


def _turns(spark, d):
    m = V.messages(spark, d).where("role = 'user'")
    return m.selectExpr("kb_id", "substr(content, 1, 20) as query", "content as message", "case when message_id % 6 = 0 then '暂无相关信息' else 'ok' end as answer", "case when message_id % 11 = 0 then 'fixed' end as correction", "array(named_struct('chunk_id', message_id % 9, 'score', 0.5D)) as sources", "case when message_id % 4 = 0 then null else cast(message_id % 10 as double) / 10 end as max_score", "message_id % 8 = 0 as weak_hit", "message_id % 3 <> 0 as sufficient", "message_id % 13 = 0 as refused")


def qu01_classify_gap(spark, d):
    kind = G.classify_gap(F.col("correction"), F.col("message"), F.col("max_score"), F.col("weak_hit"))
    return _turns(spark, d).groupBy(kind.alias("gap_type"), "kb_id").agg(F.count(F.lit(1)).alias("n"))


def qu02_enqueue_gaps(spark, d):
    stored = V.messages(spark, d).where("role = 'user' and message_id % 5 = 0").selectExpr("kb_id", "substr(content, 1, 20) as query", "'pending' as status")
    return G.enqueue_gaps(_turns(spark, d), stored)


def qu03_feedback_to_gaps(spark, d):
    m = V.messages(spark, d)
    fb = m.where("role = 'assistant'").selectExpr("message_id", "case message_id % 3 when 0 then 'like' when 1 then 'dislike' else 'correction' end as feedback_type")
    q = stats.immediately_previous_user(m).join(m.select("message_id", F.col("content").alias("answer")), "message_id")
    return G.feedback_to_gaps(fb, q).select("message_id", "gap_type", F.md5("query").alias("query_md5"))


def qu04_source_ref(spark, d):
    m = V.messages(spark, d).where("role = 'assistant'")
    ref = F.when(F.col("message_id") % 3 == 0, F.substring("content", 1, 30)).when(F.col("message_id") % 3 == 1, F.concat(F.substring("content", 1, 12), F.lit("zzz"))).otherwise(F.lit("abc"))
    return m.select("message_id", G.source_ref_ok(ref, F.lit(""), F.col("content")).alias("ok"))


def wn09_supporting_chunk(spark, d):
    chunks = V.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey")).selectExpr("l_orderkey * 10 + l_linenumber as chunk_id", "l_orderkey as document_id", "l_linenumber as chunk_index")
    return D.supporting_chunk(chunks)


def wn15_stratified_sample(spark, d):
    s = V.samples(spark, d).select("sample_id", "q_type").distinct()
    return D.stratified_sample(s)


def wn16_kb_selection(spark, d):
    return D.kb_selection(V.chunks(spark, d, content=False)).select("kb_id", "chunk_id", F.col("rn").cast("long").alias("rn"))


def ev12_build_eval_samples(spark, d):
    relations = V.documents(spark, d).selectExpr("kb_id", "document_id as chunk_id", "filename as subject", "status as predicate", "concat('o', cast(document_id % 9 as string)) as object_entity")
    return D.build_eval_samples(V.chunks(spark, d), relations).select("kb_id", "q_type", F.col("n").cast("long").alias("n"), F.md5("question").alias("question_md5"), F.md5("ground_truth").alias("truth_md5"), F.size("relevant").cast("long").alias("n_relevant"))


def _cjk_orders(spark, d):
    """Chunks and questions of CJK characters, one for each digit of the data."""
    cjk = lambda c: F.translate(c.cast("string"), "0123456789", "零一二三四五六七八九")
    orders = V.table(spark, d, "orders")
    chunks = orders.select(F.col("o_orderkey").alias("chunk_id"), (F.col("o_orderkey") % 20).alias("kb_id"), cjk(F.col("o_custkey") * 1009).alias("content"))
    samples = orders.where("o_orderkey % 100 = 0").select(F.col("o_orderkey").alias("sample_id"), (F.col("o_orderkey") % 20).alias("kb_id"), cjk(F.col("o_custkey") * 37).alias("question"), (F.col("o_orderkey") + F.col("o_custkey") % 3).alias("primary_id"))
    return chunks, samples


def jn12_best_chunks(spark, d):
    from docweave.operators.search import best_chunks_for_question

    chunks, samples = _cjk_orders(spark, d)
    return best_chunks_for_question(samples.withColumnRenamed("sample_id", "query_id"), chunks).select("query_id", "chunk_id", "score", "rank")


def ev13_fix_annotations(spark, d):
    chunks, samples = _cjk_orders(spark, d)
    return D.fix_annotations(samples, chunks).select("sample_id", "action", F.coalesce(F.size("relevant"), F.lit(-1)).cast("long").alias("n"))


def sr18_image_dedup(spark, d):
    images = V.table(spark, d, "lineitem").selectExpr("l_orderkey % 100 as doc_id", "l_linenumber as page", "md5(cast(l_partkey % 50 as string)) as hash", "cast(l_quantity as int) + 10 as width", "cast(l_quantity as int) + 12 as height")
    return D.image_dedup(images).select("doc_id", "hash", F.col("n").cast("long").alias("n"))


_FB = "fb AS (SELECT chunk_id, sum(CASE WHEN feedback_type = 'like' THEN 1 ELSE 0 END) AS lk, sum(CASE WHEN feedback_type = 'dislike' THEN 1 ELSE 0 END) AS dl, sum(CASE WHEN feedback_type = 'correction' THEN 1 ELSE 0 END) AS co FROM fx_feedback GROUP BY 1)"
_Q = _FB + f""", q AS (SELECT *, s < 0.25 OR dl >= 3 AS rv FROM (SELECT c.chunk_id, coalesce(dl, 0) AS dl, round(greatest(0.0, least(1.0, CAST(0.4 AS DOUBLE) * least(c.hit_count / 20.0, 1.0) + CAST(0.3 AS DOUBLE) * CASE WHEN lk + dl > 0 THEN CAST(lk AS DOUBLE) / (lk + dl) ELSE 0.5 END
 - CAST(0.2 AS DOUBLE) * least(CAST(coalesce(co, 0) AS DOUBLE) / greatest(c.hit_count, 1), 1.0) + CAST(0.1 AS DOUBLE) * greatest(0.0, 1 - date_diff('day', c.created_at, TIMESTAMP '{AS_OF}') / 365.0))), 4) AS s FROM fx_chunks c LEFT JOIN fb ON fb.chunk_id = c.chunk_id) x)"""
_IDS = "ids AS (SELECT suggestion_id, 0 AS pos, suggestion_id // 15 AS chunk_id FROM fx_suggestions UNION ALL SELECT suggestion_id, 1, suggestion_id // 22 FROM fx_suggestions)"
_CF = "cf AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN 'dismissed' ELSE 'pending' END AS st, CASE doc_id % 5 WHEN 0 THEN 'resolved_keep_new' WHEN 1 THEN 'resolved_keep_old' WHEN 2 THEN 'dismissed' WHEN 3 THEN 'nonsense' ELSE 'resolved_keep_new' END AS de, doc_id + 1 IN (SELECT doc_id FROM documents) AS ex, length(text) AS n FROM documents WHERE doc_id % 4 = 0)"
_DUP = "vec AS (SELECT vec_id AS chunk_id, label AS kb_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), cls AS (SELECT *, min(chunk_id) OVER (PARTITION BY kb_id, e) AS first FROM vec), dup AS (SELECT a.kb_id, a.chunk_id AS a, b.chunk_id AS b FROM cls a JOIN cls b ON a.kb_id = b.kb_id AND a.chunk_id < b.chunk_id AND round(1 - list_cosine_similarity(a.e, b.e), 6) <= 0.8 WHERE (a.first = a.chunk_id AND b.first = b.chunk_id) OR a.chunk_id = b.first)"
SQL = {
    "fl09_rel_overlap": M.REL_OVERLAP,
    "jn12_best_chunks": M.BEST_CHUNKS,
    "ev13_fix_annotations": M.FIXED_ANNOTATIONS,
    "qu01_classify_gap": with_views(*M.GAPS),
    "qu02_enqueue_gaps": with_views(*M.ENQUEUED),
    "qu05_apply_transitions": M.TRANSITIONS.format(suggestions=V.SQL["fx_suggestions"]),
    "qu09_consistency": M.CONSISTENCY,
    "st01_scan_suggestions": with_views(M.SCAN, _Q, _DUP, M.ALIVE),
    "wn15_stratified_sample": with_views("SELECT sample_id, q_type FROM (SELECT *, row_number() OVER (PARTITION BY q_type ORDER BY md5(concat(CAST(sample_id AS VARCHAR), '|42')), sample_id) AS rn, count(*) OVER (PARTITION BY q_type) AS n FROM (SELECT DISTINCT sample_id, q_type FROM fx_samples) s) x WHERE rn <= greatest(1, round(n * CAST(0.2 AS DOUBLE)))"),
    "jn01_chunk_refs": with_views("SELECT DISTINCT c.chunk_id, c.document_id, concat('doc-', c.document_id, '.txt') AS filename, c.chunk_index, c.is_active, substr(c.content, 1, 80) AS preview FROM ids JOIN fx_chunks c ON c.chunk_id = ids.chunk_id", _IDS),
    "jn02_explode_refs": with_views("SELECT suggestion_id, string_agg(concat('doc-', chunk_id, '.txt'), ',' ORDER BY pos) AS files FROM ids WHERE chunk_id IN (SELECT doc_id FROM documents) GROUP BY 1", _IDS),
    "jn03_tag_map": "SELECT d.doc_id AS document_id, coalesce(t.tags, '') AS tags FROM documents d LEFT JOIN (SELECT doc_id, string_agg(n_name, ',' ORDER BY n_name) AS tags FROM (SELECT DISTINCT doc_id, n_name FROM (SELECT doc_id, doc_id % 5 AS t FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, doc_id % 4 FROM documents WHERE doc_id % 3 <> 0) b JOIN nation n ON n.n_nationkey = b.t) u GROUP BY 1) t ON t.doc_id = d.doc_id",
    "jn07_missing_relevant": with_views("SELECT sample_id, relevant_id FROM fx_samples WHERE relevant_id % 2 = 1 OR relevant_id NOT IN (SELECT doc_id FROM documents)"),
    "jn07b_backfill_needed": with_views("SELECT chunk_id, kb_id FROM fx_chunks WHERE is_active AND chunk_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 3 = 0)"),
    "jn09_resolve_kb_id": f"""WITH k AS (SELECT {_uuid("c_custkey")} AS kb_id FROM customer), r AS (SELECT DISTINCT concat(if(o_orderkey % 5 = 0, '  ', ''), if(o_orderkey % 11 = 0, 'x', ''), substr({_uuid("o_custkey")}, 1, CAST(o_orderkey % 37 AS INTEGER)), if(o_orderkey % 3 = 0, ' ', '')) AS ref FROM orders),
        m AS (SELECT r.ref, count(k.kb_id) AS n, min(k.kb_id) AS only_kb FROM r LEFT JOIN k ON trim(r.ref) <> '' AND starts_with(k.kb_id, trim(r.ref)) GROUP BY 1)
        SELECT ref, CASE WHEN n = 1 THEN only_kb END AS kb_id, CASE WHEN n = 1 THEN NULL WHEN trim(ref) = '' THEN 'blank' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS problem FROM m""",
    "jn09b_rewrite_kb_ids": f"WITH k AS (SELECT {_uuid('c_custkey')} AS kb_id FROM customer), t AS ("
        + " UNION ALL ".join(f"SELECT '{name}' AS part, substr({_uuid(f'1 + ({key}) % 100')}, 1, CAST(1 + ({key}) % 36 AS INTEGER)) AS ref FROM {t}" for name, _, t, key in KB_TABLES)
        + "), r AS (SELECT DISTINCT ref FROM t), m AS (SELECT r.ref, CASE WHEN count(*) = 1 THEN min(k.kb_id) END AS kb FROM r JOIN k ON starts_with(k.kb_id, r.ref) GROUP BY 1) SELECT part, coalesce(m.kb, t.ref) AS kb_id, count(*) AS n FROM t LEFT JOIN m ON m.ref = t.ref GROUP BY 1, 2",
    "jn13_duplicate_open_rows": with_views("SELECT kb_id, content AS query, min(message_id) AS message_id FROM fx_messages m WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM fx_messages o WHERE o.role = 'user' AND o.message_id % 6 = 0 AND o.kb_id = m.kb_id AND o.content = m.content) GROUP BY 1, 2"),
    "fl08_filter_queue": with_views("SELECT suggestion_id, kb_id, count(*) OVER () AS total FROM fx_suggestions WHERE status = 'pending' AND suggestion_type = 'duplicate' ORDER BY created_at DESC, suggestion_id DESC LIMIT 25 OFFSET 10"),
    "st02_new_suggestions": with_views("SELECT kb_id, suggestion_type AS type, suggestion_id % 50 AS chunk, min(suggestion_id) AS suggestion_id FROM fx_suggestions s WHERE NOT EXISTS (SELECT 1 FROM fx_suggestions p WHERE p.suggestion_id % 3 = 0 AND p.status = 'pending' AND p.kb_id = s.kb_id AND p.suggestion_type = s.suggestion_type AND p.suggestion_id % 50 = s.suggestion_id % 50) GROUP BY 1, 2, 3"),
    "st03_replaced_chunks": "SELECT CASE WHEN doc_id % 10 = 0 THEN doc_id + 1000000 ELSE doc_id END AS chunk_id, doc_id AS document_id, source AS kb_id, CASE WHEN doc_id % 10 = 0 THEN n_chars + 1 ELSE n_chars END AS char_count FROM documents",
    "qu06_apply_actions": with_views("SELECT c.chunk_id, c.is_active AND NOT coalesce(o.dead, false) AS is_active, CASE WHEN o.up > 0 THEN round(least(1.0, s + CAST(0.15 AS DOUBLE) * o.up), 4) ELSE s END AS quality_score, rv AND NOT coalesce(o.up > 0, false) AS needs_review FROM fx_chunks c JOIN q ON q.chunk_id = c.chunk_id LEFT JOIN o ON o.chunk_id = c.chunk_id", _Q,
        "o AS (SELECT suggestion_id // 15 AS chunk_id, bool_or(suggestion_type IN ('cold_stale', 'low_quality', 'archive_candidate')) AS dead, sum(CASE WHEN suggestion_type = 'high_quality_zero_hit' THEN 1 ELSE 0 END) AS up FROM fx_suggestions WHERE status = 'executed' GROUP BY 1)"),
    "qu07_resolve_conflicts": f"WITH {_CF} SELECT doc_id AS conflict_id, CASE WHEN st = 'pending' AND de <> 'nonsense' AND (de <> 'resolved_keep_new' OR ex) THEN de ELSE st END AS status, CASE WHEN st = 'pending' AND de = 'resolved_keep_new' AND ex THEN sha256(concat('conflict-', CAST(doc_id AS VARCHAR))) END AS resolved_chunk_id FROM cf",
    "qu07b_conflict_chunks": f"WITH {_CF} SELECT sha256(concat('conflict-', CAST(doc_id AS VARCHAR))) AS chunk_id, CASE WHEN doc_id % 8 = 0 THEN doc_id ELSE doc_id + 1 END AS document_id, source AS kb_id, n AS char_count FROM cf WHERE st = 'pending' AND de = 'resolved_keep_new' AND ex",
    "qu08_toggle_documents": with_views("SELECT chunk_id, CASE WHEN chunk_id % 6 = 0 THEN chunk_id % 12 = 0 ELSE is_active END AS is_active, CASE WHEN chunk_id % 6 = 0 THEN chunk_id % 12 = 0 ELSE true END AS document_active FROM fx_chunks WHERE chunk_id % 9 <> 0"),
    "qu03_feedback_to_gaps": with_views("SELECT message_id, CASE WHEN message_id % 3 = 1 THEN 'RETRIEVAL_MISS' ELSE 'USER_CORRECTION' END AS gap_type, md5(CASE WHEN r = 'user' THEN c ELSE substr(content, 1, 200) END) AS query_md5 FROM (SELECT *, lag(role) OVER w AS r, lag(content) OVER w AS c FROM fx_messages WINDOW w AS (PARTITION BY conversation_id ORDER BY created_at, message_id)) x WHERE role = 'assistant' AND message_id % 3 <> 0"),
    "qu04_source_ref": with_views("SELECT message_id, CASE WHEN message_id % 3 = 2 THEN false WHEN message_id % 3 = 0 THEN length(trim(substr(content, 1, 30))) >= 4 ELSE length(trim(concat(substr(content, 1, 12), 'zzz'))) >= 8 AND contains(content, substr(trim(concat(substr(content, 1, 12), 'zzz')), 1, 12)) END AS ok FROM fx_messages WHERE role = 'assistant'"),
    "wn09_supporting_chunk": "WITH c AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS doc, l_linenumber AS ix FROM lineitem), n AS (SELECT a.id, b.id AS other, abs(a.ix - b.ix) <= 2 AS near, row_number() OVER (PARTITION BY a.id ORDER BY CASE WHEN abs(a.ix - b.ix) <= 2 THEN 0 ELSE 1 END, b.ix) AS rn FROM c a JOIN c b ON a.doc = b.doc AND a.id <> b.id) SELECT c.id AS chunk_id, n.other AS supporting_id FROM c LEFT JOIN n ON n.id = c.id AND n.rn = 1",
    "wn16_kb_selection": with_views("SELECT kb_id, chunk_id, rn FROM (SELECT kb_id, chunk_id, row_number() OVER (PARTITION BY kb_id ORDER BY hit_count DESC, chunk_index, chunk_id) AS rn FROM fx_chunks WHERE is_active AND kb_id IN (SELECT kb_id FROM fx_chunks GROUP BY 1 HAVING count(*) >= 30 ORDER BY count(*) DESC, kb_id LIMIT 5)) x WHERE rn <= 80"),
    "sr18_image_dedup": "SELECT doc_id, hash, n FROM (SELECT doc_id, hash, row_number() OVER (PARTITION BY doc_id ORDER BY page, hash) AS n FROM (SELECT l_orderkey % 100 AS doc_id, md5(CAST(l_partkey % 50 AS VARCHAR)) AS hash, min(l_linenumber) AS page FROM lineitem WHERE CAST(floor(l_quantity) AS INTEGER) + 10 >= 32 AND CAST(floor(l_quantity) AS INTEGER) + 12 >= 32 GROUP BY 1, 2) x) y WHERE n <= 30",
}
QUERIES = {k: v for k, v in globals().items() if k[:2] in ("jn", "fl", "st", "qu", "wn", "ev", "sr") and callable(v)}
