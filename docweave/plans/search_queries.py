"""Queries over full-text search, fusion, filters and vectors, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import ann as A
from docweave.operators import ranking as R
from docweave.operators import search as S
from docweave.operators import stats
from docweave.operators import text_index as TI
from docweave.operators import vectors as X
from docweave.operators.common import materialised, shared_folder
from docweave.sources import views as V
from docweave.sources.views import AS_OF, with_views


def _postings(spark, d):
    """The index as a job would find it: written once, read several times."""
    return materialised(S.build_postings(V.chunks(spark, d, counted=False)))


def _bm25(spark, d, every=False):
    q = V.questions(spark, d)
    return S.bm25_search(q.withColumn("kb_id", F.lit(None).cast("string")) if every else q, _postings(spark, d))


def _vectors(spark, d):
    e = V.table(spark, d, "embeddings")
    return e.selectExpr("vec_id as chunk_id", "label as kb_id", "embedding", f"timestampadd(DAY, -cast(vec_id % 300 as int), TIMESTAMP_NTZ '{AS_OF}') as created_at")


def _vector_queries(spark, d):
    return _vectors(spark, d).where("chunk_id % 100 = 0").selectExpr("chunk_id as query_id", "kb_id", "embedding")


def _quality(spark, d):
    return stats.recalculate_quality(V.chunks(spark, d, content=False), stats.feedback_counts(V.feedback(spark, d)), AS_OF)


def _candidates(spark, d):
    """Search results of all kbs with content, document and a model score that some of them have."""
    found = materialised(_bm25(spark, d, True).where("rank <= 10"))
    rows = found.join(V.chunks(spark, d, counted=False).select("chunk_id", "document_id", "content"), "chunk_id").join(V.questions(spark, d).select("query_id", "question"), "query_id")
    return rows.withColumns({"rrf_score": F.round(1 / (60.0 + F.col("rank")), 12), "document_id": F.col("document_id") % 7, "model_score": F.when(F.col("query_id") % 3 != 0, ((F.col("chunk_id") * 13 + F.col("query_id")) % 100) / 200.0)})


def sr01_build_postings(spark, d):
    return S.build_postings(V.chunks(spark, d, counted=False)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def sr02_bm25_search(spark, d):
    return _bm25(spark, d)


def sr02b_bm25_all_kbs(spark, d):
    return _bm25(spark, d, True).where("rank <= 5")


def sr03_vector_topk(spark, d):
    return X.vector_search(_vector_queries(spark, d), _vectors(spark, d), 30).select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


def sr03b_vector_only(spark, d):
    return X.vector_only_search(_vector_queries(spark, d), _vectors(spark, d)).select("query_id", "chunk_id", "rank", "score")


def fl04_vector_threshold(spark, d):
    found = X.vector_search(_vector_queries(spark, d), _vectors(spark, d), 50)
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_kept"))


def sr16_ingest_gate(spark, d):
    new = _vectors(spark, d).where("chunk_id % 10 = 3").withColumn("content", F.when(F.col("chunk_id") % 20 == 3, F.lit("text")).otherwise(F.lit(" ")))
    old = _vectors(spark, d).where("chunk_id % 10 <> 3")
    return X.ingest_gate(new, old, 0.6, 0.75).withColumn("similarity", F.round("similarity", 3))


def sr17_near_duplicate_pairs(spark, d):
    return X.near_duplicate_pairs(_vectors(spark, d), most=0.8).withColumn("similarity", F.round("similarity", 3))


def sr19_weak_hit_probe(spark, d):
    return X.weak_hit_probe(_vector_queries(spark, d), _vectors(spark, d).where("chunk_id % 100 <> 0"))


def jn08_fts_sync_diff(spark, d):
    index = V.chunks(spark, d).where("chunk_id % 5 <> 0").select("chunk_id", F.when(F.col("chunk_id") % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")).alias("content"))
    gone = index.where("chunk_id < 20").select((F.col("chunk_id") + 10_000_000).alias("chunk_id"), "content")
    return S.fts_sync_diff(V.chunks(spark, d), index.unionByName(gone))


def jn08b_incremental_index(spark, d):
    """The index of an older state of the chunks, brought to the present one and then made one segment; the questions' hits in it."""
    path = shared_folder(spark)
    now = V.chunks(spark, d)
    gone = now.where("chunk_id % 50 = 1").withColumn("chunk_id", F.col("chunk_id") + 10_000_000)
    old = now.where("chunk_id % 5 <> 0").withColumn("content", F.when(F.col("chunk_id") % 7 == 0, F.concat("content", F.lit(" an older ending"))).otherwise(F.col("content"))).unionByName(gone)
    TI.refresh_index(old, path)
    TI.refresh_index(now, path)
    TI.compact_index(spark, path)
    return TI.index_search(V.questions(spark, d), path)


def _index(spark, d, cells=32):
    v = _vectors(spark, d)
    centroids = A.train_centroids(v, cells)
    return materialised(A.build_index(v, centroids)), centroids


def sr03c_index_exact(spark, d):
    """The nearest vectors through the cells of an index, with bounds."""
    index, centroids = _index(spark, d)
    found = A.exact_topk(_vector_queries(spark, d), index, centroids, 30)
    return found.withColumn("score", F.round(X.vector_score(F.col("distance")), 4)).where(X.vector_score(F.col("distance")) > 0.15).select("query_id", "chunk_id", "rank", "score")


def sr03d_index_approximate(spark, d):
    """As sr03c, from each query's nearest twenty of thirty-two cells alone."""
    index, centroids = _index(spark, d)
    return A.approximate_topk(_vector_queries(spark, d), index, centroids, 30, probes=20)


def sr05_anchor_search(spark, d):
    q = V.table(spark, d, "benchmark").selectExpr("item_id as query_id", "cast(null as string) as kb_id", "concat('「', substr(text, 1, 30), '」与「', substr(text, 32, 20), '」') as question")
    return S.anchor_search(q, _postings(spark, d))


def wn01_rrf_fuse(spark, d):
    found = _bm25(spark, d, True)
    other = R.ranked(found.withColumn("score", (F.col("chunk_id") * 7919 + F.col("query_id")) % 1009).drop("rank"))
    lists = found.select("query_id", F.lit(0).alias("list_no"), "chunk_id", "rank").unionByName(other.select("query_id", F.lit(1).alias("list_no"), "chunk_id", "rank"))
    return R.rrf_fuse(lists)


def _lists(spark, d):
    found = _bm25(spark, d, True)
    parts = [found.where(c).select("query_id", F.lit(i).alias("list_no"), "chunk_id", "rank", F.lit(s).alias("source")) for i, (c, s) in enumerate((("rank <= 12", "hybrid"), ("chunk_id % 3 = 0", "graph"), ("chunk_id % 5 = 1", "anchor")))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return R.ranked(rows.withColumn("score", -F.col("rank")).drop("rank").withColumn("key", F.struct("query_id", "list_no")), by="key").drop("key", "score")


def wn02_merge_source_lists(spark, d):
    return R.merge_source_lists(_lists(spark, d), 10)


def wn03_merge_with_quota(spark, d):
    return R.merge_with_quota(_lists(spark, d), 6)


def wn04_term_overlap_rerank(spark, d):
    return R.term_overlap_rerank(_candidates(spark, d)).select("query_id", "chunk_id", "score", "rank")


def wn05_blend_quality(spark, d):
    rows = _candidates(spark, d).join(_quality(spark, d).select("chunk_id", "quality_score"), "chunk_id", "left")
    return rows.select("query_id", "chunk_id", R.blend_quality(F.col("rrf_score"), F.coalesce("quality_score", F.lit(0.5))).alias("blended"))


def wn06_rerank_by_score(spark, d):
    raw = F.col("model_score") * 40 - 10
    return R.rerank_by_score(_candidates(spark, d).where("model_score is not null").withColumn("model_raw", raw)).select("query_id", "chunk_id", F.round("model_score", 5).alias("model_score"), "rank")


def fl02_quality_gate(spark, d):
    return R.quality_gate(_candidates(spark, d).select("query_id", "chunk_id", "rank"), _quality(spark, d))


def fl03_post_retrieval_filter(spark, d):
    return R.post_retrieval_filter(_candidates(spark, d), least=0.3).select("query_id", "chunk_id", "rank")


def wn12_pack_context(spark, d):
    return R.pack_context(_candidates(spark, d).where("rank <= 5")).select("query_id", F.length("context").alias("n_chars"), F.md5("context").alias("context_md5"))


_POST = "tok AS (SELECT chunk_id, kb_id, unnest(regexp_extract_all(lower(content), '[0-9a-z_]{2,}')) AS term FROM fx_chunks WHERE is_active), post AS (SELECT kb_id, chunk_id, term, count(*) AS tf FROM tok GROUP BY 1, 2, 3), len AS (SELECT chunk_id, count(*) AS doc_len FROM tok GROUP BY 1), st AS (SELECT count(*) AS n, avg(doc_len) AS avgdl FROM len)"
_BM = _POST + """, qt AS (SELECT DISTINCT query_id, kb_id, lower(term) AS term FROM (SELECT query_id, kb_id, unnest(list_slice(regexp_extract_all(question, '[0-9A-Za-z_]{2,}'), 1, 20)) AS term FROM fx_questions) x),
idf AS (SELECT term, greatest(ln(((SELECT n FROM st) - df + 0.5) / (df + 0.5)), 1e-6) AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY 1) d),
sc AS (SELECT q.query_id, q.kb_id AS qkb, p.kb_id AS pkb, p.chunk_id, round(sum(idf * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * doc_len / (SELECT avgdl FROM st)))), 6) AS score FROM qt q JOIN post p ON p.term = q.term JOIN idf i ON i.term = q.term JOIN len l ON l.chunk_id = p.chunk_id GROUP BY 1, 2, 3, 4),
own AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc WHERE qkb = pkb),
every AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc)"""
_COUNTS = "fb AS (SELECT chunk_id, sum(CASE WHEN feedback_type = 'like' THEN 1 ELSE 0 END) AS like_count, sum(CASE WHEN feedback_type = 'dislike' THEN 1 ELSE 0 END) AS dislike_count, sum(CASE WHEN feedback_type = 'correction' THEN 1 ELSE 0 END) AS correction_count FROM fx_feedback GROUP BY 1)"
_QUALITY = _COUNTS + f""", ql AS (SELECT c.chunk_id, coalesce(dislike_count, 0) AS dislike_count, round(greatest(0.0, least(1.0, CAST(0.4 AS DOUBLE) * least(c.hit_count / 20.0, 1.0) + CAST(0.3 AS DOUBLE) * CASE WHEN like_count + dislike_count > 0 THEN CAST(like_count AS DOUBLE) / (like_count + dislike_count) ELSE 0.5 END
 - CAST(0.2 AS DOUBLE) * least(CAST(coalesce(correction_count, 0) AS DOUBLE) / greatest(c.hit_count, 1), 1.0) + CAST(0.1 AS DOUBLE) * greatest(0.0, 1 - date_diff('day', c.created_at, TIMESTAMP '{AS_OF}') / 365.0))), 4) AS quality_score FROM fx_chunks c LEFT JOIN fb ON fb.chunk_id = c.chunk_id)"""
QUALITY_CTES = _QUALITY
_CAND = _BM + ", cand AS (SELECT e.query_id, e.chunk_id, e.score, e.rank, c.document_id % 7 AS document_id, c.content, q.question, round(1 / (CAST(60 AS DOUBLE) + e.rank), 12) AS rrf_score, CASE WHEN e.query_id % 3 <> 0 THEN CAST((e.chunk_id * 13 + e.query_id) % 100 AS DOUBLE) / 200 END AS model_score FROM every e JOIN fx_chunks c ON c.chunk_id = e.chunk_id JOIN fx_questions q ON q.query_id = e.query_id WHERE e.rank <= 10)"
_VEC = f"v AS (SELECT vec_id AS chunk_id, label AS kb_id, CAST(embedding AS DOUBLE[]) AS e, TIMESTAMP '{AS_OF}' - to_days(CAST(vec_id % 300 AS INTEGER)) AS created_at FROM embeddings)"
_DIST = "round(1 - list_cosine_similarity(a.e, b.e), 6)"
_NEAR = _VEC + f", nn AS (SELECT a.chunk_id AS query_id, b.chunk_id, {_DIST} AS d, row_number() OVER (PARTITION BY a.chunk_id ORDER BY {_DIST}, b.chunk_id) AS rank FROM v a JOIN v b ON a.kb_id = b.kb_id WHERE a.chunk_id % 100 = 0)"
_LISTS = _BM + ", raw AS (SELECT query_id, 0 AS list_no, chunk_id, rank, 'hybrid' AS source FROM every WHERE rank <= 12 UNION ALL SELECT query_id, 1, chunk_id, rank, 'graph' FROM every WHERE rank <= 30 AND chunk_id % 3 = 0 UNION ALL SELECT query_id, 2, chunk_id, rank, 'anchor' FROM every WHERE rank <= 30 AND chunk_id % 5 = 1), ls AS (SELECT query_id, list_no, chunk_id, source, row_number() OVER (PARTITION BY query_id, list_no ORDER BY rank, chunk_id) AS rank FROM raw), fus AS (SELECT query_id, chunk_id, round(sum(CAST(1 AS DOUBLE) / (60 + rank)), 6) AS score, string_agg(source, '+' ORDER BY source) AS source, min(list_no * 1000 + rank) AS first FROM ls GROUP BY 1, 2), mrg AS (SELECT query_id, chunk_id, score, source, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, chunk_id) AS rank FROM fus)"

SQL = {
    "sr01_build_postings": with_views("SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM post GROUP BY 1", _POST),
    "sr02_bm25_search": with_views("SELECT * FROM own WHERE rank <= 30", _BM),
    "sr02b_bm25_all_kbs": with_views("SELECT * FROM every WHERE rank <= 5", _BM),
    "sr03_vector_topk": with_views("SELECT query_id, chunk_id, rank, round(0.7 * (1 - d), 4) AS score FROM nn WHERE rank <= 30 AND 0.7 * (1 - d) > 0.15", _NEAR),
    "sr03c_index_exact": with_views("SELECT query_id, chunk_id, rank, round(0.7 * (1 - d), 4) AS score FROM nn WHERE rank <= 30 AND 0.7 * (1 - d) > 0.15", _NEAR),
    "jn08b_incremental_index": with_views("SELECT * FROM own WHERE rank <= 30", _BM),
    "sr03b_vector_only": with_views("SELECT query_id, chunk_id, rank, round(CAST(1 AS DOUBLE) / rank, 6) AS score FROM nn WHERE rank <= 5 AND 0.7 * (1 - d) > 0.15", _NEAR),
    "fl04_vector_threshold": with_views("SELECT query_id, count(*) AS n_kept FROM nn WHERE rank <= 50 AND 0.7 * (1 - d) > 0.15 GROUP BY 1", _NEAR),
    "sr16_ingest_gate": with_views("SELECT c.chunk_id, c.kb_id, CASE WHEN d < 0.6 THEN 'duplicate' WHEN d < 0.75 THEN 'conflict' ELSE 'allow' END AS status, n.other AS nearest_id, CASE WHEN d IS NOT NULL THEN round(round(greatest(0.0, 1 - d * d / 2), 4), 3) END AS similarity FROM v c LEFT JOIN g n ON n.chunk_id = c.chunk_id AND n.rank = 1 WHERE c.chunk_id % 10 = 3",
        _VEC, f"g AS (SELECT a.chunk_id, b.chunk_id AS other, {_DIST} AS d, row_number() OVER (PARTITION BY a.chunk_id ORDER BY {_DIST}, b.chunk_id) AS rank FROM v a JOIN v b ON a.kb_id = b.kb_id WHERE a.chunk_id % 20 = 3 AND b.chunk_id % 10 <> 3)"),
    "sr17_near_duplicate_pairs": with_views(f"SELECT a.kb_id, a.chunk_id AS a, b.chunk_id AS b, round(round(greatest(0.0, 1 - {_DIST}), 4), 3) AS similarity FROM c a JOIN c b ON a.kb_id = b.kb_id AND a.chunk_id < b.chunk_id AND {_DIST} <= 0.8 WHERE (a.first = a.chunk_id AND b.first = b.chunk_id) OR a.chunk_id = b.first",
        _VEC, "c AS (SELECT *, min(chunk_id) OVER (PARTITION BY kb_id, e) AS first FROM v)"),
    "sr19_weak_hit_probe": with_views("SELECT q.chunk_id AS query_id, coalesce(bool_or(0.7 * (1 - g.d) >= 0.25), false) AS weak_hit FROM v q LEFT JOIN g ON g.query_id = q.chunk_id AND g.rank <= 5 WHERE q.chunk_id % 100 = 0 GROUP BY 1", _VEC,
        f"g AS (SELECT a.chunk_id AS query_id, {_DIST} AS d, row_number() OVER (PARTITION BY a.chunk_id ORDER BY {_DIST}, b.chunk_id) AS rank FROM v a JOIN v b ON a.kb_id = b.kb_id WHERE a.chunk_id % 100 = 0 AND b.chunk_id % 100 <> 0)"),
    "jn08_fts_sync_diff": with_views("SELECT chunk_id, action FROM (SELECT chunk_id, CASE WHEN NOT is_active AND chunk_id % 5 <> 0 THEN 'delete' WHEN is_active AND chunk_id % 5 = 0 THEN 'insert' WHEN is_active AND chunk_id % 7 = 0 THEN 'refresh' END AS action FROM fx_chunks UNION ALL SELECT chunk_id + 10000000, 'delete' FROM fx_chunks WHERE chunk_id < 20 AND chunk_id % 5 <> 0) x WHERE action IS NOT NULL"),
    "wn01_rrf_fuse": with_views("SELECT * FROM (SELECT query_id, chunk_id, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS rank FROM f) x WHERE rank <= 30", _BM,
        "two AS (SELECT query_id, chunk_id, rank FROM every WHERE rank <= 30 UNION ALL SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY (chunk_id * 7919 + query_id) % 1009 DESC, chunk_id) FROM every WHERE rank <= 30)", "f AS (SELECT query_id, chunk_id, round(sum(CAST(1 AS DOUBLE) / (60 + rank)), 12) AS rrf_score FROM two GROUP BY 1, 2)"),
    "wn02_merge_source_lists": with_views("SELECT * FROM mrg WHERE rank <= 10", _LISTS),
    "wn03_merge_with_quota": with_views("SELECT query_id, chunk_id, rank, reserved FROM (SELECT query_id, chunk_id, place IS NOT NULL AS reserved, row_number() OVER (PARTITION BY query_id ORDER BY place NULLS LAST, pool_rank NULLS LAST, chunk_id) AS rank FROM j) x WHERE rank <= 6", _LISTS,
        "res AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY head, chunk_id) AS place FROM (SELECT query_id, chunk_id, min(list_no * 1000 + rank) AS head FROM ls WHERE rank <= 1 GROUP BY 1, 2) y)",
        "j AS (SELECT coalesce(m.query_id, r.query_id) AS query_id, coalesce(m.chunk_id, r.chunk_id) AS chunk_id, r.place, m.rank AS pool_rank FROM (SELECT m.* FROM mrg m JOIN (SELECT query_id, max(place) AS n FROM res GROUP BY 1) k ON k.query_id = m.query_id WHERE m.rank <= 6 + k.n) m FULL OUTER JOIN res r ON r.query_id = m.query_id AND r.chunk_id = m.chunk_id)"),
    "wn04_term_overlap_rerank": with_views("SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s", _CAND,
        "s AS (SELECT query_id, chunk_id, round(CAST(0.65 AS DOUBLE) * rrf_score + CAST(0.35 AS DOUBLE) * (CAST(len(list_intersect(q, t)) AS DOUBLE) / len(q)), 6) AS score FROM (SELECT query_id, chunk_id, rrf_score, list_distinct(regexp_extract_all(lower(question), '[0-9A-Za-z_]{2,}')) AS q, list_distinct(regexp_extract_all(lower(content), '[0-9A-Za-z_]{2,}')) AS t FROM cand) x)"),
    "wn05_blend_quality": with_views("SELECT c.query_id, c.chunk_id, round(CAST(0.7 AS DOUBLE) * rrf_score + CAST(0.3 AS DOUBLE) * coalesce(quality_score, 0.5), 4) AS blended FROM cand c LEFT JOIN ql ON ql.chunk_id = c.chunk_id", _CAND, _QUALITY),
    "wn06_rerank_by_score": with_views("SELECT query_id, chunk_id, round(m, 5) AS model_score, rank FROM (SELECT query_id, chunk_id, m, row_number() OVER (PARTITION BY query_id ORDER BY m DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round(CASE WHEN r BETWEEN 0 AND 1 THEN r ELSE 1 / (1 + exp(-r)) END, 6) AS m FROM (SELECT query_id, chunk_id, model_score * 40 - 10 AS r FROM cand WHERE model_score IS NOT NULL) a) b) c WHERE rank <= 5", _CAND),
    "fl02_quality_gate": with_views("SELECT c.query_id, c.chunk_id, c.rank, coalesce(quality_score, 0.5) AS quality_score FROM cand c LEFT JOIN ql ON ql.chunk_id = c.chunk_id WHERE coalesce(dislike_count, 0) < 3 AND NOT ((coalesce(quality_score, 0.5) < 0.25 OR coalesce(dislike_count, 0) >= 3) AND coalesce(dislike_count, 0) >= 2) AND coalesce(quality_score, 0.5) >= 0.25", _CAND, _QUALITY),
    "fl03_post_retrieval_filter": with_views("SELECT query_id, chunk_id, rank FROM (SELECT query_id, chunk_id, rank, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) AS n FROM m WHERE ok OR (NOT any_ok AND best = 1 AND has)) x WHERE n <= 2", _CAND,
        "m AS (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS any_ok, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(model_score, score) DESC, rank) AS best FROM (SELECT *, bool_or(model_score IS NOT NULL) OVER (PARTITION BY query_id) AS has, coalesce(model_score, score) >= 0.3 OR query_id % 3 = 0 AS ok FROM cand) y)"),
}
QUERIES = {k: v for k, v in globals().items() if k[:2] in ("sr", "wn", "fl", "jn") and callable(v)}
