"""Fusion, reranking and filters of ranked candidates. All windows are over one query's rows.

A candidate has query_id, chunk_id and rank (from 1) or score; ties go to the smaller chunk_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import overlap, retrieval_terms

RRF_K, POOL = 60, 30


def ranked(df: DataFrame, score: str = "score", by: str = "query_id", most: int | None = None, name: str = "rank") -> DataFrame:
    """Rows with their rank by falling score, ``most`` at most."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), "chunk_id")))
    return out if most is None else out.where(F.col(name) <= most)


def rrf_fuse(lists: DataFrame, k: int = RRF_K, pool: int = POOL) -> DataFrame:
    """query_id, chunk_id, rrf_score, rank from lists (query_id, list_no, chunk_id, rank)."""
    fused = lists.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("rrf_score"))
    return ranked(fused, "rrf_score", most=pool)


def rrf_fuse_two(first: DataFrame, second: DataFrame, k: int = RRF_K, pool: int = POOL) -> DataFrame:
    """As ``rrf_fuse``, of two lists (query_id, chunk_id, rank) with each chunk once a query: they meet in one join."""
    a, b = first.select("query_id", "chunk_id", F.col("rank").alias("a")), second.select("query_id", "chunk_id", F.col("rank").alias("b"))
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return ranked(a.join(b, ["query_id", "chunk_id"], "full_outer").select("query_id", "chunk_id", F.round(part("a") + part("b"), 12).alias("rrf_score")), "rrf_score", most=pool)


def merge_source_lists(lists: DataFrame, top_k: int) -> DataFrame:
    """Lists with source, fused: source labels of a chunk sorted and joined by +, scores to six places.

    With a column graph_seeds, the last list that has any wins.
    """
    extra = [F.max_by("graph_seeds", F.when(F.col("graph_seeds").isNotNull(), F.col("list_no"))).alias("graph_seeds")] if "graph_seeds" in lists.columns else []
    fused = lists.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("source"), F.min(F.struct("list_no", "rank")).alias("first"), *extra
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).drop("first")


def merge_with_quota(lists: DataFrame, top_k: int, per_list: int = 1, quota_lists: DataFrame | None = None) -> DataFrame:
    """The heads of every list first, in the order of the lists, then the fused pool, each chunk once."""
    heads = (lists if quota_lists is None else quota_lists).where(F.col("rank") <= per_list)
    reserved = heads.groupBy("query_id", "chunk_id").agg(F.min(F.struct("list_no", "rank")).alias("at"))
    numbered = reserved.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "chunk_id"))).select("query_id", "chunk_id", "place")
    n = numbered.groupBy("query_id").agg(F.max("place").alias("n"))
    pool = merge_source_lists(lists, 2**31 - 1).join(n, "query_id", "left").where(F.col("rank") <= top_k + F.coalesce("n", F.lit(0)))
    joined = pool.select("query_id", "chunk_id", F.col("rank").alias("pool_rank")).join(numbered, ["query_id", "chunk_id"], "full_outer")
    order = Window.partitionBy("query_id").orderBy(F.col("place").asc_nulls_last(), F.col("pool_rank").asc_nulls_last(), "chunk_id")
    return joined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query_id", "chunk_id", "rank", F.col("place").isNotNull().alias("reserved"))


def term_overlap_rerank(candidates: DataFrame) -> DataFrame:
    """0.65 fused score + 0.35 share of the question's terms; without terms the fused order stays. Needs question, content, rrf_score."""
    terms = retrieval_terms(F.col("question"))
    mixed = F.round(0.65 * F.col("rrf_score") + 0.35 * overlap(F.col("q_terms"), retrieval_terms(F.col("content"))), 6)
    rows = candidates.withColumn("q_terms", terms)
    return ranked(rows.withColumn("score", F.when(F.size("q_terms") == 0, F.col("rrf_score")).otherwise(mixed)).drop("q_terms"))


def blend_quality(retrieval: Column, quality: Column) -> Column:
    """Seven parts retrieval, three parts quality, to four places."""
    return F.round(0.7 * retrieval + 0.3 * quality, 4)


def normalize_score(raw: Column) -> Column:
    """A raw model score: itself within [0, 1], else its logistic."""
    return F.when(raw.between(0.0, 1.0), raw).otherwise(1 / (1 + F.exp(-raw)))


def rerank_by_score(candidates: DataFrame, raw: str = "model_raw", top_k: int = 5) -> DataFrame:
    """The best rows by a given model score."""
    return ranked(candidates.withColumn("model_score", F.round(normalize_score(F.col(raw)), 6)), "model_score", most=top_k)


def post_retrieval_filter(candidates: DataFrame, least: float = 0.25, per_document: int = 2, soft_fallback: bool = True, use_threshold: bool = True) -> DataFrame:
    """Drop rows under the threshold of the model score, then more than ``per_document`` rows of a document in rank order.

    Where all of a query's rows fall, its best stays if ``soft_fallback``. Rows without a model score use their score;
    a query without any model score has no threshold. A blank document counts as none.
    """
    q = Window.partitionBy("query_id")
    score = F.coalesce("model_score", "score", F.lit(0.0))
    scored = candidates.withColumn("__s", score).withColumn("__has", F.max(F.col("model_score").isNotNull()).over(q))
    passed = (F.col("__s") >= least) | ~F.col("__has") if use_threshold else F.lit(True)
    marked = scored.withColumn("__ok", passed).withColumn("__any", F.max("__ok").over(q)).withColumn("__best", F.row_number().over(q.orderBy(F.desc("__s"), "rank")))
    kept = marked.where(F.col("__ok") | (~F.col("__any") & (F.col("__best") == 1) & F.col("__has") & F.lit(soft_fallback)))
    text = F.coalesce(F.col("document_id").cast("string"), F.lit(""))
    nth = F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy("rank"))
    return kept.withColumn("__n", nth).where((F.col("__n") <= per_document) | (text == "")).drop("__s", "__has", "__ok", "__any", "__best", "__n")


def quality_gate(candidates: DataFrame, quality: DataFrame, least: float = 0.25) -> DataFrame:
    """Without chunks that three or more dislike, that are to be reviewed and two dislike, or of quality below ``least`` (0.5 if unknown)."""
    q = quality.select("chunk_id", "quality_score", "dislike_count", "needs_review")
    joined = candidates.join(q, "chunk_id", "left")
    dislikes, review = F.coalesce("dislike_count", F.lit(0)), F.coalesce("needs_review", F.lit(False))
    good = (dislikes < 3) & ~(review & (dislikes >= 2)) & (F.coalesce("quality_score", F.lit(0.5)) >= least)
    return joined.where(good).withColumn("quality_score", F.coalesce("quality_score", F.lit(0.5))).drop("dislike_count", "needs_review")


def pack_context(candidates: DataFrame, most: int = 4500) -> DataFrame:
    """One numbered context of each query, cut at ``most`` characters: a fold, for each cut depends on those before."""
    rows = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("r"))
    folded = F.expr(f"""
        aggregate(transform(r, (x, i) -> concat('[来源 ', cast(i + 1 as string), '] ', x.content)), named_struct('left', {most}, 'parts', cast(array() as array<string>)),
          (s, t) -> if(s.left <= 0, s, if(length(t) > s.left,
             named_struct('left', 0, 'parts', concat(s.parts, array(concat(substring(t, 1, s.left), '…')))),
             named_struct('left', s.left - length(t), 'parts', concat(s.parts, array(t))))),
          s -> array_join(s.parts, '\\n\\n'))
    """)
    return rows.select("query_id", F.when(F.size("r") == 0, F.lit("（无相关内容）")).otherwise(folded).alias("context"))
