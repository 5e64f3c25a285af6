"""Searches composed of others: hybrid, multi-hop, sub-query, two rounds, and what to make of their results.

Vectors of questions and chunks are input columns, model scores too; a question without a vector has no vector hits.
Results are query_id, chunk_id, score, rank, source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.operators import graph, ranking, search, vectors
from docweave.operators.common import materialised

#: Fixed values of the gates.
MIN_SCORE, MIN_OVERLAP, MIN_SUBSTANTIVE, MIN_ANCHOR, MIN_ANCHOR_MATCHES = 0.06, 0.12, 0.05, 0.20, 2
RRF_SCALE, NEAR_DOMAIN_MAX, MODEL_SURE, LOW_QUALITY = 0.15, 0.45, 0.50, 0.30
SPLIT_CUES = ["关联", "两段", "多跳", "之间", "关系", "联系"]
GRAPH_CUES = ["关联", "两段", "多跳", "之间"]
ANCHOR_HITS = 3


def routed(queries: DataFrame, default_k: int = 5) -> DataFrame:
    """Queries with route and top_k; chitchat gets no search."""
    route = T.route_query(F.col("question"))
    return queries.withColumn("route", route).withColumn("top_k", T.route_top_k(F.col("route"), F.col("question"), default_k)).where("top_k > 0")


def hybrid_search(queries: DataFrame, chunks: DataFrame, postings: DataFrame, quality: DataFrame, top_k: int | None = 5, least: float = 0.25, soft_fallback: bool = True, stored: DataFrame | None = None) -> DataFrame:
    """Vector and full-text pools fused, reranked by terms, filtered, blended with quality.

    ``queries``: query_id, kb_id, question, embedding (may be null) and, for ``top_k`` None, top_k. ``stored``: chunk_id, kb_id, embedding of the
    chunks, where these have no column embedding. What is found is written before it meets the texts, so that where it is small they are not shuffled.
    """
    asked = materialised(queries)
    by_vector = vectors.vector_search(asked, chunks if stored is None else stored)
    fused = materialised(ranking.rrf_fuse_two(by_vector, search.bm25_search(asked, postings)).select("query_id", "chunk_id", "rrf_score"))
    alive = chunks.where("is_active").select("chunk_id", "document_id", "content", *[c for c in ("model_score",) if c in chunks.columns])
    rows = fused.join(alive, "chunk_id").join(asked.select("query_id", "question", *(["top_k"] if top_k is None else [])), "query_id")
    if "model_score" not in rows.columns:
        rows = rows.withColumn("model_score", F.lit(None).cast("double"))
    kept = ranking.post_retrieval_filter(ranking.term_overlap_rerank(rows), least, soft_fallback=soft_fallback)
    gated = ranking.quality_gate(kept, quality)
    blended = gated.withColumn("score", ranking.blend_quality(F.col("score"), F.col("quality_score"))).drop("rank")
    out = ranking.ranked(blended)
    head = out.where(F.col("rank") <= (F.col("top_k") if top_k is None else F.lit(top_k)))
    return materialised(head.select("query_id", "chunk_id", "score", "rank", "quality_score", "model_score", F.lit("hybrid").alias("source")))


def _evidence(queries: DataFrame, results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per query: the best score, the best overlaps of its term sets, counts and flags of its results; terms are taken of the found chunks alone."""
    q = queries.select("query_id", "question", *[c for c in ("route",) if c in queries.columns])
    if "route" not in q.columns:
        q = q.withColumn("route", T.route_query(F.col("question")))
    terms = q.withColumns({"terms": T.retrieval_terms(F.col("question")), "sub": T.substantive_terms(F.col("question")), "anchor": T.anchor_terms(F.col("question"))})
    terms = terms.withColumn("sub", F.when(F.size("sub") > 0, F.col("sub")).otherwise(F.col("terms")))
    have = set(results.columns)
    extra = {c: F.lit(None).cast(t) for c, t in (("model_score", "double"), ("quality_score", "double"), ("source", "string")) if c not in have}
    rows = results.withColumns(extra).join(chunks.select("chunk_id", "content"), "chunk_id").join(terms, "query_id").withColumn("held", T.retrieval_terms(F.col("content")))
    low = F.coalesce("quality_score", F.lit(0.5)) < LOW_QUALITY
    stats = rows.groupBy("query_id").agg(
        F.max("score").alias("max_score"), F.max(T.overlap(F.col("terms"), F.col("held"))).alias("term_overlap"), F.max(T.overlap(F.col("sub"), F.col("held"))).alias("sub_overlap"),
        F.max(T.overlap(F.col("anchor"), F.col("held"))).alias("anchor_overlap"), F.max(F.size(F.array_intersect("anchor", "held"))).alias("anchor_matches"),
        F.max("model_score").alias("model_top"), F.sum(F.when((F.col("rank") <= 3) & low, 1).otherwise(0)).alias("n_low"), F.count(F.lit(1)).alias("n"),
        F.max(F.coalesce(F.col("source").contains("graph"), F.lit(False))).alias("has_graph"),
    )
    return terms.select("query_id", "route", F.size("anchor").alias("n_anchor")).join(stats, "query_id", "left")


def retrieval_abstain(queries: DataFrame, results: DataFrame, chunks: DataFrame, relaxed: bool = False, model_least: float = 0.35) -> DataFrame:
    """The results of queries whose evidence holds. The rules stand in order, the first that fits decides."""
    e = _evidence(queries, results, chunks)
    best = F.greatest("term_overlap", "sub_overlap", "anchor_overlap")
    has_model, top, score = F.col("model_top").isNotNull(), F.col("model_top"), F.col("max_score")
    low = (F.col("n") >= 3) & (F.col("n_low") > 2)
    needed = F.least(F.lit(MIN_ANCHOR_MATCHES), F.col("n_anchor"))
    mismatch = (F.col("n_anchor") > 0) & ~((F.col("anchor_matches") >= needed) & (F.col("anchor_overlap") >= MIN_ANCHOR))
    anchored = F.lit(not relaxed) & (F.col("n_anchor") > 0) & ((F.col("anchor_matches") < needed) | (F.col("anchor_overlap") < MIN_ANCHOR))
    keep = (
        F.when(F.col("route") == "chitchat", True)
        .when(has_model & (top < model_least), False)
        .when(has_model & (top >= MODEL_SURE), ~low)
        .when(has_model & (top < NEAR_DOMAIN_MAX) & mismatch, False)
        .when(low, False)
        .when(F.col("has_graph") & (score >= MIN_SCORE * 0.6), True)
        .when(anchored, False)
        .when((F.col("sub_overlap") < MIN_SUBSTANTIVE) & (score < RRF_SCALE), False)
        .when((best < MIN_OVERLAP * 0.75) & (score < 0.18), False)
        .when((score < MIN_SCORE) & (best < MIN_OVERLAP), False)
        .when((F.col("route") == "factual") & (score < MIN_SCORE * 0.85) & (best < MIN_OVERLAP * 0.8), False)
        .otherwise(True)
    )
    return results.join(e.where("n is not null").where(keep).select("query_id"), "query_id", "left_semi")


def sufficiency(queries: DataFrame, results: DataFrame, chunks: DataFrame, min_score: float = 0.06, min_overlap: float = 0.10) -> DataFrame:
    """query_id, sufficient, sufficiency of each query's results; chitchat is sufficient, no results are not."""
    e = _evidence(queries, results, chunks)
    best = F.greatest("term_overlap", "sub_overlap", "anchor_overlap")
    least = F.when(F.col("route") == "relational", min_score * 0.85).when(F.col("route") == "comprehensive", min_score * 0.9).otherwise(min_score)
    share = F.when(F.col("route") == "relational", min_overlap * 0.85).otherwise(min_overlap)
    combined = 0.55 * F.least(F.lit(1.0), F.col("max_score") / 0.5) + 0.45 * F.least(F.lit(1.0), best / 0.35)
    small = (F.col("max_score") > 0) & (best >= share)
    large = (F.col("max_score") >= least) & ((best >= share) | (F.col("max_score") >= least * 1.8))
    enough = F.when(F.col("route") == "chitchat", True).when(F.col("n").isNull(), False).when(F.col("max_score") < RRF_SCALE, small).otherwise(large)
    value = F.when(F.col("route") == "chitchat", 1.0).when(F.col("n").isNull(), 0.0).otherwise(F.round(combined, 4))
    return e.select("query_id", "route", enough.alias("sufficient"), value.alias("sufficiency"), "max_score")


def sub_query_search(queries: DataFrame, find, top_k: int = 5) -> DataFrame:
    """Each part of a compound question searched on its own, lists fused. ``find``: (queries, k) -> results; per part min(8, max(3, k // n + 1)) rows."""
    parts = materialised(queries).withColumn("parts", T.sub_queries(F.col("question"))).select("*", F.size("parts").alias("n_parts"), F.posexplode("parts").alias("list_no", "part"))
    sub = materialised(parts.drop("question", "parts").withColumnRenamed("part", "question").withColumns({"parent": F.col("query_id"), "query_id": F.col("query_id") * 100 + F.col("list_no")}))
    found = find(sub, 8).join(sub.select("query_id", "parent", "list_no", "n_parts"), "query_id")
    per = F.least(F.lit(8), F.greatest(F.lit(3), F.floor(F.lit(top_k) / F.col("n_parts")) + 1))
    lists = materialised(found.where(F.col("rank") <= per).select(F.col("parent").alias("query_id"), "list_no", "chunk_id", "rank", "source", "n_parts"))
    merged = ranking.merge_source_lists(lists.drop("n_parts"), 15)
    size = lists.groupBy("query_id").agg(F.first("n_parts").alias("n"))
    return merged.join(size, "query_id").where(F.col("rank") <= F.least(F.lit(15), F.lit(top_k) + F.col("n"))).select("query_id", "chunk_id", "score", "rank", "source")


def coverage(queries: DataFrame, results: DataFrame, chunks: DataFrame, least: float = 0.15) -> DataFrame:
    """The share of a question's parts whose best chunk has ``least`` of their terms."""
    parts = queries.select("query_id", F.posexplode(T.sub_queries(F.col("question"))).alias("i", "part")).withColumn("t", T.unicode_terms(F.col("part")))
    held = results.select("query_id", "chunk_id").join(chunks.select("chunk_id", "content"), "chunk_id").select("query_id", T.unicode_terms(F.col("content")).alias("held"))
    best = parts.join(held, "query_id", "left").groupBy("query_id", "i").agg(F.max(T.overlap(F.col("t"), F.coalesce("held", F.array().cast("array<string>")))).alias("o"))
    return best.groupBy("query_id").agg(F.round(F.avg((F.col("o") >= least).cast("double")), 4).alias("coverage"))


def multi_hop_search(queries: DataFrame, find, postings: DataFrame, chunks: DataFrame, top_k: int = 5, per_anchor: int = 5) -> DataFrame:
    """Relational and comprehensive questions with two anchors or more, searched by anchor.

    Each anchor's list is its own search fused with its own full-text hits, ``per_anchor`` at most; the quotes of the
    question are one list more. Every anchor's list has a quota in the merged one. Questions that the relaxed gate drops
    altogether fall back to full-text hits alone: of the quotes and of each anchor, the anchors with a quota again.
    """
    q = materialised(queries).withColumn("route", T.route_query(F.col("question"))).withColumn("anchors", T.multi_hop_anchors(F.col("question")))
    cue = F.exists(F.array(*[F.lit(c) for c in SPLIT_CUES]), lambda c: F.col("question").contains(c))
    split = materialised(q.where(F.col("route").isin("relational", "comprehensive") & cue & (F.size("anchors") >= 2)))
    spread = split.select("*", F.posexplode("anchors").alias("list_no", "anchor"))
    short = F.length("anchor") < 12
    sub = spread.drop("question", "anchors").withColumn("question", F.when(short, F.concat("anchor", F.lit(" 相关内容"))).otherwise(F.col("anchor")))
    sub = materialised(sub.withColumns({"parent": F.col("query_id"), "query_id": F.col("query_id") * 100 + F.col("list_no")}))
    found = find(sub.drop("anchor"), per_anchor).select("query_id", F.lit(0).alias("list_no"), "chunk_id", "rank", "source")
    # anchors and quotes are searched in one pass over the postings; ids of both may be equal
    owner = lambda quoted: F.struct(F.col("query_id").alias("id"), F.lit(quoted).alias("quoted")).alias("query_id")
    asked = sub.select(owner(False), "kb_id", F.lit(0).alias("a"), "anchor").unionByName(split.select(owner(True), "kb_id", F.posexplode(T.quote_anchors(F.col("question"))).alias("a", "anchor")))
    by_terms = materialised(search.variant_search(asked, postings, ANCHOR_HITS).select(F.col("query_id.id").alias("query_id"), "query_id.quoted", "chunk_id", "rank"))
    texts = by_terms.where(~F.col("quoted") & (F.col("rank") <= ANCHOR_HITS)).select("query_id", F.lit(1).alias("list_no"), "chunk_id", "rank", F.lit("anchor-fts").alias("source"))
    fused = ranking.merge_source_lists(materialised(found).unionByName(texts), per_anchor).select("query_id", "chunk_id", "rank", "source")
    parents = sub.select("query_id", "parent", "list_no")
    named = lambda df: df.join(parents, "query_id").select(F.col("parent").alias("query_id"), "list_no", "chunk_id", "rank", "source")
    own = materialised(named(fused))
    quoted = by_terms.where("quoted").select("query_id", F.lit(-1).alias("list_no"), "chunk_id", "rank", F.lit("quote-fts").alias("source"))
    pool = F.least(F.lit(top_k) + 2 * F.size("anchors"), F.lit(15))
    merged = ranking.merge_with_quota(quoted.unionByName(own), 15, quota_lists=own).join(split.select("query_id", pool.alias("pool")), "query_id").where((F.col("rank") <= F.col("pool")) & (F.col("rank") <= top_k))
    scored = materialised(merged.select("query_id", "chunk_id", F.round(1.0 / (60 + F.col("rank")), 6).alias("score"), "rank", F.lit("multi_hop").alias("source")))
    kept = materialised(retrieval_abstain(split, scored, chunks, relaxed=True, model_least=0.25))
    dropped = split.select("query_id").join(kept.select("query_id").distinct(), "query_id", "left_anti")
    by_text = named(texts.select("query_id", "chunk_id", "rank", "source"))
    lists = materialised(quoted.unionByName(by_text).join(dropped, "query_id", "left_semi"))
    back = ranking.merge_with_quota(lists, top_k, quota_lists=lists.where("list_no >= 0"))
    return kept.unionByName(materialised(back.select("query_id", "chunk_id", F.round(1.0 / (60 + F.col("rank")), 6).alias("score"), "rank", F.lit("fts").alias("source"))))


def routed_search(queries: DataFrame, find, relations: DataFrame, chunks: DataFrame, top_k: int = 5, gated: bool = True) -> DataFrame:
    """One round of search by route: questions about relations get the entity graph's list beside the hybrid one, fused before the gate.

    Where the graph finds nothing the hybrid list stays as it is. A question whose results the graph is part of passes the
    gate as one with graph evidence.
    """
    q = materialised(queries.withColumn("route", T.route_query(F.col("question"))))
    cue = F.exists(F.array(*[F.lit(c) for c in GRAPH_CUES]), lambda c: F.col("question").contains(c))
    hybrid = materialised(find(q, top_k).select("query_id", F.lit(1).alias("list_no"), "chunk_id", "score", "rank", "source"))
    by_graph = graph.graph_search(q.where((F.col("route") == "relational") | cue), relations, chunks, "lite", top_k)
    near = materialised(by_graph.select("query_id", F.lit(0).alias("list_no"), "chunk_id", "rank", F.lit("graph").alias("source")))
    both = near.unionByName(hybrid.drop("score").join(near.select("query_id").distinct(), "query_id", "left_semi"))
    fused = ranking.merge_source_lists(both, top_k).select("query_id", "chunk_id", "score", "rank", "source")
    alone = hybrid.join(near.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "chunk_id", "score", "rank", "source")
    rows = materialised(fused).unionByName(materialised(alone))
    return retrieval_abstain(q, rows, chunks) if gated else rows


def two_round_search(queries: DataFrame, find, chunks: DataFrame, default_k: int = 5) -> DataFrame:
    """Round one as routed; where that is insufficient, round two with the expanded question and three rows more (12 at most).

    The first sufficient round stays. If neither is, the one of the higher score does (round two on a tie) and refused is true.
    """
    first = materialised(routed(materialised(queries), default_k))
    one = materialised(find(first, None))
    judged = sufficiency(first, one, chunks)
    weak = first.join(judged.where("not sufficient").select("query_id"), "query_id", "left_semi")
    again = materialised(weak.withColumn("question", T.expand_query_for_retry(F.col("question"), F.col("route"))).withColumn("top_k", F.least(F.col("top_k") + 3, F.lit(12))))
    two = materialised(find(again, None))
    rejudged = sufficiency(again, two, chunks)
    j = judged.select("query_id", F.col("sufficient").alias("s1"), F.coalesce("max_score", F.lit(0.0)).alias("m1")).join(rejudged.select("query_id", F.col("sufficient").alias("s2"), F.coalesce("max_score", F.lit(0.0)).alias("m2")), "query_id", "left")
    pick = F.when(F.col("s1"), 1).when(F.col("s2"), 2).when(F.col("m1") > F.coalesce("m2", F.lit(0.0)), 1).otherwise(2)
    choice = j.select("query_id", pick.alias("round"), (~F.col("s1") & ~F.coalesce("s2", F.lit(False))).alias("refused"))
    both = one.withColumn("round", F.lit(1)).unionByName(two.withColumn("round", F.lit(2)))
    return both.join(choice, ["query_id", "round"]).select("query_id", "chunk_id", "score", "rank", "round", "refused")


def strict_vs_relaxed(queries: DataFrame, chunks: DataFrame, postings: DataFrame, quality: DataFrame, relations: DataFrame, top_k: int = 5, stored: DataFrame | None = None) -> DataFrame:
    """Both answers to a question side by side: without fallback at 0.35, and with fallback and the graph at 0.25."""
    strict = retrieval_abstain(queries, hybrid_search(queries, chunks, postings, quality, top_k, 0.35, False, stored), chunks, model_least=0.35)
    loose = hybrid_search(queries, chunks, postings, quality, top_k, 0.25, True, stored)
    by_graph = graph.graph_search(queries, relations, chunks, "lite", top_k)
    near = materialised(by_graph.select("query_id", F.lit(1).alias("list_no"), "chunk_id", "rank", F.lit("graph").alias("source")))
    lists = loose.select("query_id", F.lit(0).alias("list_no"), "chunk_id", "rank", "source").unionByName(near)
    relaxed = retrieval_abstain(queries, materialised(ranking.merge_source_lists(lists, top_k)), chunks, relaxed=True, model_least=0.25)
    a, b = strict.select("query_id", "chunk_id", F.col("rank").alias("strict_rank")), relaxed.select("query_id", "chunk_id", F.col("rank").alias("relaxed_rank"))
    return a.join(b, ["query_id", "chunk_id"], "full_outer")
