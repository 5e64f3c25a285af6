"""Nearest neighbours of many vectors at once, and the gates built on them.

Distances are 1 - cosine; ``metric='l2'`` reads a threshold as the distance of unit vectors instead.
Vectors and queries of a kb are dealt out in blocks, so no kb is one task; each pair of blocks keeps
the best k per query, and only those are merged.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.operators import ann
from docweave.operators.common import materialised

#: Rows of a block: some ten megabytes of vectors.
BLOCK_ROWS = 20_000


def _nearest(q: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of q, row of v and distance of the k nearest of every query, of equally near ones the first."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
    d = np.round(1 - unit(q) @ unit(v).T, 6)
    if d.shape[1] <= k:
        rows, cols = np.nonzero(np.ones_like(d, dtype=bool))
        return rows, cols, d[rows, cols]
    # distances have six places, so distance and column make one whole number without ties
    order = np.rint(d * 1e6).astype(np.int64) * d.shape[1] + np.arange(d.shape[1])
    cols = np.argpartition(order, k - 1, axis=1)[:, :k].ravel()
    rows = np.repeat(np.arange(len(q)), k)
    return rows, cols, d[rows, cols]


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 30, block_rows: int = BLOCK_ROWS, skip_self: bool = False) -> DataFrame:
    """query_id, chunk_id, distance (six places), rank of each query's k nearest in its kb.

    ``queries``: query_id, kb_id, embedding; ``vectors``: chunk_id, kb_id, embedding. Ties go to the smaller id;
    ``skip_self`` leaves out a row of the query's own id. A kb's vectors and queries are both dealt into blocks of
    about ``block_rows``, and every block of the one meets every block of the other.
    """
    per = k + skip_self
    q = queries.where("embedding is not null").select("query_id", "kb_id", F.col("embedding").cast("array<double>").alias("embedding"))
    v = vectors.where("embedding is not null").select("chunk_id", "kb_id", F.col("embedding").cast("array<double>").alias("embedding"))
    blocks = lambda df, name: df.groupBy("kb_id").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias(name))
    sizes = materialised(blocks(v, "v_blocks").join(blocks(q, "q_blocks"), "kb_id"))  # small, so that vectors are not shuffled to meet it
    others = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    qs = q.join(sizes, "kb_id").select("query_id", "kb_id", "embedding", F.pmod(F.xxhash64("query_id"), F.col("q_blocks")).alias("q_block"), others("v_blocks").alias("v_block"))
    v = v.join(sizes, "kb_id").select("chunk_id", F.col("kb_id").alias("kb"), "embedding", F.pmod(F.xxhash64("chunk_id"), F.col("v_blocks")).alias("vb"), others("q_blocks").alias("qb"))

    def block(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": left.query_id[:0], "chunk_id": right.chunk_id[:0], "distance": pd.Series(dtype="float64")})
        right = right.sort_values("chunk_id")
        target, ids, out = np.stack(right.embedding.to_numpy()), right.chunk_id.to_numpy(), []
        for lo in range(0, len(left), 512):
            part = left.iloc[lo : lo + 512]
            i, j, dist = _nearest(np.stack(part.embedding.to_numpy()), target, per)
            out.append(pd.DataFrame({"query_id": part.query_id.to_numpy()[i], "chunk_id": ids[j], "distance": dist}))
        return pd.concat(out)

    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # both sides alike, whatever they were dealt by before
    qs, v = qs.repartition(n, "kb_id", "v_block", "q_block"), v.repartition(n, "kb", "vb", "qb")
    found = qs.groupBy("kb_id", "v_block", "q_block").cogroup(v.groupBy("kb", "vb", "qb")).applyInPandas(block, f"query_id {q.schema['query_id'].dataType.simpleString()}, chunk_id {v.schema['chunk_id'].dataType.simpleString()}, distance double")
    if skip_self:
        found = found.where("query_id <> chunk_id")
    order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vector_score(distance: Column) -> Column:
    return 0.7 * (1 - distance)


def vector_search(queries: DataFrame, vectors: DataFrame, limit: int = 30, least: float = 0.15) -> DataFrame:
    """Neighbours whose score 0.7 (1 - d) is above ``least``."""
    found = vector_topk(queries, vectors, limit)
    return found.withColumn("score", F.round(vector_score(F.col("distance")), 6)).where(vector_score(F.col("distance")) > least)


def vector_only_search(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """The first k of a pool of max(3k, 15), scored by 1 / rank."""
    found = vector_search(queries, vectors, max(3 * k, 15))
    return found.where(F.col("rank") <= k).withColumn("score", F.round(1.0 / F.col("rank"), 6))


def weak_hit_probe(queries: DataFrame, vectors: DataFrame, least: float = 0.25) -> DataFrame:
    """query_id, weak_hit: whether one of the five nearest scores ``least`` or more."""
    hits = vector_topk(queries, vectors, 5).groupBy("query_id").agg(F.max(vector_score(F.col("distance")) >= least).alias("weak_hit"))
    return queries.select("query_id").join(hits, "query_id", "left").select("query_id", F.coalesce("weak_hit", F.lit(False)).alias("weak_hit"))


def _threshold(cosine: float, metric: str) -> float:
    return cosine if metric == "cosine" else cosine**2 / 2  # of unit vectors d_l2^2 = 2 (1 - cos)


def ingest_gate(new_chunks: DataFrame, vectors: DataFrame, duplicate: float = 0.4, conflict: float = 0.7071, metric: str = "cosine") -> DataFrame:
    """chunk_id, status, nearest_id, similarity of each new chunk against what its kb stores; new chunks are not compared with each other.

    duplicate if the nearest of three is nearer than ``duplicate``, conflict if any is nearer than ``conflict``, else
    allow. Blank content and chunks without neighbours are allowed. ``new_chunks``: chunk_id, kb_id, content, embedding.
    """
    asked = new_chunks.where("trim(coalesce(content, '')) <> ''").select(F.col("chunk_id").alias("query_id"), "kb_id", "embedding")
    near = vector_topk(asked, vectors, 3).where("rank = 1").select(F.col("query_id").alias("chunk_id"), F.col("chunk_id").alias("nearest_id"), "distance")
    joined = new_chunks.select("chunk_id", "kb_id").join(near, "chunk_id", "left")
    status = F.when(F.col("distance") < _threshold(duplicate, metric), "duplicate").when(F.col("distance") < _threshold(conflict, metric), "conflict").otherwise("allow")
    similarity = F.when(F.col("distance").isNotNull(), F.round(F.greatest(F.lit(0.0), 1 - F.col("distance") * F.col("distance") / 2), 4))
    return joined.select("chunk_id", "kb_id", status.alias("status"), "nearest_id", similarity.alias("similarity"))


def ordered_admission(new_chunks: DataFrame, vectors: DataFrame, duplicate: float = 0.4, conflict: float = 0.7071, metric: str = "cosine") -> DataFrame:
    """chunk_id, kb_id, status, nearest_id, similarity: each new document is judged against what its kb stores and what was allowed of the documents before it.

    ``new_chunks``: chunk_id, kb_id, position (of its document, one of each number in a kb), content, embedding. Chunks of one document are
    not compared with each other. A chunk is allowed if nothing allowed before it is nearer than ``conflict``; else it is a duplicate of the
    nearest if that is nearer than ``duplicate``, or else in conflict with it. So the allowed ones are the first independent
    set of the graph of near pairs in the order of positions. It is found in rounds of joins: what has no undecided one before it is allowed, what is near that is not;
    rounds are as many as the longest chain of such decisions. Blank content and null embeddings are allowed. Chunks of one document
    with equal vectors have the same decision: the smallest stands for them, so a document never meets itself for each pair of its chunks.
    """
    most = _threshold(conflict, metric)
    known = new_chunks.where("trim(coalesce(content, '')) <> '' and embedding is not null").select("chunk_id", "kb_id", "position", "embedding")
    smallest = F.min("chunk_id").over(Window.partitionBy("kb_id", "position", "embedding"))
    members = materialised(known.withColumn("first", smallest))
    asked = materialised(members.where("chunk_id = first").drop("first"))
    near = lambda d: d < most
    stored = materialised(vector_topk(asked.withColumnRenamed("chunk_id", "query_id"), vectors, 1).where(near(F.col("distance"))).select(F.col("query_id").alias("late"), F.col("chunk_id").alias("early"), "distance"))
    known = stored.select("late").distinct()
    end = lambda k: asked.select(F.col("chunk_id").alias(k), F.col("position").alias(f"position_{k}"))
    pairs = ann.pairs_within(asked, most).where(near(F.col("distance"))).join(end("a"), "a").join(end("b"), "b").where("position_a <> position_b")
    first = F.col("position_a") < F.col("position_b")
    edges = pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("early"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("late"), "distance")
    edges = materialised(edges.join(known.withColumnRenamed("late", "early"), "early", "left_anti").select("early", "late", "distance"))
    refused, left = [known], edges.select("early", "late").join(known, "late", "left_anti")
    while not left.isEmpty():
        sources = left.select("early").distinct().join(left.select(F.col("late").alias("early")), "early", "left_anti")
        out = materialised(left.join(sources, "early").select("late").distinct())
        refused.append(out)
        left = materialised(left.join(out, "late", "left_anti").join(out.withColumnRenamed("late", "early"), "early", "left_anti"))
    refused = materialised(reduce(DataFrame.unionByName, refused))
    allowed = edges.join(refused.withColumnRenamed("late", "early"), "early", "left_anti")
    causes = stored.unionByName(allowed.select("late", "early", "distance"))
    nearest = causes.groupBy("late").agg(F.min(F.struct("distance", "early")).alias("n")).select(F.col("late").alias("chunk_id"), F.col("n.early").alias("nearest_id"), "n.distance")
    nearest = members.select("chunk_id", "first").join(nearest.withColumnRenamed("chunk_id", "first"), "first").drop("first")
    joined = new_chunks.select("chunk_id", "kb_id").join(nearest, "chunk_id", "left")
    status = F.when(F.col("distance").isNull(), "allow").when(F.col("distance") < _threshold(duplicate, metric), "duplicate").otherwise("conflict")
    similarity = F.when(F.col("distance").isNotNull(), F.round(F.greatest(F.lit(0.0), 1 - F.col("distance") * F.col("distance") / 2), 4))
    return joined.select("chunk_id", "kb_id", status.alias("status"), "nearest_id", similarity.alias("similarity"))


def near_duplicate_pairs(chunks: DataFrame, scan: int | None = None, k: int | None = None, most: float = 0.4, metric: str = "cosine") -> DataFrame:
    """kb_id, a, b, similarity: chunks of a kb at most ``most`` apart, each pair once.

    Chunks of equal vectors are one class: the smallest stands for it in pairs with others, and meets each of its own
    copies once. With ``scan`` only each kb's newest ``scan`` chunks are looked at, each with the nearest of its ``k``
    neighbours (itself among them). ``chunks``: chunk_id, kb_id, created_at, embedding.
    """
    own = chunks.select(F.col("chunk_id").alias("a"), "kb_id")
    if scan is None:
        known = chunks.where("embedding is not null")
        classes = materialised(known.groupBy("kb_id", "embedding").agg(F.min("chunk_id").alias("first")))
        copies = known.join(classes, ["kb_id", "embedding"]).where("chunk_id <> first").select(F.col("first").alias("a"), F.col("chunk_id").alias("b"), F.lit(0.0).alias("distance"))
        pairs = ann.pairs_within(classes.withColumnRenamed("first", "chunk_id"), _threshold(most, metric)).unionByName(copies)
    else:
        newest = F.row_number().over(Window.partitionBy("kb_id").orderBy(F.desc("created_at"), "chunk_id"))
        scanned = chunks.withColumn("rn", newest).where(F.col("rn") <= scan)
        found = vector_topk(scanned.select(F.col("chunk_id").alias("query_id"), "kb_id", "embedding"), chunks, (k or 3) - 1, skip_self=True)
        near = found.where((F.col("rank") == 1) & (F.col("distance") <= _threshold(most, metric)))
        pairs = near.select(F.least("query_id", "chunk_id").alias("a"), F.greatest("query_id", "chunk_id").alias("b"), "distance").groupBy("a", "b").agg(F.min("distance").alias("distance"))
    return pairs.join(own, "a").select("kb_id", "a", "b", F.round(F.greatest(F.lit(0.0), 1 - F.col("distance")), 4).alias("similarity"))
