"""The full-text index as a table that follows the chunks: segments, deletes, kept counts, compaction.

Each refresh is one version of a ``store``: postings of the chunks that are new or have other content, the ids of those that changed
or went, and what the refresh adds to the counts of BM25, which are sums over versions: the number of chunks, their lengths and each term's chunks.
Nothing written before is touched until ``compact_index`` writes what lives as one segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators.common import materialised
from docweave.operators.search import bm25_search, build_postings
from docweave.sources import store

KEY = "chunk_id"
_COUNTS = {"terms": ["term"], "totals": []}


def refresh_index(chunks: DataFrame, path: str) -> int:
    """Bring the index at ``path`` to the state of ``chunks`` (kb_id, chunk_id, content, is_active); returns the version.

    Inactive, missing and blank chunks leave, new ones enter, changed ones are replaced. Contents are compared as hashes. The same chunks again
    give a version without rows.
    """
    spark = chunks.sparkSession
    version = (store.versions(spark, path) or [(0, False)])[-1][0] + 1
    alive = chunks.where("is_active and trim(coalesce(content, '')) <> ''")
    now = alive.select(KEY, F.xxhash64("kb_id", "content").alias("now"))
    held = store.read(spark, path, "contents", key=KEY)
    held = now.where("false").withColumnRenamed("now", "hash") if held is None else held
    changed = materialised(now.join(held, KEY, "full_outer").where("now is null or hash is null or now <> hash").select(KEY, F.col("now").isNotNull().alias("enters"), F.col("hash").isNotNull().alias("leaves")))
    fresh = alive.join(changed.where("enters").select(KEY), KEY, "left_semi")
    postings = materialised(build_postings(fresh.select("kb_id", KEY, "content", "is_active")))
    old = store.read(spark, path, "postings", key=KEY)
    sign = postings.select("term", "doc_len", "head", F.lit(1).alias("s"))
    if old is not None:
        sign = sign.unionByName(old.join(changed.where("leaves").select(KEY), KEY, "left_semi").select("term", "doc_len", "head", F.lit(-1).alias("s")))
    sign = materialised(sign)
    tables = {
        "postings": postings,
        "contents": now.join(changed.where("enters").select(KEY), KEY, "left_semi").withColumnRenamed("now", "hash"),
        "terms": sign.groupBy("term").agg(F.sum("s").alias("df")).where("df <> 0"),
        "totals": sign.where("head").agg(F.coalesce(F.sum("s"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("s") * F.col("doc_len")), F.lit(0)).alias("total_len")),
    }
    store.commit(path, version, changed, tables, key=KEY)
    return version


def compact_index(spark: SparkSession, path: str) -> int:
    return store.compact(spark, path, KEY, _COUNTS)


def index_search(queries: DataFrame, path: str, limit: int = 30) -> DataFrame:
    """``bm25_search`` over the index, with its kept counts."""
    spark = queries.sparkSession
    df = store.read(spark, path, "terms", key=KEY).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    totals = store.read(spark, path, "totals", key=KEY).agg(F.sum("n").alias("n"), (F.sum("total_len") / F.sum("n")).alias("avgdl"))
    return bm25_search(queries, store.read(spark, path, "postings", key=KEY), limit, df, totals)
