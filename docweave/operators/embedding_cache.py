"""Compute once per distinct text: a table of vectors by content hash.

``get_or_compute`` gives every row its text's vector: hashes that the table lacks are computed, each distinct text once, and
enter it; those it has count as hits. ``evict`` keeps the rows used last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import content_hash
from docweave.operators.common import materialised


def empty_cache(rows: DataFrame) -> DataFrame:
    """A cache without entries, in the session of ``rows``: hash, embedding, hits, last_used."""
    return rows.sparkSession.createDataFrame([], "hash string, embedding array<float>, hits long, last_used long")


def get_or_compute(rows: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], now: int, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows with embedding, the cache afterwards).

    ``compute`` gets hash and text of the misses and returns hash and embedding; it runs once. ``now`` is a number that rises from run to run. Of
    a text's rows in one run the first counts as a miss where the cache lacks it, all others are hits. A null text is the empty text.
    """
    keyed = rows.withColumn("__hash", content_hash(F.col(text)))
    wanted = keyed.groupBy(F.col("__hash").alias("hash")).agg(F.first(F.coalesce(F.col(text), F.lit(""))).alias("text"), F.count(F.lit(1)).alias("uses"))
    known = materialised(wanted.join(cache, "hash", "left"))
    misses = known.where("last_used is null")
    made = materialised(compute(misses.select("hash", "text")).select("hash", F.col("embedding").cast("array<float>").alias("embedding")))
    new = misses.select("hash", "uses").join(made, "hash").select("hash", "embedding", (F.col("uses") - 1).alias("hits"), F.lit(now).cast("long").alias("last_used"))
    used = known.where("last_used is not null").select("hash", "embedding", (F.col("hits") + F.col("uses")).alias("hits"), F.lit(now).cast("long").alias("last_used"))
    touched = materialised(new.unionByName(used))
    after = materialised(touched.unionByName(cache.join(wanted.select("hash"), "hash", "left_anti").select("hash", "embedding", "hits", "last_used")))
    out = keyed.join(touched.select(F.col("hash").alias("__hash"), "embedding"), "__hash").drop("__hash")
    return out, after


def evict(cache: DataFrame, most: int) -> DataFrame:
    """The ``most`` entries used last; of those used in the same run, the smaller hashes.

    Only the numbers of entries by run meet in one task; within the run at the border a global top-k takes what is left of ``most``.
    """
    runs = cache.groupBy("last_used").agg(F.count(F.lit(1)).alias("n"))
    newer = F.sum("n").over(Window.orderBy(F.desc("last_used")).rowsBetween(Window.unboundedPreceding, -1))
    runs = materialised(runs.withColumn("newer", F.coalesce(newer, F.lit(0))).where(F.col("newer") < most))
    whole = cache.join(runs.where(F.col("newer") + F.col("n") <= most).select("last_used"), "last_used", "left_semi")
    border = runs.where(F.col("newer") + F.col("n") > most).first()  # one row at most
    if border is None:
        return whole
    part = cache.where(F.col("last_used") == border.last_used).orderBy("hash").limit(most - border.newer)
    return whole.unionByName(part)
