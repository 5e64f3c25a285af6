"""Full-text index and search as tables: postings, BM25, index upkeep, anchors.

Statistics are over the whole index; a query's kb filters after scoring.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.text import fts_query_terms, quote_anchors, search_variants
from docweave.operators.common import materialised
from docweave.operators.ranking import ranked

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


#: Lower-cased words and single CJK characters; chunks whose terms are counted at a time.
TERM, COUNTED_ROWS = re.compile("[0-9a-z_]{2,}|[一-鿿]"), 200


def build_postings(chunks: DataFrame, *more: str) -> DataFrame:
    """kb_id, term, chunk_id, tf, doc_len, head (and further columns of the chunk) of all active chunks; one posting a chunk is its head.

    A chunk's terms lie in one row, so they are counted there and nothing is shuffled. They are found and counted in Python, which takes
    less than half the time of Spark's regular expressions, sorting and array functions.
    """
    rows = chunks.where("is_active").select("kb_id", "chunk_id", *more, F.lower(F.coalesce("content", F.lit(""))).alias("content"))
    own = rows.drop("content").schema.fieldNames()
    schema = T.StructType([*rows.drop("content").schema]).add("term", "string").add("tf", "long").add("doc_len", "long").add("head", "boolean")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, COUNTED_ROWS) for at in range(0, len(batch), COUNTED_ROWS)):
                found = [TERM.findall(text) for text in part["content"].to_pylist()]
                tf = [Counter(terms) for terms in found]
                sizes = np.array([len(t) for t in tf])
                head = np.zeros(sizes.sum(), dtype=bool)
                head[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
                at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                lengths = np.repeat(np.array([len(terms) for terms in found], dtype=np.int64), sizes)
                counted = [pa.array([term for t in tf for term in t], pa.string()), pa.array([n for t in tf for n in t.values()], pa.int64()), pa.array(lengths), pa.array(head)]
                yield pa.RecordBatch.from_arrays([*(part[c].take(at) for c in own), *counted], [*own, "term", "tf", "doc_len", "head"])

    return rows.mapInArrow(count, schema).select("kb_id", "term", "chunk_id", *more, "tf", "doc_len", "head")


def index_stats(postings: DataFrame) -> DataFrame:
    """One row: number of chunks and their mean length, from the chunks' heads."""
    return postings.where("head").agg(F.count(F.lit(1)).alias("n"), F.avg("doc_len").alias("avgdl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, kb_id, term of questions, each term once."""
    return queries.select("query_id", "kb_id", F.explode(F.array_distinct(F.transform(fts_query_terms(F.col("question")), F.lower))).alias("term"))


#: Postings, in limits, that give the first bound of a query's scores, and the slack of bounds, for scores have six places.
FIRST_POSTINGS, SLACK = 20, 1e-5


def _weighed(asked: DataFrame, hits: DataFrame, totals: DataFrame, df: DataFrame | None) -> DataFrame:
    """query_id, kb_id, term, idf, avgdl, most (the term's largest part of a score in the query's scope) and n_hits (its postings there)."""
    one = hits.crossJoin(F.broadcast(totals.select("avgdl")))
    tops = materialised(one.groupBy("term", "kb_id").agg(F.count(F.lit(1)).alias("n_hits"), F.max(_part(F.lit(1.0))).alias("top")))
    df = tops.groupBy("term").agg(F.sum("n_hits").alias("df")) if df is None else df.join(asked.select("term").distinct(), "term", "left_semi")
    idf = df.crossJoin(F.broadcast(totals)).select("term", "avgdl", F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF)).alias("idf"))
    scopes = tops.where("kb_id is not null").unionByName(tops.groupBy("term").agg(F.lit(None).cast(tops.schema["kb_id"].dataType).alias("kb_id"), F.sum("n_hits").alias("n_hits"), F.max("top").alias("top")))
    here = (F.col("a.term") == F.col("s.term")) & F.col("a.kb_id").eqNullSafe(F.col("s.kb_id"))
    return asked.join(idf, "term").alias("a").join(scopes.alias("s"), here).select("a.*", (F.col("a.idf") * F.col("s.top")).alias("most"), "s.n_hits")


def _part(idf: Column) -> Column:
    """What a posting adds to the score of its chunk."""
    return idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avgdl")))


def bm25_search(queries: DataFrame, postings: DataFrame, limit: int = 30, df: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank: the best chunks of each query's kb (of all for a null kb); terms are OR-combined, scores have six places.

    Exact, without scoring every chunk that has a common term. Each term has an upper bound of what it adds in the query's scope. The
    terms that can add most give a first k-th score. Terms whose bounds together stay below that cannot bring a chunk among the first k by
    themselves: their postings are read only for the chunks that other terms have found and that can still reach the k-th score of what these have given.

    ``postings``: a table, read several times; ``df`` (term, df) and ``totals`` (n, avgdl; one row) are counted unless an index keeps them. A query without
    a kb and its own terms meet postings of all kbs, and only where there is such a query.
    """
    asked = materialised(query_terms(queries))
    hits = postings.join(asked.select("term").distinct(), "term", "left_semi")
    own = materialised(_weighed(asked, hits, index_stats(postings) if totals is None else totals.select("n", "avgdl"), df))
    falling = Window.partitionBy("query_id").orderBy(F.desc("most"), "term")
    rising = Window.partitionBy("query_id").orderBy("most", F.desc("term"))
    ahead = F.sum("n_hits").over(falling.rowsBetween(Window.unboundedPreceding, -1))
    own = materialised(own.withColumns({"early": F.coalesce(ahead, F.lit(0)) < FIRST_POSTINGS * limit, "below": F.sum("most").over(rising)}))
    scopes = {r[0] for r in own.select(F.col("kb_id").isNull()).distinct().collect()}  # two rows at most

    def parts(terms: DataFrame) -> DataFrame:
        """query_id, chunk_id, score of the chunks that have some of these terms."""
        t = terms.select("query_id", "term", F.col("kb_id").alias("kb"), "idf", "avgdl")
        joins = {False: lambda: postings.join(t.where("kb is not null"), (postings["term"] == t["term"]) & (postings["kb_id"] == t["kb"])), True: lambda: postings.join(t.where("kb is null"), postings["term"] == t["term"])}
        found = [joins[every]().select("query_id", "chunk_id", _part(F.col("idf")).alias("part")) for every in sorted(scopes)]
        return reduce(DataFrame.unionByName, found).groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"))

    if not scopes:
        return ranked(queries.join(hits, F.lit(False)).select("query_id", "chunk_id", F.lit(0.0).alias("score")), most=limit)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    kth = parts(own.where("early")).withColumn("n", F.row_number().over(best)).where(F.col("n") == limit).select("query_id", (F.col("score") - SLACK).alias("least"))
    own = materialised(own.join(kth, "query_id", "left").withColumn("light", F.coalesce(F.col("below") < F.col("least"), F.lit(False))))
    rest = own.groupBy("query_id").agg(F.sum(F.when(F.col("light"), F.col("most")).otherwise(0.0)).alias("rest"), F.coalesce(F.max("least"), F.lit(0.0)).alias("least"))
    found = materialised(parts(own.where("not light")).join(rest, "query_id").where("score + rest >= least").select("query_id", "chunk_id", "score", "rest"))
    higher = found.withColumn("n", F.row_number().over(best)).where(F.col("n") == limit).select("query_id", (F.col("score") - SLACK).alias("least"))
    found = materialised(found.join(higher, "query_id", "left").where("least is null or score + rest >= least").select("query_id", "chunk_id", "score"))
    light = own.where("light").select("query_id", "term", "idf", "avgdl")
    # only postings of found chunks meet them, so that where these are few the others are not shuffled
    near = postings.select("term", "chunk_id", "tf", "doc_len").join(light.select("term").distinct(), "term", "left_semi").join(found.select("chunk_id").distinct(), "chunk_id", "left_semi")
    more = found.select("query_id", "chunk_id").join(light, "query_id").join(near, ["term", "chunk_id"]).select("query_id", "chunk_id", _part(F.col("idf")).alias("score"))
    return ranked(found.unionByName(more).groupBy("query_id", "chunk_id").agg(F.round(F.sum("score"), 6).alias("score")), most=limit)


def fts_sync_diff(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """chunk_id, action: delete (gone or inactive), insert (active, not indexed), refresh (other content); contents meet as hashes."""
    c = chunks.select("chunk_id", "is_active", F.xxhash64("content").alias("now"))
    i = index.select("chunk_id", F.lit(True).alias("indexed"), F.xxhash64("content").alias("then"))
    both = c.join(i, "chunk_id", "full_outer")
    active = F.coalesce("is_active", F.lit(False))
    action = F.when(F.col("indexed") & ~active, "delete").when(F.col("indexed").isNull() & active, "insert").when(F.col("now") != F.col("then"), "refresh")
    return both.select("chunk_id", action.alias("action")).where("action is not null")


def variant_search(anchors: DataFrame, postings: DataFrame, per_variant: int = 3, limit: int = 10) -> DataFrame:
    """query_id, chunk_id, rank, score: full-text hits of the variants of anchors (query_id, kb_id, a, anchor), in the order first seen; score 1 - 0.04 i."""
    parts = anchors.select("query_id", "kb_id", "a", F.posexplode(search_variants(F.col("anchor"))).alias("v", "question"))
    sub = parts.withColumn("sub_id", F.struct("query_id", "a", "v"))
    found = bm25_search(sub.select(F.col("sub_id").alias("query_id"), "kb_id", "question"), postings, per_variant)
    rows = found.select("query_id.query_id", "chunk_id", F.struct("query_id.a", "query_id.v", "rank").alias("at"))
    first = rows.groupBy("query_id", "chunk_id").agg(F.min("at").alias("at"))
    seen = first.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "chunk_id")) - 1).where(F.col("i") < limit)
    return seen.select("query_id", "chunk_id", (F.col("i") + 1).alias("rank"), F.round(1 - 0.04 * F.col("i"), 6).alias("score"))


def anchor_search(queries: DataFrame, postings: DataFrame, per_variant: int = 3, limit: int = 10) -> DataFrame:
    """``variant_search`` of each question's quoted anchors."""
    return variant_search(queries.select("query_id", "kb_id", F.posexplode(quote_anchors(F.col("question"))).alias("a", "anchor")), postings, per_variant, limit)


def best_chunks_for_question(questions: DataFrame, chunks: DataFrame, n: int = 2, terms: int = 8) -> DataFrame:
    """Chunks of the question's kb that contain one of its first CJK n-grams, by the share of its CJK characters that they have.

    Both sides meet on the grams themselves, so no pair is tried that shares none, in joins that sort and merge: Spark takes exploded rows to be
    as many bytes as the rows that they come from, and would broadcast them. Of chunks that have the same gram and the same characters only the first ``n`` can be
    among a question's best; and a chunk meets a question ``terms`` times at most, so its best are in its first n * terms meetings.
    """
    grams = lambda c: F.expr(f"flatten(transform(array(4, 3, 2), w -> flatten(transform(regexp_extract_all({c}, '[一-鿿]{{2,}}', 0), r -> if(length(r) >= w, transform(sequence(1, length(r) - w + 1), i -> substring(r, i, w)), array())))))")
    chars = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[一-鿿]"), F.lit(0)))
    asked = questions.select("query_id", "kb_id", F.slice(F.array_distinct(grams("question")), 1, terms).alias("grams"), chars("question").alias("chars"))
    spread = asked.select("query_id", "kb_id", "chars", F.explode("grams").alias("gram"))
    held = chunks.select("chunk_id", "kb_id", F.array_sort(chars("content")).alias("held"), F.explode(F.array_distinct(grams("content"))).alias("gram"))
    held = held.join(spread.select("kb_id", "gram").distinct().hint("merge"), ["kb_id", "gram"], "left_semi")
    alike = F.row_number().over(Window.partitionBy("kb_id", "gram", "held").orderBy("chunk_id"))
    pairs = held.withColumn("at", alike).where(F.col("at") <= n).join(spread.hint("merge"), ["kb_id", "gram"])
    score = F.round(F.size(F.array_intersect("chars", "held")) / F.size("chars"), 4)
    first = ranked(pairs.select("query_id", "chunk_id", score.alias("score")), most=n * terms).drop("rank")
    return ranked(first.distinct(), most=n)


def rel_overlap_ok(question: Column, content: Column, share: float = 0.15, least: int = 3) -> Column:
    """Whether the content has enough of the question's CJK characters."""
    chars = F.array_distinct(F.regexp_extract_all(question, F.lit("[一-鿿]"), F.lit(0)))
    hits = F.size(F.array_intersect(chars, F.regexp_extract_all(content, F.lit("[一-鿿]"), F.lit(0))))
    return (F.size(chars) > 0) & (hits >= least) & (hits / F.size(chars) >= share)
