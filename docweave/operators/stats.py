"""Usage, feedback and quality aggregates over chunks, documents and messages.

Every "now" is an argument ``as_of``. Counts of what may be missing are zero-filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import parse_sources

HIT_BUCKETS = ["0", "1-5", "6-20", ">20"]


def _instant(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def _count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def hit_distribution(chunks: DataFrame) -> DataFrame:
    """kb_id, bucket, n for each of the four buckets; a null count is 0."""
    hits = F.coalesce(F.col("hit_count"), F.lit(0))
    wide = chunks.groupBy("kb_id").agg(
        _count_if(hits <= 0).alias("b0"), _count_if(hits.between(1, 5)).alias("b1"), _count_if(hits.between(6, 20)).alias("b2"), _count_if(hits > 20).alias("b3")
    )
    pairs = ", ".join(f"'{name}', b{i}" for i, name in enumerate(HIT_BUCKETS))
    return wide.selectExpr("kb_id", f"stack(4, {pairs}) as (bucket, n)")


def kb_stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents, chunks and hits per kb; a kb that only one side has gets zeros."""
    d = documents.groupBy("kb_id").agg(F.count(F.lit(1)).alias("n_documents"))
    c = chunks.groupBy("kb_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("hit_count").alias("hits"))
    return d.join(c, "kb_id", "full_outer").fillna(0, ["n_documents", "n_chunks", "hits"])


def stats_overview(documents: DataFrame, chunks: DataFrame, top: int = 8) -> DataFrame:
    """The kbs with most documents, with the totals of all: each side is counted before they meet."""
    d = documents.groupBy("kb_id").agg(F.countDistinct("document_id").alias("n_documents"))
    c = chunks.groupBy("kb_id").agg(F.countDistinct("chunk_id").alias("n_chunks"))
    both = d.join(c, "kb_id", "left").fillna(0, ["n_chunks"])
    every = Window.partitionBy()
    totals = both.withColumns({"total_documents": F.sum("n_documents").over(every), "total_chunks": F.sum("n_chunks").over(every)})
    return totals.orderBy(F.desc("n_documents"), "kb_id").limit(top)


def kb_summary(documents: DataFrame, messages: DataFrame, chunks: DataFrame, tags: DataFrame) -> DataFrame:
    """Documents, conversations, messages, tags and hits of each kb that has documents."""
    out = documents.groupBy("kb_id").agg(F.count(F.lit(1)).alias("n_documents"))
    m = messages.groupBy("kb_id").agg(F.countDistinct("conversation_id").alias("n_conversations"), F.count(F.lit(1)).alias("n_messages"))
    t = tags.groupBy("kb_id").agg(F.countDistinct("tag_id").alias("n_tags"))
    h = chunks.groupBy("kb_id").agg(F.sum("hit_count").alias("hits"))
    for part in (m, t, h):
        out = out.join(part, "kb_id", "left")
    return out.fillna(0)


def exploded_sources(messages: DataFrame) -> DataFrame:
    """message_id, kb_id, created_at, pos, chunk_id, score of the sources of assistant messages."""
    said = messages.where((F.col("role") == "assistant") & F.col("sources").isNotNull())
    spread = said.select("message_id", "kb_id", "conversation_id", "created_at", F.posexplode(parse_sources(F.col("sources"))).alias("pos", "s"))
    return spread.select("message_id", "kb_id", "conversation_id", "created_at", "pos", F.col("s.chunk_id").alias("chunk_id"), F.col("s.score").alias("score"))


def cite_counts(messages: DataFrame) -> DataFrame:
    """How often each chunk is cited."""
    cited = exploded_sources(messages.select("message_id", "kb_id", "conversation_id", "created_at", "role", "sources"))
    return cited.where("chunk_id is not null").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_cites"))


def activity_heatmap(messages: DataFrame, as_of: str, days: int = 30, kb: str | None = None) -> DataFrame:
    """Messages by weekday (Monday is 0) and hour over the last ``days`` (90 at most); only cells with any."""
    since = F.expr(f"timestampadd(DAY, -{min(days, 90)}, cast('{as_of}' as timestamp_ntz))")
    seen = messages.where((F.col("created_at") >= since) & (F.col("created_at") <= _instant(as_of)))
    seen = seen if kb is None else seen.where(F.col("kb_id") == kb)
    return seen.groupBy(F.weekday("created_at").cast("long").alias("weekday"), F.hour("created_at").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def hit_trend(messages: DataFrame, as_of: str, days: int = 7, kb: str | None = None) -> DataFrame:
    """Answers with sources on each of the last ``days`` days (30 at most), days without any as 0."""
    n = min(days, 30)
    said = messages.where((F.col("role") == "assistant") & F.col("sources").isNotNull())
    said = said if kb is None else said.where(F.col("kb_id") == kb)
    counts = said.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    calendar = messages.sparkSession.range(n).selectExpr(f"date_sub(cast('{as_of}' as date), cast(id as int)) as day")
    return calendar.join(counts, "day", "left").fillna(0, ["n"])


def cold_chunks(chunks: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Chunks without hits that are ``days`` old or older."""
    until = F.expr(f"timestampadd(DAY, -{days}, cast('{as_of}' as timestamp_ntz))")
    return chunks.where((F.coalesce("hit_count", F.lit(0)) == 0) & (F.col("created_at") <= until))


def cold_knowledge(chunks: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """cold_old and cold_total for every kb and, with kb_id null, for all."""
    until = F.expr(f"timestampadd(DAY, -{days}, cast('{as_of}' as timestamp_ntz))")
    cold = F.coalesce(F.col("hit_count"), F.lit(0)) == 0
    return chunks.rollup("kb_id").agg(_count_if(cold & (F.col("created_at") <= until)).alias("cold_old"), _count_if(cold).alias("cold_total"))


def stuck_documents(documents: DataFrame, as_of: str, minutes: int = 3) -> DataFrame:
    before = F.expr(f"timestampadd(MINUTE, -{minutes}, cast('{as_of}' as timestamp_ntz))")
    return documents.where((F.col("status") == "processing") & (F.col("created_at") < before))


def previous_user_message(messages: DataFrame) -> DataFrame:
    """For each assistant message: the latest user message of its conversation that is strictly earlier."""
    w = Window.partitionBy("conversation_id").orderBy(F.unix_micros(F.col("created_at").cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    asked = F.when(F.col("role") == "user", F.struct("created_at", "message_id", "content"))
    question = F.max(asked).over(w)
    rows = messages.select("message_id", "conversation_id", "kb_id", "role", "sources", "created_at", question.alias("q"))
    return rows.where("role = 'assistant'").select("message_id", "conversation_id", "kb_id", "sources", "created_at", F.col("q.message_id").alias("question_id"), F.col("q.content").alias("question"))


def immediately_previous_user(messages: DataFrame) -> DataFrame:
    """For each assistant message: the message just before it, if a user wrote that."""
    w = Window.partitionBy("conversation_id").orderBy("created_at", "message_id")
    before = F.lag(F.struct("role", "message_id", "content")).over(w)
    rows = messages.select("message_id", "role", before.alias("b")).where("role = 'assistant'")
    own = F.col("b.role") == "user"
    return rows.select("message_id", F.when(own, F.col("b.message_id")).alias("question_id"), F.when(own, F.col("b.content")).alias("question"))


def rag_sankey(messages: DataFrame, limit: int = 15) -> DataFrame:
    """Links of each kb's last ``limit`` sourced answers: question to chunk (1 each) and chunk to answer (scores, null or 0 as 1), sums of 0.1 at least."""
    answers = previous_user_message(messages).where(F.col("sources").isNotNull())
    last = F.row_number().over(Window.partitionBy("kb_id").orderBy(F.desc("created_at"), F.desc("message_id")))
    recent = answers.withColumn("rn", last).where(F.col("rn") <= limit)
    flows = recent.select("kb_id", "message_id", "question_id", F.explode(F.slice(parse_sources(F.col("sources")), 1, 3)).alias("s"))
    chunk = F.concat(F.lit("c"), F.col("s.chunk_id").cast("string"))
    weight = F.when(F.coalesce(F.col("s.score"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("s.score"))
    ask = flows.where("question_id is not null").select("kb_id", F.concat(F.lit("q"), F.col("question_id").cast("string")).alias("source"), chunk.alias("target"), F.lit(1.0).alias("value"))
    reply = flows.select("kb_id", chunk.alias("source"), F.concat(F.lit("a"), F.col("message_id").cast("string")).alias("target"), weight.alias("value"))
    return ask.unionByName(reply).groupBy("kb_id", "source", "target").agg(F.greatest(F.sum("value"), F.lit(0.1)).alias("value"))


def document_rollup(ingested: DataFrame) -> DataFrame:
    """Of rows (document_id, char_count, gate status): counts and status per document. All duplicates: completed with 0 chunks; nothing: error."""
    allowed = F.col("gate_status") == "allow"
    rows = ingested.groupBy("document_id").agg(
        _count_if(allowed).alias("chunk_count"), F.sum(F.when(allowed, F.col("char_count")).otherwise(0)).alias("char_count"),
        _count_if(F.col("gate_status") == "duplicate").alias("duplicate_count"), _count_if(F.col("gate_status") == "conflict").alias("conflict_count"),
    )
    some = F.col("chunk_count") + F.col("duplicate_count") + F.col("conflict_count") > 0
    return rows.withColumn("status", F.when(some, "completed").otherwise("error"))


def gate_stats(ingested: DataFrame) -> DataFrame:
    """allow, duplicate and conflict counts per document."""
    out = ingested.groupBy("document_id").pivot("gate_status", ["allow", "duplicate", "conflict"]).agg(F.count(F.lit(1)))
    return out.fillna(0, ["allow", "duplicate", "conflict"])


def feedback_counts(feedback: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """Likes, dislikes and corrections of each chunk.

    A row counts for its chunk_ids if it lists any, else for its chunk_id, else for all chunks its message cites.
    """
    have = set(feedback.columns)
    single = F.when(F.col("chunk_id").isNotNull(), F.array(F.col("chunk_id").cast("long")))
    listed = [F.when(F.size("chunk_ids") > 0, F.col("chunk_ids"))] if "chunk_ids" in have else []
    rows = feedback
    cited = []
    if messages is not None and "message_id" in have:
        spread = messages.select("message_id", F.transform(parse_sources(F.col("sources")), lambda s: s["chunk_id"]).alias("cited"))
        rows, cited = rows.join(spread, "message_id", "left"), [F.col("cited")]
    spread = rows.select("feedback_type", F.explode(F.coalesce(*listed, single, *cited)).alias("chunk_id")).where("chunk_id is not null")
    kinds = ["like", "dislike", "correction"]
    counts = spread.groupBy("chunk_id").agg(*[_count_if(F.col("feedback_type") == k).alias(f"{k}_count") for k in kinds])
    return counts


def hit_counts(chunks: DataFrame, returned: DataFrame) -> DataFrame:
    """Chunks with one hit more for each time a search returned them."""
    more = returned.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("more"))
    joined = chunks.join(more, "chunk_id", "left")
    return joined.withColumn("hit_count", F.coalesce("hit_count", F.lit(0)) + F.coalesce("more", F.lit(0))).drop("more")


def quality_score(hits: Column, likes: Column, dislikes: Column, corrections: Column, created_at: Column, as_of: str) -> Column:
    """0.4 usage + 0.3 like rate - 0.2 corrections + 0.1 freshness, in [0, 1], to four places."""
    zero = F.lit(0)
    h, li, di, co = (F.coalesce(c, zero) for c in (hits, likes, dislikes, corrections))
    days = F.floor((F.unix_seconds(_instant(as_of).cast("timestamp")) - F.unix_seconds(created_at.cast("timestamp"))) / 86400)
    fresh = F.when(created_at.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - days / 365.0))
    rate = F.when(li + di > 0, li / (li + di)).otherwise(0.5)
    raw = 0.4 * F.least(h / 20.0, F.lit(1.0)) + 0.3 * rate - 0.2 * F.least(co / F.greatest(h, F.lit(1)), F.lit(1.0)) + 0.1 * fresh
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4)


def recalculate_quality(chunks: DataFrame, counts: DataFrame, as_of: str) -> DataFrame:
    """chunk_id, quality_score, needs_review of every chunk."""
    joined = chunks.select("chunk_id", "hit_count", "created_at").join(counts, "chunk_id", "left")
    score = quality_score(F.col("hit_count"), F.col("like_count"), F.col("dislike_count"), F.col("correction_count"), F.col("created_at"), as_of)
    review = (F.col("quality_score") < 0.25) | (F.coalesce("dislike_count", F.lit(0)) >= 3)
    return joined.withColumn("quality_score", score).select("chunk_id", "quality_score", review.alias("needs_review"), *[F.coalesce(f"{k}_count", F.lit(0)).alias(f"{k}_count") for k in ("like", "dislike", "correction")])


def suggestion_status_counts(suggestions: DataFrame) -> DataFrame:
    """The five statuses of each kb, zero-filled."""
    states = ["pending", "approved", "dismissed", "executed", "verified"]
    return suggestions.groupBy("kb_id").pivot("status", states).agg(F.count(F.lit(1))).fillna(0, states)


def kb_health(chunks: DataFrame, quality: DataFrame, gaps: DataFrame, conflicts: DataFrame, as_of: str) -> DataFrame:
    """attention_score of each kb: cold chunks, open gaps, pending conflicts, chunks to review; healthy at 0, attention below 10, else critical.

    A gap's kb may be the full id or the part before its first hyphen.
    """
    base = chunks.groupBy("kb_id").agg(F.count(F.lit(1)).alias("total_chunks"), _count_if(F.col("is_active")).alias("active_chunks"))
    cold = cold_chunks(chunks, as_of).groupBy("kb_id").agg(F.count(F.lit(1)).alias("cold"))
    review = chunks.select("chunk_id", "kb_id").join(quality.where("needs_review").select("chunk_id"), "chunk_id", "left_semi").groupBy("kb_id").agg(F.count(F.lit(1)).alias("review"))
    open_gaps = gaps.where(F.col("status").isin("pending", "suggested", "manual_required")).groupBy("kb_id").agg(F.count(F.lit(1)).alias("n"))
    full = base.select("kb_id", F.explode(F.array_distinct(F.array(F.col("kb_id"), F.substring_index("kb_id", "-", 1)))).alias("alias"))
    gap = full.join(open_gaps.withColumnRenamed("kb_id", "alias"), "alias").groupBy("kb_id").agg(F.sum("n").alias("open_gaps"))
    fight = conflicts.where("status = 'pending'").groupBy("kb_id").agg(F.count(F.lit(1)).alias("pending_conflicts"))
    out = base
    for part in (cold, gap, fight, review):
        out = out.join(part, "kb_id", "left")
    out = out.fillna(0)
    score = F.col("cold") + F.col("open_gaps") + F.col("pending_conflicts") + F.col("review")
    return out.withColumn("attention_score", score).withColumn("level", F.when(score == 0, "healthy").when(score < 10, "attention").otherwise("critical"))


def top_chunks(chunks: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` chunks with most hits of each kb."""
    rank = F.row_number().over(Window.partitionBy("kb_id").orderBy(F.desc("hit_count"), "chunk_id"))
    return chunks.where("hit_count > 0").select("kb_id", "chunk_id", "hit_count", rank.cast("long").alias("rank")).where(F.col("rank") <= n)


def cite_vs_hit(chunks: DataFrame, cites: DataFrame, limit: int = 10) -> DataFrame:
    """The chunks with most hits (the newest first of equal ones) and how often they are cited; without hits anywhere, those cited most."""
    joined = chunks.join(cites, "chunk_id", "left").fillna(0, ["n_cites"])
    any_hit = chunks.agg((F.max("hit_count") > 0).alias("any_hit"))  # one row
    key = F.when(F.col("any_hit"), F.col("hit_count")).otherwise(F.col("n_cites"))
    rows = joined.crossJoin(F.broadcast(any_hit)).select("chunk_id", F.substring("content", 1, 24).alias("label"), "hit_count", "n_cites", "created_at", key.alias("k"))
    return rows.where("k > 0").orderBy(F.desc("k"), F.desc("created_at"), "chunk_id").limit(limit).select("chunk_id", "label", "hit_count", "n_cites")


def low_quality_top(chunks: DataFrame, quality: DataFrame, limit: int = 20) -> DataFrame:
    """Each kb's chunks to review, worst first."""
    rank = F.row_number().over(Window.partitionBy("kb_id").orderBy("quality_score", "chunk_id"))
    return chunks.select("chunk_id", "kb_id").join(quality.where("needs_review"), "chunk_id").select("kb_id", "chunk_id", "quality_score", rank.cast("long").alias("rank")).where(F.col("rank") <= limit)


def conversation_title(messages: DataFrame, most: int = 30) -> DataFrame:
    """The first user message of each conversation as its title, on one line."""
    first = F.min_by("content", F.struct("created_at", "message_id"))
    return messages.where("role = 'user'").groupBy("conversation_id").agg(first.alias("c")).select("conversation_id", F.substring(F.trim(F.translate("c", "\n\r", "  ")), 1, most).alias("title"))


def recent_turn(messages: DataFrame) -> DataFrame:
    """The latest two messages of each conversation as its last question and answer."""
    rn = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("message_id")))
    two = messages.select("conversation_id", "role", "content", rn.alias("rn")).where("rn <= 2")
    return two.groupBy("conversation_id").agg(F.min_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.col("rn"))).alias("user_text"), F.min_by(F.when(F.col("role") == "assistant", F.col("content")), F.when(F.col("role") == "assistant", F.col("rn"))).alias("assistant_text"))


def compress_history(messages: DataFrame, recent_turns: int = 2, cap: int = 600) -> DataFrame:
    """Each conversation's history: its last turns whole, what is older as one line of snippets; with the share of characters saved.

    A snippet has 50 characters where more than eight messages are older, else 80.
    """
    keep = max(2, 2 * recent_turns)
    order = Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("message_id"))
    ranked = messages.select("conversation_id", "role", "content", F.row_number().over(order).alias("rn"), F.count(F.lit(1)).over(Window.partitionBy("conversation_id")).alias("n"))
    older = F.col("rn") > keep
    short = F.concat("role", F.lit(": "), F.expr("substring(regexp_replace(content, '\\\\n', ' '), 1, case when n - {0} > 8 then 50 else 80 end)".format(keep)))
    rows = ranked.groupBy("conversation_id").agg(
        F.array_sort(F.collect_list(F.when(older, F.struct((-F.col("rn")).alias("o"), short.alias("t"))))).alias("old"),
        F.array_sort(F.collect_list(F.when(~older, F.struct((-F.col("rn")).alias("o"), F.concat("role", F.lit(": "), "content").alias("t"))))).alias("new"),
        F.sum(F.length("content")).alias("before"),
    )
    line = F.array_join(F.transform("old", lambda x: x["t"]), "\n")
    capped = F.when(F.length(line) > cap, F.concat(F.substring(line, 1, cap), F.lit("…"))).otherwise(line)
    out = rows.select("conversation_id", F.size("old").cast("long").alias("n_older"), capped.alias("summary"), F.array_join(F.transform("new", lambda x: x["t"]), "\n").alias("recent"), "before")
    after = F.length("summary") + F.length("recent")
    return out.withColumn("savings_ratio", F.round(F.greatest(F.lit(0.0), 1 - after / F.greatest("before", F.lit(1))), 4)).drop("before")


def metric_trend(runs: DataFrame, metric: str, limit: int = 20, version: str | None = None) -> DataFrame:
    """The newest runs' values of a metric, oldest first. ``runs``: run_id, dataset_version, created_at, aggregate_json."""
    aliases = {"context_recall": "recall", "context_precision": "precision", "hit": "hit_rate"}
    name = aliases.get(metric, metric)
    own = runs if version is None else runs.where(F.col("dataset_version") == version)
    value = F.from_json("aggregate_json", "map<string,double>")[name]
    newest = own.select("run_id", "created_at", value.alias("value")).where("value is not null").orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)
    return newest.orderBy("created_at", "run_id")
