"""Governance scans, queues and state changes, as batch jobs over tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import has_no_info_phrase, looks_like_user_fact
from docweave.operators.common import materialised
from docweave.operators.stats import cold_chunks

COLD_DAYS, ABSENT_SCORE = 90, 0.2
#: Characters of a content that a suggestion shows.
PREVIEW = 120
#: Transitions by event: the status it needs and the one it leads to.
FORWARD = {"approve": ("pending", "approved"), "dismiss": ("pending", "dismissed"), "execute": ("approved", "executed"), "verify": ("executed", "verified")}
#: Where a rollback leads from each status.
ROLLBACK = {"approved": "pending", "executed": "approved", "verified": "executed", "dismissed": "pending"}
NO_ANSWER = ["暂无相关信息", "暂无相关内容", "知识库中暂无", "no relevant information"]


def chunk_refs(chunk_ids: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """chunk_id with document_id, filename, chunk_index, is_active, preview; missing ids are left out."""
    own = chunks.select("chunk_id", "document_id", "chunk_index", "is_active", F.substring("content", 1, 80).alias("preview"))
    return chunk_ids.select("chunk_id").distinct().join(own, "chunk_id").join(documents.select("document_id", "filename"), "document_id")


#: Places in lists that one row of a reference meets; an id that stands in more is dealt into shares of about as many.
SHARE = 50_000


def explode_refs(suggestions: DataFrame, refs: DataFrame) -> DataFrame:
    """suggestion_id with refs, an array in the order of its chunk_ids.

    Places and references meet on (chunk_id, share): the places of an id that very many lists have, found or not, are shares, and its reference stands once for each.
    """
    spread = suggestions.select("suggestion_id", F.posexplode_outer("chunk_ids").alias("pos", "chunk_id"))
    hot = materialised(spread.groupBy("chunk_id").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares")).where("shares > 1"))
    same = F.col("s.chunk_id").eqNullSafe(F.col("h.chunk_id"))
    share = F.when(F.col("shares") > 1, F.pmod(F.xxhash64("suggestion_id", "pos"), F.col("shares"))).otherwise(F.lit(0)).cast("int")
    dealt = spread.alias("s").join(hot.alias("h"), same, "left").select("s.*", share.alias("share"))
    copied = refs.join(hot, "chunk_id", "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)))
    found = dealt.join(copied, ["chunk_id", "share"], "left").withColumn("r", F.when(F.col("document_id").isNotNull(), F.struct("pos", "chunk_id", "filename", "preview")))
    return found.groupBy("suggestion_id").agg(F.array_sort(F.collect_list("r")).alias("refs"))


def tag_map(documents: DataFrame, bridge: DataFrame, tags: DataFrame) -> DataFrame:
    """document_id with its tag names, sorted; without tags an empty array."""
    named = bridge.join(tags.select("tag_id", "name"), "tag_id").groupBy("document_id").agg(F.array_sort(F.collect_set("name")).alias("tags"))
    return documents.select("document_id").join(named, "document_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def resolve_kb_id(refs: DataFrame, kbs: DataFrame) -> DataFrame:
    """ref, kb_id, problem: the id that a reference is, else the only one that begins with it; ambiguous, missing and blank ones say so.

    White space around a reference does not count. The lengths that are asked, no more than the longest id has, are one row; each id gives its
    beginnings of these lengths, and they meet the references as equals.
    """
    asked = refs.select("ref").distinct().withColumn("asked", F.regexp_replace(F.coalesce("ref", F.lit("")), "^\\s+|\\s+$", ""))
    asked = materialised(asked)
    ids = kbs.select("kb_id").where("kb_id is not null").distinct()
    longest = ids.agg(F.max(F.length("kb_id")).alias("longest"))
    lengths = asked.where("asked <> ''").select(F.length("asked").alias("n")).distinct().crossJoin(F.broadcast(longest)).where("n <= longest").agg(F.array_sort(F.collect_set("n")).alias("lengths"))
    spread = ids.crossJoin(F.broadcast(lengths)).select("kb_id", F.explode(F.filter("lengths", lambda n: n <= F.length("kb_id"))).alias("n"))
    begin = spread.select("kb_id", F.expr("substring(kb_id, 1, n)").alias("asked"))
    found = begin.join(asked.select("asked").distinct(), "asked", "left_semi").groupBy("asked").agg(F.count(F.lit(1)).alias("n"), F.min("kb_id").alias("only"), F.max(F.when(F.col("kb_id") == F.col("asked"), F.col("kb_id"))).alias("exact"))
    joined = asked.join(found, "asked", "left")
    kb = F.coalesce("exact", F.when(F.col("n") == 1, F.col("only")))
    problem = F.when(kb.isNotNull(), F.lit(None)).when(F.col("asked") == "", "blank").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return joined.select("ref", kb.alias("kb_id"), problem.alias("problem"))


def rewrite_kb_ids(tables: dict[str, tuple[DataFrame, str]], kbs: DataFrame) -> dict[str, DataFrame]:
    """The tables, each given with the name of its kb column, with full ids there where they can be told; all references are resolved at once."""
    refs = reduce(DataFrame.unionByName, [df.select(F.col(c).alias("ref")).distinct() for df, c in tables.values()])
    known = materialised(resolve_kb_id(refs, kbs).where("kb_id is not null and kb_id <> ref").select("ref", F.col("kb_id").alias("full")))

    def one(df: DataFrame, column: str) -> DataFrame:
        named = known.toDF("__ref", "__full")
        return df.join(named, F.col(column) == F.col("__ref"), "left").withColumn(column, F.coalesce("__full", column)).drop("__ref", "__full")

    return {name: one(df, c) for name, (df, c) in tables.items()}


def new_only(rows: DataFrame, existing: DataFrame, keys: list[str], open_states: list[str] | None = None) -> DataFrame:
    """Rows whose key no open row of ``existing`` has, each key once (the smallest row)."""
    held = existing if open_states is None else existing.where(F.col("status").isin(open_states))
    fresh = rows.join(held.select(*keys).distinct(), keys, "left_anti")
    rest = [c for c in rows.columns if c not in keys]
    return fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*") if rest else fresh.distinct()


def filter_queue(rows: DataFrame, status: str | None = None, kind: str | None = None, type_column: str = "suggestion_type", limit: int = 50, offset: int = 0, key: str = "suggestion_id") -> DataFrame:
    """A page of a queue, newest first, with the total of all that match."""
    own = rows if status is None else rows.where(F.col("status") == status)
    own = own if kind is None else own.where(F.col(type_column) == kind)
    total = own.agg(F.count(F.lit(1)).alias("total"))
    page = own.orderBy(F.desc("created_at"), F.desc(key)).offset(offset).limit(limit)
    return page.withColumn("__one", F.lit(1)).join(total.withColumn("__one", F.lit(1)), "__one").drop("__one")


def scan_suggestions(chunks: DataFrame, documents: DataFrame, quality: DataFrame, duplicates: DataFrame, as_of: str, most_cold: int = 50) -> DataFrame:
    """kb_id, type, chunk_ids (sorted), title, action, severity, preview: cold and stale, quality and duplicate suggestions.

    ``duplicates``: kb_id, a, b, similarity. Of the quality rules the first that fits counts. Of contents the first PREVIEW characters are read.
    """
    alive = chunks.where("is_active").join(documents.select("document_id", "filename"), "document_id")
    place = F.concat("filename", F.lit(" · 第 "), F.col("chunk_index").cast("string"), F.lit(" 段"))
    ids = F.array(F.col("chunk_id").cast("string"))
    preview = F.substring("content", 1, PREVIEW)
    oldest = F.row_number().over(Window.partitionBy("kb_id").orderBy("created_at", "chunk_id"))
    cold = cold_chunks(alive, as_of, COLD_DAYS).withColumn("rn", oldest).where(F.col("rn") <= most_cold)
    parts = [cold.select("kb_id", F.lit("cold_stale").alias("type"), ids.alias("chunk_ids"), place.alias("title"), F.lit("archive").alias("action"), F.lit("warning").alias("severity"), preview.alias("preview"))]
    q = alive.join(quality.select("chunk_id", "quality_score", "needs_review"), "chunk_id")
    hits = F.coalesce("hit_count", F.lit(0))
    kind = F.when(F.col("needs_review") & (hits > 0), "low_quality").when((F.col("quality_score") >= 0.65) & (hits == 0), "high_quality_zero_hit").when((F.col("quality_score") < 0.25) & (hits == 0), "archive_candidate")
    suffix = F.when(F.col("type") == "low_quality", "（低质量）").when(F.col("type") == "high_quality_zero_hit", "（零命中）").otherwise("（归档候选）")
    action = F.when(F.col("type") == "low_quality", "deactivate").when(F.col("type") == "high_quality_zero_hit", "boost_faq").otherwise("archive")
    severity = F.when(F.col("type") == "low_quality", "error").when(F.col("type") == "high_quality_zero_hit", "info").otherwise("warning")
    parts.append(q.withColumn("type", kind).where("type is not null").select("kb_id", "type", ids.alias("chunk_ids"), F.concat(place, suffix).alias("title"), action.alias("action"), severity.alias("severity"), preview.alias("preview")))
    names = alive.select(F.col("chunk_id"), place.alias("place"), F.substring("content", 1, 60).alias("p"))
    a, b = names.toDF("a", "place_a", "p_a"), names.toDF("b", "place_b", "p_b")
    pair = F.array_sort(F.array(F.col("a").cast("string"), F.col("b").cast("string")))
    parts.append(duplicates.join(a, "a").join(b, "b").select("kb_id", F.lit("duplicate").alias("type"), pair.alias("chunk_ids"), F.concat("place_a", F.lit(" 与 "), "place_b", F.lit(" 疑似重复")).alias("title"), F.lit("merge").alias("action"), F.lit("warning").alias("severity"), F.concat("p_a", F.lit(" … / "), "p_b").alias("preview")))
    return reduce(DataFrame.unionByName, parts)


def new_suggestions(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Suggestions that no pending one of the same kb, type and chunks covers. ``stored``: kb_id, type, chunk_ids, status."""
    return new_only(found, stored, ["kb_id", "type", "chunk_ids"], ["pending"])


def replaced_chunks(chunks: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """The chunks after some documents were read anew."""
    return chunks.join(changed.select("document_id").distinct(), "document_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def apply_transitions(suggestions: DataFrame, events: DataFrame) -> DataFrame:
    """suggestion_id, status, audit (an entry for each legal event), after the events (suggestion_id, seq, event) in order; illegal ones change nothing."""
    steps = events.groupBy("suggestion_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "event"))), lambda e: e["event"]).alias("events"))
    rows = suggestions.select("suggestion_id", "status").join(steps, "suggestion_id", "left").withColumn("events", F.coalesce("events", F.array().cast("array<string>")))
    cases = [(F"e = '{e}' and s.status = '{a}'", b) for e, (a, b) in FORWARD.items()] + [(f"e = 'rollback' and s.status = '{a}'", b) for a, b in ROLLBACK.items()]
    to = "case " + " ".join(f"when {c} then '{b}'" for c, b in cases) + " end"
    fold = F.expr(
        "aggregate(events, named_struct('status', status, 'audit', cast(array() as array<string>)), "
        f"(s, e) -> transform(array({to}), n -> if(n is null, s, named_struct('status', n, 'audit', concat(s.audit, array(concat(e, ':', s.status, '>', n))))))[0])"
    )
    return rows.withColumn("f", fold).select("suggestion_id", F.col("f.status").alias("status"), F.col("f.audit").alias("audit"))


def apply_actions(chunks: DataFrame, quality: DataFrame, executed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, quality) after executed suggestions (action, chunk_ids): archive and deactivate switch off, boost_faq adds 0.15 and ends the review."""
    spread = executed.select("action", F.explode("chunk_ids").alias("chunk_id"))
    off = spread.where(F.col("action").isin("archive", "deactivate")).select("chunk_id").distinct().withColumn("off", F.lit(True))
    up = spread.where("action = 'boost_faq'").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_up"))
    c = chunks.join(off, "chunk_id", "left").withColumn("is_active", F.col("is_active") & F.col("off").isNull()).drop("off")
    q = quality.join(up, "chunk_id", "full_outer")
    score = F.coalesce("quality_score", F.lit(0.5))
    q = q.withColumn("quality_score", F.when(F.col("n_up").isNotNull(), F.round(F.least(F.lit(1.0), score + 0.15 * F.col("n_up")), 4)).otherwise(score))
    return c, q.withColumn("needs_review", F.coalesce("needs_review", F.lit(False)) & F.col("n_up").isNull()).drop("n_up")


def resolve_conflicts(conflicts: DataFrame, decisions: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conflicts, new chunks): only pending ones change; keep_new makes a chunk, of the source document or else the existing chunk's."""
    new_id = F.sha2(F.concat(F.lit("conflict-"), F.col("conflict_id").cast("string")), 256)
    joined = conflicts.join(decisions.select("conflict_id", "decision"), "conflict_id", "left").join(chunks.select(F.col("chunk_id").alias("existing_chunk_id"), F.col("document_id").alias("existing_document_id")), "existing_chunk_id", "left")
    ok = (F.col("status") == "pending") & F.col("decision").isin("resolved_keep_new", "resolved_keep_old", "dismissed") & ((F.col("decision") != "resolved_keep_new") | F.col("existing_document_id").isNotNull())
    made = joined.where(ok & (F.col("decision") == "resolved_keep_new"))
    fresh = made.select(new_id.alias("chunk_id"), F.coalesce("source_document_id", "existing_document_id").alias("document_id"), "kb_id", F.col("new_content").alias("content"), F.lit(0).alias("chunk_index"), F.length("new_content").alias("char_count"))
    after = joined.withColumn("resolved_chunk_id", F.when(ok & (F.col("decision") == "resolved_keep_new"), new_id)).withColumn("status", F.when(F.coalesce(ok, F.lit(False)), F.col("decision")).otherwise(F.col("status")))
    return after.select("conflict_id", "kb_id", "existing_chunk_id", "status", "resolved_chunk_id"), fresh


def toggle_documents(documents: DataFrame, chunks: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) with is_active as in ``changes`` (document_id, active)."""
    new = changes.select("document_id", "active")
    flip = lambda df: df.join(new, "document_id", "left").withColumn("is_active", F.coalesce("active", "is_active")).drop("active")
    return flip(documents), flip(chunks)


def delete_documents(ids: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """The tables without the rows of some documents."""
    gone = ids.select("document_id").distinct()
    return [t.join(gone, "document_id", "left_anti") for t in tables]


def consistency_shortcuts(pairs: DataFrame, least: float = 0.15) -> DataFrame:
    """pair_id, verdict: what can be told of two answers (and a third from memory) without a judge; else needs_judge."""
    a, b, p = (F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("answer_a", "answer_b", "answer_param"))
    chars = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[一-鿿]"), F.lit(0)))
    declines = lambda c: reduce(lambda x, y: x | y, [c.contains(w) for w in NO_ANSWER])
    share = F.size(F.array_intersect(chars(a), chars(p))) / F.greatest(F.size(chars(a)), F.lit(1))
    clash = (p != "") & ~declines(a) & ~declines(p) & (F.size(chars(a)) > 0) & (F.size(chars(p)) > 0) & (share < least)
    return pairs.select("pair_id", F.when((a == "") | (b == ""), "UNCERTAIN").when(a == b, "OK").when(clash, "CONFLICT").otherwise("needs_judge").alias("verdict"))


def classify_gap(correction: Column, message: Column, max_score: Column, weak_hit: Column) -> Column:
    """``max_score`` is null where nothing was found."""
    corrected = F.length(F.trim(F.coalesce(correction, F.lit("")))) > 0
    absent = max_score.isNull() | (max_score < ABSENT_SCORE)
    return F.when(corrected, "USER_CORRECTION").when(looks_like_user_fact(message), "USER_PROVIDED").when(absent & ~F.coalesce(weak_hit, F.lit(False)), "KNOWLEDGE_ABSENT").otherwise("RETRIEVAL_MISS")


def enqueue_gaps(turns: DataFrame, stored: DataFrame) -> DataFrame:
    """kb_id, query, gap_type, status, source_ref of turns that show a gap, once a kb and query, unless an open gap has it.

    ``turns``: kb_id, query, message, answer, correction, sources (array of structs in rank order), max_score, weak_hit,
    sufficient, refused.
    """
    kind = classify_gap(F.col("correction"), F.col("message"), F.col("max_score"), F.col("weak_hit"))
    silent = has_no_info_phrase(F.col("answer"))
    typed = turns.withColumn("gap_type", kind)
    user = F.col("gap_type").isin("USER_CORRECTION", "USER_PROVIDED")
    satisfied = F.col("sufficient") & ~F.col("refused") & ~user & ~silent
    poor = F.col("max_score").isNull() | (F.col("max_score") < ABSENT_SCORE) | silent
    status = F.when(F.col("gap_type") == "KNOWLEDGE_ABSENT", "manual_required").when(user, "suggested").otherwise("pending")
    rows = typed.where(~satisfied & (user | poor)).select("kb_id", "query", "gap_type", status.alias("status"), F.to_json(F.slice("sources", 1, 5)).alias("source_ref"))
    return new_only(rows, stored, ["kb_id", "query"], ["pending", "suggested", "manual_required"])


def feedback_to_gaps(feedback: DataFrame, questions: DataFrame) -> DataFrame:
    """Gaps from dislikes and corrections. ``questions``: message_id, question, answer; without a question the answer's start stands in."""
    kind = F.when(F.col("feedback_type") == "dislike", "RETRIEVAL_MISS").when(F.col("feedback_type") == "correction", "USER_CORRECTION")
    rows = feedback.withColumn("gap_type", kind).where("gap_type is not null").join(questions, "message_id", "left")
    return rows.select("message_id", "gap_type", F.coalesce("question", F.substring("answer", 1, 200)).alias("query"))


def source_ref_ok(ref: Column, user: Column, assistant: Column) -> Column:
    """Whether a reference of four characters or more stands in a message, or its first twelve do if it has eight."""
    r = F.trim(F.coalesce(ref, F.lit("")))
    whole = user.contains(r) | assistant.contains(r)
    start = F.substring(r, 1, 12)
    return (F.length(r) >= 4) & (whole | ((F.length(r) >= 8) & (user.contains(start) | assistant.contains(start))))
