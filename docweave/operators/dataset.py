"""Building and repairing evaluation datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import extract_term, first_sentence
from docweave.operators.graph import multi_hop_pairs
from docweave.operators.search import best_chunks_for_question, rel_overlap_ok

#: Question templates.
FACT_TEMPLATES = ["{}是什么？", "介绍一下{}。", "{}有哪些要点？", "文档里关于{}说了什么？"]
CONCEPT_TEMPLATES = ["请解释{}的含义。", "{}有什么特点？", "如何理解{}？"]
UNRELATED = ["量子纠缠实验的具体操作步骤是什么？", "CRISPR 基因编辑的详细实验流程是怎样的？", "火星殖民基地的建设方案有哪些？", "深海热泉生态系统的完整分类学报告？"]
WRONG_TERMS = ["React 18 Suspense 源码", "量子纠缠", "CRISPR", "火星基地"]
BANNED = ["根据本知识库", "本知识库内容", "知识库中关于「本知识库"]
NOTHING_KNOWN = "知识库中暂无相关信息。"


def _filled(templates: list[str], n: Column, term: Column) -> Column:
    parts = [F.concat(F.lit(t.split("{}")[0]), term, F.lit(t.split("{}")[1])) for t in templates]
    return F.element_at(F.array(*parts), (n % len(templates) + 1).cast("int"))


def kb_selection(chunks: DataFrame, least: int = 30, kbs: int = 5, per_kb: int = 80) -> DataFrame:
    """The ``per_kb`` active chunks with most hits of the ``kbs`` largest kbs of ``least`` chunks or more."""
    size = chunks.groupBy("kb_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "kb_id").limit(kbs)
    own = chunks.where("is_active").join(size.select("kb_id"), "kb_id")
    rank = F.row_number().over(Window.partitionBy("kb_id").orderBy(F.desc("hit_count"), "chunk_index", "chunk_id"))
    return own.withColumn("rn", rank).where(F.col("rn") <= per_kb)


def supporting_chunk(chunks: DataFrame) -> DataFrame:
    """chunk_id, supporting_id: of the same document the first chunk by index at most two places away, else the first other.

    The smaller indices within reach come first, then those of the chunk's own index, then the larger ones.
    """
    by_index = Window.partitionBy("document_id").orderBy("chunk_index")
    reach = lambda lo, hi: F.min(F.struct("chunk_index", "chunk_id")).over(by_index.rangeBetween(lo, hi))["chunk_id"]
    tied, whole = Window.partitionBy("document_id", "chunk_index").orderBy("chunk_id"), Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id")

    def other(w) -> Column:
        first, second = (F.nth_value("chunk_id", i).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for i in (1, 2))
        return F.when(first != F.col("chunk_id"), first).otherwise(second)

    return chunks.select("chunk_id", F.coalesce(reach(-2, -1), other(tied), reach(1, 2), other(whole)).alias("supporting_id"))


def build_eval_samples(chunks: DataFrame, relations: DataFrame, facts: int = 16, concepts: int = 6, hops: int = 10, negatives: int = 8) -> DataFrame:
    """kb_id, q_type, n, question, ground_truth, relevant, grades, negative_subtype of each selected kb.

    Facts and concepts come from its chunks of more than 40 characters in rank order, multi-hop questions from pairs of
    its relations and then from neighbouring chunks, negatives from fixed questions. A question counts once a kb.
    """
    picked = kb_selection(chunks).where("length(trim(content)) > 40")
    order = F.row_number().over(Window.partitionBy("kb_id").orderBy("rn", "chunk_id")) - 1
    active = picked.withColumn("i", order).withColumn("term", extract_term(F.col("content")))
    support = supporting_chunk(picked)
    ids = lambda *c: F.array(*[F.col(x) for x in c])
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, q_type: str, question: Column, truth: Column, relevant: Column, grades: Column, n: Column, subtype: Column = none) -> DataFrame:
        return df.select("kb_id", F.lit(q_type).alias("q_type"), n.cast("long").alias("n"), question.alias("question"), truth.alias("ground_truth"), relevant.cast("array<bigint>").alias("relevant"), grades.cast("array<string>").alias("grades"), subtype.alias("negative_subtype"))

    base = active.join(support, "chunk_id", "left")
    both = F.when(F.col("supporting_id").isNotNull(), ids("chunk_id", "supporting_id")).otherwise(ids("chunk_id"))
    marks = F.when(F.col("supporting_id").isNotNull(), F.array(F.lit("primary"), F.lit("supporting"))).otherwise(F.array(F.lit("primary")))
    fact = rows(base, "fact", _filled(FACT_TEMPLATES, F.col("i"), F.col("term")), F.trim(F.substring("content", 1, 500)), both, marks, F.col("i"))
    concept = rows(active.where(F.col("i") >= facts), "concept", _filled(CONCEPT_TEMPLATES, F.col("i"), F.col("term")), F.trim(F.substring("content", 1, 600)), ids("chunk_id"), F.array(F.lit("primary")), F.col("i"))
    text = active.select("kb_id", "chunk_id", first_sentence(F.col("content")).alias("s"), first_sentence(F.col("content"), 30).alias("s30"), "i")
    a, b = text.toDF("kb_id", "a", "s_a", "s30_a", "i_a"), text.toDF("kb_id", "b", "s_b", "s30_b", "i_b")
    subject = relations.groupBy("kb_id", F.col("chunk_id").alias("a"), "object_entity").agg(F.min("subject").alias("subject"), F.min("predicate").alias("predicate"))
    linked = multi_hop_pairs(relations, 2 * hops).join(subject, ["kb_id", "a", "object_entity"]).join(a, ["kb_id", "a"]).join(b, ["kb_id", "b"])
    truth = F.concat("s_a", F.lit("\n"), "s_b")
    by_graph = rows(linked, "multi_hop", F.concat(F.lit("「"), "subject", F.lit("」和「"), "object_entity", F.lit("」之间有什么联系？（通过"), "predicate", F.lit("）")), truth, ids("a", "b"), F.array(F.lit("primary"), F.lit("primary")), F.row_number().over(Window.partitionBy("kb_id").orderBy("a", "b")) - 1)
    beside = a.where("i_a % 2 = 0").withColumn("i_b", F.col("i_a") + 1).join(b, ["kb_id", "i_b"])
    by_text = rows(beside, "multi_hop", F.concat(F.lit("综合两段内容，「"), "s30_a", F.lit("」与「"), "s30_b", F.lit("」有何关联？")), truth, ids("a", "b"), F.array(F.lit("primary"), F.lit("supporting")), F.col("i_a") + 1_000_000)
    each = picked.select("kb_id").distinct()
    empty = F.array().cast("array<bigint>")
    fixed = each.select("kb_id", F.posexplode(F.array(*[F.lit(q) for q in UNRELATED])).alias("i", "q"))
    unrelated = rows(fixed.where(F.col("i") < negatives // 2), "negative", F.col("q"), F.lit(NOTHING_KNOWN), empty, empty, F.col("i"), F.lit("unrelated"))
    near = each.select("kb_id", F.posexplode(F.array(*[F.lit(f"本知识库中{w}章节的详细内容是什么？") for w in WRONG_TERMS])).alias("i", "q"))
    near_domain = rows(near.where(F.col("i") < negatives - negatives // 2), "negative", F.col("q"), F.lit(NOTHING_KNOWN), empty, empty, F.col("i") + 100, F.lit("near_domain"))
    every = reduce(DataFrame.unionByName, [fact, concept, by_graph, by_text, unrelated, near_domain])
    clean = every.where(~reduce(lambda x, y: x | y, [F.col("question").contains(p) for p in BANNED]))
    kind = F.expr("case q_type when 'fact' then 0 when 'concept' then 1 when 'multi_hop' then 2 else 3 end")
    once = clean.withColumn("dup", F.row_number().over(Window.partitionBy("kb_id", "question").orderBy(kind, "n"))).where("dup = 1")
    quota = F.expr(f"case q_type when 'fact' then {facts} when 'concept' then {concepts} when 'multi_hop' then {hops} else {negatives} end")
    place = F.row_number().over(Window.partitionBy("kb_id", "q_type").orderBy("n", "question"))
    return once.withColumn("place", place).where(F.col("place") <= quota).drop("dup", "n").withColumnRenamed("place", "n")


def stratified_sample(samples: DataFrame, fraction: float = 0.2, seed: int = 42, key: str = "sample_id") -> DataFrame:
    """Of each question type max(1, round(n f)) samples, in the order of a hash with the seed: the same ones each time."""
    order = F.row_number().over(Window.partitionBy("q_type").orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key))
    n = F.count(F.lit(1)).over(Window.partitionBy("q_type"))
    return samples.withColumns({"__rn": order, "__n": n}).where(F.col("__rn") <= F.greatest(F.lit(1), F.round(F.col("__n") * fraction))).drop("__rn", "__n")


def missing_relevant_chunks(samples: DataFrame, chunks: DataFrame) -> DataFrame:
    """Relevant ids without a chunk. ``samples``: sample_id, relevant_id."""
    return samples.where("relevant_id is not null").join(chunks.select(F.col("chunk_id").alias("relevant_id")), "relevant_id", "left_anti").select("sample_id", "relevant_id")


def backfill_needed(chunks: DataFrame, relations: DataFrame) -> DataFrame:
    """Active chunks without triples."""
    return chunks.where("is_active").join(relations.select("chunk_id").distinct(), "chunk_id", "left_anti").select("chunk_id", "kb_id")


def fix_annotations(samples: DataFrame, chunks: DataFrame, least: float = 0.15) -> DataFrame:
    """sample_id, action, relevant of fact samples (sample_id, kb_id, question, primary_id): ok, repointed to the best two chunks, or flagged."""
    joined = samples.join(chunks.select(F.col("chunk_id").alias("primary_id"), "content"), "primary_id", "left")
    ok = F.col("content").isNotNull() & rel_overlap_ok(F.col("question"), F.coalesce("content", F.lit("")))
    judged = joined.withColumn("ok", ok)
    bad = judged.where("not ok").select(F.col("sample_id").alias("query_id"), "kb_id", "question")
    best = best_chunks_for_question(bad, chunks).where(F.col("score") >= least).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("best"))
    out = judged.join(best, judged["sample_id"] == best["query_id"], "left")
    action = F.when(F.col("ok"), "ok").when(F.col("best").isNotNull(), "repointed").otherwise("flagged")
    return out.select("sample_id", action.alias("action"), F.when(F.col("ok"), F.array("primary_id")).otherwise(F.col("best")).alias("relevant"))


def image_dedup(images: DataFrame, least_side: int = 32, most: int = 30) -> DataFrame:
    """Images (doc_id, page, hash, width, height) large enough, the first of each hash of a document, ``most`` a document."""
    large = images.where((F.col("width") >= least_side) & (F.col("height") >= least_side))
    w = Window.partitionBy("doc_id", "hash").orderBy("page", "width", "height")
    first = large.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
    return first.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "hash"))).where(F.col("n") <= most)
