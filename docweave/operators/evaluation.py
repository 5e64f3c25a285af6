"""Retrieval evaluation: metrics of samples, their means, gates and comparisons of runs.

A sample has relevant (array of ids), grades (map from id to a grade name, may be null), retrieved
(array of ids in rank order) and q_type. Means leave nulls out and are null over nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions.text import unicode_terms

#: Gains of grades; any other grade has 1.
GAINS = {"primary": 3.0, "supporting": 2.0, "tangential": 1.0}

#: Least values by phase.
GATES = {
    "v1_baseline": {"context_recall_mean": 0.80, "retrieval_hit_rate": 0.88},
    "week0": {"negative_reject_rate": 0.78, "context_recall_mean": 0.85, "retrieval_hit_rate": 0.88},
    "week2": {"context_precision_mean": 0.35, "context_precision_chunk": 0.35, "negative_reject_rate": 0.78, "context_recall_mean": 0.85},
    "week2_v2": {"context_precision_mean": 0.30, "context_precision_chunk": 0.30, "negative_reject_rate": 0.70, "context_recall_mean": 0.80},
    "week4": {"faithfulness_mean": 0.75, "answer_relevancy_mean": 0.48, "context_precision_mean": 0.42, "context_precision_chunk": 0.42, "negative_reject_rate": 0.82},
    "week4_quality": {"context_precision_chunk": 0.50, "negative_reject_rate": 0.95, "context_recall_mean": 0.85, "context_recall_chunk": 0.85},
}
#: The metric that stands in for one a report lacks.
STAND_IN = {"context_precision_chunk": "context_precision_mean", "context_recall_mean": "context_recall_chunk"}
#: What two runs are compared by.
COMPARED = ["context_precision_chunk", "context_recall_chunk", "context_precision_mean", "context_recall_mean", "mrr_mean", "ndcg_at_5_mean", "retrieval_hit_rate", "negative_reject_rate", "faithfulness_mean", "answer_relevancy_mean", "llm_judge_faithfulness_mean", "sample_count"]


def mrr(retrieved: Column, relevant: Column) -> Column:
    """1 / rank of the first relevant id, 0 without any."""
    ranks = F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda r: r.isNotNull())
    return F.when(F.size(ranks) > 0, F.round(1 / F.array_min(ranks), 4)).otherwise(0.0)


def precision_at(retrieved: Column, relevant: Column, k: int) -> Column:
    """Relevant share of the first k rows, of as many as there are."""
    top = F.slice(retrieved, 1, k)
    hits = F.size(F.filter(top, lambda x: F.array_contains(relevant, x)))
    return F.when(F.size(top) > 0, F.round(hits / F.size(top), 4)).otherwise(0.0)


def _gain(grades: Column, relevant: Column):
    def gain(x: Column) -> Column:
        grade = F.try_element_at(grades, x)
        named = reduce(lambda c, g: c.when(grade == g[0], g[1]), GAINS.items(), F.when(F.lit(False), 0.0)).otherwise(1.0)
        return F.when(grade.isNotNull(), named).when(F.array_contains(relevant, x), 1.0).otherwise(0.0)

    return gain


def _discounted(gains: Column) -> Column:
    parts = F.transform(gains, lambda g, i: g / F.log2(i + 2.0))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def ndcg(retrieved: Column, relevant: Column, grades: Column, k: int = 5) -> Column:
    """Graded ids gain even if they are not relevant; the ideal order is of relevant ids alone."""
    gain = _gain(grades, relevant)
    dcg = _discounted(F.transform(F.slice(retrieved, 1, k), gain))
    ideal = _discounted(F.slice(F.sort_array(F.transform(relevant, gain), asc=False), 1, k))
    return F.when(ideal > 0, F.round(dcg / ideal, 4)).otherwise(0.0)


def retrieval_metrics(samples: DataFrame) -> DataFrame:
    """All metrics of each sample. A negative one scores 1 if nothing was retrieved; a positive one without relevant ids has nulls and no hit."""
    got, want = F.array_distinct("retrieved"), F.array_distinct("relevant")
    both = F.size(F.array_intersect("retrieved", "relevant"))
    negative, unlabelled = F.col("q_type") == "negative", F.size(F.coalesce("relevant", F.array().cast("array<bigint>"))) == 0
    empty = F.size("retrieved") == 0
    none = F.lit(None).cast("double")

    def metric(value: Column) -> Column:
        return F.when(negative | unlabelled, none).otherwise(value)

    def share(value: Column) -> Column:
        return F.when(negative, empty.cast("double")).when(unlabelled, none).otherwise(F.round(value, 4))

    r, w, g = F.col("retrieved"), F.col("relevant"), F.col("grades")
    recall = share(both / F.size(want))
    precision = share(F.when(F.size(got) > 0, both / F.size(got)).otherwise(0.0))
    return samples.withColumns({
        "context_recall": recall, "context_precision": precision,
        "retrieval_hit": F.when(negative, empty).when(unlabelled, False).otherwise(both > 0),
        "negative_ok": F.when(negative, empty), "mrr": metric(mrr(r, w)), "ndcg_at_5": metric(ndcg(r, w, g)),
        **{f"precision_at_{k}": metric(precision_at(r, w, k)) for k in (1, 3, 5)},
    })


def _means(all_rows: bool = False) -> list[Column]:
    negative = F.col("q_type") == "negative"
    positive = lambda name: F.col(name) if all_rows and name in ("context_precision", "context_recall") else F.when(~negative, F.col(name))
    avg = lambda c: F.round(F.avg(c), 4)
    precision, recall = avg(positive("context_precision")), avg(positive("context_recall"))
    return [
        F.count(F.lit(1)).alias("sample_count"), precision.alias("context_precision_mean"), recall.alias("context_recall_mean"),
        precision.alias("context_precision_chunk"), recall.alias("context_recall_chunk"),
        *[avg(positive(m)).alias(f"{m}_mean") for m in ("mrr", "ndcg_at_5", "precision_at_1", "precision_at_3", "precision_at_5")],
        avg(F.when(~negative, F.coalesce("retrieval_hit", F.lit(False)).cast("double"))).alias("retrieval_hit_rate"),
        avg(F.when(negative, F.coalesce("negative_ok", F.lit(False)).cast("double"))).alias("negative_reject_rate"),
        *[avg(F.col(m)).alias(n) for m, n in (("faithfulness", "faithfulness_mean"), ("answer_relevancy", "answer_relevancy_mean"), ("llm_judge_faithfulness", "llm_judge_faithfulness_mean"), ("retrieve_ms", "avg_retrieve_ms"), ("generate_ms", "avg_generate_ms"))],
    ]


JUDGED = ["faithfulness", "answer_relevancy", "llm_judge_faithfulness", "retrieve_ms", "generate_ms"]


def _with_judged(samples: DataFrame) -> DataFrame:
    return samples.withColumns({c: F.lit(None).cast("double") for c in JUDGED if c not in samples.columns})


def aggregate(samples: DataFrame, all_rows: bool = False) -> DataFrame:
    """One row of means. ``all_rows`` takes precision and recall over negatives too."""
    return _with_judged(samples).agg(*_means(all_rows))


def aggregate_by(samples: DataFrame) -> DataFrame:
    """The means of all samples, by question type, by kb, and of negatives by subtype; a null key is 'unknown'."""
    rows = _with_judged(samples).withColumns({k: F.coalesce(F.col(k), F.lit("unknown")) for k in ("q_type", "kb_id", "negative_subtype")})
    keyed = rows.withColumn("type_key", F.col("q_type"))
    grouped = keyed.groupingSets([[], [F.col("type_key")], [F.col("kb_id")]], F.col("type_key"), F.col("kb_id")).agg(F.grouping_id().alias("gid"), *_means())
    kind = F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, "q_type").otherwise("kb_id")
    main = grouped.withColumns({"group_by": kind, "group_key": F.coalesce("type_key", "kb_id", F.lit(""))}).drop("gid", "type_key", "kb_id")
    sub = rows.where("q_type = 'negative'").groupBy("negative_subtype").agg(*_means())
    return main.unionByName(sub.withColumns({"group_by": F.lit("negative_subtype"), "group_key": F.col("negative_subtype")}).drop("negative_subtype"))


def hit_buckets(samples: DataFrame) -> DataFrame:
    """Samples by how much of their relevant ids was found: full, partial (exactly one), miss, n/a."""
    both, want = F.size(F.array_intersect("retrieved", "relevant")), F.size(F.array_distinct("relevant"))
    bucket = F.when(F.coalesce(want, F.lit(0)) <= 0, "n/a").when(both >= want, "full").when(both == 0, "miss").otherwise("partial")
    return samples.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def contextual_relevancy(question: Column, contexts: Column) -> Column:
    """The best share of the question's terms that a context has."""
    asked = unicode_terms(question)
    shares = F.transform(contexts, lambda c: F.size(F.array_intersect(asked, unicode_terms(c))) / F.size(asked))
    return F.when((F.size(asked) > 0) & (F.size(contexts) > 0), F.round(F.array_max(shares), 4)).otherwise(0.0)


def grounding(answer: Column, contexts: Column) -> Column:
    """The share of the answer's terms that the contexts have together; 1 without terms in the answer, 0 without any in the contexts."""
    said = unicode_terms(answer)
    known = F.array_distinct(F.flatten(F.transform(contexts, unicode_terms)))
    return F.when(F.size(said) == 0, 1.0).when(F.size(known) == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(said, known)) / F.size(said), 4))


def long_metrics(report: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """metric, value of a wide report, beside the columns ``keys``."""
    keys = keys or []
    names = [c for c in report.columns if c not in keys]
    return report.select(*keys, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(keys or [], names, "metric", "value")


def check_gates(metrics: DataFrame, spark: SparkSession) -> DataFrame:
    """phase, metric, minimum, value, passed for every gate. ``metrics``: metric, value. A missing value fails."""
    rows = [(p, m, v, STAND_IN.get(m)) for p, gates in GATES.items() for m, v in gates.items()]
    gates = spark.createDataFrame(rows, "phase string, metric string, minimum double, stand_in string")
    own = metrics.select(F.col("metric"), F.col("value").alias("own"))
    other = metrics.select(F.col("metric").alias("stand_in"), F.col("value").alias("other"))
    value = F.coalesce("own", "other")
    joined = gates.join(own, "metric", "left").join(other, "stand_in", "left")
    return joined.select("phase", "metric", "minimum", value.alias("value"), F.coalesce(value >= F.col("minimum"), F.lit(False)).alias("passed"))


def knowledge_retention(baseline: DataFrame, current: DataFrame, recall: float = 0.85, precision: float = 0.80) -> DataFrame:
    """Recall and precision against a baseline's; skipped if missing or the baseline is not above 0."""
    least = F.when(F.col("metric") == "context_recall_mean", recall).otherwise(precision)
    b, c = baseline.select("metric", F.col("value").alias("baseline")), current.select("metric", F.col("value").alias("current"))
    both = b.join(c, "metric", "full_outer").where(F.col("metric").isin("context_recall_mean", "context_precision_mean"))
    skipped = F.col("baseline").isNull() | F.col("current").isNull() | (F.col("baseline") <= 0)
    ratio = F.when(~skipped, F.col("current") / F.col("baseline"))
    return both.select("metric", "baseline", "current", F.round(ratio, 4).alias("ratio"), skipped.alias("skipped"), F.coalesce(ratio >= least, F.lit(True)).alias("passed"))


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Each compared metric before and after, with the change; left out if both lack it."""
    b, a = before.select("metric", F.col("value").alias("before")), after.select("metric", F.col("value").alias("after"))
    both = b.join(a, "metric", "full_outer").where(F.col("metric").isin(COMPARED) & F.coalesce("before", "after").isNotNull())
    return both.withColumn("delta", F.round(F.col("after") - F.col("before"), 4))


def compare_subtypes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Reject rates by negative subtype before and after. Inputs as from ``aggregate_by``."""
    part = lambda df, n: df.where("group_by = 'negative_subtype'").select(F.col("group_key").alias("subtype"), F.col("negative_reject_rate").alias(f"{n}_rate"), F.col("sample_count").alias(f"{n}_count"))
    return part(before, "before").join(part(after, "after"), "subtype", "full_outer").withColumn("delta", F.round(F.col("after_rate") - F.col("before_rate"), 4))


def phase_exit(groups: DataFrame, v1_recall: float = 0.85, v1_reject: float = 1.0, v2_recall: float = 0.82, v2_samples: int = 50) -> DataFrame:
    """Whether each dataset passes. ``groups``: dataset_version with the columns of ``aggregate_by``."""
    v1 = groups.where("dataset_version = 'v1' and group_by = 'all'").select("dataset_version", "sample_count", "context_recall_mean", "negative_reject_rate", ((F.col("context_recall_mean") >= v1_recall) & (F.col("negative_reject_rate") >= v1_reject)).alias("ok"))
    v2 = groups.where("dataset_version = 'v2' and group_by = 'q_type' and group_key = 'multi_hop'").select("dataset_version", "sample_count", "context_recall_mean", "negative_reject_rate", ((F.col("sample_count") >= v2_samples) & (F.col("context_recall_mean") >= v2_recall)).alias("ok"))
    return v1.unionByName(v2).select("dataset_version", "sample_count", "context_recall_mean", "negative_reject_rate", F.coalesce("ok", F.lit(False)).alias("passed"))


def graph_mode_ab(runs: DataFrame, base: str = "lite") -> DataFrame:
    """Mean recall of each graph mode, its difference to the base mode, and whether it is the best (the first name of equals)."""
    means = runs.groupBy("mode").agg(F.round(F.avg("context_recall"), 4).alias("recall"), F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    reference = F.max(F.when(F.col("mode") == base, F.col("recall"))).over(every)
    best = F.row_number().over(Window.partitionBy().orderBy(F.desc_nulls_last("recall"), "mode")) == 1
    return means.select("mode", "n", "recall", F.round(F.col("recall") - reference, 4).alias("delta"), best.alias("is_best"))


def diagnose(report: DataFrame, has_generation: bool = True) -> DataFrame:
    """The bottleneck that a report's means point at."""
    below = lambda c, x: F.coalesce(F.col(c) < x, F.lit(False))
    weak, loose = below("context_recall_mean", 0.6), below("context_precision_mean", 0.35)
    faith = F.coalesce(F.coalesce("faithfulness_mean", "llm_judge_faithfulness_mean") < 0.6, F.lit(False))
    reject = below("negative_reject_rate", 0.5)
    if not has_generation:
        return report.withColumn("bottleneck", F.when(weak, "retrieval").otherwise("retrieval_baseline_only"))
    return report.withColumn("bottleneck", F.when(weak & (faith | reject), "both").when(weak | loose, "retrieval").when(reject | faith, "generation").otherwise("balanced"))


#: Question types of a dataset.
Q_TYPES = ["fact", "multi_hop", "concept", "negative"]


def dataset_audit(samples: DataFrame, banned: list[str], version: str = "v2", least_per_kb: int = 40, least_kbs: int = 5) -> DataFrame:
    """Issue rows (rule, subject, found). ``samples``: sample_id, kb_id, q_type, question, ground_truth, relevant, negative_subtype."""
    size = F.greatest(F.size(F.coalesce("relevant", F.array().cast("array<bigint>"))), F.lit(0))
    id_ = F.col("sample_id").cast("string")
    issue = lambda rule, df, found=F.lit(1): df.select(F.lit(rule).alias("rule"), id_.alias("subject"), found.cast("long").alias("found"))
    parts = [issue("banned phrase", samples.where(reduce(lambda a, b: a | b, [F.col("question").contains(p) for p in banned], F.lit(False))))]
    parts.append(issue("positive without relevant chunks", samples.where((F.col("q_type") != "negative") & (size == 0))))
    parts.append(issue("invalid type", samples.where(~F.coalesce(F.col("q_type").isin(Q_TYPES), F.lit(False)))))
    parts.append(issue("missing field", samples.where(F.coalesce(F.col("question"), F.lit("")).eqNullSafe("") | F.col("kb_id").isNull() | F.col("ground_truth").isNull())))
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    negative = F.col("q_type") == "negative"
    rules = [("negatives", negative, 40 if version == "v2" else 10)]
    if version == "v2":
        rules += [("unrelated negatives", negative & (F.col("negative_subtype") == "unrelated"), 20), ("near_domain negatives", negative & (F.col("negative_subtype") == "near_domain"), 20), ("multi-relevant samples", size > 1, 30)]
        parts.append(issue("negative without subtype", samples.where(negative & F.col("negative_subtype").isNull())))
    totals = samples.agg(*[count(c).alias(f"c{i}") for i, (_, c, _) in enumerate(rules)], F.countDistinct("kb_id").alias("kbs"))
    stack = ", ".join([f"'{name}', {least}L, c{i}" for i, (name, _, least) in enumerate(rules)] + [f"'kbs', {least_kbs}L, kbs"])
    few = totals.selectExpr(f"stack({len(rules) + 1}, {stack}) as (subject, least, found)").where("found < least")
    parts.append(few.select(F.lit("too few").alias("rule"), "subject", "found"))
    kb = samples.groupBy("kb_id").agg(F.count(F.lit(1)).alias("found")).where(F.col("found") < least_per_kb)
    parts.append(kb.select(F.lit("too few of a kb").alias("rule"), F.col("kb_id").cast("string").alias("subject"), "found"))
    return reduce(DataFrame.unionByName, parts)
