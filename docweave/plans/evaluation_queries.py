"""Queries over retrieval evaluation, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import evaluation as E
from docweave.sources import views as V
from docweave.sources.views import with_views


def _samples(spark, d):
    """One row a sample: relevant ids and grades of the view, and a run that finds every third of them among others."""
    rows = V.samples(spark, d)
    entry = F.when(F.col("relevant_id").isNotNull(), F.struct("relevant_id", "grade"))
    grouped = rows.groupBy("sample_id", "q_type").agg(F.array_sort(F.collect_list(F.col("relevant_id").cast("long"))).alias("relevant"), F.map_from_entries(F.collect_list(entry)).alias("grades"))
    found = F.expr("filter(transform(sequence(0L, 4L), i -> sample_id div 100L * 100L + (sample_id * 7L + i * i * 3L) % 100L), x -> q_type <> 'negative' or sample_id % 2 = 0)")
    kb = F.concat(F.lit("kb"), (F.col("sample_id") % 3).cast("string"))
    subtype = F.when(F.col("q_type") == "negative", F.when(F.col("sample_id") % 2 == 0, "near_domain").otherwise("unrelated"))
    return grouped.withColumns({"retrieved": found, "kb_id": kb, "negative_subtype": subtype, "faithfulness": (F.col("sample_id") % 10) / 10.0})


def _metrics(spark, d):
    return E.retrieval_metrics(_samples(spark, d))


def _report(spark, d, all_rows=False):
    return E.long_metrics(E.aggregate(_metrics(spark, d), all_rows))


METRICS = ["context_recall", "context_precision", "retrieval_hit", "negative_ok", "mrr", "ndcg_at_5", "precision_at_1", "precision_at_3", "precision_at_5"]


def ev01_retrieval_metrics(spark, d):
    return _metrics(spark, d).select("sample_id", "q_type", *METRICS).withColumn("negative_ok", F.col("negative_ok").cast("string"))


def ev02_mrr(spark, d):
    return _metrics(spark, d).select("sample_id", "mrr")


def ev03_precision_at_k(spark, d):
    return _metrics(spark, d).select("sample_id", "precision_at_1", "precision_at_3", "precision_at_5")


def ev04_ndcg(spark, d):
    return _metrics(spark, d).select("sample_id", "ndcg_at_5")


def ev05_grounding(spark, d):
    """Each assistant message against the conversation's user messages."""
    m = V.messages(spark, d)
    ctx = m.where("role = 'user'").groupBy("conversation_id").agg(F.collect_list("content").alias("contexts"))
    rows = m.where("role = 'assistant'").join(ctx, "conversation_id", "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
    return rows.select("message_id", E.contextual_relevancy(F.col("content"), F.col("contexts")).alias("relevancy"), E.grounding(F.col("content"), F.col("contexts")).alias("grounding"))


def ev06_check_gates(spark, d):
    return E.check_gates(_report(spark, d), spark)


def ev07_knowledge_retention(spark, d):
    return E.knowledge_retention(_report(spark, d, True), _report(spark, d))


def ev08_compare_runs(spark, d):
    return E.compare_runs(_report(spark, d, True), _report(spark, d))


def ev08b_compare_subtypes(spark, d):
    rows = _metrics(spark, d)
    return E.compare_subtypes(E.aggregate_by(rows), E.aggregate_by(rows.where("sample_id % 4 <> 0")))


def ev09_phase_exit(spark, d):
    groups = E.aggregate_by(_metrics(spark, d))
    return E.phase_exit(groups.withColumn("dataset_version", F.lit("v1")).unionByName(groups.withColumn("dataset_version", F.lit("v2"))))


def ev10_graph_mode_ab(spark, d):
    modes = F.explode(F.array(F.lit("legacy"), F.lit("linear"), F.lit("lite"))).alias("mode")
    rows = _metrics(spark, d).where("context_recall is not null").select("sample_id", "context_recall", modes)
    return E.graph_mode_ab(rows.where("mode <> 'linear' or sample_id % 2 = 0").where("mode <> 'legacy' or sample_id % 3 = 0"))


def ev11_diagnose(spark, d):
    groups = E.aggregate_by(_metrics(spark, d))
    return E.diagnose(groups).select("group_by", "group_key", "bottleneck")


def ag16_eval_aggregate(spark, d):
    return E.aggregate(_metrics(spark, d)).drop("avg_retrieve_ms", "avg_generate_ms", "answer_relevancy_mean", "llm_judge_faithfulness_mean")


def ag16b_eval_aggregate_all_rows(spark, d):
    return E.aggregate(_metrics(spark, d), True).select("sample_count", "context_recall_mean", "context_precision_mean")


def ag17_eval_aggregate_by(spark, d):
    return E.aggregate_by(_metrics(spark, d)).select("group_by", "group_key", "sample_count", "context_recall_mean", "mrr_mean", "retrieval_hit_rate", "negative_reject_rate", "faithfulness_mean")


def ag19_hit_buckets(spark, d):
    return E.hit_buckets(_samples(spark, d))


def ag21_dataset_audit(spark, d):
    """Samples made of the benchmark's texts, audited against a phrase that some of them have."""
    b = V.table(spark, d, "benchmark")
    rows = b.selectExpr("item_id as sample_id", "concat('kb', cast(item_id % 4 as string)) as kb_id", "case item_id % 5 when 0 then 'negative' when 1 then 'fact' when 2 then 'concept' when 3 then 'multi_hop' else 'other' end as q_type", "text as question", "case when item_id % 11 = 0 then null else text end as ground_truth", "case when item_id % 3 = 0 then array(item_id, item_id + 1) when item_id % 3 = 1 then array(item_id) else cast(array() as array<bigint>) end as relevant", "case when item_id % 2 = 0 then 'unrelated' end as negative_subtype")
    return E.dataset_audit(rows, ["the "])


def st04_relevant_retrieved(spark, d):
    both = F.array_sort(F.array_intersect("relevant", "retrieved"))
    return _samples(spark, d).select("sample_id", F.array_join(F.transform(both, lambda x: x.cast("string")), ",").alias("common"))


_S = """smp AS (SELECT sample_id, q_type, list_sort(list(relevant_id) FILTER (WHERE relevant_id IS NOT NULL)) AS relevant FROM fx_samples GROUP BY 1, 2),
run AS (SELECT s.sample_id, i.i AS pos, s.sample_id // 100 * 100 + (s.sample_id * 7 + i.i * i.i * 3) % 100 AS id FROM (SELECT DISTINCT sample_id, q_type FROM fx_samples) s, (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) i WHERE s.q_type <> 'negative' OR s.sample_id % 2 = 0),
rel AS (SELECT sample_id, relevant_id, grade, CASE grade WHEN 'primary' THEN 3.0 WHEN 'supporting' THEN 2.0 ELSE 1.0 END AS gain FROM fx_samples WHERE relevant_id IS NOT NULL),
hit AS (SELECT run.sample_id, run.pos, run.id, rel.gain FROM run LEFT JOIN rel ON rel.sample_id = run.sample_id AND rel.relevant_id = run.id),
per AS (SELECT sample_id, count(DISTINCT CASE WHEN gain IS NOT NULL THEN id END) AS both, count(DISTINCT id) AS got, min(CASE WHEN gain IS NOT NULL THEN pos + 1 END) AS first,
  sum(coalesce(gain, 0) / log2(pos + 2)) AS dcg, sum(CASE WHEN gain IS NOT NULL AND pos < 1 THEN 1 ELSE 0 END) AS p1, sum(CASE WHEN gain IS NOT NULL AND pos < 3 THEN 1 ELSE 0 END) AS p3, sum(CASE WHEN gain IS NOT NULL THEN 1 ELSE 0 END) AS p5 FROM hit GROUP BY 1),
ideal AS (SELECT sample_id, sum(gain / log2(rn + 1)) AS idcg, max(n) AS want FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY gain DESC) AS rn, count(*) OVER (PARTITION BY sample_id) AS n FROM rel) x WHERE rn <= 5 GROUP BY 1),
base AS (SELECT DISTINCT sample_id, q_type FROM fx_samples),
met AS (SELECT b.sample_id, b.q_type,
  CASE WHEN q_type = 'negative' THEN CASE WHEN p.got IS NULL THEN 1.0 ELSE 0.0 END WHEN i.want IS NOT NULL THEN round(CAST(p.both AS DOUBLE) / i.want, 4) END AS context_recall,
  CASE WHEN q_type = 'negative' THEN CASE WHEN p.got IS NULL THEN 1.0 ELSE 0.0 END WHEN i.want IS NOT NULL THEN round(CAST(p.both AS DOUBLE) / p.got, 4) END AS context_precision,
  CASE WHEN q_type = 'negative' THEN p.got IS NULL WHEN i.want IS NULL THEN false ELSE p.both > 0 END AS retrieval_hit,
  CASE WHEN q_type = 'negative' THEN p.got IS NULL END AS negative_ok,
  CASE WHEN q_type <> 'negative' AND i.want IS NOT NULL THEN coalesce(round(CAST(1 AS DOUBLE) / p.first, 4), 0.0) END AS mrr,
  CASE WHEN q_type <> 'negative' AND i.want IS NOT NULL THEN round(p.dcg / i.idcg, 4) END AS ndcg_at_5,
  CASE WHEN q_type <> 'negative' AND i.want IS NOT NULL THEN CAST(p.p1 AS DOUBLE) END AS precision_at_1,
  CASE WHEN q_type <> 'negative' AND i.want IS NOT NULL THEN round(CAST(p.p3 AS DOUBLE) / 3, 4) END AS precision_at_3,
  CASE WHEN q_type <> 'negative' AND i.want IS NOT NULL THEN round(CAST(p.p5 AS DOUBLE) / 5, 4) END AS precision_at_5,
  concat('kb', b.sample_id % 3) AS kb_id, CASE WHEN q_type = 'negative' THEN CASE WHEN b.sample_id % 2 = 0 THEN 'near_domain' ELSE 'unrelated' END END AS negative_subtype, CAST(b.sample_id % 10 AS DOUBLE) / 10 AS faithfulness
  FROM base b LEFT JOIN per p ON p.sample_id = b.sample_id LEFT JOIN ideal i ON i.sample_id = b.sample_id)"""


def _agg(extra: str = "", where: str = "") -> str:
    pos = lambda c, n: f"round(avg(CASE WHEN q_type <> 'negative' THEN {c} END), 4) AS {n}"
    return (
        f"SELECT {extra} count(*) AS sample_count, {pos('context_precision', 'context_precision_mean')}, {pos('context_recall', 'context_recall_mean')}, {pos('context_precision', 'context_precision_chunk')}, {pos('context_recall', 'context_recall_chunk')}, "
        + ", ".join(pos(m, f"{m}_mean") for m in ("mrr", "ndcg_at_5", "precision_at_1", "precision_at_3", "precision_at_5"))
        + ", round(avg(CASE WHEN q_type <> 'negative' THEN CASE WHEN retrieval_hit THEN 1.0 ELSE 0.0 END END), 4) AS retrieval_hit_rate, round(avg(CASE WHEN q_type = 'negative' THEN CASE WHEN negative_ok THEN 1.0 ELSE 0.0 END END), 4) AS negative_reject_rate, round(avg(faithfulness), 4) AS faithfulness_mean "
        f"FROM met {where}"
    )


_ALL = "round(avg(context_precision), 4) AS context_precision_mean, round(avg(context_recall), 4) AS context_recall_mean"
_GROUPS = "grp AS (" + " UNION ALL ".join([
    _agg("'all' AS group_by, '' AS group_key,"), _agg("'q_type' AS group_by, q_type AS group_key,", "GROUP BY q_type"), _agg("'kb_id' AS group_by, kb_id AS group_key,", "GROUP BY kb_id"),
    _agg("'negative_subtype' AS group_by, negative_subtype AS group_key,", "WHERE q_type = 'negative' GROUP BY negative_subtype"),
]) + ")"
_GATE_ROWS = " UNION ALL ".join(f"SELECT '{p}' AS phase, '{m}' AS metric, CAST({v} AS DOUBLE) AS minimum, (SELECT {m if m != 'answer_relevancy_mean' else 'CAST(NULL AS DOUBLE)'} FROM one) AS value" for p, g in E.GATES.items() for m, v in g.items())
_TERMS = "list_distinct(regexp_extract_all(lower({0}), '[\\pL\\pM\\pN_]{{2,}}'))"

SQL = {
    "ev01_retrieval_metrics": with_views("SELECT sample_id, q_type, " + ", ".join(m if m != "negative_ok" else "CAST(negative_ok AS VARCHAR) AS negative_ok" for m in METRICS) + " FROM met", _S),
    "ev02_mrr": with_views("SELECT sample_id, mrr FROM met", _S),
    "ev03_precision_at_k": with_views("SELECT sample_id, precision_at_1, precision_at_3, precision_at_5 FROM met", _S),
    "ev04_ndcg": with_views("SELECT sample_id, ndcg_at_5 FROM met", _S),
    "ev05_grounding": with_views("SELECT a.message_id, coalesce(round(max(CASE WHEN u.t IS NOT NULL THEN CAST(len(list_intersect(a.t, u.t)) AS DOUBLE) / len(a.t) END), 4), 0.0) AS relevancy, CASE WHEN count(u.t) = 0 THEN 0.0 ELSE round(CAST(len(list_intersect(any_value(a.t), list_distinct(flatten(list(u.t))))) AS DOUBLE) / len(any_value(a.t)), 4) END AS grounding FROM a LEFT JOIN u ON u.conversation_id = a.conversation_id GROUP BY 1",
        f"a AS (SELECT message_id, conversation_id, {_TERMS.format('content')} AS t FROM fx_messages WHERE role = 'assistant')", f"u AS (SELECT conversation_id, {_TERMS.format('content')} AS t FROM fx_messages WHERE role = 'user')"),
    "ev06_check_gates": with_views("SELECT phase, metric, minimum, value, coalesce(value >= minimum, false) AS passed FROM gates", _S, f"one AS ({_agg()})", f"gates AS ({_GATE_ROWS})"),
    "ev07_knowledge_retention": with_views("SELECT m.metric, m.baseline, m.current, round(current / baseline, 4) AS ratio, false AS skipped, current / baseline >= CASE WHEN metric = 'context_recall_mean' THEN 0.85 ELSE 0.8 END AS passed FROM m", _S, f"one AS ({_agg()})", f"al AS (SELECT {_ALL} FROM met)",
        "m AS (SELECT 'context_recall_mean' AS metric, (SELECT context_recall_mean FROM al) AS baseline, (SELECT context_recall_mean FROM one) AS current UNION ALL SELECT 'context_precision_mean', (SELECT context_precision_mean FROM al), (SELECT context_precision_mean FROM one))"),
    "ev08_compare_runs": with_views('SELECT metric, "before", "after", round("after" - "before", 4) AS delta FROM c', _S, f"one AS ({_agg()})", f"al AS (SELECT {_ALL} FROM met)",
        "c AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST((SELECT {x} FROM {t}) AS DOUBLE) AS \"before\", CAST((SELECT {m} FROM one) AS DOUBLE) AS \"after\"" for m, x, t in [(m, m.replace("_chunk", "_mean"), "al") if m.startswith("context") else (m, m, "one") for m in E.COMPARED if m not in ("answer_relevancy_mean", "llm_judge_faithfulness_mean")]) + ")"),
    "ev08b_compare_subtypes": with_views("SELECT b.k AS subtype, b.r AS before_rate, b.n AS before_count, a.r AS after_rate, a.n AS after_count, round(a.r - b.r, 4) AS delta FROM b LEFT JOIN a ON a.k = b.k", _S,
        *[f"{t} AS (SELECT negative_subtype AS k, round(avg(CASE WHEN negative_ok THEN 1.0 ELSE 0.0 END), 4) AS r, count(*) AS n FROM met WHERE q_type = 'negative' {w} GROUP BY 1)" for t, w in (("b", ""), ("a", "AND sample_id % 4 <> 0"))]),
    "ev09_phase_exit": with_views("SELECT 'v1' AS dataset_version, sample_count, context_recall_mean, negative_reject_rate, coalesce(context_recall_mean >= 0.85 AND negative_reject_rate >= 1.0, false) AS passed FROM grp WHERE group_by = 'all' UNION ALL SELECT 'v2', sample_count, context_recall_mean, negative_reject_rate, coalesce(sample_count >= 50 AND context_recall_mean >= 0.82, false) FROM grp WHERE group_by = 'q_type' AND group_key = 'multi_hop'", _S, _GROUPS),
    "ev10_graph_mode_ab": with_views("SELECT mode, n, recall, round(recall - (SELECT recall FROM m WHERE mode = 'lite'), 4) AS delta, row_number() OVER (ORDER BY recall DESC NULLS LAST, mode) = 1 AS is_best FROM m", _S,
        "m AS (SELECT mode, round(avg(context_recall), 4) AS recall, count(*) AS n FROM met, (SELECT 'legacy' AS mode UNION ALL SELECT 'linear' UNION ALL SELECT 'lite') x WHERE context_recall IS NOT NULL AND (mode <> 'linear' OR sample_id % 2 = 0) AND (mode <> 'legacy' OR sample_id % 3 = 0) GROUP BY 1)"),
    "ev11_diagnose": with_views("SELECT group_by, group_key, CASE WHEN w AND (f OR r) THEN 'both' WHEN w OR l THEN 'retrieval' WHEN r OR f THEN 'generation' ELSE 'balanced' END AS bottleneck FROM (SELECT group_by, group_key, coalesce(context_recall_mean < 0.6, false) AS w, coalesce(context_precision_mean < 0.35, false) AS l, coalesce(faithfulness_mean < 0.6, false) AS f, coalesce(negative_reject_rate < 0.5, false) AS r FROM grp) x", _S, _GROUPS),
    "ag16_eval_aggregate": with_views(_agg(), _S),
    "ag16b_eval_aggregate_all_rows": with_views(f"SELECT count(*) AS sample_count, {_ALL} FROM met", _S),
    "ag17_eval_aggregate_by": with_views("SELECT group_by, group_key, sample_count, context_recall_mean, mrr_mean, retrieval_hit_rate, negative_reject_rate, faithfulness_mean FROM grp", _S, _GROUPS),
    "ag19_hit_buckets": with_views("SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN i.want IS NULL THEN 'n/a' WHEN p.both >= w.n THEN 'full' WHEN coalesce(p.both, 0) = 0 THEN 'miss' ELSE 'partial' END AS bucket FROM base b LEFT JOIN per p ON p.sample_id = b.sample_id LEFT JOIN ideal i ON i.sample_id = b.sample_id LEFT JOIN (SELECT sample_id, count(*) AS n FROM rel GROUP BY 1) w ON w.sample_id = b.sample_id) x GROUP BY 1", _S),
    "ag21_dataset_audit": "WITH s AS (SELECT item_id, text, concat('kb', item_id % 4) AS kb FROM benchmark) SELECT 'banned phrase' AS rule, CAST(item_id AS VARCHAR) AS subject, CAST(1 AS BIGINT) AS found FROM s WHERE text LIKE '%the %' UNION ALL SELECT 'positive without relevant chunks', CAST(item_id AS VARCHAR), 1 FROM s WHERE item_id % 5 <> 0 AND item_id % 3 = 2 UNION ALL SELECT 'invalid type', CAST(item_id AS VARCHAR), 1 FROM s WHERE item_id % 5 = 4 UNION ALL SELECT 'missing field', CAST(item_id AS VARCHAR), 1 FROM s WHERE item_id % 11 = 0 UNION ALL SELECT 'negative without subtype', CAST(item_id AS VARCHAR), 1 FROM s WHERE item_id % 5 = 0 AND item_id % 2 = 1 UNION ALL SELECT 'too few', k, n FROM (SELECT 'negatives' AS k, 40 AS least, count(*) AS n FROM s WHERE item_id % 5 = 0 UNION ALL SELECT 'unrelated negatives', 20, count(*) FROM s WHERE item_id % 10 = 0 UNION ALL SELECT 'near_domain negatives', 20, 0 UNION ALL SELECT 'multi-relevant samples', 30, count(*) FROM s WHERE item_id % 3 = 0 UNION ALL SELECT 'kbs', 5, count(DISTINCT kb) FROM s) t WHERE n < least UNION ALL SELECT 'too few of a kb', kb, count(*) FROM s GROUP BY kb HAVING count(*) < 40",
    "st04_relevant_retrieved": with_views("SELECT b.sample_id, coalesce(c.common, '') AS common FROM base b LEFT JOIN (SELECT sample_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS common FROM (SELECT DISTINCT sample_id, id FROM hit WHERE gain IS NOT NULL) h GROUP BY 1) c ON c.sample_id = b.sample_id", _S),
}
QUERIES = {k: v for k, v in globals().items() if k[:2] in ("ev", "ag", "st") and callable(v)}
