"""Literal cases of single rules."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.operators import chunking as K
from docweave.operators import evaluation as E
from docweave.operators import governance as G
from docweave.operators import ann, graph, ranking, stats, vectors


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_terms(spark):
    assert set(one(spark, T.retrieval_terms(F.lit("ReAct 与检索增强，AI a 生成")))) == {"react", "检索", "增强", "ai", "生成"}
    assert set(one(spark, T.substantive_terms(F.lit("请介绍 知识 图谱")))) == {"绍", "图谱"}
    assert one(spark, T.fts_query_terms(F.lit("  "))) is None
    assert one(spark, T.fts_query_terms(F.lit("ab 中文"))) == ["ab", "中", "文"]
    assert one(spark, T.fts_query_terms(F.lit("!?"))) == ["!?"]
    assert set(one(spark, T.anchor_terms(F.lit("「向量 检索」本知识库中图谱章节")))) == {"向量", "检索", "图谱"}


@pytest.mark.parametrize(("question", "route"), [
    ("", "chitchat"), ("你好", "chitchat"), ("what is this", "chitchat"), ("谢谢？", "factual"), ("A和B的区别", "relational"), ("综合两段内容说明关联在哪里以及更多更多更多更多更多", "relational"), ("总结一下这份文档", "comprehensive"), ("向量索引怎样建立", "factual"),
])
def test_route(spark, question, route):
    assert one(spark, T.route_query(F.lit(question))) == route


def test_top_k(spark):
    assert one(spark, T.route_top_k(F.lit("chitchat"), F.lit("hi"))) == 0
    assert one(spark, T.route_top_k(F.lit("comprehensive"), F.lit("x" * 20))) == 4
    assert one(spark, T.route_top_k(F.lit("factual"), F.lit("x" * 81))) == 6
    assert one(spark, T.dynamic_top_k(F.lit("short"))) == 4 and one(spark, T.dynamic_top_k(F.lit("x" * 90))) == 7


def test_anchors_and_parts(spark):
    q = "「向量索引」和「全文检索」之间有什么联系"
    assert one(spark, T.quote_anchors(F.lit(q))) == ["向量索引", "全文检索"]
    assert one(spark, T.multi_hop_anchors(F.lit(q))) == ["向量索引", "全文检索"]
    assert one(spark, T.multi_hop_anchors(F.lit("缓存与索引的关系"))) == ["缓存", "索引的"]  # the second part is greedy
    assert one(spark, T.sub_queries(F.lit("什么是向量索引？什么是全文检索？"))) == ["什么是向量索引", "什么是全文检索"]
    assert one(spark, T.sub_queries(F.lit("短"))) == ["短"] and one(spark, T.sub_queries(F.lit(" "))) == []
    long = "《" + "a" * 30 + "》"
    assert one(spark, T.search_variants(F.lit(long)))[:2] == [long, long[:24]]
    assert one(spark, T.parse_sources(F.lit("not json"))) == [] and one(spark, T.parse_sources(F.lit(None).cast("string"))) == []


def test_metrics(spark):
    ids = lambda *x: F.array(*[F.lit(i) for i in x])
    assert one(spark, E.mrr(ids("x", "a"), ids("a"))) == 0.5
    assert one(spark, E.precision_at(ids("a", "b", "x"), ids("a", "b"), 3)) == 0.6667
    grades = F.create_map(F.lit("a"), F.lit("primary"), F.lit("b"), F.lit("supporting"))
    assert one(spark, E.ndcg(ids("a", "b"), ids("a", "b"), grades)) == 1.0
    assert one(spark, E.grounding(F.lit("?"), ids("alpha"))) == 1.0 and one(spark, E.grounding(F.lit("alpha"), ids("?"))) == 0.0


def test_fusion_and_filters(spark):
    lists = spark.createDataFrame([(1, 0, "a", 1), (1, 0, "b", 2), (1, 0, "c", 3), (1, 1, "b", 1), (1, 1, "d", 2)], "query_id long, list_no int, chunk_id string, rank int")
    assert [r.chunk_id for r in ranking.rrf_fuse(lists).orderBy("rank").collect()][0] == "b"
    assert one(spark, ranking.blend_quality(F.lit(0.8), F.lit(0.2))) == 0.62
    rows = spark.createDataFrame([(1, i, 7, 0.9 - i / 10, None, i + 1) for i in range(4)], "query_id long, chunk_id long, document_id long, score double, model_score double, rank int")
    assert sorted(r.chunk_id for r in ranking.post_retrieval_filter(rows).collect()) == [0, 1]
    low = rows.withColumn("model_score", F.lit(0.1) + F.col("chunk_id") / 100)
    assert [r.chunk_id for r in ranking.post_retrieval_filter(low).collect()] == [3]
    assert ranking.post_retrieval_filter(low, soft_fallback=False).count() == 0


def test_context_budget(spark):
    rows = spark.createDataFrame([(1, 1, "x" * 10), (1, 2, "y" * 100), (1, 3, "z")], "query_id long, rank int, content string")
    text = ranking.pack_context(rows, 40).first()["context"]
    assert text.startswith("[来源 1] xxxxxxxxxx\n\n[来源 2] y") and text.endswith("…") and "z" not in text


def test_gate_distances(spark):
    v = spark.createDataFrame([(1, "k", [1.0, 0.0]), (2, "k", [0.0, 1.0])], "chunk_id long, kb_id string, embedding array<double>")
    new = spark.createDataFrame([(10, "k", "text", [1.0, 0.0]), (11, "k", " ", [1.0, 0.0]), (12, "other", "text", [1.0, 0.0]), (13, "k", "t", [1.0, 1.0])], "chunk_id long, kb_id string, content string, embedding array<double>")
    got = {r.chunk_id: (r.status, r.similarity) for r in vectors.ingest_gate(new, v).collect()}
    assert got == {10: ("duplicate", 1.0), 11: ("allow", None), 12: ("allow", None), 13: ("duplicate", 0.9571)}


def test_vector_topk_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, i % 3, [float(x) for x in m[i]]) for i in range(300)], "chunk_id long, kb_id int, embedding array<double>")
    q = df.where("chunk_id % 10 = 0").withColumnRenamed("chunk_id", "query_id")
    got = {(r.query_id, r["rank"]): r.chunk_id for r in vectors.vector_topk(q, df, 5, block_rows=7).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for i in range(0, 300, 10):
        d = [(round(1 - float(u[i] @ u[j]), 6), j) for j in range(300) if j % 3 == i % 3]
        assert [got[i, k + 1] for k in range(5)] == [j for _, j in sorted(d)[:5]]


def test_pairs_within_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    m = np.concatenate([rng.normal(size=(60, 4)), rng.normal(size=(1, 4)).repeat(6, axis=0)])
    df = spark.createDataFrame([(i, i % 2, [float(x) for x in m[i]], "2024-01-01") for i in range(66)], "chunk_id long, kb_id int, embedding array<double>, created_at string")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = {(i, j) for i in range(66) for j in range(i + 1, 66) if i % 2 == j % 2 and round(1 - float(u[i] @ u[j]), 6) <= 0.4}
    assert {(r.a, r.b) for r in ann.pairs_within(df, 0.4, block_rows=7).collect()} == near
    first = {i: min(j for j in range(66) if j % 2 == i % 2 and (m[i] == m[j]).all()) for i in range(66)}
    want = {(i, j) for i, j in near if first[i] == i and first[j] in (i, j)}
    assert {(r.a, r.b) for r in vectors.near_duplicate_pairs(df).collect()} == want


def test_supporting_chunk_with_many_ties(spark):
    rows = [(1, 7, 5), *((i, 7, 3) for i in range(10, 30)), (2, 7, 9), (3, 8, 0)]
    df = spark.createDataFrame(rows, "chunk_id long, document_id long, chunk_index long")
    got = {r.chunk_id: r.supporting_id for r in stats_free_supporting(df).collect()}
    assert got[1] == 10 and got[10] == 11 and got[11] == 10 and got[2] == 10 and got[3] is None


def stats_free_supporting(df):
    from docweave.operators.dataset import supporting_chunk

    return supporting_chunk(df)


def spec_split(text, size, overlap):
    """A character at a time."""
    out, cur = [], ""
    for ch in text:
        cur += ch
        if len(cur) >= size:
            cut, begin = -1, int(len(cur) * 0.8)
            for s in K.SEPARATORS:
                p = cur[begin:].rfind(s)
                if p != -1 and abs(begin + p + len(s) - size) < abs(cut - size):
                    cut = begin + p + len(s)
            cut = cut if cut > 0 else len(cur)
            out.append(cur[:cut].strip())
            cur = cur[max(0, cut - overlap):]
    return [*out, cur.strip()] if cur.strip() else out


def test_fixed_chunks_equal_the_spec():
    rng = random.Random(5)
    for _ in range(150):
        text = "".join(rng.choice(["ab", "词", "。", ". ", "\n", "\n\n", " ", "? ", "；", "x" * 9]) for _ in range(rng.randint(0, 400)))
        size = rng.choice([20, 50, 117])
        assert K.split_fixed(text, size, size // 10) == spec_split(text, size, size // 10)


def test_structured_chunks(spark):
    assert K.split_paragraphs("x", noise=30) == []
    md = "# A\n" + "a" * 40 + "\n## B\n" + "b" * 50 + "\n# C\n" + "c" * 35
    assert K.split_markdown(md) == [("a" * 40, "A"), ("b" * 50, "A > B"), ("c" * 35, "C")]
    assert K.merged_paragraphs("aa\n\nbb\n\n" + "c" * 10, 6) == ["aa\n\nbb", "c" * 10]
    docs = spark.createDataFrame([(1, "k", "txt", "short"), (2, "k", "txt", "  "), (3, "k", "txt", None)], "document_id long, kb_id string, file_type string, text string")
    kbs = spark.createDataFrame([], "kb_id string, chunk_size int, chunk_overlap int")
    assert [(r.document_id, r.content) for r in K.build_chunks(docs, kbs).collect()] == [(1, "short")]


def rels(spark, *rows):
    return spark.createDataFrame([("k", c, s, p, o) for s, o, c, p in rows], "kb_id string, chunk_id long, subject string, predicate string, object_entity string")


def test_graph_expansion_needs_a_bridge(spark):
    seeds = spark.createDataFrame([(1, "k", "AA"), (1, "k", "BB")], "query_id long, kb_id string, entity string")
    apart = rels(spark, ("AA", "X1", 1, "r"), ("BB", "Y1", 2, "r"))
    assert graph.graph_expand(seeds, apart).count() == 0
    bridge = rels(spark, ("AA", "BB", 3, "r"), ("AA", "X1", 1, "r"))
    assert {r.chunk_id: r.score for r in graph.graph_expand(seeds, bridge).collect()}[3] == 1.2


def test_entity_linking(spark):
    names = spark.createDataFrame([("k", n) for n in ["向量索引", "缓存", "图数据库", "abc", "向量素引"]], "kb_id string, entity string")
    q = spark.createDataFrame([(1, "k", "向量索引怎么建")], "query_id long, kb_id string, question string")
    assert {r.entity for r in graph.link_entities(q, names).collect()} == {"向量索引", "向量素引"}


def test_triples(spark):
    c = spark.createDataFrame([("k", 1, "缓存是内存结构。索引与缓存，"), ("k", 2, None)], "kb_id string, chunk_id long, content string")
    assert {(r.subject, r.predicate, r.object_entity) for r in graph.extract_triples(c).collect()} == {("缓存", "是", "内存结构"), ("索引", "关联", "缓存")}


def test_quality_rules(spark):
    f = lambda **k: one(spark, stats.quality_score(*[F.lit(k[c]) for c in ("h", "li", "di", "co")], F.lit("2024-01-01").cast("timestamp_ntz"), "2024-01-01"))
    assert f(h=20, li=1, di=0, co=0) == 0.8 and f(h=0, li=0, di=0, co=0) == 0.25 and f(h=0, li=0, di=5, co=9) == 0.0


def test_transitions(spark):
    s = spark.createDataFrame([(1, "pending"), (2, "dismissed"), (3, "pending")], "suggestion_id long, status string")
    e = spark.createDataFrame([(1, 2, "execute"), (1, 1, "approve"), (1, 3, "approve"), (2, 1, "rollback"), (2, 2, "approve")], "suggestion_id long, seq int, event string")
    got = {r.suggestion_id: (r.status, r.audit) for r in G.apply_transitions(s, e).collect()}
    assert got == {1: ("executed", ["approve:pending>approved", "execute:approved>executed"]), 2: ("approved", ["rollback:dismissed>pending", "approve:pending>approved"]), 3: ("pending", [])}


def test_consistency(spark):
    p = spark.createDataFrame([(1, "", "x", ""), (2, " a ", "a", ""), (3, "天地玄黄", "x", "宇宙洪荒"), (4, "x", "y", "")], "pair_id int, answer_a string, answer_b string, answer_param string")
    assert {r.pair_id: r.verdict for r in G.consistency_shortcuts(p).collect()} == {1: "UNCERTAIN", 2: "OK", 3: "CONFLICT", 4: "needs_judge"}
