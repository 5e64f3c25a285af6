"""Rows that a row is exploded into are not broadcast: Spark takes them for as few bytes as the row has."""

import random

from docweave.operators import graph, search
from docweave.operators.common import materialised


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_linking_broadcasts_nothing(spark):
    names = materialised(spark.createDataFrame([("k", "P0000001"), ("k", "零一二三四"), ("l", "P1")], "kb_id string, entity string"))
    asked = materialised(spark.createDataFrame([(1, "k", "P0000001 与 一二三 的关系"), (2, "l", "P2")], "query_id long, kb_id string, question string"))
    found = graph.link_entities(asked, names)
    assert "Generate" in plan(found) and "BroadcastHashJoin" not in plan(found)
    assert sorted((r.query_id, r.entity) for r in found.collect()) == [(1, "P0000001"), (1, "零一二三四"), (2, "P1")]


def test_best_chunks_broadcast_nothing_and_equal_a_loop(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("零一二三") for _ in range(n))
    chunks = [(i, rng.choice("kl"), text(rng.randint(0, 7))) for i in range(400)] + [(1000 + i, "k", "a零一b") for i in range(50)]
    asked = [(q, rng.choice("kl"), text(rng.randint(1, 6))) for q in range(30)]
    grams = lambda t: list(dict.fromkeys(t[i : i + w] for w in (4, 3, 2) for i in range(len(t) - w + 1)))[:8]
    want = set()
    for q, kb, t in asked:
        met = sorted((-round(len(set(t) & set(c)) / len(set(t)), 4), i) for i, k, c in chunks if k == kb and any(g in c for g in grams(t)))
        want |= {(q, i, -s, n) for n, (s, i) in enumerate(met[:2], 1)}
    found = search.best_chunks_for_question(materialised(spark.createDataFrame(asked, "query_id long, kb_id string, question string")), materialised(spark.createDataFrame(chunks, "chunk_id long, kb_id string, content string")))
    assert "Generate" in plan(found) and "BroadcastHashJoin" not in plan(found)
    assert {(r.query_id, r.chunk_id, r.score, r["rank"]) for r in found.collect()} == want
