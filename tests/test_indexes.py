"""The vector index, the incremental text index, bounds of BM25, prefixes of ids and the cache of vectors, against plain versions."""

import hashlib
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.operators import ann, embedding_cache, governance, search, text_index, vectors
from docweave.plans import search_queries
from docweave.sources import store

VECTORS = "chunk_id long, kb_id string, embedding array<double>"


def clustered(seed, n, dims=16, centres=30, spread=0.15):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    return [(i, "a" if i % 5 else "b", [float(x) for x in c[rng.integers(centres)] + rng.normal(size=dims) * spread]) for i in range(n)]


def distances(rows, others):
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
    return np.round(1 - unit(np.array([r[2] for r in rows])) @ unit(np.array([o[2] for o in others])).T, 6)


def plain_topk(rows, queries, k):
    d, out = distances(queries, rows), set()
    for i, q in enumerate(queries):
        near = sorted((d[i, j], r[0]) for j, r in enumerate(rows) if r[1] == q[1])[:k]
        out |= {(q[0], c, x, n + 1) for n, (x, c) in enumerate(near)}
    return out


@pytest.mark.parametrize("block_rows", [20_000, 40])
def test_exact_index_equals_brute_force(spark, block_rows):
    rows = clustered(1, 1500) + [(9000, "a", [0.0] * 16), (9001, "a", clustered(1, 1)[0][2])]
    queries = [r for r in rows if r[0] % 100 == 0] + [(9002, "c", rows[0][2])]
    df, q = spark.createDataFrame(rows, VECTORS), spark.createDataFrame(queries, VECTORS).withColumnRenamed("chunk_id", "query_id")
    centroids = ann.train_centroids(df, 24)
    index = ann.build_index(df, centroids)
    found = ann.exact_topk(q, index, centroids, 10, first=2, block_rows=block_rows)
    assert {(r.query_id, r.chunk_id, r.distance, r["rank"]) for r in found.collect()} == plain_topk(rows, queries, 10)
    cells = ann.visited_cells(q, index, centroids, found, 10).where("query_id < 9000").agg(F.sum("needed"), F.sum("cells")).first()
    assert cells[0] < 0.5 * cells[1]  # bounds leave most cells unread
    near = ann.approximate_topk(q, index, centroids, 10, probes=3)
    assert near.count() and near.join(found, ["query_id", "chunk_id"]).count() >= 0.9 * found.count()


def test_approximate_query_has_its_recall(spark, small):
    exact = {(r.query_id, r.chunk_id) for r in search_queries.X.vector_topk(search_queries._vector_queries(spark, small), search_queries._vectors(spark, small), 30).collect()}
    found = {(r.query_id, r.chunk_id) for r in search_queries.sr03d_index_approximate(spark, small).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


@pytest.mark.parametrize("most", [0.0, 0.02, 0.3])
def test_pairs_within_equal_all_pairs(spark, most):
    rows = clustered(2, 700) + [(9000, "a", [0.0] * 16), (9001, "a", clustered(2, 1)[0][2]), (9002, "b", clustered(2, 1)[0][2])]
    d = distances(rows, rows)
    want = {(min(x[0], y[0]), max(x[0], y[0]), d[i, j]) for i, x in enumerate(rows) for j, y in enumerate(rows[:i]) if x[1] == y[1] and d[i, j] <= most}
    df = spark.createDataFrame(rows, VECTORS)
    for block_rows in (20_000, 50):
        assert {tuple(r) for r in ann.pairs_within(df, most, cells=16, block_rows=block_rows).collect()} == want
    if most == 0.02:
        tried = ann.pairs_within(df, most, cells=64, counted=True).agg(F.sum("candidates")).first()[0]
        every = sum(n * (n - 1) // 2 for n in (sum(r[1] == k for r in rows) for k in "ab"))
        assert len(want) <= tried < every / 5
    assert ann.pairs_within(df.where("false"), most).count() == 0


def test_equal_vectors_stay_one_class(spark):
    rows = [(i, "a", "2024-01-01", [1.0, 0.0]) for i in range(200)] + [(300, "a", "2024-01-01", [0.0, 1.0]), (301, "a", "2024-01-01", None)]
    got = vectors.near_duplicate_pairs(spark.createDataFrame(rows, "chunk_id long, kb_id string, created_at string, embedding array<double>"))
    assert {(r.a, r.b) for r in got.collect()} == {(0, i) for i in range(1, 200)}


# ---------------------------------------------------------------- full text

WORDS = [f"w{i}" for i in range(300)]


def chunk_rows(rng, n, begin=0):
    return [(f"k{i % 3}", begin + i, " ".join(rng.choices(WORDS, [1 / (j + 1) for j in range(300)], k=rng.randint(1, 80))), i % 17 != 0) for i in range(n)]


CHUNKS = "kb_id string, chunk_id long, content string, is_active boolean"


def plain_bm25(chunks, queries, limit):
    docs = {c: (kb, re.findall(r"[0-9a-z_]{2,}", text.lower())) for kb, c, text, active in chunks if active}
    docs = {c: v for c, v in docs.items() if v[1]}
    n, avg = len(docs), sum(len(t) for _, t in docs.values()) / len(docs)
    df = {}
    for _, t in docs.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = set()
    for q, kb, text in queries:
        scores = {}
        for w in set(re.findall(r"[0-9a-z_]{2,}", text.lower())):
            idf = max(math.log((n - df.get(w, 0) + 0.5) / (df.get(w, 0) + 0.5)), 1e-6)
            for c, (k, t) in docs.items():
                if w in t and kb in (None, k):
                    tf = t.count(w)
                    scores[c] = scores.get(c, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
        best = sorted((-round(s, 6), c) for c, s in scores.items())[:limit]
        out |= {(q, c, i + 1) for i, (_, c) in enumerate(best)}
    return out


def asked(rng, n=30):
    return [(i, None if i % 4 == 0 else f"k{i % 3}", " ".join(rng.choices(WORDS, k=rng.randint(1, 6)) + ["w0", "w1", "w2"])) for i in range(n)] + [(99, "k0", "nothing here")]


QUESTIONS = "query_id long, kb_id string, question string"


@pytest.mark.parametrize("first", [search.FIRST_POSTINGS, 1])
def test_bounded_bm25_equals_a_loop(spark, monkeypatch, first):
    monkeypatch.setattr(search, "FIRST_POSTINGS", first)
    rng = random.Random(4)
    chunks, queries = chunk_rows(rng, 400), asked(rng)
    df = spark.createDataFrame(chunks, CHUNKS)
    for limit in (5, 30):
        got = search.bm25_search(spark.createDataFrame(queries, QUESTIONS), search.build_postings(df), limit)
        assert {(r.query_id, r.chunk_id, r["rank"]) for r in got.collect()} == plain_bm25(chunks, queries, limit)
    assert search.bm25_search(spark.createDataFrame(queries, QUESTIONS).where("query_id = 99"), search.build_postings(df)).count() == 0


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_incremental_index_equals_a_fresh_build(spark, tmp_path):
    rng, path = random.Random(6), f"{tmp_path}/index"
    rows = {r[1]: r for r in chunk_rows(rng, 200)}
    queries = asked(rng)
    questions = spark.createDataFrame(queries, QUESTIONS)
    for step in range(4):
        for c in rng.sample(sorted(rows), 20):
            kb, _, text, active = rows[c]
            rows[c] = rng.choice([(kb, c, text + " w7 w7", True), (kb, c, text, not active), (kb, c, " ", True)])
        for c in rng.sample(sorted(rows), 5):
            del rows[c]
        rows |= {r[1]: r for r in chunk_rows(rng, 20, 1000 * (step + 1))}
        before = files_of(f"{path}/postings")
        version = text_index.refresh_index(spark.createDataFrame(list(rows.values()), CHUNKS), path)
        after = files_of(f"{path}/postings")
        assert version == step + 1 and before.items() <= after.items()
        got = text_index.index_search(questions, path, 10)
        assert {(r.query_id, r.chunk_id, r["rank"]) for r in got.collect()} == plain_bm25(list(rows.values()), queries, 10)
    text_index.compact_index(spark, path)
    got = text_index.index_search(questions, path, 10)
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in got.collect()} == plain_bm25(list(rows.values()), queries, 10)
    text_index.refresh_index(spark.createDataFrame(list(rows.values()), CHUNKS), path)
    last = store.versions(spark, path)[-1][0]
    assert store.read(spark, path, "postings", last, key="chunk_id").count() == store.read(spark, path, "postings", last - 1, key="chunk_id").count()
    assert spark.read.parquet(f"{path}/postings/version={last}").count() == 0


# ---------------------------------------------------------------- prefixes


def test_prefixes_of_ids(spark):
    ids = ["abc-1", "abc-2", "abd-1", "x", "xy", "xyz-long-one"]
    refs = ["a", "ab", "abc", "abc-1", "abd", "abd-1", "x", "xy", "xyz", " abd ", "", "  ", None, "zz", "abc-1-longer", "xyz-long-one-and-more"]
    got = {r.ref: (r.kb_id, r.problem) for r in governance.resolve_kb_id(spark.createDataFrame([(r,) for r in refs], "ref string"), spark.createDataFrame([(i,) for i in ids], "kb_id string")).collect()}
    for ref in refs:
        raw = (ref or "").strip()
        found = [i for i in ids if i.startswith(raw)]
        kb = raw if raw in ids else found[0] if raw and len(found) == 1 else None
        assert got[ref] == (kb, None if kb else "blank" if not raw else "ambiguous" if found else "missing"), ref
    tables = {"one": (spark.createDataFrame([("abd", 1), ("abc", 2), (None, 3)], "kb_id string, n int"), "kb_id"), "two": (spark.createDataFrame([(5, "xyz")], "n int, knowledge_base_id string"), "knowledge_base_id")}
    done = governance.rewrite_kb_ids(tables, spark.createDataFrame([(i,) for i in ids], "kb_id string"))
    assert {tuple(r) for r in done["one"].collect()} == {("abd-1", 1), ("abc", 2), (None, 3)} and done["two"].columns == ["n", "knowledge_base_id"]
    assert [tuple(r) for r in done["two"].collect()] == [(5, "xyz-long-one")]
    assert governance.resolve_kb_id(spark.createDataFrame([("a",)], "ref string"), spark.createDataFrame([], "kb_id string")).first().problem == "missing"


# ---------------------------------------------------------------- cache


def test_each_text_is_computed_once(spark):
    calls = []

    def compute(misses):
        calls.append(sorted(r.text for r in misses.collect()))
        return misses.select("hash", F.array(F.length("text").cast("float")).alias("embedding"))

    rng, cache, plain = random.Random(8), None, {}
    for run in range(1, 5):
        texts = [rng.choice(["one", "two", "three", "four", "", None, f"new {run}"]) for _ in range(25)]
        rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
        cache = embedding_cache.empty_cache(rows) if cache is None else cache
        found, cache = embedding_cache.get_or_compute(rows, cache, compute, run)
        assert {r.id: r.embedding for r in found.collect()} == {i: [float(len(t or ""))] for i, t in enumerate(texts)}
        assert calls[-1] == sorted({t or "" for t in texts} - set(plain))
        for t in texts:
            hits, _ = plain.get(t or "", (-1, 0))
            plain[t or ""] = (hits + 1, run)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert {r["hash"]: (r.hits, r.last_used) for r in cache.collect()} == {digest(t): v for t, v in plain.items()}
        most = 5
        kept = sorted(plain, key=lambda t: (-plain[t][1], digest(t)))[:most]
        cache = embedding_cache.evict(cache, most)
        assert {r["hash"] for r in cache.collect()} == {digest(t) for t in kept}
        plain = {t: plain[t] for t in kept}
