"""Upserting ingest, ordered admission and the versioned store."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.operators.vectors import ordered_admission
from docweave.sources import store
from docweave.streaming import jobs

FILES = "kb_id string, document_id long, file_type string, text string, position long, seq long, withdrawn boolean"
TABLES = jobs.TABLES


def text_of(i, version=0):
    rng = random.Random(100 * i + version)
    return "\n\n".join(" ".join(rng.choice("alpha beta gamma delta omega river stone 文档是来源".split()) for _ in range(60)) for _ in range(1 + i % 4))


def embedded(made):
    """A stub: a vector of the chunk's own."""
    return made.withColumn("embedding", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (F.pmod(F.xxhash64("chunk_id", i), F.lit(2001)) / 1000.0 - 1).cast("float")))


def kbs(spark):
    return spark.createDataFrame([("a", 400, 40), ("b", 300, 0)], "kb_id string, chunk_size int, chunk_overlap int")


def state(spark, path, version=None):
    return {name: sorted((tuple(map(str, r)) for r in store.read(spark, path, name, version).drop("embedding").collect())) for name in TABLES}


BATCHES = [
    [("a" if i % 2 else "b", i, "txt", text_of(i), i, 0, False) for i in range(12)],
    [("a" if i % 2 else "b", i, "txt", text_of(i), i, 1, False) for i in range(12, 20)] + [("b", 4, "txt", text_of(4, 1), 4, 1, False)],
    [("a", 5, "txt", None, 5, 2, True), ("b", 6, "txt", text_of(6, 1), 6, 2, False), ("b", 6, "txt", text_of(6, 2), 6, 3, False), ("a", 99, "txt", "  ", 99, 2, False)],
    [("b", 4, "txt", text_of(4, 2), 4, 4, False), ("b", 8, "txt", None, 8, 4, True), ("a", 5, "txt", text_of(5, 3), 5, 5, False)],
]


def test_stream_of_changes_equals_one_build(spark, tmp_path):
    for b, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, FILES).write.mode("append").parquet(f"{tmp_path}/files")
        stream = spark.readStream.schema(FILES).parquet(f"{tmp_path}/files")
        jobs.upsert_stream(stream, kbs(spark), f"{tmp_path}/index", f"{tmp_path}/checkpoint", embedded, duplicate=0.0, conflict=0.0).awaitTermination()
    last = {}
    for rows in BATCHES:
        for r in rows:
            last[r[1]] = r
    jobs.upsert_batch(spark.createDataFrame(list(last.values()), FILES), kbs(spark), f"{tmp_path}/one", 2, embedded, 0.0, 0.0)
    got, want = state(spark, f"{tmp_path}/index"), state(spark, f"{tmp_path}/one")
    assert got == want and all(got[t] for t in ("chunks", "vectors", "postings", "triples", "documents"))
    assert {r.document_id for r in store.read(spark, f"{tmp_path}/index", "documents").where("status = 'failed'").collect()} == {99}
    before = state(spark, f"{tmp_path}/index", 2)
    assert before["chunks"] != got["chunks"]
    version = store.compact(spark, f"{tmp_path}/index")
    assert version == 9 and state(spark, f"{tmp_path}/index") == got and state(spark, f"{tmp_path}/index", 2) == before
    # a batch that comes again replaces itself
    jobs.upsert_batch(spark.createDataFrame(BATCHES[3], FILES), kbs(spark), f"{tmp_path}/index", 8, embedded, 0.0, 0.0)
    assert state(spark, f"{tmp_path}/index") == got and state(spark, f"{tmp_path}/index", 8) == got


def test_a_stop_between_tables_leaves_the_last_version(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/index"
    jobs.upsert_batch(spark.createDataFrame(BATCHES[0], FILES), kbs(spark), path, 2, embedded, 0.0, 0.0)
    before, real = state(spark, path), store.commit

    def stops(path, version, changed, tables, **options):
        tables = dict(tables)
        tables["triples"] = tables["triples"].withColumn("subject", F.raise_error(F.lit("stopped")).cast("string"))
        real(path, version, changed, tables, **options)

    monkeypatch.setattr(store, "commit", stops)
    with pytest.raises(Exception, match="stopped"):
        jobs.upsert_batch(spark.createDataFrame(BATCHES[1], FILES), kbs(spark), path, 4, embedded, 0.0, 0.0)
    assert state(spark, path) == before
    monkeypatch.setattr(store, "commit", real)
    jobs.upsert_batch(spark.createDataFrame(BATCHES[1], FILES), kbs(spark), path, 4, embedded, 0.0, 0.0)
    assert state(spark, path) != before and state(spark, path, 2) == before


def loop(rows, stored, duplicate, conflict):
    """A document at a time: rows (chunk_id, kb, position, vector)."""
    held, out = list(stored), {}
    for position in sorted({r[2] for r in rows}):
        new = []
        for c, kb, p, v in rows:
            if p != position:
                continue
            near = sorted((round(1 - float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 6), o) for o, k, _, w in held if k == kb)
            if not near or near[0][0] >= conflict:
                out[c] = ("allow", None)
                new.append((c, kb, p, v))
            else:
                out[c] = ("duplicate" if near[0][0] < duplicate else "conflict", near[0][1])
        held += new
    return out, held


@pytest.mark.parametrize("n_batches", [1, 5])
def test_admission_equals_a_loop(spark, n_batches):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(150, 12))
    vectors = [(centres[rng.integers(150)] + rng.normal(size=12) * rng.choice([0.05, 0.3, 0.6])) for _ in range(1500)]
    rows = [(i, "a" if i // 2 % 3 else "b", i // 2, v) for i, v in enumerate(vectors)]  # 750 documents of two chunks
    stored = [(10_000 + i, "a", -1, centres[i]) for i in range(10)]
    want, _ = loop(rows, stored, 0.05, 0.2)
    schema = "chunk_id long, kb_id string, position long, content string, embedding array<double>"
    frame = lambda rs: spark.createDataFrame([(c, k, p, "x", [float(x) for x in v]) for c, k, p, v in rs], schema)
    held, got = stored, {}
    for b in range(n_batches):
        part = [r for r in rows if r[2] * n_batches // 750 == b]
        judged = {r.chunk_id: (r.status, r.nearest_id) for r in ordered_admission(frame(part), frame(held), 0.05, 0.2).collect()}
        got |= judged
        held = held + [r for r in part if judged[r[0]][0] == "allow"]
    assert got == want and {s for s, _ in got.values()} == {"allow", "duplicate", "conflict"}


def test_admission_of_blank_and_missing(spark):
    schema = "chunk_id long, kb_id string, position long, content string, embedding array<double>"
    rows = [(1, "a", 1, "x", [1.0, 0.0]), (2, "a", 2, " ", [1.0, 0.0]), (3, "a", 3, "x", None), (4, "a", 4, "x", [1.0, 0.0]), (5, "b", 4, "x", [1.0, 0.0])]
    df = spark.createDataFrame(rows, schema)
    got = {r.chunk_id: (r.status, r.nearest_id) for r in ordered_admission(df, df.where("false")).collect()}
    assert got == {1: ("allow", None), 2: ("allow", None), 3: ("allow", None), 4: ("duplicate", 1), 5: ("allow", None)}
    assert ordered_admission(df.where("false"), df).count() == 0
