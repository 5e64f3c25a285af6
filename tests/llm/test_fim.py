"""Fill-in-middle against a plain version, and its edge cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from docweave.llm import fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PIECES = [" ", "\n", "\t\x0b", "a", "bc", "é", "漢字", "🙂", "\x1c", " ", "\0", "<P", "<P>", "<M>", "word "]


def plain(text, key, unit="token"):
    units = TOKEN.findall(text) if unit == "token" else list(text)
    n, h = len(units), hashlib.sha256(f"42:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("block", [1 << 20, 3, 1])
def test_transformation_equals_the_plain_version(monkeypatch, block):
    monkeypatch.setattr(fim, "BLOCK", block)
    rng = random.Random(block)
    for k in range(5000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))
        for unit in ("token", "character"):
            *rest, output = fim.transformed(text.encode(), str(k), unit=unit)
            assert (*rest, output.decode()) == plain(text, k, unit)


def test_index_holds_the_exceptions_alone():
    data = "ab é漢x🙂".encode()
    found = fim.Exceptions.of(fim.np.frombuffer(data, dtype="u1"))
    assert found.at.tolist() == [3, 5, 9] and found.excess.tolist() == [1, 3, 6]
    text = data.decode()
    for k in range(len(text) + 1):
        assert found.byte(k) == len(text[:k].encode()) and found.points(found.byte(k)) == k


def test_edges_and_round_trip(spark):
    rng = random.Random(3)
    texts = [None, "", "   ", "<S>", "a", "é " * 200_000] + ["".join(rng.choice(PIECES) for _ in range(30)) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (7, texts[7]), (None, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("mine")).withColumn("output", F.lit(1))
    made = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(made) == len(rows)
    want = sorted(((i, *plain(t or "", "" if i is None else i), t or "") for i, t in rows), key=str)
    assert sorted((tuple(r) for r in made), key=str) == want
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.where("false")).count() == 0


def test_query_equals_sql(spark, small):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    got = fim.op13_fim(spark, small).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = duckdb.sql(fim.OP13_SQL).df().sort_values("doc_id").reset_index(drop=True)
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in want.columns:
        assert (got[c].fillna(-1) == want[c].fillna(-1)).all(), c
    assert (got.restored_sha256 == [hashlib.sha256((t or "").encode()).hexdigest() for _, t in sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())]).all()
