"""Lists of ids and their references meet in shares: no id, found or not, brings all its places to one task."""

from pyspark.sql import functions as F

from docweave.operators import governance
from docweave.operators.common import materialised


def test_places_are_dealt_out(spark, monkeypatch):
    rows = [(i, [i % 7, -1, None, 3]) for i in range(400)] + [(400, []), (401, None), (402, [5, 5])]
    lists = materialised(spark.createDataFrame(rows, "suggestion_id long, chunk_ids array<long>"))
    refs = materialised(spark.createDataFrame([(i, f"f{i}", f"d{i}", "p") for i in range(6)], "chunk_id long, filename string, document_id string, preview string"))
    monkeypatch.setattr(governance, "SHARE", 20)
    seen = []
    real = governance.materialised
    monkeypatch.setattr(governance, "materialised", lambda df: seen.append(real(df)) or seen[-1])
    got = {r.suggestion_id: [(x.pos, x.filename) for x in r.refs] for r in governance.explode_refs(lists, refs).collect()}
    assert got == {i: [(at, f"f{c}") for at, c in enumerate(ids or []) if c is not None and 0 <= c < 6] for i, ids in rows}
    assert {r.chunk_id: r.shares for r in seen[0].where(F.col("chunk_id").isNull() | F.col("chunk_id").isin(-1, 3)).collect()} == {None: 21, -1: 20, 3: 23}
