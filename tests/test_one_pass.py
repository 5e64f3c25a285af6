"""The multi-hop search builds postings once and asks them twice."""

from docweave.operators import search
from docweave.plans import composite_queries as queries


def test_multi_hop_builds_postings_once(spark, small, monkeypatch):
    built, asked, build, ask = [], [], search.build_postings, search.bm25_search
    monkeypatch.setattr(search, "build_postings", lambda *a: built.append(1) or build(*a))
    monkeypatch.setattr(search, "bm25_search", lambda *a, **k: asked.append(1) or ask(*a, **k))
    queries.sr06_multi_hop_search(spark, small)
    assert (len(built), len(asked)) == (1, 2)
