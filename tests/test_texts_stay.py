"""Texts are counted where they lie: postings of odd contents, and no shuffle of texts before something is found."""

import io
from contextlib import redirect_stdout

from docweave.operators import search
from docweave.plans import composite_queries, search_queries


def test_postings_of_odd_contents(spark):
    rows = [(1, "k", "B_1 b_1 a xx 中中文", True), (2, "k", None, True), (3, "k", "", True), (4, "k", "aa", False), (5, None, "İX ÄÖ é aa\naa", True)]
    got = search.build_postings(spark.createDataFrame(rows, "chunk_id long, kb_id string, content string, is_active boolean")).collect()
    assert {(r.chunk_id, r.kb_id, r.term, r.tf, r.doc_len) for r in got} == {(1, "k", "b_1", 2, 6), (1, "k", "xx", 1, 6), (1, "k", "中", 2, 6), (1, "k", "文", 1, 6), (5, None, "aa", 2, 2)}
    assert sorted(r.chunk_id for r in got if r.head) == [1, 5]


def test_texts_meet_no_events_and_no_vectors(spark, small):
    for df in (composite_queries._chunks(spark, small), search.build_postings(composite_queries._chunks(spark, small))):
        out = io.StringIO()
        with redirect_stdout(out):
            df.explain()
        assert "Join" not in out.getvalue() and "Exchange" not in out.getvalue()


def test_found_rows_are_written_before_they_meet_texts(spark, small, monkeypatch):
    written, real = [], search_queries.materialised
    monkeypatch.setattr(search_queries, "materialised", lambda df: written.append(df.columns) or real(df))
    search_queries._candidates(spark, small)
    assert ["query_id", "chunk_id", "score", "rank"] in written
