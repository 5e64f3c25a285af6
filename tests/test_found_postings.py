"""Only postings of chunks that are found meet these for the light terms."""

import re

from docweave.operators import search
from docweave.operators.common import materialised


def test_postings_of_found_chunks_alone(spark):
    rows = [(i, "k", f"common w{i % 7} v{i}", True) for i in range(200)]
    postings = materialised(search.build_postings(spark.createDataFrame(rows, "chunk_id long, kb_id string, content string, is_active boolean")))
    q = spark.createDataFrame([(1, "k", "common w3 v10")], "query_id long, kb_id string, question string")
    plan = search.bm25_search(q, postings, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join LeftSemi, \(chunk_id", plan)
