"""Where a threshold's balls touch most cells, the join copies no vectors; previews are cut before they are shuffled."""

import re

import numpy as np

from docweave.operators import ann
from docweave.operators.common import materialised
from docweave.plans import registry


def test_balls_that_touch_most_cells_make_no_copies(spark, monkeypatch):
    rng = np.random.default_rng(4)
    dealt = []
    monkeypatch.setattr(ann, "materialised", lambda df: dealt.append(df) or materialised(df))
    spread, near = rng.normal(size=(300, 24)), np.repeat(rng.normal(size=(30, 24)), 10, axis=0) + rng.normal(size=(300, 24)) / 50
    for v, most in ((spread, 0.8), (near, 0.01)):
        rows = materialised(spark.createDataFrame([(f"c{i}", "kl"[i % 2], v[i].tolist()) for i in range(300)], "chunk_id string, kb_id string, embedding array<double>"))
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        d = np.round(1 - unit @ unit.T, 6)
        want = {(min(f"c{a}", f"c{b}"), max(f"c{a}", f"c{b}")) for a, b in np.argwhere(d <= most) if a < b and a % 2 == b % 2}
        for block in (ann.BLOCK_ROWS, 60):
            dealt.clear()
            assert {(r.a, r.b) for r in ann.pairs_within(rows, most, cells=32, block_rows=block).collect()} == want
            (cells,) = (df for df in dealt if "home" in df.columns)
            assert cells.count() == 300 if v is spread else cells.select("cell").distinct().count() > 1


def test_previews_are_cut_before_shuffles(spark, small):
    lines = registry.QUERIES["st01_scan_suggestions"](spark, small)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    whole = {x for line in lines if "Relation [" in line for x in re.findall(r"\btext#\d+", line)}
    carried = [line for line in lines if "Relation [" not in line and any(re.search(rf"(?<!substring\(){x}\b", line) for x in whole)]
    assert whole and not [line for line in carried if "Filter" not in line]
