"""Questions made of texts with line breaks: query and SQL state one rule."""

import os

import duckdb
import pytest

from docweave.plans import registry
from tests.test_oracles import TABLES, plain

#: White space other than blanks at the places where the questions are cut.
TEXTS = ["Erhere ntan.\nEnhaly annd then reble reing the was thwhti orhe.", "\n the thing\tof and  the\nwas in re ing the that and of\nthe", "the  thing and of the (was) in re ing that of the and", "\nand of the was\n"]


@pytest.fixture(scope="module")
def broken(spark, small, tmp_path_factory):
    folder = tmp_path_factory.mktemp("breaks")
    for t in TABLES:
        os.symlink(f"{small}/{t}.parquet", folder / f"{t}.parquet") if t != "benchmark" else None
    spark.createDataFrame([(i * 6 + k, t) for i, t in enumerate(TEXTS) for k in (0, 1, 5)], "item_id long, text string").coalesce(1).write.parquet(str(folder / "benchmark.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", ["tx11_anchor_terms", "sr05_anchor_search"])
def test_line_breaks(spark, broken, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{broken}/{t}.parquet{'/*.parquet' if t == 'benchmark' else ''}')")
    assert plain(registry.QUERIES[name](spark, broken).toPandas()) == plain(c.sql(registry.SQL[name]).df())
