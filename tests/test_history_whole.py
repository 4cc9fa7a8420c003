"""The history queries over whole tables, and files of one and two authors."""

from pathlib import Path

import pytest

from quarrygraph import schema
from quarrygraph.operators import history
from quarrygraph.plans import reference  # noqa: F401
from quarrygraph.plans.registry import QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.is_dir(), reason="no test data")
def test_all_rows_and_authors(spark):
    li, o = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("lineitem", "orders"))
    all_rows = li.join(o, li.l_orderkey == o.o_orderkey)
    assert QUERIES["git_summary"](spark, str(DATA)).first().changes == all_rows.selectExpr("l_orderkey", "l_partkey", "IF(l_partkey % 7 = 0, l_linenumber, 0) AS a", "IF(l_partkey % 7 = 0, l_quantity, 0) AS b").distinct().count()
    got = {r.author for r in QUERIES["gitlog_commits"](spark, str(DATA)).select("author").distinct().collect()}
    assert got == {f"c{r.o_custkey}" for r in all_rows.select("o_custkey").distinct().collect()}


def test_few_authors(spark):
    log = [("1", "ann", ["a", "b", "c"]), ("2", "bob", ["b", "c"]), ("3", "cy", ["c"]), ("4", "bob", ["b"])]
    c = spark.createDataFrame([(sha, who, 0, "feat", [(f, 1, 0) for f in files]) for sha, who, files in log], schema.COMMITS)
    got = {r.file: (r.owner, r.contributors, r.risk) for r in history.bus_factor(history.file_metrics(c), c).collect()}
    assert got == {"a": ("ann", 1, "critical"), "b": ("bob", 2, "high")}
