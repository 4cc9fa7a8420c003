"""Envelopes hold every row."""

import io
import json

from quarrygraph import api


def test_all_rows(spark):
    df = spark.range(2500).selectExpr("id", "map('a', id) AS m")
    assert {r["id"] for r in api.envelope(lambda: df)["data"]} == set(range(2500))
    out = io.StringIO()
    assert api.print_envelope(lambda: {"rows": df, "none": df.limit(0), "n": 1}, out)
    got = json.loads(out.getvalue())
    assert got["success"] and got["data"]["none"] == [] and got["data"]["n"] == 1
    assert sorted(got["data"]["rows"], key=lambda r: r["id"]) == [{"id": i, "m": {"a": i}} for i in range(2500)]


def test_failure_after_rows(spark):
    bad = spark.range(10).selectExpr("id", "raise_error('no') AS x")
    out = io.StringIO()
    assert not api.print_envelope(lambda: {"good": spark.range(5), "bad": bad}, out)
    assert json.loads(out.getvalue())["success"] is False
