"""Open-ended properties survive writes of a workspace."""

from quarrygraph import schema
from quarrygraph.operators import store


def test_extras_survive(spark, tmp_path):
    w = store.Workspace(spark, str(tmp_path), "x")
    row = lambda name, extras: (name, "class", None, f"{name}.py", None, None, None, None, extras)
    w.write(spark.createDataFrame([row("a", {"k": "1", "j": None}), row("b", {}), row("c", None)], schema.ENTITIES))
    w.write(spark.createDataFrame([row("d", {"k": "2"})], schema.ENTITIES))
    w.write(spark.createDataFrame([row("a", {"k": "3"})], schema.ENTITIES))
    files = spark.createDataFrame([("d.py",)], "file string")
    w.ingest_changes(spark.createDataFrame([row("d", {"k": "4"})], schema.ENTITIES), spark.createDataFrame([], schema.RELATIONS), files)
    assert {r.entity_name: r.extras for r in w.table("entities").collect()} == {"a": {"k": "3"}, "b": {}, "c": None, "d": {"k": "4"}}
