"""Every query with SQL gives the SQL's rows on the smallest tables; the package imports without the llm part."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
from quarrygraph.plans import problems, reference  # noqa: E402, F401
from quarrygraph.plans.registry import QUERIES, SQL  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con():
    if not DATA.is_dir():
        pytest.skip("no test data")
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    return c


def plain(v):
    return round(v, 8) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    df = QUERIES[name](spark, str(DATA))
    got = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    rel = con.sql(SQL[name])
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_rest_does_not_import_llm():
    code = "import sys, quarrygraph.plans.problems, quarrygraph.plans.reference, quarrygraph.api; sys.exit(any(m.startswith('quarrygraph.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
