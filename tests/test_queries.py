"""Every registered query against its oracle on the smallest tables."""

import json
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from tablecheck.queries import ORACLE_SQL, QUERIES
from tablecheck.queries.registry import TABLES
from tests.conftest import ROOT, SF


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    got = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(tuple(str(v) for _, v in sorted(zip(names, r, strict=True), key=lambda x: x[0])) for r in got.fetchall())
    assert sorted(tuple(str(r[c]) for c in sorted(names)) for r in rows) == want


def test_min_by_max_by_with_ties_and_nulls(spark, tmp_path):
    """Rows in order of their keys, in two files; SQL on one thread takes the first of equal prices and passes over NULL keys and prices."""
    nan, zero = float("nan"), -0.0
    rows = [(1, 7, 5.0), (2, 7, 9.0), (3, 7, 9.0), (4, 7, 5.0), (5, 8, None), (None, 8, 1.0), (6, 8, 2.0), (7, 8, 2.0), (None, 9, 3.0), (8, 9, None)]
    rows += [(10, 10, nan), (11, 10, nan), (12, 10, 1.0), (13, 11, 0.0), (14, 11, zero), (-(2**63), 12, 4.0), (15, 12, 4.0), (16, None, 1.0), (17, None, 1.0)]
    rows += [(20 + i, 13, float(i % 2)) for i in range(40)]
    where = str(tmp_path / "orders.parquet")
    half = len(rows) // 2
    for part in (rows[:half], rows[half:]):
        spark.createDataFrame(part, "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).write.mode("append").parquet(where)
    files = sorted((f for f in os.listdir(where) if f.endswith(".parquet")), key=lambda f: os.path.getmtime(f"{where}/{f}"))
    c = duckdb.connect(config={"threads": 1})
    c.execute(f"CREATE TABLE orders AS SELECT * FROM '{where}/{files[0]}' UNION ALL SELECT * FROM '{where}/{files[1]}'")
    want = {k: (a, b) for k, a, b in c.execute(ORACLE_SQL["min_by_max_by"]).fetchall()}
    assert want[7] == (2, 1) and want[8] == (6, 6) and want[9] == (None, None)
    assert {r.o_custkey: (r.dearest, r.cheapest) for r in QUERIES["min_by_max_by"](spark, str(tmp_path)).collect()} == want


def test_entry_without_the_corpus_folders(tmp_path):
    """A copy of the repository without them imports and has all other queries; another missing module is no reason to drop queries."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm", "corpus_pipeline.py", "spark-warehouse"))
    (copy / "tablecheck/llm/__pycache__").mkdir(parents=True)

    def told(where):
        code = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
        return subprocess.run([sys.executable, "-c", code], cwd=where, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(where)})

    assert json.loads(told(copy).stdout) == [sorted(QUERIES), sorted(ORACLE_SQL)]
    (copy / "corpus_pipeline.py").write_text("import no_such_module")
    assert "no_such_module" in told(copy).stderr
