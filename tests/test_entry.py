import importlib
import os
import subprocess
import sys
import time
from pathlib import Path

import pytest

import __spark_entry__ as entry
from fotolake import registry

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(registry.queries()) > 100


def test_flagship_runs(spark):
    assert entry.entry(spark).columns == ["id", "taken_at"]


@pytest.mark.parametrize("missing", ["fotolake.llm", "xxhash"])
def test_the_rest_works_without_the_optional_part(monkeypatch, missing):
    """Without the folder, and without a package that only it needs."""
    for name in [m for m in sys.modules if m.startswith(("fotolake.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    try:
        again = importlib.reload(entry)
        assert set(again.queries()) == set(registry.queries()) and set(again.oracle_sql()) == set(registry.oracle_sql())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


@pytest.mark.parametrize("family", registry.FAMILIES)
def test_queries_equal_their_twins(spark, family):
    duckdb = pytest.importorskip("duckdb")
    sys.path.insert(0, "tools")
    from tools.compare import TABLES, multiset

    plan = importlib.import_module(f"fotolake.plans.{family}")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, query in plan.QUERIES.items():
        frame = query(spark, SF)
        rows = frame.collect()
        if name in plan.SQL:
            result = con.execute(plan.SQL[name])
            columns = [d[0] for d in result.description]
            assert sorted(columns) == sorted(frame.columns), name
            assert multiset(frame.columns, rows) == multiset(columns, result.fetchall()), name


def test_working_tables_go_with_the_session(tmp_path):
    """A driver that ends leaves nothing in the shared folder; what was there before stays."""
    code = f"""
from fotolake import storage
from fotolake.session import local_session
spark = local_session(2, 2, "1g", "cleanup")
assert storage.settled(storage.settled(spark.range(5).toDF("a.b"))).count() == 5
import os
assert len([n for n in os.listdir("{tmp_path}") if n.startswith("fotolake-")]) == 2
"""
    (tmp_path / "other").mkdir()
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=ROOT, env=os.environ | {"PYSPARK_SUBMIT_ARGS": f"--conf spark.checkpoint.dir=file://{tmp_path} pyspark-shell"})
    left = lambda: [n for n in os.listdir(tmp_path) if n.startswith("fotolake-")]
    for _ in range(100):
        if not left():
            break
        time.sleep(0.1)
    assert not left() and (tmp_path / "other").exists()
