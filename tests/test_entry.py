"""The contract of the entry module, with and without the corpus subpackage."""

import importlib
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

DATA = "/root/testdata/sf0.001"


def test_queries_have_sql_or_a_reason(spark):
    entry = importlib.import_module("__spark_entry__")
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 130
    assert entry.entry(spark).count() > 0


def _names(folder) -> list[str]:
    code = "import __spark_entry__ as e; print('NAMES', *e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120, check=True).stdout
    return next(x.split()[1:] for x in said.splitlines() if x.startswith("NAMES"))


@pytest.mark.parametrize("left", ["nothing", "caches", "pipeline", "broken"])
def test_imports_without_the_corpus_subpackage(tmp_path, left):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "skeinlake", tmp_path / "skeinlake", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(root / name, tmp_path / name)
    if left != "pipeline":
        (tmp_path / "corpus_pipeline.py").unlink()
    if left == "caches":
        (tmp_path / "skeinlake/llm/__pycache__").mkdir(parents=True)
    if left == "broken":
        (tmp_path / "skeinlake/llm").mkdir()
        (tmp_path / "skeinlake/llm/__init__.py").write_text("import no_such_module")
        (tmp_path / "corpus_pipeline.py").write_text("import skeinlake.llm")
    names = _names(tmp_path)
    assert "G15" in names and not any(q.startswith("op") or q == "pipeline" for q in names)


def test_a_sample_of_queries_agrees_with_sql(spark):
    import duckdb

    entry = importlib.import_module("__spark_entry__")
    db = duckdb.connect()
    for t in ("documents", "events", "embeddings", "lineitem", "orders", "customer", "part", "region", "nation", "conversations"):
        db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    for name in ("H05", "G10", "D01", "E07", "C15", "J07", "I16", "K06", "A07", "F06"):
        df = entry.queries()[name](spark, DATA)
        names = sorted(df.columns)
        got = sorted(map(str, (tuple(r[c] for c in names) for r in df.collect())))
        want = sorted(map(str, db.execute(f"select {', '.join(names)} from ({entry.oracle_sql()[name]})").fetchall()))
        assert got == want, name
