"""Every registered query against its SQL, and what stands without the corpus operators."""

import ast
import glob
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tallyloom import catalog

ROOT = Path(__file__).resolve().parents[1]


def cells(frame, columns):
    def show(v):
        if pd.isna(v):
            return "null"
        if isinstance(v, bool) or str(v) in ("True", "False"):
            return str(v)
        return repr(round(float(v), 6)) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted(tuple(show(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for f in glob.glob(f"{tiny}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, tiny, name):
    ours = catalog.queries()[name](spark, tiny).toPandas()
    theirs = duck.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    assert cells(ours, columns) == cells(theirs, columns)


def test_only_random_rows_lack_sql():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"synthetic_rows", "intent_classifier", "semantic_grade", "domain_match", "diverse_phrases", "meta_grader"}


def test_synthetic_rows_are_seeded(spark, tiny):
    rows = catalog.queries()["synthetic_rows"](spark, tiny)
    assert rows.count() == 500 and rows.filter("label < 0 OR label > 1").count() == 0
    assert rows.collect() == catalog.queries()["synthetic_rows"](spark, tiny).collect()


def test_nothing_else_imports_the_corpus_operators():
    for p in (ROOT / "tallyloom").rglob("*.py"):
        if "llm" in p.parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n or "corpus_pipeline" in n for n in names), p


def test_entry_without_the_corpus_operators(tmp_path):
    for name in ("__spark_entry__.py", "tallyloom"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    package = tmp_path / "tallyloom"
    package.mkdir()
    for p in (ROOT / "tallyloom").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (package / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op1') for n in e.queries()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert out == [str(len(catalog.queries())), str(len(catalog.oracle_sql())), "False"]


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark)
    assert rows.count() > 0 and "strength" in rows.columns
