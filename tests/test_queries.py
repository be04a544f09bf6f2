"""Registered queries against their DuckDB statements, on the smallest tables."""

from __future__ import annotations

import logging
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from plumbago.plans import logs, queries
from plumbago.plans.providers import Overlap
from plumbago.plans.settings import Settings, settings
from plumbago.sources import files

SF = "/root/testdata/sf0.001"
LIGHT = sorted(set(queries.ORACLE_SQL) - {"ann_topk"})  # tested on larger tables


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", LIGHT)
def test_query(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    rows = lambda df: sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_corpus_operators(tmp_path):
    """The driver may delete the corpus operators, with the pipeline's file or without it: the other queries are still there."""
    repo = Path(__spark_entry__.__file__).parent
    shutil.copytree(repo / "plumbago", tmp_path / "plumbago", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (repo / name).exists():
            shutil.copy(repo / name, tmp_path / name)
    said = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", said], cwd=tmp_path, capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.stdout.split() == [str(len(queries.QUERIES)), str(len(queries.ORACLE_SQL)), "False"]


def test_settings(monkeypatch):
    monkeypatch.setenv("PLUMBAGO_CHUNK_SIZE", "7")
    monkeypatch.setenv("PLUMBAGO_DEBUG", "false")
    settings.cache_clear()
    assert settings() == Settings(chunk_size=7, debug=False)
    settings.cache_clear()


def test_logs(tmp_path):
    log = logs.setup(str(tmp_path))
    log.info("one")
    log.error("two")
    for h in log.handlers:
        h.flush()
    assert "one" in (tmp_path / "app.log").read_text() and "one" not in (tmp_path / "error.log").read_text() and "two" in (tmp_path / "error.log").read_text()
    assert logs.setup(str(tmp_path), debug=True).level == logging.DEBUG and len(log.handlers) == 3


def test_single_files_and_evaluation(spark, tmp_path):
    (tmp_path / "a.md").write_text("x" * 1500)
    (tmp_path / "t.csv").write_text("a,b\n1,2\n,\n")
    assert [r.page for r in files.parse_markdown(spark, str(tmp_path / "a.md")).orderBy("page").collect()] == [1, 2]
    assert [r.content for r in files.parse_table(spark, str(tmp_path / "t.csv")).collect()] == ["a: 1; b: 2"]
    r = Overlap().evaluate(spark.createDataFrame([("1", "aa bb", "aa cc", "aa bb cc")], "query_id string, question string, answer string, context string")).first()
    assert (r.accuracy, r.completeness, r.relevance) == (10.0, 5.0, 10.0)
