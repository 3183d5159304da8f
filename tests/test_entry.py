"""The driver's contract, with and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

REPO = Path(__file__).resolve().parents[1]


def test_entry(spark):
    assert set(__spark_entry__.entry(spark).columns) == {"p_partkey", "k", "visible_count"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_corpus_operators(tmp_path):
    for p in REPO.iterdir():
        if p.name not in (".git", "corpus_pipeline.py", "targetlake"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "targetlake").mkdir()
    for p in (REPO / "targetlake").iterdir():
        if p.name != "llm":
            (tmp_path / "targetlake" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; names = set(e.queries()); e.oracle_sql(); assert 'unique_prefix' in names and not any(n.startswith('op') or n == 'pipeline' for n in names)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


@pytest.mark.parametrize("name", ["catalog_files", "sample_files"])
def test_files_against_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for table in ("part", "lineitem", "orders"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = db.sql(__spark_entry__.oracle_sql()[name])
    columns = want.columns
    got = [tuple(r) for r in __spark_entry__.queries()[name](spark, folder).select(*columns).collect()]
    assert got and sorted(got, key=str) == sorted(want.fetchall(), key=str)
