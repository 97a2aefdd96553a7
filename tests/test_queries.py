"""Every registered query of the library against its SQL, on the smallest test data."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest

from concordia.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if hasattr(v, "quantize") or isinstance(v, float):
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    if isinstance(v, list):
        return [plain(x) for x in v]
    return str(v)


@pytest.mark.skipif(not DATA.is_dir(), reason="no test data here")
@pytest.mark.parametrize("name", sorted(catalogue()))
def test_query(spark, oracle, name):
    query, sql = catalogue()[name]
    found = query(spark, str(DATA))
    rows = found.collect()
    if sql is None:
        return
    want = oracle.sql(sql)
    assert sorted(want.columns) == sorted(found.columns)
    at = [want.columns.index(c) for c in found.columns]
    assert sorted(str([plain(v) for v in r]) for r in rows) == sorted(str([plain(r[i]) for i in at]) for r in want.fetchall())


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_module_works_without_the_llm_folders(tmp_path, with_pipeline):
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "concordia", tmp_path / "concordia", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copy(root / "corpus_pipeline.py", tmp_path) if with_pipeline and (root / "corpus_pipeline.py").exists() else None
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship_line_changes' in q and not any(n[:2] == 'op' and n[2].isdigit() or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
