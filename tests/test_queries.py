"""Every query with SQL against DuckDB on the same files."""

from __future__ import annotations

import math

import duckdb
import pytest

from undula import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value + 0.0 if isinstance(value, float) else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr([plain(r[k]) for k in order]) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_against_sql(spark, sf, duck, name):
    df = plans.queries()[name](spark, sf)
    found = duck.execute(plans.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, found.fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 60
    assert e.entry(spark).count() > 0


def test_rest_imports_without_the_training_data_operators(tmp_path):
    """A copy without the llm folders and the pipeline still lists its queries."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parents[1]
    shutil.copytree(root / "undula", tmp_path / "undula", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)
