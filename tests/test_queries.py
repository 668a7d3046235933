"""Every registered query beside its SQL in DuckDB, over the smallest tables."""

import duckdb
import pytest

from tessera.plans import all_queries
from tessera.plans.tables import NAMES

QUERIES = all_queries()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(tuple(repr(r[n]) for n in names) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, sf_dir, name):
    query, sql = QUERIES[name]
    got = query(spark, sf_dir).toArrow()
    if sql:
        assert rows(got) == rows(oracle.sql(sql).to_arrow_table())


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_llm_folder(tmp_path):
    """What is left when the folder and the pipeline are gone imports and has its queries."""
    import os
    import shutil
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{top}/tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{top}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tpch_q1' in q and not any(n.startswith('op') for n in q if n[2:3].isdigit()) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
