"""The driver's contract, and a few queries against their SQL on the small tables."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["graph_stats", "similar_pairs_eps30", "generalized_degree", "kcore_members", "core_numbers", "degree_ratio_candidates"])
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = __spark_entry__.queries()[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in sorted(found.columns))
    want = db.execute(f"SELECT {columns} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, found.select(*sorted(found.columns)).collect())) == sorted(want)


def test_without_training_data_operators(tmp_path):
    """With the subpackage, its tests and the pipeline deleted, the entry imports and keeps the graph queries."""
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(f"{root}/simgraph", tmp_path / "simgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.catalog.QUERIES) and sorted(e.oracle_sql()) == sorted(e.catalog.ORACLES))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=100)
    assert done.stdout.strip() == "True", done.stderr
