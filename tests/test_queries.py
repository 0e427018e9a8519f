"""Queries against their oracles on the driver's smallest tables, and what the entry module promises."""

import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from confab.plans import more  # noqa: F401
from confab.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: queries that may have no rows on the smallest tables
EMPTY = {"anti_cache_miss", "small_island_merge"}
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple("null" if x is None or x is pd.NA or x != x else repr(x) for x in r) for r in df.itertuples(index=False))


@needs_data
@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, expect = core.QUERIES[name](spark, SF).toPandas(), c.sql(core.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expect.columns)
    assert rows(got) == rows(expect)
    assert name in EMPTY or len(got), "an oracle over no rows tells nothing"


@needs_data
@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE_SQL)))
def test_query_without_oracle_runs(spark, name):
    """SQL can't say these; their operators are held against brute force elsewhere."""
    assert core.QUERIES[name](spark, SF).count() > 0


def test_registry():
    assert set(core.ORACLE_SQL) <= set(core.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
    for sql in core.ORACLE_SQL.values():
        assert "LIMIT" not in sql.upper() or "ORDER BY" in sql.upper()


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_without_training_data_operators(tmp_path, pipeline):
    """The entry module imports and lists the core queries where the subpackage is gone, with or without the pipeline's file."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    os.symlink(f"{root}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    (tmp_path / "confab").mkdir()
    for p in os.listdir(f"{root}/confab"):
        if p != "llm":
            os.symlink(f"{root}/confab/{p}", tmp_path / "confab" / p)
    if pipeline:
        os.symlink(f"{root}/corpus_pipeline.py", tmp_path / "corpus_pipeline.py")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op1_') or n == 'pipeline' for n in e.queries()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.stdout.split() == [str(len(core.QUERIES)), "False"], done.stderr


@needs_data
def test_joins_are_on_keys(spark):
    """No cross join or nested loop in the plans of the interval joins."""
    for name in ("point_in_interval", "max_overlap", "summed_overlap", "tolerance_nearest", "nearest_survivor"):
        plan = core.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan, name


@needs_data
def test_summed_overlap_broadcasts_no_exploded_side(spark):
    """Words are many for each row of the small table that they are made of, so its size is no reason to broadcast them."""
    plan = core.QUERIES["summed_overlap"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2


def test_candidate_coherence_of_a_last_vector_alone(spark, tmp_path):
    """Six vectors are a candidate of five and one without pairs."""
    at = f"{tmp_path}/embeddings.parquet"
    pd.DataFrame({"vec_id": range(6), "embedding": [[1.0, float(i)] for i in range(6)]}).to_parquet(at)
    c = duckdb.connect()
    c.sql(f"create view embeddings as select *, 0 as label from '{at}'")
    got = core.QUERIES["candidate_coherence"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(c.sql(core.ORACLE_SQL["candidate_coherence"]).df()) and len(got) == 1
