"""Every registered query against its DuckDB oracle at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tools.check import TABLES, rows_of

from pairgrade.plans.registry import ORACLE, QUERIES  # noqa: E402
# Model fits and profiles are covered by their own tests.
SLOW = {"tree_tier_classifier", "mlp_tier_classifier", "cv_train_eval", "ssp_pca", "fusion_features"}


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", sorted(k for k in QUERIES if k in ORACLE))
def test_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, SF)
    cur = duck.execute(ORACLE[key])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


@pytest.mark.parametrize("key", sorted(k for k in QUERIES if k not in ORACLE and k not in SLOW))
def test_runs(spark, key):
    assert QUERIES[key](spark, SF).count() > 0


def test_entry_is_stable(spark):
    df = entry.entry(spark)
    assert df.columns == ["y", "n", "share"]
    assert df.count() == 4
