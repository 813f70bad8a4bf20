"""Every registered query of the engine, against DuckDB wherever it has SQL."""

import duckdb
import pytest

from tidemill.plans import registry
from tidemill.plans.queries import ORACLES, QUERIES

#: Fits of models take long and have no SQL; tests/test_models.py has small ones.
SLOW = {"gbt_forecast", "rf_forecast", "direct_linear_forecast", "direct_linear_maps", "rolling_origin_cv", "seed_spread", "seed_mean_scores", "permutation_importance", "feature_ablation", "leave_one_zone_out_gbt"}


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in ("events", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def shared_tables():
    """Tables such as the bins are written once for all queries of this module."""
    registry.TABLES = {}
    yield
    registry.TABLES = None


def test_registry():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 90
    assert set(QUERIES) - set(ORACLES) == SLOW


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, sf, con, name):
    want = con.execute(ORACLES[name])
    cols = [c[0] for c in want.description]
    df = QUERIES[name](spark, sf)
    assert sorted(cols) == sorted(df.columns)
    show = lambda row: tuple(f"{x + 0.0:.6f}" if isinstance(x, float) else str(x) for x in row)
    assert sorted(show(r) for r in df.select(*cols).collect()) == sorted(show(r) for r in want.fetchall())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_stay_in_the_jvm_and_read_events_once(spark, sf):
    for name in ("flagship_policy", "joint_grid", "candidate_set", "stable_window_sensitivity", "window_level_metrics", "average_precision", "calibration_rank10"):
        df = QUERIES[name](spark, sf)
        text = plan(df)
        assert "Python" not in text and "CartesianProduct" not in text, name
        assert not any("events.parquet" in f for f in df.inputFiles()), name  # bins are written before
