"""Every registered query against its SQL, and the shape of the plans, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from stationcast.plans import training
from tools.check import TABLES, rows_of
from workloads.registry import REGISTRY

SF = "/root/testdata/sf0.001"
FITS = {"linear_regression", "random_forest", "gradient_boosting", "extreme_boosting", "compare_models",
        "mean_importance", "train_register_forecast"}


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


OWN = sorted(name for name, q in REGISTRY.items() if q.sql is not None)


@pytest.mark.parametrize("name", OWN)
def test_query_equals_its_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())


def test_only_fits_have_no_sql():
    assert set(REGISTRY) - set(OWN) == FITS


@pytest.mark.parametrize("name, rounds", [
    ("random_forest", 100), ("gradient_boosting", 150), ("extreme_boosting", 200), ("compare_models", 200),
    ("mean_importance", 100), ("train_register_forecast", 200)])
def test_fits_use_the_full_rounds(spark, monkeypatch, name, rounds):
    class Asked(Exception):
        pass

    def asked(learner, train):
        raise Asked(learner.settings.rounds)
    monkeypatch.setattr(training, "fit_horizons", asked)
    with pytest.raises(Asked) as found:
        entry.queries()[name](spark, SF)
    assert found.value.args == (rounds,)


def test_entry(spark):
    assert entry.entry(spark).count() == 102


def test_bootstrap_draws_every_row_of_equal_values(spark, tmp_path):
    """Hundreds of rows an hour share one value: each is still drawn by its own key, in the query and in its SQL."""
    events = f"{tmp_path}/events.parquet"
    duckdb.sql(f"COPY (SELECT * REPLACE (CAST(user_id % 3 + 1 AS DOUBLE) AS value) FROM '{SF}/events.parquet') TO '{events}'")
    own = duckdb.connect()
    own.execute(f"CREATE VIEW events AS SELECT * FROM '{events}'")
    df = entry.queries()["diurnal_profile"](spark, str(tmp_path))
    sql = entry.oracle_sql()["diurnal_profile"]
    rel = own.sql(sql)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())
    # The rows that are resampled are all clean rows, one by one.
    head, _ = sql.split("started AS")
    drawn = own.sql(head.rstrip().rstrip(",") + " SELECT count(*), count(DISTINCT seed) FROM drawn WHERE replicate = 1").fetchall()[0]
    clean = own.sql(head.split(", seeded AS")[0] + " SELECT count(*) FROM clean").fetchall()[0]
    assert drawn[0] == clean[0] and drawn[1] > 0.99 * clean[0]
