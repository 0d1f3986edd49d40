"""Every registered analysis query against its SQL, over whole tables."""

import math

import duckdb
import pytest

from clickpulse.plans.oracles import ORACLES
from clickpulse.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()
#: Models and resamples that SQL can't express.
ROWS_ONLY = {"best_weights", "pc1_weights", "delta_score", "delta_holdout", "ridge_sweep", "weight_stability", "weight_choice"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    return value


def test_all_have_sql():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY and not set(ORACLES) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    made = duck.sql(ORACLES[name])
    assert sorted(made.columns) == columns
    order = [made.columns.index(c) for c in columns]
    by = lambda row: tuple((v is None, str(v)) for v in row)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=by)
    want = sorted((tuple(plain(r[i]) for i in order) for r in made.fetchall()), key=by)
    assert got == want


def test_alert_day_has_alerts(spark, sf_dir):
    assert QUERIES["anomaly_summary"](spark, sf_dir).count() > 0
