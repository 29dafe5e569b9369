"""Registered queries against their SQL twins on the smallest data."""

import math
from pathlib import Path

import duckdb
import pytest

from hourloom.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test data not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted([tuple(clean(r[i]) for i in order) for r in data], key=repr)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


PICKED = [
    "src_load_increment", "prj_parse_period", "flt_calibration_split", "ts_clean_pipeline", "ts_interpolate_by_user",
    "set_union_prefer_first", "fn_structural_load", "win_features_full", "win_features_serve", "win_halo", "dq_ordering",
    "agg_quantile_events", "agg_histogram", "ev_dm_hac", "ev_calibration_curve", "ml_conformal", "fc_recursive",
    "fc_zero_fill", "bt_fold_table_rolling", "bt_walk_forward_linear", "bt_recursive_reanchored", "gate_state",
    "src_load_reconcile", "ev_dm_simple_p", "ml_forest_score", "fc_recursive_forest", "gate_lifecycle",
]


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLES[name])
    assert sorted(df.columns) == sorted(d[0] for d in cur.description)
    assert got == rows([d[0] for d in cur.description], cur.fetchall())
