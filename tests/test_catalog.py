"""The registered queries: every family against its SQL twin on the small tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import connect, spark_rows, sql_rows

FOLDER = "/root/testdata/sf0.01"
NAMES = [
    "s2_delisting_price", "s9_upsert_table", "s17_news_feed", "u8_investability", "u13_rule_counts", "p4_sector_imputation",
    "f19_factor_table", "z6_standardize_all", "c4_icir_weighted", "r2_tilted_weights", "l5_select_over_dates", "v11_validation_report",
    "m2_beta_neutral", "o2_combinatorial_folds", "a3_net_alpha", "e7_constant_correlation", "e18_regime_filter", "b1_posterior_covariance",
    "b6_scenario_moments", "k2_dispersion", "k9_risk_contributions", "k15_bootstrap_distances", "k16_distance_kendall",
    "t6_grid_search", "q6_rebalance_decision", "x2_session_bars", "x5_streaming_screen", "f13_momentum_top_picks",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the generated tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    assert spark_rows(entry.queries()[name](spark, FOLDER)) == sql_rows(con, entry.oracle_sql()[name])


def test_entry_returns_ten_names(spark):
    df = entry.entry(spark)
    assert df.columns == ["ticker", "sector", "score"] and df.count() == 10


def test_twins_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    families = {n.split("_")[0] for n in entry.queries()}
    for prefix, count in dict(s=19, u=14, p=14, f=19, z=7, c=8, r=3, l=5, v=13, m=4, o=3, a=6, e=19, b=13, k=17, t=8, q=6, x=5, j=3).items():
        missing = {f"{prefix}{i}" for i in range(1, count + 1)} - families
        assert not missing, missing
