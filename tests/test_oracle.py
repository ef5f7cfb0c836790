"""Registered queries against DuckDB. BARWRIGHT_ORACLE=all runs every one of them."""

import os

import pytest

import __spark_entry__ as entry
from compare import differences, oracle

FOLDER = os.environ.get("BARWRIGHT_DATA", "/root/testdata/sf0.01")
SAMPLE = """io02_text_bars io04_sector_enrichment se01_05_sessions_daily se01_05_sessions_hourly se12_horizon_masks lb03_multi_horizon
lb06_07_xs_targets ts02_mom ts09_ema_macd ts13_skew_kurt ts21_autocorr ts35_dual_thrust tf03_lite_operators tf06_ohlcv_block vw01_csz_unbounded_groups
vw03_tsz vw05_causal_z vw11_extended_views ev04_rank_ic ev08_stride_ics ev10_newey_west ev11_bootstrap_ci jn06_prior_months fs05_yearly_score
sp03_quarterly_splits wn02_windows sm03_weighted_fill sm05_event_tail ca04_key_affine ca05_composite_keys en09_rolling_grid en11_rolling_group_alpha
en23_regime_memory en29_cross_section_blend uv01_unique_visitors
se20_bar_contract se20_panel_contract tf10_bank_b_3_13 sm07_whole_timestamps en28_candidate_guard""".split()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("BARWRIGHT_ORACLE") == "all" else SAMPLE


@pytest.fixture(scope="module")
def duck():
    return oracle(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    assert len(got)
    assert differences(got, duck.execute(entry.oracle_sql()[name]).df()) == []


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["month", "ic", "n"] and df.count() > 0
