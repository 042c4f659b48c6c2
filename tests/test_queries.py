"""Queries against their oracle on the small tables; TEST_ALL=1 runs every one of them."""

import os
import sys

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tickloom.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FEW = "exchange_sessions rss_feed symbol_grammar screen_fund_filter pattern_sentence macro_report market_source stream_upsert stream_select_events cluster_stories fold_duplicates title_similarity rsi macd atr bollinger session_vwap ema detect_patterns outlook asof_session weekly_timeline event_cars welch_test title_tokens news_recap news_low_value core_name html_strip news_page screen_value status_combine table_sort replace_range upsert_articles append_similar needs_refresh build_overdue parse_news_ts skip_bad_rows stream_bars month_counts month_window scored_articles save_scores cursor_codec page_groups retro_fold coverage_state keep_stale sparkline_rows unscored_articles".split()


def plain(value):
    if isinstance(value, float):
        return None if value != value else f"{value:.6g}"
    if value is None or value is pd.NaT:
        return None
    return str(value).removesuffix(" 00:00:00")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(str, map(plain, r))) for r in frame.astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("TEST_ALL") else FEW)
def test_query_equals_oracle(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    ints = [c for c in got.columns if pd.api.types.is_numeric_dtype(got[c]) and pd.api.types.is_numeric_dtype(want[c])]
    assert rows(got.astype({c: "float64" for c in ints if got[c].dtype != bool})) == rows(want.astype({c: "float64" for c in ints if want[c].dtype != bool}))


def test_every_query_has_an_oracle_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == {"findings"}  # tests/test_operators.py holds these
