"""Every query with SQL against DuckDB at the smallest size."""

import glob
import os

import duckdb
import pytest

from barloom.plans.oracles import ORACLES
from barloom.plans.queries import QUERIES

#: One of each kind; the driver compares all of them. Set BARLOOM_ALL=1 to do so here.
SOME = ["bars_weekly", "nan_repair", "ema_triple", "ma_crossovers", "hull", "rsi", "ultimate", "macd", "cci", "adx", "demand_index", "bear_bull_signals", "stochastic_signals", "rsi_metric", "ultimate_signals", "macd_signals", "awesome_signals", "bollinger_signals", "zigzag", "head_shoulders", "trend_lines", "trend_periods", "line_groups", "nearest_lines", "macd_stats", "macd_runs", "support_resistance", "nearest_levels", "candle_reversals", "merged_signals", "candle_patterns", "candle_ladder", "candle_signals", "support_clusters", "beta", "correlation_index", "synopsis", "ledger_sim", "altman_z", "recommendation_curve", "bars_6h"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or v != v:
        return ""
    if isinstance(v, float):
        return repr(v)
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


def test_every_query_with_sql_exists():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("BARLOOM_ALL") else SOME)
def test_same_rows(spark, sf, con, name):
    got = QUERIES[name](spark, sf)
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert table(got.columns, got.collect()) == table(columns, want.fetchall())


def test_candles_come_in_stretches(spark, sf, con, monkeypatch):
    """No window of theirs holds a whole symbol, and rows at the edges of stretches are as right as others."""
    from barloom.functions import series
    from barloom.plans import candle_rows

    monkeypatch.setattr(series, "STRETCH", 24)
    monkeypatch.setattr(candle_rows, "ORDERS", 16)
    for name in ("candle_patterns_line", "candle_three_line_strike", "candle_doji", "candle_reversals"):
        got = QUERIES[name](spark, sf)
        want = con.execute(ORACLES[name])
        columns = [d[0] for d in want.description]
        assert table(got.columns, got.collect()) == table(columns, want.fetchall())
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if " Window [" in line]
        assert windows
        for line in windows:  # by stretch, by order keys, or over the counts of these
            assert "_part#" in line or "_orders#" in line or "_count#" in line
