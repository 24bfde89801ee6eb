"""DuckDB SQL for the queries of plans.queries, written apart from them: windows, lists and joins over the same tables.

chain() builds one statement: bars, then a stage for each dict of new columns, then the final columns.
"""

from __future__ import annotations

from .candle_rows import SCRIPTS
from .candle_sql import OUTCOMES, seen, seen_by_body
from . import line_sql
from .machine_sql import above_total, band_exit, band_extremes, confirmed_sign, double_turn, level_crossing, lows, machine, rejection, saucer, swings, twin_peaks, two_lows, zigzag, zone_crossing, zone_divergence, zone_exit, zone_turns

ORACLES: dict[str, str] = {}
P = "PARTITION BY symbol"
O = f"{P} ORDER BY i"  # noqa: E741
TP, MID = "(close + low + high) / 3.0", "(high + low) / 2.0"


def raw_bars(symbol: str = "o_orderpriority", interval: str = "week", tables: str = "orders") -> str:
    return f"""SELECT CAST({symbol} AS VARCHAR) AS symbol, CAST(date_trunc('{interval}', o_orderdate) AS DATE) AS dt, min_by(o_totalprice, o_orderkey) AS open,
        max(o_totalprice) AS high, min(o_totalprice) AS low, max_by(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume FROM {tables} GROUP BY 1, 2"""


NATION = raw_bars("c_nationkey", "month", "orders JOIN customer ON o_custkey = c_custkey")
MARKET = raw_bars("'^MKT'")


def numbered(name: str, source: str) -> str:
    return f"{name} AS (SELECT *, close AS adj_close, row_number() OVER ({P} ORDER BY dt) - 1 AS i, count(*) OVER ({P}) AS n FROM ({source}))"


def chain(*stages: dict[str, str] | str, out: str, source: str | None = None, more: str = "") -> str:
    parts, last = [numbered("bars", source or raw_bars())] + ([more] if more else []), "bars"
    for k, stage in enumerate(stages):
        body = stage.format(last=last) if isinstance(stage, str) else "SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in stage.items()) + f" FROM {last}"
        last = f"s{k}"
        parts.append(f"{last} AS ({body})")
    return "WITH " + ",\n".join(parts) + f"\n{out.format(last=last)}"


def cells(*names: str, of: dict[str, str] | None = None) -> str:
    return "SELECT symbol, i, " + ", ".join(f"round({(of or {}).get(c, c)}, 4) + 0.0 AS {c}" for c in names) + " FROM {last}"


def frame(a: int | None, b: int) -> str:
    edge = lambda k: "CURRENT ROW" if k == 0 else f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}"
    return f"({O} ROWS BETWEEN {'UNBOUNDED PRECEDING' if a is None else edge(a)} AND {edge(b)})"


def over(e: str, a: int | None, b: int) -> str:
    return f"{e} OVER {frame(a, b)}"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({O})"


def sma(x: str, n: int) -> str:
    return f"CASE WHEN n > {n + 3} THEN CASE WHEN i < {n - 1} THEN {x} ELSE {over(f'avg({x})', 1 - n, 0)} END END"


def wma(x: str, n: int) -> str:
    return f"CASE WHEN i < {n} THEN {x} ELSE ({' + '.join(f'{n - k}.0 * {lag(x, k) if k else x}' for k in range(n))}) / {n * (n + 1) / 2} END"


def so_far(x: str) -> str:
    return over(f"list({x})", None, 0)


def ema(x: str, values: str, n: int) -> str:
    """values: the list of x so far."""
    k = 2.0 / (n + 1)
    return f"CASE WHEN n > {n + 3} THEN CASE WHEN i < {n - 1} THEN {x} ELSE list_reduce(list_prepend(list_avg({values}[1:{n}]), {values}[{n + 1}:]), lambda e, v: e * {1 - k!r} + v * {k!r}) END END"


def slope(x: str, n: int) -> str:
    return f"CASE WHEN i < {n} THEN 0.0 ELSE {over(f'regr_slope({x}, CAST(i AS DOUBLE))', -n, -1)} END"


def scaled(x: str) -> str:
    return f"CASE WHEN {x} < 0 THEN {x} / min({x}) OVER ({P}) * -0.35 WHEN max({x}) OVER ({P}) > 0 THEN {x} / max({x}) OVER ({P}) * 0.35 ELSE 0.0 END"


def largest(x: str, *others: str) -> str:
    top = f"greatest({', '.join(f'max(abs({c})) OVER ({P})' for c in (x, *others))})" if others else f"max(abs({x})) OVER ({P})"
    return f"CASE WHEN {top} > 0 THEN {x} / {top} ELSE {x} END"


def spread(x: str, w: tuple[float, ...]) -> str:
    return f"{x} * {w[0]} + " + " + ".join(f"(coalesce({lag(x, k)}, 0.0) + coalesce(lead({x}, {k}) OVER ({O}), 0.0)) * {w[k]}" for k in (1, 2, 3))


def side(x: str) -> str:
    return f"last_value(CASE WHEN {x} > 0 THEN 1 WHEN {x} < 0 THEN -1 END IGNORE NULLS) OVER {frame(None, 0)}"


CHANGE = f"coalesce((close - {lag('close')}) / nullif({lag('close')}, 0) * 100.0, 0.0)"

# sources
for _name, _source in (("bars_weekly", raw_bars()), ("bars_nation", NATION), ("bars_market", MARKET)):
    ORACLES[_name] = chain(out=cells("open", "high", "low", "close", "volume"), source=_source)
_Q = f"""SELECT symbol, CAST(date_trunc('quarter', dt) AS DATE) AS dt, min_by(open, dt) AS open, max(high) AS high, min(low) AS low, max_by(close, dt) AS close, sum(volume) AS volume FROM ({raw_bars()}) GROUP BY 1, 2"""
ORACLES["resample_quarter"] = chain(out=cells("open", "high", "low", "close", "volume"), source=_Q)
ORACLES["last_period"] = chain(out=cells("close"), source=f"SELECT * EXCLUDE (last_dt) FROM (SELECT *, max(dt) OVER (PARTITION BY symbol) AS last_dt FROM ({raw_bars()})) WHERE dt > last_dt - INTERVAL 24 MONTH")
ORACLES["single_fund"] = chain(out=cells("close") + " WHERE symbol = '1-URGENT'")
ORACLES["symbol_list"] = "SELECT DISTINCT upper(o_orderpriority) AS symbol FROM orders"
ORACLES["validity_gate"] = chain(out="SELECT symbol, count(*) AS n_missing, count(*) AS n_rows FROM {last} WHERE symbol = '5-LOW' GROUP BY 1")
ORACLES["repair_log"] = chain({"status": "CASE WHEN i % 7 = 3 OR i % 50 BETWEEN 20 AND 22 OR i = 0 THEN 'repaired' ELSE 'complete' END"}, out="SELECT symbol, status, count(*) AS n_rows FROM {last} GROUP BY 1, 2")
_GAP = {c: f"CASE WHEN i % 7 = 3 OR i % 50 BETWEEN 20 AND 22 OR i = 0 THEN NULL ELSE {c} END" for c in ("open", "high", "low", "close")}
_TWICE = f"(CAST(round(b_{{c}} * 100) AS BIGINT) + CAST(round(lead({{v}}) OVER ({O}) * 100) AS BIGINT))"  # in whole cents, half a cent to the even one
_MEAN = f"({_TWICE} // 2 + {_TWICE} % 2 * ({_TWICE} // 2 % 2)) / 100.0"
_FIX = {
    f"f_{c}": f"CASE WHEN g_{c} IS NOT NULL THEN g_{c} WHEN b_{c} IS NULL THEN first_value(g_{c} IGNORE NULLS) OVER ({O} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) WHEN lead(g_{c}) OVER ({O}) IS NOT NULL THEN {_MEAN.replace('{v}', f'g_{c}').replace('{c}', c)} ELSE b_{c} END"
    for c in _GAP
}
ORACLES["nan_repair"] = chain({f"g_{c}": e for c, e in _GAP.items()}, {f"b_{c}": f"last_value(g_{c} IGNORE NULLS) OVER ({O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)" for c in _GAP}, _FIX, out=cells(*_GAP, of={c: f"f_{c}" for c in _GAP}).replace(", 4)", ", 0)"))
ORACLES["wide_to_long"] = chain(
    "SELECT s.symbol, d.dt, b.close FROM (SELECT DISTINCT dt FROM {last}) d CROSS JOIN (VALUES ('1-URGENT'), ('5-LOW')) s(symbol) LEFT JOIN {last} b ON b.symbol = s.symbol AND b.dt = d.dt", out="SELECT symbol, dt, round(close, 4) + 0.0 AS close FROM {last}"
)
ORACLES["stats_high_level"] = chain(
    {"was": lag("close")},
    "SELECT symbol, max_by(close, i) AS c, max_by(was, i) AS b, max(close) AS m FROM {last} GROUP BY 1",
    out="SELECT symbol, round_even(c, 2) AS current_price, round_even(c - b, 2) AS change, round_even((c - b) / b * 100.0, 3) AS percent_change, round_even(m, 2) AS max_close FROM {last}",
)

# averages and trends
ORACLES["typical_price"] = chain({"typical": TP}, out=cells("typical"))
ORACLES["mid_price"] = chain({"mid": MID}, out=cells("mid"))
ORACLES["percent_change"] = chain({"change": CHANGE}, out=cells("change"))
ORACLES["sma"] = chain({"sma": sma("close", 20)}, out=cells("sma"))
ORACLES["ema"] = chain({"l": so_far("close")}, {"ema": ema("close", "l", 20)}, out=cells("ema"))
ORACLES["wma"] = chain({"wma": wma("close", 9)}, out=cells("wma"))
ORACLES["windowed_ma_simple"] = chain({"windowed": f"CASE WHEN i >= 5 AND i < n - 5 THEN {over('avg(close)', -5, 4)} ELSE close END"}, out=cells("windowed"))
ORACLES["windowed_ma_exp"] = chain({"windowed": f"CASE WHEN i >= 5 AND i < n - 5 THEN close * (2.0 / 11) + ({over('sum(close)', -5, 4)} - close) / 9.0 * (1 - 2.0 / 11) ELSE close END"}, out=cells("windowed"))
_PCT = {f"{leg}_pct": f"round_even((close - {leg}) / nullif({leg}, 0) * 100.0, 3)" for leg in ("short", "medium", "long")}
_LEGS = {"short": 12, "medium": 50, "long": 200}
_SMA3 = {leg: sma("close", n) for leg, n in _LEGS.items()}
ORACLES["sma_triple"] = chain(_SMA3, _PCT, out=cells(*_LEGS, *_PCT).replace(", 4)", ", 5)"))
_EMA3 = {leg: ema("close", "l", n) for leg, n in zip(_LEGS, (9, 20, 50), strict=True)}
ORACLES["ema_triple"] = chain({"l": so_far("close")}, _EMA3, _PCT, out=cells(*_LEGS, *_PCT))


def crossings(fast: str, slow: str, term: str, a: int, b: int, table: str) -> str:
    return f"""SELECT symbol, i, dt, CASE WHEN sd > 0 THEN 'bullish' ELSE 'bearish' END AS type, CASE WHEN sd > 0 THEN 'golden crossover ({term}: {a}d > {b}d)' ELSE 'death crossover ({term}: {b}d > {a}d)' END AS value
        FROM (SELECT *, coalesce({lag("sd")}, 0) AS was FROM (SELECT *, {side(f"{fast} - {slow}")} AS sd FROM {table})) WHERE sd IS NOT NULL AND sd <> was AND long IS NOT NULL AND medium IS NOT NULL"""


def both_crossings(a: int, b: int, c: int) -> str:
    return crossings("short", "medium", "midterm", a, b, "{last}") + " UNION ALL " + crossings("medium", "long", "longterm", b, c, "{last}")


ORACLES["ma_crossovers"] = chain(_SMA3, out=both_crossings(12, 50, 200))
ORACLES["ema_crossovers"] = chain({"l": so_far("close")}, _EMA3, out=both_crossings(9, 20, 50))
ORACLES["offset_trim"] = chain({"sma": sma("close", 20)}, out=cells("sma") + " WHERE i >= 30")
_SWING = {"short": sma("close", 4), "medium": sma("close", 9), "long": sma("close", 18)}
ORACLES["swing_states"] = chain(
    _SWING,
    {"state": "CASE WHEN i < 18 THEN 'n' WHEN short > medium AND medium > long THEN 'u3' WHEN short > medium AND short > long THEN 'u2' WHEN short > medium OR short > long THEN 'u1' WHEN short < medium AND medium < long THEN 'e3' WHEN short < medium AND short < long THEN 'e2' WHEN short < medium OR short < long THEN 'e1' ELSE 'n' END"},
    out="SELECT symbol, i, state FROM {last}",
)
ORACLES["hull"] = chain({f"h{n}": f"2.0 * ({wma('close', n // 2)}) - ({wma('close', n)})" for n in (9, 16, 36)}, {"short": wma("h9", 3), "medium": wma("h16", 4), "long": wma("h36", 6)}, out=cells(*_LEGS))
_TREND = {"t": f"0.3 * ({slope('close', 28)}) + 0.4 * ({slope('close', 56)}) + 0.3 * ({slope('close', 84)})"}
ORACLES["auto_trend"] = chain(_TREND, {"trend": scaled("t")}, out=cells("trend"))
ORACLES["normalize"] = chain({"x": slope("close", 14)}, {"scaled": largest("x")}, out=cells("scaled"))
ORACLES["trend_report"] = chain(
    {f"d{p}": f"close - ({sma('close', p)})" for p in (50, 25, 12)},
    " UNION ALL ".join(f"SELECT symbol, {p} AS period, max_by(d{p}, i) AS a, avg(d{p}) AS b FROM {{last}} GROUP BY 1" for p in (50, 25, 12)),
    out="SELECT symbol, period, round(a, 4) + 0.0 AS last_difference, round(b, 4) + 0.0 AS mean_difference, CASE WHEN a > 0 THEN 'above' WHEN a < 0 THEN 'below' ELSE 'at' END AS side FROM {last}",
)

# oscillators
_LOW, _HIGH = over("min(low)", -13, 0), over("max(high)", -13, 0)
_STOCHASTIC = [{"fast_k": f"CASE WHEN i < 13 THEN 50.0 ELSE coalesce((close - {_LOW}) / nullif({_HIGH} - {_LOW}, 0) * 100.0, 50.0) END"}, {"smooth_k": f"CASE WHEN i < 13 THEN 50.0 ELSE {over('avg(fast_k)', -2, 0)} END"}, {"slow_d": f"CASE WHEN i < 13 THEN 50.0 ELSE {over('avg(smooth_k)', -2, 0)} END"}]
ORACLES["stochastic"] = chain(*_STOCHASTIC, out=cells("fast_k", "smooth_k", "slow_d"))
_RSI = [
    {"d": f"round({CHANGE}, 6)"},
    {"g": "greatest(d, 0.0)", "w": "greatest(-d, 0.0)"},
    {f"{a}{j}": f"round_even({over(f'sum({a})', -14 - j, -1 - j)} / 14, 6)" for a in "gw" for j in (0, 1)},
    {"rs": "CASE WHEN i = 14 THEN g0 / nullif(w0, 0) WHEN w1 <> 0 THEN ((g1 * 13 + g) / 14.0) / nullif((w1 * 13 + w) / 14.0, 0) END"},
    {"rsi": "CASE WHEN i < 14 THEN 50.0 ELSE coalesce(round_even(100.0 - 100.0 / (1.0 + rs), 6), 100.0) END"},
]
ORACLES["rsi"] = chain(*_RSI, out=cells("rsi").replace(", 4)", ", 2)"))
_RSI_LIMITS = [
    {"t": f"0.45 * ({slope('close', 42)}) + 0.33 * ({slope('close', 77)}) + 0.22 * ({slope('close', 112)})"},
    {"s": scaled("t")},
    {"oversold": "CASE WHEN s > 0.1 THEN 40.0 - 10.0 * exp(-15.0 * (s - 0.1)) ELSE 30.0 END", "overbought": "CASE WHEN s < -0.1 THEN 60.0 + 10.0 * exp(15.0 * (s + 0.1)) ELSE 70.0 END"},
]
ORACLES["rsi_thresholds"] = chain(*_RSI_LIMITS, out=cells("oversold", "overbought"))
_RATIO = lambda n: f"CASE WHEN i >= {n} THEN coalesce({over('sum(bp)', -n, 0)} / nullif({over('sum(tr)', -n, 0)}, 0), 0.0) ELSE 0.0 END"
_ULTIMATE = [
    {"pc": lag("close")},
    {"bp": "CASE WHEN i > 0 THEN round_even(close - least(low, pc), 6) ELSE 0.0 END", "tr": "CASE WHEN i > 0 THEN round_even(greatest(high, pc) - least(low, pc), 6) ELSE 0.0 END"},
    {"ultimate": f"CASE WHEN i < 27 THEN 50.0 ELSE 100.0 * (4.0 * ({_RATIO(7)}) + 2.0 * ({_RATIO(14)}) + ({_RATIO(28)})) / 7.0 END"},
]
ORACLES["ultimate"] = chain(*_ULTIMATE, out=cells("ultimate"))
_MACD = [{"l": so_far("close")}, {"a": ema("close", "l", 12), "b": ema("close", "l", 26)}, {"macd": "CASE WHEN i < 26 THEN 0.0 ELSE a - b END"}, {"m": so_far("macd")}, {"signal_line": ema("macd", "m", 9)}, {"bar": "macd - signal_line"}]
ORACLES["macd"] = chain(*_MACD, out=cells("macd", "signal_line", "bar"))
_AWESOME = [{"mid": MID}, {"x": f"CASE WHEN i < 34 THEN 0.0 ELSE ({sma('mid', 5)}) - ({sma('mid', 34)}) END"}, {"m": sma("x", 14), "g": sma("x", 34)}, {"awesome": largest("x", "m", "g"), "medium": largest("m", "x", "g"), "long": largest("g", "x", "m")}]
ORACLES["awesome"] = chain(*_AWESOME, out=cells("awesome", "medium", "long"))
ORACLES["awesome_trigger"] = chain(*_AWESOME, out="SELECT symbol, i, CASE WHEN long > 0 AND medium > long AND awesome > medium THEN 1 WHEN long < 0 AND medium < long AND awesome < medium THEN -1 ELSE 0 END AS trigger FROM {last}")


def zero_crossings(x: str, value: str) -> str:
    return f"SELECT symbol, i, dt, CASE WHEN sd > 0 THEN 'bullish' ELSE 'bearish' END AS type, '{value}' AS value FROM (SELECT *, {lag('sd')} AS was FROM (SELECT *, {side(x)} AS sd FROM {{last}})) WHERE sd <> was"


_ROC = {f"roc_{n}": f"CASE WHEN i < {n} THEN 0.0 ELSE (close / {lag('close', n)} - 1.0) * 100.0 END" for n in (10, 20, 40)}
ORACLES["awesome_zero"] = chain(*_AWESOME, out=zero_crossings("awesome", "zero crossover"))
ORACLES["roc_zero"] = chain(_ROC, out=zero_crossings("roc_20", "zero crossover 20d"))
ORACLES["roc"] = chain(_ROC, out=cells(*_ROC))
ORACLES["momentum"] = chain(
    {"d": f"coalesce(close - {lag('close')}, 0.0)"},
    {"u": over("sum(greatest(d, 0.0))", -18, -1), "w": over("sum(greatest(-d, 0.0))", -18, -1)},
    {"momentum": "CASE WHEN i < 19 THEN 0.0 ELSE (u - w) / nullif(u + w, 0) * 100.0 END"},
    {"momentum_line": sma("momentum", 9)},
    {"compared": "CAST(sign(momentum - momentum_line) AS DOUBLE)"},
    out=cells("momentum", "momentum_line", "compared"),
)
_KST = [
    {f"r{n}": f"CASE WHEN i < {n} THEN 0.0 ELSE (close / {lag('close', n)} - 1.0) * 100.0 END" for n in (10, 15, 20, 30)},
    {"kst": f"({sma('r10', 10)}) + 2.0 * ({sma('r15', 10)}) + 3.0 * ({sma('r20', 10)}) + 4.0 * ({sma('r30', 15)})"},
    {"kst_line": sma("kst", 9)},
]
ORACLES["kst"] = chain(*_KST, out=cells("kst", "kst_line"))
_N = (20, 40, 80)
_CCI = [
    {"tp": TP},
    {f"a{n}": sma("tp", n) for n in _N} | {f"w{n}": over("list(tp)", -n, -1) for n in _N},
    {f"d{n}": f"list_sum(list_transform(w{n}, lambda v: abs(v - a{n}))) / {n}.0" for n in _N},
    {f"m{n}": f"max(CASE WHEN i = {n} THEN d{n} END) OVER ({P})" for n in _N},
    {f"cci_{n}": f"(tp - a{n}) / nullif(CASE WHEN i < {n} THEN m{n} ELSE d{n} END * 0.015, 0)" for n in _N},
]
ORACLES["cci"] = chain(*_CCI, out=cells("cci_20", "cci_40", "cci_80"))

# volatility, volume, power
_ATR = [{"pc": lag("close")}, {"true_range": "CASE WHEN i > 0 THEN greatest(high - low, abs(high - pc), abs(low - pc)) ELSE 0.0 END"}, {"atr": f"CASE WHEN i < 13 THEN 0.0 ELSE {sma('true_range', 14)} END"}]
ORACLES["atr"] = chain(*_ATR, out=cells("true_range", "atr"))
ORACLES["atr_signals"] = chain(
    *_ATR,
    {"l": so_far("atr")},
    {"s": ema("atr", "l", 50), "g": ema("atr", "l", 200)},
    {"st": "CASE WHEN atr > s AND s > g THEN 'u3' WHEN atr > s AND atr > g THEN 'u2' WHEN atr < s AND atr > g THEN 'u1' WHEN atr > s AND atr < g THEN 'e1' WHEN atr < s AND s < g THEN 'e3' WHEN atr < s AND atr < g THEN 'e2' ELSE 'n' END"},
    {"was": f"coalesce({lag('st')}, 'n')"},
    {"score": "CASE WHEN st = 'u3' AND was <> 'u3' THEN -1.0 WHEN st = 'e3' AND was <> 'e3' THEN 1.0 WHEN st = 'u2' AND was = 'e1' THEN -0.6 WHEN st = 'e2' AND was = 'u1' THEN 0.6 WHEN st = 'u1' AND was = 'u3' THEN 0.2 WHEN st = 'e1' AND was = 'e3' THEN -0.2 END"},
    out="SELECT symbol, i, dt, CASE WHEN score > 0 THEN 'bullish' ELSE 'bearish' END AS type, was || ' to ' || st AS value FROM {last} WHERE score IS NOT NULL AND g IS NOT NULL",
)
_WILDER = lambda x: f"CASE WHEN i < 13 THEN 0.0 ELSE list_reduce(list_prepend(list_sum({x}[1:14]), {x}[15:]), lambda e, v: e - e / 14.0 + v) END"
_ADX = [
    *_ATR,
    {"up": f"high - {lag('high')}", "dn": f"{lag('low')} - low"},
    {"p": "CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END", "m": "CASE WHEN dn >= up AND dn > 0 THEN dn ELSE 0.0 END"},
    {"lp": so_far("p"), "lm": so_far("m")},
    {"sp": _WILDER("lp"), "sm": _WILDER("lm")},
    {"di_plus": "CASE WHEN i < 14 THEN 0.0 ELSE sp / nullif(atr, 0) * 100.0 END", "di_minus": "CASE WHEN i < 14 THEN 0.0 ELSE sm / nullif(atr, 0) * 100.0 END"},
    {"dx": "CASE WHEN i < 14 THEN 0.0 ELSE coalesce(abs(di_plus - di_minus) / nullif(di_plus + di_minus, 0) * 100.0, 0.0) END"},
    {"lx": so_far("dx")},
    {"adx": "CASE WHEN i < 13 THEN 20.0 ELSE list_reduce(list_prepend(list_sum(lx[1:14]) / 14.0, lx[15:]), lambda e, v: (e * 13 + v) / 14.0) END"},
]
ORACLES["adx"] = chain(*_ADX, out=cells("di_plus", "di_minus", "adx"))
ORACLES["adx_signals"] = chain(
    *_ADX,
    {"rising": f"({slope('close', 14)}) > 0", "was": lag("adx")},
    {"value": "CASE WHEN was < 25 AND adx >= 25 THEN 'strong trend' WHEN was < 20 AND adx >= 20 THEN 'trend begins' WHEN was > 40 AND adx <= 40 THEN 'high trend fades' WHEN was > 20 AND adx <= 20 THEN 'trend ends' END"},
    out="SELECT symbol, i, dt, CASE WHEN (value IN ('strong trend', 'trend begins')) = rising THEN 'bullish' ELSE 'bearish' END AS type, value FROM {last} WHERE value IS NOT NULL",
)
_OBV = [{"mv": f"coalesce(sign(close - {lag('close')}), 0) * volume"}, {"obv": over("sum(mv)", None, 0)}]
ORACLES["obv"] = chain(*_OBV, out=cells("obv"))
ORACLES["obv_spikes"] = chain(*_OBV, {"d": f"obv - ({sma('obv', 20)})"}, {"spike": f"CASE WHEN abs(d) > max(abs(d)) OVER ({P}) / 5.0 THEN d ELSE 0.0 END"}, out=cells("spike"))
ORACLES["demand_index"] = chain(
    {"v": f"CASE WHEN i > 0 THEN greatest(high, {lag('high')}) - least(low, {lag('low')}) ELSE 0.0 END"},
    {"a": sma("v", 10)},
    {"k": "coalesce(3.0 * close / nullif(a, 0), 0.0)"},
    {"p": "(close - open) / open * k"},
    {"b": "CASE WHEN p = 0 THEN 0.0 WHEN p > 0 THEN volume ELSE volume / p END", "s": "CASE WHEN p = 0 THEN 0.0 WHEN p > 0 THEN volume / p ELSE volume END"},
    {"x": "coalesce(CASE WHEN abs(b) > abs(s) THEN s / nullif(b, 0) ELSE b / nullif(s, 0) END, 0.0)"},
    {"l": so_far("x")},
    {"demand_index": ema("x", "l", 10)},
    out=cells("demand_index"),
)
for _key, _n, _k in (("bollinger", 20, 2.0), ("bollinger_10", 10, 1.5)):
    ORACLES[_key] = chain({"tp": TP}, {"middle": sma("tp", _n), "sd": f"CASE WHEN i < {_n} THEN 0.0 ELSE {over('stddev_pop(tp)', -_n, -1)} END * {_k}"}, {"upper": "middle + sd", "lower": "middle - sd"}, out=cells("middle", "upper", "lower"))
ORACLES["volatility_blend"] = chain(
    {"tp": TP},
    {f"v{n}": f"CASE WHEN i >= {n} THEN 2.0 * {over('stddev_pop(tp)', -n, -1)} ELSE 0.0 END" for n in (50, 100, 250, 500)},
    {"volatility": "coalesce(CASE WHEN i >= 500 THEN 0.4 * v50 + 0.3 * v100 + 0.2 * v250 + 0.1 * v500 WHEN i >= 250 THEN 0.55 * v50 + 0.3 * v100 + 0.15 * v250 WHEN i >= 100 THEN 0.7 * v50 + 0.3 * v100 ELSE v50 END / nullif(tp, 0), 0.0)"},
    out=cells("volatility"),
)
_POWER = [{"l": so_far("close")}, {"av": ema("close", "l", 13)}, {"bulls": "high - av", "bears": "low - av"}]
ORACLES["bear_bull"] = chain(*_POWER, out=cells("bulls", "bears"))
_K = (4, 5, 6, 7, 8)
_DIVERGES = lambda k: f"CASE WHEN e > 0 AND bears < 0 AND b{k} > 0 AND du > 0 AND dc < 0 THEN 'bullish' WHEN e < 0 AND bulls > 0 AND u{k} < 0 AND db < 0 AND dc > 0 THEN 'bearish' END"
ORACLES["bear_bull_signals"] = chain(
    *_POWER,
    {"e": slope("av", 12), "db": f"bears - {lag('bears')}", "du": f"bulls - {lag('bulls')}", "dc": f"close - {lag('close')}"} | {f"{a}{k}": slope(x, k - 1) for k in _K for a, x in (("b", "bears"), ("u", "bulls"))},
    {f"k{k}": _DIVERGES(k) for k in _K},
    {"type": f"coalesce({', '.join(f'k{k}' for k in _K)})", "k": "CASE " + " ".join(f"WHEN k{k} IS NOT NULL THEN {k}" for k in _K) + " END"},
    out="SELECT symbol, i, dt, type, type || ' divergence: ' || k || 'd interval' AS value FROM {last} WHERE type IS NOT NULL AND i > 0",
)
_TOTAL = [
    {"l": so_far("close")},
    {"e": ema("close", "l", 10)},
    {"u": "CASE WHEN high > e THEN 1.0 ELSE 0.0 END", "d": "CASE WHEN low < e THEN 1.0 ELSE 0.0 END"},
    {c: f"CASE WHEN i < 44 THEN {over(f'sum({x})', None, 0)} ELSE {over(f'sum({x})', -44, -1)} END * 100.0 / 45.0" for c, x in (("bulls", "u"), ("bears", "d"))},
    {"total": "abs(bulls - bears)"},
]
ORACLES["total_power"] = chain(*_TOTAL, out=cells("bulls", "bears", "total"))
ORACLES["zone_islands"] = chain(
    _ROC, {"sd": side("roc_10")}, {"fresh": f"CASE WHEN sd <> coalesce({lag('sd')}, 0) THEN 1 ELSE 0 END"}, {"run": over("sum(fresh)", None, 0)}, out="SELECT symbol, sd AS sign, min(i) AS first_i, max(i) AS last_i, count(*) AS n_rows, round(max(abs(roc_10)), 4) + 0.0 AS extreme FROM {last} WHERE sd IS NOT NULL GROUP BY symbol, run, sd"
)

# chart features
_GAPS = [{"ph": lag("high"), "pl": lag("low")}, {"direction": "CASE WHEN ph < low * (1 - 0.0075) THEN 'up' WHEN high < pl * (1 - 0.0075) THEN 'down' END"}]
ORACLES["price_gaps"] = chain(*_GAPS, out="SELECT symbol, i, direction, round(CASE WHEN direction = 'up' THEN high - ph ELSE low - pl END, 4) + 0.0 AS difference FROM {last} WHERE direction IS NOT NULL")
ORACLES["gap_trends"] = chain(*_GAPS, {f"t{p}": slope("close", p) for p in (7, 14, 28)}, {f"trend_{p}": scaled(f"t{p}") for p in (7, 14, 28)}, out=cells("trend_7", "trend_14", "trend_28") + " WHERE direction IS NOT NULL")
ORACLES["filtered_extrema"] = chain(
    {"st": f"sign(close - {lag('close')})"},
    {"d": f"last_value(CASE WHEN i = 1 AND st = 0 THEN -1 WHEN st <> 0 THEN st END IGNORE NULLS) OVER {frame(None, 0)}"},
    {"nx": f"lead(d) OVER ({O})"},
    out="SELECT symbol, i, CASE WHEN d > 0 THEN 'max' ELSE 'min' END AS kind FROM {last} WHERE d * nx < 0",
)
_POINTS = " UNION ALL ".join(
    f"SELECT symbol, {t} AS timeframe, i // {t} AS block, '{kind}' AS kind, arg_{f}(i, (close, {'' if f == 'min' else '-'}i)) AS i, {f}(close) AS price FROM {{last}} GROUP BY symbol, i // {t}" for t in (13, 21, 34, 55) for kind, f in (("support", "min"), ("resistance", "max"))
)
ORACLES["support_points"] = chain(out=_POINTS)
_KIND = "PARTITION BY symbol, kind ORDER BY price, i"
ORACLES["support_clusters"] = chain(
    _POINTS,
    "SELECT *, lag(price) OVER (" + _KIND + ") AS b FROM (SELECT DISTINCT symbol, kind, i, price FROM {last})",
    "SELECT *, sum(CASE WHEN b IS NULL OR (price - b) / b >= 0.007 THEN 1 ELSE 0 END) OVER (" + _KIND + " ROWS UNBOUNDED PRECEDING) AS chain FROM {last}",
    "SELECT *, max(chain) OVER (PARTITION BY symbol, kind) AS top FROM {last}",
    out="SELECT symbol, kind, round(round_even(avg(price), 2), 0) AS price, min(i) AS start, count(*) AS n_points FROM {last} WHERE chain < top GROUP BY symbol, kind, chain HAVING count(*) > 1",
)

# state machines: each list of stages makes the series, then machines go over it
def recursive(stages: list, machines: list[str], found: str, out: str) -> str:
    """machines are tables over base (the series with p, the close before); found: symbol, i, type, value, score of all signals."""
    base = chain(*stages, {"p": lag("close")}, out=", base AS (SELECT *, close AS c FROM {last})").replace("\n, base", ",\nbase").replace("WITH ", "WITH RECURSIVE ", 1)
    return f"{base},\n" + ",\n".join([*machines, f"found AS ({found})"]) + f"\n{out}"


_EVENTS = "SELECT symbol, i, dt, type, value FROM found JOIN (SELECT symbol, i, dt FROM base) USING (symbol, i)"


def metric_of(weights: tuple[float, ...]) -> str:
    """The score series: impulses spread, averaged and scaled."""
    return f""", q0 AS (SELECT symbol, i, n, coalesce(score, 0.0) AS x FROM base LEFT JOIN (SELECT symbol, i, sum(score) AS score FROM found GROUP BY 1, 2) USING (symbol, i)), q1 AS (SELECT *, {spread("x", weights)} AS y FROM q0),
        q2 AS (SELECT *, {so_far("y")} AS l FROM q1), q3 AS (SELECT *, {ema("y", "l", 7)} AS e FROM q2) SELECT symbol, i, round({largest("e")}, 4) + 0.0 AS metric FROM q3"""


def told(table: str, value: str, score: float) -> str:
    return f"SELECT symbol, i, kind AS type, '{value}' AS value, CASE WHEN kind = 'bullish' THEN {score} ELSE -{score} END AS score FROM {table} WHERE kind IS NOT NULL"


_PAIRS = [("fs", "fast_k", "smooth_k", "fast-smooth crossover"), ("sd", "smooth_k", "slow_d", "smooth-slow crossover")]
_LINES = [("df", "fast_k", "fast divergence"), ("ds", "smooth_k", "smooth divergence"), ("dd", "slow_d", "slow divergence")]
_M = [f"s_{t} AS (SELECT symbol, i, {x} AS x, {y} AS y FROM base), {zone_crossing(t, f's_{t}')}" for t, x, y, _ in _PAIRS] + [f"s_{t} AS (SELECT symbol, i, {x} AS x, c, p FROM base), {zone_divergence(t, f's_{t}')}" for t, x, _ in _LINES]
_F = " UNION ALL ".join([told(t, v, 1.0) for t, _, _, v in _PAIRS] + [told(t, v, 1.5) for t, _, v in _LINES])
ORACLES["stochastic_signals"] = recursive(_STOCHASTIC, _M, _F, _EVENTS)
ORACLES["stochastic_metric"] = recursive(_STOCHASTIC, _M, _F, metric_of((1.0, 0.85, 0.55, 0.1)))
_RSI_ALL = [*_RSI, *_RSI_LIMITS]
_M = ["src AS (SELECT symbol, i, rsi AS x, c, oversold AS lo, overbought AS hi FROM base)", rejection("rej", "src"), zone_turns("turns", "src")]
_F = told("rej", "swing rejection", 1.0) + " UNION ALL " + told("turns", "divergence", 1.0)
ORACLES["rsi_signals"] = recursive(_RSI_ALL, _M, _F, _EVENTS)
ORACLES["rsi_metric"] = recursive(_RSI_ALL, _M, _F, metric_of((1.0, 0.85, 0.55, 0.1)))
_M = [
    "src AS (SELECT symbol, i, ultimate AS x, c, p FROM base)", swings("swing", "src"), lows("low", "src"),
    "final AS (SELECT symbol, z, d, max_by(low, i) AS low FROM low GROUP BY 1, 2, 3)",
    "held AS (SELECT f.*, max(f.d * s.x) AS barrier, max(CASE WHEN s.i = f.z THEN s.x END) AS own, max(CASE WHEN s.i = f.low THEN s.x END) AS there FROM final f JOIN src s ON s.symbol = f.symbol AND s.i BETWEEN f.z AND f.low GROUP BY ALL)",
    "broken AS (SELECT h.symbol, h.z, h.d, min(s.i) AS i FROM held h JOIN src s ON s.symbol = h.symbol AND s.i >= h.low AND h.d * s.x > h.barrier WHERE h.d * (h.there - h.own) > 0 GROUP BY 1, 2, 3)",
    "every AS (SELECT symbol, i, CASE WHEN d > 0 THEN 'bullish' ELSE 'bearish' END AS type, 'divergence (original)' AS value, CAST(d AS DOUBLE) AS score, z FROM broken UNION ALL SELECT *, 1000000000 FROM (" + told("swing", "divergence", 1.0) + "))",
]
_F = "SELECT symbol, i, type, value, score FROM every QUALIFY row_number() OVER (PARTITION BY symbol, i ORDER BY z) = 1"
ORACLES["ultimate_signals"] = recursive(_ULTIMATE, _M, _F, _EVENTS)
ORACLES["ultimate_metric"] = recursive(_ULTIMATE, _M, _F, metric_of((1.0, 0.9, 0.75, 0.45)))
_M = ["src AS (SELECT symbol, i, coalesce(kst, 0) AS x, coalesce(kst_line, 0) AS y, quantile_cont(kst, 0.85) OVER (PARTITION BY symbol) AS hi, quantile_cont(kst, 0.15) OVER (PARTITION BY symbol) AS lo FROM base)", band_exit("exits", "src")]
_F = f"""SELECT symbol, i, kind AS type, CASE WHEN kind = 'bearish' THEN 'overbought signal_line crossed' ELSE 'oversold signal_line crossed' END AS value, 1.0 AS score FROM exits WHERE kind IS NOT NULL
    UNION ALL SELECT symbol, i, CASE WHEN sd > 0 THEN 'bullish' ELSE 'bearish' END, 'signal_line crossover', 0.2 FROM (SELECT *, {lag('sd')} AS was FROM (SELECT *, {side('x - y')} AS sd FROM src)) WHERE sd <> was"""
ORACLES["kst_signals"] = recursive(_KST, _M, _F, _EVENTS)
_M = [f"s{n} AS (SELECT symbol, i, cci_{n} AS x FROM base), {level_crossing(f'm{n}', f's{n}')}" for n in (20, 40, 80)]
_SAID = {"low": ("bearish", "crossover to -100", -1.0), "high": ("bullish", "crossover to +100", 1.0), "down": ("bearish", "zero crossover", -0.6), "up": ("bullish", "zero crossover", 0.6)}
_F = " UNION ALL ".join(f"SELECT symbol, i, '{t}' AS type, '{v} ({n}d)' AS value, {w} AS score FROM m{n} WHERE kind = '{k}'" for n in (20, 40, 80) for k, (t, v, w) in _SAID.items())
ORACLES["cci_signals"] = recursive(_CCI, _M, _F, _EVENTS)
_LEVEL = " + ".join(f"CASE WHEN cci_{n} > 100 THEN 0.2 WHEN cci_{n} < -100 THEN -0.2 ELSE 0.0 END" for n in (20, 40, 80))
ORACLES["cci_metric"] = recursive(
    _CCI, _M, _F, f""", q0 AS (SELECT symbol, i, n, coalesce(score, 0.0) + {_LEVEL} AS y FROM base LEFT JOIN (SELECT symbol, i, sum(score) AS score FROM found GROUP BY 1, 2) USING (symbol, i)), q2 AS (SELECT *, {so_far("y")} AS l FROM q0),
    q3 AS (SELECT *, {ema("y", "l", 7)} AS e FROM q2) SELECT symbol, i, round({largest("e")}, 4) + 0.0 AS metric FROM q3"""
)

def sign_changes(x: str, value: str, score: float, silent: bool = True) -> str:
    """Rows of base from 26 on, or of all, where the last sign of x other than 0 changes; the first one is told unless silent."""
    was = lag("sd") if silent else f"coalesce({lag('sd')}, 0)"
    return f"SELECT symbol, i, CASE WHEN sd > 0 THEN 'bullish' ELSE 'bearish' END AS type, '{value}' AS value, sd * {score} AS score FROM (SELECT *, {was} AS before FROM (SELECT *, {side(x)} AS sd FROM base)) WHERE sd <> before"


_M = ["src AS (SELECT symbol, i, coalesce(macd, 0) AS x, p FROM base)", two_lows("pair", "src"), confirmed_sign("line", "src")]
_BARS = sign_changes("CASE WHEN i >= 26 THEN bar END", "bar crossover", 1.0, silent=False)
ORACLES["macd_signals"] = recursive(_MACD, _M, " UNION ALL ".join([told("pair", "divergence", 1.0), told("line", "zero crossover", 1.0), _BARS]), _EVENTS)
ORACLES["macd_metric"] = recursive(
    _MACD, _M[:2], told("pair", "divergence", 1.0), f""", q0 AS (SELECT symbol, i, n, bar, coalesce(score, 0.0) * max(abs(bar)) OVER (PARTITION BY symbol) / 2.0 AS x FROM base LEFT JOIN (SELECT symbol, i, sum(score) AS score FROM found GROUP BY 1, 2) USING (symbol, i)),
    q1 AS (SELECT *, bar + {spread("x", (1.0, 0.85, 0.55, 0.2))} AS y FROM q0), q2 AS (SELECT *, {so_far("y")} AS l FROM q1), q3 AS (SELECT *, {ema("y", "l", 7)} AS e FROM q2) SELECT symbol, i, round({largest("e")}, 4) + 0.0 AS metric FROM q3"""
)
_M = [f"src AS (SELECT symbol, i, coalesce(awesome, 0) AS x, coalesce({lag('awesome')}, 0) AS w FROM base)", twin_peaks("peaks", "src"), saucer("bowl", "src")]
_F = " UNION ALL ".join([told("peaks", "twin peaks", 1.0), told("bowl", "saucer", 1.0), sign_changes("awesome", "zero crossover", 1.0)])
ORACLES["awesome_signals"] = recursive(_AWESOME, _M, _F, _EVENTS)
ORACLES["awesome_metric"] = recursive(
    _AWESOME, _M, _F, f""", q0 AS (SELECT symbol, i, n, awesome, CAST(sign(coalesce(score, 0.0)) AS DOUBLE) AS x FROM base LEFT JOIN (SELECT symbol, i, sum(score) AS score FROM found GROUP BY 1, 2) USING (symbol, i)),
    q1 AS (SELECT *, {spread("x", (1.0, 0.85, 0.5, 0.05))} AS y FROM q0), q2 AS (SELECT *, {so_far("y")} AS l FROM q1), q3 AS (SELECT *, {ema("y", "l", 7)} AS e FROM q2) SELECT symbol, i, round({largest("e")} + awesome, 4) + 0.0 AS metric FROM q3"""
)
_M = [f"s{n} AS (SELECT symbol, i, roc_{n} AS x, quantile_cont(roc_{n}, 0.9) OVER (PARTITION BY symbol) AS hi, quantile_cont(roc_{n}, 0.1) OVER (PARTITION BY symbol) AS lo FROM base), {zone_exit(f'm{n}', f's{n}')}" for n in (10, 20, 40)]
_F = " UNION ALL ".join([f"SELECT symbol, i, kind AS type, CASE WHEN kind = 'bearish' THEN 'overbought' ELSE 'oversold' END || ' crossover {n}d' AS value, 1.0 AS score FROM m{n} WHERE kind IS NOT NULL" for n in (10, 20, 40)] + [sign_changes(f"roc_{n}", f"zero crossover {n}d", 1.0) for n in (10, 20, 40)])
ORACLES["roc_signals"] = recursive([_ROC], _M, _F, _EVENTS)

ORACLES["zigzag"] = recursive([], ["src AS (SELECT symbol, i, close AS x FROM base)", zigzag("z", "src", 0.05)], "SELECT 1 AS none", "SELECT symbol, CAST(was_place AS BIGINT) AS i, was AS value, kind FROM z WHERE kind IS NOT NULL")

_BANDS = [{"tp": TP}, {"middle": sma("tp", 20), "sd": f"CASE WHEN i < 20 THEN 0.0 ELSE {over('stddev_pop(tp)', -20, -1)} END * 2.0"}, {"upper": "middle + sd", "lower": "middle - sd"}]
_M = [
    "src AS (SELECT symbol, i, c, middle AS mid, lower AS lo, upper AS hi, lower AS edge FROM base WHERE middle IS NOT NULL)", "top AS (SELECT symbol, i, c, mid, hi AS edge FROM src)",
    double_turn("bottoms", "src", 20, 1), double_turn("tops", "top", 20, -1), band_extremes("bands", "src", 20),
]
_F = " UNION ALL ".join([told("bottoms", "W bottom", 1.0), told("tops", "M top", 1.0), "SELECT symbol, i, CASE WHEN kind LIKE 'lower%' THEN 'bearish' ELSE 'bullish' END AS type, kind AS value, CASE WHEN kind LIKE 'lower%' THEN -0.5 ELSE 0.5 END AS score FROM bands WHERE kind IS NOT NULL"])
ORACLES["bollinger_signals"] = recursive(_BANDS, _M, _F, _EVENTS)
ORACLES["bollinger_metric"] = recursive(
    _BANDS, _M, _F, f""", q0 AS (SELECT symbol, i, n, close, middle, lower, coalesce(score, 0.0) AS x FROM base LEFT JOIN (SELECT symbol, i, sum(score) AS score FROM found GROUP BY 1, 2) USING (symbol, i)), q1 AS (SELECT *, {spread("x", (1.0, 0.6, 0.25, 0.0))} AS s FROM q0),
    q2 AS (SELECT *, CASE WHEN abs(s) <= 0.6 THEN coalesce(round_even((close - middle) / nullif(middle - lower, 0), 4), 0.0) ELSE s END AS y FROM q1), q3 AS (SELECT *, {so_far("y")} AS l FROM q2), q4 AS (SELECT *, {ema("y", "l", 7)} AS e FROM q3)
    SELECT symbol, i, round({largest("e")}, 4) + 0.0 AS metric FROM q4"""
)

_M = ["src AS (SELECT symbol, i, bulls AS x, bears AS y, total AS t FROM base)", above_total("above", "src")]
_F = f"""SELECT symbol, i, 'bullish' AS type, 'full bullish signal: 100%' AS value, 3.0 AS score FROM base WHERE total >= 99 AND bulls >= 99 UNION ALL SELECT symbol, i, 'bearish', 'full bearish signal: 100%', -3.0 FROM base WHERE total >= 99 AND bears >= 99
    UNION ALL SELECT symbol, i, CASE WHEN sd > 0 THEN 'bullish' ELSE 'bearish' END, 'bear-bull crossover', -1.0 FROM (SELECT *, {lag("sd")} AS was FROM (SELECT *, coalesce({side("bulls - bears")}, -1) AS sd FROM base)) WHERE sd <> was
    UNION ALL SELECT symbol, i, kind, CASE kind WHEN 'bullish' THEN 'bull-total crossover' ELSE 'bear-total crossover' END, CASE kind WHEN 'bullish' THEN 1.0 ELSE -1.0 END FROM above WHERE kind IS NOT NULL
    UNION ALL SELECT symbol, i, 'bullish', 'bull-adjustment level crossover', 1.0 FROM (SELECT *, {lag("bulls")} AS was FROM base) WHERE was < 72 AND bulls > 72
    UNION ALL SELECT symbol, i, 'bearish', 'bear-adjustment level crossover', -1.0 FROM (SELECT *, {lag("bears")} AS was FROM base) WHERE was < 72 AND bears > 72"""
ORACLES["total_power_signals"] = recursive(_TOTAL, _M, _F, _EVENTS)
ORACLES["total_power_metric"] = recursive(_TOTAL, _M, _F, metric_of((1.0, 0.85, 0.6, 0.25)))

_STATES = [*_POWER, {"e": slope("av", 12), "db": f"bears - {lag('bears')}", "du": f"bulls - {lag('bulls')}", "dc": f"close - {lag('close')}"} | {f"{a}{k}": slope(x, k - 1) for k in _K for a, x in (("b", "bears"), ("u", "bulls"))}]
_F = " UNION ALL ".join(
    f"SELECT symbol, i, 'x' AS type, 'x' AS value, CASE WHEN e > 0 AND bears < 0 AND b{k} > 0 THEN CASE WHEN du > 0 AND dc < 0 THEN 2.5 WHEN du > 0 THEN 1.5 ELSE 1.0 END WHEN e < 0 AND bulls > 0 AND u{k} < 0 THEN CASE WHEN db < 0 AND dc > 0 THEN -2.5 WHEN db < 0 THEN -1.5 ELSE -1.0 END ELSE 0.0 END AS score FROM base WHERE i > 0"
    for k in _K
)
ORACLES["bear_bull_metric"] = recursive(_STATES, [], _F, metric_of((1.0, 0.75, 0.45, 0.1)))

# candles
_CLASS = [
    {"size": "abs(open - close)", "rng": "abs(high - low)", "av": sma("close", 10)},
    {"l": so_far("rng")},
    {"vol": ema("rng", "l", 25)} | {k: f"quantile_cont(size, {q}) OVER ({P})" for k, q in (("pl", 0.75), ("ps", 0.25), ("pd", 0.01))},
    {"shadow_ratio": "CASE WHEN size > 0 THEN (high - low) / size ELSE 0.0 END", "trend": "CASE WHEN close > av THEN 'above' WHEN close < av THEN 'below' ELSE 'at' END", "body": "CASE WHEN size >= pl THEN 'long' WHEN size <= ps THEN 'short' ELSE 'normal' END", "vol_body": "CASE WHEN high > low + vol * 0.75 THEN 'long' WHEN high < low + vol * 0.5 THEN 'short' ELSE 'normal' END", "white": "close > open"},
    {"doji": "size <= pd AND shadow_ratio >= 8.0"},
]
ORACLES["candle_class"] = chain(*_CLASS, out="SELECT symbol, i, trend, body, vol_body, white, doji, round(shadow_ratio, 4) + 0.0 AS shadow_ratio FROM {last}")
_SCRIPTS = ", ".join(f"({k}, {j}, {level}, {', '.join(map(str, c))})" for k, (level, cs) in enumerate(SCRIPTS) for j, c in enumerate(cs))
LINES = f"""SELECT CAST(g AS VARCHAR) AS symbol, DATE '1990-01-01' + CAST(t AS INTEGER) AS dt, CASE WHEN so IS NULL THEN o ELSE base + lv + so END AS open, CASE WHEN so IS NULL THEN greatest(o, c) + up ELSE base + lv + sh END AS high,
    CASE WHEN so IS NULL THEN least(o, c) - down ELSE base + lv + sl END AS low, CASE WHEN so IS NULL THEN c ELSE base + lv + sc END AS close, 1.0::DOUBLE AS volume FROM (
  SELECT *, o + turn * size AS c, CASE WHEN r5 % 100 < bare THEN 0.0 WHEN r5 % 3 = 1 THEN 0.25 ELSE 1.5 END::DOUBLE AS up, CASE WHEN r6 % 100 < bare THEN 0.0 WHEN r6 % 3 = 1 THEN 0.25 ELSE 1.5 END::DOUBLE AS down FROM (
    SELECT *, base + ((r4 % (5 + 4 * (g % 3)) - (2 + 2 * (g % 3))) * 0.25)::DOUBLE AS o, 30 + g % 5 * 15 AS bare,
      CASE WHEN r % 200 = 0 THEN 0.0 WHEN r % 10 < 2 THEN 0.0625 WHEN r % 10 < 4 THEN 0.5 WHEN r % 10 < 7 THEN 1.5 ELSE 3.0 END::DOUBLE AS size,
      CASE WHEN r2 % 100 < 50 + (10 + 15 * (g % 3)) * (CASE WHEN t % 24 < 12 THEN -1 ELSE 1 END) THEN 1.0 ELSE -1.0 END::DOUBLE AS turn FROM (
      SELECT *, (100 + abs(t % 24 - 12) * 0.75 * (g % 4))::DOUBLE AS base, r * 48271 % 2147483647 AS r2, r * 69621 % 2147483647 AS r4, r * 16807 % 2147483647 AS r5, r * 39373 % 2147483647 AS r6 FROM (
        SELECT l_suppkey % 60 AS g, row_number() OVER (PARTITION BY l_suppkey % 60 ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS t, (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 1299709) % 2147483647 * 48271 % 2147483647 AS r FROM lineitem)))
  ) LEFT JOIN (VALUES {_SCRIPTS}) AS x(script, step, lv, so, sh, sl, sc) ON script = t // 50 % {len(SCRIPTS)} AND step = t % 50 - 30"""
_CANDLES = "SELECT symbol, i, dt, struct_pack(open := open, high := high, low := low, close := close, white := white, body := body, vol := vol_body, doji := doji, ratio := shadow_ratio, trend := trend) AS k FROM {last}"


def candle_sql(out: str, source: str | None = None) -> str:
    return chain(*_CLASS, _CANDLES, out=f", candles AS (SELECT * FROM {{last}}) {out}", source=source).replace("\n, candles", ",\ncandles")


_EVERY = " UNION ALL ".join(f"SELECT symbol, i, '{p}' AS pattern, value FROM ({seen(p)})" for p in OUTCOMES)
for _p in OUTCOMES:
    ORACLES[f"candle_{_p.replace(' ', '_')}"] = candle_sql(seen(_p), LINES)
for _name, _source in (("candle_patterns", None), ("candle_patterns_line", LINES)):
    ORACLES[_name] = candle_sql(f"SELECT symbol, i, pattern, CAST(value AS BIGINT) AS value FROM ({_EVERY}) WHERE value <> 0", _source)
_STYLES = " UNION ALL ".join(f"SELECT symbol, i, '{p}: ' || s AS style, coalesce(v, 0) AS v FROM ({seen(p, True)}) WHERE s IS NOT NULL" for p in OUTCOMES)
ORACLES["candle_signals"] = candle_sql(f", styles AS ({_STYLES}) SELECT DISTINCT symbol, i, dt, CASE WHEN net > 0 THEN 'bullish' ELSE 'bearish' END AS type, style AS value FROM (SELECT *, sum(v) OVER (PARTITION BY symbol, i) AS net FROM styles) JOIN (SELECT symbol, i, dt FROM candles) USING (symbol, i) WHERE net <> 0")

# across symbols
_MKT = numbered("market", MARKET) + f",\nmr AS (SELECT dt, adj_close AS market_adj, {CHANGE} AS market_ret FROM market)"
_BOTH = [{"ret": CHANGE}, "SELECT a.*, m.market_ret, m.market_adj FROM {last} a JOIN mr m ON a.dt = m.dt"]
ORACLES["beta"] = chain(*_BOTH, more=_MKT, out="SELECT symbol, round(regr_slope(ret, market_ret), 4) + 0.0 AS beta, round(regr_r2(ret, market_ret), 4) + 0.0 AS r_squared FROM {last} GROUP BY 1")
ORACLES["mci_correlation"] = chain(
    *_BOTH,
    {"hr": "CASE WHEN i >= n // 2 THEN ret END", "hm": "CASE WHEN i >= n // 2 THEN market_ret END"},
    more=_MKT,
    out="SELECT symbol, round_even(regr_slope(ret, market_ret), 5) AS beta, round_even(regr_r2(ret, market_ret), 5) AS r_squared, round_even(regr_slope(hr, hm), 5) AS beta_half, round_even(regr_r2(hr, hm), 5) AS r_squared_half FROM {last} GROUP BY 1",
)
ORACLES["interval_deviation"] = chain(
    "SELECT * FROM {last} WHERE i >= n - 250", {"r": f"coalesce((adj_close - {lag('adj_close')}) / {lag('adj_close')}, 0.0)"}, out="SELECT symbol, round(avg(r), 4) + 0.0 AS mean_return, round(median(r), 4) + 0.0 AS median_return, round(stddev_pop(r), 4) + 0.0 AS interval_deviation FROM {last} GROUP BY 1"
)
ORACLES["normalized_ratio"] = chain(*_BOTH, {"q": "adj_close / market_adj"}, {"q0": f"round_even(first_value(q) OVER ({O}), 6)"}, {"ratio": "round_even(q / q0 - 1.0, 6)"}, more=_MKT, out=cells("ratio"))
ORACLES["period_strength"] = chain(
    *_BOTH,
    "SELECT symbol, i, n, adj_close / market_adj AS q, p.period FROM {last} CROSS JOIN (VALUES (20), (50), (100)) p(period) WHERE i >= n - p.period",
    "SELECT *, round_even(first_value(q) OVER (PARTITION BY symbol, period ORDER BY i), 6) AS q0 FROM {last}",
    {"r": "round_even(q / q0 - 1.0, 6)"},
    more=_MKT,
    out="SELECT symbol, period, round(avg(r), 4) + 0.0 AS average, round(stddev_pop(r), 4) + 0.0 AS deviation, round(min(r), 4) + 0.0 AS lowest, round(max(r), 4) + 0.0 AS highest, round(max_by(r, i), 4) + 0.0 AS current FROM {last} GROUP BY 1, 2",
)
ORACLES["future_returns"] = chain({f"future_{k}": f"coalesce(round_even((lead(close, {k}) OVER ({O}) - close) / close * 100.0, 3), 0.0)" for k in (5, 15, 45, 90)}, out=cells("future_5", "future_15", "future_45", "future_90"))


def r_squared(w: int) -> dict[str, str]:
    s = {k: over(f"sum({e})", 1 - w, -1) for k, e in {"x": "market_ret", "y": "ret", "xx": "market_ret * market_ret", "yy": "ret * ret", "xy": "market_ret * ret"}.items()}
    den = f"(({w}.0 * {s['xx']} - {s['x']} * {s['x']}) * ({w}.0 * {s['yy']} - {s['y']} * {s['y']}))"
    return {f"r{w}": f"CASE WHEN i < {w} THEN 0.0 ELSE coalesce(({w}.0 * {s['xy']} - {s['x']} * {s['y']}) ** 2 / CASE WHEN {den} > 0 THEN {den} END, 0.0) END"}


ORACLES["rolling_correlation"] = chain(*_BOTH, r_squared(50), more=_MKT, out="SELECT symbol, i, dt, round(r50, 4) + 0.0 AS r_squared FROM {last}")
ORACLES["correlation_index"] = chain(
    *_BOTH,
    r_squared(100) | r_squared(50) | r_squared(25),
    "SELECT 'all' AS symbol, dt, sum(r100) AS a, sum(r50) AS b, sum(r25) AS c FROM {last} GROUP BY dt",
    {"i": "row_number() OVER (ORDER BY dt) - 1", "n": "count(*) OVER ()"},
    {"corr_100": largest("a"), "corr_50": largest("b"), "corr_25": largest("c")},
    {"overall": "1.5 * corr_100 + 1.25 * corr_50 + corr_25"},
    {"line": sma("overall", 20)},
    {"difference": "overall - line"},
    more=_MKT,
    out=cells("corr_100", "corr_50", "corr_25", "overall", "line", "difference").replace("SELECT symbol, i,", "SELECT i, dt,"),
)
_COMPOUND = "round(ln({0}) + sum(ln(1 + greatest({1}, -0.99))) OVER (PARTITION BY {2} ORDER BY dt ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS log_value"
ORACLES["bci"] = chain(
    {"ret": CHANGE}, "SELECT r_name AS name, dt, sum(ret * 0.2) / 100.0 AS r FROM {last} JOIN nation ON symbol = CAST(n_nationkey AS VARCHAR) JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2", source=NATION, out="SELECT name, dt, " + _COMPOUND.format("25.0", "r", "name") + " FROM {last}"
)
ORACLES["synthetic_fund"] = chain(
    {"ret": CHANGE},
    "SELECT r_name AS fund, dt, sum(ret / 100.0 * 0.2 * 0.9) AS r FROM {last} JOIN nation ON symbol = CAST(n_nationkey AS VARCHAR) JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "SELECT fund, dt, r + 0.1 * (0.01 / count(*) OVER (PARTITION BY fund) / 2.0) AS r FROM {last}",
    source=NATION,
    out="SELECT fund, dt, " + _COMPOUND.format("25.0", "r", "fund") + " FROM {last}",
)

# reports
_LONG = " UNION ALL ".join(f"SELECT symbol, i, '{a}' AS indicator, '{c}' AS component, {c} AS value FROM {{last}}" for a, c in (("average", "short"), ("average", "medium"), ("atr", "atr")))
ORACLES["synopsis"] = chain(
    *_ATR,
    _SMA3,
    _LONG,
    "SELECT *, lag(value) OVER (PARTITION BY symbol, indicator, component ORDER BY i) AS b FROM {last}",
    out="SELECT symbol, indicator, component, round(max_by(value, i), 4) + 0.0 AS current, round(max_by(b, i), 4) + 0.0 AS previous, CASE WHEN indicator = 'atr' THEN 'oscillator' ELSE 'trend' END AS kind FROM {last} GROUP BY 1, 2, 3",
)
ORACLES["export_pivot"] = chain(*_ATR, _SMA3, out='SELECT symbol, i, round(coalesce(short, 0.0), 4) + 0.0 AS "average-short", round(coalesce(medium, 0.0), 4) + 0.0 AS "average-medium", round(coalesce(atr, 0.0), 4) + 0.0 AS "atr-atr" FROM {last}')
ORACLES["export_filter"] = chain(*_ATR, out="SELECT symbol, i, 'atr' AS indicator, 'atr' AS component, round(atr, 4) + 0.0 AS value FROM {last} WHERE symbol = '5-LOW'")

# portfolios
_TRADES = "t AS (SELECT o_orderpriority AS symbol, CAST(date_trunc('week', o_orderdate) AS DATE) AS dt, CASE WHEN l_returnflag = 'R' THEN -1.0 ELSE 1.0 END AS sg, l_extendedprice / l_quantity * l_quantity AS amount, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
ORACLES["ledger_sim"] = chain(
    "SELECT b.symbol, b.dt, b.close, coalesce(s.q, 0.0) AS q, coalesce(s.c, 0.0) AS c FROM {last} b LEFT JOIN (SELECT symbol, dt, sum(sg * q) AS q, sum(-sg * amount) AS c FROM t GROUP BY 1, 2) s ON b.symbol = s.symbol AND b.dt = s.dt",
    "SELECT *, sum(q) OVER (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING) AS held FROM {last}",
    "SELECT dt, sum(held * close) AS value, sum(c) AS c FROM {last} GROUP BY 1",
    "SELECT dt, value, 1000000.0 + sum(c) OVER (ORDER BY dt ROWS UNBOUNDED PRECEDING) AS cash FROM {last}",
    more=_TRADES,
    out="SELECT dt, round(value, 2) + 0.0 AS value, round(cash, 2) + 0.0 AS cash, round(value + cash, 2) + 0.0 AS total FROM {last}",
)
ORACLES["holdings"] = chain(
    "SELECT s.symbol, s.shares, s.shares * c.close AS value FROM (SELECT symbol, sum(sg * q) AS shares FROM t GROUP BY 1) s JOIN (SELECT symbol, max_by(close, i) AS close FROM {last} GROUP BY 1) c ON s.symbol = c.symbol",
    "SELECT *, round_even(value / sum(value) OVER () * 100.0, 2) AS percent FROM {last}",
    more=_TRADES,
    out="SELECT symbol, round(shares, 2) + 0.0 AS shares, round(value, 2) + 0.0 AS value, round(percent, 2) + 0.0 AS percent, CAST(dense_rank() OVER (ORDER BY percent DESC) AS INTEGER) AS rank FROM {last}",
)
_BRACKETS = ((0, 11000, 0.1), (11000, 44725, 0.12), (44725, 95375, 0.22), (95375, 182100, 0.24), (182100, 231250, 0.32), (231250, 578125, 0.35), (578125, 100000000, 0.37))
_TAX = " + ".join(f"greatest(least(o_totalprice, {h}.0) - {low}.0, 0.0) * {r}" for low, h, r in _BRACKETS)
ORACLES["tax_brackets"] = f"SELECT o_orderkey, round(o_totalprice, 2) + 0.0 AS income, round(tax, 4) + 0.0 AS tax, round(coalesce(round_even(round_even(tax, 2) / nullif(o_totalprice, 0) * 100.0, 2), 0.0), 1) + 0.0 AS effective_rate FROM (SELECT o_orderkey, o_totalprice, {_TAX} AS tax FROM orders)"
_RACE = "CASE WHEN g = 0 THEN pay * {0} ELSE pay * ((1.0 + g) ** ({0}) - 1.0) / g END"
ORACLES["contribution_race"] = f"""SELECT scenario, CAST(m AS INTEGER) AS month, round(({_RACE.format("least(m, 120)")}) * (1.0 + g) ** greatest(m - 120, 0), 2) + 0.0 AS early, round({_RACE.format("greatest(m - 120, 0)")}, 2) + 0.0 AS late
    FROM (SELECT CAST(s AS BIGINT) AS scenario, r / 12.0 AS g, c / 12.0 AS pay FROM (VALUES (1, 0.06::DOUBLE, 6000.0::DOUBLE), (2, 0.09, 12000.0), (3, 0.0, 6000.0)) v(s, r, c)), range(1, 505) x(m)"""
ORACLES["dividends_quarterly"] = chain(
    """SELECT d.symbol, d.year, d.quarter, sum(round_even(dividend * 100.0, 2)) AS paid, sum(dividend) AS dividend FROM (SELECT symbol, CAST(year(dt) AS INTEGER) AS year, CAST(quarter(dt) AS INTEGER) AS quarter, round_even(close * 0.01, 2) AS dividend FROM {last} WHERE i % 13 = 6) d GROUP BY 1, 2, 3""",
    "SELECT s.*, coalesce(e.next_close, e.last_close) AS price FROM {last} s LEFT JOIN (SELECT *, lead(first_close) OVER (PARTITION BY symbol ORDER BY year, quarter) AS next_close FROM (SELECT symbol, year(dt) AS year, quarter(dt) AS quarter, max_by(close, dt) AS last_close, min_by(close, dt) AS first_close FROM bars GROUP BY 1, 2, 3)) e ON s.symbol = e.symbol AND s.year = e.year AND s.quarter = e.quarter",
    out='SELECT symbol, year, quarter, round(round_even(paid, 2), 4) + 0.0 AS paid, round(price, 4) + 0.0 AS price, round(round_even(dividend / price * 400.0, 4), 4) + 0.0 AS "yield" FROM {last}',
)

# fundamentals
ORACLES["altman_z"] = """SELECT symbol, round(z, 4) AS z, CASE WHEN z >= 3.0 THEN 'green' WHEN z > 1.8 THEN 'yellow' ELSE 'red' END AS colour FROM (
    SELECT CAST(s_suppkey AS VARCHAR) AS symbol, 1.2 * (((abs(s_acctbal) + 50) / (abs(s_acctbal) * 0.5 + 40)) / (abs(s_acctbal) * 3 + 100)) + 1.4 * (s_acctbal / (abs(s_acctbal) * 3 + 100)) + 3.3 * (s_acctbal * 0.2 / (abs(s_acctbal) * 3 + 100))
        + 0.6 * (abs(s_acctbal) * 4 / (abs(s_acctbal) * 0.5 + 40)) + abs(s_acctbal) * 2 / (abs(s_acctbal) * 3 + 100) AS z FROM supplier)"""
ORACLES["statement_pivot"] = "SELECT CAST(s_suppkey AS VARCHAR) AS symbol, round(s_acctbal * 0.2, 4) + 0.0 AS ebit, round(abs(s_acctbal) * 3 + 100, 4) + 0.0 AS total_assets FROM supplier"
ORACLES["eps"] = "SELECT CAST(o_custkey AS VARCHAR) AS symbol, strftime(o_orderdate, '%Y') AS period, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) / (o_custkey % 97 + 3), 0) AS eps FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey, 2"
ORACLES["recommendation_curve"] = """WITH g AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS dt, o_custkey % 11 AS firm, max(CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 3 END) AS g FROM orders GROUP BY 1, 2, 3),
    h AS (SELECT *, least(lead(dt) OVER (PARTITION BY symbol, firm ORDER BY dt), CAST(dt + INTERVAL 24 MONTH AS DATE)) AS until FROM g)
    SELECT d.symbol, d.dt, count(*) AS firms, round(avg(h.g), 4) AS mean_grade FROM (SELECT DISTINCT symbol, dt FROM g) d JOIN h ON h.symbol = d.symbol AND h.dt <= d.dt AND d.dt < h.until GROUP BY 1, 2"""
ORACLES["bars_6h"] = """SELECT event_type AS symbol, to_timestamp(CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT))::TIMESTAMP AS dt, round(min_by(value, ts), 4) + 0.0 AS open, round(max(value), 4) + 0.0 AS high, round(min(value), 4) + 0.0 AS low, round(max_by(value, ts), 4) + 0.0 AS close, count(*) AS volume FROM events GROUP BY 1, 2"""

# extrema and lines: tables of their own over the bars
_BARS = numbered("bars", raw_bars())
_OBV_BARS = _BARS.replace("bars AS", "priced AS", 1) + f""",
moved AS (SELECT *, coalesce(sign(close - {lag('close')}), 0) * volume AS mv FROM priced), bars AS (SELECT * REPLACE ({over('sum(mv)', None, 0)} AS close) FROM moved)"""
for _name, _sql in (
    ("extrema", line_sql.EXTREMA), ("head_shoulders", line_sql.head_and_shoulders([4], "")), ("head_shoulders_all", line_sql.head_and_shoulders(list(line_sql.SIZES), "size AS filter_size, ")), ("trend_lines", line_sql.TREND_LINES),
    ("trend_forecast", line_sql.TREND_FORECAST), ("trend_touches", line_sql.TREND_TOUCHES), ("trend_periods", line_sql.TREND_PERIODS), ("obv_trend_lines", line_sql.OBV_LINES), ("channel_lines", line_sql.CHANNEL_LINES),
    ("line_groups", line_sql.LINE_GROUPS), ("nearest_lines", line_sql.NEAREST_LINES),
):
    ORACLES[_name] = _sql.replace("{bars}", _BARS).replace("{obv}", _OBV_BARS)

# runs of one sign, as ranges around each row
_RUNS = [
    *_MACD,
    {"ln": f"max(CASE WHEN macd < 0 THEN i END) OVER ({O} ROWS UNBOUNDED PRECEDING)", "lp": f"max(CASE WHEN macd > 0 THEN i END) OVER ({O} ROWS UNBOUNDED PRECEDING)", "nn": f"min(CASE WHEN macd < 0 THEN i END) OVER ({O} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", "np": f"min(CASE WHEN macd > 0 THEN i END) OVER ({O} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"},
    {"run_start": "coalesce(CASE WHEN macd > 0 THEN ln ELSE lp END + 1, 0)", "run_end": "coalesce(CASE WHEN macd > 0 THEN nn ELSE np END - 1, n - 1)"},
    "SELECT a.*, a.run_end - a.run_start + 1 AS run_rows, (SELECT max(abs(b.macd)) FROM {last} b WHERE b.symbol = a.symbol AND b.i BETWEEN a.run_start AND a.run_end) AS top FROM {last} a",
    {"group_value": "CASE WHEN top = 0 THEN 0.0 ELSE macd / top * 100.0 END", "rows1": lag("run_rows", 2), "at": f"{lag('run_start', 2)} - 2"},
    "SELECT a.*, CASE WHEN a.i > 2 AND a.at > 0 THEN 1.5 - a.rows1 * 1.0 / greatest(a.rows1, b.run_rows) * 0.5 ELSE 1.25 END AS factor FROM {last} a LEFT JOIN {last} b ON b.symbol = a.symbol AND b.i = a.at",
]
ORACLES["macd_runs"] = chain(*_RUNS, out="SELECT symbol, i, run_start, run_end, run_rows, round(group_value, 4) + 0.0 AS group_value, round(factor, 4) + 0.0 AS factor FROM {last}")
_STATS = [*_RUNS, {"mm": so_far("macd")}, {"e3": ema("macd", "mm", 3), "m1": lag("macd"), "m3": lag("macd", 3), "largest": f"max(abs(macd)) OVER ({P})", "up": f"max_by(macd, i) OVER ({P}) > 0"}, {"bound": f"coalesce(max(CASE WHEN i < n - 1 AND (macd > 0) <> up THEN i END) OVER ({P}), 0)"}, {"seg": f"list(macd) FILTER (WHERE i >= bound) OVER ({O} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"}]
ORACLES["macd_stats"] = chain(
    *_STATS,
    "SELECT *, CASE WHEN len(seg) > 6 THEN list_reduce(list_prepend(list_avg(seg[1:3]), seg[4:]), lambda e, v: e * 0.5 + v * 0.5) END AS se, group_value / factor AS strength FROM {last} WHERE i = n - 1",
    out="""SELECT symbol, round(macd, 4) + 0.0 AS macd, round(macd / nullif(largest, 0) * 100.0, 4) + 0.0 AS period_value, round(group_value, 4) + 0.0 AS group_value, round(CASE WHEN top = 0 THEN 0.0 ELSE (macd - e3) / top * 100.0 END, 4) + 0.0 AS change, run_start, run_rows, round(factor, 4) + 0.0 AS factor,
    CASE WHEN macd > m1 THEN 'rising' ELSE 'falling' END AS current_trend, CASE WHEN se IS NULL THEN NULL WHEN macd > se THEN 'rising' ELSE 'falling' END AS group_trend,
    CASE WHEN macd > 0 AND m3 < 0 THEN 'crossover_bullish' WHEN macd < 0 AND m3 > 0 THEN 'crossover_bearish' ELSE CASE WHEN abs(strength) > 70 THEN 'strongly' ELSE 'weakly' END || CASE WHEN strength > 0 THEN '_bullish' ELSE '_bearish' END END AS state FROM {last}""",
)

# levels: clusters as above, united pair by pair, round by round
_LEVELS = """clusters AS (SELECT symbol, CASE WHEN 2 * (x % n) = n THEN x // n + x // n % 2 WHEN 2 * (x % n) > n THEN x // n + 1 ELSE x // n END AS c, s FROM (SELECT symbol, CAST(sum(CAST(round(price * 100) AS BIGINT)) AS BIGINT) AS x, count(*) AS n, min(i) AS s FROM ({chains}) WHERE chain < top GROUP BY symbol, kind, chain HAVING count(*) > 1)),
near AS (SELECT 0 AS step, symbol, c, s FROM clusters UNION ALL SELECT step + 1, symbol, unnest(cs), unnest(ss) FROM (SELECT step, symbol, more,
    CASE WHEN c / 100.0 > nc / 100.0 * (1 - 0.011) THEN [CASE WHEN (c + nc) % 2 = 0 THEN (c + nc) // 2 ELSE (c + nc) // 2 + (c + nc) // 2 % 2 END] WHEN coalesce(pc / 100.0 > c / 100.0 * (1 - 0.011), false) THEN [] ELSE [c] END AS cs,
    CASE WHEN c / 100.0 > nc / 100.0 * (1 - 0.011) THEN [least(s, ns)] WHEN coalesce(pc / 100.0 > c / 100.0 * (1 - 0.011), false) THEN [] ELSE [s] END AS ss
    FROM (SELECT *, bool_or(coalesce(c / 100.0 > nc / 100.0 * (1 - 0.011), false)) OVER (PARTITION BY symbol) AS more FROM (SELECT *, lead(c) OVER w AS nc, lead(s) OVER w AS ns, lag(c) OVER w AS pc FROM near WINDOW w AS (PARTITION BY symbol ORDER BY c, s)))) WHERE more),
levels AS (SELECT symbol, c / 100.0 AS price, s AS start FROM near QUALIFY step = max(step) OVER (PARTITION BY symbol))"""
_CHAINS = chain(
    _POINTS, "SELECT *, lag(price) OVER (" + _KIND + ") AS b FROM (SELECT DISTINCT symbol, kind, i, price FROM {last})",
    "SELECT *, sum(CASE WHEN b IS NULL OR (price - b) / b >= 0.007 THEN 1 ELSE 0 END) OVER (" + _KIND + " ROWS UNBOUNDED PRECEDING) AS chain FROM {last}", "SELECT *, max(chain) OVER (PARTITION BY symbol, kind) AS top FROM {last}", out="SELECT * FROM {last}",
)
_LEVELS = "WITH RECURSIVE " + _BARS + ",\n" + _LEVELS.replace("{chains}", _CHAINS)
ORACLES["support_levels"] = _LEVELS + "\nSELECT * FROM levels"
ORACLES["support_resistance"] = (
    _LEVELS
    + """,
closes AS (SELECT symbol, max_by(close, i) AS last FROM bars GROUP BY 1),
against AS (SELECT l.symbol, price, start, last, round_even((price - last) / last * 100.0, 3) AS percent FROM levels l JOIN closes c ON c.symbol = l.symbol),
lists AS (SELECT *, 'major' AS list, -price AS far FROM against UNION ALL SELECT *, CASE WHEN price < last THEN 'support' ELSE 'resistance' END, abs(price - last) FROM against WHERE price <> last)
SELECT symbol, list, row_number() OVER (PARTITION BY symbol, list ORDER BY far, start) AS rank, price, start, round(percent, 2) + 0.0 AS percent, CASE WHEN percent < 0 THEN 'support' ELSE 'resistance' END AS state FROM lists QUALIFY list = 'major' OR rank <= 7"""
)
ORACLES["nearest_levels"] = _LEVELS + """
SELECT b.symbol, b.i, b.dt, b.close, (SELECT max(price) FROM levels l WHERE l.symbol = b.symbol AND price <= b.close) AS support, (SELECT min(price) FROM levels l WHERE l.symbol = b.symbol AND price > b.close) AS resistance FROM bars b"""

# reversals in an extreme of the stochastic oscillator
_SEEN = " UNION ALL ".join(f"SELECT symbol, i, {k} AS k, j, '{p}: ' || s AS style, v FROM (SELECT *, row_number() OVER (PARTITION BY symbol, i ORDER BY body) AS j FROM ({seen_by_body(p)})) WHERE s IS NOT NULL" for k, p in enumerate(("dark cloud piercing line", "evening morning star")))
_ADDED = f", found AS ({_SEEN}), net AS (SELECT symbol, i, sum(v) AS value, string_agg(style, ', ' ORDER BY k, j) AS styles FROM found GROUP BY 1, 2 HAVING sum(v) <> 0)"
ORACLES["candle_reversals_unconfirmed"] = candle_sql(_ADDED + " SELECT symbol, i, dt, CAST(value AS INTEGER) AS value, styles FROM net JOIN (SELECT symbol, i, dt FROM candles) USING (symbol, i)", LINES)
ORACLES["candle_reversals"] = chain(
    *_STOCHASTIC, *_CLASS, {"zone": "smooth_k >= 80 OR smooth_k <= 20"}, {"zones": f"zone OR coalesce({lag('zone')}, false)"}, "SELECT zones, " + _CANDLES.removeprefix("SELECT "),
    out=f", candles AS (SELECT * FROM {{last}}) {_ADDED} SELECT symbol, i, dt, CAST(value * 2 AS INTEGER) AS value, styles FROM net JOIN (SELECT symbol, i, dt, zones FROM candles) USING (symbol, i) WHERE zones", source=LINES,
).replace("\n, candles", ",\ncandles")

# signals of four indicators, as sessions of three weeks
_FOUR = {"average": "ma_crossovers", "stochastic": "stochastic_signals", "rsi": "rsi_signals", "macd": "macd_signals"}
ORACLES["merged_signals"] = (
    "WITH found AS ("
    + " UNION ALL ".join(f"SELECT symbol, i, dt, type, '{k}' AS indicator FROM ({ORACLES[q]})" for k, q in _FOUR.items())
    + """),
fresh AS (SELECT *, CASE WHEN dt <= lag(dt) OVER w + INTERVAL 21 DAY THEN 0 ELSE 1 END AS f FROM found WINDOW w AS (PARTITION BY symbol, type ORDER BY dt)),
session AS (SELECT *, sum(f) OVER (PARTITION BY symbol, type ORDER BY dt, f DESC ROWS UNBOUNDED PRECEDING) AS s FROM fresh)
SELECT symbol, type, min(i) AS first_i, max(i) AS last_i, min(dt) AS first_dt, max(dt) AS last_dt, count(*) AS n_signals, string_agg(DISTINCT indicator, ',' ORDER BY indicator) AS indicators FROM session GROUP BY symbol, type, s"""
)

# the calendar: missing rows inserted and repaired
_GRID = f"""WITH raw AS ({NATION}), numbers AS (SELECT *, row_number() OVER ({P} ORDER BY dt) - 1 AS j FROM raw), held AS (SELECT * FROM numbers WHERE j % 5 <> 2),
days AS (SELECT DISTINCT dt FROM raw), months AS (SELECT CAST(unnest(generate_series(min(dt), max(dt), INTERVAL 1 MONTH)) AS DATE) AS dt FROM raw), names AS (SELECT DISTINCT symbol FROM held)"""
_HOLES = {c: f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN b_{c} IS NULL THEN first_value({c} IGNORE NULLS) OVER ({O} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) WHEN lead({c}) OVER ({O}) IS NOT NULL THEN {_MEAN.replace('{v}', c).replace('{c}', c)} ELSE b_{c} END" for c in ("open", "close")}
ORACLES["calendar_align"] = f"""{_GRID},
grid AS (SELECT s.symbol, d.dt, h.open, h.close, row_number() OVER (PARTITION BY s.symbol ORDER BY d.dt) - 1 AS i FROM names s CROSS JOIN days d LEFT JOIN held h ON h.symbol = s.symbol AND h.dt = d.dt),
before AS (SELECT *, {', '.join(f"last_value({c} IGNORE NULLS) OVER ({O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b_{c}" for c in _HOLES)} FROM grid)
SELECT symbol, i, {', '.join(f"round({e}, 4) + 0.0 AS {c}" for c, e in _HOLES.items())} FROM before"""
ORACLES["calendar_inserted"] = f"""{_GRID},
grid AS (SELECT s.symbol, d.dt, h.close, row_number() OVER (PARTITION BY s.symbol ORDER BY d.dt) - 1 AS i, h.symbol IS NULL AS missing FROM names s CROSS JOIN months d LEFT JOIN held h ON h.symbol = s.symbol AND h.dt = d.dt)
SELECT symbol, i, dt FROM grid WHERE missing"""

# files
ORACLES["ledger_files"] = """SELECT 'FUND' || l_suppkey % 7 AS ticker, 'Fund of part, ' || l_suppkey % 7 AS title, 1e6::DOUBLE AS start_capital, 'P' || l_partkey % 50 AS stock, CASE WHEN l_returnflag = 'R' THEN 'Sell' ELSE 'Buy' END AS action, count(*) AS n_trades,
    min(o_orderdate)::DATE AS first_dt, max(o_orderdate)::DATE AS last_dt, round(sum(l_quantity::DECIMAL(18, 2))::DOUBLE, 2) + 0.0 AS shares, round(sum(l_extendedprice::DECIMAL(18, 2))::DOUBLE, 2) + 0.0 AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4, 5"""
ORACLES["config_files"] = """SELECT upper(n_name) AS symbol, p AS period, m AS months, i AS interval, CASE WHEN r_regionkey % 2 = 0 AND r_regionkey > 2 THEN 'bci,mci' WHEN r_regionkey % 2 = 0 THEN 'mci' WHEN r_regionkey > 2 THEN 'bci' ELSE '' END AS indexes,
    CASE WHEN r_regionkey > 0 THEN lower(r_name) ELSE '' END AS export FROM nation JOIN region ON n_regionkey = r_regionkey CROSS JOIN (VALUES ('2y', 24, '1wk'), ('5y', 60, '1d')) t(p, m, i)"""
ORACLES["export_csv"] = ORACLES["export_pivot"]
_THREE = {"average": "ma_crossovers", "awesome": "awesome_zero", "atr": "atr_signals"}
ORACLES["export_json"] = (
    "WITH found AS (" + " UNION ALL ".join(f"SELECT symbol, '{k}' AS indicator FROM ({ORACLES[q]})" for k, q in _THREE.items())
    + f"), counted AS (SELECT symbol, indicator, count(*) AS n FROM found GROUP BY 1, 2), series AS ({chain(*_ATR, _SMA3, out='SELECT symbol, i, short, medium, atr FROM {last}')}), "
    + """cells AS (SELECT symbol, 'average' AS indicator, 'short' AS component, i, short AS v FROM series UNION ALL SELECT symbol, 'average', 'medium', i, medium FROM series UNION ALL SELECT symbol, 'atr', 'atr', i, atr FROM series)
SELECT c.symbol, c.indicator, component, coalesce(max(n), 0) AS n_signals, count(*) AS n_values, round(arg_max(v, i), 4) + 0.0 AS last FROM cells c LEFT JOIN counted d ON d.symbol = c.symbol AND d.indicator = c.indicator GROUP BY 1, 2, 3"""
)

# stop and reverse: the slow pass goes on with the side and the extreme that the fast one ended with
def _sar(name: str, base: float, first: str) -> str:
    """first: symbol, sar, ext and up at row 4."""
    now = "(m.sar + m.fac * (m.ext - m.sar))"
    broke, along = f"CASE WHEN m.up THEN s.low < {now} ELSE s.high > {now} END", "CASE WHEN m.up THEN s.high > m.ext ELSE s.low < m.ext END"
    return f"""{name} AS (SELECT symbol, CAST(4 AS BIGINT) AS i, sar, ext, {base!r}::DOUBLE AS fac, up, false AS turn FROM ({first}) UNION ALL SELECT s.symbol, CAST(s.i AS BIGINT), CASE WHEN {broke} THEN m.ext ELSE {now} END,
    CASE WHEN {broke} THEN CASE WHEN m.up THEN s.low ELSE s.high END WHEN {along} THEN CASE WHEN m.up THEN s.high ELSE s.low END ELSE m.ext END, CASE WHEN {broke} THEN {base!r} WHEN {along} THEN least(m.fac + {base!r}, 0.2) ELSE m.fac END, CASE WHEN {broke} THEN NOT m.up ELSE m.up END, {broke}
    FROM {name} m JOIN bars s ON s.symbol = m.symbol AND s.i = m.i + 1)"""


_SAR = f"""WITH RECURSIVE {_BARS},
start AS (SELECT symbol, max(high) AS top, min(low) AS bottom, regr_slope(close, i) FILTER (WHERE i < 4) > 0 AS up FROM bars WHERE i < 5 GROUP BY 1 HAVING count(*) = 5),
{_sar("fast", 0.02, "SELECT symbol, CASE WHEN up THEN bottom ELSE top END AS sar, CASE WHEN up THEN top ELSE bottom END AS ext, up FROM start")},
ended AS (SELECT symbol, arg_max(ext, i) AS ext, arg_max(up, i) AS up FROM fast GROUP BY 1),
{_sar("slow", 0.01, "SELECT e.symbol, CASE WHEN s.up THEN s.bottom ELSE s.top END AS sar, e.ext, e.up FROM ended e JOIN start s ON s.symbol = e.symbol")}"""
_PASSES = [("fast", "f"), ("slow", "g")]
ORACLES["psar"] = f"""{_SAR}
SELECT b.symbol, b.i, {', '.join(f"round(coalesce({t}.sar, close), 4) + 0.0 AS sar_{n}, round(round_even((close - coalesce({t}.sar, close)) / nullif(coalesce({t}.sar, close), 0) * 100.0, 3), 4) + 0.0 AS sar_{n}_pct" for n, t in _PASSES)}
FROM bars b LEFT JOIN fast f ON f.symbol = b.symbol AND f.i = b.i LEFT JOIN slow g ON g.symbol = b.symbol AND g.i = b.i"""
ORACLES["psar_signals"] = f"{_SAR}\n" + " UNION ALL ".join(f"SELECT t.symbol, t.i, b.dt, CASE WHEN up THEN 'bullish' ELSE 'bearish' END AS type, CASE WHEN up THEN 'downtrend broken-{n}' ELSE 'upward broken-{n}' END AS value FROM {n} t JOIN bars b ON b.symbol = t.symbol AND b.i = t.i WHERE turn" for n, _ in _PASSES)

# swings: st is the block, kind the event, v the score
_STATE = "CASE WHEN i < {n} THEN 'n' WHEN short > medium AND medium > long THEN 'u3' WHEN short > medium AND short > long THEN 'u2' WHEN short > medium OR short > long THEN 'u1' WHEN short < medium AND medium < long THEN 'e3' WHEN short < medium AND short < long THEN 'e2' WHEN short < medium OR short < long THEN 'e1' ELSE 'n' END"
_SWUNG = "WHEN now = 'u2' THEN CASE WHEN was LIKE 'e%' THEN {a} ELSE {z} END WHEN now = 'u3' AND was <> 'u3' AND m.st <> 'u' THEN {b} WHEN c > y THEN {c} WHEN now = 'e2' THEN CASE WHEN was LIKE 'u%' THEN {d} ELSE {z} END WHEN now = 'e3' AND was <> 'e3' AND m.st <> 'e' THEN {e} WHEN c < y THEN {f}"


def swung(**k: str) -> str:
    return "CASE WHEN s.i = 0 THEN {z} ".format(**k) + _SWUNG.format(**k) + f" ELSE {k['z']} END"


_SWINGS = machine("swung", "sw", {"st": "''", "v": "0"}, {"st": swung(a="'u1'", b="'u'", c="m.st", d="'e1'", e="'e'", f="m.st", z="m.st"), "v": swung(a="0.5", b="1.0", c="0.1", d="-0.5", e="-1.0", f="-0.1", z="0.0")}, swung(a="'bullish'", b="'bullish'", c="NULL", d="'bearish'", e="'bearish'", f="NULL", z="NULL"))


def swing_series(stages: list, after: int, scaled_first: bool) -> str:
    head = chain(*stages, {"now": _STATE.replace("{n}", str(after))}, {"was": lag("now")}, out=", sw AS (SELECT symbol, i, n, dt, now, was, close AS c, long AS y FROM {last})").replace("\n, sw", ",\nsw").replace("WITH ", "WITH RECURSIVE ", 1)
    whole_scale = largest("y0") if scaled_first else "y0"
    return f"{head},\n{_SWINGS},\ng0 AS (SELECT s.symbol, s.i, s.n, s.dt, v, w.kind FROM swung w JOIN sw s ON s.symbol = w.symbol AND s.i = w.i), g1 AS (SELECT *, {spread('v', (1.0, 0.55, 0.25, 0.1))} AS y0 FROM g0), g2 AS (SELECT *, {whole_scale} AS y1 FROM g1), g3 AS (SELECT *, {sma('y1', 7)} AS metric FROM g2)\n"


_HULL = [{f"h{n}": f"2.0 * ({wma('close', n // 2)}) - ({wma('close', n)})" for n in (9, 16, 36)}, {"short": wma("h9", 3), "medium": wma("h16", 4), "long": wma("h36", 6)}]
_SHOWN = "SELECT symbol, i, round(v, 4) + 0.0 AS swing, round(metric, 4) + 0.0 AS metric FROM g3"
ORACLES["swing_trade"] = swing_series([_SWING], 18, False) + _SHOWN
ORACLES["hull_swing"] = swing_series(_HULL, 36, True) + _SHOWN
ORACLES["swing_signals"] = swing_series([_SWING], 18, False) + "SELECT symbol, i, dt, kind AS type, CASE WHEN abs(v) = 0.5 THEN 'swing crossover' WHEN v > 0 THEN 'confirmed bull trend' ELSE 'confirmed bear trend' END || ' (4-9-18)' AS value FROM g3 WHERE kind IS NOT NULL"

# volume: one side is carried through the averages of 10, 20 and 40 rows
_SIDES = " UNION ALL ".join(f"SELECT symbol, i, dt, {n} AS k, CASE WHEN obv > s{n} THEN 1 WHEN obv < s{n} THEN -1 END AS sg FROM {{last}}" for n in (10, 20, 40))
ORACLES["obv_signals"] = chain(
    *_OBV, {f"s{n}": sma("obv", n) for n in (10, 20, 40)}, {"d": f"obv - s20"}, {"spike": f"CASE WHEN abs(d) > max(abs(d)) OVER ({P}) / 2.5 THEN d ELSE 0.0 END"},
    out=f"SELECT symbol, i, dt, CASE WHEN sg > 0 THEN 'bullish' ELSE 'bearish' END AS type, 'obv crossover (' || k || 'd)' AS value FROM (SELECT *, last_value(sg IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY k, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM ({_SIDES})) WHERE sg <> held UNION ALL SELECT symbol, i, dt, 'bullish', 'significant spike: ' || CAST(trunc(spike) AS BIGINT) FROM {{last}} WHERE spike > 0",
)
_DEMAND = [
    {"v": f"CASE WHEN i > 0 THEN greatest(high, {lag('high')}) - least(low, {lag('low')}) ELSE 0.0 END"}, {"a": sma("v", 10)}, {"k": "coalesce(3.0 * close / nullif(a, 0), 0.0)"}, {"p": "(close - open) / nullif(open, 0) * k"},
    {"b": "CASE WHEN p = 0 THEN 0.0 WHEN p > 0 THEN volume ELSE volume / p END", "s": "CASE WHEN p = 0 THEN 0.0 WHEN p > 0 THEN volume / p ELSE volume END"}, {"x": "coalesce(CASE WHEN abs(b) > abs(s) THEN s / nullif(b, 0) ELSE b / nullif(s, 0) END, 0.0)"},
    {"l": so_far("x")}, {"di": f"coalesce({ema('x', 'l', 10)}, 0.0)"}, {f"d{w}": f"coalesce({sma('di', w)}, 0.0)" for w in (3, 4, 5, 7, 10)} | {f"c{w}": f"coalesce({sma('close', w)}, 0.0)" for w in (3, 4, 5, 7, 10)},
]


def turned(x: str, line: str) -> list[str]:
    """The side of x to line, the first one down unless it is above; and where it changes."""
    side_now = f"CASE WHEN {x} > {line} THEN 1 WHEN i = 0 OR {x} < {line} THEN -1 END"
    return [side_now, f"CASE WHEN {{c}} <> last_value({{c}} IGNORE NULLS) OVER ({O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN {{c}} END"]


_TURNS = {"z": ("di", "0.0")} | {f"td{w}": ("di", f"d{w}") for w in (3, 4, 5, 7, 10)} | {f"tc{w}": ("close", f"c{w}") for w in (3, 4, 5, 7, 10)}
_NAMED = "CASE WHEN {t} > 0 THEN 'bullish' ELSE 'bearish' END"
ORACLES["demand_signals"] = chain(
    *_DEMAND, {k: turned(*xy)[0] for k, xy in _TURNS.items()}, {f"{k}_t": turned(*xy)[1].replace("{c}", k) for k, xy in _TURNS.items()},
    {f"q{w}": f"close - c{w}" for w in (5, 10)}, {f"first{w}": f"first_value(q{w}) OVER ({O})" for w in (5, 10)},
    {f"held{w}": f"coalesce(last_value(CASE WHEN td{w}_t IS NOT NULL THEN q{w} END IGNORE NULLS) OVER ({O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first{w})" for w in (5, 10)},
    out=" UNION ALL ".join(
        [f"SELECT symbol, i, dt, {_NAMED.format(t='z_t')} AS type, 'zero crossover' AS value FROM {{last}} WHERE z_t IS NOT NULL"]
        + [f"SELECT symbol, i, dt, {_NAMED.format(t=f'td{w}_t')}, 'dual-signal-line {w}d divergence' FROM {{last}} WHERE td{w}_t * tc{w}_t < 0" for w in (3, 4, 5, 7, 10)]
        + [f"SELECT symbol, i, dt, {_NAMED.format(t=f'-td{w}_t')}, 'signal-line zone {w}d divergence' FROM {{last}} WHERE td{w}_t * held{w} > 0 AND td{w}_t * q{w} > 0" for w in (5, 10)]
    ),
)
_MOMENTUM = [{"d": f"coalesce(close - {lag('close')}, 0.0)"}, {"u": over("sum(greatest(d, 0.0))", -18, -1), "w": over("sum(greatest(-d, 0.0))", -18, -1)}, {"momentum": "coalesce(CASE WHEN i < 19 THEN 0.0 ELSE (u - w) / nullif(u + w, 0) * 100.0 END, 0.0)"}]
ORACLES["momentum_signals"] = recursive(
    _MOMENTUM, ["src AS (SELECT symbol, i, momentum AS x FROM base)", zigzag("z", "src", 0.0).replace("abs(a) * 0.0", "10.0"), f"ends AS (SELECT z.symbol, CAST(z.was_place AS BIGINT) AS i, z.was AS v, z.kind, b.close FROM z JOIN base b ON b.symbol = z.symbol AND b.i = CAST(z.was_place AS BIGINT) WHERE z.kind IS NOT NULL)",
    "pairs AS (SELECT *, lag(v) OVER w AS v0, lag(close) OVER w AS c0 FROM ends WINDOW w AS (PARTITION BY symbol, kind ORDER BY i))"],
    "SELECT symbol, i, CASE WHEN kind = 'max' THEN 'bearish' ELSE 'bullish' END AS type, 'divergence' AS value, 1.0 AS score FROM pairs WHERE CASE WHEN kind = 'max' THEN v < v0 AND close > c0 ELSE v > v0 AND close < c0 END", _EVENTS,
)

# the last ten rows of every indicator
_ALL = {
    "average": "ma_crossovers", "exponential_average": "ema_crossovers", "swing": "swing_signals", "parabolic_sar": "psar_signals", "stochastic": "stochastic_signals", "rsi": "rsi_signals", "ultimate": "ultimate_signals", "macd": "macd_signals", "awesome": "awesome_signals",
    "rate_of_change": "roc_signals", "know_sure_thing": "kst_signals", "commodity_channel": "cci_signals", "bear_bull": "bear_bull_signals", "total_power": "total_power_signals", "bollinger": "bollinger_signals", "true_range": "atr_signals", "directional": "adx_signals",
    "balance_volume": "obv_signals", "demand": "demand_signals",
}
_EACH = {k: ORACLES[q] for k, q in _ALL.items()} | {"candlesticks": ORACLES["candle_signals"].replace(LINES, raw_bars()), "momentum": ORACLES["momentum_signals"].replace("10.0 OR", "40.0 OR").replace("+ 10.0", "+ 40.0").replace("- 10.0", "- 40.0")}
ORACLES["last_signals"] = "WITH found AS (" + " UNION ALL ".join(f"SELECT symbol, i, dt, type, value, '{k}' AS indicator FROM ({q})" for k, q in _EACH.items()) + f"""),
lasts AS (SELECT symbol, count(*) - 1 AS last_i FROM ({raw_bars()}) GROUP BY 1)
SELECT f.symbol, indicator, i, dt, type, value, last_i - i AS days_ago FROM found f JOIN lasts l ON l.symbol = f.symbol WHERE i >= last_i - 10"""

# savers
_SAVED = "CASE WHEN g = 0 THEN pay * {n} ELSE pay * (pow(g + 1.0, {n}) - 1.0) / g END"
_SAVERS = "SELECT c_custkey AS scenario, c_custkey % 10 / 100.0 / 12.0 AS g, (c_custkey % 10 * 1000.0 + 5000.0) / 12.0 AS pay, unnest(range(1, 61)) AS month FROM customer"
ORACLES["contribution_race"] = f"SELECT scenario, month, round(({_SAVED.format(n='least(month, 24)')}) * pow(g + 1.0, greatest(month - 24, 0)), 2) + 0.0 AS early, round({_SAVED.format(n='greatest(month - 24, 0)')}, 2) + 0.0 AS late FROM (SELECT scenario, month, g::DOUBLE AS g, pay::DOUBLE AS pay FROM ({_SAVERS}))"
ORACLES["price_race"] = chain(out="SELECT symbol, count(*) AS n_rows, round(coalesce(sum(500.0 / close) FILTER (WHERE i < 24), 0.0) * max_by(close, i), 1) + 0.0 AS early, round(coalesce(sum(500.0 / close) FILTER (WHERE i >= 24), 0.0) * max_by(close, i), 1) + 0.0 AS late FROM {last} GROUP BY 1", source=NATION)

# clusters: the events of each member in turn are piled up, one by one, on a list with a cell for each row
_SPEEDS = {"stochastic": {"fast": (10, 3, 3), "medium": (14, 3, 3), "slow": (20, 5, 5)}, "ultimate": {"fast": (4, 8, 16), "medium": (7, 14, 28), "slow": (10, 20, 40)}, "rsi": {"fast": 8, "medium": 14, "slow": 20}}
_WHOLE = {"stochastic": (1, 2, 1), "rsi": (1, 3, 2), "ultimate": (3, 7, 4)}
_CLUSTERS = {"full_stochastic": ["stochastic"], "ultimate": ["ultimate"], "rsi": ["rsi"], "all": ["stochastic", "ultimate", "rsi"], "market": ["stochastic", "ultimate", "rsi"]}


def _member(kind: str, speed: str, tag: str, n: object) -> tuple[list[dict[str, str]], list[str], str]:
    """Stages that make a member's series, its machines, and its events: symbol, i, sign and o, their order."""
    source = lambda columns: f"src_{tag} AS MATERIALIZED (SELECT symbol, i, c, p, {columns} FROM base)"
    signed = lambda t, o: f"SELECT symbol, i, CASE WHEN kind = 'bullish' THEN 1 ELSE -1 END AS sign, {o} + i AS o FROM {t} WHERE kind IS NOT NULL"
    if kind == "stochastic":
        k, smooth, slow = n  # type: ignore[misc]
        low, high = over("min(low)", 1 - k, 0), over("max(high)", 1 - k, 0)
        flat = lambda x: f"CASE WHEN i < {k - 1} THEN 50.0 ELSE {x} END"
        stages = [{f"{tag}f": flat(f"coalesce((close - {low}) / nullif({high} - {low}, 0) * 100.0, 50.0)")}, {f"{tag}s": flat(over(f"avg({tag}f)", 1 - smooth, 0))}, {f"{tag}d": flat(over(f"avg({tag}s)", 1 - slow, 0))}]
        parts = [f"x_{tag} AS MATERIALIZED (SELECT symbol, i, {tag}f AS x, {tag}s AS y FROM base)", zone_crossing(f"zx_{tag}", f"x_{tag}"), f"y_{tag} AS MATERIALIZED (SELECT symbol, i, {tag}s AS x, {tag}d AS y FROM base)", zone_crossing(f"zy_{tag}", f"y_{tag}"), source(f"{tag}s AS x"), zone_divergence(f"zd_{tag}", f"src_{tag}")]
        return stages, parts, " UNION ALL ".join([signed(f"zx_{tag}", "0"), signed(f"zy_{tag}", "1000000"), signed(f"zd_{tag}", "2000000")])
    if kind == "rsi":
        limits = [{f"{tag}t": f"0.45 * ({slope('close', n * 3)}) + 0.33 * ({slope('close', int(n * 5.5))}) + 0.22 * ({slope('close', n * 8)})"}, {f"{tag}z": scaled(f"{tag}t")}]
        zones = {f"{tag}lo": f"CASE WHEN {tag}z > 0.1 THEN 40.0 - 10.0 * exp(-15.0 * ({tag}z - 0.1)) ELSE 30.0 END", f"{tag}hi": f"CASE WHEN {tag}z < -0.1 THEN 60.0 + 10.0 * exp(15.0 * ({tag}z + 0.1)) ELSE 70.0 END"}
        means = {f"{tag}{a}{j}": f"round_even({over(f'sum({a})', -n - j, -1 - j)} / {n}, 6)" for a in "gw" for j in (0, 1)}
        rs = f"CASE WHEN i = {n} THEN {tag}g0 / nullif({tag}w0, 0) WHEN {tag}w1 <> 0 THEN (({tag}g1 * {n - 1} + g) / {n}.0) / nullif(({tag}w1 * {n - 1} + w) / {n}.0, 0) END"
        stages = [means, {f"{tag}q": rs}, {f"{tag}r": f"CASE WHEN i < {n} THEN 50.0 ELSE coalesce(round_even(100.0 - 100.0 / (1.0 + {tag}q), 6), 100.0) END"}, *limits, zones]
        return stages, [source(f"{tag}r AS x, {tag}lo AS lo, {tag}hi AS hi"), rejection(f"rej_{tag}", f"src_{tag}"), zone_turns(f"turn_{tag}", f"src_{tag}")], signed(f"rej_{tag}", "0") + " UNION ALL " + signed(f"turn_{tag}", "1000000")
    a, b, c = n  # type: ignore[misc]
    parts = [
        source(f"{tag}u AS x"), swings(f"swing_{tag}", f"src_{tag}"), lows(f"low_{tag}", f"src_{tag}"), f"final_{tag} AS (SELECT symbol, z, d, max_by(low, i) AS low FROM low_{tag} GROUP BY 1, 2, 3)",
        f"held_{tag} AS (SELECT f.*, max(f.d * s.x) AS barrier, max(CASE WHEN s.i = f.z THEN s.x END) AS own, max(CASE WHEN s.i = f.low THEN s.x END) AS there FROM final_{tag} f JOIN src_{tag} s ON s.symbol = f.symbol AND s.i BETWEEN f.z AND f.low GROUP BY ALL)",
        f"broken_{tag} AS (SELECT h.symbol, h.z, h.d, min(s.i) AS i FROM held_{tag} h JOIN src_{tag} s ON s.symbol = h.symbol AND s.i >= h.low AND h.d * s.x > h.barrier WHERE h.d * (h.there - h.own) > 0 GROUP BY 1, 2, 3)",
        f"every_{tag} AS (SELECT symbol, i, d AS sign, z AS o FROM broken_{tag} UNION ALL {signed(f'swing_{tag}', '1000000')})",
    ]
    # a row's first event counts, where its last one stands
    return [{f"{tag}u": f"CASE WHEN i < {c - 1} THEN 50.0 ELSE 100.0 * (4.0 * ({_RATIO(a)}) + 2.0 * ({_RATIO(b)}) + ({_RATIO(c)})) / 7.0 END"}], parts, f"SELECT symbol, i, arg_min(sign, o) AS sign, max(o) AS o FROM every_{tag} GROUP BY 1, 2"


def clusters(function: str, out: str, source: str | None = None) -> str:
    """cells(symbol, i, n, dt, close, clustered), then out."""
    speeds = ("medium",) if function == "market" else ("fast", "medium", "slow")
    stages: list = [{"pc": lag("close")}, {"bp": _ULTIMATE[1]["bp"], "tr": _ULTIMATE[1]["tr"], "d": f"round({CHANGE}, 6)"}, {"g": "greatest(d, 0.0)", "w": "greatest(-d, 0.0)"}, _TREND, {"calm": f"abs({scaled('t')}) <= 0.1"}]
    parts, events = [], []
    for m, (kind, speed) in enumerate((k, x) for k in _CLUSTERS[function] for x in speeds):
        n = (5, 10, 20) if (function, kind, speed) == ("all", "ultimate", "fast") else _SPEEDS[kind][speed]
        more, tables, found = _member(kind, speed, f"{kind[0]}{speed[0]}_", n)
        stages, parts = stages + more, parts + tables
        weight = {"stochastic": "CAST(b.calm AS INTEGER)", "rsi": "CAST(NOT b.calm AS INTEGER)", "ultimate": "0"}[kind]
        whole_weight = _WHOLE[kind][("fast", "medium", "slow").index(speed)]
        events.append(f"SELECT e.symbol, e.i, e.sign, {whole_weight} + {weight} AS weight, {m} * 100000000 + e.o AS o FROM ({found}) e JOIN base b ON b.symbol = e.symbol AND b.i = e.i")
    head = chain(*stages, {"p": lag("close")}, out=", base AS (SELECT *, close AS c FROM {last})", source=source).replace("\n, base", ",\nbase").replace("WITH ", "WITH RECURSIVE ", 1)
    near = " ".join(f"WHEN v <> 0 AND (k - 1 = e.i + {k} OR k - 1 = CASE WHEN e.i < {k} THEN e.i - {k} + p.n ELSE e.i - {k} END) THEN v + e.sign * {share} * e.weight" for k, share in ((1, 5.0), (2, 3.0), (3, 2.0)))
    piled = f"list_transform(p.cell, lambda v, k: CASE WHEN k - 1 = e.i THEN v + e.sign * CASE WHEN v <> 0 THEN 8.0 * e.weight ELSE 1.0 END {near} ELSE v END)"
    return f"""{head},\n{(","+chr(10)).join(parts)},
events AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY o) AS q FROM ({' UNION ALL '.join(events)})),
pile AS (SELECT symbol, CAST(0 AS BIGINT) AS q, max(n) AS n, list_transform(range(0, max(n)), lambda x: 0.0::DOUBLE) AS cell FROM base GROUP BY 1 UNION ALL SELECT p.symbol, p.q + 1, p.n, {piled} FROM pile p JOIN events e ON e.symbol = p.symbol AND e.q = p.q + 1),
done AS (SELECT symbol, arg_max(cell, q) AS cell FROM pile GROUP BY 1),
cells AS (SELECT b.symbol, b.i, b.n, b.dt, b.close, d.cell[b.i + 1] AS clustered FROM base b JOIN done d ON d.symbol = b.symbol)
{out}"""


for _f in _CLUSTERS:
    ORACLES[f"cluster_{_f}"] = clusters(_f, "SELECT symbol, i, round(clustered, 4) + 0.0 AS clustered FROM cells")
ORACLES["cluster_dates"] = clusters("all", "SELECT symbol, i, dt, round(close, 4) + 0.0 AS close, round(clustered, 4) + 0.0 AS clustered FROM cells WHERE clustered <> 0")
ORACLES["cluster_metric"] = clusters(
    "all", f", q1 AS (SELECT *, {spread('clustered', (1.0, 0.85, 0.55, 0.1))} AS y FROM cells), q2 AS (SELECT *, {so_far('y')} AS l FROM q1), q3 AS (SELECT *, {ema('y', 'l', 7)} AS e FROM q2) SELECT symbol, i, round({largest('e')}, 4) + 0.0 AS metric FROM q3"
).replace("\n, q1", ",\nq1")
ORACLES["cluster_signals"] = clusters(
    "all",
    f""", q1 AS (SELECT *, {so_far('clustered')} AS l FROM cells), q2 AS (SELECT *, nullif({ema('clustered', 'l', 3)}, 0) AS e FROM q1), q3 AS (SELECT *, quantile_cont(e, 0.9) OVER ({P}) AS top, quantile_cont(e, 0.1) OVER ({P}) AS low FROM q2)
SELECT symbol, i, dt, CASE WHEN e > top THEN 'bullish' ELSE 'bearish' END AS type, CAST(round(e, 2) + 0.0 AS VARCHAR) AS value FROM q3 WHERE e > top OR e < low""",
).replace("\n, q1", ",\nq1")
ORACLES["mci"] = clusters(
    "market",
    """, sums AS (SELECT dt, sum(clustered) AS x FROM cells GROUP BY 1), placed AS (SELECT *, row_number() OVER (ORDER BY dt) - 1 AS i, count(*) OVER () AS n FROM sums),
smooth AS (SELECT *, CASE WHEN i >= 1 AND i < n - 1 THEN avg(x) OVER (ORDER BY i ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) ELSE x END AS y FROM placed)
SELECT i, dt, round(CASE WHEN max(abs(y)) OVER () > 0 THEN y / max(abs(y)) OVER () ELSE y END, 4) + 0.0 AS composite FROM smooth""",
    NATION,
).replace("\n, sums", ",\nsums")
ORACLES["tci"] = clusters(
    "all",
    """, sums AS (SELECT r_name AS name, dt, sum(clustered * 0.2) AS x FROM cells JOIN nation ON symbol = CAST(n_nationkey AS VARCHAR) JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
SELECT name, dt, round(CASE WHEN max(abs(x)) OVER (PARTITION BY name) > 0 THEN x / max(abs(x)) OVER (PARTITION BY name) ELSE x END, 4) + 0.0 AS cluster FROM sums""",
    NATION,
).replace("\n, sums", ",\nsums")

# returns against benchmarks
_YEAR = {"y": "CASE WHEN n <= 250 THEN 200 ELSE 250 END", "k": "n - i"}
_AT = {f"a{k}": f"max(CASE WHEN k = {k} THEN close END) OVER ({P})" for k in (1, 62, 63, 125, 126, 187, 188, 250)} | {"old": f"max(CASE WHEN k = y THEN close END) OVER ({P})", "was": f"CASE WHEN y = 200 THEN {lag('close', 200)} ELSE {lag('close', 250)} END"}
_GAIN = lambda a, b: f"coalesce(({a} - {b}) / nullif({b}, 0) * 100.0, 0.0)"
_RETURNED = f"SELECT symbol, (max({_GAIN('a1', 'old')}) + max({' + '.join(_GAIN(f'a{a}', f'a{b}') for a, b in ((1, 62), (63, 125), (126, 187), (188, 250)))})) / 2.0 AS annual_return, coalesce(stddev_pop(CASE WHEN i > 0 AND i % y = 0 THEN (close - was) / nullif(was, 0) * 100.0 END), 0.0) / 2.0 AS deviation FROM {{last}} GROUP BY 1"
ORACLES["annual_returns"] = chain(_YEAR, _AT, _RETURNED, out="SELECT symbol, round(annual_return, 4) + 0.0 AS annual_return, round(deviation, 4) + 0.0 AS deviation FROM {last}")
_SPREAD_OF = f"SELECT symbol, stddev_pop(r) AS dev FROM (SELECT symbol, coalesce((close - {lag('close')}) / nullif({lag('close')}, 0), 0.0) AS r FROM (SELECT * FROM {{last}} WHERE i >= n - 250)) GROUP BY 1"
_PART = lambda name, stage, source=None: f"{name} AS ({chain(*stage, out='SELECT * FROM {last}', source=source)})"
_RISK = ",\n".join([_PART("own", [_YEAR, _AT, _RETURNED]), _PART("all_market", [_YEAR, _AT, _RETURNED], MARKET), _PART("own_spread", [_SPREAD_OF]), _PART("market_spread", [_SPREAD_OF], MARKET)])
_BETA = chain(*_BOTH, more=_MKT, out="SELECT symbol, regr_slope(ret, market_ret) AS b, regr_r2(ret, market_ret) AS r2 FROM {last} GROUP BY 1")
ORACLES["risk_ratios"] = f"""WITH {_RISK}, slopes AS ({_BETA}),
one AS (SELECT o.symbol, o.annual_return AS a, o.deviation AS d, round_even(b, 4) AS beta, round_even(r2, 4) AS r_squared, m.annual_return AS ma, m.deviation AS md, s.dev / nullif(t.dev, 0) AS ratio FROM own o JOIN slopes x ON x.symbol = o.symbol JOIN own_spread s ON s.symbol = o.symbol CROSS JOIN all_market m CROSS JOIN market_spread t),
two AS (SELECT *, round_even((a - 2.5) / nullif(d, 0), 4) AS sharpe, round_even((ma - 2.5) / nullif(md, 0), 4) AS ms FROM one)
SELECT symbol, round(round_even(a - 2.5 - beta * (ma - 2.5), 4), 4) + 0.0 AS alpha, round(beta, 4) + 0.0 AS beta, round(r_squared, 4) + 0.0 AS r_squared, round(sharpe, 4) + 0.0 AS sharpe, round(round_even(sharpe / nullif(ms, 0), 4), 4) + 0.0 AS market_sharpe,
    round(round_even(d, 4), 4) + 0.0 AS standard_deviation, round(round_even(ratio, 4), 4) + 0.0 AS standard_dev_ratio FROM two"""
ORACLES["relative_strength"] = f"""WITH {_BARS}, bench AS (SELECT 'market' AS benchmark, dt, close AS m FROM ({MARKET}) UNION ALL SELECT 'peer', dt, close FROM bars WHERE symbol = '5-LOW'),
met AS (SELECT symbol, i, b.dt, benchmark, close / nullif(m, 0) AS q FROM bars b JOIN bench ON bench.dt = b.dt), based AS (SELECT *, round_even(first_value(q) OVER (PARTITION BY symbol, benchmark ORDER BY i), 6) AS q0 FROM met)
SELECT symbol, i, dt, benchmark, round(round_even(q / nullif(q0, 0) - 1.0, 6), 6) + 0.0 AS ratio FROM based"""

# bought once, dividends into shares one after the other
ORACLES["buy_hold"] = f"""WITH RECURSIVE {_BARS},
paid AS (SELECT symbol, i, close, round_even(round(close * 0.01, 6), 2) AS d, row_number() OVER ({O}) AS q FROM bars WHERE i % 13 = 6),
bought AS (SELECT symbol, floor(10000000.0 / arg_min(close, i)) AS s0, arg_min(close, i) AS c0, arg_max(close, i) AS last FROM bars GROUP BY 1),
held AS (SELECT symbol, CAST(0 AS BIGINT) AS q, s0::DOUBLE AS shares FROM bought UNION ALL SELECT h.symbol, p.q, round(h.shares * (p.d / p.close + 1.0), 3) FROM held h JOIN paid p ON p.symbol = h.symbol AND p.q = h.q + 1)
SELECT b.symbol, s0::DOUBLE AS init_shares, round(10000000.0 - s0 * c0, 2) AS cash, h.shares AS final_shares, round(last * h.shares + round(10000000.0 - s0 * c0, 2), 2) AS final_amount FROM bought b JOIN (SELECT symbol, arg_max(shares, q) AS shares FROM held GROUP BY 1) h ON h.symbol = b.symbol"""

# score series of the rate of change
_ROC_WEIGHT = {10: 0.65, 20: 1.0, 40: 0.4}
_ROC_M = [f"s{n} AS (SELECT symbol, i, roc_{n} AS x, quantile_cont(roc_{n}, 0.9) OVER (PARTITION BY symbol) AS hi, quantile_cont(roc_{n}, 0.1) OVER (PARTITION BY symbol) AS lo FROM base), {zone_exit(f'm{n}', f's{n}')}" for n in (10, 20, 40)]
_ROC_F = " UNION ALL ".join([told(f"m{n}", "exit", w) for n, w in _ROC_WEIGHT.items()] + [sign_changes(f"roc_{n}", "zero", 0.75 * w) for n, w in _ROC_WEIGHT.items()])
ORACLES["roc_metric"] = recursive([_ROC], _ROC_M, _ROC_F, f""", q0 AS (SELECT symbol, i, n, coalesce(score, 0.0) AS x FROM base LEFT JOIN (SELECT symbol, i, sum(score) AS score FROM found GROUP BY 1, 2) USING (symbol, i)),
    q2 AS (SELECT *, {so_far("x")} AS l FROM q0), q3 AS (SELECT *, {ema("x", "l", 7)} AS e FROM q2) SELECT symbol, i, round({largest("e")}, 4) + 0.0 AS metric FROM q3""").replace("\n, q0", ",\nq0")

# series against series by row, and symbols against the funds of their sectors
_SMA_OF = lambda source: chain({"x": sma("close", 20)}, {"ret": f"coalesce((x - {lag('x')}) / nullif({lag('x')}, 0) * 100.0, 0.0)"}, out="SELECT symbol, i, ret FROM {last}", source=source)
ORACLES["beta_lists"] = f"WITH a AS ({_SMA_OF(raw_bars())}), m AS ({_SMA_OF(MARKET)}) SELECT a.symbol, round(regr_slope(a.ret, m.ret), 4) + 0.0 AS beta, round(regr_r2(a.ret, m.ret), 4) + 0.0 AS r_squared FROM a JOIN m ON m.i = a.i GROUP BY 1"
_PLACED = "placed AS (SELECT n_nationkey AS k, r_name, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS place FROM nation JOIN region ON n_regionkey = r_regionkey)"
ORACLES["sector_funds"] = f"""WITH {_PLACED} SELECT CAST(a.k AS VARCHAR) AS symbol, lower(a.r_name) AS sector, CAST(max(CASE WHEN b.place = 1 THEN b.k END) AS VARCHAR) AS etf, string_agg(CASE WHEN b.place BETWEEN 2 AND 4 AND b.k <> a.k THEN CAST(b.k AS VARCHAR) END, ',' ORDER BY b.place) AS peers
FROM placed a JOIN placed b ON a.r_name = b.r_name GROUP BY 1, 2"""
ORACLES["sector_strength"] = f"""WITH {numbered("bars", NATION)}, {_PLACED},
pairs AS (SELECT CAST(a.k AS VARCHAR) AS symbol, CASE WHEN b.place = 1 THEN 'sector' ELSE 'peer' END AS kind, CAST(b.k AS VARCHAR) AS fund FROM placed a JOIN placed b ON a.r_name = b.r_name AND b.place <= 4 AND a.k <> b.k),
met AS (SELECT p.symbol, kind, fund, b.i, b.dt, b.close / nullif(f.close, 0) AS q FROM pairs p JOIN bars b ON b.symbol = p.symbol JOIN bars f ON f.symbol = p.fund AND f.dt = b.dt),
based AS (SELECT *, round_even(first_value(q) OVER (PARTITION BY symbol, kind, fund ORDER BY i), 6) AS q0 FROM met)
SELECT symbol, kind, fund, i, dt, round(round_even(q / nullif(q0, 0) - 1.0, 6), 6) + 0.0 AS ratio FROM based"""
