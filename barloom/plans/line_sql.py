"""DuckDB SQL of extrema and of trend lines, written from their description and apart from the operators. Sets of points that shrink
from fit to fit are recursive: the rows of a step carry the line fitted to them, and the next step has those beyond it.

All parts are tables of one WITH RECURSIVE; ``bars`` (symbol, i, n, dt, close, volume) comes first.
"""

from __future__ import annotations


def shown(*names: str) -> str:
    """Columns rounded to one digit. Fits of prices lie between two of these often, so that the noise of sums is rounded off before."""
    return ", ".join(f"round(round({c}, 6), 1) + 0.0 AS {c}" for c in names)


def fit(parts: str = "") -> str:
    """Slope and intercept of y over x; what rises by next to nothing is level. parts: of a window, else of a group."""
    over = f" OVER (PARTITION BY {parts})" if parts else ""
    line = f"regr_slope(y, x){over}"
    return f"CASE WHEN abs({line}) * (max(x){over} - min(x){over}) <= 1e-9 * abs(avg(y){over}) THEN 0.0 ELSE {line} END AS slope, regr_intercept(y, x){over} AS intercept, count(*){over} AS size"


def extrema(sizes: dict[int, float | None], name: str = "ext") -> str:
    """name(symbol, size, seq, i, value, kind, volume): extrema through centred averages, exponential where there is a strength."""
    parts = []
    for size, strength in sizes.items():
        h = size // 2
        total = f"sum(close) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN {h} PRECEDING AND {max(h - 1, 0)} FOLLOWING)"
        if h == 0:
            f = "close"
        elif strength is None:
            f = f"{total} / {2 * h}.0"
        else:
            w = min(strength / (size + 1), 1.0)
            f = f"close * {w!r} + ({total} - close) / {2 * h - 1}.0 * {1 - w!r}"
        parts.append(f"SELECT symbol, {size} AS size, {h} AS h, i, n, CASE WHEN i >= {h} AND i < n - {h} THEN {f} ELSE close END AS f FROM bars WHERE n > {size + 3}" if h else f"SELECT symbol, {size} AS size, 0 AS h, i, n, close AS f FROM bars WHERE n > {size + 3}")
    w = "(PARTITION BY symbol, size ORDER BY i)"
    return f"""{name}_f AS ({' UNION ALL '.join(parts)}),
{name}_s AS (SELECT *, CASE WHEN i = 1 THEN CASE WHEN f > lag(f) OVER {w} THEN 1 ELSE -1 END WHEN f > lag(f) OVER {w} THEN 1 WHEN f < lag(f) OVER {w} THEN -1 END AS s FROM {name}_f),
{name}_d AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY symbol, size ORDER BY i ROWS UNBOUNDED PRECEDING) AS d FROM {name}_s),
{name}_t AS (SELECT symbol, size, h, i, CASE WHEN d > 0 THEN 'max' ELSE 'min' END AS kind FROM (SELECT *, lead(d) OVER {w} AS e FROM {name}_d) WHERE d <> e),
{name} AS (SELECT t.symbol, t.size, row_number() OVER (PARTITION BY t.symbol, t.size, t.kind ORDER BY t.i) AS seq, b.i, b.close AS value, t.kind, b.volume FROM {name}_t t JOIN bars b ON b.symbol = t.symbol AND b.i BETWEEN t.i - t.h AND t.i + greatest(t.h, 1) - 1
    QUALIFY row_number() OVER (PARTITION BY t.symbol, t.size, t.kind, t.i ORDER BY CASE WHEN t.kind = 'max' THEN -b.close ELSE b.close END, b.i) = 1)"""


EXTREMA = "WITH RECURSIVE {bars},\n" + extrema({8: 2.0}) + "\nSELECT DISTINCT symbol, i, round(value, 4) + 0.0 AS value, kind FROM ext"


def head_and_shoulders(sizes: list[int], columns: str) -> str:
    """Six extrema in a row as a head between shoulders."""
    lags = ", ".join(f"lag({c}, {5 - k}) OVER w AS {name}{k}" for k in range(6) for c, name in (("i", "x"), ("value", "v"), ("volume", "u")))
    mean = "(v0 + v1 + v2 + v3 + v4 + v5) / 6.0"
    sd = f"sqrt(({' + '.join(f'(v{k} - m) * (v{k} - m)' for k in range(6))}) / 6.0)"
    return f"""WITH RECURSIVE {{bars}},
{extrema(dict.fromkeys(sizes))},
kept AS (SELECT *, lag(value) OVER (PARTITION BY symbol, size, kind ORDER BY seq) AS was FROM ext QUALIFY value > was * 1.01 OR value < was * 0.99),
six AS (SELECT symbol, size, {lags} FROM kept WINDOW w AS (PARTITION BY symbol, size ORDER BY i, kind DESC, seq)),
line AS (SELECT *, (v3 - v1) / (x3 - x1) AS slope, {mean} AS m FROM six WHERE x0 IS NOT NULL AND x3 <> x1),
dev AS (SELECT *, {sd} AS sd, v1 - slope * x1 AS intercept FROM line),
found AS (SELECT *, CASE WHEN v0 > v1 AND v2 > v0 AND v4 < v2 AND v4 > v3 AND u4 < u0 AND v5 < intercept + slope * x5 THEN 'bearish'
    WHEN v0 <= v1 AND v2 < v0 AND v4 > v2 AND v4 < v3 AND u3 > u0 AND v5 > intercept + slope * x5 AND u5 > u3 THEN 'bullish' END AS type FROM dev)
SELECT symbol, {columns}type, x0 AS first_i, x5 AS last_i, x4 - x0 AS width, round(slope, 4) + 0.0 AS slope, round(intercept, 4) + 0.0 AS intercept, round(m, 3) + 0.0 AS avg, round(sd, 3) + 0.0 AS stdev, round(sd * 100.0 / m, 3) + 0.0 AS percent FROM found WHERE type IS NOT NULL"""


def trend_lines(sizes: tuple[int, ...], windows: dict[str, str], band: float = 0.06) -> str:
    """lines(symbol, term, slope, intercept, start_i, end_i, ...). windows: the rows of each term's blocks, as SQL over n."""
    terms = " UNION ALL ".join(f"SELECT symbol, '{t}' AS term, CAST({w} AS BIGINT) AS w, n FROM (SELECT DISTINCT symbol, n FROM bars)" for t, w in windows.items())
    again = fit("symbol, term, start_i")
    return f"""{extrema({n: 2.0 + 0.1 * k for k, n in enumerate(sizes)})},
points AS (SELECT DISTINCT symbol, i, value, kind FROM (SELECT *, coalesce(lag(i) OVER (PARTITION BY symbol, size, kind ORDER BY seq), 0) AS was FROM ext) WHERE i <> was),
terms AS ({terms}),
blocks AS (SELECT symbol, term, w, start_i, {fit()} FROM (SELECT b.symbol, term, w, b.i // w * w AS start_i, b.i AS x, close AS y FROM bars b JOIN terms t ON t.symbol = b.symbol AND w > 1 AND b.i < t.n // w * w) GROUP BY 1, 2, 3, 4),
shrink AS (SELECT 0 AS step, symbol, term, start_i, sign, x, y, {again} FROM (SELECT b.symbol, term, start_i, CASE WHEN slope >= 0 THEN 1 ELSE -1 END AS sign, p.i AS x, p.value AS y FROM blocks b JOIN points p ON p.symbol = b.symbol AND p.i >= start_i AND p.i < start_i + w
        AND p.kind = CASE WHEN slope >= 0 THEN 'min' ELSE 'max' END WHERE slope <> 0)
    UNION ALL SELECT step + 1, symbol, term, start_i, sign, x, y, {again} FROM (SELECT * FROM shrink WHERE sign * slope > 0 AND step < 49 AND sign * (y - (slope * x + intercept)) < -1e-9 * abs(y))),
fitted AS (SELECT DISTINCT symbol, term, start_i, slope, intercept, size FROM shrink QUALIFY step = max(step) OVER (PARTITION BY symbol, term, start_i)),
candidates AS (SELECT b.symbol, b.term, b.w, b.start_i, CASE WHEN f.size IS NULL THEN b.slope WHEN f.size > 1 THEN f.slope END AS slope, CASE WHEN f.size IS NULL THEN b.intercept ELSE f.intercept END AS intercept FROM blocks b LEFT JOIN fitted f ON f.symbol = b.symbol AND f.term = b.term AND f.start_i = b.start_i),
stood AS (SELECT c.*, b.i, b.n, b.close, c.slope * b.i + c.intercept AS y, c.slope * (b.i + 1) + c.intercept AS y1 FROM candidates c JOIN bars b ON b.symbol = c.symbol WHERE c.slope IS NOT NULL),
reached AS (SELECT symbol, term, start_i, slope, intercept, max(n) AS n, coalesce(max(CASE WHEN i >= 1 AND y1 <= {1 + band!r} * close AND y1 >= {1 - band!r} * close THEN i + 1 END), 1) AS stop FROM stood GROUP BY 1, 2, 3, 4, 5
    HAVING count(CASE WHEN i >= start_i AND i < start_i + w - 1 AND CASE WHEN slope > 0 THEN close < y * 0.99 ELSE close > y * 1.01 END THEN 1 END) = 0),
lines AS (SELECT r.symbol, term, slope, intercept, start_i, stop - 1 AS end_i, a.dt AS start_dt, b.dt AS end_dt, stop - start_i AS length, CASE WHEN slope < 0 THEN 'bear' ELSE 'bull' END AS type, stop = r.n AS current
    FROM reached r JOIN bars a ON a.symbol = r.symbol AND a.i = start_i JOIN bars b ON b.symbol = r.symbol AND b.i = stop - 1 WHERE stop > start_i + 1)"""


# Sizes of the averages for head and shoulders.
SIZES = (0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 14, 16, 17, 19, 26, 35, 51)
WINDOWS = {"long": "163", "intermediate": "91", "short": "56", "near": "27"}
_LINES = "WITH RECURSIVE {bars},\n" + trend_lines((4, 8, 16, 32), WINDOWS)
_SHOWN = f"SELECT symbol, term, {shown('slope', 'intercept')}, start_i, end_i, start_dt, end_dt, length, type, current FROM lines"
_SIDES = """,
along AS (SELECT l.symbol, term, start_i, type, b.i, b.dt, close, abs(close - (slope * b.i + intercept)) <= 1e-9 * abs(slope * b.i + intercept) AS is_on, close > slope * b.i + intercept AS is_over FROM lines l JOIN bars b ON b.symbol = l.symbol AND b.i BETWEEN start_i AND end_i),
sides AS (SELECT *, is_on OR is_over AS up, coalesce(lag(is_on OR is_over) OVER (PARTITION BY symbol, term, start_i ORDER BY i), is_on OR is_over) AS was FROM along)"""
TREND_LINES = f"{_LINES}\n{_SHOWN}"
OBV_LINES = "WITH RECURSIVE {obv},\n" + trend_lines((0, 2, 4, 7), {"long": "3", "intermediate": "15", "short": "31", "near": "floor(n * 0.25)"}) + f"\n{_SHOWN}"
TREND_TOUCHES = (
    _LINES
    + _SIDES
    + """
SELECT symbol, term, start_i, i, dt, round(close, 4) + 0.0 AS price, 'cross' AS event, CASE WHEN up THEN 'above' ELSE 'below' END AS side FROM sides WHERE up <> was
UNION ALL SELECT symbol, term, start_i, i, dt, round(close, 4) + 0.0, 'touch', CASE WHEN was THEN 'above' ELSE 'below' END FROM sides WHERE is_on"""
)
TREND_PERIODS = (
    _LINES
    + _SIDES
    + """,
islands AS (SELECT *, i - row_number() OVER (PARTITION BY symbol, term, start_i, up ORDER BY i) AS island FROM sides),
periods AS (SELECT symbol, term, start_i, up = (any_value(type) = 'bull') AS good, min(i) AS first_i, max(i) AS last_i, min(dt) AS first_dt, max(dt) AS last_dt FROM islands GROUP BY symbol, term, start_i, up, island)
SELECT symbol, term, start_i, row_number() OVER (PARTITION BY symbol, term, start_i ORDER BY first_i) - 1 AS period, CASE WHEN good THEN 'valid' ELSE 'broken' END AS state, first_i, last_i, first_dt, last_dt FROM periods"""
)
TREND_FORECAST = (
    _LINES
    + """,
last AS (SELECT symbol, max_by(close, i) AS last FROM bars GROUP BY 1)
SELECT l.symbol, term, start_i, end_i, current, ahead, round(round_even(round(slope * (end_i + ahead) + intercept, 6), 2), 1) + 0.0 AS price, CASE WHEN last < round_even(round(slope * (end_i + 5) + intercept, 6), 2) THEN 'Below' ELSE 'Above' END AS state,
    CASE WHEN slope < 0 THEN 'DOWN' WHEN slope > 0 THEN 'UP' ELSE 'n/a' END AS direction FROM lines l JOIN last ON last.symbol = l.symbol CROSS JOIN (VALUES (5), (10), (20)) t(ahead)"""
)


def _span(lines: str, share: str, first: str = "0", last: str = "1e9") -> str:
    """Lines with the first and last row, from first to last, at which they are within share of the closes."""
    y, s = "(l.slope * b.i + l.intercept)", share
    return f"""SELECT l.*, min(b.i) OVER (PARTITION BY l.symbol, l.id) AS a, max(b.i) OVER (PARTITION BY l.symbol, l.id) AS z FROM {lines} l JOIN bars b ON b.symbol = l.symbol AND b.i BETWEEN {first} AND {last}
        AND CASE WHEN {y} < 0 THEN {y} BETWEEN (1 + {s}) * close AND (1 - {s}) * close ELSE {y} BETWEEN (1 - {s}) * close AND (1 + {s}) * close END QUALIFY row_number() OVER (PARTITION BY l.symbol, l.id ORDER BY b.i) = 1"""


_ANGLE = "degrees(atan(slope * scale)) + CASE WHEN slope < 0 THEN 180 ELSE 0 END"
_FIT = fit("symbol, part, side")
CHANNELS = f"""scales AS (SELECT symbol, n, CASE WHEN max(close) > min(close) THEN n / (max(close) - min(close)) ELSE 0 END AS scale FROM bars GROUP BY 1, 2),
divided AS (SELECT symbol, n, d, n // d AS period FROM scales CROSS JOIN (VALUES (1), (2), (4), (8)) t(d)),
cut AS (SELECT symbol, d, 0 AS slides, k, period * k AS a, CASE WHEN k = d - 1 THEN n ELSE period * (k + 1) END AS b FROM (SELECT *, unnest(range(0, d)) AS k FROM divided)
    UNION ALL SELECT symbol, d, 1, k, k - period, k FROM (SELECT *, unnest(range(period, n, 2)) AS k FROM divided)),
parts AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d, slides, k) AS part FROM cut),
shrink AS (SELECT 0 AS step, symbol, part, side, x, y, {_FIT} FROM (SELECT p.symbol, part, side, b.i AS x, close AS y FROM parts p JOIN bars b ON b.symbol = p.symbol AND b.i >= a AND b.i < p.b CROSS JOIN (VALUES (1), (-1)) t(side))
    UNION ALL SELECT step + 1, symbol, part, side, x, y, {_FIT} FROM (SELECT * FROM shrink WHERE size > 4 AND side * (y - (slope * x + intercept)) > 0)),
fitted AS (SELECT DISTINCT symbol, part, side, slope, intercept, size FROM shrink QUALIFY step = max(step) OVER (PARTITION BY symbol, part, side)),
raw AS (SELECT f.symbol, d, f.part * 2 - CASE WHEN side > 0 THEN 1 ELSE 0 END AS id, side, slope, intercept, {_ANGLE} AS angle, CASE WHEN slides = 1 THEN 0.1 ELSE 0.05 END AS share FROM fitted f JOIN parts p ON p.symbol = f.symbol AND p.part = f.part JOIN scales s ON s.symbol = f.symbol WHERE size BETWEEN 2 AND 4),
channels AS (SELECT symbol, d, id, side, slope, intercept, angle, a AS start_i, z AS end_i, 1 AS n_lines FROM ({_span('raw', 'l.share')}))"""


def _round(k: int, source: str, degrees: float) -> str:
    """Lines of source grouped by angle and intercept: group{k} with the columns of source."""
    low, high = 1 - degrees / 20, 1 + degrees / 20
    joins = f"m.angle0 + {degrees!r} > s.angle AND CASE WHEN m.intercept0 < 0 THEN {low!r} * m.intercept0 > {high!r} * s.intercept ELSE {high!r} * m.intercept0 > {low!r} * s.intercept END"
    return f"""sorted{k} AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY angle, id) AS r FROM {source}),
walk{k} AS (SELECT symbol, r, angle AS angle0, intercept AS intercept0, 1 AS g FROM sorted{k} WHERE r = 1
    UNION ALL SELECT s.symbol, s.r, CASE WHEN {joins} THEN m.angle0 ELSE s.angle END, CASE WHEN {joins} THEN m.intercept0 ELSE s.intercept END, CASE WHEN {joins} THEN m.g ELSE m.g + 1 END FROM walk{k} m JOIN sorted{k} s ON s.symbol = m.symbol AND s.r = m.r + 1),
mean{k} AS (SELECT symbol, g AS id, avg(slope) AS slope, avg(intercept) AS intercept, min(start_i) AS first, max(end_i) AS last, sum(n_lines) AS n_lines FROM walk{k} JOIN sorted{k} USING (symbol, r) GROUP BY 1, 2),
group{k} AS (SELECT x.symbol, id, slope, intercept, {_ANGLE} AS angle, a AS start_i, z AS end_i, n_lines FROM ({_span(f'mean{k}', '0.03', 'l.first', 'l.last')}) x JOIN scales s ON s.symbol = x.symbol WHERE z - a + 1 > 4)"""


_GROUPS = "WITH RECURSIVE {bars},\n" + ",\n".join([CHANNELS, _round(1, "channels", 2.5), _round(2, "group1", 0.2), _round(3, "group2", 0.3)])
CHANNEL_LINES = "WITH RECURSIVE {bars},\n" + CHANNELS + f"\nSELECT symbol, d AS divisor, CASE WHEN side > 0 THEN 'upper' ELSE 'lower' END AS side, {shown('slope', 'intercept', 'angle')}, start_i, end_i FROM channels"
LINE_GROUPS = _GROUPS + f"\nSELECT symbol, {shown('slope', 'intercept', 'angle')}, start_i, end_i, CAST(n_lines AS BIGINT) AS n_lines FROM group3"
NEAREST_LINES = (
    _GROUPS
    + """,
over_bars AS (SELECT b.symbol, b.i, close, slope * b.i + g.intercept AS y FROM group3 g JOIN bars b ON b.symbol = g.symbol AND b.i BETWEEN start_i AND end_i),
near AS (SELECT symbol, i, min(CASE WHEN y - close >= -1e-9 * abs(y) THEN y END) AS above, max(CASE WHEN y - close < -1e-9 * abs(y) THEN y END) AS below, count(*) AS n_lines FROM over_bars GROUP BY 1, 2)
SELECT b.symbol, b.i, """
    + shown("close", "above", "below")
    + """, coalesce(n_lines, 0) AS n_lines FROM bars b LEFT JOIN near m ON m.symbol = b.symbol AND m.i = b.i"""
)
