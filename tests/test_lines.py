"""Trend lines against hand-made series and plain loops; tests.test_oracles holds their queries against SQL."""

import math
import random

import pytest

from barloom.operators import features, lines
from tests.test_series import bars

TREND = "symbol string, term string, slope double, intercept double, start_i long, end_i long, type string, current boolean"


def line(spark, slope=1.0, intercept=0.0, last=9, kind="bull"):
    return spark.createDataFrame([("a", "near", slope, intercept, 0, last, kind, True)], TREND)


def test_touches_and_crossings(spark):
    b = bars(spark, [0.5, 0.5, 2.0, 4.0, 3.0, 4.0, 6.5, 7.0, 7.5, 8.5])
    got = [(r["i"], r["event"], r["side"]) for r in lines.line_touches(line(spark), b).orderBy("i", "event").collect()]
    assert got == [(1, "cross", "below"), (2, "cross", "above"), (2, "touch", "below"), (4, "cross", "below"), (6, "cross", "above"), (7, "touch", "above"), (8, "cross", "below")]


def test_periods_of_a_rising_and_a_falling_line(spark):
    b = bars(spark, [0.5, 0.5, 2.0, 4.0, 3.0, 4.0, 6.5, 7.0, 7.5, 8.5])
    got = [(r["state"], r["first_i"], r["last_i"]) for r in lines.line_periods(line(spark), b).orderBy("first_i").collect()]
    assert got == [("valid", 0, 0), ("broken", 1, 1), ("valid", 2, 3), ("broken", 4, 5), ("valid", 6, 7), ("broken", 8, 9)]
    falling = [r["state"] for r in lines.line_periods(line(spark, -1.0, 5.0, 4, "bear"), b).orderBy("first_i").collect()]
    assert falling == ["valid", "broken"]


def test_a_line_that_closes_never_reach(spark):
    b = bars(spark, [0.5] * 6)
    high = line(spark, 0.1, 5.0, 5)
    assert [r["state"] for r in lines.line_periods(high, b).collect()] == ["broken"]
    assert [r["state"] for r in lines.line_periods(high, b, compat=True).collect()] == ["valid"]
    assert lines.line_touches(high, b).count() == 0


def test_forecast_goes_by_the_first_price(spark):
    got = lines.line_forecast(line(spark), bars(spark, [float(k) for k in range(10)] + [14.5]), (5, 10)).orderBy("ahead").collect()
    assert [(r["ahead"], r["price"], r["state"], r["direction"]) for r in got] == [(5, 14.0, "Above", "UP"), (10, 19.0, "Above", "UP")]


def test_trend_line_of_a_rising_block(spark):
    x = [10 + 0.5 * k + (3.0 if k % 4 in (1, 2) else 0.0) for k in range(40)]
    got = lines.trend_lines(bars(spark, x), (0,), (20,)).orderBy("start_i").collect()
    assert [r["start_i"] for r in got] == [0, 20] and all(r["type"] == "bull" for r in got)
    assert all(r["slope"] == pytest.approx(0.5, abs=0.06) for r in got)
    assert lines.trend_lines(bars(spark, x), (0,), (41,)).count() == 0


def test_one_point_alone_has_no_line():
    import numpy as np

    at, y = np.array([1.0, 5.0, 9.0]), np.array([5.0, 4.0, 9.0])
    assert lines._block_line((1.0, 0.0), 1, at, y) is None  # the second alone is below the line of the three
    at, y = np.array([1.0, 3.0, 5.0, 9.0]), np.array([2.0, 9.0, 4.0, 6.0])
    slope, intercept = lines._block_line((1.0, 0.0), 1, at, y)
    assert all(slope * p + intercept <= q + 1e-9 for p, q in zip(at, y))


def plain_near(slope, intercept, v, a, b, share):
    held = []
    for i in range(a, b + 1):
        y = slope * i + intercept
        low, high = sorted([(1 - share) * v[i], (1 + share) * v[i]])
        if (y >= 0 and low <= y <= high and v[i] >= 0) or (y < 0 and v[i] < 0 and low <= y <= high):
            held.append(i)
    return (held[0], held[-1]) if held else None


def test_groups_against_a_plain_loop(spark):
    rng = random.Random(5)
    v = [100 + 10 * math.sin(k / 6) + rng.random() for k in range(90)]
    b = bars(spark, v)
    found = lines.channel_lines(b)
    held = sorted((r["angle"], r["id"], r["slope"], r["intercept"], r["start_i"], r["end_i"]) for r in found.collect())
    assert all(r["end_i"] < 90 for r in found.collect()) and len(held) > 50
    scale = len(v) / (max(v) - min(v))
    for degrees in (2.5, 0.2, 0.3):
        groups, share = [], degrees / 20
        for r in held:
            first = groups[-1][0] if groups else None
            if first and r[0] < first[0] + degrees and ((1 + share) * first[3] > (1 - share) * r[3] if first[3] >= 0 else (1 - share) * first[3] > (1 + share) * r[3]):
                groups[-1].append(r)
            else:
                groups.append([r])
        after = []
        for g in groups:
            s, c = sum(r[2] for r in g) / len(g), sum(r[3] for r in g) / len(g)
            span = plain_near(s, c, v, min(r[4] for r in g), max(r[5] for r in g), 0.03)
            if span and span[1] - span[0] >= 4:
                after.append((math.degrees(math.atan(s * scale)) + (180 if s < 0 else 0), len(after), s, c, *span))
        held = sorted(after)
    got = sorted((r["angle"], r["slope"], r["start_i"], r["end_i"]) for r in lines.line_groups(found, b).collect())
    assert [(round(r[0], 6), round(r[2], 6), r[4], r[5]) for r in held] == [(round(a, 6), round(s, 6), x, y) for a, s, x, y in got]


def test_nearest_lines(spark):
    held = spark.createDataFrame([("a", 0, 0.0, 10.0, 0, 3), ("a", 1, 0.0, 12.0, 0, 9), ("a", 2, 0.0, 5.0, 2, 9)], "symbol string, id long, slope double, intercept double, start_i long, end_i long")
    got = {r["i"]: (r["above"], r["below"], r["n_lines"]) for r in lines.nearest_lines(held, bars(spark, [11.0, 10.0, 9.0, 13.0, 12.0, 4.0] + [6.0] * 6)).collect()}
    assert got[0] == (12.0, 10.0, 2) and got[1] == (10.0, None, 2) and got[2] == (10.0, 5.0, 3)
    assert got[3] == (None, 12.0, 3) and got[4] == (12.0, 5.0, 2) and got[5] == (5.0, None, 2) and got[11] == (None, None, 0)


def test_odd_series(spark):
    for x in ([5.0], [5.0, 6.0], [5.0] * 40, [-3.0, 2.0] * 20):
        b = bars(spark, x)
        found = lines.channel_lines(b)
        lines.nearest_lines(lines.line_groups(found, b), b).collect()
        lines.line_periods(lines.trend_lines(b, (2,), (5, 0.25)), b).collect()
    assert lines.line_groups(found.limit(0), b).count() == 0 and lines.trend_lines(b.limit(0)).count() == 0


def test_duplicates_of_extrema(spark):
    rows = [(0, 0, 10.0), (1, 3, 10.05), (2, 3, 10.05), (3, 7, 12.0), (4, 9, 12.05), (5, 12, 11.0)]
    points = spark.createDataFrame([("a", 4, s, i, v, "max", 1.0) for s, i, v in rows], features.EXTREMA)
    assert [r["i"] for r in features.without_duplicates(points, "point").orderBy("i").collect()] == [3, 7, 9, 12]
    assert [r["i"] for r in features.without_duplicates(points).orderBy("i").collect()] == [7, 12]
