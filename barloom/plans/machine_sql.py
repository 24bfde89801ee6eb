"""DuckDB SQL of state machines as recursive queries, written from their specification and apart from the operators.

A machine goes over the rows of a table (symbol, i, x, y, c, p and more; p is the close before) in order of i. Its columns are worked
out from those of the row before (m) and the row (s).
"""

from __future__ import annotations


def machine(name: str, source: str, start: dict[str, str], step: dict[str, str], emit: str) -> str:
    """A recursive table name(symbol, i, columns of start, kind)."""
    first = ", ".join(f"CAST({v} AS {'VARCHAR' if c == 'st' else 'DOUBLE'}) AS {c}" for c, v in start.items())
    after = ", ".join(f"CAST({step.get(c, f'm.{c}')} AS {'VARCHAR' if c == 'st' else 'DOUBLE'})" for c in start)
    return f"""{name} AS (SELECT symbol, CAST(-1 AS BIGINT) AS i, {first}, CAST(NULL AS VARCHAR) AS kind FROM (SELECT DISTINCT symbol FROM {source})
        UNION ALL SELECT s.symbol, CAST(s.i AS BIGINT), {after}, CAST({emit} AS VARCHAR) FROM {name} m JOIN {source} s ON s.symbol = m.symbol AND s.i = m.i + 1)"""


def case(states: dict[str, str], other: str) -> str:
    """One expression for each state; others keep their value."""
    return "CASE m.st " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in states.items()) + f" ELSE {other} END"


def zone_crossing(name: str, source: str) -> str:
    """Both lines in a zone (x the faster), then x crosses y, then x leaves the zone."""
    st = {
        "n": "CASE WHEN x >= 80 THEN 'b1' WHEN x <= 20 THEN 's1' ELSE 'n' END",
        "b1": "CASE WHEN x < 80 THEN 'n' WHEN y >= 80 THEN 'b2' ELSE 'b1' END", "b2": "CASE WHEN x < y THEN 'b3' ELSE 'b2' END", "b3": "CASE WHEN x < 80 THEN 'n' ELSE 'b3' END",
        "s1": "CASE WHEN x > 20 THEN 'n' WHEN y <= 20 THEN 's2' ELSE 's1' END", "s2": "CASE WHEN x > y THEN 's3' ELSE 's2' END", "s3": "CASE WHEN x > 20 THEN 'n' ELSE 's3' END",
    }
    return machine(name, source, {"st": "'n'"}, {"st": case(st, "m.st")}, "CASE WHEN m.st = 'b3' AND x < 80 THEN 'bearish' WHEN m.st = 's3' AND x > 20 THEN 'bullish' END")


def zone_divergence(name: str, source: str) -> str:
    """Two peaks in a zone that fall while the closes rise (two dips that rise while they fall)."""
    st = {
        "n": "CASE WHEN x >= 80 THEN 'b1' WHEN x <= 20 THEN 's1' ELSE 'n' END",
        "b1": "CASE WHEN x < v0 THEN 'b2' ELSE 'b1' END", "b2": "CASE WHEN x < 80 THEN 'b3' WHEN x > v0 THEN 'b1' ELSE 'b2' END", "b3": "CASE WHEN x > v1 THEN 'b4' ELSE 'b3' END",
        "b4": "CASE WHEN x < v1 THEN 'n' WHEN x > v0 THEN 'b1' ELSE 'b4' END",
        "s1": "CASE WHEN x > v0 THEN 's2' ELSE 's1' END", "s2": "CASE WHEN x > 20 THEN 's3' WHEN x < v0 THEN 's1' ELSE 's2' END", "s3": "CASE WHEN x < v1 THEN 's4' ELSE 's3' END",
        "s4": "CASE WHEN x > v1 THEN 'n' WHEN x < v0 THEN 's1' ELSE 's4' END",
    }
    v0 = {
        "n": "CASE WHEN x >= 80 OR x <= 20 THEN x ELSE v0 END", "b1": "CASE WHEN x < v0 THEN v0 ELSE x END", "s1": "CASE WHEN x > v0 THEN v0 ELSE x END",
        "b2": "CASE WHEN x >= 80 AND x > v0 THEN x ELSE v0 END", "s2": "CASE WHEN x <= 20 AND x < v0 THEN x ELSE v0 END",
        "b4": "CASE WHEN x >= v1 AND x > v0 THEN x ELSE v0 END", "s4": "CASE WHEN x <= v1 AND x < v0 THEN x ELSE v0 END",
    }
    v1 = {"b2": "CASE WHEN x < 80 THEN x ELSE v1 END", "s2": "CASE WHEN x > 20 THEN x ELSE v1 END", "b3": "x", "s3": "x", "b4": "CASE WHEN x < v1 THEN v1 ELSE x END", "s4": "CASE WHEN x > v1 THEN v1 ELSE x END"}
    p0 = {"b1": "CASE WHEN x < v0 THEN c ELSE p0 END", "s1": "CASE WHEN x > v0 THEN c ELSE p0 END"}
    emit = "CASE WHEN m.st = 'b4' AND x < v1 AND p0 < p AND v0 > v1 THEN 'bearish' WHEN m.st = 's4' AND x > v1 AND p0 > p AND v0 < v1 THEN 'bullish' END"
    return machine(name, source, {"st": "'n'", "v0": "0", "v1": "0", "p0": "0"}, {"st": case(st, "m.st"), "v0": case(v0, "m.v0"), "v1": case(v1, "m.v1"), "p0": case(p0, "m.p0")}, emit)


def rejection(name: str, source: str) -> str:
    """Out of a zone, a turn, back but not into the zone, and beyond the turn. lo and hi are columns."""
    st = {
        "0": "CASE WHEN x <= lo THEN '1' WHEN x >= hi THEN '5' ELSE '0' END",
        "1": "CASE WHEN x > lo THEN '2' ELSE '1' END", "2": "CASE WHEN x < a THEN '3' WHEN x >= hi THEN '5' ELSE '2' END", "3": "CASE WHEN x <= lo THEN '1' WHEN x <= b THEN '3' ELSE '4' END",
        "4": "CASE WHEN x > a THEN '0' WHEN x <= lo THEN '1' ELSE '4' END",
        "5": "CASE WHEN x < hi THEN '6' ELSE '5' END", "6": "CASE WHEN x > b THEN '7' WHEN x <= lo THEN '1' ELSE '6' END", "7": "CASE WHEN x >= hi THEN '5' WHEN x >= a THEN '7' ELSE '8' END",
        "8": "CASE WHEN x < b THEN '0' WHEN x >= hi THEN '5' ELSE '8' END",
    }
    a = {"1": "CASE WHEN x > lo THEN x ELSE a END", "2": "CASE WHEN x >= a AND x < hi THEN x ELSE a END", "4": "CASE WHEN x > a THEN 0 ELSE a END", "6": "CASE WHEN x > b THEN x ELSE a END", "7": "CASE WHEN x < hi AND x >= a THEN x ELSE a END", "8": "CASE WHEN x < b THEN 0 ELSE a END"}
    b = {"2": "CASE WHEN x < a THEN x ELSE b END", "3": "CASE WHEN x > lo AND x <= b THEN x ELSE b END", "4": "CASE WHEN x > a THEN 0 ELSE b END", "5": "CASE WHEN x < hi THEN x ELSE b END", "6": "CASE WHEN x <= b AND x > lo THEN x ELSE b END", "8": "CASE WHEN x < b THEN 0 ELSE b END"}
    emit = "CASE WHEN m.st = '4' AND x > a THEN 'bullish' WHEN m.st = '8' AND x < b THEN 'bearish' END"
    return machine(name, source, {"st": "'0'", "a": "0", "b": "0"}, {"st": case(st, "m.st"), "a": case(a, "m.a"), "b": case(b, "m.b")}, emit)


def zone_turns(name: str, source: str) -> str:
    """Two lows of x with one turn between, the second within the zone and higher while the close is lower (and upside down)."""
    st = {
        "n": "CASE WHEN x <= lo THEN 'u1' WHEN x >= hi THEN 'e1' ELSE 'n' END",
        "u1": "CASE WHEN x <= r0 THEN 'u1' ELSE 'u2' END", "u2": "CASE WHEN x < a THEN 'u3' WHEN x >= hi THEN 'e1' ELSE 'u2' END", "u3": "CASE WHEN x <= r1 THEN 'u3' ELSE 'n' END",
        "e1": "CASE WHEN x >= r0 THEN 'e1' ELSE 'e2' END", "e2": "CASE WHEN x > a THEN 'e3' WHEN x <= lo THEN 'u1' ELSE 'e2' END", "e3": "CASE WHEN x >= r1 THEN 'e3' ELSE 'n' END",
    }
    r0 = {"n": "CASE WHEN x <= lo OR x >= hi THEN x ELSE r0 END", "u1": "least(x, r0)", "e1": "greatest(x, r0)", "u2": "CASE WHEN x >= a AND x >= hi THEN x ELSE r0 END", "e2": "CASE WHEN x <= a AND x <= lo THEN x ELSE r0 END"}
    a = {"u1": "CASE WHEN x > r0 THEN x ELSE a END", "e1": "CASE WHEN x < r0 THEN x ELSE a END", "u2": "CASE WHEN x >= a AND x < hi THEN x ELSE a END", "e2": "CASE WHEN x <= a AND x > lo THEN x ELSE a END"}
    r1 = {"u2": "CASE WHEN x < a THEN x ELSE r1 END", "e2": "CASE WHEN x > a THEN x ELSE r1 END", "u3": "least(x, r1)", "e3": "greatest(x, r1)"}
    p0 = {"u1": "CASE WHEN x <= r0 THEN c ELSE p0 END", "e1": "CASE WHEN x >= r0 THEN c ELSE p0 END"}
    p1 = {"u3": "CASE WHEN x <= r1 THEN c ELSE p1 END", "e3": "CASE WHEN x >= r1 THEN c ELSE p1 END"}
    emit = "CASE WHEN m.st = 'u3' AND x > r1 AND r1 <= lo AND p1 < p0 AND r0 < r1 THEN 'bullish' WHEN m.st = 'e3' AND x < r1 AND r1 >= hi AND p1 > p0 AND r0 > r1 THEN 'bearish' END"
    start = {"st": "'n'", "r0": "0", "r1": "0", "a": "0", "p0": "0", "p1": "0"}
    return machine(name, source, start, {"st": case(st, "m.st"), "r0": case(r0, "m.r0"), "r1": case(r1, "m.r1"), "a": case(a, "m.a"), "p0": case(p0, "m.p0"), "p1": case(p1, "m.p1")}, emit)


def level_crossing(name: str, source: str) -> str:
    """Beyond plus or minus 100, and back over zero; rows without a value change nothing. kind is high, low, down or up."""
    st = {
        "": "CASE WHEN x > 0 THEN 'p1' ELSE 'n1' END", "n1": "CASE WHEN x > 0 THEN 'p1' WHEN x <= -100 THEN 'n2' ELSE 'n1' END", "p1": "CASE WHEN x < 0 THEN 'n1' WHEN x >= 100 THEN 'p2' ELSE 'p1' END",
        "p2": "CASE WHEN x < 0 THEN 'n1' ELSE 'p2' END", "n2": "CASE WHEN x > 0 THEN 'p1' ELSE 'n2' END",
    }
    emit = "CASE WHEN m.st = 'n1' AND x <= -100 THEN 'low' WHEN m.st = 'p1' AND x >= 100 THEN 'high' WHEN m.st = 'p2' AND x < 0 THEN 'down' WHEN m.st = 'n2' AND x > 0 THEN 'up' END"
    return machine(name, source, {"st": "''"}, {"st": f"CASE WHEN x IS NULL THEN m.st ELSE {case(st, 'm.st')} END"}, emit)


def band_exit(name: str, source: str) -> str:
    """Beyond hi or lo; there, back within without a word, or over the line y with a signal."""
    st = {"n": "CASE WHEN x > hi THEN 'b' WHEN x < lo THEN 's' ELSE 'n' END", "b": "CASE WHEN x < hi OR x < y THEN 'n' ELSE 'b' END", "s": "CASE WHEN x > lo OR x > y THEN 'n' ELSE 's' END"}
    return machine(name, source, {"st": "'n'"}, {"st": case(st, "m.st")}, "CASE WHEN m.st = 'b' AND x >= hi AND x < y THEN 'bearish' WHEN m.st = 's' AND x <= lo AND x > y THEN 'bullish' END")


def swings(name: str, source: str, lo: str = "30", hi: str = "70") -> str:
    """The second search of the ultimate oscillator: the chain from the lower zone, then in the same row that from the upper one."""
    up = f"""SELECT m.i AS was, m.st, m.v0, m.v1, m.v2, m.p0, m.p1, s.symbol, s.i, s.x, s.p,
        CASE WHEN m.st = 'n' AND x <= {lo} THEN 'u1' WHEN m.st = 'u1' AND x >= m.v0 THEN 'u2' WHEN m.st = 'u2' AND x > {lo} THEN 'u3' WHEN m.st = 'u3' AND x <= m.v1 THEN 'u4' WHEN m.st = 'u4' AND m.v2 < x THEN 'u5'
            WHEN m.st = 'u5' AND x > m.v1 THEN CASE WHEN m.p0 > m.p1 THEN 'n' ELSE 'u3' END WHEN m.st = 'u5' AND x < m.v2 THEN 'u4' ELSE m.st END AS t,
        CASE WHEN m.st = 'n' AND x <= {lo} OR m.st = 'u1' AND x < m.v0 THEN x ELSE m.v0 END AS a0,
        CASE WHEN m.st = 'u2' AND x > {lo} OR m.st = 'u3' AND x > m.v1 OR m.st = 'u5' AND x > m.v1 AND m.p0 <= m.p1 THEN x ELSE m.v1 END AS a1,
        CASE WHEN m.st = 'u3' AND x <= m.v1 OR m.st = 'u4' AND m.v2 >= x OR m.st = 'u5' AND x <= m.v1 AND x < m.v2 THEN x ELSE m.v2 END AS a2,
        CASE WHEN m.st = 'u1' AND x >= m.v0 THEN p ELSE m.p0 END AS q0, CASE WHEN m.st = 'u4' AND m.v2 < x THEN p ELSE m.p1 END AS q1, m.st = 'u5' AND x > m.v1 AND m.p0 > m.p1 AS bull
        FROM {name} m JOIN {source} s ON s.symbol = m.symbol AND s.i = m.i + 1"""
    anew = f"(t = 'n' OR t LIKE 'u%' OR t = 'e2')"
    return f"""{name} AS (SELECT symbol, CAST(-1 AS BIGINT) AS i, 'n' AS st, 0.0::DOUBLE AS v0, 0.0::DOUBLE AS v1, 0.0::DOUBLE AS v2, 0.0::DOUBLE AS p0, 0.0::DOUBLE AS p1, CAST(NULL AS VARCHAR) AS kind FROM (SELECT DISTINCT symbol FROM {source})
        UNION ALL SELECT symbol, CAST(i AS BIGINT),
        CASE WHEN {anew} AND x >= {hi} THEN 'e1' WHEN t = 'e1' AND x <= a0 THEN 'e2' WHEN t = 'e2' AND x < {hi} THEN 'e3' WHEN t = 'e3' AND x >= a1 THEN 'e4' WHEN t = 'e4' AND a2 > x THEN 'e5'
            WHEN t = 'e5' AND x < a1 THEN CASE WHEN q0 < q1 THEN 'n' ELSE 'e3' END WHEN t = 'e5' AND x > a2 THEN 'e4' WHEN t NOT LIKE 'e%' AND x <= {lo} THEN 'u1' ELSE t END,
        CASE WHEN {anew} AND x >= {hi} OR t = 'e1' AND x > a0 OR t NOT LIKE 'e%' AND x <= {lo} THEN x ELSE a0 END,
        CASE WHEN t = 'e2' AND x < {hi} OR t = 'e3' AND x < a1 OR t = 'e5' AND x < a1 AND q0 >= q1 THEN x ELSE a1 END,
        CASE WHEN t = 'e3' AND x >= a1 OR t = 'e4' AND a2 <= x OR t = 'e5' AND x >= a1 AND x > a2 THEN x ELSE a2 END,
        CASE WHEN t = 'e1' AND x <= a0 THEN p ELSE q0 END, CASE WHEN t = 'e4' AND a2 > x THEN p ELSE q1 END,
        CASE WHEN bull THEN 'bullish' WHEN t = 'e5' AND x < a1 AND q0 < q1 THEN 'bearish' END FROM ({up}))"""


def lows(name: str, source: str, lo: str = "30", hi: str = "70") -> str:
    """For each row z in a zone the row of the last lower low (higher high) of the close that a bounce followed: symbol, z, d, i, low."""
    return f"""{name} AS (SELECT symbol, i AS z, CASE WHEN x < {lo} THEN 1 ELSE -1 END AS d, c AS own, i, c AS track, i AS at, 0 AS b, CAST(NULL AS BIGINT) AS low FROM {source} WHERE x < {lo} OR x > {hi}
        UNION ALL SELECT m.symbol, m.z, m.d, m.own, s.i,
        CASE WHEN d * (c - own) < 0 AND b < 2 OR b > 1 AND d * (c - track) < 0 THEN c ELSE track END, CASE WHEN d * (c - own) < 0 AND b < 2 OR b > 1 AND d * (c - track) < 0 THEN s.i ELSE m.at END,
        CASE WHEN d * (c - own) < 0 AND b < 2 THEN 1 WHEN b = 1 AND d * (c - track) > 0 THEN 2 WHEN b > 1 AND d * (c - track) < 0 THEN 3 WHEN b = 3 AND d * (c - track) > 0 THEN 4 ELSE b END,
        CASE WHEN b = 3 AND d * (c - track) > 0 THEN m.at ELSE low END FROM {name} m JOIN {source} s ON s.symbol = m.symbol AND s.i = m.i + 1)"""


def two_lows(name: str, source: str, first: int = 26) -> str:
    """Divergences of the MACD line x: in each row the chain for lows, then that for peaks."""
    go = f"s.i >= {first}"
    up = f"""SELECT m.st, m.v0, m.v1, m.p0, m.p1, s.symbol, s.i, s.x, s.p, {go} AS go,
        CASE WHEN NOT {go} THEN m.st WHEN m.st = 'n' AND x < 0 THEN 'u1' WHEN m.st = 'u1' AND x >= m.v0 THEN 'u2' WHEN m.st = 'u2' THEN CASE WHEN x <= m.v1 THEN 'u3' WHEN x > 0 THEN 'e1' ELSE 'u2' END
            WHEN m.st = 'u3' THEN CASE WHEN x > m.v1 THEN 'u4' WHEN x <= m.v0 THEN 'u1' ELSE 'u3' END WHEN m.st = 'u4' THEN CASE WHEN x < m.v1 THEN 'u3' WHEN m.p1 < m.p0 AND m.v0 < m.v1 THEN 'n' ELSE 'u1' END ELSE m.st END AS t,
        CASE WHEN {go} AND (m.st = 'n' AND x < 0 OR m.st = 'u1' AND x < m.v0 OR m.st = 'u2' AND x > m.v1 AND x > 0) THEN x ELSE m.v0 END AS a0,
        CASE WHEN {go} AND (m.st = 'u1' AND x >= m.v0 OR m.st = 'u2' AND x > m.v1 AND x <= 0 OR m.st = 'u3' AND x <= m.v1) THEN x ELSE m.v1 END AS a1,
        CASE WHEN {go} AND m.st = 'u1' AND x >= m.v0 THEN p ELSE m.p0 END AS q0, CASE WHEN {go} AND m.st = 'u3' AND x > m.v1 THEN p ELSE m.p1 END AS q1,
        {go} AND m.st = 'u4' AND x >= m.v1 AND m.p1 < m.p0 AND m.v0 < m.v1 AS bull
        FROM {name} m JOIN {source} s ON s.symbol = m.symbol AND s.i = m.i + 1"""
    return f"""{name} AS (SELECT symbol, CAST(-1 AS BIGINT) AS i, 'n' AS st, 0.0::DOUBLE AS v0, 0.0::DOUBLE AS v1, 0.0::DOUBLE AS p0, 0.0::DOUBLE AS p1, CAST(NULL AS VARCHAR) AS kind FROM (SELECT DISTINCT symbol FROM {source})
        UNION ALL SELECT symbol, CAST(i AS BIGINT),
        CASE WHEN NOT go THEN t WHEN t = 'n' AND x > 0 THEN 'e1' WHEN t = 'e1' AND x <= a0 THEN 'e2' WHEN t = 'e2' THEN CASE WHEN x >= a1 THEN 'e3' WHEN x < 0 THEN 'u1' ELSE 'e2' END
            WHEN t = 'e3' THEN CASE WHEN x < a1 THEN 'e4' WHEN x >= a0 THEN 'e1' ELSE 'e3' END WHEN t = 'e4' THEN CASE WHEN x > a1 THEN 'e3' WHEN q1 > q0 AND a0 < a1 THEN 'n' ELSE 'e1' END ELSE t END,
        CASE WHEN go AND (t = 'n' AND x > 0 OR t = 'e1' AND x > a0 OR t = 'e2' AND x < a1 AND x < 0) THEN x ELSE a0 END,
        CASE WHEN go AND (t = 'e1' AND x <= a0 OR t = 'e2' AND x < a1 AND x >= 0 OR t = 'e3' AND x >= a1) THEN x ELSE a1 END,
        CASE WHEN go AND t = 'e1' AND x <= a0 THEN p ELSE q0 END, CASE WHEN go AND t = 'e3' AND x < a1 THEN p ELSE q1 END,
        CASE WHEN bull THEN 'bullish' WHEN go AND t = 'e4' AND x <= a1 AND q1 > q0 AND a0 < a1 THEN 'bearish' END FROM ({up}))"""


def confirmed_sign(name: str, source: str, first: int = 26) -> str:
    """The sign of x, told in the row after it has changed if it lasts."""
    st = {
        "n": "CASE WHEN x > 0 THEN 'u1' WHEN x < 0 THEN 'e1' ELSE 'n' END", "u1": "CASE WHEN x < 0 THEN 'e1' ELSE 'u2' END", "e1": "CASE WHEN x > 0 THEN 'u1' ELSE 'e2' END",
        "u2": "CASE WHEN x < 0 THEN 'e1' ELSE 'u2' END", "e2": "CASE WHEN x > 0 THEN 'u1' ELSE 'e2' END",
    }
    emit = f"CASE WHEN s.i < {first} THEN NULL WHEN m.st = 'u1' AND x >= 0 THEN 'bullish' WHEN m.st = 'e1' AND x <= 0 THEN 'bearish' END"
    return machine(name, source, {"st": "'n'"}, {"st": f"CASE WHEN s.i < {first} THEN m.st ELSE {case(st, 'm.st')} END"}, emit)


def twin_peaks(name: str, source: str) -> str:
    """A second peak of x below the first with a saddle above zero between (upside down below zero); w is x in the row before."""
    st = {
        "": "CASE WHEN x > 0 THEN 'rise' ELSE 'drop' END",
        "rise": "CASE WHEN x < w THEN 'pos_saddle' ELSE 'rise' END", "pos_saddle": "CASE WHEN x < 0 THEN 'drop' WHEN x > w THEN 'rise_2' ELSE 'pos_saddle' END",
        "rise_2": "CASE WHEN x >= a THEN 'rise' WHEN x < w THEN 'bear_peaks' ELSE 'rise_2' END", "bear_peaks": "CASE WHEN x < 0 THEN 'drop' ELSE 'bear_peaks' END",
        "drop": "CASE WHEN x > w THEN 'neg_saddle' ELSE 'drop' END", "neg_saddle": "CASE WHEN x > 0 THEN 'rise' WHEN x < w THEN 'drop_2' ELSE 'neg_saddle' END",
        "drop_2": "CASE WHEN x <= a THEN 'drop' WHEN x > w THEN 'bull_peaks' ELSE 'drop_2' END", "bull_peaks": "CASE WHEN x > 0 THEN 'rise' ELSE 'bull_peaks' END",
    }
    a = {"rise": "CASE WHEN x < w THEN w ELSE a END", "drop": "CASE WHEN x > w THEN w ELSE a END", "rise_2": "CASE WHEN x >= a THEN x ELSE a END", "drop_2": "CASE WHEN x <= a THEN x ELSE a END"}
    emit = "CASE WHEN m.st = 'rise_2' AND x < a AND x < w THEN 'bearish' WHEN m.st = 'drop_2' AND x > a AND x > w THEN 'bullish' END"
    return machine(name, source, {"st": "''", "a": "0"}, {"st": case(st, "m.st"), "a": case(a, "m.a")}, emit)


def saucer(name: str, source: str) -> str:
    """Two steps towards zero and one away, without crossing it."""
    st = {
        "": "CASE WHEN x > 0 THEN 'pos' ELSE 'neg' END",
        "pos": "CASE WHEN x < 0 THEN 'neg' WHEN x < w THEN 'drop_1' ELSE 'pos' END", "drop_1": "CASE WHEN x < 0 THEN 'neg' WHEN x < w THEN 'drop_2' ELSE 'pos' END", "drop_2": "CASE WHEN x < 0 THEN 'neg' WHEN x > w THEN 'pos' ELSE 'drop_2' END",
        "neg": "CASE WHEN x > 0 THEN 'pos' WHEN x > w THEN 'rise_1' ELSE 'neg' END", "rise_1": "CASE WHEN x > 0 THEN 'pos' WHEN x > w THEN 'rise_2' ELSE 'neg' END", "rise_2": "CASE WHEN x > 0 THEN 'pos' WHEN x < w THEN 'neg' ELSE 'rise_2' END",
    }
    return machine(name, source, {"st": "''"}, {"st": case(st, "m.st")}, "CASE WHEN m.st = 'drop_2' AND x >= 0 AND x > w THEN 'bullish' WHEN m.st = 'rise_2' AND x <= 0 AND x < w THEN 'bearish' END")


def zone_exit(name: str, source: str) -> str:
    """Beyond hi or lo, and back within."""
    st = {"n": "CASE WHEN x > hi THEN 'u' WHEN x < lo THEN 'd' ELSE 'n' END", "u": "CASE WHEN x < hi THEN 'n' ELSE 'u' END", "d": "CASE WHEN x > lo THEN 'n' ELSE 'd' END"}
    return machine(name, source, {"st": "'n'"}, {"st": case(st, "m.st")}, "CASE WHEN m.st = 'u' AND x < hi THEN 'bearish' WHEN m.st = 'd' AND x > lo THEN 'bullish' END")


def zigzag(name: str, source: str, share: float) -> str:
    """Extrema by reversals of a share; kind is max or min where a reversal shows in row i, which is the extremum of row place and value a."""
    turn = f"(m.st = 'up' AND x < a - abs(a) * {share} OR m.st = 'down' AND x > a + abs(a) * {share})"
    start = {"st": "''", "a": "0", "place": "0", "was": "0", "was_place": "0"}
    further = "m.st = 'up' AND x > a OR m.st = 'down' AND x < a"
    step = {
        "st": f"CASE WHEN m.st = '' THEN CASE WHEN x > 0 THEN 'up' ELSE 'down' END WHEN {turn} THEN CASE m.st WHEN 'up' THEN 'down' ELSE 'up' END ELSE m.st END",
        "a": f"CASE WHEN m.st = '' OR {further} OR {turn} THEN x ELSE a END", "place": f"CASE WHEN m.st = '' OR {further} OR {turn} THEN s.i ELSE place END", "was": "a", "was_place": "place",
    }
    return machine(name, source, start, step, f"CASE WHEN {turn} THEN CASE m.st WHEN 'up' THEN 'max' ELSE 'min' END END")


def double_turn(name: str, source: str, first: int, d: int) -> str:
    """A W at the lower band (d = 1) or an M at the upper one (-1): edge is the band, mid its middle."""
    far = "s.c <= edge" if d > 0 else "s.c > edge"
    near = "s.c <= edge" if d > 0 else "s.c >= edge"
    below, above = (lambda x: f"{d} * (s.c - {x}) < 0"), (lambda x: f"{d} * (s.c - {x}) > 0")
    st = {
        "n": f"CASE WHEN {far} THEN 'w1' ELSE 'n' END", "w1": f"CASE WHEN {below('p0')} THEN 'w1' ELSE 'w2' END", "w2": f"CASE WHEN NOT {below('mid')} THEN 'w3' WHEN {below('p0')} THEN 'w1' ELSE 'w2' END",
        "w3": f"CASE WHEN {above('p1')} THEN 'w3' ELSE 'w4' END", "w4": f"CASE WHEN {below('p0')} THEN 'w5' WHEN {near} THEN 'w1' WHEN {above('p1')} THEN 'w3' ELSE 'w4' END",
        "w5": f"CASE WHEN {below('p2')} THEN CASE WHEN {near} THEN 'w1' ELSE 'w5' END ELSE 'w6' END", "w6": f"CASE WHEN {above('p1')} THEN 'n' WHEN {below('p2')} THEN CASE WHEN {near} THEN 'w1' ELSE 'w5' END ELSE 'w6' END",
    }
    p0 = {"n": f"CASE WHEN {far} THEN s.c ELSE p0 END", "w1": f"CASE WHEN {below('p0')} THEN s.c ELSE p0 END", "w2": f"CASE WHEN {below('mid')} AND {below('p0')} THEN s.c ELSE p0 END"}
    p1 = {"w2": f"CASE WHEN NOT {below('mid')} THEN s.c ELSE p1 END", "w3": f"CASE WHEN {above('p1')} THEN s.c ELSE p1 END", "w4": f"CASE WHEN NOT {below('p0')} AND NOT {near} AND {above('p1')} THEN s.c ELSE p1 END"}
    p2 = {"w4": f"CASE WHEN {below('p0')} THEN s.c ELSE p2 END", "w5": f"CASE WHEN {below('p2')} THEN s.c ELSE p2 END", "w6": f"CASE WHEN NOT {above('p1')} AND {below('p2')} THEN s.c ELSE p2 END"}
    go = lambda x, other: f"CASE WHEN s.i < {first} THEN {other} ELSE {x} END"
    step = {"st": go(case(st, "m.st"), "m.st"), "p0": go(case(p0, "m.p0"), "m.p0"), "p1": go(case(p1, "m.p1"), "m.p1"), "p2": go(case(p2, "m.p2"), "m.p2")}
    kind = "bullish" if d > 0 else "bearish"
    return machine(name, source, {"st": "'n'", "p0": "0", "p1": "0", "p2": "0"}, step, f"CASE WHEN s.i >= {first} AND m.st = 'w6' AND {above('p1')} THEN '{kind}' END")


def band_extremes(name: str, source: str, first: int) -> str:
    """Above or below the middle mid, then beyond hi or lo (kind with crossover), still so in the next row (with extreme), and back."""
    st = {
        "n": "CASE WHEN c < mid THEN 'e1' WHEN c > mid THEN 'u1' ELSE 'n' END",
        "e1": "CASE WHEN c <= lo THEN 'e2' WHEN c > mid THEN 'u1' ELSE 'e1' END", "e2": "CASE WHEN c <= lo THEN 'e2' ELSE 'e3' END", "e3": "CASE WHEN c >= mid THEN 'u1' ELSE 'e3' END",
        "u1": "CASE WHEN c >= hi THEN 'u2' WHEN c < mid THEN 'e1' ELSE 'u1' END", "u2": "CASE WHEN c >= hi THEN 'u2' ELSE 'u3' END", "u3": "CASE WHEN c <= mid THEN 'e1' ELSE 'u3' END",
    }
    emit = f"CASE WHEN s.i < {first} THEN NULL WHEN m.st = 'e1' AND c <= lo THEN 'lower band crossover' WHEN m.st = 'e2' AND c <= lo THEN 'lower band extreme' WHEN m.st = 'u1' AND c >= hi THEN 'upper band crossover' WHEN m.st = 'u2' AND c >= hi THEN 'upper band extreme' END"
    return machine(name, source, {"st": "'n'"}, {"st": f"CASE WHEN s.i < {first} THEN m.st ELSE {case(st, 'm.st')} END"}, emit)


def above_total(name: str, source: str) -> str:
    """The total t above the bulls x or, which counts more, above the bears y; told when that one comes above the total again."""
    held = "CASE WHEN t > y THEN -1 WHEN t > x THEN 1 ELSE m.a END"
    over = f"CASE {held} WHEN 1 THEN x > t WHEN -1 THEN y > t ELSE false END"
    return machine(name, source, {"a": "0"}, {"a": f"CASE WHEN {over} THEN 0 ELSE {held} END"}, f"CASE WHEN {over} THEN CASE {held} WHEN 1 THEN 'bullish' ELSE 'bearish' END END")
