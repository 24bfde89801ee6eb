"""Run configurations and static mappings: JSON files that are read on the driver, as plain data."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

INTERVALS = {"1d": "day", "1wk": "week", "1w": "week", "1mo": "month", "1m": "month"}
PERIODS = {"1y": 12, "2y": 24, "5y": 60, "10y": 120}
INDEXES = ("^GSPC", "^IRX")


@dataclass
class Config:
    """What to run: symbols, periods with their intervals, which composites, and what to export."""

    symbols: list[str] = field(default_factory=list)
    periods: list[str] = field(default_factory=lambda: ["2y"])
    intervals: list[str] = field(default_factory=lambda: ["1d"])
    indexes: dict[str, bool] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)
    export: str = ""


def parse_config(text: str) -> Config:
    """A configuration from JSON text; intervals are filled up with 1d, symbols are upper case."""
    raw = json.loads(text)
    own = raw.get("Properties", {})
    exports = raw.get("Exports", {})
    periods = list(own.get("Period", ["2y"]))
    intervals = [{"1w": "1wk", "1m": "1mo"}.get(i, i) for i in own.get("Interval", [])]
    intervals += ["1d"] * (len(periods) - len(intervals))
    symbols = raw.get("Ticker Symbols", [])
    symbols = symbols.split() if isinstance(symbols, str) else symbols
    return Config([s.upper().strip() for s in symbols], periods, intervals, {k: bool(v) for k, v in own.get("Indexes", {}).items()}, raw.get("Views", {}), exports.get("fields", "") if exports.get("run") else "")


def load_config(path: str) -> Config:
    return parse_config(Path(path).read_text())


def with_indexes(symbols: list[str]) -> list[str]:
    return [*symbols, *[x for x in INDEXES if x not in symbols]]


def weights_table(spark: SparkSession, mapping: dict[str, dict[str, float]]) -> DataFrame:
    """name, symbol and weight from a mapping of index names to weights: a dimension of as many rows as the file has entries."""
    return spark.createDataFrame([(n, s, float(w)) for n, ws in mapping.items() for s, w in ws.items()], "name string, symbol string, weight double")


def fund_weights(spark: SparkSession, spec: str) -> DataFrame:
    """fund, symbol and weight from the JSON of synthetic funds."""
    funds = json.loads(spec)["Funds"]
    return spark.createDataFrame([(f["ticker"], m["symbol"], float(m["allocation"])) for f in funds for m in f["makeup"]], "fund string, symbol string, weight double")


def sector_etf(sectors: dict[str, str], name: str) -> str | None:
    """The ETF of a sector, by its name without regard to case."""
    return {k.lower(): v for k, v in sectors.items()}.get(name.lower())


def peers(comparison: dict[str, list[str]], etf: str) -> list[str]:
    return comparison.get(etf, [])


def sector_table(spark: SparkSession, sectors: dict[str, str], comparison: dict[str, list[str]]) -> DataFrame:
    """sector, etf and peers from the mappings of a sectors file: a dimension of as many rows as the file has sectors."""
    return spark.createDataFrame([(s, e, peers(comparison, e)) for s, e in sectors.items()], "sector string, etf string, peers array<string>")
