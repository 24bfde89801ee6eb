"""File formats of ledgers and run configurations as Spark data sources, and the folder that a session shares.

``register(spark)`` adds the formats ``ledger`` (read and write) and ``run_config`` (read). Paths may be of any file system that
pyarrow opens; the driver lists files, and each file is read by one task, line by line.
"""

from __future__ import annotations

import csv
import datetime as d
import io
import json
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .config import PERIODS, parse_config

LEDGER = "ticker string, title string, start_capital double, stock string, action string, price double, dt date, amount double, shares double"
CONFIG = "file string, symbol string, period string, months int, interval string, indexes array<string>, export string"
# The head of a ledger's rows, what a row may do, and the lines within which the head must come.
HEAD = ("Stock", "Action", "Price of Action", "Date", "Actual Amt", "Shares", "", "Cash Available")
ACTIONS, HEAD_WITHIN = ("Buy", "Sell", "Deposit", "Withdraw", "Dividend"), 1000
#: Rows of a ledger that are read at once.
AT_ONCE = 10_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir; where that is unset, a local session gets a temporary folder and a cluster an error."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="barloom-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@dataclass
class FilePartition(InputPartition):
    path: str


def _files(path: str, *endings: str) -> list[str]:
    """The file, or all files below the folder with one of the endings."""
    where, inner = fs.FileSystem.from_uri(path)
    info = where.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = where.get_file_info(fs.FileSelector(inner, recursive=True))
    scheme = path[: len(path) - len(inner)] if path.endswith(inner) else path.split(":", 1)[0] + "://"
    return sorted(scheme + f.path for f in found if f.type == fs.FileType.File and f.path.endswith(endings) and not f.base_name.startswith((".", "_")))


def _opened(path: str) -> io.TextIOWrapper:
    where, inner = fs.FileSystem.from_uri(path)
    return io.TextIOWrapper(where.open_input_stream(inner), "utf-8", newline="")


# --- ledgers ---------------------------------------------------------------------------------------------------------------------------


def _number(cell: str) -> float | None:
    try:
        return float(cell)
    except ValueError:
        pass
    try:
        return float(cell.replace("$", "").replace(",", "").replace(" ", ""))
    except ValueError:
        return None


@lru_cache(maxsize=100_000)
def _day(cell: str) -> d.date | None:
    try:
        return d.datetime.strptime(cell.strip(), "%m/%d/%Y").date()
    except ValueError:
        return None


@lru_cache(maxsize=100_000)
def _shown(day: d.date | None) -> str | None:
    return day and f"{day.month}/{day.day}/{day.year}"


def _values(column: pa.Array) -> list:
    """column.to_pylist(), with repeated texts and dates made once."""
    if pa.types.is_string(column.type) or pa.types.is_date(column.type):
        own = column.dictionary_encode("encode")
        made = own.dictionary.to_pylist()
        return [made[k] for k in own.indices.to_numpy().tolist()]
    return column.to_numpy().tolist() if pa.types.is_floating(column.type) and not column.null_count else column.to_pylist()


def ledger_head(rows: Iterator[list[str]], path: str = "") -> dict[str, str]:
    """The header of a ledger: title, and the named values below it, up to the row of column names, which is consumed."""
    head: dict[str, str] = {}
    for k, row in enumerate(rows):
        cells = [c.strip() for c in row] or [""]
        if cells[0] == HEAD[0]:
            return head
        if k == 0:
            head["title"] = cells[0]
        elif cells[0]:
            head[cells[0].lower().replace(" ", "_")] = cells[1] if len(cells) > 1 else ""
        if k > HEAD_WITHIN:
            break
    raise ValueError(f"{path}: no row begins with {HEAD[0]}")


def read_head(path: str) -> dict[str, str]:
    with _opened(path) as file:
        return ledger_head(csv.reader(file), path)


class LedgerReader(DataSourceReader):
    """A row for each trade; rows without an action or a date are left out. A ledger without a ticker goes by its file's name."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [FilePartition(f) for f in _files(self.path, ".csv")]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(x.split()[0], {"string": pa.string(), "double": pa.float64(), "date": pa.date32()}[x.split()[1]]) for x in LEDGER.split(", ")])
        with _opened(partition.path) as file:
            rows = csv.reader(file)
            head = ledger_head(rows, partition.path)
            ticker = head.get("ticker") or partition.path.rsplit("/", 1)[-1].removesuffix(".csv")
            same = (ticker, head.get("title"), _number(head.get("start_capital", "")))
            while some := list(islice(rows, AT_ONCE)):
                found = []
                for row in some:
                    stock, action, price, day, amount, shares, *_ = [c.strip() for c in row] + [""] * 6
                    if action in ACTIONS and (on := _day(day)):
                        found.append((stock, action, _number(price), on, _number(amount), _number(shares)))
                if found:
                    yield pa.RecordBatch.from_arrays([*(pa.array([x] * len(found), f.type) for x, f in zip(same, schema, strict=False)), *(pa.array(v, f.type) for v, f in zip(zip(*found, strict=True), list(schema)[3:], strict=True))], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class LedgerWriter(DataSourceArrowWriter):
    """A file for each run of rows of one ticker. Tasks write under hidden names, and the commit shows those of the tasks that count."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.names = path, schema.names

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        where, inner = fs.FileSystem.from_uri(self.path)
        where.create_dir(inner, recursive=True)
        files: list[tuple[str, str]] = []
        file, ticker = None, None
        for batch in batches:
            r = dict(zip(self.names, batch.columns, strict=True))
            tickers = _values(r["ticker"])
            ends = [k for k in range(1, len(tickers)) if tickers[k] != tickers[k - 1]] + [len(tickers)] * bool(tickers)
            empty = [""] * len(tickers)
            cells = list(zip(*[_values(r[x]) for x in ("stock", "action", "price")], map(_shown, _values(r["dt"])), _values(r["amount"]), _values(r["shares"]), empty, empty, strict=True))
            for start, end in zip([0, *ends], ends, strict=False):
                if file is None or tickers[start] != ticker:
                    if file:
                        file.close()
                    ticker, key = tickers[start], uuid.uuid4().hex
                    safe = "".join(c if c.isalnum() or c in "-_" else "_" for c in ticker or "none")
                    files.append((f"{inner}/_{key}.csv", f"{inner}/{safe}-{key[:8]}.csv"))
                    file = io.TextIOWrapper(where.open_output_stream(files[-1][0]), "utf-8", newline="")
                    out = csv.writer(file, lineterminator="\n")
                    blank = [""] * len(HEAD)
                    out.writerows([[r["title"][start].as_py(), *blank[1:]], blank, ["Start Capital", r["start_capital"][start].as_py(), *blank[2:]], ["Ticker", ticker, *blank[2:]], blank, HEAD])
                out.writerows(cells[start:end])
        if file:
            file.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        where, _ = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for hidden, shown in m.files if m else ():
                where.move(hidden, shown)

    def abort(self, messages: list[Written | None]) -> None:
        where, _ = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for hidden, _shown in m.files if m else ():
                where.delete_file(hidden)


class LedgerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ledger"

    def schema(self) -> str:
        return LEDGER

    def reader(self, schema: StructType) -> LedgerReader:
        return LedgerReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> LedgerWriter:
        return LedgerWriter(self.options["path"], schema)


def write_ledgers(trades: DataFrame, path: str, by_year: bool = False) -> None:
    """Ledger files of trades (the columns of LEDGER), those of one ticker in one file, by date.

    A file is written and read by one task. With by_year a ticker's years go to tasks of their own, so that it may have several files,
    each with whole years.
    """
    register(trades.sparkSession)
    order = ["ticker", "dt", "stock", "action", "shares", "price"]
    rows = trades.select(*[c.split()[0] for c in LEDGER.split(", ")])
    spread = rows.repartition("ticker", F.year("dt")) if by_year else rows.repartition("ticker")
    spread.sortWithinPartitions(*order).write.format("ledger").mode("append").save(path)


# --- configurations ----------------------------------------------------------------------------------------------------------------------


class ConfigReader(DataSourceReader):
    """A row for each symbol and period of each configuration. A file is one JSON document or one on each line."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [FilePartition(f) for f in _files(self.path, ".json", ".txt")]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        with _opened(partition.path) as file:
            text = file.read()
        try:
            json.loads(text)
            documents = [text]
        except ValueError:
            documents = [line for line in text.splitlines() if line.strip()]
        for document in documents:
            c = parse_config(document)
            for period, interval in zip(c.periods, c.intervals, strict=False):
                for symbol in c.symbols:
                    yield partition.path.rsplit("/", 1)[-1], symbol, period, PERIODS.get(period), interval, sorted(k for k, v in c.indexes.items() if v), c.export


class ConfigSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "run_config"

    def schema(self) -> str:
        return CONFIG

    def reader(self, schema: StructType) -> ConfigReader:
        return ConfigReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LedgerSource)
    spark.dataSource.register(ConfigSource)
