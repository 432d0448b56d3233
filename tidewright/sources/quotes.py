"""Remote quotes as a Spark data source: a partition per batch of tickers.

A provider is a picklable object with ``bars(tickers, since) -> iterable of history rows`` and
``actions(tickers, kind, since) -> iterable of rows``, where since is the first day wanted, left out where all are; FolderProvider
reads Parquet files and needs no network.  A batch is tried again with growing, jittered pauses; one that keeps failing
gives a status row for each of its tickers instead of stopping the others.

Which tickers and days are wanted reaches the provider: days by the option ``since``, and both by filters on Ticker and
Date that Spark pushes down (fetch turns that on).  Spark applies its filters once more, so a provider may send more
than was asked for.

As a stream (follow), the offset is the last day of each ticker; a micro-batch holds the days after it.  For that a
provider has ``latest(tickers) -> {ticker: last complete day}`` too, which never goes back.
"""

from __future__ import annotations

import datetime as dt
import random
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

from ..operators.prep import batches
from ..schema import DIVIDENDS, HISTORY, SPLITS, struct

ATTEMPTS, FIRST_WAIT, LONGEST_WAIT, PAUSE, PAUSE_AFTER_FAILURE = 5, 1.0, 8.0, 0.5, 1.0
STATUS = "Ticker string,status string"
TABLES = {"history": HISTORY, "dividends": DIVIDENDS, "splits": SPLITS}
#: Rows with a null status, and rows with nothing but a ticker and its status (of actions: failures only): one download shows both.
FETCHED = {"fetched": "history", "dividends_fetched": "dividends", "splits_fetched": "splits"}


class Provider(Protocol):
    def bars(self, tickers: list[str], since: dt.datetime | None = None) -> Iterable[tuple]: ...

    def actions(self, tickers: list[str], kind: str, since: dt.datetime | None = None) -> Iterable[tuple]: ...


@dataclass
class FolderProvider:
    """Quotes of a folder with history.parquet, and dividends.parquet and splits.parquet if there are any."""

    folder: str

    def _rows(self, name: str, spec: str, tickers: list[str], since: dt.datetime | None) -> Iterator[tuple]:
        import pyarrow as pa
        import pyarrow.dataset as ds

        try:
            table = ds.dataset(f"{self.folder}/{name}.parquet")
        except FileNotFoundError:
            return
        columns = [x.split()[0] for x in spec.split(",")]
        wanted = ds.field("Ticker").isin(tickers)
        if since is not None:
            wanted = wanted & (ds.field("Date") >= pa.scalar(since, table.schema.field("Date").type))
        for batch in table.to_batches(columns=columns, filter=wanted):
            yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

    def bars(self, tickers: list[str], since: dt.datetime | None = None) -> Iterator[tuple]:
        return self._rows("history", HISTORY, tickers, since)

    def latest(self, tickers: list[str]) -> dict[str, dt.datetime]:
        days: dict[str, dt.datetime] = {}
        for t, day in self._rows("history", "Ticker string,Date timestamp_ntz", tickers, None):
            if day is not None:
                days[t] = max(days.get(t, day), day)
        return days

    def actions(self, tickers: list[str], kind: str, since: dt.datetime | None = None) -> Iterator[tuple]:
        return self._rows(kind, {"dividends": DIVIDENDS, "splits": SPLITS}[kind], tickers, since)


@dataclass
class NetworkProvider:
    """Quotes of the optional package yfinance: one call for a batch of tickers, days not adjusted, with what was paid and split beside them."""

    period: str = "max"

    def _frames(self, tickers: list[str], since: dt.datetime | None) -> Iterator[tuple]:
        """Each ticker and its frame; a frame for one ticker alone may have no level of tickers in its columns."""
        yfinance = network()
        span = {"period": self.period} if since is None else {"start": since.strftime("%Y-%m-%d")}
        found = yfinance.download(tickers, interval="1d", auto_adjust=False, actions=True, group_by="ticker", threads=False, progress=False, **span)
        if found is None or not len(found):
            return
        index = found.index
        found.index = index.tz_localize(None) if index.tz is None else index.tz_convert("UTC").tz_localize(None)
        if getattr(found.columns, "nlevels", 1) == 1:
            yield tickers[0], found
            return
        there = set(found.columns.get_level_values(0))
        yield from ((t, found[t]) for t in tickers if t in there)

    def bars(self, tickers: list[str], since: dt.datetime | None = None) -> Iterator[tuple]:
        number = lambda x: None if x != x else float(x)
        for t, frame in self._frames(tickers, since):
            named = frame.reindex(columns=["Open", "High", "Low", "Close", "Adj Close", "Volume"]).dropna(how="all")
            for day, *prices, volume in named.itertuples(name=None):
                yield (t, day.to_pydatetime(), *map(number, prices), None if volume != volume else int(volume))

    def latest(self, tickers: list[str]) -> dict[str, dt.datetime]:
        """Yesterday in UTC, for all: a day that is not over may still change."""
        day = dt.datetime.combine(dt.datetime.now(dt.UTC).date(), dt.time()) - dt.timedelta(days=1)
        return dict.fromkeys(tickers, day)

    def actions(self, tickers: list[str], kind: str, since: dt.datetime | None = None) -> Iterator[tuple]:
        name = {"dividends": "Dividends", "splits": "Stock Splits"}[kind]
        for t, frame in self._frames(tickers, since):
            if name in frame:
                paid = frame[name].dropna()
                yield from ((t, day.to_pydatetime(), float(x)) for day, x in paid[paid != 0].items())


def network():
    """The package that the network provider asks; an error at once where it is not installed."""
    try:
        import yfinance
    except ImportError as e:
        raise RuntimeError("quotes from the network need the package yfinance; --quotes FOLDER reads them from files") from e
    return yfinance


def tried(call: Callable[[], list], attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> list:
    """The result of call, tried again after a pause that doubles and jitters."""
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k == attempts - 1:
                raise
            wait(min(LONGEST_WAIT, FIRST_WAIT * 2**k) * random.uniform(0.5, 1.0))
    return []


class Batch(InputPartition):
    def __init__(self, tickers: list[str]) -> None:
        super().__init__(tickers)
        self.tickers = tickers


class QuoteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.provider: Provider = cloudpickle.loads(bytes.fromhex(options["provider"]))
        self.table = options.get("table", "history")
        self.groups = [x.split("\t") for x in options["batches"].split("\n") if x]
        self.attempts, self.pause = int(options.get("attempts", ATTEMPTS)), float(options.get("pause", PAUSE))
        self.since = dt.datetime.fromisoformat(options["since"]) if options.get("since") else None
        self.tickers: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take what narrows tickers and days; all filters are left to Spark as well.  A status is of all days that are there."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("Ticker",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tickers = named if self.tickers is None else self.tickers & named
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("Date",) and self.table in TABLES:
                self.since = f.value if self.since is None else max(self.since, f.value)
            yield f

    def partitions(self) -> list[Batch]:
        groups = [[t for t in g if self.tickers is None or t in self.tickers] for g in self.groups]
        return [Batch(g) for g in groups if g] or [Batch([])]

    def read(self, partition: Batch) -> Iterator[tuple]:
        if not partition.tickers:
            return
        kind = FETCHED.get(self.table, self.table)
        prices = kind in ("history", "status")
        span = () if self.since is None else (self.since,)
        fetch = (lambda t: self.provider.bars(t, *span)) if prices else lambda t: self.provider.actions(t, kind, *span)
        try:
            rows = tried(lambda: list(fetch(partition.tickers)), self.attempts, lambda s: time.sleep(s if self.pause else 0))
        except Exception as e:
            time.sleep(PAUSE_AFTER_FAILURE if self.pause else 0)
            rows, said = [], dict.fromkeys(partition.tickers, str(e) if prices else f"actions:{e}")
        else:
            time.sleep(self.pause)
            priced = {r[0] for r in rows if r[5] is not None} if prices else set()
            said = {t: "ok" if t in priced else "empty" for t in partition.tickers} if prices else {}
        if self.table == "status":
            yield from said.items()
        elif self.table in FETCHED:
            yield from ((*r, None) for r in rows)
            yield from ((t, *[None] * TABLES[kind].count(","), s) for t, s in said.items())
        else:
            yield from rows


class Days(InputPartition):
    """Tickers of a batch with new days, each with its last old day, if any, and its last new one."""

    def __init__(self, spans: dict[str, tuple[str | None, str]]) -> None:
        super().__init__(spans)
        self.spans = spans


class QuoteStream(DataSourceStreamReader):
    """New bars of each ticker.  What keeps failing fails the micro-batch, which runs again: no day is skipped."""

    def __init__(self, options: dict[str, str]) -> None:
        self.provider = cloudpickle.loads(bytes.fromhex(options["provider"]))
        self.groups = [x.split("\t") for x in options["batches"].split("\n") if x]
        self.attempts, self.pause = int(options.get("attempts", ATTEMPTS)), float(options.get("pause", PAUSE))

    def retried(self, call: Callable[[], list]) -> list:
        return tried(call, self.attempts, lambda s: time.sleep(s if self.pause else 0))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        days = {t: d.isoformat() for g in self.groups for t, d in self.retried(lambda g=g: list(self.provider.latest(g).items()))}
        return dict(sorted(days.items()))

    def partitions(self, start: dict, end: dict) -> list[Days]:
        spans = [{t: (start.get(t), end[t]) for t in g if t in end and (t not in start or start[t] < end[t])} for g in self.groups]
        return [Days(x) for x in spans if x]

    def read(self, partition: Days) -> Iterator[tuple]:
        day = dt.datetime.fromisoformat
        spans = {t: (day(a) if a else dt.datetime.min, day(b)) for t, (a, b) in partition.spans.items()}
        first = min(a for a, _ in spans.values())
        since = () if first == dt.datetime.min else (first,)
        rows = self.retried(lambda: list(self.provider.bars(list(spans), *since)))
        time.sleep(self.pause)
        yield from (r for r in rows if r[0] in spans and r[1] is not None and spans[r[0]][0] < r[1] <= spans[r[0]][1])


class Quotes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quotes"

    def schema(self) -> str:
        table = self.options.get("table", "history")
        return struct(f"{TABLES[FETCHED[table]]},status string" if table in FETCHED else {**TABLES, "status": STATUS}[table])

    def reader(self, schema) -> QuoteReader:
        return QuoteReader(self.options)

    def streamReader(self, schema) -> QuoteStream:
        if self.options.get("table", "history") != "history":
            raise ValueError("only the history is a stream")
        return QuoteStream(self.options)


def listed(universe: DataFrame, batch_size: int) -> str:
    """The universe's batches as an option: a line each, tickers between tabs."""
    groups = batches(universe, batch_size).groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("ord", "ticker"))).alias("t")).orderBy("batch").collect()
    return "\n".join("\t".join(x.ticker for x in r.t) for r in groups)


def fetch(spark: SparkSession, universe: DataFrame, provider: Provider, table: str = "history", batch_size: int = 30, **options: object) -> DataFrame:
    """Rows of a table for the universe's tickers (ticker, ord): history, dividends, splits, status, or one of FETCHED, which has rows and status.

    options: attempts, pause, and since, the first day wanted (ISO).
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # Spark refuses a source that takes filters where this is off
    spark.dataSource.register(Quotes)
    reader = spark.read.format("quotes").option("provider", cloudpickle.dumps(provider).hex()).option("table", table).option("batches", listed(universe, batch_size))
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def follow(spark: SparkSession, universe: DataFrame, provider: Provider, batch_size: int = 30, **options: object) -> DataFrame:
    """A stream of the universe's bars: at first all, then those of new days.  A ticker that joins later comes with its whole history.

    With the same checkpoint a restart neither repeats nor skips a bar.  options: attempts, pause.
    """
    spark.dataSource.register(Quotes)
    reader = spark.readStream.format("quotes").option("provider", cloudpickle.dumps(provider).hex()).option("batches", listed(universe, batch_size))
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()
