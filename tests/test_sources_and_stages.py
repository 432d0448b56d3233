"""The source of quotes and what reaches its provider, settings and checks made while planning, and what a dry run leaves behind."""

from __future__ import annotations

import datetime as dt
import os
import sys
import types
from dataclasses import dataclass

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pyspark import cloudpickle

from tidewright import config
from tidewright.plans import stages
from tidewright.schema import require
from tidewright.sources import files, quotes

DAY = dt.datetime(2024, 1, 1)
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks do not have this module


@dataclass
class Counting:
    """Ten days for each ticker; writes down, for each call, what was asked for."""

    folder: str

    def bars(self, tickers, since=None):
        import uuid

        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(f"{','.join(sorted(tickers))} {since}")
        days = [DAY + dt.timedelta(days=k) for k in range(10)]
        return [(t, d, 1.0, 1.0, 1.0, 1.0, 1.0, 1) for t in tickers for d in days if since is None or d >= since]

    def actions(self, tickers, kind, since=None):
        return [(t, DAY, 2.0) for t in tickers if since is None or DAY >= since]

    def calls(self):
        return sorted(open(f"{self.folder}/{n}").read() for n in os.listdir(self.folder))


def universe(spark, *tickers):
    return spark.createDataFrame([(t, k) for k, t in enumerate(tickers)], "ticker string, ord int")


def test_filters_reach_the_provider(spark, tmp_path):
    provider = Counting(str(tmp_path))
    asked = quotes.fetch(spark, universe(spark, "A", "B", "C", "D"), provider, batch_size=2, pause=0)
    rows = asked.where(F.col("Ticker").isin("A", "D") & (F.col("Date") >= F.lit(DAY + dt.timedelta(days=7)).cast("timestamp_ntz"))).collect()
    assert sorted((r.Ticker, r.Date.day) for r in rows) == [(t, d) for t in "AD" for d in (8, 9, 10)]
    assert provider.calls() == ["A 2024-01-08 00:00:00", "D 2024-01-08 00:00:00"]


def test_the_option_reaches_the_provider(spark, tmp_path):
    provider = Counting(str(tmp_path))
    assert quotes.fetch(spark, universe(spark, "A", "B"), provider, pause=0, since="2024-01-09").count() == 4
    assert provider.calls() == ["A,B 2024-01-09 00:00:00"]
    assert quotes.fetch(spark, universe(spark, "A"), provider, "splits", pause=0, since="2024-01-09").count() == 0


def test_no_ticker_left_asks_nobody(spark, tmp_path):
    provider = Counting(str(tmp_path))
    assert quotes.fetch(spark, universe(spark, "A"), provider, pause=0).where("Ticker = 'Z'").count() == 0
    assert provider.calls() == []


def frame(tickers, fields, rows):
    index = pd.DatetimeIndex([pd.Timestamp("2024-01-02", tz="Europe/Copenhagen"), pd.Timestamp("2024-01-03", tz="Europe/Copenhagen")])
    columns = pd.MultiIndex.from_product([tickers, fields]) if tickers else fields
    return pd.DataFrame(rows, index=index, columns=columns)


FIELDS = ["Open", "High", "Low", "Close", "Adj Close", "Volume", "Dividends", "Stock Splits"]
ROW, LATER, NONE = [1.0, 2.0, 0.5, 1.5, 1.4, 7.0, 0.0, 0.0], [2.0, 3.0, 1.5, 2.5, 2.4, 8.0, 0.3, 4.0], [float("nan")] * 8


@pytest.fixture
def network(monkeypatch):
    asked = []

    def answered(result):
        def download(tickers, **how):
            asked.append((list(tickers), how))
            return result

        monkeypatch.setitem(sys.modules, "yfinance", types.SimpleNamespace(download=download))
        return asked

    return answered


def test_a_batch_is_one_call(network):
    asked = network(frame(["A", "B"], FIELDS, [ROW + NONE, LATER + NONE]))
    got = list(quotes.NetworkProvider().bars(["A", "B", "GONE"]))
    assert got == [("A", dt.datetime(2024, 1, 1, 23), *ROW[:5], 7), ("A", dt.datetime(2024, 1, 2, 23), *LATER[:5], 8)]
    (tickers, how), = asked
    assert tickers == ["A", "B", "GONE"] and how["period"] == "max" and how["group_by"] == "ticker" and how["threads"] is False and how["auto_adjust"] is False


def test_one_ticker_without_a_level_of_tickers(network):
    asked = network(frame(None, FIELDS, [ROW, LATER]))
    provider = quotes.NetworkProvider()
    assert [r[0] for r in provider.bars(["A"], dt.datetime(2023, 5, 6))] == ["A", "A"]
    assert asked[0][1]["start"] == "2023-05-06" and "period" not in asked[0][1]
    assert list(provider.actions(["A"], "dividends")) == [("A", dt.datetime(2024, 1, 2, 23), 0.3)]
    assert list(provider.actions(["A"], "splits")) == [("A", dt.datetime(2024, 1, 2, 23), 4.0)]


def test_nothing_from_the_network(network):
    network(pd.DataFrame())
    assert list(quotes.NetworkProvider().bars(["A"])) == [] and list(quotes.NetworkProvider().actions(["A"], "splits")) == []


def test_a_missing_package_is_said_at_once(spark, monkeypatch, capsys):
    from tidewright.__main__ import main

    monkeypatch.setitem(sys.modules, "yfinance", None)
    assert main(["fetch", "--input", "anything.csv"], spark) == 1
    assert "yfinance" in capsys.readouterr().err


@pytest.mark.parametrize("incremental", [False, True])
def test_a_dry_run_leaves_nothing(spark, tmp_path, monkeypatch, incremental):
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    listed, out = tmp_path / "list.csv", tmp_path / "out"
    listed.write_text("ticker\nA\nB\n")
    (tmp_path / "calls").mkdir()
    got = stages.fetch_stage(spark, config.Fetch(input=str(listed), out=str(out), dry_run=True, actions=True, incremental=incremental), Counting(str(tmp_path / "calls")), pause=0)
    assert got.history.count() == 20 and not out.exists()


@dataclass
class Newest:
    """A year of days up to today for every ticker, at prices of their own."""

    def bars(self, tickers, since=None):
        today = dt.datetime.now(dt.UTC).replace(tzinfo=None, hour=0, minute=0, second=0, microsecond=0)
        days = [today - dt.timedelta(days=k) for k in range(365)]
        return [(t, d, *[100.0 + len(t) + d.day] * 5, 1) for t in tickers for d in days if since is None or d >= since]


def test_queries_that_features_lack_are_fetched(spark, tmp_path):
    from tidewright.operators import indicators, windows

    rows = spark.createDataFrame([("A", DAY + dt.timedelta(days=k), 10.0 + k % 7, 10.0 + k % 7) for k in range(60)], "Ticker string, Date timestamp_ntz, AdjClose double, Close double")
    found = indicators.add_features(rows, "AdjClose", (20,), ())
    found.write.partitionBy("Ticker").parquet(f"{tmp_path}/features.parquet")
    windows.event_windows(found, 6, 2, "any", True).write.parquet(f"{tmp_path}/rebased")
    (tmp_path / "watch.csv").write_text("Ticker\nA\nNEW\n")
    settings = config.Match(watch=f"{tmp_path}/watch.csv", ref_dir=f"{tmp_path}/rebased", lookback=5, horizon=2, topn=3, match_cols="AdjClose_Rebased,MA_20_Rebased", query_from_features=True, query_features_dir=f"{tmp_path}/features.parquet")
    for provider, asked in ((None, {"A"}), (Newest(), {"A", "NEW"})):
        scores, after, status = stages.match_stage(spark, settings, provider, write=False)
        assert {(r.QueryTicker, r.status) for r in status.collect()} == {(t, "ok") for t in asked}
        assert sorted(r.QueryTicker for r in scores.collect()) == sorted([*asked] * 3) and after.count() == 6 * len(asked)


def test_what_is_asked_for_and_not_listed_is_said(spark, tmp_path, capsys):
    from tidewright.__main__ import main

    spark.createDataFrame([("A", DAY, *[1.0] * 5, 1)], "Ticker string, Date timestamp_ntz, Open double, High double, Low double, Close double, AdjClose double, Volume long").write.parquet(f"{tmp_path}/q/history.parquet")
    (tmp_path / "list.csv").write_text("ticker\nA\nB\n")
    assert main(["fetch", "--quotes", f"{tmp_path}/q", "--input", f"{tmp_path}/list.csv", "--only", "A,ZZ,YY", "--out", f"{tmp_path}/o", "--dry-run"], spark) == 0
    assert capsys.readouterr().err.splitlines()[-2:] == ["not in the list: YY", "not in the list: ZZ"]


def test_pauses_between_batches(spark, tmp_path, monkeypatch):
    waited = []
    monkeypatch.setattr(quotes.time, "sleep", waited.append)
    reader = quotes.QuoteReader({"provider": quotes.cloudpickle.dumps(Counting(str(tmp_path))).hex(), "batches": "A\tB\nC"})
    assert len(list(reader.read(quotes.Batch(["A", "B"])))) == 20 and waited == [0.5]

    class Broken(Counting):
        def bars(self, tickers, since=None):
            raise OSError("no answer")

    waited.clear()
    reader = quotes.QuoteReader({"provider": quotes.cloudpickle.dumps(Broken(str(tmp_path))).hex(), "batches": "A", "table": "status"})
    assert list(reader.read(quotes.Batch(["A"]))) == [("A", "no answer")]
    assert len(waited) == 5 and all(0.5 <= w <= 8 for w in waited[:4]) and waited[-1] == 1.0


@pytest.mark.parametrize("inferred", ["true", "false"])
def test_tickers_stay_text_in_any_session(spark, tmp_path, inferred):
    name = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(name)
    rows = spark.createDataFrame([(t, DAY, 1.0, 1.0, 5.0) for t in ("0700", "0005", "7")], "Ticker string, Date timestamp_ntz, Close double, AdjClose double, MA_3 double")
    out = str(tmp_path / "f.parquet")
    rows.write.partitionBy("Ticker").parquet(out)
    spark.conf.set(name, inferred)
    try:
        found = [files.read_features_input(spark, out), files.load_data(spark, out), files.read_query_features(spark, out, rows.select("Ticker"), ["Close"])]
        for df in found:
            assert {r.Ticker for r in df.select("Ticker").collect()} == {"0700", "0005", "7"}
        assert spark.conf.get(name) == inferred
    finally:
        spark.conf.set(name, before)


def test_columns_that_a_stage_needs(spark):
    with pytest.raises(ValueError, match="input lacks columns: Date, Close"):
        require(spark.createDataFrame([("A",)], "Ticker string"), ["Ticker", "Date", "Close"])


def test_the_first_input_that_is_there(spark, tmp_path):
    (tmp_path / "b.csv").write_text("x\n")
    at = lambda *names: files.first_existing(spark, *[f"{tmp_path}/{n}" for n in names]).rsplit("/", 1)[1]
    assert (at("a.csv", "b.csv"), at("b.csv", "a.csv"), at("a.csv", "c.csv")) == ("b.csv", "b.csv", "a.csv")


#: Fixed values of the presets, where they differ from the defaults.
PRESETS = {
    ("Fetch", "standard"): {"input": "tickers.csv", "out": "data_all", "float_dp": 4, "partition_by": "Ticker", "incremental": True, "actions": True},
    ("Fetch", "fast"): {"input": "tickers.csv", "out": "data_all", "float_dp": 4, "partition_by": "Ticker", "incremental": True, "batch_size": 20},
    ("Fetch", "validate"): {"input": "tickers.csv", "out": "data_all", "validate_only": True},
    ("Features", "standard"): {"partition_by": "Ticker", "csv": "features.csv", "use_adjclose": True, "float_dp": 4},
    ("Windows", "standard"): {
        **{"input": "features.parquet", "before": 75, "after": 25, "per_ticker": True, "float_dp": 4, "format": "both", "csv_head": 1000, "csv_tail": 1000},
        **{"drop_rows_if_nan": "any", "require_full_window": True},
    },
}


def test_presets_and_a_flag_beside_one():
    from dataclasses import fields

    kinds = {k.__name__: k for k in config.PRESETS}
    assert {(k.__name__, p) for k, named in config.PRESETS.items() for p in named} == set(PRESETS)
    for (kind, preset), want in PRESETS.items():
        made = config.configured(kinds[kind], preset)
        assert {f.name: getattr(made, f.name) for f in fields(made) if getattr(made, f.name) != f.default} == want
    assert config.from_flags(config.Windows, ["--preset", "standard", "--before=60"]).before == 60


def test_days_are_dealt_out_whole_and_in_order(spark, tmp_path):
    """The messy input of the readers' queries: no task holds all rows, none holds a part of a ticker's day."""
    from tidewright import stored_queries

    orders = [(k, k % 40, dt.date(1995, 1, 1 + k % 28), float(k)) for k in range(2_000)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, f"S{k % 5}") for k in range(40)], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        rows = stored_queries.messy(spark, str(tmp_path)).withColumns({"task": F.spark_partition_id(), "nth": F.monotonically_increasing_id()}).orderBy("nth").collect()
    finally:
        spark.conf.set(name, before)
    assert len(rows) == 2_000 and len({r.task for r in rows}) > 1
    tasks, prices = {}, {}
    for r in rows:
        if r.Date != "no date":
            tasks.setdefault((r.Ticker, r.Date), set()).add(r.task)
        prices.setdefault(r.task, []).append(float(r.AdjClose))
    assert all(len(x) == 1 for x in tasks.values()) and all(p == sorted(p) for p in prices.values())
