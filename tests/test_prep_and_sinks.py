"""Normalising, deduplicating, merging, scalar rules, sinks, comparison, presets, the quote source and the chained stages."""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from tidewright import config
from tidewright.functions import scalars
from tidewright.operators import compare, indicators, prep, report
from tidewright.plans import stages
from tidewright.schema import HISTORY, HISTORY_COLUMNS, struct
from tidewright.sinks import tables
from tidewright.sources import files, quotes
from tidewright.streaming import ingest

START = dt.datetime(2024, 1, 1)


def history(spark, **tickers):
    rows = [(t, START + dt.timedelta(days=k), *([float(v)] * 5), 100 + k) for t, values in tickers.items() for k, v in enumerate(values)]
    return spark.createDataFrame(rows, struct(HISTORY))


def test_empty_vendor_frame_keeps_the_schema(spark):
    raw = spark.createDataFrame([], "Date string, seq int")
    got = prep.normalize_prices(raw, "AAPL", "seq")
    assert got.columns == HISTORY_COLUMNS and got.count() == 0


def test_vendor_frame_is_renamed_and_typed(spark):
    raw = spark.createDataFrame([("2024-01-01", 1.0, "2.5", 7.0, 0), ("2024-01-01", 9.0, "9", 9.0, 1), ("2024-01-02", 1.0, "n/a", float("nan"), 2)], "Date string, Open double, `Adj Close` string, Volume double, seq int")
    got = prep.normalize_prices(raw, "X", "seq").orderBy("Date").collect()
    assert [(r.Ticker, r.Date.day, r.Open, r.AdjClose, r.Volume, r.Close) for r in got] == [("X", 1, 1.0, 2.5, 7, None), ("X", 2, 1.0, None, None, None)]


def test_local_midnight_is_the_day_before_in_utc(spark):
    raw = spark.createDataFrame([("2024-01-02 00:00:00", 0), ("2024-07-02 00:00:00", 1)], "Date string, seq int")
    got = [r.Date for r in prep.normalize_prices(raw, "X", "seq", "Europe/Copenhagen").orderBy("Date").collect()]
    assert [(d.day, d.hour) for d in got] == [(1, 23), (1, 22)]


def test_first_and_last_of_a_key(spark):
    rows = spark.createDataFrame([("A", START, v, k) for k, v in enumerate((1.0, 2.0, 3.0))], "Ticker string, Date timestamp_ntz, v double, seq int")
    assert prep.keep_first(rows, "seq").first().v == 1.0 and prep.keep_last(rows, "seq").first().v == 3.0


def test_merge_keeps_what_is_stored(spark):
    old, new = history(spark, A=[1.0, 2.0], B=[5.0]), history(spark, A=[9.0, 9.0, 3.0]).withColumn("seq", F.lit(1))
    got = {(r.Ticker, r.Date.day): r.Close for r in prep.incremental_merge(old, new, "seq").collect()}
    assert got == {("A", 1): 1.0, ("A", 2): 2.0, ("A", 3): 3.0, ("B", 1): 5.0}
    assert prep.incremental_merge(None, new, "seq").count() == 3


def test_scalars(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    assert pick(scalars.fixed(F.lit(0.12345), 4)) == "0.1234"
    assert [pick(scalars.safe_filename(F.lit(x))) for x in ("BRK/B", " x y ", "", "0700", "nan")] == ["BRK_B", "x_y", "NA", "0700", "nan"]
    assert pick(scalars.split_list(F.lit(" a, ,b ,"))) == ["a", "b"]
    assert pick(scalars.to_number(F.lit("x"))) is None and pick(scalars.to_number(F.lit("NaN"))) is None
    assert pick(scalars.base_name(F.lit("MA_20_Rebased"))) == "MA_20"
    assert pick(scalars.gain(F.lit(None).cast("double"))) is None and pick(scalars.loss(F.lit(-2.0))) == 2.0
    assert pick(scalars.rebased(F.lit(1.0), F.lit(0.0))) is None


@pytest.mark.parametrize("head,tail,kept", [(None, None, 6), (2, 1, 3), (3, 3, 6), (9, 9, 6), (2, None, 2), (0, 0, 0), (-1, 2, 2)])
def test_head_and_tail(spark, head, tail, kept):
    assert tables.head_and_tail(history(spark, A=range(6)).withColumn("k", F.lit(1)), head, tail, ["Ticker"], ["Date"]).count() == kept


def test_rewriting_replaces_touched_partitions_only(spark, tmp_path):
    out = str(tmp_path / "t")
    tables.write_parquet(history(spark, A=[1.0], B=[2.0]), out, "Ticker")
    tables.write_parquet(history(spark, A=[7.0]), out, "Ticker")
    assert {r.Ticker: r.Close for r in spark.read.parquet(out).collect()} == {"A": 7.0, "B": 2.0}


def test_ticker_like_partitions_stay_text(spark, tmp_path):
    tables.save_prices(history(spark, **{"0700": [1.0], "005930": [2.0]}), str(tmp_path), partition_by="Ticker")
    assert {r.Ticker for r in files.read_history(spark, str(tmp_path)).collect()} == {"0700", "005930"}
    assert files.read_ticker_history(spark, str(tmp_path), "0700").count() == 1
    assert files.read_history(spark, str(tmp_path / "none")) is None


def test_compare(spark):
    left, right = history(spark, A=[1.0, 2.0, 3.0]), history(spark, A=[1.0, 2.1, 3.0])
    rows = {r.column: r for r in compare.compare(left, right).collect()}
    assert rows["Close"].mismatches == 1 and rows["Volume"].mismatches == 0 and rows["Volume"].unpaired == 0
    same = compare.verdict(left, left).first()
    assert same.all_match and same.mismatched == ""
    other = compare.verdict(left, right.where("Close <> 3")).first()
    assert not other.all_match and (other.left_rows, other.right_rows) == (3, 2)
    holes = compare.compare(left, right.withColumn("Open", F.lit(None).cast("double"))).where("column = 'Open'").first()
    assert (holes.left_nulls, holes.right_nulls, holes.mismatches) == (0, 3, 0)


def test_universe(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_text(" Ticker ,name\n AAPL ,x\nMSFT,y\nAAPL,z\n,w\n")
    universe, missing = files.read_table(spark, str(path), ["MSFT", "ZZZ"])
    assert [r.ticker for r in universe.collect()] == ["MSFT"] and [r.ticker for r in missing.collect()] == ["ZZZ"]
    everything, _ = files.read_table(spark, str(path))
    assert [r.ticker for r in everything.orderBy("ord").collect()] == ["AAPL", "MSFT"]
    path.write_text("name\nx\n")
    with pytest.raises(ValueError):
        files.read_table(spark, str(path))


def test_presets():
    std = config.configured(config.Windows, "standard")
    assert (std.before, std.after, std.drop_rows_if_nan, std.require_full_window) == (75, 25, "any", True)
    assert config.from_flags(config.Windows, ["--before=60", "--preset", "standard"]).before == 60
    assert config.from_flags(config.Windows, ["--csv-head", "5"]).before == 50
    assert config.from_flags(config.Features, []).float_dp == 4
    assert config.configured(config.Fetch, "fast").batch_size == 20 and config.configured(config.Fetch, "validate").validate_only
    with pytest.raises(ValueError):
        config.configured(config.Features, "fast")


def failing_provider():
    start = START

    class Failing:  # local, so that it travels with the job
        def bars(self, tickers):
            if "BAD" in tickers:
                raise OSError("no answer")
            return [(t, start, 1.0, 1.0, 1.0, 1.0, 1.0, 5) for t in tickers if t != "NONE"]

        def actions(self, tickers, kind):
            return [(t, start, 0.5) for t in tickers]

    return Failing()


def test_a_failing_batch_does_not_stop_the_others(spark):
    universe = spark.createDataFrame([("A", 0), ("NONE", 1), ("BAD", 2), ("B", 3)], "ticker string, ord int")
    rows = quotes.fetch(spark, universe, failing_provider(), batch_size=2, attempts=2, pause=0)
    status = {r.Ticker: r.status for r in quotes.fetch(spark, universe, failing_provider(), "status", 2, attempts=2, pause=0).collect()}
    assert {r.Ticker for r in rows.collect()} == {"A"} and status == {"A": "ok", "NONE": "empty", "BAD": "no answer", "B": "no answer"}
    assert quotes.fetch(spark, universe.where("ticker <> 'BAD'"), failing_provider(), "splits", 2, pause=0).count() == 3
    summary = report.run_summary(spark.createDataFrame(list(status.items()), "ticker string, status string")).first()
    assert tuple(summary) == (4, 1, 3, 1)


def test_attempts_pause_longer_and_longer():
    waits, calls = [], []

    def call():
        calls.append(1)
        raise OSError

    with pytest.raises(OSError):
        quotes.tried(call, 5, waits.append)
    assert len(calls) == 5 and len(waits) == 4 and all(w <= quotes.LONGEST_WAIT for w in waits)


def test_stages_end_to_end(spark, tmp_path):
    days = [10 + 0.1 * k + (k % 7) for k in range(60)]
    (tmp_path / "quotes").mkdir()
    history(spark, AAA=days, BBB=[2 * x + (k % 3) for k, x in enumerate(days)]).toPandas().to_parquet(tmp_path / "quotes/history.parquet")
    (tmp_path / "list.csv").write_text("ticker\nAAA\nBBB\nCCC\n")
    out = str(tmp_path / "data")
    fetch = config.Fetch(input=str(tmp_path / "list.csv"), out=out, incremental=True, partition_by="Ticker", float_dp=4)
    (tmp_path / "data").mkdir()
    for _ in range(2):
        got = stages.fetch_stage(spark, fetch, quotes.FolderProvider(str(tmp_path / "quotes")), pause=0)
    assert files.read_history(spark, out).count() == 120 and got.summary.first().empty_series == 1
    assert json.loads((tmp_path / "data/run_report.json").read_text())["failed"] == [{"ticker": "CCC", "reason": "empty"}]
    features = config.Features(input=f"{out}/history_all_parquet", out=f"{out}/features.parquet", csv=f"{out}/features.csv", ma=(5, 10), rsi=6, use_adjclose=True, partition_by="Ticker", float_dp=4)
    assert stages.features_stage(spark, features).count() == 120
    wide = config.Windows(input=f"{out}/features.parquet", out=f"{out}/rebased", per_ticker=True, before=5, after=3, format="both", csv_head=10, csv_tail=10, float_dp=4, drop_rows_if_nan="any", require_full_window=True)
    made = stages.windows_stage(spark, wide)
    assert made.count() == 2 * (60 - 9 - 8) * 9 and {r.AdjClose_Rebased for r in made.where("Offset = 0").collect()} == {100.0}
    assert spark.read.option("header", True).csv(f"{out}/rebased/rebased_csv").count() == 40
    (tmp_path / "watch.csv").write_text("Ticker\nAAA\nNOPE\n")
    asked = config.Match(watch=str(tmp_path / "watch.csv"), ref_dir=f"{out}/rebased/rebased_parquet", lookback=6, horizon=3, topn=4, match_cols="AdjClose_Rebased,MA_5_Rebased", query_from_features=True, query_features_dir=f"{out}/features.parquet", out_dir=f"{out}/analog")
    best, after, status = stages.match_stage(spark, asked)
    assert best.count() == 4 and after.count() == 12 and {r.status for r in status.collect()} == {"ok"}
    assert spark.read.parquet(f"{out}/analog/scores").count() == 4


def test_stream_appends_each_bar_once(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    history(spark, A=[1.0, 2.0]).write.parquet(source)
    ingest.append_history(ingest.bar_stream(spark, source), out, state).awaitTermination()
    history(spark, A=[9.0, 9.0, 3.0]).write.mode("append").parquet(source)
    ingest.append_history(ingest.bar_stream(spark, source), out, state).awaitTermination()
    assert sorted(r.Close for r in spark.read.parquet(out).collect()) == [1.0, 2.0, 3.0]


def test_stream_keeps_bars_that_come_late(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    history(spark, A=[1.0] * 400).where("Date >= '2025-01-01'").write.parquet(source)
    for more in ({"B": [2.0] * 400}, {"A": [3.0] * 400}, {}):
        ingest.append_history(ingest.bar_stream(spark, source), out, state).awaitTermination()
        if more:
            history(spark, **more).coalesce(1).write.mode("append").parquet(source)
    rows = spark.read.parquet(out).collect()
    assert len(rows) == len({(r.Ticker, r.Date) for r in rows}) == 800
    assert all(r.Close == (2.0 if r.Ticker == "B" else 1.0 if r.Date.year == 2025 else 3.0) for r in rows)


def test_windows_profile_of_features_input(spark, tmp_path):
    history(spark, A=[1.0, 2.0]).union(history(spark, A=[5.0])).write.parquet(str(tmp_path / "x.parquet"))
    got = files.read_features_input(spark, str(tmp_path / "x.parquet"))
    assert got.count() == 2
    assert indicators.add_features(got, "Close", (2,), ()).count() == 2
    with pytest.raises(ValueError):
        files.read_any(spark, "x.json")


def test_each_batch_is_downloaded_once(spark, tmp_path):
    @dataclass
    class CountingProvider:
        """Leaves a file for each download."""

        folder: str

        def bars(self, tickers):
            open(f"{self.folder}/{uuid.uuid4().hex}", "w").close()
            if "BAD" in tickers:
                raise OSError("no answer")
            return [(t, dt.datetime(2024, 3, d), 1.0, 2.0, 0.5, None if t == "NONE" else 1.5, 1.5, 10) for t in tickers for d in (1, 4)]

        def actions(self, tickers, kind):
            return []

    (tmp_path / "calls").mkdir()
    (tmp_path / "list.csv").write_text("ticker\nONE\nNONE\nBAD\n")
    fetch = config.Fetch(input=str(tmp_path / "list.csv"), out=str(tmp_path / "out"), batch_size=1, incremental=True, actions=False, fail_on_empty=5)
    for run in (1, 2):
        got = stages.fetch_stage(spark, fetch, CountingProvider(str(tmp_path / "calls")), pause=0, attempts=1)
        assert len(os.listdir(tmp_path / "calls")) == 3 * run
        assert {r.ticker: r.status for r in got.status.collect()} == {"ONE": "ok", "NONE": "empty", "BAD": "no answer"}
        assert got.history.where("Ticker = 'ONE'").count() == 2
        assert len(os.listdir(tmp_path / "calls")) == 3 * run
