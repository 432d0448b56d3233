"""Streams: features with state against the batch, and quotes whose offset is a day for each ticker."""

from __future__ import annotations

import datetime as dt
import os
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.operators import indicators
from tidewright.sources import quotes
from tidewright.streaming import features, ingest

quotes.cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks cannot import this module
DAY = dt.datetime(2024, 1, 1)
BARS = "Ticker string, Date timestamp_ntz, Open double, High double, Low double, Close double, AdjClose double, Volume long"


def rows_of(ticker, prices, first=0):
    return [(ticker, DAY + dt.timedelta(days=first + k), x, x, x, x, x, 1) for k, x in enumerate(prices)]


def run(spark, folder, rows, **how):
    spark.createDataFrame(rows, BARS).write.mode("append").parquet(f"{folder}/in")
    features.append_features(ingest.bar_stream(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/state", **how).awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_features_of_a_stream_equal_the_batch(spark, tmp_path):
    draw = np.random.default_rng(3)
    series = {t: (100 + draw.normal(0, 1, 300).cumsum()).tolist() for t in ("A", "0700", "Ü")} | {"FLAT": [5.0] * 40, "ONE": [1.0], "NONE": [None] * 5, "ZERO": [0.0, 0.0, 1.0, 0.0] * 5}
    series["A"][50:60] = [None] * 10
    edges = [0, 1, 13, 14, 15, 200, 300]  # runs that end before, at and after the point where numbers begin
    for a, b in zip(edges, edges[1:]):
        made = run(spark, str(tmp_path), [r for t, x in series.items() for r in rows_of(t, x[a:b], a)], ma=(1, 5, 20, 200), rsi=(1, 3, 14))
    whole = indicators.add_features(spark.createDataFrame([r for t, x in series.items() for r in rows_of(t, x)], BARS), "AdjClose", (1, 5, 20, 200), (1, 3, 14))
    got, want = (d.toPandas().sort_values(["Ticker", "Date"]).reset_index(drop=True) for d in (made.where(~F.col("late")), whole))
    assert made.where("late").count() == 0 and len(got) == len(want) == 3 * 300 - 10 + 40 + 1 + 20
    pd.testing.assert_frame_equal(got[list(want.columns)], want, check_dtype=False, rtol=1e-9)
    assert made.columns[-1] == "late" and set(want.columns) == set(made.columns) - {"late"}


def test_bars_that_come_late_or_twice_are_marked_and_change_nothing(spark, tmp_path):
    run(spark, str(tmp_path), rows_of("A", [1.0, 2.0, 3.0]), ma=(2,), rsi=2)
    made = run(spark, str(tmp_path), [*rows_of("A", [9.0], 1), *rows_of("A", [9.0], -5), *rows_of("A", [4.0, 2.0], 3), *rows_of("A", [2.0], 4), (None, *rows_of("A", [1.0])[0][1:]), ("A", None, *rows_of("A", [1.0])[0][2:])], ma=(2,), rsi=2)
    rows = made.orderBy("Date", "late").collect()
    assert [(r.Date.day, r.MA_2, r.RSI_2 is None) for r in rows if not r.late] == [(1, None, True), (2, 1.5, True), (3, 2.5, False), (4, 3.5, False), (5, 3.0, False)]
    assert sorted(r.AdjClose for r in rows if r.late) == [2.0, 9.0, 9.0] and all(r.MA_2 is None and r.RSI_2 is None for r in rows if r.late)


def test_an_empty_stream_gives_the_columns(spark, tmp_path):
    made = run(spark, str(tmp_path), rows_of("A", []), ma=(3,), rsi=())
    assert made.columns[-2:] == ["MA_3", "late"] and made.count() == 0


@dataclass
class Growing:
    """Quotes of a file that tests write anew: ticker, number of days; notes calls, and fails while a file says so."""

    folder: str

    def known(self):
        return {t: int(n) for t, n in (x.split() for x in open(f"{self.folder}/days").read().splitlines())}

    def latest(self, tickers):
        return {t: DAY + dt.timedelta(days=n - 1) for t, n in self.known().items() if t in tickers}

    def bars(self, tickers, since=None):
        if os.path.exists(f"{self.folder}/down"):
            raise OSError("no answer")
        with open(f"{self.folder}/calls", "a") as f:
            f.write(f"{','.join(tickers)} {since}\n")
        return [r for t, n in self.known().items() if t in tickers for r in rows_of(t, [float(k) for k in range(n)]) if since is None or r[1] >= since]


def test_a_restart_neither_repeats_nor_skips_a_bar(spark, tmp_path):
    provider, seen = Growing(str(tmp_path)), []

    def follow(days, *tickers):
        (tmp_path / "days").write_text("".join(f"{t} {n}\n" for t, n in days.items()))
        universe = spark.createDataFrame([(t, k) for k, t in enumerate(tickers)], "ticker string, ord int")
        bars = quotes.follow(spark, universe, provider, batch_size=2, pause=0, attempts=1)
        keep = lambda batch, _: seen.extend((r.Ticker, r.Close) for r in batch.collect())
        bars.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted(seen)

    first = [("A", 0.0), ("A", 1.0), ("A", 2.0), ("B", 0.0)]
    assert follow({"A": 3, "B": 1}, "A", "B", "C") == first
    assert follow({"A": 3, "B": 1}, "A", "B", "C") == first  # nothing new
    (tmp_path / "down").write_text("")
    with pytest.raises(Exception, match="no answer"):
        follow({"A": 4, "B": 3, "C": 2}, "A", "B", "C")
    (tmp_path / "down").unlink()
    later = sorted([*first, ("A", 3.0), ("B", 1.0), ("B", 2.0), ("C", 0.0), ("C", 1.0)])  # B was behind A
    assert follow({"A": 4, "B": 3, "C": 2}, "A", "B", "C") == later
    assert follow({"A": 5, "B": 3, "C": 2, "D": 1}, "D", "A", "B", "C") == sorted([*later, ("A", 4.0), ("D", 0.0)])  # batches cut anew
    calls = (tmp_path / "calls").read_text().splitlines()
    assert calls[0] == "A,B None" and "A,B 2024-01-01 00:00:00" in calls and "C None" in calls  # days that are known are not asked for
