"""Event windows under every policy, and the analog search with its invariants."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewright.operators import indicators, match, windows

START = dt.datetime(2024, 1, 1)


def panel(spark, **tickers):
    rows = [(t, START + dt.timedelta(days=k), *(v if isinstance(v, tuple) else (v, v))) for t, values in tickers.items() for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "Ticker string, Date timestamp_ntz, AdjClose double, Close double")


def test_centre_is_100_and_edges_have_no_window(spark):
    swing = [50.0 + (7 * k) % 13 for k in range(33)]
    got = windows.event_windows(panel(spark, T=swing), 4, 6)
    rows = {(r.RefDate - START).days: r for r in got.where("Offset = 0").collect()}
    assert sorted(rows) == list(range(4, 27)) and all(r.AdjClose_Rebased == r.Close_Rebased == 100.0 and r.Date == r.RefDate for r in rows.values())
    last = got.where("Offset = 6").collect()
    assert all(r.Close_Rebased == pytest.approx(100 * swing[(r.Date - START).days] / swing[(r.RefDate - START).days]) for r in last) and len(last) == 23


def test_short_series_has_no_window(spark):
    assert windows.event_windows(panel(spark, T=[1.0, 2.0, 3.0]), 2, 1).count() == 0


def test_window_columns_stand_by_number(spark):
    found = indicators.add_features(panel(spark, T=[float(x) for x in range(1, 15)]), "Close", (10, 2), 3)
    got = windows.event_windows(found, 1, 1, "none")
    assert got.columns == ["Ticker", "RefDate", "Offset", "Date", "AdjClose_Rebased", "Close_Rebased", "MA_2_Rebased", "MA_10_Rebased", "RSI_3"]


def plain_windows(rows, before, after, policy, full):
    out = set()
    for c in range(before, len(rows) - after):
        ref = rows[c]
        if not any(ref):
            continue
        window = [(k, tuple(v / r * 100 if r and v is not None else None for v, r in zip(rows[c + k], ref, strict=True))) for k in range(-before, after + 1)]
        keep = {"none": lambda v: True, "any": lambda v: None not in v, "all": lambda v: any(x is not None for x in v)}[policy]
        kept = [(k, v) for k, v in window if keep(v)]
        if not (full and len(kept) < len(window)):
            out |= {(c, k, *v) for k, v in kept}
    return out


@pytest.mark.parametrize("policy", windows.POLICIES)
@pytest.mark.parametrize("full", [False, True])
def test_policies_against_a_plain_version(spark, policy, full):
    values = [(1.0, 2.0), (None, 3.0), (4.0, 0.0), (5.0, 5.0), (0.0, None), (0.0, 0.0), (2.0, 1.0), (3.0, 3.0), (4.0, 2.0), (None, None), (1.0, 1.0), (2.0, 2.0)]
    got = windows.event_windows(panel(spark, T=values), 2, 1, policy, full)
    found = {((r.RefDate - START).days, r.Offset, r.AdjClose_Rebased, r.Close_Rebased) for r in got.collect()}
    assert found == plain_windows(values, 2, 1, policy, full)


def search(spark, queries, reference, lookback=4, metric="mse", weights=None, n=3):
    columns = ("AdjClose_Rebased",)
    wide = windows.event_windows(reference.select("Ticker", "Date", "AdjClose"), lookback - 1, 2, "any", True)
    asked = match.query_points(queries, lookback, columns)
    return match.top_matches(match.scores(asked, wide, lookback, columns, metric, weights), n, 9), wide, asked


WAVE = [10.0, 11.0, 13.0, 12.0, 15.0, 14.0, 16.0, 18.0, 17.0, 20.0]


@pytest.mark.parametrize("metric", match.METRICS)
def test_a_window_matches_itself_with_0(spark, metric):
    best, _, _ = search(spark, panel(spark, Q=WAVE[2:6]), panel(spark, R=WAVE), metric=metric)
    first = best.where("Rank = 1").first()
    assert first.Score == pytest.approx(0, abs=1e-12) and (first.RefDate - START).days == 5


def test_constant_series_score_1_by_correlation(spark):
    best, _, _ = search(spark, panel(spark, Q=[7.0] * 4), panel(spark, R=WAVE), metric="corr")
    assert {r.Score for r in best.collect()} == {1.0}


def test_scaling_prices_changes_no_score(spark):
    one, _, _ = search(spark, panel(spark, Q=WAVE[:4]), panel(spark, R=WAVE))
    ten, _, _ = search(spark, panel(spark, Q=[10 * x for x in WAVE[:4]]), panel(spark, R=[3 * x for x in WAVE]))
    assert [(r.RefDate, pytest.approx(r.Score)) for r in one.orderBy("Rank").collect()] == [(r.RefDate, r.Score) for r in ten.orderBy("Rank").collect()]


def test_ties_stand_by_ticker_and_date(spark):
    best, _, _ = search(spark, panel(spark, Q=[1.0, 2.0, 3.0, 4.0]), panel(spark, B=[5.0] * 8, A=[5.0] * 8), n=4)
    assert [(r.MatchTicker, (r.RefDate - START).days) for r in best.orderBy("Rank").collect()] == [("A", 3), ("A", 4), ("A", 5), ("B", 3)]


def test_numpy_kernel_agrees(spark):
    _, wide, asked = search(spark, panel(spark, Q=WAVE[:4], P=WAVE[3:7]), panel(spark, R=WAVE, S=WAVE[::-1]))
    for metric in match.METRICS:
        a = match.scores(asked, wide, 4, ("AdjClose_Rebased",), metric)
        b = match.match_in_arrays(asked, wide, 4, ("AdjClose_Rebased",), metric)
        key = ["QueryTicker", "MatchTicker", "RefDate"]
        rows = [{(*(r[k] for k in key),): r.Score for r in x.collect()} for x in (a, b)]
        assert rows[0].keys() == rows[1].keys() and all(rows[0][k] == pytest.approx(rows[1][k], abs=1e-9) for k in rows[0])


def test_query_blocks_give_the_same(spark, monkeypatch):
    _, wide, asked = search(spark, panel(spark, Q=WAVE[:4], P=WAVE[3:7], O=WAVE[5:9]), panel(spark, R=WAVE))
    whole = match.scores(asked, wide, 4, ("AdjClose_Rebased",))
    monkeypatch.setattr(match, "QUERY_BLOCK", 1)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, match.scores(asked, wide, 4, ("AdjClose_Rebased",)).collect()))


def test_weights(spark):
    assert match.parsed_weights(None, ["a", "b"]) == [1.0, 1.0]
    with pytest.raises(ValueError):
        match.parsed_weights([1.0], ["a", "b"])
    best, _, _ = search(spark, panel(spark, Q=WAVE[:4]), panel(spark, R=WAVE), weights=[0.0])
    assert {r.Score for r in best.collect()} == {0.0}


def test_bad_queries_are_reported_and_the_others_go_on(spark):
    data = panel(spark, OK=WAVE, SHORT=[1.0], HOLE=[1.0, 2.0, None, 3.0], ZERO=[1.0, 2.0, 3.0, 0.0])
    status = {r.QueryTicker: r.status for r in match.query_status(data, 4, ("AdjClose_Rebased",)).collect()}
    assert status == {"OK": "ok", "SHORT": "short", "HOLE": "missing", "ZERO": "missing"}
    assert {r.QueryTicker for r in match.query_points(data, 4, ("AdjClose_Rebased",)).collect()} == {"OK"}


def test_futures_count_positions_and_hide_infinities(spark):
    wide = spark.createDataFrame([("R", START, k, v) for k, v in ((0, 1.0), (1, 2.0), (3, float("inf")), (4, 5.0))], "Ticker string, RefDate timestamp_ntz, Offset int, X double")
    day = spark.createDataFrame([("Q", "R_rebased.parquet", "R", START)], "QueryTicker string, SourceFile string, MatchTicker string, RefDate timestamp_ntz")
    assert [(r.FutureOffset, r.X) for r in match.futures(day, wide, 4, ("X",)).orderBy("FutureOffset").collect()] == [(1, 2.0), (2, None), (3, 5.0)]
    empty = match.futures(day, wide, 0, ("X",))
    assert empty.count() == 0 and empty.columns == ["QueryTicker", "MatchTicker", "RefDate", "FutureOffset", "X"]


def test_plot_frame_takes_the_first_matches(spark):
    best, wide, asked = search(spark, panel(spark, Q=WAVE[:4]), panel(spark, R=WAVE))
    shown = match.plot_frame(asked, match.futures(best, wide, 2, ("AdjClose_Rebased",)), "AdjClose_Rebased", 2)
    assert shown.select("series").distinct().count() == 3 and shown.where(F.col("series") == "query").count() == 4
