"""Long series in blocks, and the analog search by blocks, against whole series and plain scores."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import ewm
from tidewright.operators import analogs, blocks, indicators, match, windows

START = dt.datetime(2000, 1, 1)
COLUMNS = ("AdjClose_Rebased", "MA_3_Rebased")


def panel(spark, lengths, seed=1, holes=0.1):
    """Random walks with missing days, missing values and zeros."""
    draw, rows = np.random.default_rng(seed), []
    for t, n in lengths.items():
        days = np.cumsum(draw.integers(1, 6, n))
        for d, x in zip(days.tolist(), (50 + np.cumsum(draw.normal(0, 1, n))).tolist(), strict=True):
            kind = draw.random()
            rows.append((t, START + dt.timedelta(days=d), None if kind < holes else 0.0 if kind < 1.3 * holes else x, x, None if draw.random() < holes else x * 2))
    return spark.createDataFrame(rows, "Ticker string, Date timestamp_ntz, AdjClose double, Close double, MA_3 double")


def rows_of(df, *columns):
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


def same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(u == v or u == pytest.approx(v, rel=1e-9, abs=1e-9) for u, v in zip(x, y, strict=True))


# blocks


def test_places_without_sorting_a_series(spark):
    data = panel(spark, {"A": 400, "B": 7, "C": 1})
    got = blocks.numbered(data).withColumn("want", F.row_number().over(indicators.by_date()) - 1)
    assert got.where("__rn <> want").count() == 0
    assert {(r.Ticker, r["__n"]) for r in got.collect()} == {("A", 400), ("B", 7), ("C", 1)}
    assert blocks.numbered(data.limit(0)).count() == 0


@pytest.mark.parametrize(("before", "after", "size"), [(0, 0, 10), (3, 0, 10), (4, 6, 10), (25, 12, 10), (5, 5, 1000)])
def test_every_row_is_where_it_is_looked_at(spark, before, after, size):
    got = blocks.cut(panel(spark, {"A": 57, "B": 10, "C": 1}), before, after, size).collect()
    want = {(t, k, r) for t, n in (("A", 57), ("B", 10), ("C", 1)) for k in range(-(-n // size)) for r in range(max(0, k * size - before), min(n, (k + 1) * size + after))}
    assert {(r.Ticker, r["__block"], r["__rn"]) for r in got} == want and len(got) == len(want)


def test_features_in_blocks_are_those_of_whole_series(spark):
    data = panel(spark, {"A": 700, "B": 90, "C": 2}).select("Ticker", "Date", "AdjClose", "Close")
    whole = indicators.add_features(data, "AdjClose", (3, 40), (2, 14))
    names = whole.columns
    assert names == ["Ticker", "Date", "Close", "AdjClose", "MA_3", "MA_40", "RSI_2", "RSI_14"]
    for block in (16, 64, 100_000):
        cut = indicators.add_features(data, "AdjClose", (3, 40), (2, 14), block=block)
        assert cut.columns == names
        same(rows_of(cut, *names), rows_of(whole, *names))
    same(rows_of(indicators.add_features(data, "AdjClose", (3, 40), (2, 14), route="pandas"), *names), rows_of(whole, *names))


@pytest.mark.parametrize("policy", windows.POLICIES)
@pytest.mark.parametrize("full", [False, True])
def test_windows_in_blocks_are_those_of_whole_series(spark, policy, full):
    data = panel(spark, {"A": 120, "B": 30, "C": 4}).select("Ticker", "Date", "AdjClose", "Close")
    whole = windows.event_windows(data, 6, 3, policy, full)
    same(rows_of(windows.event_windows(data, 6, 3, policy, full, block=11), *whole.columns), rows_of(whole, *whole.columns))


def test_one_series_is_dealt_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        data = panel(spark, {"A": 2000}, holes=0).select("Ticker", "Date", "AdjClose", "Close")
        wide = windows.event_windows(data, 6, 3, "any", True, block=100)
        assert wide.select(F.spark_partition_id()).distinct().count() > 1
        assert windows.event_windows(data, 6, 3, "any", True).select(F.spark_partition_id()).distinct().count() == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# smoothing


def recursion(x, alpha):
    out, y = [], None
    for v in x:
        y = v if y is None else (1 - alpha) * y + alpha * v
        out.append(y)
    return np.array(out)


@pytest.mark.parametrize("size", [None, 2048])
def test_smoothing_of_a_million_rows_equals_the_recursion(spark, size):
    n, alpha = 1_000_000, 1 / 14
    values = np.abs(np.sin(np.arange(n) * 0.37)) * (np.arange(n) % 1000 < 900)
    base = spark.range(n).select(F.lit("T").alias("Ticker"), F.col("id").alias("Date"), F.when((F.col("id") % 1000) < 900, F.abs(F.sin(F.col("id") * 0.37))).otherwise(0.0).alias("x"))
    rows = base.withColumns({"__rn": F.col("Date"), "__n": F.lit(n).cast("long")})
    got = ewm.recursive_means(blocks.cut(rows, 1, 0, size), {"y": (F.col("x"), alpha)}, size)
    found = got.where("Date % 997 = 0 or Date >= 999000").select("Date", "y").orderBy("Date").toPandas()
    want = recursion(values, alpha)[found["Date"].to_numpy()]
    assert len(found) > 1900 and np.allclose(found["y"], want, rtol=1e-9, atol=1e-300)


@pytest.mark.parametrize("size", [None, 8, 40])
@pytest.mark.parametrize("length", [1, 2, 5, 14, 300])
def test_smoothing_starts_with_the_first_change(spark, size, length):
    x = [None, 3.0, 0.0, 0.0, 5.0, *[1.0] * 60, *[0.0] * 200]
    rows = spark.createDataFrame([("T", START + dt.timedelta(days=k), v) for k, v in enumerate(x)], "Ticker string, Date timestamp_ntz, x double")
    got = ewm.recursive_means(blocks.cut(rows, 1, 0, size), {"y": (F.col("x"), 1 / length)}, size).orderBy("Date").collect()
    assert got[0].y is None and len(got) == len(x)
    assert [r.y for r in got[1:]] == pytest.approx(recursion(x[1:], 1 / length).tolist(), rel=1e-9)


def test_a_long_flat_end_keeps_the_ratio_of_gains_and_losses(spark):
    prices = [10.0, 11.0, 10.5, 12.0, 11.0, *[11.0] * 400]
    data = spark.createDataFrame([("T", START + dt.timedelta(days=k), v) for k, v in enumerate(prices)], "Ticker string, Date timestamp_ntz, AdjClose double")
    moves = np.diff(prices)
    g, l = recursion(np.maximum(moves, 0), 1 / 3)[-1], recursion(np.maximum(-moves, 0), 1 / 3)[-1]
    for block in (None, 50):
        last = indicators.add_features(data, "AdjClose", (), 3, block=block).orderBy(F.col("Date").desc()).first()
        assert last.RSI_3 == pytest.approx(100 - 100 / (1 + g / l), rel=1e-9)


# the search


def asked_of(data, lookback, columns=COLUMNS):
    return match.query_points(data, lookback, columns)


@pytest.mark.parametrize("policy", windows.POLICIES)
@pytest.mark.parametrize("full", [False, True])
@pytest.mark.parametrize("block", [None, 13])
def test_windows_of_series_are_those_in_files(spark, policy, full, block):
    data = panel(spark, {"A": 90, "B": 40, "C": 5}, holes=0.04)
    asked = asked_of(panel(spark, {"Q": 12, "P": 9}, 7, 0), 5)
    search = analogs.search_of(5, COLUMNS, "mse", [2.0, 1.0], horizon=3, top=4, places=9)
    wide = windows.event_windows(data, 6, 3, policy, full)
    stored, series = analogs.closest(asked, analogs.Stored(wide), search), analogs.closest(asked, analogs.OfSeries(data, 6, 3, policy, full, block), search)
    names = ["QueryTicker", "Rank", "SourceFile", "MatchTicker", "RefDate", "Score"]
    plain = match.top_matches(match.scores(asked, wide, 5, COLUMNS, "mse", [2.0, 1.0]), 4, 9)
    same(rows_of(stored, *names), rows_of(plain, *names))
    same(rows_of(series, *names), rows_of(plain, *names))
    after = match.futures(plain, wide, 3, COLUMNS)
    for found in (stored, series):
        same(rows_of(analogs.futures_of(found), *after.columns), rows_of(after, *after.columns))
        assert analogs.futures_of(found).columns == after.columns


@pytest.mark.parametrize("metric", match.METRICS)
def test_a_grid_of_blocks_gives_the_same(spark, monkeypatch, metric):
    data = panel(spark, {"A": 150, "B": 60}, 3, 0.02)
    asked = asked_of(panel(spark, {f"Q{k}": 8 for k in range(7)}, 5, 0), 5)
    search = analogs.search_of(5, COLUMNS, metric, horizon=2, top=3, places=9)
    one = analogs.closest(asked, analogs.OfSeries(data, 6, 3), search)
    want, after = rows_of(one, "QueryTicker", "Rank", "MatchTicker", "RefDate", "Score"), rows_of(analogs.futures_of(one), "QueryTicker", "RefDate", "FutureOffset", *COLUMNS)
    monkeypatch.setattr(analogs, "QUERY_BLOCK", 2)
    monkeypatch.setattr(analogs, "CELL_ROWS", 60)
    for given in (analogs.OfSeries(data, 6, 3, block=20), analogs.Stored(windows.event_windows(data, 6, 3, "any", True))):
        many = analogs.closest(asked, given, search)
        same(rows_of(many, "QueryTicker", "Rank", "MatchTicker", "RefDate", "Score"), want)
        same(rows_of(analogs.futures_of(many), "QueryTicker", "RefDate", "FutureOffset", *COLUMNS), after)


def test_more_queries_than_a_block(spark):
    reference = spark.createDataFrame([("R", START, k, float(100 + k)) for k in range(-2, 1)], "Ticker string, RefDate timestamp_ntz, Offset int, X double")
    asked = spark.range(2001).select(F.col("id").cast("string").alias("QueryTicker"), F.explode(F.array(*[F.struct(F.lit(k).alias("Offset"), F.lit(100.0 + k).alias("X")) for k in range(-2, 1)])).alias("p"))
    asked = asked.select("QueryTicker", "p.*")
    for found in (match.match_in_arrays(asked, reference, 3, ("X",)), match.scores(asked, reference, 3, ("X",))):
        assert found.count() == 2001 and found.where("Score <> 0").count() == 0


def test_what_is_shuffled_is_the_best_of_each_task(spark):
    data = panel(spark, {"A": 3000}, holes=0)
    search = analogs.search_of(5, COLUMNS, top=3)
    found = analogs.matches(asked_of(panel(spark, {"Q": 9, "P": 9}, 2, 0), 5), analogs.OfSeries(data, 6, 3, block=50), search)
    by_task = found.groupBy(F.spark_partition_id(), "QueryTicker").count().collect()
    assert all(r["count"] <= 3 for r in by_task) and found.count() < 3000 / 10


def test_windows_are_in_the_plan_once(spark):
    data = panel(spark, {"A": 60})
    best = analogs.closest(asked_of(panel(spark, {"Q": 9}, 2, 0), 5), analogs.OfSeries(data, 6, 3), analogs.search_of(5, COLUMNS, horizon=3, top=3))
    plan = analogs.futures_of(best)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Join") == 0


@pytest.mark.parametrize("metric", match.METRICS)
def test_ties_constants_and_infinities(spark, metric):
    flat = spark.createDataFrame([(t, START + dt.timedelta(days=k), float("inf") if t == "Z" and k == 20 else 5.0) for t in "BAZ" for k in range(40)], "Ticker string, Date timestamp_ntz, AdjClose double")
    asked = match.query_points(flat.where("Ticker = 'A'"), 4, ("AdjClose_Rebased",))
    search = analogs.search_of(4, ("AdjClose_Rebased",), metric, top=30)
    got = analogs.closest(asked, analogs.OfSeries(flat, 4, 2), search).orderBy("Rank").collect()
    assert [(r.MatchTicker, (r.RefDate - START).days) for r in got] == [("A", k) for k in range(4, 34)]
    assert {r.Score for r in got} == {0.0 if metric == "mse" else 1.0}


def test_rough_scores_bound_exact_ones():
    draw = np.random.default_rng(6)
    search = analogs.search_of(75, COLUMNS, "mse", [1.0, 0.3])
    queries, wide = 100 + draw.normal(0, 300, (6, 2, 75)), 100 + draw.normal(0, 300, (200, 2, 75))
    wide[:6] = queries + 1e-7
    rough, off = analogs.Scorer(search, queries).nearly(wide)
    exact = np.stack([analogs.scores_of(search, wide, np.repeat(q[None], 200, 0)) for q in queries], axis=1)
    assert (np.abs(rough - exact) <= off).all()


def test_nothing_to_find(spark):
    data = panel(spark, {"A": 30})
    search = analogs.search_of(5, COLUMNS, horizon=2, top=3)
    none = asked_of(data.limit(0), 5)
    assert analogs.closest(none, analogs.OfSeries(data, 6, 3), search).count() == 0
    assert analogs.closest(asked_of(panel(spark, {"Q": 9}, 2, 0), 5), analogs.OfSeries(data.limit(0), 6, 3), search).count() == 0
    assert analogs.closest(asked_of(panel(spark, {"Q": 9}, 2, 0), 5), analogs.OfSeries(data, 2, 3), search).count() == 0
    with pytest.raises(ValueError):
        analogs.search_of(5, COLUMNS, "cosine")
