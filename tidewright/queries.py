"""Registered queries of the price-panel engine, on bars derived from the transaction tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .functions.ewm import recursive_means
from .operators import analogs, blocks, compare, indicators, match, prep, report, windows
from .plans.bars import bars, bars_of, bars_with_gaps, brand_ticks, table, ticks
from .sinks.tables import head_and_tail

Query = Callable[[SparkSession, str], DataFrame]
#: Small windows for whole results; the presets' sizes are used for profiles.
BEFORE, AFTER, LOOKBACK, HORIZON, TOP = 20, 5, 21, 5, 10
MATCH = ("AdjClose_Rebased", "MA_5_Rebased", "MA_10_Rebased")
WEIGHTS = (2.0, 1.0, 0.5)
#: Decimal places of values, and of summed-up scores, which run into the millions.
PLACES, SCORE_PLACES = 6, 3


def shown(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Dates as text, counts as longs, doubles to a few places: what two engines can agree on."""
    kinds = dict(df.dtypes)
    out = {}
    for c, t in kinds.items():
        if t == "timestamp_ntz":
            out[c] = F.date_format(c, "yyyy-MM-dd")
        elif t == "int":
            out[c] = F.col(c).cast("long")
        elif t == "double":
            out[c] = F.round(c, places)
    return df.withColumns(out) if out else df


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.add_features(bars(spark, sf_dir), "AdjClose", (5, 10), (), places=True)


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.event_windows(_features(spark, sf_dir), BEFORE, AFTER, "any", True)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.query_points(_features(spark, sf_dir), LOOKBACK, MATCH)


def _scores(spark: SparkSession, sf_dir: str, metric: str = "mse", weights=None) -> DataFrame:
    return match.scores(_asked(spark, sf_dir), _windows(spark, sf_dir), LOOKBACK, MATCH, metric, weights)


def _top(spark: SparkSession, sf_dir: str, metric: str = "mse", weights=None, horizon: int = 0, block: int | None = None) -> DataFrame:
    """The best windows, found in blocks of series, and what followed them."""
    search = analogs.search_of(LOOKBACK, MATCH, metric, weights, horizon, TOP, 9)
    return analogs.closest(_asked(spark, sf_dir), analogs.OfSeries(_features(spark, sf_dir), BEFORE, AFTER, block=block), search)


def _gap_windows(policy: str, full: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(windows.event_windows(bars_with_gaps(spark, sf_dir).select("Ticker", "Date", "AdjClose", "Close"), 4, 2, policy, full))

    return run


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "orders").select(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")).alias("name"), F.col("o_orderkey").alias("ord"))
    return prep.clean_tickers(lists, "name", "ord")


def _wanted(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("1-URGENT",), ("5-LOW",), ("9-NONE",)], "ticker string")


def universe_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.only(universe(spark, sf_dir), _wanted(spark))


def universe_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.unknown(universe(spark, sf_dir), _wanted(spark))


def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = ticks(spark, sf_dir).select(
        F.col("Ticker").alias("t"),
        F.date_format("Date", "yyyy-MM-dd").alias("Date"),
        F.col("price").cast("string").alias("Open"),
        F.when(F.col("seq") % 5 == 0, "n/a").otherwise(F.col("price").cast("string")).alias("Close"),
        (F.col("price") / 2).alias("Adj Close"),
        (F.col("seq") % 100).cast("double").alias("Volume"),
        "seq",
    )
    return shown(prep.normalize_prices(raw, F.col("t"), "seq"))


def local_midnight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Midnight in a zone as naive UTC: an hour or two before, so on the day before."""
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").cast("timestamp_ntz").alias("local")).distinct()
    return days.select(F.date_format("local", "yyyy-MM-dd").alias("local"), F.date_format(scalars.naive_utc(F.col("local"), "Europe/Copenhagen"), "yyyy-MM-dd HH:mm").alias("utc"))


def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = ticks(spark, sf_dir)
    stored = prep.keep_first(trades.where("seq % 3 = 0"), "seq").select("Ticker", "Date", (F.col("price") * 10).alias("price"))
    return shown(prep.incremental_merge(stored, trades, "seq"))


def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = bars(spark, sf_dir)
    both = days.select("Ticker", "Date", "Close").unionByName(days.select("Date", "Ticker", F.col("Volume").cast("double").alias("Volume")), allowMissingColumns=True)
    return shown(both)


def delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(bars(spark, sf_dir).select("Ticker", "Date", indicators.delta(F.col("Close"), indicators.by_date()).alias("delta")))


def averages(*lengths: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = indicators.add_features(bars(spark, sf_dir), "Close", lengths, ())
        return shown(found.select("Ticker", "Date", *[f"MA_{n}" for n in lengths]))

    return run


def averages_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(match.query_averages(bars_with_gaps(spark, sf_dir), "AdjClose", (3, 5)).select("Ticker", "Date", "MA_3", "MA_5"))


def smoothed(size: int | None) -> Query:
    """Smoothed gains and losses, in blocks of so many rows or by whole series."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = indicators.changes("AdjClose", blocks.in_block(size), blocks.cut(bars(spark, sf_dir), 1, 0, size))
        means = recursive_means(rows, {"gain": (F.col("__g"), 1 / 14), "loss": (F.col("__l"), 1 / 14)}, size)
        return shown(means.select("Ticker", "Date", "gain", "loss"), 4)

    return run


def rsi(flat: bool = False, route: str = "jvm") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        days = bars(spark, sf_dir)
        days = days.withColumn("AdjClose", F.lit(5.0)) if flat else days
        return shown(indicators.add_features(days, "AdjClose", (), 14, route).select("Ticker", "Date", "RSI_14"))

    return run


def features_full(spark: SparkSession, sf_dir: str, block: int | None = None) -> DataFrame:
    return shown(indicators.add_features(bars_with_gaps(spark, sf_dir), "AdjClose", (20, 50, 200), 14, block=block))


def ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(windows.ordinals(bars(spark, sf_dir)).select("Ticker", "Date", "rn", "n"))


def windows_with_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = indicators.add_features(bars(spark, sf_dir).select("Ticker", "Date", "Close", "AdjClose"), "AdjClose", (5,), 3)
    return shown(windows.event_windows(found, 3, 2, "any", False))


def windows_profile(spark: SparkSession, sf_dir: str, block: int | None = None) -> DataFrame:
    """The preset's windows, [-75, 25], summed up by offset."""
    found = indicators.add_features(bars(spark, sf_dir).select("Ticker", "Date", "Close", "AdjClose"), "AdjClose", (20, 50, 200), (), block=block, places=True)
    wide = windows.event_windows(found, 75, 25, "any", True, block)
    return shown(wide.groupBy("Offset").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"avg_{c}") for c in wide.columns if c.endswith("_Rebased")]))


def brand_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = bars_of(brand_ticks(spark, sf_dir)).select("Ticker", "Date", "Close", "AdjClose")
    wide = windows.event_windows(indicators.add_features(days, "AdjClose", (20,), ()), 10, 5, "all", False)
    return shown(wide.groupBy("Ticker", "Offset").agg(F.count("*").alias("n"), F.avg("AdjClose_Rebased").alias("avg_adj"), F.avg("MA_20_Rebased").alias("avg_ma")))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_asked(spark, sf_dir))


def query_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = bars_with_gaps(spark, sf_dir)
    short = days.where("Ticker <> 'BUILDING' or Date >= timestamp_ntz'1998-07-20'")
    return match.query_status(short.withColumn("MA_5", F.col("Close")), LOOKBACK, ("AdjClose_Rebased", "MA_5_Rebased"))


def window_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.event_windows(bars_with_gaps(spark, sf_dir).select("Ticker", "Date", "AdjClose", "Close"), 4, 2, "all", False)
    return shown(match.complete_windows(rows, ("AdjClose_Rebased", "Close_Rebased"), 5).select("MatchTicker", "RefDate"))


def scores_profile(metric: str, weights=None) -> Query:
    """All scores of all queries and windows, summed up by query and matched ticker."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _scores(spark, sf_dir, metric, weights)
        return shown(found.groupBy("QueryTicker", "MatchTicker").agg(F.count("*").alias("n"), F.avg("Score").alias("avg_score"), F.min("Score").alias("min_score"), F.max("Score").alias("max_score")), SCORE_PLACES)

    return run


def arrays_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analogs.all_scores(_asked(spark, sf_dir), analogs.OfSeries(_features(spark, sf_dir), BEFORE, AFTER), analogs.search_of(LOOKBACK, MATCH))
    return shown(found.groupBy("QueryTicker", "MatchTicker").agg(F.count("*").alias("n"), F.avg("Score").alias("avg_score"), F.min("Score").alias("min_score"), F.max("Score").alias("max_score")), SCORE_PLACES)


def many_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth day's last rows as a query of its own, against all windows: a query set of any size, block by block."""
    found = _features(spark, sf_dir)
    ends = windows.event_windows(found, LOOKBACK - 1, 0, "any", True).where(F.dayofyear("RefDate") % 10 == 0)
    asked = ends.select(F.concat_ws(" ", "Ticker", F.date_format("RefDate", "yyyy-MM-dd")).alias("QueryTicker"), "Offset", *MATCH)
    search = analogs.search_of(LOOKBACK, MATCH, top=2, places=SCORE_PLACES)
    best = analogs.closest(asked, analogs.OfSeries(found, BEFORE, AFTER), search)
    return shown(best.select("QueryTicker", "Rank", "MatchTicker", "RefDate", "Score"), SCORE_PLACES)


def top(metric: str, weights=None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(_top(spark, sf_dir, metric, weights).select("QueryTicker", "Rank", "MatchTicker", "RefDate", "SourceFile", "Score"))

    return run


def futures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(analogs.futures_of(_top(spark, sf_dir, horizon=HORIZON)))


def futures_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the policy dropped leave no gap in FutureOffset."""
    rows = windows.event_windows(bars_with_gaps(spark, sf_dir).select("Ticker", "Date", "AdjClose"), 2, 4, "any", False)
    days = rows.where("Offset = 0").select(F.lit("Q").alias("QueryTicker"), F.concat("Ticker", F.lit("_rebased.parquet")).alias("SourceFile"), F.col("Ticker").alias("MatchTicker"), "RefDate")
    return shown(match.futures(days, rows, 4, ("AdjClose_Rebased",)))


def all_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match.with_run(_top(spark, sf_dir), LOOKBACK, HORIZON, "mse", MATCH)
    return shown(found.select("QueryTicker", "MatchTicker", "RefDate", "Score", "SourceFile", "Lookback", "Horizon", "Metric", "MatchCols"))


def plot_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = analogs.futures_of(_top(spark, sf_dir, horizon=HORIZON))
    return shown(match.plot_frame(_asked(spark, sf_dir), after, "AdjClose_Rebased", 5))


def csv_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(head_and_tail(bars(spark, sf_dir).select("Ticker", "Date", "Close"), 30, 20, ["Ticker"], ["Date"]))


def round_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.fixed(F.col("o_totalprice") / 7.0, 4).alias("shown"))


def safe_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "orders").select(F.concat(F.lit(" "), F.replace("o_orderpriority", F.lit("-"), F.lit('/:"')), F.lit(" x")).alias("name")).distinct()
    odd = spark.createDataFrame([("BRK/B",), ("  ",), ("a<>b c",), ("0700",)], "name string")
    return names.union(odd).select("name", scalars.safe_filename(F.col("name")).alias("safe"))


def split_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "customer").select(F.concat("c_mktsegment", F.lit(" ,, "), F.col("c_nationkey").cast("string"), F.lit(" ,")).alias("cell")).distinct()
    return cells.select("cell", F.array_join(scalars.split_list(F.col("cell")), "|").alias("entries"))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.batches(universe(spark, sf_dir), 2)


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = bars_with_gaps(spark, sf_dir).withColumn("Close", F.when(F.col("Ticker") != "MACHINERY", F.col("Close")))
    listed = days.select(F.col("Ticker").alias("ticker")).distinct().union(spark.createDataFrame([("NONE",)], "ticker string"))
    return report.run_summary(report.ticker_status(listed, days))


def _copies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    left = bars(spark, sf_dir).select("Ticker", "Date", "Open", "Close", "Volume")
    day = F.dayofyear("Date")
    right = left.where(day % 97 != 0).withColumns(
        {"Close": F.when(day % 31 == 0, F.col("Close") * 1.01).when(day % 29 == 0, None).otherwise(F.col("Close")), "Open": F.col("Open") * (1 + 1e-7)}
    )
    return left, right


def diff_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.compare(*_copies(spark, sf_dir))


def diff_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.verdict(*_copies(spark, sf_dir))


def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each type of event, by time, then identifier."""
    events = table(spark, sf_dir, "events").withColumn("seq", F.struct("ts", "event_id"))
    return shown(prep.keep_last(events, "seq", ("event_type",)).select("event_type", "event_id", "value"))


def dedup(keep: Callable[[DataFrame, str], DataFrame]) -> Query:
    return lambda spark, sf_dir: shown(keep(ticks(spark, sf_dir), "seq"))


QUERIES: dict[str, Query] = {
    "universe_distinct": universe,
    "universe_only_semi": universe_only,
    "universe_missing_anti": universe_missing,
    "normalize_prices": normalize,
    "local_midnight": local_midnight,
    "bars": lambda spark, sf_dir: shown(bars(spark, sf_dir)),
    "brand_bars": lambda spark, sf_dir: shown(bars_of(brand_ticks(spark, sf_dir))),
    "adjusted_only": lambda spark, sf_dir: shown(prep.adjusted_only(bars(spark, sf_dir)).select("Ticker", "Date", "Close")),
    "dedup_first": dedup(prep.keep_first),
    "dedup_last": dedup(prep.keep_last),
    "latest_event": latest_event,
    "incremental_merge": merge,
    "union_by_name": union_by_name,
    "drop_null_price": lambda spark, sf_dir: shown(bars_with_gaps(spark, sf_dir).where("AdjClose is not null").select("Ticker", "Date", "AdjClose")),
    "delta": delta,
    "ma_single": averages(20),
    "ma_multi": averages(20, 50, 200),
    "ma_with_gaps": averages_with_gaps,
    "ewm_gain_loss": smoothed(None),
    "ewm_in_blocks": smoothed(97),
    "rsi": rsi(),
    "rsi_pandas_route": rsi(route="pandas"),
    "rsi_flat": rsi(flat=True),
    "features_full": features_full,
    "features_in_blocks": lambda spark, sf_dir: features_full(spark, sf_dir, 256),
    "ordinal": ordinal,
    "windows_none": _gap_windows("none", False),
    "windows_any": _gap_windows("any", False),
    "windows_all": _gap_windows("all", False),
    "windows_full_any": _gap_windows("any", True),
    "windows_full_all": _gap_windows("all", True),
    "windows_with_rsi": windows_with_rsi,
    "windows_profile": windows_profile,
    "windows_in_blocks": lambda spark, sf_dir: windows_profile(spark, sf_dir, 256),
    "brand_profile": brand_profile,
    "query_vectors": query_vectors,
    "query_status": query_status,
    "window_complete": window_complete,
    "score_mse": scores_profile("mse"),
    "score_corr": scores_profile("corr"),
    "score_weighted": scores_profile("mse", WEIGHTS),
    "score_mse_arrays": arrays_profile,
    "topn_matches": top("mse"),
    "topn_corr_weighted": top("corr", WEIGHTS),
    "futures": futures,
    "futures_in_blocks": lambda spark, sf_dir: shown(analogs.futures_of(_top(spark, sf_dir, horizon=HORIZON, block=256))),
    "score_many_queries": many_queries,
    "futures_positional": futures_positional,
    "all_scores": all_scores,
    "plot_frame": plot_frame,
    "csv_sample": csv_sample,
    "round_dp": round_places,
    "safe_filename": safe_filename,
    "split_lists": split_lists,
    "batches": batches,
    "ticker_counts": lambda spark, sf_dir: report.ticker_counts(bars(spark, sf_dir)),
    "ticker_nunique": lambda spark, sf_dir: report.ticker_total(bars(spark, sf_dir)),
    "run_summary": run_summary,
    "diff_columns": diff_columns,
    "diff_verdict": diff_verdict,
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars, averages and RSI, event windows, and the closest analogs of each ticker's last days, in one plan."""
    return top("mse")(spark, sf_dir)
