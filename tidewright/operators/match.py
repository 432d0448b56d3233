"""Analog search: a query's last days against all reference windows, the closest ones, and what followed them.

Window points meet query points by Offset, so windows are scanned once for all queries, and scoring is a hash
aggregate whose partial sums shrink each window to one row per query before anything is shuffled.  For the best matches
alone, or for many queries, see analogs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import rebased
from ..schema import finite, require
from . import analogs
from .analogs import METRICS, parsed_weights
from .indicators import by_date, moving_average

#: Queries whose points are broadcast at once; more meet the windows in blocks.
QUERY_BLOCK = analogs.QUERY_BLOCK
DEFAULT_COLUMNS = ("AdjClose_Rebased", "MA_20_Rebased", "MA_50_Rebased", "MA_200_Rebased")
WINDOW = ["SourceFile", "MatchTicker", "RefDate"]


def base_of(name: str) -> str:
    return name.removesuffix("_Rebased")


def query_averages(df: DataFrame, price: str = "AdjClose", windows: Sequence[int] = (20, 50, 200)) -> DataFrame:
    """Moving averages for a fetched query: a gap in the price is a gap in the average (rows are not dropped first)."""
    return df.withColumns({f"MA_{w}": moving_average(F.col(price), w, by_date()) for w in windows})


def calendar_days(trading_days: int) -> int:
    """Days of the calendar that are asked for to get so many days of trading."""
    return int(trading_days * 2.5)


def days_needed(lookback: int, longest: int = 200) -> int:
    """Days of trading that a query needs: its own, and those that the longest average runs over before."""
    return longest + lookback


def recent(df: DataFrame, trading_days: int, today: Column | None = None) -> DataFrame:
    """df's rows of the calendar days that hold about so many days of trading, up to today."""
    newest = F.current_date() if today is None else today
    return df.where(F.col("Date") >= F.date_sub(newest, calendar_days(trading_days)).cast("timestamp_ntz"))


def rebased_to_last(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with each <base>_Rebased: the base column over its ticker's last value, times 100; null if that is null, 0 or infinite."""
    require(df, [base_of(c) for c in columns])
    whole = by_date().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = {c: F.last(base_of(c)).over(whole) for c in columns}
    return df.withColumns({c: F.when(finite(last[c]), rebased(F.col(base_of(c)), last[c])) for c in columns})


def last_rows(df: DataFrame, n: int) -> DataFrame:
    """The last n rows of each ticker, with __back (1 for the last one); places that df already has are used."""
    counted = "__rn" in df.columns
    back = F.col("__n") - F.col("__rn") if counted else F.row_number().over(Window.partitionBy("Ticker").orderBy(F.col("Date").desc()))
    return df.withColumn("__back", back.cast("int")).where(F.col("__back") <= n)


def query_points(df: DataFrame, lookback: int, columns: Sequence[str] = DEFAULT_COLUMNS) -> DataFrame:
    """QueryTicker, Offset (1 - lookback to 0), one column each: the last ``lookback`` rows of each ticker, rebased to the last one.

    A ticker with too few rows, or with a value missing, has no points; query_status says why.
    """
    rows = rebased_to_last(last_rows(df, lookback), columns)
    counts = Window.partitionBy("Ticker")
    fine = F.count("*").over(counts) == lookback
    for c in columns:
        fine = fine & (F.count(c).over(counts) == lookback)
    return rows.withColumn("__fine", fine).where("__fine").select(F.col("Ticker").alias("QueryTicker"), (1 - F.col("__back")).alias("Offset"), *columns)


def query_status(df: DataFrame, lookback: int, columns: Sequence[str] = DEFAULT_COLUMNS) -> DataFrame:
    """QueryTicker, status: ok, short (too few rows), or missing (a value or a usable last value is)."""
    rows = rebased_to_last(last_rows(df, lookback), columns)
    counts = rows.groupBy(F.col("Ticker").alias("QueryTicker")).agg(F.count("*").alias("n"), *[F.count(c).alias(f"__n{k}") for k, c in enumerate(columns)])
    whole = F.lit(True)
    for k in range(len(columns)):
        whole = whole & (F.col(f"__n{k}") == lookback)
    return counts.select("QueryTicker", F.when(F.col("n") < lookback, "short").when(~whole, "missing").otherwise("ok").alias("status"))


def reference_points(windows: DataFrame, columns: Sequence[str], first: int, last: int) -> DataFrame:
    """SourceFile, MatchTicker, RefDate, Offset and the match columns of the windows' rows with Offset in [first, last]."""
    require(windows, ["Ticker", "RefDate", "Offset", *columns])
    source = F.col("SourceFile") if "SourceFile" in windows.columns else F.concat("Ticker", F.lit("_rebased.parquet"))
    rows = windows.where(F.col("Offset").between(first, last))
    return rows.select(source.alias("SourceFile"), F.col("Ticker").alias("MatchTicker"), "RefDate", "Offset", *columns)


def complete_windows(windows: DataFrame, columns: Sequence[str], lookback: int) -> DataFrame:
    """SourceFile, MatchTicker, RefDate of windows that have ``lookback`` rows up to the reference day and no value missing."""
    points = reference_points(windows, columns, 1 - lookback, 0)
    counts = points.groupBy(*WINDOW).agg(F.count("*").alias("__n"), *[F.count(c).alias(f"__n{k}") for k, c in enumerate(columns)])
    fine = F.col("__n") == lookback
    for k in range(len(columns)):
        fine = fine & (F.col(f"__n{k}") == lookback)
    return counts.where(fine).select(*WINDOW)


def distance(metric: str, a: Column, b: Column) -> Column:
    """Aggregate over the points of a window.  corr: 1 - Pearson, and 1 if either side is constant."""
    if metric == "mse":
        return F.avg((a - b) * (a - b))
    if metric == "corr":
        return 1 - F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0))
    raise ValueError(f"metric is one of {METRICS}")


def scores(queries: DataFrame, windows: DataFrame, lookback: int, columns: Sequence[str] = DEFAULT_COLUMNS, metric: str = "mse", weights: Sequence[float] | None = None) -> DataFrame:
    """QueryTicker, SourceFile, MatchTicker, RefDate, Score of every query (its points) and complete window; lower is closer.

    A ticker is matched with its own history too.  Weights that sum to 0 are divided by 1.
    """
    weights = parsed_weights(weights, columns)
    total = sum(weights) or 1.0
    points = reference_points(windows, columns, 1 - lookback, 0)
    if queries.select("QueryTicker").distinct().count() > QUERY_BLOCK:
        return match_in_arrays(queries, windows, lookback, columns, metric, weights)
    asked = queries.select("QueryTicker", "Offset", *[F.col(c).alias(f"__q_{c}") for c in columns])
    met = points.join(F.broadcast(asked), "Offset")  # QUERY_BLOCK x lookback points at most
    sums = met.groupBy("QueryTicker", *WINDOW).agg(
        F.count("*").alias("__n"),
        *[F.count(c).alias(f"__n{k}") for k, c in enumerate(columns)],
        *[distance(metric, F.col(c), F.col(f"__q_{c}")).alias(f"__s{k}") for k, c in enumerate(columns)],
    )
    fine, score = F.col("__n") == lookback, F.lit(0.0)
    for k, w in enumerate(weights):
        fine, score = fine & (F.col(f"__n{k}") == lookback), score + F.lit(w) * F.col(f"__s{k}")
    return sums.where(fine).select("QueryTicker", *WINDOW, (score / total).alias("Score"))


def top_matches(scored: DataFrame, n: int, places: int | None = None) -> DataFrame:
    """The n lowest scores of each query, with their Rank; ties go by source file, ticker and date.  places: round scores before ranking."""
    score = F.col("Score") if places is None else F.round("Score", places)
    order = Window.partitionBy("QueryTicker").orderBy(score, "SourceFile", "MatchTicker", "RefDate")
    return scored.withColumn("Rank", F.row_number().over(order)).where(F.col("Rank") <= n)


def with_run(matches: DataFrame, lookback: int, horizon: int, metric: str, columns: Sequence[str]) -> DataFrame:
    """The combined score table's constant columns."""
    return matches.withColumns({"Lookback": F.lit(lookback), "Horizon": F.lit(horizon), "Metric": F.lit(metric), "MatchCols": F.lit(",".join(columns))})


def futures(matches: DataFrame, windows: DataFrame, horizon: int, columns: Sequence[str] = DEFAULT_COLUMNS) -> DataFrame:
    """QueryTicker, MatchTicker, RefDate, FutureOffset and the match columns after each matched day.

    FutureOffset counts the rows that the window has after its day, so it differs from Offset where rows were dropped.
    Infinite values are null.  A horizon of 0 gives an empty table with these columns.
    """
    after = reference_points(windows, columns, 1, horizon)
    met = matches.select("QueryTicker", *WINDOW).join(after, WINDOW)
    place = F.row_number().over(Window.partitionBy("QueryTicker", *WINDOW).orderBy("Offset"))
    return met.select("QueryTicker", "MatchTicker", "RefDate", place.alias("FutureOffset"), *[F.when(finite(F.col(c)), F.col(c)).alias(c) for c in columns])


def plot_frame(queries: DataFrame, future: DataFrame, column: str, top: int = 5) -> DataFrame:
    """What a plot shows: the query's line (series "query") and the first ``top`` matches' futures by ticker and date."""
    place = F.dense_rank().over(Window.partitionBy("QueryTicker").orderBy("MatchTicker", "RefDate"))
    label = F.concat_ws(" ", "MatchTicker", F.date_format("RefDate", "yyyy-MM-dd"))
    shown = future.withColumn("__k", place).where(F.col("__k") <= top)
    lines = shown.select("QueryTicker", label.alias("series"), F.col("FutureOffset").alias("x"), F.col(column).alias("y"))
    return queries.select("QueryTicker", F.lit("query").alias("series"), F.col("Offset").alias("x"), F.col(column).alias("y")).unionByName(lines)


def match_in_arrays(queries: DataFrame, windows: DataFrame, lookback: int, columns: Sequence[str] = DEFAULT_COLUMNS, metric: str = "mse", weights: Sequence[float] | None = None) -> DataFrame:
    """The same as scores, by numpy in blocks of queries and windows, for any number of queries."""
    return analogs.all_scores(queries, analogs.Stored(windows), analogs.search_of(lookback, columns, metric, weights))
