"""Parquet and CSV sinks.  Rewriting a partitioned table replaces the partitions that are touched, and only those."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import fixed, safe_filename
from ..schema import PRICE_COLUMNS
from ..sources.files import exists, write_text


def write_parquet(df: DataFrame, path: str, partition_by: str | None = None, compression: str = "snappy") -> None:
    """Partitioned by a column, rows of one value go to one task's file (split by size if a value is large), sorted within."""
    if partition_by:
        order = [c for c in (partition_by, "RefDate", "Offset", "Date") if c in df.columns]
        df = df.repartition(partition_by).sortWithinPartitions(*order)
    writer = df.write.mode("overwrite").option("compression", compression).option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def rounded_view(df: DataFrame, places: int | None, columns: list[str] | None = None) -> DataFrame:
    """df with doubles (all, or those named) rounded half to even and written with a fixed number of places."""
    if places is None:
        return df
    doubles = [c for c, t in df.dtypes if t in ("double", "float") and (columns is None or c in columns)]
    return df.withColumns({c: fixed(F.col(c), places) for c in doubles})


def head_and_tail(df: DataFrame, head: int | None, tail: int | None, keys: list[str], order: list[str]) -> DataFrame:
    """The first ``head`` and the last ``tail`` rows per file (keys); all of them if neither is given or both reach everything."""
    if head is None and tail is None:
        return df
    h, t = max(0, head or 0), max(0, tail or 0)
    file = Window.partitionBy(*keys)
    rows = df.withColumns({"__rn": F.row_number().over(file.orderBy(*order)), "__n": F.count("*").over(file)})
    return rows.where((F.col("__rn") <= h) | (F.col("__rn") > F.col("__n") - t)).drop("__rn", "__n")


def write_csv(df: DataFrame, path: str, places: int | None = None, columns: list[str] | None = None, by: str | None = None) -> None:
    """A CSV view; by: a folder per value, of which only those that df has are replaced."""
    view = rounded_view(df, places, columns)
    if by:
        view = view.withColumn("__file", safe_filename(F.col(by))).repartition("__file")
        view.write.mode("overwrite").option("header", True).option("partitionOverwriteMode", "dynamic").partitionBy("__file").csv(path)
    else:
        view.write.mode("overwrite").option("header", True).csv(path)


def save_prices(df: DataFrame, out: str, per_ticker: bool = False, compression: str = "snappy", partition_by: str | None = None, float_dp: int | None = None, whole: Callable[[], DataFrame] | None = None) -> None:
    """History as Parquet and as CSV with its price columns rounded.

    Of a table by ticker only the tickers of df are replaced.  whole: gives all rows once the Parquet is written, for a CSV
    that is one table.
    """
    by = "Ticker" if per_ticker else None
    if per_ticker or partition_by:
        write_parquet(df, f"{out}/history_all_parquet", partition_by or "Ticker", compression)
    else:
        write_parquet(df, f"{out}/history_all.parquet", None, compression)
    write_csv(whole() if whole and not by else df, f"{out}/history_all.csv", float_dp, PRICE_COLUMNS, by)


def save_actions(dividends: DataFrame, splits: DataFrame, out: str, compression: str = "snappy", float_dp: int | None = None) -> None:
    for name, table in (("dividends", dividends), ("splits", splits)):
        if not table.isEmpty():
            write_parquet(table, f"{out}/{name}", "Ticker", compression)
            write_csv(table, f"{out}/{name}.csv", float_dp, None, "Ticker")


def save_windows(
    df: DataFrame, out: str, per_ticker: bool = False, format: str = "csv", float_dp: int | None = None, csv_head: int | None = None, csv_tail: int | None = None
) -> None:
    """Windows as Parquet (complete) and CSV (rounded, and sampled per file if asked)."""
    if format in ("parquet", "both"):
        write_parquet(df, f"{out}/rebased_parquet", "Ticker" if per_ticker else None)
    if format in ("csv", "both"):
        keys = ["Ticker"] if per_ticker else []
        sample = head_and_tail(df, csv_head, csv_tail, keys, ["Ticker", "RefDate", "Offset"])
        write_csv(sample, f"{out}/rebased_csv", float_dp, None, "Ticker" if per_ticker else None)


def save_matches(scores: DataFrame, futures: DataFrame, out: str) -> None:
    """Scores as one CSV, as a CSV per query, and as Parquet by query; futures by query."""
    write_csv(scores, f"{out}/all_scores.csv")
    write_csv(scores, f"{out}/scores_csv", by="QueryTicker")
    write_parquet(scores, f"{out}/scores", "QueryTicker")
    write_parquet(futures, f"{out}/futures", "QueryTicker")


def save_report(summary: DataFrame, status: DataFrame, path: str, dry_run: bool = False, **settings: object) -> dict:
    """A run's report as JSON: counts, the tickers that are fine, those that failed with the reason, and the settings."""
    counts = summary.first().asDict()
    rows = status.select("ticker", "status").orderBy("ticker").collect()  # a row per ticker of the universe
    report = {
        "timestamp": datetime.now(UTC).isoformat(),
        "interval": "1d",
        "ok": [r.ticker for r in rows if r.status == "ok"],
        "failed": [{"ticker": r.ticker, "reason": r.status} for r in rows if r.status != "ok"],
        "summary": {**counts, **settings, "dry_run": dry_run},
    }
    if not dry_run:
        write_text(status.sparkSession, path, json.dumps(report, ensure_ascii=False, indent=2))
    return report


def log_event(spark: SparkSession, path: str | None, event: dict) -> None:
    """Add an event with its time to a file of JSON lines, in any store; without a path, nothing.  The file holds a line per run."""
    if path:
        before = [r.value for r in spark.read.text(path).collect()] if exists(spark, path) else []
        write_text(spark, path, "\n".join([*before, json.dumps({"ts": datetime.now(UTC).isoformat(), **event}, ensure_ascii=False)]) + "\n")
