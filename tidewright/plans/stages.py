"""The four stages from their settings.  Chained without files in between they are one lazy plan."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Features, Fetch, Match, Windows
from ..functions.scalars import parse_list, to_date
from ..operators import analogs, compare, indicators, match, prep, report, windows
from ..operators.blocks import BLOCK
from ..sinks import tables
from ..sources import files, quotes


@dataclass
class Fetched:
    history: DataFrame
    status: DataFrame
    summary: DataFrame
    missing: DataFrame


def kept(df: DataFrame, out: str, dry: bool = False) -> DataFrame:
    """df as a table of its own, in the folder for checkpoints or, without one, beside the output: computed once, and safe from lost executors.

    dry: nothing is written; df is held in memory, and what is lost there is computed again.
    """
    if dry:
        return df.persist()
    spark = df.sparkSession
    folder = f"{spark.sparkContext.getCheckpointDir() or f'{out}/_work'}/fetch-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def fetch_stage(spark: SparkSession, config: Fetch, provider: quotes.Provider, **options: object) -> Fetched | None:
    """Fetch, normalise, merge with what is stored, and write.  validate_only checks the list and returns None.

    Raises RuntimeError if more series are empty than fail_on_empty allows.
    """
    if not config.input:
        raise ValueError("input is missing")
    universe, missing = files.read_table(spark, config.input, parse_list(config.only))
    if config.validate_only:
        return None
    began = time.time()
    fetched = kept(quotes.fetch(spark, universe, provider, "fetched", config.batch_size, **options).withColumn("seq", F.monotonically_increasing_id()), config.out, config.dry_run)
    status = fetched.where("status IS NOT NULL").select(F.col("Ticker").alias("ticker"), "status")
    raw = fetched.where("status IS NULL").drop("status")
    new = prep.normalize_prices(raw, F.col("Ticker"), "seq")
    if config.adjusted_only:
        new = prep.adjusted_only(new)
    stored = files.read_history(spark, config.out) if config.incremental else None
    history = new if stored is None else prep.incremental_merge(stored, new.withColumn("seq", F.lit(0)), "seq")
    by_ticker = files.exists(spark, f"{config.out}/history_all_parquet") and (config.per_ticker or config.partition_by == "Ticker")
    replaced, whole = history, None
    if stored is not None and not config.dry_run:  # what is read is about to be replaced
        if by_ticker:  # by the tickers alone that get new rows; the files of the others stay as they are
            replaced, whole = prep.touched(stored, new.withColumn("seq", F.lit(0)), "seq"), lambda: files.read_history(spark, config.out)
        replaced = kept(replaced, config.out)
    if config.actions and not config.dry_run:
        paid = {t: kept(quotes.fetch(spark, universe, provider, f"{t}_fetched", config.batch_size, **options), config.out) for t in ("dividends", "splits")}
        for t in paid.values():
            status = status.unionByName(t.where("status IS NOT NULL").select(F.col("Ticker").alias("ticker"), "status").distinct())
    summary = report.run_summary(status)
    if not config.dry_run:
        tables.save_prices(replaced, config.out, config.per_ticker, config.compression, config.partition_by, config.float_dp, whole)
        history = whole() if whole else replaced
        if config.actions:
            tables.save_actions(*(t.where("status IS NULL").drop("status") for t in paid.values()), config.out, config.compression, config.float_dp)
        tables.save_report(summary, status, f"{config.out}/run_report.json", incremental=config.incremental, actions=config.actions, adjusted_only=config.adjusted_only, out_dir=config.out)
    tables.log_event(spark, config.log_file, {"event": "fetch", "elapsed_s": round(time.time() - began, 3)})
    if report.too_many_empty(status, config.fail_on_empty):
        raise RuntimeError("more empty series than fail_on_empty allows")
    return Fetched(history, status, summary, missing)


def features_stage(spark: SparkSession, config: Features, write: bool = True) -> DataFrame:
    path = config.input or files.first_existing(spark, "data_all/history_all_parquet", "data_all/history_all.parquet")
    price = "AdjClose" if config.use_adjclose else "Close"
    out = indicators.add_features(files.read_features_input(spark, path), price, config.ma, config.rsi, block=BLOCK)
    if write:
        tables.write_parquet(out, config.out, config.partition_by)
        if config.csv:
            tables.write_csv(out, config.csv, config.float_dp)
    return out


def windows_stage(spark: SparkSession, config: Windows, write: bool = True) -> DataFrame:
    data = files.load_data(spark, config.input or files.first_existing(spark, "features.parquet", "features.csv"))
    out = windows.event_windows(data, config.before, config.after, config.drop_rows_if_nan, config.require_full_window, BLOCK)
    if write:
        tables.save_windows(out, config.out, config.per_ticker, config.format, config.float_dp, config.csv_head, config.csv_tail)
    return out


def fetched_queries(spark: SparkSession, watch: DataFrame, provider: quotes.Provider, lookback: int) -> DataFrame:
    """The newest bars of the watched tickers with their averages, as many days as a query needs."""
    universe, wanted = watch.groupBy(F.col("Ticker").alias("ticker")).agg(F.min("ord").alias("ord")), match.days_needed(lookback)
    since = (datetime.now(UTC) - timedelta(days=match.calendar_days(wanted))).date()
    raw = quotes.fetch(spark, universe, provider, since=since.isoformat()).withColumn("seq", F.monotonically_increasing_id())
    return match.query_averages(match.recent(prep.normalize_prices(raw, F.col("Ticker"), "seq"), wanted))


def match_stage(spark: SparkSession, config: Match, provider: quotes.Provider | None = None, write: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores, futures, status of the queries).  A query that cannot be built is reported and the others go on."""
    columns = parse_list(config.match_cols)
    weights = [float(w) for w in parse_list(config.weights)]
    watch = files.read_watch(spark, config.watch)
    bases = [match.base_of(c) for c in columns]
    if config.query_from_features:
        source = files.read_query_features(spark, config.query_features_dir, watch, bases)
        absent = watch.join(source.select("Ticker").distinct(), "Ticker", "left_anti")
        if provider is not None and not absent.isEmpty():  # what the features lack is asked for
            source = source.unionByName(fetched_queries(spark, absent, provider, config.lookback).select(source.columns))
    elif provider is not None:
        source = fetched_queries(spark, watch, provider, config.lookback)
    else:
        raise ValueError("queries need features or a provider")
    reference = files.read_windows(spark, config.ref_dir, columns)
    asked = match.query_points(source, config.lookback, columns)
    search = analogs.search_of(config.lookback, columns, config.metric, weights, config.horizon, config.topn)
    best = analogs.closest(asked, analogs.Stored(reference), search)
    if write:  # what several files and the futures read is computed once
        best = kept(best, config.out_dir)
    found = match.with_run(best.drop("Future"), config.lookback, config.horizon, config.metric, columns)
    after = analogs.futures_of(best)
    if write:
        tables.save_matches(found, after, config.out_dir)
    return found, after, match.query_status(source, config.lookback, columns)


def diff_stage(spark: SparkSession, left: str, right: str) -> DataFrame | None:
    """The verdict on two copies of a table, each a CSV or a Parquet; None if one of them is not there."""
    if not (files.exists(spark, left) and files.exists(spark, right)):
        return None
    return compare.verdict(*(dated(files.read_any(spark, p)) for p in (left, right)))


def dated(df: DataFrame) -> DataFrame:
    """df with its dates read as dates, as a CSV has them as text."""
    return df.withColumns({c: to_date(F.col(c)) for c in ("RefDate", "Date") if c in df.columns})
