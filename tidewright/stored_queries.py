"""Registered queries about what lies in files and between stages: sinks read back, scans, sources, and the stages' control.

Each writes into a new folder, and what it returns is read from there.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import config
from .functions import scalars
from .operators import analogs, indicators, match, prep, report, windows
from .plans import stages
from .plans.bars import bars, bars_with_gaps, table, ticks
from .queries import AFTER, BEFORE, HORIZON, LOOKBACK, MATCH, TOP, Query, shown
from .schema import HISTORY, HISTORY_COLUMNS, PRICE_COLUMNS, struct
from .sinks import tables
from .sources import files, quotes
from .streaming import features, ingest

PLACES_SHOWN, HEAD, TAIL = 4, 30, 20
TODAY = "1998-08-02"
#: The first day that comes to a stream in its second run.
SECOND = "1996-05-17"
#: The preset's match: 75 days, 25 more, four columns.
WIDE = match.DEFAULT_COLUMNS


def folder(spark: SparkSession) -> str:
    """A new folder where the session's checkpoints go; a local session without any gets one on its own machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset")
        base = tempfile.mkdtemp(prefix="tidewright-")
    return f"{base.rstrip('/')}/stored-{uuid.uuid4().hex}"


def csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def day(c: str) -> Column:
    return F.substring(c, 1, 10).alias(c)


def lines(spark: SparkSession, path: str, rows: list[str]) -> str:
    files.write_text(spark, path, "\n".join(rows) + "\n")
    return path


# -- sinks ------------------------------------------------------------------------------------------------------------


def stored_prices(spark: SparkSession, sf_dir: str, **how: object) -> str:
    out = folder(spark)
    tables.save_prices(bars(spark, sf_dir), out, **how)
    return out


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(files.read_history(spark, stored_prices(spark, sf_dir)).select(HISTORY_COLUMNS))


def ticker_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(files.read_ticker_history(spark, stored_prices(spark, sf_dir, partition_by="Ticker"), "BUILDING").select(HISTORY_COLUMNS))


def no_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by ticker of what is stored, and whether a place where nothing was has none."""
    rows = report.ticker_counts(files.read_history(spark, stored_prices(spark, sf_dir)))
    return rows.withColumn("absent", F.lit(files.read_history(spark, folder(spark)) is None))


def prices_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = csv(spark, f"{stored_prices(spark, sf_dir, per_ticker=True, float_dp=PLACES_SHOWN)}/history_all.csv")
    return text.select("Ticker", day("Date"), *PRICE_COLUMNS, "Volume")


def rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ticker is written again with other prices; the others stay as they were."""
    out, days = f"{folder(spark)}/t", bars(spark, sf_dir).select("Ticker", "Date", "Close")
    tables.write_parquet(days, out, "Ticker")
    tables.write_parquet(days.where("Ticker = 'MACHINERY'").withColumn("Close", F.col("Close") * 2), out, "Ticker")
    return shown(spark.read.parquet(out).select(F.col("Ticker").cast("string"), "Date", "Close"))


def merged_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that brings new days for some tickers: all bars are there then, and the files of the other tickers are the old ones."""
    out = folder(spark)
    quoted = quotes_folder(spark, sf_dir)
    listed = f"{out}/list.csv"
    segments(spark, sf_dir).select("ticker").repartition(1).write.option("header", True).csv(listed)
    known = bars(spark, sf_dir).where("Ticker IN ('BUILDING', 'FURNITURE') OR Date < timestamp_ntz'1998-01-01'")
    tables.save_prices(known, f"{out}/data", partition_by="Ticker")
    path = F.col("_metadata.file_path")
    names = lambda: spark.read.parquet(f"{out}/data/history_all_parquet").select(F.col("Ticker").cast("string"), path.alias("file")).distinct().collect()
    before = {r.file for r in names()}
    got = stages.fetch_stage(spark, config.Fetch(input=listed, out=f"{out}/data", incremental=True, partition_by="Ticker"), quoted, pause=0)
    stayed = spark.createDataFrame([(r.Ticker, r.file in before) for r in names()], "Ticker string, stayed boolean").groupBy("Ticker").agg(F.every("stayed").alias("stayed"))  # a row per file
    text = csv(spark, f"{out}/data/history_all.csv").groupBy("Ticker").agg(F.count("*").alias("in_csv"))
    sums = got.history.groupBy("Ticker").agg(F.count("*").alias("n"), F.round(F.sum("Close"), 2).alias("total"))
    return sums.join(stayed, "Ticker").join(text, "Ticker")


def paid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).where("seq % 50 = 0").groupBy("Ticker", "Date").agg((F.max("price") / 100).alias("Dividend"))


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).where("seq % 97 = 0").groupBy("Ticker", "Date").agg((F.max(F.col("seq") % 4) + 1).cast("double").alias("SplitRatio"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dividends are written; splits, of which there are none, are not."""
    out = folder(spark)
    splits = spark.createDataFrame([], "Ticker string, Date timestamp_ntz, SplitRatio double")
    tables.save_actions(paid(spark, sf_dir), splits, out, float_dp=PLACES_SHOWN)
    text = csv(spark, f"{out}/dividends.csv").select("Ticker", day("Date"), F.col("Dividend").alias("text"))
    rows = shown(spark.read.parquet(f"{out}/dividends")).select(F.col("Ticker").cast("string"), "Date", "Dividend")
    return rows.join(text, ["Ticker", "Date"]).withColumn("splits_written", F.lit(files.exists(spark, f"{out}/splits")))


REASON = "intet svar: æøå"


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{folder(spark)}/run_report.json"
    status = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("ticker")).distinct()
    status = status.withColumn("status", F.when(F.col("ticker") == "BUILDING", REASON).when(F.col("ticker") == "MACHINERY", "empty").otherwise("ok"))
    tables.save_report(report.run_summary(status), status, out, incremental=True)
    said = spark.read.option("multiLine", True).json(out)
    failed = F.array_join(F.transform("failed", lambda x: F.concat_ws("=", x["ticker"], x["reason"])), ",")
    return said.select("interval", "summary.tickers_total", "summary.tickers_ok", "summary.tickers_failed", "summary.empty_series", "summary.incremental", F.array_join("ok", ",").alias("ok"), failed.alias("failed"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{folder(spark)}/log.jsonl"
    for row in report.ticker_counts(bars(spark, sf_dir)).collect():  # a row per market segment
        tables.log_event(spark, out, {"event": f"{row.Ticker} hentet på ny", "n": row.n_rows})
    tables.log_event(spark, None, {"event": "nothing"})
    raw = spark.read.text(out)
    return raw.select(
        F.get_json_object("value", "$.event").alias("event"), F.get_json_object("value", "$.n").cast("long").alias("n"), F.get_json_object("value", "$.ts").try_cast("timestamp").isNotNull().alias("stamped"), F.contains("value", F.lit("\\u")).alias("escaped")
    )


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.add_features(bars(spark, sf_dir).select("Ticker", "Date", "Close", "AdjClose"), "AdjClose", (5, 10), ())


def features_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{folder(spark)}/features.parquet"
    tables.write_parquet(featured(spark, sf_dir), out, "Ticker")
    return shown(files.load_data(spark, out).select("Ticker", "Date", "Close", "AdjClose", "MA_5", "MA_10"))


def features_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{folder(spark)}/features.csv"
    tables.write_csv(bars_with_gaps(spark, sf_dir).select("Ticker", "Date", "Close", "AdjClose", "Volume"), out, PLACES_SHOWN)
    return csv(spark, out).select("Ticker", day("Date"), "Close", "AdjClose", "Volume")


def gap_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.event_windows(bars_with_gaps(spark, sf_dir).select("Ticker", "Date", "AdjClose", "Close"), 4, 2, "any", False)


def saved_windows(spark: SparkSession, sf_dir: str) -> str:
    out = folder(spark)
    tables.save_windows(gap_windows(spark, sf_dir), out, True, "both", PLACES_SHOWN, HEAD, TAIL)
    return out


def windows_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{saved_windows(spark, sf_dir)}/rebased_parquet")
    return shown(rows.select(F.col("Ticker").cast("string"), "RefDate", "Offset", "Date", "AdjClose_Rebased", "Close_Rebased"))


def windows_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv(spark, f"{saved_windows(spark, sf_dir)}/rebased_csv").select("Ticker", day("RefDate"), "Offset", day("Date"), "AdjClose_Rebased", "Close_Rebased")


def stored_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each file that stand before one that sorts lower: none."""
    rows = spark.read.parquet(f"{saved_windows(spark, sf_dir)}/rebased_parquet").select("RefDate", "Offset", F.col("Ticker").cast("string"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("nth"))
    order = Window.partitionBy("file").orderBy("nth")
    key = F.struct("RefDate", "Offset")
    return rows.withColumn("wrong", F.coalesce(F.lag(key).over(order) > key, F.lit(False))).groupBy("Ticker").agg(F.count_if("wrong").alias("wrong"), F.count("*").alias("n"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.listed(spark.read.parquet(f"{saved_windows(spark, sf_dir)}/rebased_parquet"))
    return rows.groupBy("Ticker").agg(F.min("place").alias("first")).select("Ticker", F.row_number().over(Window.orderBy("first")).cast("long").alias("place"))


# -- scans ------------------------------------------------------------------------------------------------------------


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several rows a day, some without a date or with a price that is none; the rows of a day of a ticker are in one file, in order."""
    price = F.col("price").cast("string")
    rows = ticks(spark, sf_dir).withColumns({"Day": F.when(F.col("seq") % 17 == 0, "no date").otherwise(F.date_format("Date", "yyyy-MM-dd")), "Close": F.when(F.col("seq") % 5 == 0, "n/a").otherwise(price), "AdjClose": price})
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # as many for tables of any size
    return rows.repartition(parts, "Ticker", rows["Date"]).sortWithinPartitions("seq").select("Ticker", F.col("Day").alias("Date"), "Close", "AdjClose")


def features_input(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f"{folder(spark)}/in.{kind}"
        writer = messy(spark, sf_dir).write.option("header", True) if kind == "csv" else messy(spark, sf_dir).write
        getattr(writer, kind)(out)
        return shown(files.read_features_input(spark, out).select("Ticker", "Date", "Close", "AdjClose"))

    return run


def windows_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{folder(spark)}/features"  # no suffix: Parquet
    messy(spark, sf_dir).withColumn("MA_3", F.col("AdjClose")).write.parquet(out)
    return shown(files.load_data(spark, out).select("Ticker", "Date", "Close", "MA_3"))


def generic_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from CSV and Parquet; what is neither is refused."""
    out, rows = folder(spark), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows.write.option("header", True).csv(f"{out}/n.csv")
    rows.write.parquet(f"{out}/n.parquet")
    try:
        files.read_any(spark, f"{out}/n.txt")
        refused = False
    except ValueError:
        refused = True
    both = [files.read_any(spark, f"{out}/n.{k}").select(F.lit(k).alias("kind"), F.col("n_nationkey").cast("long"), "n_name") for k in ("csv", "parquet")]
    return both[0].unionByName(both[1]).withColumn("refused", F.lit(refused))


def null_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by ticker before and after those without a date go."""
    raw = messy(spark, sf_dir).withColumn("seq", F.monotonically_increasing_id())
    kept = prep.coerced(raw, "seq", ["Close"], ("Ticker", "Date", "seq"))
    return raw.groupBy("Ticker").agg(F.count("*").alias("before")).join(kept.groupBy("Ticker").agg(F.count("*").alias("after")), "Ticker")


def reference_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.read_windows(spark, f"{saved_windows(spark, sf_dir)}/rebased_parquet", ["AdjClose_Rebased", "MA_9_Rebased"])
    return shown(rows.select(F.col("Ticker").cast("string"), "RefDate", "Offset", F.col("SourceFile").endswith(".parquet").alias("from_file"), "AdjClose_Rebased", "MA_9_Rebased"))


def query_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{folder(spark)}/features.parquet"
    tables.write_parquet(featured(spark, sf_dir), out, "Ticker")
    wanted = spark.createDataFrame([("BUILDING",), ("NOPE",), ("HOUSEHOLD",), ("BUILDING",)], "Ticker string")
    return shown(files.read_query_features(spark, out, wanted, ["AdjClose", "MA_5"]).select(F.col("Ticker").cast("string"), "Date", "AdjClose", "MA_5"))


def list_of(spark: SparkSession, sf_dir: str, header: str, name: Column) -> str:
    """One file with a name for each customer, in order of their keys: with spaces around it, or nothing."""
    cell = F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.concat(F.lit(" "), name, F.lit(" ")))
    out = f"{folder(spark)}/list.csv"
    rows = table(spark, sf_dir, "customer").repartition(1).sortWithinPartitions("c_custkey").select(cell.alias(header), F.col("c_custkey").alias("why"))
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(out)
    return out


def watch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.read_watch(spark, list_of(spark, sf_dir, "Ticker", F.concat("c_mktsegment", F.lit("."), F.col("c_nationkey").cast("string"))))
    return rows.select("Ticker", F.row_number().over(Window.orderBy("ord")).cast("long").alias("place"))


def universe_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list whose names have leading zeros, of which some are asked for, and one that is not there."""
    path = list_of(spark, sf_dir, " TICKER ", F.lpad(F.col("c_nationkey").cast("string"), 4, "0"))
    universe, missing = files.read_table(spark, path, ["0007", "0012", "9999"])
    return universe.select("ticker", F.lit(True).alias("listed")).union(missing.select("ticker", F.lit(False)))


def suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.concat_ws("_", "p_brand", F.when(F.col("p_partkey") % 2 == 0, "Rebased"), F.when(F.col("p_partkey") % 3 == 0, "B")).alias("name")).distinct()
    return names.select("name", scalars.base_name(F.col("name")).alias("base"))


def text_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickers that look like numbers, by each reader of partitioned tables, whatever the session makes of such folders."""
    out = f"{folder(spark)}/features.parquet"
    code = F.lpad(F.ascii("Ticker").cast("string"), 4, "0")
    tables.write_parquet(featured(spark, sf_dir).withColumn("Ticker", code), out, "Ticker")
    name = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        wanted = spark.createDataFrame([("0066",), ("0077",)], "Ticker string")
        found = {"features": files.read_features_input(spark, out), "windows": files.load_data(spark, out), "query": files.read_query_features(spark, out, wanted, ["AdjClose", "MA_5"])}
    finally:
        spark.conf.set(name, before)
    rows = [df.select(F.lit(k).alias("reader"), F.col("Ticker"), "Date", "AdjClose").groupBy("reader", "Ticker").agg(F.count("*").alias("n"), F.sum("AdjClose").alias("total")) for k, df in found.items()]
    return shown(rows[0].unionByName(rows[1]).unionByName(rows[2]), 3)


def diff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV against a Parquet of the same table with some values changed."""
    from .queries import _copies

    out = folder(spark)
    left, right = _copies(spark, sf_dir)
    tables.write_csv(left, f"{out}/left.csv")
    tables.write_parquet(right, f"{out}/right.parquet")
    return stages.diff_stage(spark, f"{out}/left.csv", f"{out}/right.parquet")


# -- sources ----------------------------------------------------------------------------------------------------------


@dataclass
class Shaky:
    """A folder's quotes, at the ``after``-th attempt; never for a batch with BAD, and no actions for BUILDING's batch."""

    folder: quotes.FolderProvider
    after: int = 1
    asked: int = 0

    def bars(self, tickers: list[str], since: object = None) -> list[tuple]:
        self.asked += 1
        if self.asked < self.after or "BAD" in tickers:
            raise OSError("no answer")
        return list(self.folder.bars(tickers, since))

    def actions(self, tickers: list[str], kind: str, since: object = None) -> list[tuple]:
        if "BUILDING" in tickers:
            raise OSError("no answer")
        return list(self.folder.actions(tickers, kind, since))


def segments(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """ticker, ord: the market segments by name, then the others as they are named."""
    names = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("ticker"), F.lit(0).alias("late")).distinct()
    others = spark.createDataFrame([(t, k + 1) for k, t in enumerate(more)], "ticker string, late int")
    return names.union(others).select("ticker", F.struct("late", "ticker").alias("ord"))


def quotes_folder(spark: SparkSession, sf_dir: str) -> quotes.FolderProvider:
    out = folder(spark)
    bars(spark, sf_dir).write.parquet(f"{out}/history.parquet")
    paid(spark, sf_dir).write.parquet(f"{out}/dividends.parquet")
    split(spark, sf_dir).write.parquet(f"{out}/splits.parquet")
    return quotes.FolderProvider(out)


def quoted(name: str) -> Query:
    return lambda spark, sf_dir: shown(quotes.fetch(spark, segments(spark, sf_dir, "NONE"), quotes_folder(spark, sf_dir), name, 2, pause=0))


def quotes_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days that are asked for, by an option and by a filter; the provider reads no others."""
    asked = quotes.fetch(spark, segments(spark, sf_dir), quotes_folder(spark, sf_dir), "history", 2, pause=0, since="1997-03-01")
    return shown(asked.where("Ticker <> 'BUILDING' AND Date >= timestamp_ntz'1998-01-15'"))


def halves(rows: DataFrame) -> list[DataFrame]:
    """Rows before a day, and from it on: what is there at first, and what comes later."""
    return [rows.where(f"Date < timestamp_ntz'{SECOND}'"), rows.where(f"Date >= timestamp_ntz'{SECOND}'")]


def stream_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history that a stream of quotes stores in two runs, between which the provider gets new days."""
    out, wanted = folder(spark), segments(spark, sf_dir, "NONE")
    provider = quotes.FolderProvider(f"{out}/quotes")
    for rows in halves(bars(spark, sf_dir)):
        rows.write.mode("append").parquet(f"{out}/quotes/history.parquet")
        ingest.append_history(quotes.follow(spark, wanted, provider, 2, pause=0), f"{out}/history", f"{out}/state").awaitTermination()
    return shown(spark.read.schema(struct(HISTORY)).parquet(f"{out}/history"))


def stream_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a stream of bars in two runs; the second carries on with the state of the first."""
    out = folder(spark)
    for rows in halves(bars_with_gaps(spark, sf_dir)):
        rows.write.mode("append").parquet(f"{out}/bars")
        features.append_features(ingest.bar_stream(spark, f"{out}/bars"), f"{out}/features", f"{out}/state").awaitTermination()
    return shown(spark.read.parquet(f"{out}/features").drop("late"))


def quote_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days that a query of the preset's size asks for."""
    wanted = match.days_needed(75)
    found = match.recent(bars(spark, sf_dir), wanted, F.lit(TODAY).cast("date"))
    return shown(found.select("Ticker", "Date", "Close")).withColumn("calendar_days", F.lit(match.calendar_days(wanted)).cast("long"))


def retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.fetch(spark, segments(spark, sf_dir), Shaky(quotes_folder(spark, sf_dir), after=3), "status", 2, pause=0)


def isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.fetch(spark, segments(spark, sf_dir, "NONE", "BAD", "LAST"), Shaky(quotes_folder(spark, sf_dir)), "status", 2, attempts=2, pause=0)


def failed_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quotes.fetch(spark, segments(spark, sf_dir), Shaky(quotes_folder(spark, sf_dir)), "splits_fetched", 2, attempts=1, pause=0.001)
    return shown(found.select("Ticker", "Date", "SplitRatio", "status"))


# -- stages -----------------------------------------------------------------------------------------------------------


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run writes and says: only validating, as a dry run (which leaves nothing behind), for real, and with more empty series than allowed."""
    out = folder(spark)
    listed = f"{out}/list.csv"
    segments(spark, sf_dir, "NONE").select("ticker").repartition(1).write.option("header", True).csv(listed)
    quoted, rows = quotes_folder(spark, sf_dir), []
    for name, how in (("validate", {"validate_only": True}), ("dry", {"dry_run": True}), ("real", {}), ("empty", {"fail_on_empty": 0})):
        try:
            got = stages.fetch_stage(spark, config.Fetch(input=listed, out=f"{out}/{name}", **how), quoted, pause=0)
            said = "nothing" if got is None else f"{got.history.count()} rows"
        except RuntimeError as e:
            said = str(e)
        rows.append((name, said, *(files.exists(spark, f"{out}/{name}{x}") for x in ("", "/run_report.json", "/history_all.parquet"))))
    return spark.createDataFrame(rows, "run string, said string, anything boolean, report boolean, history boolean")


def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of calls from the command line on quotes of all segments, and how many bars lie in the output afterwards."""
    from .__main__ import main

    out, quoted = folder(spark), quotes_folder(spark, sf_dir).folder
    listed = f"{out}/list.csv"
    segments(spark, sf_dir, "NONE").select("ticker").repartition(1).write.option("header", True).csv(listed)
    given = ["fetch", "--quotes", quoted, "--input", listed, "--out"]
    calls = {
        "diff without files": ["diff", f"{out}/a.csv", f"{out}/b.csv"],
        "diff of one file": ["diff", f"{out}/a.csv"],
        "too many empty": [*given, f"{out}/empty", "--fail-on-empty", "0", "--dry-run"],
        "validated": [*given, f"{out}/validated", "--validate-only"],
        "fetched": [*given, f"{out}/fetched"],
        "no such stage": ["bake"],
    }
    rows = []
    for k, v in calls.items():
        code, history = main(v, spark), files.read_history(spark, v[6]) if len(v) > 6 else None
        rows.append((k, code, 0 if history is None else history.count()))
    return spark.createDataFrame(rows, "call string, code long, bars long")


def no_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search in windows that are all too short: no rows, with the columns of a result."""
    rows = windows.event_windows(featured(spark, sf_dir), 3, 1, "any", True)
    asked = match.query_points(featured(spark, sf_dir), LOOKBACK, MATCH)
    best = match.top_matches(match.scores(asked, rows, LOOKBACK, MATCH), TOP)
    after = match.futures(best, rows, HORIZON, MATCH)
    return best.agg(F.count("*").alias("matches")).withColumns({"columns": F.lit(",".join(sorted(best.columns))), "futures": F.lit(after.count()).cast("long")})


def match_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match stage from files to files: scores in Parquet, in one CSV and in a CSV per query, and futures."""
    out, found = folder(spark), featured(spark, sf_dir)
    tables.write_parquet(found, f"{out}/features.parquet", "Ticker")
    tables.save_windows(windows.event_windows(found, BEFORE, AFTER, "any", True), out, True, "parquet")
    watch = lines(spark, f"{out}/watch.csv", ["Ticker", "BUILDING", "NOPE", "MACHINERY"])
    settings = config.Match(
        watch=watch, ref_dir=f"{out}/rebased_parquet", lookback=LOOKBACK, horizon=HORIZON, topn=TOP, match_cols=",".join(MATCH), out_dir=f"{out}/found", query_from_features=True, query_features_dir=f"{out}/features.parquet"
    )
    stages.match_stage(spark, settings)
    scores = [
        ("scores", spark.read.parquet(f"{out}/found/scores")),
        ("all_scores.csv", csv(spark, f"{out}/found/all_scores.csv")),
        ("scores_csv", csv(spark, f"{out}/found/scores_csv")),
    ]
    parts = [df.select(F.lit(k).alias("file"), F.col("QueryTicker").cast("string"), "MatchTicker", F.substring(F.col("RefDate").cast("string"), 1, 10).alias("RefDate"), F.col("Rank").cast("long").alias("place"), F.col("Score").cast("double").alias("value")) for k, df in scores]
    after = spark.read.parquet(f"{out}/found/futures")
    parts.append(after.select(F.lit("futures").alias("file"), F.col("QueryTicker").cast("string"), "MatchTicker", F.substring(F.col("RefDate").cast("string"), 1, 10).alias("RefDate"), F.col("FutureOffset").cast("long").alias("place"), F.col(MATCH[0]).alias("value")))
    rows = parts[0]
    for one in parts[1:]:
        rows = rows.unionByName(one)
    return shown(rows)


# -- the match at the preset's size -----------------------------------------------------------------------------------


def topn_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = indicators.add_features(bars(spark, sf_dir).select("Ticker", "Date", "AdjClose"), "AdjClose", (20, 50, 200), (), places=True)
    search = analogs.search_of(75, WIDE, top=TOP, places=6)
    best = analogs.closest(match.query_points(found, 75, WIDE), analogs.OfSeries(found, 75, 25), search)
    return shown(best.select("QueryTicker", "Rank", "MatchTicker", "RefDate", "Score"), 3)


STORED: dict[str, Query] = {
    "stored_history": history,
    "stored_ticker_history": ticker_history,
    "no_stored_history": no_history,
    "prices_csv": prices_csv,
    "rewritten_partitions": rewritten,
    "merged_folders": merged_folders,
    "stored_actions": actions,
    "run_report": run_report,
    "run_log": run_log,
    "features_parquet": features_parquet,
    "features_csv": features_csv,
    "windows_parquet": windows_parquet,
    "windows_csv": windows_csv,
    "stored_order": stored_order,
    "sorted_listing": listing,
    "features_input_parquet": features_input("parquet"),
    "features_input_csv": features_input("csv"),
    "windows_input": windows_input,
    "generic_scan": generic_scan,
    "drop_null_dates": null_dates,
    "reference_files": reference_files,
    "query_features": query_features,
    "watch_list": watch_list,
    "universe_file": universe_file,
    "base_names": suffixes,
    "diff_files": diff_files,
    "quotes_history": quoted("history"),
    "quotes_actions": quoted("dividends"),
    "quote_range": quote_range,
    "quotes_since": quotes_since,
    "stream_features": stream_features,
    "stream_quotes": stream_quotes,
    "quotes_splits": quoted("splits"),
    "text_tickers": text_tickers,
    "fetch_retries": retried,
    "fetch_isolation": isolated,
    "failed_actions": failed_actions,
    "run_controls": controls,
    "exit_codes": exit_codes,
    "no_match": no_match,
    "match_files": match_files,
    "topn_preset": topn_preset,
}
