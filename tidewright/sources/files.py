"""Files of tickers, bars, features and windows.

Spark keeps no row order of its own, so readers whose result depends on it add ``seq``: file, then place in the file.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import to_number
from ..operators.prep import clean_tickers, coerced, only, unknown
from ..schema import HISTORY, PRICE_COLUMNS, missing_to_null, require, roles, struct


@contextmanager
def folders_as_text(spark: SparkSession) -> Iterator[None]:
    """What is read within has the values of partition folders as text, as they are written: 0700 stays 0700."""
    name = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the store that the path names has it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that exists, else the first one."""
    return next((p for p in paths if exists(spark, p)), paths[0])


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as a file of any store that Spark can write to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()


def listed(df: DataFrame, key: str = "Ticker") -> DataFrame:
    """file, key, place: the files of a table partitioned by a key, in the order of their names."""
    path = F.col("_metadata.file_path")
    names = df.select(F.regexp_extract(path, "[^/]+$", 0).alias("file"), F.regexp_extract(path, f"/{key}=([^/]*)/", 1).alias(key)).distinct()
    return names.withColumn("place", F.row_number().over(Window.orderBy(key, "file")).cast("long"))  # a row per file


def with_seq(df: DataFrame) -> DataFrame:
    """df with seq, which rises with the order of rows in their files."""
    return df.withColumn("seq", F.struct(F.col("_metadata.file_modification_time"), F.col("_metadata.file_path"), F.monotonically_increasing_id()))


def read_any(spark: SparkSession, path: str, other: str | None = None) -> DataFrame:
    """CSV by its suffix, Parquet by its suffix or for a folder; anything else as ``other``, or an error."""
    with folders_as_text(spark):
        if path.rstrip("/").endswith(".csv"):
            return spark.read.option("header", True).csv(path)
        if path.rstrip("/").endswith((".parquet", "_parquet")) or other == "parquet":
            return spark.read.parquet(path)
    raise ValueError(f"{path}: neither .csv nor .parquet")


def read_table(spark: SparkSession, path: str, only_these: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The universe (ticker, ord) of a CSV with a column ``ticker`` (any case, spaces around it), and the wanted tickers that it lacks."""
    raw = spark.read.option("header", True).csv(path)
    names = {c.strip().lower(): c for c in raw.columns}
    if "ticker" not in names:
        raise ValueError("the list of tickers needs a column 'ticker'")
    rows = raw.select(F.col(f"`{names['ticker']}`").alias("ticker"), F.monotonically_increasing_id().alias("ord"))
    universe = clean_tickers(rows, "ticker", "ord")
    wanted = spark.createDataFrame([(t,) for t in only_these or []], "ticker string")
    missing = unknown(universe, wanted)
    if only_these:
        universe = only(universe, wanted)
    if universe.isEmpty():
        raise ValueError("no tickers")
    return universe, missing


def read_watch(spark: SparkSession, path: str) -> DataFrame:
    """Ticker, ord: the watch list, in order, duplicates kept; the column's name is taken as written."""
    raw = spark.read.option("header", True).csv(path)
    require(raw, ["Ticker"], "the watch list")
    rows = raw.select(F.trim("Ticker").alias("Ticker"), F.monotonically_increasing_id().alias("ord")).where("Ticker <> ''")
    if rows.isEmpty():
        raise ValueError("no tickers to watch")
    return rows


def read_history(spark: SparkSession, out: str) -> DataFrame | None:
    """What an earlier fetch stored, whether as one table or by ticker; None if there is none, or none that can be read."""
    for name in ("history_all_parquet", "history_all.parquet"):
        try:
            if exists(spark, f"{out}/{name}"):
                return missing_to_null(spark.read.schema(struct(HISTORY)).parquet(f"{out}/{name}"))
        except AnalysisException:
            continue
    return None


def read_ticker_history(spark: SparkSession, out: str, ticker: str) -> DataFrame | None:
    """One ticker's bars; its folder alone is read."""
    history = read_history(spark, out)
    return None if history is None else history.where(F.col("Ticker") == ticker)


def read_features_input(spark: SparkSession, path: str) -> DataFrame:
    """Bars for the indicators: required columns, coerced dates and prices, the last row of a (Ticker, Date)."""
    raw = read_any(spark, path, other=None if "." in path.rsplit("/", 1)[-1] else "parquet")
    require(raw, ["Ticker", "Date", "Close", "AdjClose"])
    prices = [c for c in PRICE_COLUMNS if c in raw.columns]
    return coerced(with_seq(raw), "seq", prices).drop("seq").withColumn("Ticker", F.col("Ticker").cast("string"))


def load_data(spark: SparkSession, path: str) -> DataFrame:
    """Features for the windows: value columns coerced, the last row of a (Ticker, Date)."""
    raw = read_any(spark, path, other="parquet")
    require(raw, ["Ticker", "Date"])
    return coerced(with_seq(raw), "seq", roles(raw)[0]).drop("seq").withColumn("Ticker", F.col("Ticker").cast("string"))


def read_windows(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """Reference windows with SourceFile.  Only the match columns are read; files that lack one are empty for it and drop out.

    The columns are asked for by name and type, so no footer is opened before a task reads its file, however many there
    are and whatever else they hold.
    """
    wanted = ", ".join(["Ticker string", "RefDate timestamp_ntz", "Offset int", *[f"`{c}` double" for c in columns]])
    rows = spark.read.schema(wanted).parquet(folder)
    if rows.isEmpty():
        raise ValueError(f"{folder}: no windows")
    return rows.select("Ticker", "RefDate", "Offset", F.col("_metadata.file_name").alias("SourceFile"), *[to_number(F.col(c)).alias(c) for c in columns])


def read_query_features(spark: SparkSession, path: str, tickers: DataFrame, columns: list[str]) -> DataFrame:
    """Features of the watched tickers (Ticker): only their partitions and the needed columns are read; the last row of a date stays."""
    raw = read_any(spark, path, other="parquet")
    require(raw, ["Ticker", "Date", *columns])
    rows = with_seq(raw).select("Ticker", "Date", *columns, "seq").join(F.broadcast(tickers.select("Ticker").distinct()), "Ticker", "left_semi")
    return coerced(rows, "seq", columns).drop("seq")


__all__ = [
    "exists",
    "first_existing",
    "listed",
    "load_data",
    "read_any",
    "read_features_input",
    "read_history",
    "read_query_features",
    "read_table",
    "read_ticker_history",
    "read_watch",
    "read_windows",
    "with_seq",
    "write_text",
]
