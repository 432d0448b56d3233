"""Universe lists, normalising, deduplicating and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import naive_utc, to_date, to_number
from ..schema import HISTORY_COLUMNS, PRICE_COLUMNS, require

KEY = ("Ticker", "Date")


def distinct_in_order(df: DataFrame, value: str, order: str) -> DataFrame:
    """Each value once, at its first place: columns value, order."""
    return df.groupBy(value).agg(F.min(order).alias(order))


def clean_tickers(df: DataFrame, column: str, order: str) -> DataFrame:
    """ticker, ord: trimmed, without empty ones, each once.  A missing cell is left out."""
    rows = df.select(F.trim(F.col(column).cast("string")).alias("ticker"), F.col(order).alias("ord")).where("ticker <> ''")
    return distinct_in_order(rows, "ticker", "ord")


def only(universe: DataFrame, wanted: DataFrame) -> DataFrame:
    """The universe's tickers that are wanted, in the universe's order."""
    return universe.join(wanted.select("ticker"), "ticker", "left_semi")


def unknown(universe: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted tickers that the universe lacks."""
    return wanted.select("ticker").distinct().join(universe, "ticker", "left_anti")


def _nth(keys: tuple[str, ...], order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(order))


def keep_first(df: DataFrame, seq: str, keys: tuple[str, ...] = KEY) -> DataFrame:
    """One row per key: the first by seq, the order in which rows came in (which Spark does not keep by itself)."""
    require(df, [seq, *keys])
    return df.withColumn("__nth", _nth(keys, F.col(seq).asc())).where("__nth = 1").drop("__nth")


def keep_last(df: DataFrame, seq: str, keys: tuple[str, ...] = KEY) -> DataFrame:
    """One row per key: the last by seq."""
    require(df, [seq, *keys])
    return df.withColumn("__nth", _nth(keys, F.col(seq).desc())).where("__nth = 1").drop("__nth")


def normalize_prices(raw: DataFrame, ticker: str | Column, seq: str, zone: str | None = None) -> DataFrame:
    """A vendor's frame in the history schema: names, types, naive UTC dates; the first row of a date stays.

    ticker: the ticker's name, or a column that holds it.  Absent columns are null; a frame without rows keeps the schema.
    """
    names = {c.replace(" ", "").lower(): c for c in raw.columns}
    column = lambda n: F.col(f"`{names[n.lower()]}`") if n.lower() in names else F.lit(None)
    date = column("Datetime") if "datetime" in names else column("Date")
    rows = raw.select(
        (F.lit(ticker) if isinstance(ticker, str) else ticker).cast("string").alias("Ticker"),
        naive_utc(to_date(date), zone).alias("Date"),
        *[to_number(column(c)).alias(c) for c in PRICE_COLUMNS],
        F.floor(to_number(column("Volume"))).cast("long").alias("Volume"),
        F.col(seq).alias("__seq"),
    )
    return keep_first(rows, "__seq").select(HISTORY_COLUMNS)


def adjusted_only(df: DataFrame) -> DataFrame:
    return df.withColumn("Close", F.col("AdjClose"))


def coerced(df: DataFrame, seq: str, numeric: list[str], keys: tuple[str, ...] = KEY) -> DataFrame:
    """An input of the later stages: dates and numbers coerced, rows without a date dropped, the last row of a key stays."""
    out = df.withColumns({"Date": to_date(F.col("Date")), **{c: to_number(F.col(c)) for c in numeric}})
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as many for tables of any size: rows with their place shrink in a shuffle, and few tasks would sort many
    return keep_last(out.dropna(subset=["Date"]).repartition(parts, *keys), seq, keys)


def incremental_merge(existing: DataFrame | None, new: DataFrame, seq: str) -> DataFrame:
    """existing, and of new the first row of each key that existing lacks: what is stored wins over what is fetched."""
    new = keep_first(new, seq).drop(seq)
    if existing is None:
        return new
    fresh = new.join(existing.select(*KEY), [*KEY], "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def touched(existing: DataFrame, new: DataFrame, seq: str) -> DataFrame:
    """incremental_merge of those tickers alone that get rows which existing lacks; of the others nothing is read but their dates."""
    of_new = new.select("Ticker").distinct()
    dates = existing.join(of_new, "Ticker", "left_semi").select(*KEY)
    fresh = keep_first(new, seq).drop(seq).join(dates, [*KEY], "left_anti")
    return existing.join(fresh.select("Ticker").distinct(), "Ticker", "left_semi").unionByName(fresh, allowMissingColumns=True)


def batches(universe: DataFrame, size: int) -> DataFrame:
    """ticker, ord, batch: chunks of ``size`` tickers in order.  A row per ticker is ranked in one task."""
    place = F.row_number().over(Window.orderBy("ord", "ticker")) - 1
    return universe.withColumn("batch", F.floor(place / size))
