"""Moving averages and Wilder's RSI, per ticker, over the rows that have a price."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import ewm
from ..functions.scalars import gain, loss
from ..schema import HISTORY_COLUMNS, arranged, require
from .blocks import ADDED, cut, in_block, own


def by_date(*, key: str = "Ticker", time: str = "Date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(time)


def moving_average(value: Column, rows: int, order: WindowSpec) -> Column:
    """Mean of the last ``rows`` rows; null unless all of them exist and have a value."""
    frame = order.rowsBetween(-(rows - 1), Window.currentRow)
    return F.when(F.count(value).over(frame) == rows, F.avg(value).over(frame))


def delta(value: Column, order: WindowSpec) -> Column:
    return value - F.lag(value).over(order)


def rsi_of_means(gains: Column, losses: Column, changes: Column, length: int) -> Column:
    """RSI from the two smoothed means; null until ``length`` changes exist, 100 where nothing was lost."""
    return F.when(changes >= length, F.when(losses == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + F.try_divide(gains, losses))))


def changes(price: str, order: WindowSpec, df: DataFrame) -> DataFrame:
    """df with __g and __l: what the price gained or lost since the row before."""
    return df.withColumn("__d", delta(F.col(price), order)).withColumns({"__g": gain(F.col("__d")), "__l": loss(F.col("__d"))}).drop("__d")


def add_features(
    df: DataFrame, price: str = "AdjClose", ma: Sequence[int] = (20, 50, 200), rsi: Sequence[int] | int = 14, route: str = "jvm", block: int | None = None, places: bool = False
) -> DataFrame:
    """Rows with a price, and the indicators over them: MA_<w> and RSI_<n>.

    block: rows of a block at most, into which long series are cut with a halo of the longest average, so that no task
    holds a whole one; None where every series fits a task.  route: "jvm", or "pandas", which smooths each series in one
    pandas frame and gives the same.
    places: keep __rn and __n, by which windows over the same rows need not count them again.
    """
    require(df, ["Ticker", "Date", price])
    lengths = [rsi] if isinstance(rsi, int) else list(rsi)
    size = block and min([block, *(ewm.block_rows(1.0 / n, block) for n in lengths)])
    rows = cut(df.where(F.col(price).isNotNull()), max([1, *(w - 1 for w in ma)]), 0, size)
    rows = rows.withColumns({f"MA_{w}": moving_average(F.col(price), w, in_block(size)) for w in ma})
    if lengths:
        rows = changes(price, in_block(size), rows)
    if route == "pandas":
        rows = rows.where(own(size))
        for n in lengths:
            for c in ("__g", "__l"):
                rows = ewm.recursive_means_in_pandas(rows, ["Ticker"], "Date", c, 1.0 / n, f"{c}{n}")
    elif lengths:
        rows = ewm.recursive_means(rows, {f"{c}{n}": (F.col(c), 1.0 / n) for n in lengths for c in ("__g", "__l")}, size)
    else:
        rows = rows.where(own(size))
    rows = rows.withColumns({f"RSI_{n}": rsi_of_means(F.col(f"__g{n}"), F.col(f"__l{n}"), F.col("__rn"), n) for n in lengths})
    rows = rows.drop("__g", "__l", *[f"{c}{n}" for n in lengths for c in ("__g", "__l")], *(["__block"] if places else ADDED))
    return arranged(rows, HISTORY_COLUMNS)
