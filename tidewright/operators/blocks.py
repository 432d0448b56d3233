"""Long series in blocks of rows, each with the rows around it that its own rows look at (its halo).

A frame of rows over (Ticker, __block) then gives the own rows of a block what a frame over the whole series would, and
a series of any length is dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Own rows of a block.
BLOCK = 8192
ADDED = ("__rn", "__n", "__block")


def numbered(df: DataFrame, key: str = "Ticker", time: str = "Date") -> DataFrame:
    """df with __rn (place in its series by time, from 0) and __n (rows of its series); no task sorts a whole series.

    Rows are counted by series and month; what lies before a month is a running sum over that small table, and only the
    rows of one month are put in order together.  Rows without a key or a time belong to no series and are left out.  The exchange by series and
    month serves the join and the places.
    """
    if "__rn" in df.columns:
        return df
    rows = df.withColumn("__month", F.year(time) * 12 + F.month(time)).where(F.col(key).isNotNull() & F.col("__month").isNotNull())
    counts = rows.groupBy(key, "__month").agg(F.count("*").alias("__c"))
    series = Window.partitionBy(key)
    earlier = F.sum("__c").over(series.orderBy("__month").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(key, "__month", F.coalesce(earlier, F.lit(0)).alias("__start"), F.sum("__c").over(series).alias("__n"))
    place = F.row_number().over(Window.partitionBy(key, "__month").orderBy(time))
    return rows.join(starts.hint("shuffle_hash"), [key, "__month"]).withColumn("__rn", F.col("__start") + place - 1).drop("__month", "__start")


def cut(df: DataFrame, before: int, after: int, size: int | None = BLOCK, key: str = "Ticker", time: str = "Date") -> DataFrame:
    """df with __rn, __n and __block: each row in its own block, and in those whose own rows reach it with ``before`` rows back and ``after`` ahead.

    Without a size a series is one block, which spares the counting where every series fits a task.
    """
    if size is None:
        series = Window.partitionBy(key)
        places = {} if "__rn" in df.columns else {"__rn": F.row_number().over(series.orderBy(time)).cast("long") - 1, "__n": F.count("*").over(series)}
        return df.withColumns({**places, "__block": F.lit(0).cast("long")})
    rows = numbered(df, key, time)
    rn = F.col("__rn")
    first = F.greatest(F.floor((rn - after) / size), F.lit(0))
    last = F.least(F.floor((rn + before) / size), F.floor((F.col("__n") - 1) / size))
    return rows.withColumn("__block", F.explode(F.sequence(first, last)))


def own(size: int | None = BLOCK) -> Column:
    """Whether a row of a cut table is in the block that it belongs to; every row is so once."""
    return F.lit(True) if size is None else F.col("__block") == F.floor(F.col("__rn") / size)


def in_block(size: int | None = BLOCK, key: str = "Ticker", time: str = "Date") -> WindowSpec:
    """The rows of a block in order; of a whole series, in the order that it has anyway."""
    return Window.partitionBy(key).orderBy(time) if size is None else Window.partitionBy(key, "__block").orderBy("__rn")
