"""Exponentially weighted mean with recursion y = (1 - a) y + a x, seeded by the first value.

The recursion is a chain of affine maps.  Within a block of rows it has a closed form, a running sum of
a x (1 - a)^-i that is scaled back; a block is short enough for the powers to stay numbers.  What a block hands on is
the end of its own sum, and the ends of the blocks before it, each (1 - a)^rows weaker, until nothing is left of them in a
double.  All of it is built-in functions, and a long series is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Natural logarithms of the largest power within a block, and of what is nothing beside any double.
LARGEST, NOTHING = 230.0, 745.0


def block_rows(alpha: float, most: int) -> int:
    """Rows of a block that keep (1 - alpha)^-rows a number, ``most`` at most."""
    return most if alpha >= 1.0 else max(1, min(most, int(LARGEST / -log(1.0 - alpha))))


def faded(ends: Column, keep: float) -> Column:
    """Ends of blocks, the newest last, each of which lasts by so much over the next."""
    return F.aggregate(ends, F.lit(0.0), lambda total, y: total * keep + y)


def recursive_means(rows: DataFrame, values: dict[str, tuple[Column, float]], size: int | None, key: str = "Ticker", time: str = "Date") -> DataFrame:
    """rows of a cut table (operators.blocks) with the mean of each value, given with its alpha, as a column of that name; own rows only.

    A value may be null at the first row of a series only, where its mean is null; the first value seeds the mean.
    Where a series is one block, it is taken in parts within its task, and nothing is joined.
    """
    rn = F.col("__rn")
    rows = rows.withColumns({c: v for c, (v, _) in values.items()})
    chains = {c: 1.0 - alpha for c, (_, alpha) in values.items() if alpha < 1.0}  # a mean with alpha 1 is its value
    series = Window.partitionBy(key).orderBy(time)
    block = series if size is None else Window.partitionBy(key, "__block").orderBy("__rn")
    first = {c: (rn == 0) | ((rn == 1) & F.lag(c).over(block).isNull()) for c in chains}
    rows = rows.withColumns({f"__w_{c}": F.when(first[c], F.col(c)).otherwise(F.col(c) * (1.0 - keep)) for c, keep in chains.items()})
    if size is not None:
        rows = rows.where(F.col("__block") == F.floor(rn / size))
    if not chains:
        return rows
    parts = {c: size or block_rows(1.0 - keep, 1 << 20) for c, keep in chains.items()}
    back = {c: ceil(NOTHING / (-log(keep) * parts[c])) for c, keep in chains.items()}
    place = {c: rn % parts[c] for c in chains}
    rows = rows.withColumns({f"__part{n}": F.floor(rn / n) for n in set(parts.values())})
    sums = {}
    for c, keep in chains.items():
        upto = Window.partitionBy(key, f"__part{parts[c]}").orderBy("__rn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums[f"__y_{c}"] = F.pow(F.lit(keep), place[c]) * F.coalesce(F.sum(F.col(f"__w_{c}") * F.pow(F.lit(keep), -place[c])).over(upto), F.lit(0.0))
    rows = rows.withColumns(sums)
    if size is None:
        handed = {}
        for c, keep in chains.items():  # the parts are of a length of which a few last
            total = F.lit(0.0)
            for k in range(back[c]):
                total = total + F.coalesce(F.lag(f"__y_{c}", 1 + k * parts[c]).over(series), F.lit(0.0)) * keep ** (parts[c] * k)
            handed[f"__h_{c}"] = F.when(place[c] == 0, total)
        rows = rows.withColumns(handed)
        rows = rows.withColumns({f"__h_{c}": F.last(f"__h_{c}", ignorenulls=True).over(series) for c in chains})
    else:
        ends = rows.groupBy(key, "__block").agg(*[F.max_by(f"__y_{c}", "__rn").alias(f"__y_{c}") for c in chains])
        order = Window.partitionBy(key).orderBy("__block")  # one row per block
        handed = [key, "__block"]
        for c, keep in chains.items():
            before = F.collect_list(f"__y_{c}").over(order.rowsBetween(-back[c], -1))
            handed.append(faded(before, keep**size).alias(f"__h_{c}"))
        rows = rows.join(ends.select(*handed), [key, "__block"])
    means = {c: F.when(F.col(c).isNotNull(), F.col(f"__y_{c}") + F.pow(F.lit(keep), place[c] + 1) * F.col(f"__h_{c}")) for c, keep in chains.items()}
    return rows.withColumns(means).drop(*[f"__part{n}" for n in set(parts.values())], *[f"__{k}_{c}" for c in chains for k in "wyh"])


def recursive_means_in_pandas(df: DataFrame, keys: Sequence[str], order: str, value: str, alpha: float, out: str) -> DataFrame:
    """df with the mean as a further column, each series in one pandas frame."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def smooth(frame):
        frame = frame.sort_values(order, kind="stable")
        frame[out] = frame[value].astype(float).ewm(alpha=alpha, adjust=False).mean()
        return frame

    return df.groupBy(*keys).applyInPandas(smooth, schema)
