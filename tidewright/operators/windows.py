"""Event windows: every row of a ticker as a reference day, with the rows before and after it rebased to 100.

A window is collected by a ROWS frame, so the expansion costs no join; only columns that the output needs are in it.
Long series can be cut into blocks with a halo first, so that their reference days are dealt over many tasks before
anything is expanded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import rebased
from ..schema import arranged, require, roles
from .blocks import cut, in_block, own
from .indicators import by_date

POLICIES = ("none", "any", "all")
LEADING = ["Ticker", "RefDate", "Offset", "Date", "AdjClose_Rebased", "Close_Rebased"]


def ordinals(df: DataFrame) -> DataFrame:
    """df with rn (0-based place in its ticker) and n (rows of its ticker)."""
    return df.withColumns({"rn": F.row_number().over(by_date()) - 1, "n": F.count("*").over(Window.partitionBy("Ticker"))})


def valid_reference(c: Column) -> Column:
    return F.coalesce(c != 0, F.lit(False))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def event_windows(df: DataFrame, before: int, after: int, policy: str = "all", full: bool = False, block: int | None = None) -> DataFrame:
    """Ticker, RefDate, Offset, Date, <column>_Rebased..., RSI...: windows [-before, after] around each reference day.

    Only days with all of ``before`` rows before and ``after`` rows after them are references, and only if some value
    column is neither null nor 0 there; columns that are not so are null throughout the window.
    policy: which rows are dropped -- "any": with some rebased column null, "all": with all of them null, "none".
    full: windows that would lose a row are dropped whole.
    block: own rows of a block, for series that no task should hold whole; None where every series fits one.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {POLICIES}")
    require(df, ["Ticker", "Date"])
    values, rsi = roles(df)
    size = before + after + 1
    block = block and max(block, size)
    frame = in_block(block).rowsBetween(-before, after)
    rows = cut(df.select("Ticker", "Date", *values, *rsi, *[c for c in ("__rn", "__n") if c in df.columns]), before, after, block)
    if full and policy == "any":  # counts tell before anything is collected
        rows = rows.withColumns({f"__n_{k}": F.count(c).over(frame) for k, c in enumerate(values)})
    rows = rows.withColumn("__window", F.collect_list(F.struct("Date", *values, *rsi)).over(frame)).where(own(block) & (F.col("__rn") >= before) & (F.col("__rn") < F.col("__n") - after))
    if values:
        rows = rows.where(_any([valid_reference(F.col(c)) for c in values]))
    if full and policy == "any":
        for k, c in enumerate(values):
            rows = rows.where(valid_reference(F.col(c)) & (F.col(f"__n_{k}") == size))
    if full and policy == "all" and values:
        rows = rows.where(F.forall("__window", lambda x: _any([valid_reference(F.col(c)) & x[c].isNotNull() for c in values])))
    exploded = rows.select("Ticker", F.col("Date").alias("RefDate"), *[F.col(c).alias(f"__ref_{c}") for c in values], F.posexplode("__window").alias("__pos", "__row"))
    out = exploded.select(
        "Ticker",
        "RefDate",
        (F.col("__pos") - before).alias("Offset"),
        F.col("__row.Date").alias("Date"),
        *[rebased(F.col("__row")[c], F.col(f"__ref_{c}")).alias(f"{c}_Rebased") for c in values],
        *[F.col("__row")[c].alias(c) for c in rsi],
    )
    if values and policy == "any":
        out = out.dropna("any", subset=[f"{c}_Rebased" for c in values])
    if values and policy == "all":
        out = out.dropna("all", subset=[f"{c}_Rebased" for c in values])
    return arranged(out, LEADING)
