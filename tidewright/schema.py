"""Schemas of the tables, and the one rule about missing values: NaN becomes NULL on the way in."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HISTORY = "Ticker string,Date timestamp_ntz,Open double,High double,Low double,Close double,AdjClose double,Volume long"
DIVIDENDS = "Ticker string,Date timestamp_ntz,Dividend double"
SPLITS = "Ticker string,Date timestamp_ntz,SplitRatio double"
SCORES = "QueryTicker string,MatchTicker string,RefDate timestamp_ntz,Score double,SourceFile string"
HISTORY_COLUMNS = [x.split()[0] for x in HISTORY.split(",")]
PRICE_COLUMNS = ["Open", "High", "Low", "Close", "AdjClose"]


def struct(spec: str) -> str:
    """A schema as Spark's readers take it."""
    return spec.replace(",", ", ")


def missing_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NaN is NULL in every double or float column (or those named)."""
    kinds = dict(df.dtypes)
    chosen = [c for c in (columns or df.columns) if kinds[c] in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in chosen}) if chosen else df


def require(df: DataFrame, columns: list[str], what: str = "input") -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"{what} lacks columns: {', '.join(absent)}")


def finite(c: Column) -> Column:
    """True for numbers that are neither NaN nor infinite; never null."""
    return F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False))


def indicator(name: str) -> tuple[int, float] | None:
    """What a column's name says of an indicator: (0, length) for a moving average, (1, length) for an RSI; None for other columns.

    A name without a number has an infinite length, so it stands behind the others.
    """
    found = re.match(r"(?:(MA_)|(?i:RSI)_?)(\d+(?:\.\d+)?)?", name)
    return None if found is None else (0 if found[1] else 1, float(found[2] or "inf"))


def roles(df: DataFrame) -> tuple[list[str], list[str]]:
    """(columns that a window rebases, columns that it carries as they are): prices and averages, and RSI."""
    closing = sorted({"AdjClose", "Close"}.intersection(df.columns))
    kinds = [(c, indicator(c)) for c in df.columns]
    return closing + [c for c, k in kinds if k and k[0] == 0], [c for c, k in kinds if k and k[0] == 1]


def arranged(df: DataFrame, leading: list[str]) -> DataFrame:
    """df with the leading columns in front, then indicators by kind and length, then the rest as they came."""

    def place(name: str) -> tuple:
        if name in leading:
            return 0, leading.index(name)
        kind = indicator(name)
        return (1, *kind) if kind else (2,)

    return df.select(*sorted(df.columns, key=place))
