"""Differences between two copies of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
KEY = ("Ticker", "RefDate", "Offset", "Date")
#: numpy's defaults for closeness.
ABSOLUTE, RELATIVE = 1e-8, 1e-5


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= ABSOLUTE + RELATIVE * F.abs(b)


def numeric_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns of both that are numeric in either, without the key."""
    a, b = dict(left.dtypes), dict(right.dtypes)
    return [c for c in left.columns if c in b and c not in KEY and (a[c].startswith(NUMERIC) or b[c].startswith(NUMERIC))]


def aligned(left: DataFrame, right: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Rows of both by key, a struct l and a struct r; rows with equal keys are paired in the order of their values.

    Works for tables of unequal size: a row without a partner has a null struct.
    """
    key = tuple(c for c in key if c in left.columns and c in right.columns)
    numbers = numeric_columns(left, right)

    def numbered(df: DataFrame, side: str) -> DataFrame:
        cells = [F.col(c).try_cast("double").alias(c) for c in numbers]
        rows = df.select(*[F.col(c).alias(f"{side}_{c}") for c in key], F.struct(F.lit(1).alias("there"), *cells).alias(side))
        place = F.row_number().over(Window.partitionBy(*[f"{side}_{c}" for c in key]).orderBy(*[F.col(side)[c] for c in numbers] or [F.lit(1)]))
        return rows.withColumn(f"{side}_nth", place)

    same = F.lit(True)
    a, b = numbered(left, "l"), numbered(right, "r")
    for c in (*key, "nth"):
        same = same & F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))
    return a.join(b, same, "full_outer").select("l", "r")


def compare(left: DataFrame, right: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """A row per numeric column: nulls on each side, mismatches (pairs with a null ignored), rows without a partner, and same."""
    numbers = numeric_columns(left, right)
    pairs = aligned(left, right, key)
    counts = []
    for k, c in enumerate(numbers):
        a, b = F.col("l")[c], F.col("r")[c]
        counts += [
            F.count_if(F.col("l").isNotNull() & a.isNull()).alias(f"ln{k}"),
            F.count_if(F.col("r").isNotNull() & b.isNull()).alias(f"rn{k}"),
            F.count_if(a.isNotNull() & b.isNotNull() & ~close(a, b)).alias(f"d{k}"),
        ]
    sums = pairs.agg(F.count_if(F.col("l").isNull() | F.col("r").isNull()).alias("unpaired"), *counts)
    row = lambda k, c: F.struct(F.lit(c).alias("column"), F.col(f"ln{k}").alias("left_nulls"), F.col(f"rn{k}").alias("right_nulls"), F.col(f"d{k}").alias("mismatches"))
    rows = sums.select("unpaired", F.explode(F.array(*[row(k, c) for k, c in enumerate(numbers)])).alias("x"))
    return rows.select("x.*", "unpaired", (F.col("x.mismatches") == 0).alias("same"))


def verdict(left: DataFrame, right: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """left_rows, right_rows, mismatched (columns, sorted), all_match."""
    found = compare(left, right, key).agg(F.array_join(F.sort_array(F.collect_list(F.when(~F.col("same"), F.col("column")))), ",").alias("mismatched"))
    rows = left.agg(F.count("*").alias("left_rows")).crossJoin(right.agg(F.count("*").alias("right_rows")))  # one row each
    return rows.crossJoin(found).withColumn("all_match", (F.col("mismatched") == "") & (F.col("left_rows") == F.col("right_rows")))
