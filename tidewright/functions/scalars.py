"""Column expressions; all are built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(c: Column) -> Column:
    """A double, or null if the value is no number; NaN is null too."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def to_date(c: Column) -> Column:
    """A naive timestamp, or null."""
    return c.try_cast("timestamp_ntz")


def naive_utc(c: Column, zone: str | None) -> Column:
    """A naive local time of a zone as naive UTC; without a zone, as it is."""
    return c if zone is None else F.convert_timezone(F.lit(zone), F.lit("UTC"), c)


def split_list(c: Column) -> Column:
    """Comma-separated entries, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def parse_list(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def safe_filename(c: Column) -> Column:
    """A ticker as part of a file name: runs of characters that file systems refuse, and spaces, become underscores."""
    kept = F.trim(F.regexp_replace(c.cast("string"), r'[\\/:*?"<>|]+', "_"))
    return F.coalesce(F.nullif(F.replace(kept, F.lit(" "), F.lit("_")), F.lit("")), F.lit("NA"))


def base_name(c: Column) -> Column:
    return F.regexp_replace(c, "_Rebased$", "")


def rounded(c: Column, places: int) -> Column:
    """Half to even, as it shows in CSV."""
    return F.bround(c, places)


def fixed(c: Column, places: int) -> Column:
    """Text with a fixed number of places; null stays null."""
    return F.when(c.isNotNull(), F.format_string(f"%.{places}f", rounded(c, places)))


def gain(delta: Column) -> Column:
    return F.when(delta > 0, delta).when(delta.isNotNull(), F.lit(0.0))


def loss(delta: Column) -> Column:
    return F.when(delta < 0, -delta).when(delta.isNotNull(), F.lit(0.0))


def rebased(value: Column, reference: Column) -> Column:
    """value / reference * 100; null for a reference that is null or 0."""
    return F.try_divide(value, reference) * 100.0
