"""Moving averages and RSI of a stream of bars: the same numbers as operators.indicators gives for the whole history.

What a ticker needs for its next bars is its state: the prices that its longest average still looks at, and the smoothed
means of gains and losses.  It has that size however long the history is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schema import HISTORY_COLUMNS, require

#: Rows so far, microseconds of the last day, the last prices, and for each length of RSI its means of gains and of losses.
STATE = "seen long, last long, prices array<double>, means array<double>"


def averages(prices: np.ndarray, new: int, width: int) -> np.ndarray:
    """Means of the last ``width`` prices at each of the ``new`` last ones; NaN where there are fewer."""
    out = np.full(new, np.nan)
    full = min(new, len(prices) - width + 1)
    if full > 0:
        out[new - full :] = np.lib.stride_tricks.sliding_window_view(prices[len(prices) - width - full + 1 :], width).mean(axis=1)
    return out


def smoothed(values: np.ndarray, before: float | None, alpha: float) -> np.ndarray:
    """y = (1 - alpha) y + alpha x, carried on from ``before`` or seeded by the first value."""
    seed = [] if before is None else [before]
    return pd.Series(np.concatenate([seed, values])).ewm(alpha=alpha, adjust=False).mean().to_numpy()[len(seed) :]


def add_features(bars: DataFrame, price: str = "AdjClose", ma: Sequence[int] = (20, 50, 200), rsi: Sequence[int] | int = 14) -> DataFrame:
    """A stream of the bars that have a price, with MA_<w>, RSI_<n> and late.

    Bars of a ticker are taken by day.  One whose day is not after all that came before it in the stream cannot change
    what was already handed on: it is marked late and has null features (append_history stores it, and a batch run gives
    the features anew).  Of bars of one day in one micro-batch, one counts and the others are late.  A task holds the new
    bars of one ticker in one micro-batch, which maxFilesPerTrigger bounds.  Rows without a ticker or day are left out.
    """
    require(bars, ["Ticker", "Date", price])
    lengths = [rsi] if isinstance(rsi, int) else list(rsi)
    keep = max([1, *(w - 1 for w in ma)])  # RSI looks one price back
    names = [*(f"MA_{w}" for w in ma), *(f"RSI_{n}" for n in lengths)]
    columns = bars.columns

    def of_ticker(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last, tail, means = state.get if state.exists else (0, None, [], [])
        rows = pd.concat(list(frames)).sort_values("Date", kind="stable")
        days = rows["Date"].to_numpy().astype("datetime64[us]").astype(np.int64)
        fresh = np.append(True, days[1:] != days[:-1]) & (days > (last if last is not None else np.iinfo(np.int64).min))
        rows = rows.assign(**dict.fromkeys(names, np.nan), late=~fresh)
        values = rows[price].to_numpy(float)[fresh]
        if len(values):
            prices, new = np.concatenate([tail, values]), len(values)
            made = {f"MA_{w}": averages(prices, new, w) for w in ma}
            change = np.diff(prices[-new - 1 :])
            after = []
            for k, n in enumerate(lengths):
                before = means[2 * k : 2 * k + 2] or (None, None)
                up, down = (smoothed(x, b, 1.0 / n) for x, b in zip((np.maximum(change, 0.0), np.maximum(-change, 0.0)), before, strict=True))
                with np.errstate(divide="ignore", invalid="ignore"):
                    found = np.where(down == 0, 100.0, 100.0 - 100.0 / (1.0 + up / down))
                made[f"RSI_{n}"] = np.full(new, np.nan)
                made[f"RSI_{n}"][new - len(found) :] = found
                made[f"RSI_{n}"][seen + np.arange(new) < n] = np.nan
                after += [float(up[-1]), float(down[-1])] if len(up) else []
            for name, column in made.items():
                rows.loc[fresh, name] = column
            state.update((seen + new, int(days[fresh][-1]), prices[-keep:].tolist(), after))
        yield rows[[*columns, *names, "late"]]

    schema = T.StructType([*bars.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names), T.StructField("late", T.BooleanType())])
    rows = bars.where(F.col("Ticker").isNotNull() & F.col("Date").isNotNull() & F.col(price).isNotNull())
    made = rows.groupBy("Ticker").applyInPandasWithState(of_ticker, schema, STATE, "append", GroupStateTimeout.NoTimeout)
    rest = [c for c in columns if c not in HISTORY_COLUMNS]
    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return made.select(*[c for c in HISTORY_COLUMNS if c in columns], *rest, *[number(c) for c in names], "late")


def append_features(bars: DataFrame, out: str, checkpoint: str, **how: object) -> StreamingQuery:
    """Features of what is there, each bar's once, appended to ``out``; a later run carries on with the state in ``checkpoint``."""
    rows = add_features(bars, **how)
    return rows.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
