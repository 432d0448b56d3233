"""The closest analogs of many queries at scale: blocks of queries against blocks of windows, the best kept in each task.

Windows are never expanded into rows.  A block of a series (operators.blocks) arrives in a task as plain rows in order,
and numpy looks at every window in it at once; windows that lie in files are read as they are, each a run of rows.  Sums of
products tell which windows of a block can be among the best of a query at all; only those are scored exactly.  A task
keeps the best of each query over all that it reads, with the rows that followed them, so what is shuffled is as many rows
as tasks x queries x n, and futures need no join.

Up to QUERY_BLOCK queries are broadcast.  More are dealt into blocks, and query blocks meet window blocks in the cells of
a grid, by a cogroup; windows are computed once either way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import finite, require, roles
from .blocks import cut

#: Queries whose points are broadcast at once.
QUERY_BLOCK = 2_000
#: Rows of windows in a cell of the grid, about.
CELL_ROWS = 1 << 19
#: Windows that numpy scores at once, and pairs of a window and a query.
AT_ONCE, PAIRS_AT_ONCE = 1024, 4096
#: Relative error of a sum of products that is allowed for, some hundred times what it can be.
SLACK = 1e-11
KEYS = ["SourceFile", "MatchTicker", "RefDate"]
METRICS = ("mse", "corr")


def parsed_weights(weights: Sequence[float] | None, columns: Sequence[str]) -> list[float]:
    if weights is None or not len(weights):
        return [1.0] * len(columns)
    if len(weights) != len(columns):
        raise ValueError(f"{len(weights)} weights for {len(columns)} columns")
    return [float(w) for w in weights]


@dataclass(frozen=True)
class Search:
    lookback: int
    columns: tuple[str, ...]
    metric: str = "mse"
    weights: tuple[float, ...] = ()
    horizon: int = 0
    top: int | None = None  # None: every score
    places: int | None = None  # scores are ranked as rounded to so many places

    @property
    def bases(self) -> list[str]:
        return [c.removesuffix("_Rebased") for c in self.columns]


@dataclass
class Found:
    """Scored windows: query numbers, ranking and plain scores, keys, and what followed (columns x horizon, and how many rows of it are there)."""

    query: np.ndarray
    rank: np.ndarray
    score: np.ndarray
    source: np.ndarray
    ticker: np.ndarray
    day: np.ndarray
    after: np.ndarray
    rows: np.ndarray

    def taken(self, at: np.ndarray) -> Found:
        return Found(*(getattr(self, f)[at] for f in self.__dataclass_fields__))

    @staticmethod
    def joined(parts: list[Found]) -> Found:
        return Found(*(np.concatenate([getattr(p, f) for p in parts]) for f in Found.__dataclass_fields__))

    def best(self, n: int) -> Found:
        """The n lowest of each query; ties go by source file, ticker and day."""
        order = np.lexsort((self.day, self.ticker, self.source, self.rank, self.query))
        q = self.query[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
        nth = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        return self.taken(order[nth < n])


def scores_of(search: Search, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weighted scores of windows a against queries b, pair by pair (pairs x columns x points)."""
    if search.metric == "mse":
        each = ((a - b) ** 2).mean(axis=2)
    else:
        a, b = a - a.mean(axis=2, keepdims=True), b - b.mean(axis=2, keepdims=True)
        below = np.sqrt((a * a).sum(axis=2) * (b * b).sum(axis=2))
        each = 1 - np.divide((a * b).sum(axis=2), below, out=np.zeros_like(below), where=below > 0)
    weights = np.array(search.weights)
    return (each * weights).sum(axis=1) / (weights.sum() or 1.0)


@dataclass
class Scorer:
    """Scores windows against a block of queries (queries x columns x points), and keeps the best of each query."""

    search: Search
    queries: np.ndarray
    kept: list[Found] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.bound = np.full(len(self.queries), np.inf)  # a window beyond cannot be among the best any more
        self.part, self.size = self._parts(self.queries)

    def _parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What products are taken of, and a size for the error of the products."""
        if self.search.metric == "mse":
            x = x - 100.0  # rebased values lie about there: differences are the same, products smaller
            return x, (x * x).sum(axis=2)
        x = x - x.mean(axis=2, keepdims=True)
        norm = np.sqrt((x * x).sum(axis=2, keepdims=True))
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0), np.ones(x.shape[:2])

    def nearly(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all pairs by sums of products (windows x queries), and how far off they can be."""
        part, size = self._parts(windows)
        out, off = 0.0, 0.0
        for c, w in enumerate(self.search.weights):
            sizes = size[:, c, None] + self.size[None, :, c]
            product = part[:, c] @ self.part[:, c].T
            out = out + w * ((sizes - 2 * product) / self.search.lookback if self.search.metric == "mse" else 1 - product)
            off = off + abs(w) * sizes * SLACK
        total = sum(self.search.weights) or 1.0
        return out / total, off / abs(total)

    def add(self, windows: np.ndarray, source: np.ndarray, ticker: np.ndarray, days: np.ndarray, after: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Iterator[Found]:
        """Windows (windows x columns x points) with their keys.  after gives what followed some of them.  Yields what is found where every score is wanted."""
        for start in range(0, len(windows), AT_ONCE):
            these = windows[start : start + AT_ONCE]
            if self.search.top is None:
                near = np.ones((len(these), len(self.queries)), bool)
            else:
                with np.errstate(invalid="ignore", over="ignore"):
                    rough, off = self.nearly(these)
                limit = self.bound
                if len(these) > self.search.top:
                    limit = np.minimum(limit, np.partition(rough + off, self.search.top - 1, axis=0)[self.search.top - 1])
                near = ~(rough - off > limit + (0 if self.search.places is None else 10.0**-self.search.places))  # what is no number is looked at
            at, query = np.nonzero(near)
            for k in range(0, len(at), PAIRS_AT_ONCE):
                w, q = at[k : k + PAIRS_AT_ONCE], query[k : k + PAIRS_AT_ONCE]
                with np.errstate(invalid="ignore", over="ignore"):
                    score = scores_of(self.search, these[w], self.queries[q])
                rank = score if self.search.places is None else np.floor(score * 10.0**self.search.places + 0.5) / 10.0**self.search.places
                then, rows = after(start + w) if self.search.horizon else (np.empty((len(w), len(self.search.columns), 0)), np.zeros(len(w), np.int64))
                found = Found(q, rank, score, source[start + w], ticker[start + w], days[start + w], then, rows)
                if self.search.top is None:
                    yield found
                else:
                    self.keep(found)

    def keep(self, found: Found) -> None:
        best = Found.joined([*self.kept, found]).best(self.search.top)
        self.kept = [best]
        counts = np.bincount(best.query, minlength=len(self.queries))
        worst = np.full(len(self.queries), -np.inf)
        np.maximum.at(worst, best.query, np.where(np.isnan(best.rank), np.inf, best.rank))
        self.bound = np.where(counts >= self.search.top, worst, np.inf)


def series_windows(search: Search, before: int, after: int, policy: str, full: bool, values: np.ndarray, match: list[int], centres: np.ndarray):
    """Complete windows of a block of a series: their centres, their points (windows x columns x lookback), and what followed them.

    values: columns x rows, missing as NaN, all columns that a window has.  match: places of the match columns.  A window is what
    operators.windows gives with these settings, and complete if each of the lookback rows up to its centre is in it with every
    match column.
    """
    there = ~np.isnan(values)
    size, n, found = before + after + 1, search.lookback, centres
    usable = there[:, found] & (values[:, found] != 0)
    fine = usable[match].all(axis=0)
    if policy == "any":
        fine &= usable.all(axis=0)
        row = there.all(axis=0)
        runs = np.r_[0, np.cumsum(row)]
        span = (found - before, found + after + 1) if full else (found - n + 1, found + 1)
        fine &= runs[span[1]] - runs[span[0]] == span[1] - span[0]
    for c in match:
        runs = np.r_[0, np.cumsum(there[c])]
        fine &= runs[found + 1] - runs[found - n + 1] == n
    found, usable = found[fine], usable[:, fine]
    if full and policy == "all" and len(found):
        views = np.lib.stride_tricks.sliding_window_view(there, size, axis=1)[:, found - before]
        whole = (views & usable[:, :, None]).any(axis=0).all(axis=1)
        found, usable = found[whole], usable[:, whole]
    points = np.stack([np.lib.stride_tricks.sliding_window_view(values[c], n)[found - n + 1] / values[c, found][:, None] * 100.0 for c in match], axis=1)

    def following(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ahead = found[at][:, None] + np.arange(1, min(search.horizon, after) + 1)
        if policy == "any":
            kept = there[:, ahead].all(axis=0)
        elif policy == "all":
            kept = (there[:, ahead] & usable[:, at][:, :, None]).any(axis=0)
        else:
            kept = np.ones(ahead.shape, bool)
        rows = kept.sum(axis=1)
        place = np.argsort(~kept, axis=1, kind="stable")
        out = np.stack([np.take_along_axis(values[c][ahead] / values[c, found[at]][:, None] * 100.0, place, axis=1) for c in match], axis=1)
        return out, rows

    return found, points, following


def runs_of(frame: pd.DataFrame, keys: list[str]) -> list[int]:
    """Where runs of equal keys begin in a frame that is in order."""
    new = np.zeros(len(frame), bool)
    for k in keys:
        x = frame[k].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    if len(new):
        new[0] = True
    return np.flatnonzero(new).tolist()


def whole_runs(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames in order, cut anew so that a run of equal keys is in one of them."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        starts = runs_of(frame, keys)
        if not starts:
            continue
        if held and any(held[-1][k].iloc[-1] != frame[k].iloc[0] for k in keys):
            yield pd.concat(held, ignore_index=True)
            held = []
        if starts[-1] > 0:
            yield pd.concat([*held, frame.iloc[: starts[-1]]], ignore_index=True)
            held = []
        held.append(frame.iloc[starts[-1] :])
    if held:
        yield pd.concat(held, ignore_index=True)


class Windows:
    """How a task finds windows in what it reads: rows in order of ``keys``, then ``order``; rows of equal keys come together."""

    keys: list[str]
    order: str

    def rows(self, search: Search) -> DataFrame:
        raise NotImplementedError

    def found(self, search: Search, frame: pd.DataFrame) -> Iterator[tuple]:
        """Arguments of Scorer.add for what is in a frame."""
        raise NotImplementedError


class OfSeries(Windows):
    """Windows of series with features, as operators.windows.event_windows gives them with these settings."""

    keys = ["MatchTicker", "__block"]
    order = "__rn"

    def __init__(self, features: DataFrame, before: int, after: int, policy: str = "any", full: bool = True, block: int | None = None) -> None:
        require(features, ["Ticker", "Date"])
        self.before, self.after, self.policy, self.full = before, after, policy, full
        self.values, self.size = roles(features)[0], block and max(block, before + after + 1)
        self._features = features

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_features"}

    def rows(self, search: Search) -> DataFrame:
        require(self._features, search.bases)
        given = [c for c in ("__rn", "__n") if c in self._features.columns]
        rows = cut(self._features.select("Ticker", "Date", *self.values, *given), self.before, self.after, self.size)
        return rows.select(F.col("Ticker").alias("MatchTicker"), "__block", "__rn", "__n", F.col("Date").cast("timestamp_ntz").alias("RefDate"), *self.values)

    def found(self, search: Search, frame: pd.DataFrame) -> Iterator[tuple]:
        if search.lookback > self.before + 1:
            return
        match = [self.values.index(b) for b in search.bases]
        starts = [*runs_of(frame, self.keys), len(frame)]
        for a, b in zip(starts, starts[1:], strict=False):
            run = frame.iloc[a:b]
            rn, n, block, ticker = run["__rn"].to_numpy(), run["__n"].iloc[0], run["__block"].iloc[0], run["MatchTicker"].iloc[0]
            centres = np.flatnonzero((self.size is None or rn // self.size == block) & (rn >= self.before) & (rn < n - self.after))
            at, points, following = series_windows(search, self.before, self.after, self.policy, self.full, run[self.values].to_numpy(float).T, match, centres)
            yield points, np.full(len(at), f"{ticker}_rebased.parquet"), np.full(len(at), str(ticker)), run["RefDate"].to_numpy("datetime64[us]")[at], following


class Stored(Windows):
    """Windows as rows (Ticker, RefDate, Offset, the match columns, and SourceFile if known), as files hold them."""

    keys = KEYS
    order = "Offset"

    def __init__(self, windows: DataFrame) -> None:
        require(windows, ["Ticker", "RefDate", "Offset"])
        self._windows = windows

    def __getstate__(self) -> dict:
        return {}

    def rows(self, search: Search) -> DataFrame:
        require(self._windows, list(search.columns))
        source = F.col("SourceFile") if "SourceFile" in self._windows.columns else F.concat("Ticker", F.lit("_rebased.parquet"))
        rows = self._windows.where(F.col("Offset").between(1 - search.lookback, search.horizon))
        return rows.select(source.alias("SourceFile"), F.col("Ticker").alias("MatchTicker"), F.col("RefDate").cast("timestamp_ntz").alias("RefDate"), F.col("Offset").cast("int").alias("Offset"), *search.columns)

    def found(self, search: Search, frame: pd.DataFrame) -> Iterator[tuple]:
        n, values = search.lookback, frame[list(search.columns)].to_numpy(float)
        starts = np.array(runs_of(frame, self.keys))
        ends = np.r_[starts[1:], len(frame)]
        early = frame["Offset"].to_numpy() <= 0
        holes = np.r_[0, np.cumsum(early & np.isnan(values).any(axis=1))]
        seen = np.add.reduceat(early.astype(int), starts)
        fine = (seen == n) & (holes[ends] == holes[starts])
        starts, ends = starts[fine], ends[fine]
        points = values[starts[:, None] + np.arange(n)].transpose(0, 2, 1)
        keys = [frame[k].to_numpy()[starts] for k in KEYS]

        def following(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            rows = ends[at] - starts[at] - n
            place = np.minimum(starts[at][:, None] + n + np.arange(search.horizon), len(values) - 1)
            return values[place].transpose(0, 2, 1), rows

        yield points, keys[0].astype(str), keys[1].astype(str), keys[2].astype("datetime64[us]"), following


def table_of(search: Search, names: np.ndarray, found: Found) -> pa.RecordBatch:
    """Found rows as Arrow has them."""
    ends = np.r_[0, np.cumsum(found.rows)].astype(np.int32)
    inside = np.arange(found.after.shape[2])[None, :] < found.rows[:, None]
    then = [pa.ListArray.from_arrays(pa.array(ends), pa.array(found.after[:, c][inside].astype(float), pa.float64(), from_pandas=True)) for c in range(len(search.columns))]
    columns = [pa.array(names[found.query], pa.string()), pa.array(found.source.astype(object), pa.string()), pa.array(found.ticker.astype(object), pa.string()), pa.array(found.day.astype("datetime64[us]")), pa.array(found.score, pa.float64()), pa.array(found.rank, pa.float64()), *then]
    return pa.RecordBatch.from_arrays(columns, names=["QueryTicker", *KEYS, "Score", "__rank", *[f"__after_{c}" for c in range(len(search.columns))]])


def scored(search: Search, windows: Windows, names: np.ndarray, queries: np.ndarray, runs: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
    """All scores, or the best of each query, over the runs of rows that a task reads."""
    scorer = Scorer(search, queries)
    for frame in runs:
        for part in windows.found(search, frame):
            for found in scorer.add(*part):
                yield table_of(search, names, found)
    for found in scorer.kept:
        yield table_of(search, names, found)


def packed(points: DataFrame, search: Search) -> DataFrame:
    """QueryTicker, points: one row per query, its values column after column in order of Offset."""
    each = points.groupBy("QueryTicker").agg(F.array_sort(F.collect_list(F.struct("Offset", *search.columns))).alias("p"))
    return each.select("QueryTicker", F.flatten(F.array(*[F.col("p")[c] for c in search.columns])).alias("points"))


def shaped(points: list, search: Search) -> np.ndarray:
    return np.array([list(p) for p in points], float).reshape(len(points), len(search.columns), search.lookback)


def matches(queries: DataFrame, windows: Windows, search: Search) -> DataFrame:
    """QueryTicker, SourceFile, MatchTicker, RefDate, Score, __rank, __after_<k>: what the tasks found; of the best, some more than are wanted."""
    spark = queries.sparkSession
    asked, rows = packed(queries, search), windows.rows(search)
    then = "".join(f", __after_{c} array<double>" for c in range(len(search.columns)))
    schema = f"QueryTicker string, SourceFile string, MatchTicker string, RefDate timestamp_ntz, Score double, __rank double{then}"
    few = asked.orderBy("QueryTicker").limit(QUERY_BLOCK + 1).collect()
    if len(few) <= QUERY_BLOCK:
        names, known = np.array([r.QueryTicker for r in few], object), shaped([r.points for r in few], search)
        ordered = rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*windows.keys).orderBy(windows.order)))  # asks for rows together and in order, whoever provides it

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if len(names):
                yield from scored(search, windows, names, known, whole_runs((b.to_pandas() for b in batches), windows.keys))

        return ordered.mapInArrow(scan, schema)

    blocks = -(-asked.count() // QUERY_BLOCK)
    cells = max(1, -(-rows.count() // CELL_ROWS))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = asked.select(F.pmod(F.xxhash64("QueryTicker"), F.lit(blocks)).alias("i"), numbers(cells).alias("j"), "QueryTicker", "points")
    right = rows.select(numbers(blocks).alias("i"), F.pmod(F.xxhash64(*windows.keys), F.lit(cells)).alias("j"), *rows.columns)

    def cell(asked: pa.Table, rows: pa.Table) -> pa.Table:
        own = asked.sort_by("QueryTicker")
        frame = rows.to_pandas().sort_values([*windows.keys, windows.order], kind="stable")
        names = np.array(own["QueryTicker"].to_pylist(), object)
        parts = list(scored(search, windows, names, shaped(own["points"].to_pylist(), search), iter([frame]))) if len(names) and len(frame) else []
        return pa.Table.from_batches(parts) if parts else table_of(search, np.empty(0, object), nothing(search)).schema.empty_table()

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(cell, schema)


def nothing(search: Search) -> Found:
    none = np.empty(0)
    return Found(none.astype(int), none, none, none.astype(str), none.astype(str), none.astype("datetime64[us]"), np.empty((0, len(search.columns), 0)), none.astype(int))


def closest(queries: DataFrame, windows: Windows, search: Search) -> DataFrame:
    """QueryTicker, Rank, SourceFile, MatchTicker, RefDate, Score, Future: the search.top best windows of each query.

    queries: points as match.query_points gives them.  Future: the match columns of up to search.horizon rows after the
    day, in order; values that are not finite are null.  Ties go by source file, ticker and day.
    """
    found = matches(queries, windows, search)
    order = Window.partitionBy("QueryTicker").orderBy("__rank", "SourceFile", "MatchTicker", "RefDate")
    best = found.withColumn("Rank", F.row_number().over(order)).where(F.col("Rank") <= search.top)
    after = F.arrays_zip(*[F.col(f"__after_{c}").alias(name) for c, name in enumerate(search.columns)])
    shown = F.transform(after, lambda x: F.struct(*[F.when(finite(x[c]), x[c]).alias(c) for c in search.columns]))
    return best.select("QueryTicker", "Rank", *KEYS, "Score", shown.alias("Future"))


def futures_of(best: DataFrame) -> DataFrame:
    """QueryTicker, MatchTicker, RefDate, FutureOffset and the match columns: what followed each of the best windows."""
    rows = best.select("QueryTicker", "MatchTicker", "RefDate", F.posexplode("Future").alias("__pos", "__row"))
    names = best.schema["Future"].dataType.elementType.fieldNames()
    return rows.select("QueryTicker", "MatchTicker", "RefDate", (F.col("__pos") + 1).alias("FutureOffset"), *[F.col("__row")[c].alias(c) for c in names])


def all_scores(queries: DataFrame, windows: Windows, search: Search) -> DataFrame:
    """QueryTicker, SourceFile, MatchTicker, RefDate, Score of every query and complete window."""
    return matches(queries, windows, search).select("QueryTicker", *KEYS, "Score")


def search_of(lookback: int, columns: Sequence[str], metric: str = "mse", weights: Sequence[float] | None = None, horizon: int = 0, top: int | None = None, places: int | None = None) -> Search:
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    return Search(lookback, tuple(columns), metric, tuple(parsed_weights(weights, columns)), horizon, top, places)
