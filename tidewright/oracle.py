"""SQL for DuckDB that gives the rows of the registered queries: window functions, ordinal joins and a recursive query."""

from __future__ import annotations

from .operators.compare import ABSOLUTE, RELATIVE
from .queries import AFTER, BEFORE, HORIZON, LOOKBACK, MATCH, PLACES, SCORE_PLACES, TOP, WEIGHTS

TICKS = "ticks AS (SELECT c_mktsegment AS Ticker, CAST(o_orderdate AS DATE) AS Date, o_orderkey AS seq, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey)"
BRAND_TICKS = "ticks AS (SELECT p_brand AS Ticker, CAST(l_shipdate AS DATE) AS Date, l_orderkey * 8 + l_linenumber AS seq, l_extendedprice AS price FROM lineitem JOIN part ON l_partkey = p_partkey)"
DAYS = """bars AS (
  SELECT Ticker, Date, arg_min(price, seq) AS Open, max(price) AS High, min(price) AS Low, arg_max(price, seq) AS Close,
         arg_max(price, seq) * (CAST(year(Date) AS DOUBLE) / 1999) AS AdjClose, count(*) AS Volume
  FROM ticks GROUP BY Ticker, Date)"""
BARS = f"{TICKS}, {DAYS}"
GAPS = f"""{BARS}, gaps AS (
  SELECT * REPLACE (CASE WHEN dayofyear(Date) % 11 = 0 THEN NULL WHEN dayofyear(Date) % 13 = 0 THEN 0 ELSE AdjClose END AS AdjClose) FROM bars)"""
HISTORY = ["Open", "High", "Low", "Close", "AdjClose"]


def r(c: str, name: str | None = None) -> str:
    return f"round({c}, {PLACES}) AS {name or c}"


def ma(c: str, n: int) -> str:
    frame = f"OVER (PARTITION BY Ticker ORDER BY Date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {frame} = {n} THEN avg({c}) {frame} END"


def featured(source: str, price: str, *lengths: int, extra: str = "") -> str:
    """CTE f: rows of source with a price, and their averages."""
    return f"f AS (SELECT *{''.join(f', {ma(price, n)} AS MA_{n}' for n in lengths)}{extra} FROM {source} WHERE {price} IS NOT NULL)"


def smoothed(source: str, n: int) -> str:
    """CTE s: Ticker, Date, rn, m (changes so far), g and l (smoothed gain and loss)."""
    return f"""changes AS (
  SELECT Ticker, Date, row_number() OVER (PARTITION BY Ticker ORDER BY Date) - 1 AS rn, AdjClose - lag(AdjClose) OVER (PARTITION BY Ticker ORDER BY Date) AS d
  FROM {source} WHERE AdjClose IS NOT NULL
), s AS (
  SELECT Ticker, Date, rn, 0 AS m, CAST(NULL AS DOUBLE) AS g, CAST(NULL AS DOUBLE) AS l FROM changes WHERE rn = 0
  UNION ALL
  SELECT c.Ticker, c.Date, c.rn, s.m + 1,
         CASE WHEN s.m = 0 THEN greatest(c.d, 0) ELSE s.g * (1 - 1e0 / {n}) + greatest(c.d, 0) / {n} END,
         CASE WHEN s.m = 0 THEN greatest(-c.d, 0) ELSE s.l * (1 - 1e0 / {n}) + greatest(-c.d, 0) / {n} END
  FROM s JOIN changes c ON c.Ticker = s.Ticker AND c.rn = s.rn + 1
)"""


def rsi(n: int) -> str:
    return f"CASE WHEN m >= {n} THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END"


def windowed(source: str, values: list[str], before: int, after: int, policy: str, full: bool, rsi_columns: tuple[str, ...] = ()) -> str:
    """CTE w: Ticker, RefDate, Offset, Date, <value>_Rebased, RSI."""
    kept = {"none": "TRUE", "any": " AND ".join(f"{v}_Rebased IS NOT NULL" for v in values), "all": " OR ".join(f"{v}_Rebased IS NOT NULL" for v in values)}[policy]
    cells = ", ".join(f"CASE WHEN c.{v} <> 0 THEN r.{v} / c.{v} * 100 END AS {v}_Rebased" for v in values)
    usable = " OR ".join(f"coalesce(c.{v} <> 0, FALSE)" for v in values)
    whole = f" QUALIFY count(*) FILTER (WHERE {kept}) OVER (PARTITION BY Ticker, RefDate) = {before + after + 1}" if full else ""
    return f"""o AS (
  SELECT *, row_number() OVER (PARTITION BY Ticker ORDER BY Date) - 1 AS rn, count(*) OVER (PARTITION BY Ticker) AS n FROM {source}
), centres AS (
  SELECT * FROM o c WHERE rn >= {before} AND rn < n - {after} AND ({usable})
), spread AS (
  SELECT c.*, unnest(range({-before}, {after + 1})) AS k FROM centres c
), every AS (
  SELECT c.Ticker, c.Date AS RefDate, c.k AS "Offset", r.Date, {cells}{''.join(f', r.{x}' for x in rsi_columns)}
  FROM spread c JOIN o r ON r.Ticker = c.Ticker AND r.rn = c.rn + c.k
), w AS (
  SELECT * FROM every WHERE ({kept}){whole}
)"""


def window_query(with_: str, values: list[str], rsi_columns: tuple[str, ...] = ()) -> str:
    return f'WITH RECURSIVE {with_} SELECT Ticker, RefDate, "Offset", Date, {", ".join(r(f"{v}_Rebased") for v in values)}{"".join(", " + r(x) for x in rsi_columns)} FROM w'


VALUES = ["AdjClose", "Close", "MA_5", "MA_10"]


def asked(columns: tuple[str, ...] = MATCH, lookback: int = LOOKBACK) -> str:
    """CTE q: the last days of each ticker of f, rebased to the last one."""
    bases = {c: c.removesuffix("_Rebased") for c in columns}
    whole = "OVER (PARTITION BY Ticker ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"""q AS (
  SELECT Ticker AS QueryTicker, 1 - back AS "Offset", {', '.join(f'{b} / {b}_last * 100 AS {c}' for c, b in bases.items())}
  FROM (SELECT *, row_number() OVER (PARTITION BY Ticker ORDER BY Date DESC) AS back, {', '.join(f'last_value({b}) {whole} AS {b}_last' for b in bases.values())} FROM f)
  WHERE back <= {lookback})"""


ASKED = asked()
MATCHING = f"{BARS}, {featured('bars', 'AdjClose', 5, 10)}, {windowed('f', VALUES, BEFORE, AFTER, 'any', True)}, {ASKED}"


def scored(metric: str, weights: tuple[float, ...] = (1.0, 1.0, 1.0), columns: tuple[str, ...] = MATCH, lookback: int = LOOKBACK) -> str:
    """CTE s: every query, window and score."""
    one = {"mse": "avg(pow(w.{c} - q.{c}, 2))", "corr": "1 - coalesce(covar_pop(w.{c}, q.{c}) / nullif(stddev_pop(w.{c}) * stddev_pop(q.{c}), 0), 0)"}[metric]
    total = " + ".join(f"{wt} * ({one.format(c=c)})" for wt, c in zip(weights, columns, strict=True))
    return f"""s AS (
  SELECT QueryTicker, w.Ticker AS MatchTicker, RefDate, w.Ticker || '_rebased.parquet' AS SourceFile, ({total}) / {sum(weights)} AS Score
  FROM w JOIN q ON w."Offset" = q."Offset" GROUP BY QueryTicker, w.Ticker, RefDate HAVING count(*) = {lookback}{"".join(f" AND count(q.{c}) = {lookback}" for c in columns)})"""


def ranked(places: int = 9) -> str:
    """CTE t: the best scores of each query."""
    return f"""t AS (
  SELECT *, row_number() OVER (PARTITION BY QueryTicker ORDER BY round(Score, {places}), SourceFile, MatchTicker, RefDate) AS Rank FROM s QUALIFY Rank <= {TOP})"""


def topped(metric: str, weights: tuple[float, ...] = (1.0, 1.0, 1.0)) -> str:
    return f"{MATCHING}, {scored(metric, weights)}, {ranked()}"


AFTERWARDS = f"""fut AS (
  SELECT QueryTicker, MatchTicker, t.RefDate, row_number() OVER (PARTITION BY QueryTicker, MatchTicker, t.RefDate ORDER BY w."Offset") AS FutureOffset, {', '.join(f'w.{c}' for c in MATCH)}
  FROM t JOIN w ON w.Ticker = MatchTicker AND w.RefDate = t.RefDate WHERE w."Offset" BETWEEN 1 AND {HORIZON})"""
PROFILE = "SELECT QueryTicker, MatchTicker, count(*) AS n, " + ", ".join(f"round({f}(Score), {SCORE_PLACES}) AS {f}_score" for f in ("avg", "min", "max")) + " FROM s GROUP BY ALL"
BEST = f"SELECT QueryTicker, Rank, MatchTicker, RefDate, SourceFile, {r('Score')} FROM t"
UNIVERSE = "u AS (SELECT trim(o_orderpriority) AS ticker, min(o_orderkey) AS ord FROM orders WHERE trim(o_orderpriority) <> '' GROUP BY 1)"
WANTED = "wanted(ticker) AS (VALUES ('1-URGENT'), ('5-LOW'), ('9-NONE'))"
HEAD = "Ticker, Date, " + ", ".join(r(c) for c in HISTORY) + ", Volume"
COPIES = f"""{BARS}, a AS (SELECT Ticker, Date, Open, Close, Volume FROM bars), b AS (
  SELECT Ticker, Date, Open * (1 + 1e-7::DOUBLE) AS Open, Volume,
         CASE WHEN dayofyear(Date) % 31 = 0 THEN Close * 1.01::DOUBLE WHEN dayofyear(Date) % 29 = 0 THEN NULL ELSE Close END AS Close
  FROM a WHERE dayofyear(Date) % 97 <> 0
), p AS (
  SELECT a.Ticker AS lt, b.Ticker AS rt, {', '.join(f'CAST(a.{c} AS DOUBLE) AS l{c}, CAST(b.{c} AS DOUBLE) AS r{c}' for c in ('Open', 'Close', 'Volume'))}
  FROM a FULL JOIN b ON a.Ticker = b.Ticker AND a.Date = b.Date
), d AS ({' UNION ALL '.join(f'''
  SELECT '{c}' AS "column", count(*) FILTER (WHERE lt IS NOT NULL AND l{c} IS NULL) AS left_nulls, count(*) FILTER (WHERE rt IS NOT NULL AND r{c} IS NULL) AS right_nulls,
         count(*) FILTER (WHERE abs(l{c} - r{c}) > {ABSOLUTE} + {RELATIVE} * abs(r{c})) AS mismatches, count(*) FILTER (WHERE lt IS NULL OR rt IS NULL) AS unpaired
  FROM p''' for c in ('Open', 'Close', 'Volume'))}
)"""
GAP_VALUES = ["AdjClose", "Close"]
FULL_FEATURES = ", ".join(["f.Ticker", "f.Date", *[r(f"f.{c}", c) for c in HISTORY], "f.Volume", *[r(f"MA_{n}") for n in (20, 50, 200)], r(rsi(14), "RSI_14")])
DEDUP = "WITH {t} SELECT Ticker, Date, seq, {p} FROM ticks QUALIFY row_number() OVER (PARTITION BY Ticker, Date ORDER BY seq {o}) = 1"

ROWS: dict[str, str] = {
    "universe_distinct": f"WITH {UNIVERSE} SELECT ticker, ord FROM u",
    "universe_only_semi": f"WITH {UNIVERSE}, {WANTED} SELECT ticker, ord FROM u WHERE ticker IN (SELECT ticker FROM wanted)",
    "universe_missing_anti": f"WITH {UNIVERSE}, {WANTED} SELECT ticker FROM wanted WHERE ticker NOT IN (SELECT ticker FROM u)",
    "normalize_prices": f"""WITH {TICKS} SELECT Ticker, Date, {r('price', 'Open')}, CAST(NULL AS DOUBLE) AS High, CAST(NULL AS DOUBLE) AS Low,
        round(CASE WHEN seq % 5 <> 0 THEN price END, {PLACES}) AS Close, {r('price / 2', 'AdjClose')}, seq % 100 AS Volume
        FROM ticks QUALIFY row_number() OVER (PARTITION BY Ticker, Date ORDER BY seq) = 1""",
    "local_midnight": """SELECT local, strftime(timezone('UTC', timezone('Europe/Copenhagen', CAST(local AS TIMESTAMP))), '%Y-%m-%d %H:%M') AS utc
        FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS local FROM orders)""",
    "bars": f"WITH {BARS} SELECT {HEAD} FROM bars",
    "brand_bars": f"WITH {BRAND_TICKS}, {DAYS} SELECT {HEAD} FROM bars",
    "adjusted_only": f"WITH {BARS} SELECT Ticker, Date, {r('AdjClose', 'Close')} FROM bars",
    "dedup_first": DEDUP.format(t=TICKS, p=r("price"), o="ASC"),
    "dedup_last": DEDUP.format(t=TICKS, p=r("price"), o="DESC"),
    "latest_event": f"SELECT event_type, event_id, {r('value')} FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1",
    "incremental_merge": f"""WITH {TICKS}, first AS (SELECT * FROM ticks QUALIFY row_number() OVER (PARTITION BY Ticker, Date ORDER BY seq) = 1),
        stored AS (SELECT Ticker, Date, price * 10 AS price FROM ticks WHERE seq % 3 = 0 QUALIFY row_number() OVER (PARTITION BY Ticker, Date ORDER BY seq) = 1)
        SELECT Ticker, Date, {r('price')} FROM stored UNION ALL
        SELECT Ticker, Date, {r('price')} FROM first f WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.Ticker = f.Ticker AND s.Date = f.Date)""",
    "union_by_name": f"""WITH {BARS} SELECT Ticker, Date, {r('Close')}, CAST(NULL AS DOUBLE) AS Volume FROM bars
        UNION ALL SELECT Ticker, Date, NULL, CAST(Volume AS DOUBLE) FROM bars""",
    "drop_null_price": f"WITH {GAPS} SELECT Ticker, Date, {r('AdjClose')} FROM gaps WHERE AdjClose IS NOT NULL",
    "delta": f"WITH {BARS} SELECT Ticker, Date, round(Close - lag(Close) OVER (PARTITION BY Ticker ORDER BY Date), {PLACES}) AS delta FROM bars",
    "ma_single": f"WITH {BARS} SELECT Ticker, Date, {r(ma('Close', 20), 'MA_20')} FROM bars",
    "ma_multi": f"WITH {BARS} SELECT Ticker, Date, {', '.join(r(ma('Close', n), f'MA_{n}') for n in (20, 50, 200))} FROM bars",
    "ma_with_gaps": f"WITH {GAPS} SELECT Ticker, Date, {', '.join(r(ma('AdjClose', n), f'MA_{n}') for n in (3, 5))} FROM gaps",
    **{n: f"WITH RECURSIVE {BARS}, {smoothed('bars', 14)} SELECT Ticker, Date, round(g, 4) AS gain, round(l, 4) AS loss FROM s" for n in ("ewm_gain_loss", "ewm_in_blocks")},
    "rsi": f"WITH RECURSIVE {BARS}, {smoothed('bars', 14)} SELECT Ticker, Date, {r(rsi(14), 'RSI_14')} FROM s",
    "rsi_pandas_route": f"WITH RECURSIVE {BARS}, {smoothed('bars', 14)} SELECT Ticker, Date, {r(rsi(14), 'RSI_14')} FROM s",
    "rsi_flat": f"""WITH {BARS} SELECT Ticker, Date, CASE WHEN row_number() OVER (PARTITION BY Ticker ORDER BY Date) > 14 THEN 100e0 END AS RSI_14 FROM bars""",
    **dict.fromkeys(("features_full", "features_in_blocks"), f"""WITH RECURSIVE {GAPS}, {featured('gaps', 'AdjClose', 20, 50, 200)}, {smoothed('gaps', 14)}
        SELECT {FULL_FEATURES} FROM f JOIN s ON f.Ticker = s.Ticker AND f.Date = s.Date"""),
    "ordinal": f"WITH {BARS} SELECT Ticker, Date, row_number() OVER (PARTITION BY Ticker ORDER BY Date) - 1 AS rn, count(*) OVER (PARTITION BY Ticker) AS n FROM bars",
    **{
        f"windows_{'full_' if full else ''}{policy}": window_query(f"{GAPS}, {windowed('gaps', GAP_VALUES, 4, 2, policy, full)}", GAP_VALUES)
        for policy, full in (("none", False), ("any", False), ("all", False), ("any", True), ("all", True))
    },
    "windows_with_rsi": window_query(
        f"{BARS}, {smoothed('bars', 3)}, rs AS (SELECT Ticker, Date, {rsi(3)} AS RSI_3 FROM s), src AS (SELECT * FROM bars JOIN rs USING (Ticker, Date)), "
        f"{featured('src', 'AdjClose', 5)}, {windowed('f', ['AdjClose', 'Close', 'MA_5'], 3, 2, 'any', False, ('RSI_3',))}",
        ["AdjClose", "Close", "MA_5"],
        ("RSI_3",),
    ),
    **dict.fromkeys(("windows_profile", "windows_in_blocks"), f"""WITH {BARS}, {featured('bars', 'AdjClose', 20, 50, 200)}, {windowed('f', ['AdjClose', 'Close', 'MA_20', 'MA_50', 'MA_200'], 75, 25, 'any', True)}
        SELECT "Offset", count(*) AS n, {', '.join(r(f'avg({v}_Rebased)', f'avg_{v}_Rebased') for v in ('AdjClose', 'Close', 'MA_20', 'MA_50', 'MA_200'))} FROM w GROUP BY 1"""),
    "brand_profile": f"""WITH {BRAND_TICKS}, {DAYS}, {featured('bars', 'AdjClose', 20)}, {windowed('f', ['AdjClose', 'Close', 'MA_20'], 10, 5, 'all', False)}
        SELECT Ticker, "Offset", count(*) AS n, {r('avg(AdjClose_Rebased)', 'avg_adj')}, {r('avg(MA_20_Rebased)', 'avg_ma')} FROM w GROUP BY 1, 2""",
    "query_vectors": f"""WITH {BARS}, {featured('bars', 'AdjClose', 5, 10)}, {ASKED} SELECT QueryTicker, "Offset", {', '.join(r(c) for c in MATCH)} FROM q""",
    "query_status": f"""WITH {GAPS}, src AS (SELECT Ticker, Date, AdjClose, Close AS MA_5 FROM gaps WHERE Ticker <> 'BUILDING' OR Date >= DATE '1998-07-20'),
        last AS (SELECT Ticker, arg_max(AdjClose, Date) FILTER (WHERE TRUE) AS x, max(Date) AS newest FROM src GROUP BY Ticker),
        ends AS (SELECT s.Ticker, s.AdjClose AS a, s.MA_5 AS b FROM src s JOIN last l ON s.Ticker = l.Ticker AND s.Date = l.newest),
        rows AS (SELECT s.*, row_number() OVER (PARTITION BY s.Ticker ORDER BY Date DESC) AS back FROM src s)
        SELECT rows.Ticker AS QueryTicker, CASE WHEN count(*) < {LOOKBACK} THEN 'short'
          WHEN count(CASE WHEN a <> 0 THEN AdjClose END) < {LOOKBACK} OR count(CASE WHEN b <> 0 THEN MA_5 END) < {LOOKBACK} THEN 'missing' ELSE 'ok' END AS status
        FROM rows JOIN ends ON rows.Ticker = ends.Ticker WHERE back <= {LOOKBACK} GROUP BY 1""",
    "window_complete": f"""WITH {GAPS}, {windowed('gaps', GAP_VALUES, 4, 2, 'all', False)} SELECT Ticker AS MatchTicker, RefDate FROM w WHERE "Offset" BETWEEN -4 AND 0
        GROUP BY 1, 2 HAVING count(*) = 5 AND count(AdjClose_Rebased) = 5 AND count(Close_Rebased) = 5""",
    "score_mse": f"WITH {MATCHING}, {scored('mse')} {PROFILE}",
    "score_corr": f"WITH {MATCHING}, {scored('corr')} {PROFILE}",
    "score_weighted": f"WITH {MATCHING}, {scored('mse', WEIGHTS)} {PROFILE}",
    "score_mse_arrays": f"WITH {MATCHING}, {scored('mse')} {PROFILE}",
    "topn_matches": f"WITH {topped('mse')} {BEST}",
    "topn_corr_weighted": f"WITH {topped('corr', WEIGHTS)} {BEST}",
    **dict.fromkeys(("futures", "futures_in_blocks"), f"WITH {topped('mse')}, {AFTERWARDS} SELECT QueryTicker, MatchTicker, RefDate, FutureOffset, {', '.join(r(c) for c in MATCH)} FROM fut"),
    "score_many_queries": f"""WITH {BARS}, {featured('bars', 'AdjClose', 5, 10)}, {windowed('f', VALUES, BEFORE, AFTER, 'any', True)}, q AS (
          SELECT e.Ticker || ' ' || strftime(e.Date, '%Y-%m-%d') AS QueryTicker, k AS "Offset", {', '.join(f"p.{c.removesuffix('_Rebased')} / e.{c.removesuffix('_Rebased')} * 100 AS {c}" for c in MATCH)}
          FROM (SELECT *, unnest(range({1 - LOOKBACK}, 1)) AS k FROM o WHERE dayofyear(Date) % 10 = 0 AND rn >= {LOOKBACK - 1}) e JOIN o p ON p.Ticker = e.Ticker AND p.rn = e.rn + e.k
          QUALIFY count(p.MA_10) OVER (PARTITION BY e.Ticker, e.Date) = {LOOKBACK}
        ), {scored('mse')}, t AS (SELECT *, row_number() OVER (PARTITION BY QueryTicker ORDER BY round(Score, {SCORE_PLACES}), SourceFile, MatchTicker, RefDate) AS Rank FROM s QUALIFY Rank <= 2)
        SELECT QueryTicker, Rank, MatchTicker, RefDate, round(Score, {SCORE_PLACES}) AS Score FROM t""",
    "futures_positional": f"""WITH {GAPS}, {windowed('gaps', ['AdjClose'], 2, 4, 'any', False)}, c AS (SELECT Ticker, RefDate FROM w WHERE "Offset" = 0)
        SELECT 'Q' AS QueryTicker, w.Ticker AS MatchTicker, w.RefDate, row_number() OVER (PARTITION BY w.Ticker, w.RefDate ORDER BY "Offset") AS FutureOffset, {r('AdjClose_Rebased')}
        FROM w JOIN c ON w.Ticker = c.Ticker AND w.RefDate = c.RefDate WHERE "Offset" BETWEEN 1 AND 4""",
    "all_scores": f"""WITH {topped('mse')} SELECT QueryTicker, MatchTicker, RefDate, {r('Score')}, SourceFile, CAST({LOOKBACK} AS BIGINT) AS Lookback, CAST({HORIZON} AS BIGINT) AS Horizon,
        'mse' AS Metric, '{','.join(MATCH)}' AS MatchCols FROM t""",
    "plot_frame": f"""WITH {topped('mse')}, {AFTERWARDS}, k AS (SELECT *, dense_rank() OVER (PARTITION BY QueryTicker ORDER BY MatchTicker, RefDate) AS nth FROM fut)
        SELECT QueryTicker, 'query' AS series, "Offset" AS x, {r(MATCH[0], 'y')} FROM q
        UNION ALL SELECT QueryTicker, MatchTicker || ' ' || strftime(RefDate, '%Y-%m-%d'), FutureOffset, round({MATCH[0]}, {PLACES}) FROM k WHERE nth <= 5""",
    "csv_sample": f"""WITH {BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY Ticker ORDER BY Date) AS rn, count(*) OVER (PARTITION BY Ticker) AS c FROM bars)
        SELECT Ticker, Date, {r('Close')} FROM n WHERE rn <= 30 OR rn > c - 20""",
    "round_dp": "SELECT o_orderkey, printf('%.4f', round_even(o_totalprice / 7, 4)) AS shown FROM orders",
    "safe_filename": """WITH names AS (SELECT DISTINCT ' ' || replace(o_orderpriority, '-', '/:"') || ' x' AS name FROM orders UNION ALL SELECT unnest(['BRK/B', '  ', 'a<>b c', '0700']))
        SELECT name, coalesce(nullif(replace(trim(regexp_replace(name, '[\\\\/:*?"<>|]+', '_', 'g')), ' ', '_'), ''), 'NA') AS safe FROM names""",
    "split_lists": """SELECT cell, array_to_string(list_filter(list_transform(string_split(cell, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS entries
        FROM (SELECT DISTINCT c_mktsegment || ' ,, ' || c_nationkey || ' ,' AS cell FROM customer)""",
    "batches": f"WITH {UNIVERSE} SELECT ticker, ord, CAST(floor((row_number() OVER (ORDER BY ord, ticker) - 1) / 2) AS BIGINT) AS batch FROM u",
    "ticker_counts": f"WITH {BARS} SELECT Ticker, count(*) AS n_rows FROM bars GROUP BY 1",
    "ticker_nunique": f"WITH {BARS} SELECT count(DISTINCT Ticker) AS n_tickers FROM bars",
    "run_summary": f"""WITH {BARS}, st AS (SELECT Ticker, CASE WHEN Ticker = 'MACHINERY' THEN 'empty' ELSE 'ok' END AS status FROM (SELECT DISTINCT Ticker FROM bars) UNION ALL SELECT 'NONE', 'empty')
        SELECT count(*) AS tickers_total, count(*) FILTER (WHERE status = 'ok') AS tickers_ok, count(*) FILTER (WHERE status <> 'ok') AS tickers_failed,
        count(*) FILTER (WHERE status = 'empty') AS empty_series FROM st""",
    "diff_columns": f'WITH {COPIES} SELECT *, mismatches = 0 AS same FROM d',
    "diff_verdict": f"""WITH {COPIES} SELECT (SELECT count(*) FROM a) AS left_rows, (SELECT count(*) FROM b) AS right_rows, coalesce(x, '') AS mismatched,
        coalesce(x, '') = '' AND (SELECT count(*) FROM a) = (SELECT count(*) FROM b) AS all_match FROM (SELECT string_agg("column", ',' ORDER BY "column") AS x FROM d WHERE mismatches > 0)""",
}

#: Queries whose results have dates, which are compared as text.
DATED: dict[tuple[str, ...], tuple[str, ...]] = {
    ("Date",): (
        *("normalize_prices", "bars", "brand_bars", "adjusted_only", "dedup_first", "dedup_last", "incremental_merge", "union_by_name", "drop_null_price", "delta"),
        *("ma_single", "ma_multi", "ma_with_gaps", "ewm_gain_loss", "ewm_in_blocks", "rsi", "rsi_pandas_route", "rsi_flat", "features_full", "features_in_blocks", "ordinal", "csv_sample"),
    ),
    ("local",): ("local_midnight",),
    ("RefDate", "Date"): ("windows_none", "windows_any", "windows_all", "windows_full_any", "windows_full_all", "windows_with_rsi"),
    ("RefDate",): ("window_complete", "topn_matches", "topn_corr_weighted", "futures", "futures_in_blocks", "score_many_queries", "futures_positional", "all_scores"),
}


def dated(sql: str, columns: tuple[str, ...]) -> str:
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in columns)}) FROM ({sql})"


SQL: dict[str, str] = {**ROWS, **{name: dated(ROWS[name], columns) for columns, names in DATED.items() for name in names}}
