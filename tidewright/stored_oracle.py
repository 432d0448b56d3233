"""SQL for DuckDB that gives the rows of the queries about files and stages."""

from __future__ import annotations

from .operators.match import DEFAULT_COLUMNS
from .oracle import AFTERWARDS, BARS, GAPS, HEAD, HISTORY, ROWS, SQL, TICKS, asked, dated, featured, r, ranked, scored, topped, windowed
from .queries import MATCH
from .stored_queries import HEAD as CSV_HEAD
from .stored_queries import PLACES_SHOWN, REASON, TAIL, TODAY

GAP_WINDOWS = f"{GAPS}, {windowed('gaps', ['AdjClose', 'Close'], 4, 2, 'any', False)}"
FEATURES = f"{BARS}, {featured('bars', 'AdjClose', 5, 10)}"
LAST = "last AS (SELECT * FROM ticks WHERE seq % 17 <> 0 QUALIFY row_number() OVER (PARTITION BY Ticker, Date ORDER BY seq DESC) = 1)"
CLOSE = "CASE WHEN seq % 5 <> 0 THEN price END"
PAID = "paid AS (SELECT Ticker, Date, max(price) / 100 AS Dividend FROM ticks WHERE seq % 50 = 0 GROUP BY ALL)"
SPLIT = "split AS (SELECT Ticker, Date, CAST(max(seq % 4) + 1 AS DOUBLE) AS SplitRatio FROM ticks WHERE seq % 97 = 0 GROUP BY ALL)"
WIDE = f"""{BARS}, {featured('bars', 'AdjClose', 20, 50, 200)}, {windowed('f', [c.removesuffix('_Rebased') for c in DEFAULT_COLUMNS], 75, 25, 'any', True)},
  {asked(DEFAULT_COLUMNS, 75)}, {scored('mse', (1.0,) * 4, DEFAULT_COLUMNS, 75)}, {ranked(6)}"""


def text(c: str) -> str:
    """As a rounded CSV shows a number."""
    return f"CASE WHEN {c} IS NOT NULL THEN printf('%.{PLACES_SHOWN}f', round_even({c}, {PLACES_SHOWN})) END"


def shown_as_text(*columns: str) -> str:
    return ", ".join(f"{text(c)} AS {c}" for c in columns)


def batched(*more: str) -> str:
    """CTE b: tickers t in batches of two."""
    named = "".join(f" UNION ALL SELECT '{t}', {k + 1}" for k, t in enumerate(more))
    return f"s AS (SELECT DISTINCT c_mktsegment AS t, 0 AS late FROM customer{named}), b AS (SELECT t, late, (row_number() OVER (ORDER BY late, t) - 1) // 2 AS batch FROM s)"


WITH_DATES = {
    "stored_history": f"WITH {BARS} SELECT {HEAD} FROM bars",
    "stored_ticker_history": f"WITH {BARS} SELECT {HEAD} FROM bars WHERE Ticker = 'BUILDING'",
    "prices_csv": f"WITH {BARS} SELECT Ticker, Date, {shown_as_text(*HISTORY)}, CAST(Volume AS VARCHAR) AS Volume FROM bars",
    "rewritten_partitions": f"WITH {BARS} SELECT Ticker, Date, round(CASE WHEN Ticker = 'MACHINERY' THEN Close * 2 ELSE Close END, 6) AS Close FROM bars",
    "stored_actions": f"WITH {TICKS}, {PAID} SELECT Ticker, Date, {r('Dividend')}, {text('Dividend')} AS text, FALSE AS splits_written FROM paid",
    "features_parquet": f"WITH {FEATURES} SELECT Ticker, Date, {', '.join(r(c) for c in ('Close', 'AdjClose', 'MA_5', 'MA_10'))} FROM f",
    "features_csv": f"WITH {GAPS} SELECT Ticker, Date, {shown_as_text('Close', 'AdjClose')}, CAST(Volume AS VARCHAR) AS Volume FROM gaps",
    "features_input_parquet": f"WITH {TICKS}, {LAST} SELECT Ticker, Date, {r(CLOSE, 'Close')}, {r('price', 'AdjClose')} FROM last",
    "features_input_csv": f"WITH {TICKS}, {LAST} SELECT Ticker, Date, {r(CLOSE, 'Close')}, {r('price', 'AdjClose')} FROM last",
    "windows_input": f"WITH {TICKS}, {LAST} SELECT Ticker, Date, {r(CLOSE, 'Close')}, {r('price', 'MA_3')} FROM last",
    "query_features": f"WITH {FEATURES} SELECT Ticker, Date, {r('AdjClose')}, {r('MA_5')} FROM f WHERE Ticker IN ('BUILDING', 'HOUSEHOLD')",
    "quotes_history": f"WITH {BARS} SELECT {HEAD} FROM bars",
    "stream_quotes": SQL["bars"],
    "stream_features": SQL["features_full"],
    "quotes_actions": f"WITH {TICKS}, {PAID} SELECT Ticker, Date, {r('Dividend')} FROM paid",
    "quotes_splits": f"WITH {TICKS}, {SPLIT} SELECT Ticker, Date, SplitRatio FROM split",
    "quotes_since": f"WITH {BARS} SELECT {HEAD} FROM bars WHERE Ticker <> 'BUILDING' AND Date >= DATE '1998-01-15'",
    "quote_range": f"WITH {BARS} SELECT Ticker, Date, {r('Close')}, CAST(687 AS BIGINT) AS calendar_days FROM bars WHERE Date >= DATE '{TODAY}' - 687",
}
WINDOW_ROWS = {
    "windows_parquet": f'WITH {GAP_WINDOWS} SELECT Ticker, RefDate, "Offset", Date, {r("AdjClose_Rebased")}, {r("Close_Rebased")} FROM w',
    "windows_csv": f"""WITH {GAP_WINDOWS}, n AS (SELECT *, row_number() OVER (PARTITION BY Ticker ORDER BY RefDate, "Offset") AS place, count(*) OVER (PARTITION BY Ticker) AS c FROM w)
        SELECT Ticker, RefDate, CAST("Offset" AS VARCHAR) AS "Offset", Date, {shown_as_text('AdjClose_Rebased', 'Close_Rebased')} FROM n WHERE place <= {CSV_HEAD} OR place > c - {TAIL}""",
}
STORED_SQL: dict[str, str] = {
    **{name: dated(sql, ("Date",)) for name, sql in WITH_DATES.items()},
    **{name: dated(sql, ("RefDate", "Date")) for name, sql in WINDOW_ROWS.items()},
    "reference_files": dated(f'WITH {GAP_WINDOWS} SELECT Ticker, RefDate, "Offset", TRUE AS from_file, {r("AdjClose_Rebased")}, CAST(NULL AS DOUBLE) AS MA_9_Rebased FROM w', ("RefDate",)),
    "text_tickers": f"""WITH {FEATURES}, x AS (SELECT lpad(CAST(ascii(Ticker) AS VARCHAR), 4, '0') AS Ticker, count(*) AS n, round(sum(AdjClose), 3) AS total FROM f GROUP BY 1)
        SELECT reader, x.* FROM x, (VALUES ('features'), ('windows'), ('query')) v(reader) WHERE reader <> 'query' OR Ticker IN ('0066', '0077')""",
    "topn_preset": dated(f"WITH {WIDE} SELECT QueryTicker, Rank, MatchTicker, RefDate, round(Score, 3) AS Score FROM t", ("RefDate",)),
    "no_stored_history": f"WITH {BARS} SELECT Ticker, count(*) AS n_rows, TRUE AS absent FROM bars GROUP BY 1",
    "merged_folders": f"WITH {BARS} SELECT Ticker, count(*) AS n, round(sum(Close), 2) AS total, Ticker IN ('BUILDING', 'FURNITURE') AS stayed, count(*) AS in_csv FROM bars GROUP BY Ticker",
    "run_report": f"""WITH s AS (SELECT DISTINCT c_mktsegment AS t FROM customer), st AS (SELECT t, CASE t WHEN 'BUILDING' THEN '{REASON}' WHEN 'MACHINERY' THEN 'empty' ELSE 'ok' END AS x FROM s)
        SELECT '1d' AS "interval", count(*) AS tickers_total, count(*) FILTER (WHERE x = 'ok') AS tickers_ok, count(*) FILTER (WHERE x <> 'ok') AS tickers_failed, count(*) FILTER (WHERE x = 'empty') AS empty_series,
        TRUE AS incremental, string_agg(t, ',' ORDER BY t) FILTER (WHERE x = 'ok') AS ok, string_agg(t || '=' || x, ',' ORDER BY t) FILTER (WHERE x <> 'ok') AS failed FROM st""",
    "run_log": f"WITH {BARS} SELECT Ticker || ' hentet på ny' AS event, count(*) AS n, TRUE AS stamped, FALSE AS escaped FROM bars GROUP BY Ticker",
    "stored_order": f"WITH {GAP_WINDOWS} SELECT Ticker, CAST(0 AS BIGINT) AS wrong, count(*) AS n FROM w GROUP BY 1",
    "sorted_listing": f"WITH {GAP_WINDOWS} SELECT Ticker, row_number() OVER (ORDER BY Ticker) AS place FROM (SELECT DISTINCT Ticker FROM w)",
    "generic_scan": "SELECT kind, CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, TRUE AS refused FROM nation, (VALUES ('csv'), ('parquet')) k(kind)",
    "drop_null_dates": f"WITH {TICKS} SELECT Ticker, count(*) AS before, count(*) FILTER (WHERE seq % 17 <> 0) AS after FROM ticks GROUP BY 1",
    "watch_list": "SELECT c_mktsegment || '.' || c_nationkey AS Ticker, row_number() OVER (ORDER BY c_custkey) AS place FROM customer WHERE c_custkey % 7 <> 0",
    "universe_file": """SELECT w AS ticker, w IN (SELECT lpad(CAST(c_nationkey AS VARCHAR), 4, '0') FROM customer WHERE c_custkey % 7 <> 0) AS listed FROM (VALUES ('0007'), ('0012'), ('9999')) v(w)""",
    "base_names": """WITH n AS (SELECT DISTINCT p_brand || CASE WHEN p_partkey % 2 = 0 THEN '_Rebased' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN '_B' ELSE '' END AS name FROM part)
        SELECT name, CASE WHEN name LIKE '%!_Rebased' ESCAPE '!' THEN left(name, -8) ELSE name END AS base FROM n""",
    "diff_files": ROWS["diff_verdict"],
    "fetch_retries": "SELECT DISTINCT c_mktsegment AS Ticker, 'ok' AS status FROM customer",
    "fetch_isolation": f"""WITH {batched('NONE', 'BAD', 'LAST')} SELECT t AS Ticker,
        CASE WHEN bool_or(t = 'BAD') OVER (PARTITION BY batch) THEN 'no answer' WHEN late > 0 THEN 'empty' ELSE 'ok' END AS status FROM b""",
    "failed_actions": dated(
        f"""WITH {TICKS}, {SPLIT}, {batched()}, bad AS (SELECT t FROM b WHERE batch IN (SELECT batch FROM b WHERE t = 'BUILDING'))
        SELECT t AS Ticker, CAST(NULL AS DATE) AS Date, CAST(NULL AS DOUBLE) AS SplitRatio, 'actions:no answer' AS status FROM bad
        UNION ALL SELECT Ticker, Date, SplitRatio, NULL FROM split WHERE Ticker NOT IN (SELECT t FROM bad)""",
        ("Date",),
    ),
    "run_controls": f"""WITH {BARS}, n AS (SELECT count(*) || ' rows' AS said FROM bars)
        SELECT 'validate' AS run, 'nothing' AS said, FALSE AS anything, FALSE AS report, FALSE AS history UNION ALL SELECT 'dry', said, FALSE, FALSE, FALSE FROM n
        UNION ALL SELECT 'real', said, TRUE, TRUE, TRUE FROM n UNION ALL SELECT 'empty', 'more empty series than fail_on_empty allows', TRUE, TRUE, TRUE""",
    "exit_codes": f"""WITH {BARS}, n AS (SELECT count(*) AS n FROM bars)
        SELECT call, CAST(code AS BIGINT) AS code, CASE WHEN call = 'fetched' THEN n ELSE 0 END AS bars
        FROM n, (VALUES ('diff without files', 2), ('diff of one file', 1), ('too many empty', 1), ('validated', 0), ('fetched', 0), ('no such stage', 1)) v(call, code)""",
    "no_match": "SELECT CAST(0 AS BIGINT) AS matches, 'MatchTicker,QueryTicker,Rank,RefDate,Score,SourceFile' AS columns, CAST(0 AS BIGINT) AS futures",
    "match_files": f"""WITH {topped('mse')}, {AFTERWARDS}, asked AS (SELECT * FROM t WHERE QueryTicker IN ('BUILDING', 'MACHINERY'))
        SELECT file, QueryTicker, MatchTicker, CAST(RefDate AS VARCHAR) AS RefDate, Rank AS place, round(Score, 6) AS value FROM asked, (VALUES ('scores'), ('all_scores.csv'), ('scores_csv')) v(file)
        UNION ALL SELECT 'futures', QueryTicker, MatchTicker, CAST(RefDate AS VARCHAR), FutureOffset, round({MATCH[0]}, 6) FROM fut WHERE QueryTicker IN ('BUILDING', 'MACHINERY')""",
}
