"""The same results in SQL over the given tables."""

from __future__ import annotations

from ledgerlark.plans.screening import COLUMN_PROGRAM
from ledgerlark.schema import BASE_COLUMNS, KEY_COLUMNS

from .standins import WIDE

_LINES = """
lines AS (
    SELECT l_orderkey,
           sum(CASE WHEN l_returnflag = 'A' THEN net ELSE 0 END) AS accepted,
           sum(CASE WHEN l_returnflag = 'N' THEN net ELSE 0 END) AS kept,
           sum(CASE WHEN l_returnflag = 'R' THEN net ELSE 0 END) AS returned,
           sum(CASE WHEN l_linestatus = 'F' THEN net ELSE 0 END) AS shipped,
           sum(CASE WHEN l_linestatus = 'F' THEN net * (1 - tax) ELSE 0 END) AS after_tax,
           sum(CASE WHEN l_linestatus = 'O' THEN extended * tax END) AS open_tax
    FROM (
        SELECT *, l_extendedprice AS extended, l_tax AS tax, l_extendedprice * (1 - l_discount) AS net
        FROM lineitem
    ) AS priced
    GROUP BY l_orderkey
)
"""

_PANEL_SUMS = """
           round(sum(price), 6) AS total_assets,
           round(sum(CASE WHEN o_orderstatus = 'O' THEN price ELSE 0 END), 6) AS total_debt,
           round(sum(CASE WHEN o_orderstatus = 'F' THEN price ELSE 0 END), 6) AS stockholders_equity,
           round(sum(CASE WHEN o_orderstatus = 'P' THEN price ELSE 0 END), 6) AS current_liabilities,
           round(sum(CASE WHEN o_orderstatus <> 'F' THEN price ELSE 0 END), 6) AS liabilities,
           round(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN price ELSE 0 END), 6)
               AS current_assets,
           round(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN price ELSE 0 END), 6) AS cash,
           round(sum(CASE WHEN o_orderpriority <> '5-LOW' THEN price ELSE 0 END), 6) AS tangible
"""

_KEYS = """
    SELECT 'C' || CAST(o_custkey AS VARCHAR) AS symbol,
           make_timestamp(CAST(year(o_orderdate) AS BIGINT), 12, 31, 0, 0, 0.0) AS as_of_date,
           '12M' AS period_type, 'USD' AS currency_code,
"""

_PANEL = f"""
panel AS (
{_KEYS}
{_PANEL_SUMS}
    FROM (SELECT *, o_totalprice AS price FROM orders) AS o
    GROUP BY o_custkey, year(o_orderdate)
)
"""

_PANEL_WITH_LINES = f"""
{_LINES},
panel AS (
{_KEYS}
{_PANEL_SUMS},
           round(sum(accepted), 6) AS ebit,
           round(sum(accepted + kept), 6) AS operating_income,
           round(sum(shipped), 6) AS pretax_income,
           round(sum(after_tax), 6) AS net_income,
           round(sum(open_tax), 6) AS interest_expense,
           round(sum(kept - returned), 6) AS free_cash_flow
    FROM (SELECT *, o_totalprice AS price FROM orders) AS o
    LEFT JOIN lines ON l_orderkey = o_orderkey
    GROUP BY o_custkey, year(o_orderdate)
)
"""

_QUOTES = """
quotes AS (
    SELECT 'C' || CAST(c_custkey AS VARCHAR) AS symbol,
           CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS price,
           CAST(c_nationkey * 1000 AS DOUBLE) AS shares
    FROM customer
)
"""

_REACHED_PANEL = """
placed AS (
    SELECT *, year(as_of_date) > 1997 AS late, CAST(substr(symbol, 2) AS INTEGER) AS number FROM panel
),
merged AS (
    SELECT * EXCLUDE (total_debt, ebit), total_debt AS old_debt, ebit AS old_ebit,
        CASE WHEN again AND number % 2 = 0 THEN total_debt + 1000 ELSE total_debt END AS total_debt,
        CASE WHEN again AND number % 3 = 0 THEN CASE WHEN ebit = 0 THEN 7 ELSE 0 END ELSE ebit END AS ebit,
        late OR (again AND (number % 2 = 0 OR number % 3 = 0)) AS changed
    FROM (SELECT *, NOT late AND number % 11 = year(as_of_date) % 11 AS again FROM placed) AS marked
)
"""

_METRICS = f"""
{_PANEL},
latest AS (
    SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY as_of_date DESC) AS age FROM panel
    ) AS aged WHERE age = 1
),
graded AS (
    SELECT 'C' || CAST(c_custkey AS VARCHAR) AS company, c_mktsegment AS sector,
           CASE WHEN c_acctbal >= 0 THEN CAST(c_nationkey % 5 + 1 AS DOUBLE) END AS grade,
           CASE WHEN c_acctbal >= 0 THEN c_acctbal / 1000.0::DOUBLE END AS beta
    FROM customer
),
metrics AS (
    SELECT company AS symbol,
           current_liabilities / NULLIF(total_debt, 0) AS "shortRatio",
           total_debt / NULLIF(current_assets, 0) AS "pegRatio",
           cash / NULLIF(total_assets, 0) AS "payoutRatio",
           total_debt / NULLIF(stockholders_equity, 0) * 100.0::DOUBLE AS "debtToEquity",
           grade AS "recommendationMean", beta, sector,
           CASE WHEN grade < 2.5 THEN 'buy' WHEN grade < 3.5 THEN 'hold'
                WHEN grade IS NOT NULL THEN 'sell' END AS "recommendationKey"
    FROM graded LEFT JOIN latest ON latest.symbol = company
)
"""

_SAFE = """
    "shortRatio" < 3 AND "pegRatio" < 1.5 AND "payoutRatio" < 0.6 AND "debtToEquity" < 200
"""

_SCREENER = """
screener AS (
    SELECT 'P' || CAST(p_partkey AS VARCHAR)
               || CASE WHEN p_partkey % 14 = 0 THEN '.A' WHEN p_partkey % 14 = 7 THEN '^B' ELSE '' END AS symbol,
           lower(p_type) AS exchange, p_brand AS sector,
           CASE WHEN p_size = 50 THEN NULL WHEN p_size = 49 THEN ''
                ELSE '$' || CAST(p_size AS VARCHAR)
                     || CASE WHEN p_partkey % 3 = 0 THEN 'M' WHEN p_partkey % 3 = 1 THEN 'B' ELSE '' END
           END AS "marketCap"
    FROM part
),
plain AS (SELECT * FROM screener WHERE NOT regexp_matches(symbol, '[.^]')),
capped AS (
    SELECT symbol, exchange, sector, "marketCap",
           CASE WHEN contains("marketCap", 'M')
                    THEN TRY_CAST(substring("marketCap", 2, length("marketCap") - 2) AS DOUBLE)
                WHEN contains("marketCap", 'B')
                    THEN TRY_CAST(substring("marketCap", 2, length("marketCap") - 2) AS DOUBLE) * 1000
                WHEN "marketCap" = '' THEN NULL
                ELSE TRY_CAST(substring("marketCap", 2) AS DOUBLE) / 1e6::DOUBLE END AS market_cap
    FROM plain WHERE "marketCap" IS NOT NULL
)
"""

_COMPANIES = """
companies AS (
    SELECT 'S' || CAST(s_suppkey AS VARCHAR) || CASE WHEN s_acctbal < 1000 THEN '.A' ELSE '' END AS symbol,
           r_name AS region
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)
"""

_BY_TYPE = """
history AS (SELECT event_type AS symbol, ts AS date, event_id, value AS close FROM events)
"""

_BY_USER = """
history AS (SELECT 'U' || CAST(user_id AS VARCHAR) AS symbol, ts AS date, value AS close FROM events),
day_ends AS (
    SELECT DISTINCT 'U' || CAST(user_id AS VARCHAR) AS symbol, date_trunc('day', ts) + INTERVAL 1 DAY AS date
    FROM events
)
"""


def _rolled(period: int, source: str, order: str) -> str:
    frame = f"(PARTITION BY symbol ORDER BY {order} ROWS BETWEEN {period - 1} PRECEDING AND CURRENT ROW)"
    return f"""
        SELECT * EXCLUDE (close),
               CASE WHEN count(close) OVER {frame} = {period} THEN avg(close) OVER {frame} END AS close
        FROM {source}
    """


_ROLLING_BY_TYPE = f"""
WITH {_BY_TYPE},
recent AS (SELECT * FROM history WHERE date >= TIMESTAMP '2024-01-08'),
rolled AS ({_rolled(120, "recent", "date, event_id")})
SELECT symbol, date, event_id, round(close, 6) AS close FROM rolled
"""

_DEBT_CHANGE = f"""
WITH {_PANEL}
SELECT symbol, as_of_date, period_type, total_debt,
       total_debt - lag(total_debt) OVER (PARTITION BY symbol ORDER BY as_of_date, period_type) AS debt_change
FROM panel
"""

_RESTATED = f"""
{_PANEL},
slim AS (
    SELECT symbol, as_of_date, period_type, total_debt,
           NULLIF(stockholders_equity, 0) AS stockholders_equity
    FROM panel
),
older AS (SELECT * FROM slim WHERE year(as_of_date) <= 1998),
newer AS (
    SELECT symbol, as_of_date, period_type,
           CASE WHEN stockholders_equity IS NULL AND year(as_of_date) = 1998
                THEN total_debt + 1 ELSE total_debt END AS total_debt,
           stockholders_equity
    FROM slim WHERE year(as_of_date) >= 1998
)
"""

_SPLIT_EFFECTS = """
SELECT 'U' || CAST(user_id AS VARCHAR) AS symbol, ts AS date,
       CASE WHEN value > 90 THEN 2.0::DOUBLE WHEN value < 2 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS splits,
       round(exp(sum(CASE WHEN value > 90 THEN ln(2.0::DOUBLE) WHEN value < 2 THEN ln(0.5::DOUBLE) ELSE 0 END)
                     OVER (PARTITION BY user_id ORDER BY ts)), 6) AS split_effect
FROM events
"""

_UNNAMED = f"""
WITH {_PANEL_WITH_LINES},
named AS (SELECT * REPLACE (CASE WHEN NOT suffix(symbol, '7') THEN symbol END AS symbol) FROM panel)
SELECT symbol, as_of_date, period_type,
       CASE WHEN max(CASE WHEN ebit = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol) = 1
            THEN operating_income ELSE ebit END AS ebit,
       operating_income
FROM named
"""

_ROLLING_TIES = f"""
WITH placed AS (SELECT event_type AS symbol, strftime(ts, '%Y-%m-%d %H') AS place, value AS close FROM events),
rolled AS ({_rolled(12, "placed", "place, close")})
SELECT symbol, place, round(close, 6) AS close FROM rolled
"""

ORACLE: dict[str, str] = {
    "kpi_panel": f"""
WITH {_PANEL}, {_QUOTES}
SELECT panel.symbol, as_of_date,
       liabilities - cash AS total_net_liabilities,
       total_debt / NULLIF(stockholders_equity, 0) AS debt_to_equity,
       (liabilities - cash) / NULLIF(stockholders_equity, 0) AS net_debt_to_equity,
       current_liabilities / NULLIF(stockholders_equity, 0) AS quick_ratio,
       current_assets / NULLIF(current_liabilities, 0) AS current_ratio,
       total_assets - tangible AS intangible_assets,
       total_assets - liabilities AS book_value,
       shares * price AS market_value,
       shares * price / NULLIF(total_assets - liabilities, 0) AS price_to_book,
       cash / NULLIF(current_assets, 0) AS cash_to_current_assets,
       cash / NULLIF(shares, 0) AS cash_per_share,
       total_debt / NULLIF(liabilities, 0) AS debt_quality_ratio,
       total_debt / NULLIF(total_assets, 0) AS debt_ratio,
       shares * price + total_debt AS enterprise_value
FROM panel LEFT JOIN quotes ON quotes.symbol = panel.symbol
""",
    "kpi_wide": f"""
WITH {_PANEL_WITH_LINES}, {_QUOTES},
prepared AS (
    SELECT panel.*, price, shares,
           total_debt - lag(total_debt) OVER (PARTITION BY panel.symbol ORDER BY as_of_date, period_type)
               + interest_expense AS service,
           CASE WHEN max(CASE WHEN ebit = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY panel.symbol) = 1
                THEN operating_income ELSE ebit END AS earnings
    FROM panel LEFT JOIN quotes ON quotes.symbol = panel.symbol
)
SELECT symbol, as_of_date, period_type, currency_code,
       price AS two_hundred_day_avg_share_price,
       shares AS shares_outstanding,
       liabilities AS total_liabilities,
       liabilities - cash AS total_net_liabilities,
       pretax_income - net_income AS tax_expense,
       total_debt / NULLIF(stockholders_equity, 0) AS debt_to_equity,
       (liabilities - cash) / NULLIF(stockholders_equity, 0) AS net_debt_to_equity,
       current_liabilities / NULLIF(stockholders_equity, 0) AS quick_ratio,
       current_assets / NULLIF(current_liabilities, 0) AS current_ratio,
       total_assets - tangible AS intangible_assets,
       total_assets - liabilities AS book_value,
       shares * price AS market_value,
       shares * price / NULLIF(total_assets - liabilities, 0) AS price_to_book,
       cash / NULLIF(current_assets, 0) AS cash_to_current_assets,
       cash / NULLIF(shares, 0) AS cash_per_share,
       total_debt / NULLIF(liabilities, 0) AS debt_quality_ratio,
       total_debt / NULLIF(total_assets, 0) AS debt_ratio,
       service AS debt_service,
       net_income / NULLIF(service, 0) AS debt_service_coverage_ratio,
       net_income / NULLIF(shares, 0) AS earnings_per_share,
       earnings / NULLIF(total_assets - current_liabilities, 0) AS return_on_capital_employed,
       net_income / NULLIF(stockholders_equity, 0) AS return_on_equity,
       net_income / NULLIF(total_assets, 0) AS return_on_assets,
       net_income / NULLIF(tangible, 0) AS return_on_net_assets,
       free_cash_flow / NULLIF(shares, 0) AS free_cash_flow_per_share,
       price / NULLIF(free_cash_flow, 0) AS price_to_free_cash_flow,
       shares * price + total_debt AS enterprise_value
FROM prepared
""",
    "kpi_debt_service": _DEBT_CHANGE,
    "kpi_debt_service_split": _DEBT_CHANGE,
    "kpi_ebit_fallback": f"""
WITH {_PANEL_WITH_LINES}
SELECT symbol, as_of_date, period_type,
       CASE WHEN max(CASE WHEN ebit = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol) = 1
            THEN operating_income ELSE ebit END AS ebit,
       operating_income
FROM panel
""",
    "kpi_ebit_unnamed": _UNNAMED,
    "kpi_ebit_unnamed_split": _UNNAMED,
    "rolling_ties": _ROLLING_TIES,
    "rolling_ties_split": _ROLLING_TIES,
    "rolling_numbers_split": f"""
WITH placed AS (SELECT event_type AS symbol, -value AS place, value AS close FROM events),
rolled AS ({_rolled(12, "placed", "place, close")})
SELECT symbol, place, round(close, 6) AS close FROM rolled
""",
    **{
        name: f"""
WITH placed AS (SELECT event_type AS symbol, {place} AS place, event_id, value AS close FROM events),
rolled AS ({_rolled(12, "placed", "place")})
SELECT symbol, event_id, round(close, 6) AS close FROM rolled
"""
        for name, place in {
            "rolling_decimals_split": "event_id",
            "rolling_micros_split": "-event_id",
            "rolling_texts_split": "lpad(CAST(event_id AS VARCHAR), 12, '0')",
        }.items()
    },
    "running_total_split": """
SELECT event_type AS symbol, event_id,
       CAST(CAST(sum(CAST(value AS DECIMAL(18,4))) OVER (PARTITION BY event_type ORDER BY event_id DESC
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(28,4)) AS VARCHAR) AS total
FROM events
""",
    "kpi_ebit_missing": f"""
WITH {_PANEL_WITH_LINES}
SELECT symbol, as_of_date, period_type, coalesce(ebit, operating_income) AS ebit, operating_income FROM panel
""",
    "screen_safe": f"""
WITH {_METRICS}
SELECT symbol, "shortRatio", "pegRatio", "payoutRatio", "debtToEquity" FROM metrics WHERE {_SAFE}
""",
    "screen_rank": f"""
WITH {_METRICS}
SELECT symbol, "recommendationMean",
       row_number() OVER (ORDER BY "recommendationMean" ASC NULLS LAST, symbol) AS position
FROM metrics
""",
    "beta_rank": f"""
WITH {_METRICS}
SELECT symbol, beta, row_number() OVER (ORDER BY beta ASC NULLS LAST, symbol) AS position FROM metrics
""",
    "screen_full": f"""
WITH {_METRICS}
SELECT * FROM metrics WHERE {_SAFE}
""",
    "drop_all_null": f"""
WITH {_METRICS}
SELECT * EXCLUDE (sector) FROM metrics
""",
    "scatter_data": f"""
WITH {_METRICS}
SELECT symbol, beta, sector, "recommendationKey" FROM metrics
""",
    "tickers_by_exchange": f"""
WITH {_SCREENER}
SELECT symbol FROM plain WHERE exchange = 'economy'
UNION ALL
SELECT symbol FROM plain WHERE exchange = 'standard'
""",
    "ticker_lists": f"""
WITH {_SCREENER}, {_COMPANIES}
SELECT symbol FROM plain WHERE exchange = 'promo'
UNION ALL
SELECT symbol FROM companies WHERE region = 'EUROPE' AND NOT regexp_matches(symbol, '[.^]')
UNION ALL
SELECT symbol FROM companies
""",
    "tickers_filtered": f"""
WITH {_SCREENER}
SELECT symbol FROM capped
WHERE sector IN ('Brand#3', 'Brand#7', 'Brand#12') AND market_cap > 10 AND market_cap < 20000
""",
    "tickers_small_caps": f"""
WITH {_SCREENER}
SELECT symbol FROM capped WHERE CASE WHEN "marketCap" = '' THEN 0 ELSE market_cap END < 1
""",
    "biggest_n": f"""
WITH {_SCREENER}
SELECT symbol, market_cap FROM capped ORDER BY market_cap DESC NULLS LAST, symbol LIMIT 25
""",
    "biggest_n_in_sector": f"""
WITH {_SCREENER}
SELECT symbol, market_cap FROM capped WHERE sector = 'Brand#7'
ORDER BY market_cap DESC NULLS LAST, symbol LIMIT 5
""",
    "tickers_by_region": f"""
WITH {_COMPANIES}
SELECT symbol FROM companies WHERE region = 'ASIA' AND NOT regexp_matches(symbol, '[.^]')
""",
    "rolling_history": _ROLLING_BY_TYPE,
    "rolling_history_split": _ROLLING_BY_TYPE,
    "rolling_keyed": f"""
WITH prices AS (
    SELECT 'U' || CAST(user_id AS VARCHAR) AS symbol, ts AS date, max(value) AS close FROM events GROUP BY user_id, ts
),
rolled AS ({_rolled(12, "(SELECT *, close AS price FROM prices)", "date")})
SELECT symbol, date, price AS close, round(close, 6) AS close_mean FROM rolled
""",
    "history_at_dates": f"""
WITH {_BY_USER},
recent AS (SELECT * FROM history WHERE date >= TIMESTAMP '2024-01-03'),
rolled AS ({_rolled(20, "recent", "date")}),
wanted AS (
    SELECT DISTINCT 'U' || CAST(user_id AS VARCHAR) AS symbol, ts AS date FROM events WHERE event_type = 'error'
)
SELECT rolled.symbol, rolled.date, round(close, 6) AS close
FROM rolled JOIN wanted ON wanted.symbol = rolled.symbol AND wanted.date = rolled.date
""",
    "history_asof": f"""
WITH {_BY_USER}
SELECT d.symbol, d.date, h.close
FROM day_ends AS d ASOF LEFT JOIN history AS h ON d.symbol = h.symbol AND d.date >= h.date
""",
    "history_asof_split": f"""
WITH {_BY_TYPE},
days AS (SELECT DISTINCT symbol, date_trunc('day', date) + INTERVAL 1 DAY AS date FROM history)
SELECT d.symbol, d.date, h.close
FROM days AS d ASOF LEFT JOIN history AS h ON d.symbol = h.symbol AND d.date >= h.date
""",
    "average_history_asof": f"""
WITH {_BY_USER},
recent AS (SELECT * FROM history WHERE date >= TIMESTAMP '2024-01-03'),
rolled AS ({_rolled(5, "recent", "date")})
SELECT d.symbol, d.date, round(h.close, 6) AS close
FROM day_ends AS d ASOF LEFT JOIN rolled AS h ON d.symbol = h.symbol AND d.date >= h.date
""",
    "symbol_lookup": f"""
WITH {_BY_TYPE}
SELECT * FROM history WHERE symbol = 'click'
""",
    "refresh_pending": """
SELECT 'C' || CAST(c_custkey AS VARCHAR) AS symbol FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1998)
""",
    "refresh_merge": f"""
WITH {_RESTATED}
SELECT coalesce(o.symbol, n.symbol) AS symbol,
       coalesce(o.as_of_date, n.as_of_date) AS as_of_date,
       coalesce(o.period_type, n.period_type) AS period_type,
       coalesce(o.total_debt, n.total_debt) AS total_debt,
       coalesce(o.stockholders_equity, n.stockholders_equity) AS stockholders_equity
FROM older AS o FULL JOIN newer AS n
  ON o.symbol IS NOT DISTINCT FROM n.symbol
 AND o.as_of_date IS NOT DISTINCT FROM n.as_of_date
 AND o.period_type IS NOT DISTINCT FROM n.period_type
 AND o.total_debt IS NOT DISTINCT FROM n.total_debt
 AND o.stockholders_equity IS NOT DISTINCT FROM n.stockholders_equity
""",
    "refresh_upsert": f"""
WITH {_RESTATED}
SELECT * FROM older AS o
WHERE NOT EXISTS (
    SELECT 1 FROM newer AS n
    WHERE n.symbol = o.symbol AND n.as_of_date = o.as_of_date AND n.period_type = o.period_type
)
UNION ALL
SELECT * FROM newer
""",
    "refresh_versioned": f"""
WITH {_RESTATED}
SELECT * FROM older AS o
WHERE NOT EXISTS (
    SELECT 1 FROM newer AS n
    WHERE n.symbol = o.symbol AND n.as_of_date = o.as_of_date AND n.period_type = o.period_type
)
UNION ALL
SELECT * FROM newer
""",
    "refresh_upsert_nulls": f"""
WITH {_RESTATED},
parts AS (
    SELECT symbol, CASE WHEN total_debt > 0 THEN as_of_date END AS as_of_date, period_type, total_debt, stockholders_equity,
           NULLIF(CAST(substring(symbol, 2) AS INTEGER) % 9, 0) AS part, fresh
    FROM (SELECT *, false AS fresh FROM older UNION ALL SELECT *, true FROM newer) AS slices
),
new_rows AS (SELECT * EXCLUDE (fresh) FROM parts WHERE fresh AND coalesce(part, 0) % 3 = 0)
SELECT * EXCLUDE (fresh) FROM parts AS o
WHERE NOT fresh AND NOT EXISTS (
    SELECT 1 FROM new_rows AS n
    WHERE n.symbol = o.symbol AND n.as_of_date IS NOT DISTINCT FROM o.as_of_date AND n.period_type = o.period_type
)
UNION ALL
SELECT * FROM new_rows
""",
    "refresh_kpis": f"""
WITH {_PANEL}, {_QUOTES}
SELECT panel.symbol, as_of_date, total_debt / NULLIF(total_assets, 0) AS debt_ratio,
       shares * price AS market_value
FROM panel LEFT JOIN quotes ON quotes.symbol = panel.symbol
""",
    "refresh_restated": f"""
WITH {_PANEL_WITH_LINES}, {_QUOTES}, {_REACHED_PANEL}
SELECT m.symbol, as_of_date, total_debt - lag(total_debt) OVER w + interest_expense AS debt_service,
       CASE WHEN max(CASE WHEN ebit = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY m.symbol) = 1 THEN operating_income ELSE ebit END
           / NULLIF(total_assets - current_liabilities, 0) AS return_on_capital_employed,
       total_debt / NULLIF(total_assets, 0) AS debt_ratio, shares * price AS market_value
FROM merged AS m LEFT JOIN quotes ON quotes.symbol = m.symbol
WINDOW w AS (PARTITION BY m.symbol ORDER BY as_of_date)
""",
    "refresh_reach": f"""
WITH {_PANEL_WITH_LINES}, {_REACHED_PANEL}
SELECT symbol, as_of_date, reason, round(debt_change, 6) AS debt_change FROM (
    SELECT symbol, as_of_date, total_debt - lag(total_debt) OVER w AS debt_change,
        CASE WHEN changed THEN 'changed' WHEN lag(changed) OVER w THEN 'after a change'
             WHEN coalesce(max(ebit = 0) OVER s, false)
                <> coalesce(max(CASE WHEN year(as_of_date) <= 1997 THEN old_ebit = 0 END) OVER s, false) THEN 'EBIT rule' END AS reason
    FROM merged WINDOW w AS (PARTITION BY symbol ORDER BY as_of_date), s AS (PARTITION BY symbol)
) AS reached WHERE reason IS NOT NULL
""",
    "conform_bad_cells": """
SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS total_debt,
       CAST(NULL AS DOUBLE) AS ebit, CAST(NULL AS DOUBLE) AS net_income
FROM orders
""",
    "conform_bad_counts": """
SELECT 'total_debt' AS "column", count(*) AS n FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT 'ebit', count(o_orderstatus) FROM orders
""",
    "merge_columns": """
SELECT c_custkey, c_name, c_nationkey AS n_nationkey, c_acctbal, c_mktsegment, n_name, n_regionkey
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
""",
    "html_rows": r"""
WITH items AS (
    SELECT page_id, unnest(regexp_extract_all(html, '(?is)<li>(.*?)</li>', 1)) AS item FROM pages
),
cells AS (SELECT page_id, regexp_extract_all(item, '[">]([^"<>]*)["<]', 1) AS cell FROM items)
SELECT page_id, cell[1] AS target, cell[2] AS label, concat_ws(':', cell[1], cell[2]) AS pair,
       contains(cell[1], 'th') AS has_th, cell[2] IN ('the', 'The', 'to') AS is_word
FROM cells
""",
    "snake_values": r"""
SELECT p_partkey,
       lower(regexp_replace(
           regexp_replace(p_type || p_brand || 'NetPPEValue' || p_name, '(.)([A-Z][a-z]+)', '\1_\2', 'g'),
           '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS snake
FROM part
""",
    "json_fields": """
SELECT event_type AS symbol, value AS "twoHundredDayAverage",
       CAST(json_extract(props, '$.k') AS DOUBLE) AS "sharesOutstanding",
       CAST(user_id AS DOUBLE) AS "bidSize", CAST(NULL AS DOUBLE) AS "askSize"
FROM events
""",
    "quotes_newest": """
WITH newest AS (
    SELECT event_type, arg_max(value, ts) AS price, arg_max(CAST(json_extract(props, '$.k') AS DOUBLE), ts) AS shares,
           arg_max(CAST(user_id AS DOUBLE), ts) AS bid
    FROM events GROUP BY event_type
)
SELECT event_type AS symbol, event_id, price AS two_hundred_day_avg_share_price, shares AS shares_outstanding,
       bid AS bid_size, CAST(NULL AS DOUBLE) AS ask_size
FROM events JOIN newest USING (event_type)
""",
    "stamp_texts": """
SELECT event_id, strftime(ts, '%Y-%m-%d-%H-%M-%S') AS stamp FROM events
""",
    "kpi_growth": f"""
WITH {_PANEL_WITH_LINES}, {_QUOTES},
prepared AS (
    SELECT panel.symbol, as_of_date, price, free_cash_flow, shares * price AS market_value,
           net_income / NULLIF(shares, 0) AS eps,
           lag(free_cash_flow) OVER w AS cash_before,
           lag(net_income / NULLIF(shares, 0)) OVER w AS eps_before
    FROM panel LEFT JOIN quotes ON quotes.symbol = panel.symbol
    WINDOW w AS (PARTITION BY panel.symbol ORDER BY as_of_date, period_type)
)
SELECT symbol, as_of_date,
       free_cash_flow / NULLIF(cash_before, 0) - 1 AS free_cash_flow_growth,
       eps / NULLIF(eps_before, 0) - 1 AS earnings_per_share_growth,
       price / NULLIF(eps, 0) / NULLIF((eps / NULLIF(eps_before, 0) - 1) * 100, 0) AS peg_ratio,
       free_cash_flow / NULLIF(market_value, 0) AS free_cash_flow_yield
FROM prepared
""",
    "amounts_in_usd": """
WITH priced AS (
    SELECT o_orderkey, o_orderdate, o_totalprice,
           CASE WHEN c_mktsegment = 'BUILDING' THEN 'USD' ELSE c_mktsegment END AS currency_code
    FROM orders JOIN customer ON c_custkey = o_custkey
),
rates AS (
    SELECT currency_code, o_orderdate AS date, count(*) / 10.0::DOUBLE AS usd_rate
    FROM priced GROUP BY currency_code, o_orderdate
),
amounts AS (SELECT *, o_orderdate - INTERVAL 1 DAY AS as_of_date FROM priced)
SELECT a.o_orderkey, a.currency_code, a.as_of_date,
       a.o_totalprice * CASE WHEN a.currency_code = 'USD' THEN 1.0::DOUBLE ELSE r.usd_rate END AS total_debt
FROM amounts AS a ASOF LEFT JOIN rates AS r ON a.currency_code = r.currency_code AND a.as_of_date >= r.date
""",
    "split_effects": _SPLIT_EFFECTS,
    "split_effects_split": _SPLIT_EFFECTS,
    "insider_purchases": f"""
WITH {_PANEL},
bought AS (
    SELECT 'C' || CAST(o_custkey AS VARCHAR) AS symbol, year(o_orderdate) AS year, CAST(sum(o_orderkey % 90 + 1) AS BIGINT) AS shares
    FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey, year(o_orderdate)
)
SELECT panel.symbol, as_of_date, total_debt, shares AS insider_shares_bought
FROM panel LEFT JOIN bought ON bought.symbol = panel.symbol AND bought.year = year(as_of_date)
""",
}

# The same results with heavy symbols split.
ORACLE["kpi_wide_split"] = ORACLE["kpi_wide"]
ORACLE["biggest_n_lazy"] = ORACLE["biggest_n"]

_TEXT_METRICS = """
cells AS (
    SELECT o_orderkey AS k, o_orderpriority AS level, CAST(o_orderkey AS VARCHAR) || '.25' AS fraction FROM orders
)
"""

ORACLE["metrics_types"] = """
SELECT * FROM (VALUES
    (0, 'order_id', 'bigint'), (1, 'whole', 'bigint'), (2, 'mixed', 'double'), (3, 'flag', 'boolean'),
    (4, 'flag_or_number', 'string'), (5, 'price', 'double'),
    (6, 'dashed', (SELECT CASE WHEN count(*) > 0 THEN 'string' ELSE 'bigint' END FROM orders WHERE o_orderkey % 1000 = 0)),
    (7, 'long_number', 'double'), (8, 'nothing', 'double'), (9, 'level', 'string')
) AS t(position, "column", type)
"""

ORACLE["metrics_typed"] = f"""
WITH {_TEXT_METRICS}
SELECT k AS order_id,
       CASE WHEN k % 5 = 0 THEN NULL WHEN k % 7 = 0 THEN 12 ELSE k END AS whole,
       CASE WHEN k % 2 = 0 THEN 1000 WHEN k % 3 = 0 THEN NULL ELSE CAST(fraction AS DOUBLE) END AS mixed,
       CASE WHEN k % 2 = 0 THEN true WHEN k % 3 = 0 THEN NULL ELSE false END AS flag,
       CASE WHEN k % 2 = 0 THEN 'true' ELSE '1' END AS flag_or_number,
       CASE WHEN k % 4 <> 0 THEN CAST(fraction AS DOUBLE) END AS price,
       CASE WHEN k % 1000 = 0 THEN '-' ELSE CAST(k AS VARCHAR) END AS dashed,
       CAST('9000000000000000' || lpad(CAST(k % 1000 AS VARCHAR), 6, '0') AS DOUBLE) AS long_number,
       CAST(NULL AS DOUBLE) AS nothing,
       CASE WHEN k % 9 <> 0 THEN level END AS level
FROM cells
"""

_DRIFTING = """
entries AS (
    SELECT *, CASE WHEN event_id % 6 NOT IN (2, 3) THEN value END AS price,
           CASE WHEN event_id % 4 = 0 THEN CAST(user_id AS DOUBLE) END AS bid
    FROM events WHERE event_id % 11 NOT IN (1, 2, 4)
)
"""

ORACLE["quotes_drifting"] = f"""
WITH {_DRIFTING}
SELECT event_id, event_type AS symbol, price AS "twoHundredDayAverage", CAST(NULL AS DOUBLE) AS "sharesOutstanding",
       bid AS "bidSize", CAST(event_id AS DOUBLE) AS "askSize"
FROM entries
"""

ORACLE["quotes_drift"] = f"""
WITH {_DRIFTING},
states AS (
    SELECT unnest([
        {{'field': 'twoHundredDayAverage', 'state': CASE event_id % 6 WHEN 2 THEN 'wrong type' WHEN 3 THEN 'missing' ELSE 'read' END}},
        {{'field': 'sharesOutstanding', 'state': 'missing'}},
        {{'field': 'bidSize', 'state': CASE event_id % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'wrong type' ELSE 'missing' END}},
        {{'field': 'askSize', 'state': 'read'}},
        {{'field': CASE WHEN event_id % 5 = 0 THEN 'note' END, 'state': 'unknown'}}
    ], recursive := true) FROM entries
)
SELECT field, state, count(*) AS n,
       CASE WHEN state = 'unknown' OR (state = 'wrong type' AND field <> 'bidSize') THEN 'STRING'
            WHEN state = 'wrong type' THEN 'OBJECT<lots: BIGINT>' ELSE 'VOID' END AS type
FROM states WHERE field IS NOT NULL GROUP BY field, state
"""

ORACLE["quotes_rejected"] = """
SELECT event_id, NULL AS symbol,
       CASE event_id % 11 WHEN 1 THEN 'no JSON' WHEN 2 THEN 'no map' ELSE 'empty' END AS reason,
       CASE event_id % 11 WHEN 1 THEN 'Too Many Requests' WHEN 2 THEN '[1, 2]' ELSE '' END AS reply
FROM events WHERE event_id % 11 IN (1, 2, 4)
UNION ALL
SELECT event_id, 'gone' AS symbol, 'no fields' AS reason,
       '{"gone": null, "' || event_type || '": {"twoHundredDayAverage": '
       || CASE event_id % 6 WHEN 1 THEN '"' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || '"' WHEN 2 THEN '"n/a"' WHEN 3 THEN 'null'
               ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END
       || CASE event_id % 4 WHEN 0 THEN ', "bidSize": ' || CAST(user_id AS VARCHAR) WHEN 1 THEN ', "bidSize": {"lots": 3}' ELSE '' END
       || CASE WHEN event_id % 5 = 0 THEN ', "note": "late"' ELSE '' END
       || ', "askSize": ' || CAST(event_id AS VARCHAR) || '}}' AS reply
FROM events WHERE event_id % 11 = 3
"""

_HOSTS = """
hosts AS (
    SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, upper(regexp_extract(url, '://[^/]*/([a-z]*)', 1)) AS country FROM pages
)
"""

ORACLE["host_list"] = f"""
WITH {_HOSTS}
SELECT page_id, host || ':' || CAST(page_id % 100 + 8000 AS VARCHAR) AS proxy
FROM hosts WHERE page_id % 3 = 0 AND country IN ('FR', 'DE', 'IT', 'CH')
"""

ORACLE["host_names"] = f"""
WITH {_HOSTS}
SELECT page_id, host, country || ' & Co. <éé&lt;' AS name FROM hosts
UNION ALL
SELECT page_id, 'short' AS host, NULL AS name FROM hosts
"""


def _after_program(names: list[str]) -> list[str]:
    """The column list after the column program, step by step on a plain list."""
    left = list(names)
    for action, *arguments in COLUMN_PROGRAM:
        if action == "drop":
            left = [n for n in left if n != arguments[0]]
        else:
            left.insert(arguments[1], left.pop(arguments[0]))
    return left


def _cell(name: str) -> str:
    if name == "symbol":
        return "'C' || CAST(c_custkey AS VARCHAR)"
    if name == "recommendationMean":
        return "CASE WHEN c_acctbal >= 0 THEN CAST(c_nationkey % 5 + 1 AS VARCHAR) || '.0' ELSE '-' END"
    return f"'{name}=' || CAST(c_custkey AS VARCHAR)"


ORACLE["column_program"] = f"""
SELECT 'C' || CAST(c_custkey AS VARCHAR) AS symbol,
       concat_ws(' ', {", ".join(_cell(n) for n in _after_program(["symbol", "recommendationMean", *WIDE]))}) AS cells
FROM customer
"""

ORACLE["sorted_columns"] = f"""
SELECT 'C' || CAST(c_custkey AS VARCHAR) AS symbol, concat_ws(' ', {", ".join(_cell(n) for n in sorted(["symbol", *WIDE]))}) AS cells
FROM customer
"""

ORACLE["kpi_valuation"] = f"""
WITH {_PANEL_WITH_LINES}, {_QUOTES},
flagged AS (SELECT *, bool_or(ebit = 0) OVER (PARTITION BY symbol) AS zero FROM panel),
priced AS (
    SELECT flagged.* EXCLUDE (ebit), CASE WHEN zero THEN operating_income ELSE ebit END AS ebit, price, shares,
           CASE WHEN total_debt > stockholders_equity THEN 0.25 ELSE 0.5 END::DOUBLE AS tax_rate
    FROM flagged LEFT JOIN quotes ON quotes.symbol = flagged.symbol
)
SELECT symbol, as_of_date,
       cash - total_debt AS net_cash,
       free_cash_flow / NULLIF(total_assets, 0) AS free_cash_flow_margin,
       (shares * price + total_debt) / NULLIF(total_assets, 0) AS ev_to_sales,
       (shares * price + total_debt) / NULLIF(current_assets, 0) AS ev_to_ebitda,
       current_liabilities / NULLIF(shares * price, 0) AS buyback_yield,
       ebit * (1 - tax_rate) / NULLIF(tangible, 0) AS return_on_invested_capital,
       interest_expense / NULLIF(net_income, 0) AS payout_ratio,
       shares + 1 AS bid_size, price * 2 AS ask_size
FROM priced
"""

ORACLE["short_interest"] = """
SELECT *, "sharesShort" / NULLIF("floatShares", 0) AS "shortToFloat", "sharesShort" / NULLIF("sharesOutstanding", 0) AS "shortToShares"
FROM (
    SELECT 'P' || CAST(p_partkey AS VARCHAR) AS symbol, CAST(p_size AS DOUBLE) AS "sharesShort",
           CAST(p_partkey % 10 AS DOUBLE) AS "floatShares", p_retailprice AS "sharesOutstanding"
    FROM part
) AS parts
"""

# Statement columns that the panel has, with their names in it.
_GIVEN = {
    **{c: c for c in ("total_assets", "total_debt", "stockholders_equity", "current_liabilities", "current_assets")},
    **{c: c for c in ("operating_income", "pretax_income", "net_income", "interest_expense", "free_cash_flow")},
    "total_liabilities_net_minority_interest": "liabilities",
    "cash_and_cash_equivalents": "cash",
    "net_tangible_assets": "tangible",
    "ebit": "CASE WHEN bool_or(ebit = 0) OVER (PARTITION BY symbol) THEN operating_income ELSE ebit END",
}
_BASE = [c for c in BASE_COLUMNS if c not in (*KEY_COLUMNS, "currency_code")]

ORACLE["kpi_all_columns"] = f"""
WITH {_PANEL_WITH_LINES}, wide AS ({ORACLE["kpi_wide"]}),
base AS (SELECT symbol, as_of_date, {", ".join(f'{_GIVEN.get(c, "CAST(NULL AS DOUBLE)")} AS {c}' for c in _BASE)} FROM panel)
SELECT * FROM wide JOIN base USING (symbol, as_of_date)
"""
