"""Ledger queries: each a composition of operators, with its SQL oracle beside it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import expressions as X
from quillon.operators import aggregates, balance, compare, explorer, imports, recurring, refunds
from quillon.session import table
from quillon.sources import ledger as sources

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SPENT = "direction = 'debit' AND category NOT IN ('TRANSFERS', 'INVESTMENTS')"
REFUNDED = "direction = 'credit' AND category = 'REFUNDS'"
EARNED = "direction = 'credit' AND category = 'SALARY/INCOME'"


def linked_sql(ledger: str) -> str:
    """CTEs over a ledger's own: exclusive refund links claimed one after the other, the linked ledger, its netted spending.

    Every step takes the next refund of each (user, merchant) and the best debit that none before it has claimed.
    """
    return f"""{ledger}, refund_rows AS (
  SELECT user_id, lower(merchant) AS key, id, date, amount, row_number() OVER (PARTITION BY user_id, lower(merchant) ORDER BY date, seq, id) AS k FROM ledger WHERE {REFUNDED}
), cand AS MATERIALIZED (
  SELECT r.user_id, r.id AS refund_id, d.id AS debit_id, row_number() OVER (PARTITION BY r.user_id, r.id ORDER BY (d.amount = r.amount) DESC, d.date DESC, d.seq DESC, d.id) AS nth
  FROM refund_rows r JOIN ledger d ON d.user_id = r.user_id AND lower(d.merchant) = r.key AND d.direction = 'debit' AND d.date BETWEEN r.date - 90 AND r.date AND d.amount >= r.amount
), claims AS (
  SELECT user_id, key, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS refund_id, CAST(NULL AS VARCHAR) AS debit_id, CAST([] AS VARCHAR[]) AS claimed FROM refund_rows GROUP BY ALL
  UNION ALL
  SELECT user_id, key, k, refund_id, debit_id, CASE WHEN debit_id IS NULL THEN claimed ELSE list_append(claimed, debit_id) END FROM (
    SELECT s.user_id, s.key, s.k + 1 AS k, r.id AS refund_id, arg_min(c.debit_id, c.nth) AS debit_id, any_value(s.claimed) AS claimed
    FROM claims s JOIN refund_rows r ON r.user_id = s.user_id AND r.key = s.key AND r.k = s.k + 1
    LEFT JOIN cand c ON c.user_id = r.user_id AND c.refund_id = r.id AND NOT list_contains(s.claimed, c.debit_id) GROUP BY s.user_id, s.key, s.k, r.id)
), links AS (SELECT user_id, refund_id, debit_id FROM claims WHERE debit_id IS NOT NULL
), linked AS (
  SELECT l.*, k.debit_id AS refund_for, b.refunded FROM ledger l LEFT JOIN links k ON k.user_id = l.user_id AND k.refund_id = l.id
  LEFT JOIN (SELECT k.user_id, k.debit_id, sum(r.amount) AS refunded FROM links k JOIN ledger r ON r.user_id = k.user_id AND r.id = k.refund_id GROUP BY ALL) b ON b.user_id = l.user_id AND b.debit_id = l.id
), netted AS (SELECT * FROM (SELECT *, CAST(greatest(amount - coalesce(refunded, 0), 0) AS DECIMAL(18,2)) AS net FROM linked WHERE {SPENT}) WHERE net > 0)"""


NETTED_SQL = linked_sql(sources.LEDGER_SQL)
PCT = "CASE WHEN {1} > 0 THEN floor(CAST({0} AS DOUBLE) / CAST({1} AS DOUBLE) * 100 * 10 + 0.5) / 10 ELSE 0e0 END"
YEAR = compare.Period(dt.date(2000, 1, 1), dt.date(2000, 12, 31))
BEFORE = compare.previous(YEAR)
AS_OF = dt.date(2000, 6, 18)


def query(name: str, sql: str | None, ctes: str = sources.LEDGER_SQL) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = f"WITH RECURSIVE {ctes}{sql}" if sql.startswith(",") else f"WITH RECURSIVE {ctes} {sql}"
        return f

    return keep


def over_ledger(name: str, sql: str | None, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, sql)(lambda spark, d: f(sources.from_lineitem(spark, d)))


def over_events(name: str, sql: str | None, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, sql, sources.EVENTS_SQL)(lambda spark, d: f(sources.from_events(spark, d)))


def over_netted(name: str, sql: str | None, f: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """f takes the linked ledger and its netted spending; links are made once."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        linked = refunds.linked(sources.from_lineitem(spark, d))
        return f(linked, refunds.net_rows(linked))

    query(name, sql, NETTED_SQL)(run)


def sums(**of: str) -> str:
    return ", ".join(f"CAST(coalesce(sum(CASE WHEN {when} THEN amount END), 0) AS DOUBLE) AS {name}" for name, when in of.items())


# scans and filters
over_ledger("src_ledger_scan", "SELECT user_id, id, date, seq, direction, CAST(amount AS DOUBLE) AS amount, category, merchant FROM ledger", lambda t: t.select("user_id", "id", "date", "seq", "direction", aggregates.money("amount"), "category", "merchant"))
over_ledger(
    "flt_predicates",
    f"SELECT user_id, count(*) FILTER (direction = 'credit') AS credits, count(*) FILTER ({EARNED}) AS incomes, count(*) FILTER ({REFUNDED}) AS refunds, count(*) FILTER ({SPENT}) AS spendings FROM ledger WHERE date BETWEEN DATE '1999-01-01' AND DATE '2000-12-31' GROUP BY user_id",
    lambda t: t.where(F.col("date").between(F.lit(dt.date(1999, 1, 1)), F.lit(dt.date(2000, 12, 31)))).groupBy("user_id").agg(F.count_if(X.credit()).alias("credits"), F.count_if(X.income()).alias("incomes"), F.count_if(X.refund()).alias("refunds"), F.count_if(X.spending()).alias("spendings")),
)
WANTED = explorer.Filter(text="BRAND#1", first=dt.date(1999, 1, 1), direction="debit", least=1000.0)
_WANTED_SQL = "(contains(lower(description), 'brand#1') OR contains(lower(merchant), 'brand#1') OR contains(lower(subcategory), 'brand#1') OR contains(lower(reference), 'brand#1')) AND date >= DATE '1999-01-01' AND direction = 'debit' AND amount >= 1000"
over_ledger("flt_explorer", f"SELECT id, merchant, CAST(amount AS DOUBLE) AS amount FROM ledger WHERE {_WANTED_SQL}", lambda t: t.where(WANTED.column()).select("id", "merchant", aggregates.money("amount")))
over_ledger("top_explorer_page", f"SELECT id, date, CAST(amount AS DOUBLE) AS amount FROM ledger WHERE {_WANTED_SQL} ORDER BY amount DESC, id LIMIT 50 OFFSET 50", lambda t: explorer.page(t, WANTED, "amount", number=2).select("id", "date", aggregates.money("amount")))
over_ledger("agg_explorer_totals", f"SELECT count(*) AS n, {sums(debit="direction = 'debit'", credit="direction = 'credit'")} FROM ledger WHERE {_WANTED_SQL}", lambda t: explorer.totals(t, WANTED))
over_ledger("agg_merchant_options", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, merchant) AS place FROM (SELECT user_id, merchant, count(*) AS n FROM ledger GROUP BY ALL)) WHERE place <= 500", explorer.merchant_options)
over_ledger("agg_data_range", "SELECT user_id, min(date) AS first, max(date) AS last, count(*) AS n, max(date) - min(date) + 1 AS days FROM ledger GROUP BY user_id", explorer.data_range)
over_ledger(
    "snk_csv_rows",
    """SELECT id, concat_ws(',', CAST(date AS VARCHAR), merchant, category, subcategory, CASE WHEN direction = 'debit' THEN CAST(amount AS VARCHAR) ELSE '' END, CASE WHEN direction = 'credit' THEN CAST(amount AS VARCHAR) ELSE '' END) AS line FROM ledger""",
    explorer.csv_rows,
)

# aggregates
_RATE = "CASE WHEN {0} > 0 THEN floor(CAST({1} AS DOUBLE) / CAST({0} AS DOUBLE) * 100 * 10 + 0.5) / 10 END"
over_ledger(
    "agg_summary",
    f"""SELECT user_id, n, credits, debits, incomes, total_credit, total_debit, income, spending, refunds, transfers_in, transfers_out, investments_out, CAST(c - i - r - t AS DOUBLE) AS other_credits,
      CAST(s - r AS DOUBLE) AS net_spending, CAST(c - d AS DOUBLE) AS net_cash_flow, CAST(i - (s - r) AS DOUBLE) AS savings, {_RATE.format("i", "i - (s - r)")} AS savings_rate,
      CASE WHEN credits > 0 THEN floor(total_credit / credits * 100 + 0.5) / 100 ELSE 0e0 END AS average_credit, CASE WHEN debits > 0 THEN floor(total_debit / debits * 100 + 0.5) / 100 ELSE 0e0 END AS average_debit,
      largest_debit, largest_credit, top_category, top_amount, first_date, last_date, last_date - first_date + 1 AS days
    FROM (SELECT user_id, count(*) AS n, count(*) FILTER (direction = 'credit') AS credits, count(*) FILTER (direction = 'debit') AS debits, count(*) FILTER ({EARNED}) AS incomes,
      {sums(total_credit="direction = 'credit'", total_debit="direction = 'debit'", income=EARNED, spending=SPENT, refunds=REFUNDED, transfers_in="direction = 'credit' AND category = 'TRANSFERS'", transfers_out="direction = 'debit' AND category = 'TRANSFERS'", investments_out="direction = 'debit' AND category = 'INVESTMENTS'")},
      coalesce(sum(amount) FILTER (direction = 'credit'), 0) AS c, coalesce(sum(amount) FILTER (direction = 'debit'), 0) AS d, coalesce(sum(amount) FILTER ({EARNED}), 0) AS i, coalesce(sum(amount) FILTER ({SPENT}), 0) AS s, coalesce(sum(amount) FILTER ({REFUNDED}), 0) AS r, coalesce(sum(amount) FILTER (direction = 'credit' AND category = 'TRANSFERS'), 0) AS t,
      max(CASE WHEN direction = 'debit' AND nth = 1 THEN id END) AS largest_debit, max(CASE WHEN direction = 'credit' AND nth = 1 THEN id END) AS largest_credit, min(date) AS first_date, max(date) AS last_date
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id, direction ORDER BY amount DESC, date, seq, id) AS nth FROM ledger) GROUP BY user_id)
    LEFT JOIN (SELECT user_id, category AS top_category, CAST(a AS DOUBLE) AS top_amount FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a DESC, category) AS k FROM (SELECT user_id, category, sum(amount) AS a FROM ledger WHERE {SPENT} GROUP BY ALL)) WHERE k = 1) USING (user_id)""",
    aggregates.summary,
)
_PERIODS = {
    "daily": ("strftime(date, '%Y-%m-%d')", 1), "weekly": ("CAST(isoyear(date) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(date) AS VARCHAR), 2, '0')", 1), "monthly": ("strftime(date, '%Y-%m')", 1),
    "monthly_25": ("strftime(CASE WHEN day(date) >= 25 THEN date ELSE date - INTERVAL 1 MONTH END, '%Y-%m')", 25),
    "quarterly_25": ("CAST(year(CASE WHEN day(date) >= 25 THEN date ELSE date - INTERVAL 1 MONTH END) AS VARCHAR) || '-Q' || CAST(quarter(CASE WHEN day(date) >= 25 THEN date ELSE date - INTERVAL 1 MONTH END) AS VARCHAR)", 25),
    "yearly": ("CAST(year(date) AS VARCHAR)", 1),
}
for _name, (_key, _first) in _PERIODS.items():
    over_ledger(
        f"agg_period_{_name}",
        f"""SELECT * EXCLUDE (i, s, r), CAST(i - (s - r) AS DOUBLE) AS savings, {_RATE.format("i", "i - (s - r)")} AS savings_rate FROM (
          SELECT user_id, {_key} AS period, {sums(income=EARNED, spending=SPENT, refunds=REFUNDED, credit="direction = 'credit'", debit="direction = 'debit'", transfers_in="direction = 'credit' AND category = 'TRANSFERS'", transfers_out="direction = 'debit' AND category = 'TRANSFERS'")},
          CAST(sum(CASE WHEN direction = 'credit' THEN amount ELSE -amount END) AS DOUBLE) AS net, count(*) AS n, min(date) AS first_date,
          coalesce(sum(amount) FILTER ({EARNED}), 0) AS i, coalesce(sum(amount) FILTER ({SPENT}), 0) AS s, coalesce(sum(amount) FILTER ({REFUNDED}), 0) AS r FROM ledger GROUP BY ALL)""",
        lambda t, grain=_name.split("_")[0], first=_first: aggregates.period_series(t, grain, first),
    )
over_ledger(
    "agg_monthly_average",
    f"SELECT user_id, count(*) AS periods, floor(CAST(sum(s) AS DOUBLE) / count(*) * 100 + 0.5) / 100 AS average FROM (SELECT user_id, strftime(date, '%Y-%m') AS period, coalesce(sum(amount) FILTER ({SPENT}), 0) AS s FROM ledger GROUP BY ALL) GROUP BY user_id",
    lambda t: aggregates.monthly_average(aggregates.period_series(t, "monthly"), "spending"),
)
over_ledger(
    "win_moving_average",
    f"SELECT user_id, period, spending, floor(avg(spending) OVER (PARTITION BY user_id ORDER BY period ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) * 100 + 0.5) / 100 AS average FROM (SELECT user_id, strftime(date, '%Y-%m') AS period, CAST(coalesce(sum(amount) FILTER ({SPENT}), 0) AS DOUBLE) AS spending FROM ledger GROUP BY ALL)",
    lambda t: balance.moving_average(aggregates.period_series(t, "monthly").select("user_id", "period", "spending"), "spending"),
)
over_ledger(
    "agg_daily_limit", "SELECT user_id, period, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY period DESC) AS k FROM (SELECT user_id, strftime(date, '%Y-%m-%d') AS period, count(*) AS n FROM ledger GROUP BY ALL)) WHERE k <= 400",
    lambda t: aggregates.latest_points(aggregates.period_series(t, "daily"), 400).select("user_id", "period", "n"),
)
over_ledger(
    "flt_downsample",
    "SELECT user_id, period, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY period) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS c FROM (SELECT user_id, strftime(date, '%Y-%m-%d') AS period, count(*) AS n FROM ledger GROUP BY ALL)) WHERE k % greatest(1, CAST(ceil(c / 100e0) AS BIGINT)) = 0 OR k = c - 1",
    lambda t: aggregates.downsample(aggregates.period_series(t, "daily").select("user_id", "period", "n"), 100),
)
over_netted("agg_category_spend", f"SELECT user_id, category, CAST(a AS DOUBLE) AS amount, n, floor(CAST(a AS DOUBLE) / n * 100 + 0.5) / 100 AS average, {PCT.format('a', 'sum(a) OVER (PARTITION BY user_id)')} AS share FROM (SELECT user_id, category, sum(net) AS a, count(*) AS n FROM netted GROUP BY ALL)", lambda t, n: aggregates.category_spend(n))
over_netted("agg_category_tree", "SELECT user_id, category, CAST(sum(a) AS DOUBLE) AS amount, string_agg(subcategory || '=' || CAST(a AS VARCHAR), ';' ORDER BY a DESC, subcategory) AS subcategories FROM (SELECT user_id, category, subcategory, CAST(sum(net) AS DECIMAL(28,2)) AS a FROM netted GROUP BY ALL) GROUP BY ALL", lambda t, n: aggregates.category_tree(n))
over_netted("agg_merchant_spend", "SELECT user_id, merchant, CAST(sum(a) AS DOUBLE) AS amount, CAST(sum(n) AS BIGINT) AS n, floor(CAST(sum(a) AS DOUBLE) / sum(n) * 100 + 0.5) / 100 AS average, max(last_date) AS last_date, max(CASE WHEN k = 1 THEN category END) AS category FROM (SELECT *, row_number() OVER (PARTITION BY user_id, merchant ORDER BY a DESC, category) AS k FROM (SELECT user_id, merchant, category, sum(net) AS a, count(*) AS n, max(date) AS last_date FROM netted GROUP BY ALL)) GROUP BY ALL", lambda t, n: aggregates.merchant_spend(n))
_TREND_SQL = f"SELECT user_id, period, name, CAST(sum(a) AS DOUBLE) AS amount FROM (SELECT user_id, strftime(date, '%Y-%m') AS period, category, sum(amount) AS a FROM ledger WHERE {SPENT} GROUP BY ALL) JOIN (SELECT user_id, category, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY w DESC, category) <= 2 THEN category ELSE 'OTHER CATEGORIES' END AS name FROM (SELECT user_id, category, sum(amount) AS w FROM ledger WHERE {SPENT} GROUP BY ALL)) USING (user_id, category) GROUP BY ALL"
over_ledger("agg_category_trend", _TREND_SQL, lambda t: aggregates.category_trend(t, "monthly", 2))
over_ledger(
    "agg_category_trend_filled",
    f"SELECT user_id, period, name, coalesce(amount, 0e0) AS amount FROM (SELECT DISTINCT user_id, period FROM ({_TREND_SQL})) JOIN (SELECT DISTINCT user_id, name FROM ({_TREND_SQL})) USING (user_id) LEFT JOIN ({_TREND_SQL}) USING (user_id, period, name)",
    lambda t: aggregates.zero_filled(aggregates.category_trend(t, "monthly", 2), "name", "amount"),
)
over_ledger("agg_category_wide", f"SELECT user_id, CAST(year(date) AS VARCHAR) AS period, {sums(FOOD="category = 'FOOD'", GROCERIES="category = 'GROCERIES'", SHOPPING="category = 'SHOPPING'")} FROM ledger WHERE {SPENT} GROUP BY ALL", lambda t: aggregates.category_trend_wide(t, "yearly", ["FOOD", "GROCERIES", "SHOPPING"]))
over_ledger("agg_income_sources", f"SELECT user_id, kind, CAST(a AS DOUBLE) AS amount, n, {PCT.format('a', 'sum(a) OVER (PARTITION BY user_id)')} AS share FROM (SELECT user_id, CASE WHEN category = 'SALARY/INCOME' THEN subcategory WHEN category = 'REFUNDS' THEN 'Refunds & cashback' WHEN category = 'TRANSFERS' AND subcategory = 'Family' THEN 'Family transfers' WHEN category = 'TRANSFERS' THEN 'Transfers from people' WHEN category = 'INVESTMENTS' THEN 'Investment proceeds' ELSE 'Other credits' END AS kind, sum(amount) AS a, count(*) AS n FROM ledger WHERE direction = 'credit' GROUP BY ALL)", aggregates.income_sources)
over_ledger("agg_weekday_profile", f"SELECT u.user_id, u.weekday, coalesce(CAST(a AS DOUBLE), 0e0) AS amount, coalesce(n, 0) AS n, coalesce(floor(CAST(a AS DOUBLE) / n * 100 + 0.5) / 100, 0e0) AS average FROM (SELECT DISTINCT user_id, unnest(range(1, 8)) AS weekday FROM ledger) u LEFT JOIN (SELECT user_id, isodow(date) AS weekday, sum(amount) AS a, count(*) AS n FROM ledger WHERE {SPENT} GROUP BY ALL) s USING (user_id, weekday)", aggregates.weekday_profile)
over_ledger("agg_weekday_months", f"SELECT user_id, strftime(date, '%Y-%m') AS period, isodow(date) AS weekday, CAST(sum(amount) AS DOUBLE) AS amount FROM ledger WHERE {SPENT} GROUP BY ALL", aggregates.weekday_months)
over_ledger("agg_calendar_heat", f"SELECT user_id, date, CAST(sum(amount) AS DOUBLE) AS amount, count(*) AS n FROM ledger WHERE {SPENT} GROUP BY ALL", aggregates.calendar_heat)
_BAND = "CASE WHEN amount < 100 THEN 0 WHEN amount < 500 THEN 1 WHEN amount < 1000 THEN 2 WHEN amount < 2500 THEN 3 WHEN amount < 5000 THEN 4 WHEN amount < 10000 THEN 5 WHEN amount < 25000 THEN 6 ELSE 7 END"
over_ledger("agg_amount_histogram", f"SELECT u.user_id, u.band, coalesce(n, 0) AS n, coalesce(a, 0e0) AS amount FROM (SELECT DISTINCT user_id, unnest(range(0, 8)) AS band FROM ledger) u LEFT JOIN (SELECT user_id, {_BAND} AS band, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS a FROM ledger WHERE {SPENT} GROUP BY ALL) s USING (user_id, band)", aggregates.amount_histogram)
over_ledger("agg_monthly_frequency", "SELECT user_id, strftime(date, '%Y-%m') AS period, count(*) AS n, count(*) FILTER (direction = 'debit') AS debits, count(*) FILTER (direction = 'credit') AS credits FROM ledger GROUP BY ALL", aggregates.monthly_frequency)
over_netted("agg_payment_methods", f"SELECT user_id, method, CAST(a AS DOUBLE) AS amount, n, {PCT.format('a', 'sum(a) OVER (PARTITION BY user_id)')} AS share, floor(CAST(a AS DOUBLE) / n * 100 + 0.5) / 100 AS average FROM (SELECT user_id, coalesce(nullif(payment_method, ''), 'Other') AS method, sum(net) AS a, count(*) AS n FROM netted GROUP BY ALL)", lambda t, n: aggregates.payment_methods(n))
_SERIES_SQL = f"""SELECT user_id, {{key}} AS period, CAST(greatest(coalesce(sum(greatest(amount - coalesce(refunded, 0), 0)) FILTER ({SPENT}), 0) - coalesce(sum(amount) FILTER ({REFUNDED} AND refund_for IS NULL), 0), 0) AS DOUBLE) AS net,
  {sums(income=EARNED)}, CAST(sum(CASE WHEN direction = 'credit' THEN amount ELSE -amount END) AS DOUBLE) AS cash_flow, count(*) AS n, min(date) AS first_date FROM linked {{where}} GROUP BY ALL"""
over_netted("agg_spend_series", _SERIES_SQL.format(key="strftime(date, '%Y-%m')", where=""), lambda t, n: aggregates.spend_series(t, "monthly"))
over_netted(
    "agg_merchant_months",
    """SELECT m.user_id, m.merchant, r.period, coalesce(a, 0e0) AS amount FROM (SELECT DISTINCT user_id, merchant FROM netted) m
      JOIN (SELECT user_id, period FROM (SELECT user_id, period, row_number() OVER (PARTITION BY user_id ORDER BY period DESC) AS k FROM (SELECT DISTINCT user_id, strftime(date, '%Y-%m') AS period FROM ledger)) WHERE k <= 6) r USING (user_id)
      LEFT JOIN (SELECT user_id, merchant, strftime(date, '%Y-%m') AS period, CAST(sum(net) AS DOUBLE) AS a FROM netted GROUP BY ALL) s ON s.user_id = m.user_id AND s.merchant = m.merchant AND s.period = r.period""",
    lambda t, n: aggregates.merchant_months(n, t),
)
_STATS_SQL = """SELECT user_id, {cols} category, CAST(a AS DOUBLE) AS amount, n, floor(CAST(a AS DOUBLE) / n * 100 + 0.5) / 100 AS average, largest, largest_amount, first, last FROM (
  SELECT user_id, {key}, sum(net) AS a, count(*) AS n, arg_max(id, nth) AS largest, CAST(max(net) AS DOUBLE) AS largest_amount, min(date) AS first, max(date) AS last FROM (SELECT *, -row_number() OVER (PARTITION BY user_id, {key} ORDER BY net DESC, date, seq, id) AS nth FROM netted {where}) GROUP BY ALL)"""
_MAIN_SQL = " JOIN (SELECT user_id, merchant, arg_max(category, nth) AS category FROM (SELECT *, -row_number() OVER (PARTITION BY user_id, merchant ORDER BY w DESC, category) AS nth FROM (SELECT user_id, merchant, category, sum(net) AS w FROM netted GROUP BY ALL)) GROUP BY ALL) USING (user_id, merchant)"
over_netted("agg_category_stats", _STATS_SQL.format(cols="", key="category", where=""), lambda t, n: aggregates.group_stats(n, "category"))
over_netted("agg_merchant_stats", _STATS_SQL.format(cols="merchant,", key="merchant", where="") + _MAIN_SQL, lambda t, n: aggregates.group_stats(n, "merchant"))

# refunds, comparisons, rankings
over_ledger(
    "jn_refund_links",
    f"SELECT user_id, refund_id, debit_id FROM (SELECT r.user_id, r.id AS refund_id, d.id AS debit_id, row_number() OVER (PARTITION BY r.user_id, r.id ORDER BY (d.amount = r.amount) DESC, d.date DESC, d.seq DESC, d.id) AS nth FROM ledger r JOIN ledger d ON d.user_id = r.user_id AND lower(d.merchant) = lower(r.merchant) AND d.direction = 'debit' AND d.date BETWEEN r.date - 90 AND r.date AND d.amount >= r.amount WHERE r.{REFUNDED.replace('category', 'r.category')}) WHERE nth = 1",
    refunds.best_links,
)
query("jn_refund_links_greedy", "SELECT * FROM links", NETTED_SQL)(lambda spark, d: refunds.greedy_links(sources.from_lineitem(spark, d)))
over_netted("jn_refund_offsets", "SELECT user_id, id, CAST(refunded AS DOUBLE) AS refunded FROM linked WHERE refunded IS NOT NULL", lambda t, n: t.where("refunded IS NOT NULL").select("user_id", "id", aggregates.money("refunded")))
over_netted("flt_net_rows", "SELECT user_id, id, CAST(net AS DOUBLE) AS net FROM netted", lambda t, n: n.select("user_id", "id", aggregates.money("net")))
_IN = lambda p: f"date BETWEEN DATE '{p.first}' AND DATE '{p.last}'"
over_netted(
    "agg_category_changes",
    f"""SELECT user_id, category, CAST(a AS DOUBLE) AS now, CAST(b AS DOUBLE) AS "then", n_now, n_then, CAST(a - b AS DOUBLE) AS delta, pct AS percent, kind, kind <> 'flat' AND abs(a - b) >= 500 AND coalesce(abs(pct), 100) >= 25 AND greatest(n_now, n_then) >= 3 AS significant FROM (
      SELECT *, CASE WHEN b > 0 THEN floor(CAST(a - b AS DOUBLE) / CAST(b AS DOUBLE) * 100 * 10 + 0.5) / 10 END AS pct, CASE WHEN b = 0 AND a > 0 THEN 'new' WHEN a = 0 AND b > 0 THEN 'stopped' WHEN a > b THEN 'increase' WHEN a < b THEN 'decrease' ELSE 'flat' END AS kind FROM (
      SELECT user_id, category, coalesce(sum(net) FILTER ({_IN(YEAR)}), 0) AS a, coalesce(sum(net) FILTER ({_IN(BEFORE)}), 0) AS b, count(*) FILTER ({_IN(YEAR)}) AS n_now, count(*) FILTER ({_IN(BEFORE)}) AS n_then FROM netted WHERE {_IN(YEAR)} OR {_IN(BEFORE)} GROUP BY ALL))""",
    lambda t, n: compare.changes(n, "category", YEAR, BEFORE),
)
over_netted(
    "agg_period_totals",
    f"""SELECT user_id, gross, CAST(g - w AS DOUBLE) AS refunded, CAST(u AS DOUBLE) AS unlinked, CAST(greatest(w - u, 0) AS DOUBLE) AS net, income, credits, debits, CAST(c - d AS DOUBLE) AS cash_flow, transfers_out, investments_out, n, n_spending FROM (
      SELECT user_id, {sums(gross=SPENT, income=EARNED, credits="direction = 'credit'", debits="direction = 'debit'", transfers_out="direction = 'debit' AND category = 'TRANSFERS'", investments_out="direction = 'debit' AND category = 'INVESTMENTS'")}, coalesce(sum(amount) FILTER ({SPENT}), 0) AS g,
        coalesce(sum(greatest(amount - coalesce(refunded, 0), 0)) FILTER ({SPENT}), 0) AS w, coalesce(sum(amount) FILTER ({REFUNDED} AND refund_for IS NULL), 0) AS u, coalesce(sum(amount) FILTER (direction = 'credit'), 0) AS c, coalesce(sum(amount) FILTER (direction = 'debit'), 0) AS d,
        count(*) AS n, count(*) FILTER ({SPENT} AND amount > coalesce(refunded, 0)) AS n_spending FROM linked WHERE {_IN(YEAR)} GROUP BY user_id)""",
    lambda t, n: compare.period_totals(t, YEAR),
)
for _key in ("category", "merchant"):
    over_netted(
        f"agg_analysis_{_key}",
        f"""SELECT user_id, {_key}, amount, n, average, largest, largest_amount, first, last, place, share, before, n_before, CAST(d AS DOUBLE) AS delta, percent, kind, kind <> 'flat' AND abs(d) >= 500 AND coalesce(abs(percent), 100) >= 25 AND greatest(n, n_before) >= 3 AS significant FROM (
          SELECT *, a - b AS d, CAST(b AS DOUBLE) AS before, row_number() OVER (PARTITION BY user_id ORDER BY a DESC, {_key}) AS place, {PCT.format('a', 'sum(a) OVER (PARTITION BY user_id)')} AS share, CASE WHEN b > 0 THEN floor(CAST(a - b AS DOUBLE) / CAST(b AS DOUBLE) * 100 * 10 + 0.5) / 10 END AS percent,
            CASE WHEN b = 0 THEN 'new' WHEN a > b THEN 'increase' WHEN a < b THEN 'decrease' ELSE 'flat' END AS kind FROM (
            SELECT user_id, {_key}, CAST(a AS DOUBLE) AS amount, a, coalesce(b, 0) AS b, n, coalesce(n_before, 0) AS n_before, floor(CAST(a AS DOUBLE) / n * 100 + 0.5) / 100 AS average, largest, largest_amount, first, last FROM (
              SELECT user_id, {_key}, sum(net) AS a, count(*) AS n, arg_max(id, nth) AS largest, CAST(max(net) AS DOUBLE) AS largest_amount, min(date) AS first, max(date) AS last FROM (SELECT *, -row_number() OVER (PARTITION BY user_id, {_key} ORDER BY net DESC, date, seq, id) AS nth FROM netted WHERE {_IN(YEAR)}) GROUP BY ALL)
            LEFT JOIN (SELECT user_id, {_key}, sum(net) AS b, count(*) AS n_before FROM netted WHERE {_IN(BEFORE)} GROUP BY ALL) USING (user_id, {_key}))) WHERE place <= 10""",
        lambda t, n, key=_key: compare.analysis(t, n, key, YEAR, BEFORE, 10).select("user_id", key, "amount", "n", "average", "largest", "largest_amount", "first", "last", "place", "share", "before", "n_before", "delta", "percent", "kind", "significant"),
    )
over_netted(
    "agg_period_ranking",
    f"SELECT user_id, rank() OVER (PARTITION BY user_id ORDER BY net DESC) AS place, period, first_date, net AS spending, n FROM ({_SERIES_SQL.format(key=_PERIODS['weekly'][0], where=f'WHERE {_IN(YEAR)}')})",
    lambda t, n: compare.period_ranking(t, YEAR, "weekly"),
)
EVENTS_NETTED = linked_sql(sources.EVENTS_SQL)
_DAYS_SQL = f"""SELECT user_id, date, n, debits, credits, money_out, money_in, CAST(greatest(s - u, 0) AS DOUBLE) AS spending, income, refunds, transfers_in, money_out + money_in AS value, largest_payment, largest_receipt FROM (
  SELECT user_id, date, count(*) AS n, count(*) FILTER (direction = 'debit') AS debits, count(*) FILTER (direction = 'credit') AS credits, {sums(money_out="direction = 'debit'", money_in="direction = 'credit'", income=EARNED, refunds=REFUNDED, transfers_in="direction = 'credit' AND category = 'TRANSFERS'")},
    coalesce(sum(left_) FILTER ({SPENT}), 0) AS s, coalesce(sum(amount) FILTER ({REFUNDED} AND refund_for IS NULL), 0) AS u,
    max(CASE WHEN {SPENT} AND left_ > 0 AND p = 1 THEN id END) AS largest_payment, max(CASE WHEN direction = 'credit' AND r = 1 THEN id END) AS largest_receipt
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date ORDER BY CASE WHEN {SPENT} THEN 0 ELSE 1 END, left_ DESC, date, seq, id) AS p, row_number() OVER (PARTITION BY user_id, date, direction ORDER BY amount DESC, date, seq, id) AS r FROM (SELECT *, greatest(amount - coalesce(refunded, 0), 0) AS left_ FROM linked)) GROUP BY ALL)"""


def _event_days(spark: SparkSession, d: str) -> DataFrame:
    days = compare.day_stats(refunds.linked(sources.from_events(spark, d)))
    return days.withColumn("value", F.col("money_out") + F.col("money_in"))


query("agg_day_stats", _DAYS_SQL, EVENTS_NETTED)(_event_days)
for _measure in ("n", "spending", "money_in", "income", "value"):
    query(
        f"top_days_by_{_measure}", f"SELECT * EXCLUDE (p) FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY {_measure} DESC) AS p FROM ({_DAYS_SQL}) WHERE {_measure} > 0) WHERE p = 1", EVENTS_NETTED
    )(lambda spark, d, measure=_measure: compare.top_ties(_event_days(spark, d), measure))
over_ledger("top_largest_transactions", "SELECT user_id, place, id, date, CAST(amount AS DOUBLE) AS amount, merchant FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY amount DESC) AS place FROM ledger WHERE direction = 'debit') WHERE place <= 5", lambda t: compare.largest_transactions(t, 5, "debit"))
over_netted("agg_merchant_ranking", f"SELECT user_id, place, merchant, CAST(a AS DOUBLE) AS amount, n, share FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a DESC, merchant) AS place, {PCT.format('a', 'sum(a) OVER (PARTITION BY user_id)')} AS share FROM (SELECT user_id, merchant, sum(net) AS a, count(*) AS n FROM netted GROUP BY ALL)) WHERE place <= 8", lambda t, n: compare.merchant_ranking(n, 8))

# ordered computations
_SIGNED = "CASE WHEN direction = 'credit' THEN amount ELSE -amount END"
over_ledger("win_cumulative_flow", f"SELECT user_id, date, CAST(s AS DOUBLE) AS net, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY date) AS DOUBLE) AS cumulative FROM (SELECT user_id, date, sum({_SIGNED}) AS s FROM ledger GROUP BY ALL)", balance.cumulative_flow)
over_ledger("win_balance_on", f"SELECT user_id, CAST(sum({_SIGNED}) AS DOUBLE) AS balance, max(date) AS date FROM ledger WHERE date <= DATE '{AS_OF}' GROUP BY user_id", lambda t: balance.balance_on(balance.with_balance(t), AS_OF))


def _with_breaks(ledger: DataFrame) -> DataFrame:
    """A ledger with balances of which some are unknown and some are off by 0.02."""
    off = F.col("balance_after") + F.lit("0.02").cast("decimal(18,2)")
    return balance.with_balance(ledger).withColumn("balance_after", F.when(F.col("seq") == 7, None).when((F.col("seq") == 5) & F.col("is_recurring"), off).otherwise(F.col("balance_after")))


over_ledger(
    "win_chain_breaks",
    f"""SELECT user_id, count(*) AS n, count(*) FILTER (abs(b - lag_b - signed) > 0.011) AS breaks FROM (SELECT *, lag(b) OVER (PARTITION BY user_id ORDER BY date, seq, id) AS lag_b, sum(s) OVER (PARTITION BY user_id ORDER BY date, seq, id ROWS UNBOUNDED PRECEDING) AS all_s, s AS signed FROM (
      SELECT *, {_SIGNED} AS s, CASE WHEN seq = 5 AND is_recurring THEN run + 0.02 ELSE run END AS b FROM (SELECT *, sum({_SIGNED}) OVER (PARTITION BY user_id ORDER BY date, seq, id ROWS UNBOUNDED PRECEDING) AS run FROM ledger) WHERE seq <> 7)) GROUP BY user_id""",
    lambda t: balance.chain_breaks(_with_breaks(t)),
)
over_ledger(
    "win_flow_with_balance",
    f"""SELECT user_id, date, CAST(net AS DOUBLE) AS net, CAST(sum(net) OVER (PARTITION BY user_id ORDER BY date) AS DOUBLE) AS cumulative, balance FROM (SELECT user_id, date, sum({_SIGNED}) AS net, CAST(arg_max(b, nth) AS DOUBLE) AS balance FROM (
      SELECT *, CASE WHEN seq = 7 THEN NULL WHEN seq = 5 AND is_recurring THEN run + 0.02 ELSE run END AS b, CASE WHEN seq <> 7 THEN row_number() OVER (PARTITION BY user_id, date ORDER BY seq, id) END AS nth FROM (SELECT *, sum({_SIGNED}) OVER (PARTITION BY user_id ORDER BY date, seq, id ROWS UNBOUNDED PRECEDING) AS run FROM ledger)) GROUP BY ALL)""",
    lambda t: balance.cumulative_flow(_with_breaks(t)),
)
over_ledger(
    "win_daily_strip",
    f"""SELECT s.user_id, s.date, coalesce(CAST(c AS DOUBLE), 0e0) AS money_in, coalesce(CAST(p AS DOUBLE), 0e0) AS spent, CAST((SELECT sum({_SIGNED}) FROM ledger x WHERE x.user_id = s.user_id AND x.date <= s.date) AS DOUBLE) AS balance
      FROM (SELECT user_id, CAST(unnest(generate_series(last - INTERVAL 29 DAY, last, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT user_id, CAST(max(date) AS TIMESTAMP) AS last FROM ledger GROUP BY user_id)) s
      LEFT JOIN (SELECT user_id, date, coalesce(sum(amount) FILTER (direction = 'credit'), 0) AS c, coalesce(sum(amount) FILTER ({SPENT}), 0) AS p FROM ledger GROUP BY ALL) f USING (user_id, date)""",
    lambda t: balance.daily_strip(t, 30),
)
over_ledger(
    "win_intervals",
    "SELECT user_id, direction, series, date, CAST(amount AS DOUBLE) AS amount, date - lag(date) OVER (PARTITION BY user_id, direction, series ORDER BY date) AS gap FROM (SELECT user_id, direction, lower(merchant) AS series, date, sum(amount) AS amount FROM ledger WHERE (direction = 'debit' AND category NOT IN ('ATM/CASH', 'BANKING FEES', 'REFUNDS', 'OTHER')) OR (direction = 'credit' AND category IN ('SALARY/INCOME', 'TRANSFERS')) GROUP BY ALL)",
    lambda t: recurring.intervals(t).select("user_id", "direction", "series", "date", aggregates.money("amount"), "gap"),
)

# imports and planning
over_ledger(
    "jn_new_rows", "SELECT id FROM ledger WHERE date > DATE '1999-12-31'",
    lambda t: imports.new_rows(t, t.where(F.col("date") <= F.lit(dt.date(1999, 12, 31))), "user_id", "id").select("id"),
)
over_ledger("win_occurrences", "SELECT id, CAST(row_number() OVER (PARTITION BY user_id, date, merchant ORDER BY id) - 1 AS INTEGER) AS occurrence FROM ledger", lambda t: imports.occurrences(t, "user_id", "date", "merchant").select("id", "occurrence"))


def _two_sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Line items of 'bank' and of 'wallet' as two statements of one user's payments; every third wallet row carries a payment id."""
    rows = sources.from_lineitem(spark, d).select("user_id", "id", "date", "direction", F.floor(F.col("amount") / 20000).cast("decimal(18,2)").alias("amount"), F.substring("merchant", 1, 7).alias("merchant"), "source", (F.col("reference").cast("long") % 3 == 0).alias("has_id"))
    return rows.where("source = 'bank'"), rows.where("source = 'wallet'")


query(
    "jn_lookalikes",
    """, keyed AS (SELECT user_id, id, date, direction, CAST(floor(amount / 20000) AS DECIMAL(18,2)) AS amount, substr(regexp_replace(upper(substr(merchant, 1, 7)), '[^A-Z0-9]+', '', 'g'), 1, 40) AS key, source, CAST(reference AS BIGINT) % 3 = 0 AS has_id FROM ledger),
      met AS (SELECT a.user_id, a.id AS incoming, b.id AS existing FROM keyed a JOIN keyed b ON a.user_id = b.user_id AND a.direction = b.direction AND a.amount = b.amount AND a.key = b.key AND abs(a.date - b.date) <= 1 AND NOT (a.has_id AND b.has_id) WHERE a.source = 'bank' AND b.source = 'wallet')
      SELECT user_id, incoming, existing FROM (SELECT *, count(*) OVER (PARTITION BY user_id, incoming) AS x, count(*) OVER (PARTITION BY user_id, existing) AS y FROM met) WHERE x = 1 AND y = 1""",
)(lambda spark, d: imports.lookalikes(*_two_sources(spark, d)))
over_ledger(
    "agg_import_preview",
    f"""SELECT user_id, count(*) AS n, count(*) FILTER (NOT dup) AS fresh, count(*) FILTER (dup) AS duplicates, count(*) FILTER (NOT dup AND direction = 'debit') AS debits, count(*) FILTER (NOT dup AND direction = 'credit') AS credits, count(*) FILTER (NOT dup AND category = 'REFUNDS') AS refunds,
      count(*) FILTER (NOT dup AND category = 'TRANSFERS') AS transfers, count(*) FILTER (NOT dup AND is_recurring) AS recurring, count(*) FILTER (NOT dup AND confidence < 0.3) AS review, count(*) FILTER (NOT dup AND confidence >= 0.8) AS high, count(*) FILTER (NOT dup AND confidence >= 0.6 AND confidence < 0.8) AS medium,
      count(*) FILTER (NOT dup AND confidence < 0.6) AS low, count(DISTINCT CASE WHEN NOT dup THEN lower(merchant) END) AS merchants, {sums(debit="NOT dup AND direction = 'debit'", credit="NOT dup AND direction = 'credit'")}, min(date) AS first, max(date) AS last FROM (SELECT *, date <= DATE '1999-12-31' AS dup FROM ledger WHERE date >= DATE '1999-06-01') GROUP BY user_id""",
    lambda t: imports.preview(t.where(F.col("date") >= F.lit(dt.date(1999, 6, 1))).withColumns({"is_duplicate": F.col("date") <= F.lit(dt.date(1999, 12, 31)), "needs_review": F.col("confidence") < 0.3})),
)
over_ledger("jn_known_rows", "SELECT id FROM ledger WHERE date BETWEEN DATE '1999-06-01' AND DATE '1999-12-31'", lambda t: imports.known_rows(t.where(F.col("date") >= F.lit(dt.date(1999, 6, 1))), t.where(F.col("date") <= F.lit(dt.date(1999, 12, 31))), "user_id", "id").select("id"))
over_ledger("agg_merchant_counts", "SELECT user_id, substr(regexp_replace(upper(merchant), '[^A-Z0-9]+', '', 'g'), 1, 40) AS key, count(*) AS n FROM ledger WHERE direction = 'debit' GROUP BY ALL", imports.merchant_counts)
_PRIMARY_SQL = "SELECT *, row_number() OVER (PARTITION BY user_id, event_id ORDER BY CASE source WHEN 'bank' THEN 0 ELSE 1 END, id) = 1 AS is_primary FROM ledger"
_PRIORITY = {"bank": 0, "wallet": 1}
over_ledger("evt_primaries", f"SELECT user_id, id, is_primary FROM ({_PRIMARY_SQL})", lambda t: imports.primaries(t, _PRIORITY).select("user_id", "id", "is_primary"))
over_ledger("src_primary_scan", f"SELECT user_id, id, date, CAST(amount AS DOUBLE) AS amount FROM ({_PRIMARY_SQL}) WHERE is_primary", lambda t: sources.primary_only(imports.primaries(t, _PRIORITY)).select("user_id", "id", "date", aggregates.money("amount")))
over_ledger("jn_orphans_promoted", f"SELECT user_id, event_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_id ORDER BY CASE source WHEN 'bank' THEN 0 ELSE 1 END, id) AS k FROM ({_PRIMARY_SQL}) WHERE NOT (is_primary AND statement_id = '2000-01')) WHERE k = 1", lambda t: imports.primaries(imports.primaries(t, _PRIORITY).where("NOT (is_primary AND statement_id = '2000-01')"), _PRIORITY).where("is_primary").select("user_id", "event_id", "id"))
over_ledger("jn_provenance", f"SELECT user_id, id, name, row_number() OVER (PARTITION BY user_id, event_id ORDER BY is_primary DESC, id) AS place FROM ({_PRIMARY_SQL}) LEFT JOIN (SELECT DISTINCT statement_id, 'Statement ' || statement_id AS name FROM ledger WHERE statement_id < '2000-01') USING (statement_id)", lambda t: imports.provenance(imports.primaries(t, _PRIORITY), t.where("statement_id < '2000-01'").select("statement_id", F.concat(F.lit("Statement "), "statement_id").alias("name")).distinct()).select("user_id", "id", "name", "place"))
over_ledger("jn_near_rows", "SELECT l.id FROM ledger l JOIN (SELECT user_id, min(date) - 3 AS f, max(date) + 3 AS t FROM ledger WHERE source = 'bank' AND statement_id = '2000-02' GROUP BY user_id) s USING (user_id) WHERE l.source <> 'bank' AND l.date BETWEEN f AND t", lambda t: imports.near_rows(t.where("source = 'bank' AND statement_id = '2000-02'"), t, "bank").select("id"))
over_ledger("jn_available", "SELECT id FROM ledger l WHERE NOT EXISTS (SELECT 1 FROM ledger o WHERE o.user_id = l.user_id AND o.event_id = l.event_id AND o.source = 'bank') AND statement_id <> '2000-03' AND seq <> 4", lambda t: imports.available(t, t.where("statement_id = '2000-03'"), t.where("seq = 4"), "bank").select("id"))
over_ledger("src_value_date", "SELECT id, coalesce(value_date, date) AS date FROM ledger", lambda t: sources.by_value_date(t).select("id", "date"))
over_ledger("flt_value_basis", "SELECT id FROM ledger WHERE coalesce(value_date, date) BETWEEN DATE '2000-01-01' AND DATE '2000-01-31' AND lower(merchant) = 'brand#11'", lambda t: t.where(explorer.Filter(first=dt.date(2000, 1, 1), last=dt.date(2000, 1, 31), merchant="BRAND#11", basis="value").column()).select("id"))
over_ledger("flt_needs_review", "SELECT id FROM ledger WHERE confidence < 0.6", lambda t: t.where(explorer.Filter(review=True).column()).select("id"))
over_ledger("flt_flags", f"SELECT id, 'refund' AS flag FROM ledger WHERE {REFUNDED} UNION ALL SELECT id, 'recurring' FROM ledger WHERE is_recurring UNION ALL SELECT id, 'moved' FROM ledger WHERE category IN ('TRANSFERS', 'INVESTMENTS')", lambda t: t.where(explorer.Filter(flag="refund").column()).select("id", F.lit("refund").alias("flag")).union(t.where(explorer.Filter(flag="recurring").column()).select("id", F.lit("recurring"))).union(t.where(explorer.Filter(flag="moved").column()).select("id", F.lit("moved"))))
over_ledger("flt_source", "SELECT id FROM ledger l WHERE EXISTS (SELECT 1 FROM ledger o WHERE o.user_id = l.user_id AND o.event_id = l.event_id AND o.source = 'wallet')", lambda t: explorer.with_source(t, "wallet").select("id"))
over_ledger("flt_explorer_listing", "SELECT id, date, merchant, CAST(amount AS DOUBLE) AS amount, source, sources FROM ledger JOIN (SELECT user_id, event_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM ledger GROUP BY ALL) USING (user_id, event_id)", explorer.listed)
over_ledger("top_export", f"SELECT id FROM ledger WHERE {_WANTED_SQL} ORDER BY date DESC, seq DESC, id LIMIT 200000", lambda t: explorer.export(t, WANTED).select("id"))
over_ledger("agg_category_options", "SELECT category, string_agg(DISTINCT subcategory, ';' ORDER BY subcategory) AS subcategories, count(*) AS n FROM ledger GROUP BY category", explorer.category_tree)
over_ledger(
    "set_recurring_ids",
    "SELECT user_id, id FROM ledger WHERE is_recurring UNION SELECT user_id, id FROM ledger WHERE category = 'FOOD'",
    lambda t: t.where("is_recurring").select("user_id", "id").union(t.where("category = 'FOOD'").select("user_id", "id")).distinct(),
)


@query(
    "fn_text_and_dates",
    """SELECT p_partkey, substr(regexp_replace(upper(p_brand), '[^A-Z0-9]+', '', 'g'), 1, 40) AS merchant, trim(regexp_replace(upper(p_type), '[^A-Z0-9]+', ' ', 'g')) AS narration FROM part""",
    "unused AS (SELECT 1)",
)
def text_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.merchant_key(F.col("p_brand")).alias("merchant"), X.narration_key(F.col("p_type")).alias("narration"))
