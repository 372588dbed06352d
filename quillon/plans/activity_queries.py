"""Queries over standing payments and everyday activity: recurring series, plans, unusual activity, insights; each with its SQL oracle."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import expressions as X
from quillon.operators import anomalies, insights, planning, recurring, refunds
from quillon.plans.ledger_queries import SPENT, SQL, linked_sql, query
from quillon.session import table
from quillon.sources import ledger as sources

R2 = "floor(({0}) * 100 + 0.5) / 100"

# recurring series over standing payments
AS_OF = dt.date(2000, 12, 20)
STANDING = f"""{sources.STANDING_SQL.replace("ledger AS", "every_row AS", 1)}, ledger AS (SELECT * FROM every_row WHERE date <= DATE '{AS_OF}')"""
SERIES = f"""{STANDING}, days AS (
  SELECT user_id, direction, lower(merchant) AS series, date, sum(amount) AS amount, count(*) AS rows, any_value(merchant) AS merchant, any_value(category) AS category, any_value(subcategory) AS subcategory, count(*) FILTER (payment_method = 'AUTOPAY') AS autopays
  FROM ledger WHERE (direction = 'debit' AND category NOT IN ('ATM/CASH', 'BANKING FEES', 'REFUNDS', 'OTHER')) OR (direction = 'credit' AND category IN ('SALARY/INCOME', 'TRANSFERS')) GROUP BY ALL
), gapped AS (SELECT *, date - lag(date) OVER (PARTITION BY user_id, direction, series ORDER BY date) AS gap, lag(amount) OVER (PARTITION BY user_id, direction, series ORDER BY date) AS before FROM days
), basics AS (
  SELECT *, CASE WHEN med BETWEEN 5 AND 9 THEN 'weekly' WHEN med BETWEEN 12 AND 17 THEN 'biweekly' WHEN med BETWEEN 26 AND 35 THEN 'monthly' WHEN med BETWEEN 84 AND 100 THEN 'quarterly' WHEN med BETWEEN 350 AND 380 THEN 'yearly' END AS frequency FROM (
    SELECT user_id, direction, series, count(*) AS n, sum(rows) AS rows, list(gap) FILTER (gap IS NOT NULL) AS gaps, CAST(median(gap) AS DOUBLE) AS med, CAST(sum(amount) AS DOUBLE) AS s, CAST(sum(CAST(amount * amount AS DECIMAL(38,4))) AS DOUBLE) AS q, max(date) AS last_date,
      CAST(arg_max(amount, date) AS DOUBLE) AS last_amount, CAST(arg_max(before, date) AS DOUBLE) AS before, arg_max(category, date) AS category, arg_max(subcategory, date) AS subcategory, arg_max(merchant, date) AS merchant, median(day(date)) AS day, sum(autopays) AS autopays FROM gapped GROUP BY ALL) WHERE n >= 2
), rated AS (
  SELECT *, len(list_filter(gaps, lambda g: abs(g - med) <= greatest(3, 0.15 * nominal))) / len(gaps) AS regularity, s / n AS mean, sqrt(greatest(n * q - s * s, 0)) / s AS cv, category IN ('UTILITIES', 'BILLS', 'RENT', 'SUBSCRIPTIONS', 'EDUCATION', 'INVESTMENTS') AS bill FROM (
    SELECT *, CASE frequency WHEN 'weekly' THEN 7 WHEN 'biweekly' THEN 14 WHEN 'monthly' THEN 30 WHEN 'quarterly' THEN 91 ELSE 365 END AS nominal FROM basics WHERE frequency IS NOT NULL)
), kept AS (
  SELECT *, n = 2 AND frequency = 'monthly' AND cv < 0.01 AND regularity = 1 AS pair, CASE frequency WHEN 'monthly' THEN 1 WHEN 'quarterly' THEN 3 WHEN 'yearly' THEN 12 END AS months FROM rated
  WHERE regularity >= 0.6 AND NOT (frequency = 'weekly' AND cv > 0.1) AND NOT (category IN ('FOOD', 'GROCERIES', 'SHOPPING', 'TRANSPORTATION', 'TRAVEL', 'PERSONAL', 'ENTERTAINMENT', 'HEALTHCARE') AND cv > 0.15) AND NOT (category = 'TRANSFERS' AND cv > 0.05) AND NOT (NOT bill AND cv > 0.5)
), dated AS (
  SELECT *, CASE WHEN months IS NULL THEN CAST(last_date + INTERVAL (nominal) DAY AS DATE) ELSE CAST(date_trunc('month', last_date + INTERVAL (months) MONTH) AS DATE) + CAST(least(floor(day + 0.5), day(last_day(CAST(last_date + INTERVAL (months) MONTH AS DATE)))) AS INTEGER) - 1 END AS next_date,
    DATE '{AS_OF}' - last_date > 2.2 * med AS ended, least(1.0, CASE WHEN pair THEN least(sure, 0.5) ELSE sure END) AS capped FROM (SELECT *, 0.4e0 * regularity + 0.3e0 * (1 - least(1e0, cv / 0.5e0)) + 0.3e0 * least(1e0, n / 6e0) + CASE WHEN bill THEN 0.05e0 ELSE 0e0 END AS sure FROM kept) WHERE n >= 3 OR pair
), series AS (
  SELECT *, CASE WHEN confidence >= 0.75 THEN 'High' WHEN confidence >= 0.55 THEN 'Medium' ELSE 'Low' END AS label, {R2.format("average * CASE frequency WHEN 'weekly' THEN 52e0 / 12 WHEN 'biweekly' THEN 26e0 / 12 WHEN 'monthly' THEN 1e0 WHEN 'quarterly' THEN 1e0 / 3 ELSE 1e0 / 12 END")} AS monthly FROM (
    SELECT user_id, direction, series, merchant, category, subcategory, frequency, n, {R2.format("mean")} AS average, {R2.format("last_amount")} AS last_amount, CASE WHEN cv <= 0.05 THEN 'fixed' ELSE 'variable' END AS pattern,
      CASE WHEN direction = 'debit' AND autopays >= ceil(rows / 2) THEN 'AUTOPAY' WHEN cv <= 0.05 THEN 'FIXED' ELSE 'VARIABLE' END AS kind, floor(cv * 1000 + 0.5) / 1000 AS variability,
      {R2.format("CASE WHEN cv <= 0.05 OR (n >= 3 AND abs(last_amount - before) <= 0.01 * last_amount) THEN last_amount ELSE mean END")} AS expected, CASE WHEN before > 0 AND abs(last_amount - before) / before >= 0.05 THEN {R2.format("before")} END AS changed_from,
      last_date, next_date, CAST(floor(med + 0.5) AS INTEGER) AS interval_days, {R2.format("capped")} AS confidence, NOT ended AND next_date < DATE '{AS_OF}' AS overdue, ended FROM dated))"""


def standing(spark: SparkSession, d: str) -> DataFrame:
    return sources.standing(spark, d).where(F.col("date") <= F.lit(AS_OF))


def series_of(spark: SparkSession, d: str) -> DataFrame:
    return recurring.detect(standing(spark, d), F.lit(AS_OF))


query("rec_series", "SELECT * FROM series", SERIES)(series_of)
query("rec_members", "SELECT l.user_id, l.id FROM ledger l JOIN series s ON s.user_id = l.user_id AND s.direction = l.direction AND s.series = lower(l.merchant)", SERIES)(lambda spark, d: recurring.members(standing(spark, d), series_of(spark, d)))
query("rec_commitments", "SELECT user_id, floor(sum(monthly) * 100 + 0.5) / 100 AS monthly, count(*) AS n FROM series WHERE direction = 'debit' AND NOT ended GROUP BY user_id", SERIES)(
    lambda spark, d: insights.commitments(series_of(spark, d), spark.createDataFrame([], "user_id long, series string, monthly double"))
)

# manual obligations: one of each customer, some of which describe its standing payment
MANUAL_SQL = """manual AS (
  SELECT c_custkey AS user_id, CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 14 = 0 THEN c_mktsegment ELSE 'GYM' END AS name, 50.00::DECIMAL(18,2) AS amount, ['weekly', 'monthly', 'quarterly'][c_custkey % 3 + 1] AS frequency,
    CASE WHEN c_custkey % 5 > 0 THEN DATE '2000-01-31' END AS start_date, CASE WHEN c_custkey % 3 = 0 THEN 3 ELSE 31 END AS due_day, 'PERSONAL' AS category, 'expense' AS kind FROM customer)"""


def manual(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(
        key.alias("user_id"), key.cast("string").alias("id"), F.when(key % 14 == 0, F.col("c_mktsegment")).otherwise("GYM").alias("name"), F.lit("50.00").cast("decimal(18,2)").alias("amount"),
        F.element_at(F.array(*map(F.lit, ("weekly", "monthly", "quarterly"))), (key % 3 + 1).cast("int")).alias("frequency"), F.when(key % 5 > 0, F.lit("2000-01-31").cast("date")).alias("start_date"), F.when(key % 3 == 0, 3).otherwise(31).alias("due_day"),
        F.lit("PERSONAL").alias("category"), F.lit("expense").alias("kind"), F.lit(None).cast("string").alias("merchant_key"),
    )


UNTIL = dt.date(2001, 4, 30)
_KEY = "regexp_replace(upper({0}), '[^A-Z0-9]+', '', 'g')"
ITEMS = f"""{SERIES}, {MANUAL_SQL}, calendar AS (SELECT CAST(unnest(generate_series(DATE '{AS_OF}', DATE '{UNTIL}', INTERVAL 1 DAY)) AS DATE) AS due
), entered AS (
  SELECT m.*, due FROM manual m, calendar WHERE CASE WHEN frequency = 'weekly' THEN due >= anchor AND (due - anchor) % 7 = 0
    ELSE ((year(due) - year(coalesce(start_date, DATE '{AS_OF}'))) * 12 + month(due) - month(coalesce(start_date, DATE '{AS_OF}'))) % CASE frequency WHEN 'monthly' THEN 1 ELSE 3 END = 0 AND day(due) = least(due_day, day(last_day(due))) END
), own AS (
  SELECT s.* FROM series s WHERE NOT EXISTS (SELECT 1 FROM manual m WHERE m.user_id = s.user_id AND s.direction = 'debit' AND (contains({_KEY.format("s.merchant")}, {_KEY.format("m.name")}) OR contains({_KEY.format("m.name")}, {_KEY.format("s.merchant")}) OR (m.category = s.category AND m.frequency = s.frequency AND abs(CAST(m.amount AS DOUBLE) - s.average) <= greatest(50, 0.15 * s.average)))) AND NOT ended
), coming AS (
  SELECT *, CASE WHEN k = 0 THEN next_date WHEN frequency = 'weekly' THEN next_date + CAST(7 * k AS INTEGER) WHEN frequency = 'biweekly' THEN next_date + CAST(14 * k AS INTEGER)
      ELSE CAST(date_trunc('month', next_date + INTERVAL (k * step) MONTH) AS DATE) + CAST(least(day(last_date), day(last_day(CAST(next_date + INTERVAL (k * step) MONTH AS DATE)))) AS INTEGER) - 1 END AS due
  FROM (SELECT *, CASE frequency WHEN 'monthly' THEN 1 WHEN 'quarterly' THEN 3 ELSE 12 END AS step, unnest(range(60)) AS k FROM own)
), items AS (
  SELECT user_id, name, CAST(amount AS DOUBLE) AS amount, due AS date, kind, 'manual' AS source, category, frequency, 'Manual' AS confidence, false AS overdue FROM entered
  UNION ALL SELECT user_id, merchant, expected, greatest(due, DATE '{AS_OF}'), CASE WHEN direction = 'credit' THEN 'income' ELSE 'expense' END, 'detected', category, frequency, label, due < DATE '{AS_OF}' FROM coming WHERE due <= DATE '{UNTIL}' AND (due >= DATE '{AS_OF}' OR overdue))"""
ITEMS = ITEMS.replace("SELECT m.*, due FROM manual m, calendar", f"SELECT m.*, due FROM (SELECT *, coalesce(start_date, DATE '{AS_OF}' + CAST(((CASE WHEN due_day BETWEEN 1 AND 7 THEN due_day ELSE 1 END) - isodow(DATE '{AS_OF}') + 7) % 7 AS INTEGER)) AS anchor FROM manual) m, calendar")


def items_of(spark: SparkSession, d: str) -> DataFrame:
    return planning.upcoming(series_of(spark, d), manual(spark, d), AS_OF, UNTIL)


query("pln_upcoming", "SELECT * FROM items", ITEMS)(items_of)
query("pln_upcoming_days", f"SELECT user_id, date, floor(sum(amount) * 100 + 0.5) / 100 AS amount, count(*) AS n FROM items WHERE kind = 'expense' GROUP BY ALL", ITEMS)(
    lambda spark, d: items_of(spark, d).where("kind = 'expense'").groupBy("user_id", "date").agg(X.half_up(F.sum("amount"), 2).alias("amount"), F.count("*").alias("n"))
)
_W = [f"date BETWEEN DATE '{AS_OF - dt.timedelta(30 * (w + 1) - 1)}' AND DATE '{AS_OF - dt.timedelta(30 * w)}'" for w in range(3)]
_H = (UNTIL - AS_OF).days + 1
FORECAST = f"""{ITEMS}, members AS (SELECT DISTINCT l.user_id, l.id FROM ledger l JOIN series s ON s.user_id = l.user_id AND s.direction = 'debit' AND l.direction = 'debit' AND s.series = lower(l.merchant) WHERE l.category NOT IN ('ATM/CASH', 'BANKING FEES', 'REFUNDS', 'OTHER')
), bal AS (SELECT user_id, CAST(sum(CASE WHEN direction = 'credit' THEN amount ELSE -amount END) AS DOUBLE) AS balance FROM ledger GROUP BY user_id
), hist AS (SELECT l.*, m.id IS NULL AS plain FROM ledger l LEFT JOIN members m ON m.user_id = l.user_id AND m.id = l.id WHERE date BETWEEN DATE '{AS_OF - dt.timedelta(89)}' AND DATE '{AS_OF}'
), sums AS (
  SELECT user_id, DATE '{AS_OF}' - min(date) + 1 AS span, CAST(coalesce(sum(amount) FILTER (direction = 'credit' AND category = 'SALARY/INCOME'), 0) AS DOUBLE) AS earned, CAST(coalesce(sum(amount) FILTER ({SPENT} AND plain), 0) AS DOUBLE) AS everyday,
    list_filter([{", ".join(f"CAST(coalesce(sum(amount) FILTER ({SPENT} AND plain AND {w}), 0) AS DOUBLE)" for w in _W)}], lambda x: x > 0) AS w, list_filter([{", ".join(f"CAST(coalesce(sum(amount) FILTER ({SPENT} AND {w}), 0) AS DOUBLE)" for w in _W)}], lambda x: x > 0) AS s FROM hist GROUP BY user_id
), due AS (SELECT user_id, CAST(coalesce(sum(CAST(amount AS DECIMAL(18,2))) FILTER (kind = 'income'), 0) AS DOUBLE) AS income_due, count(*) FILTER (kind = 'income') AS incomes, CAST(coalesce(sum(CAST(amount AS DECIMAL(18,2))) FILTER (kind = 'expense'), 0) AS DOUBLE) AS due FROM items GROUP BY user_id
), found AS (SELECT user_id, count(*) FILTER (NOT ended AND direction = 'credit') AS patterns, count(*) AS n_series FROM series GROUP BY user_id
), parts AS (
  SELECT user_id, balance, coalesce(least(90, span), 0) AS data_days, coalesce(n_series, 0) AS n_series, coalesce(due, 0) AS due, CASE WHEN coalesce(incomes, 0) > 0 OR coalesce(patterns, 0) > 0 THEN coalesce(income_due, 0) ELSE {R2.format(f"CASE WHEN span IS NULL THEN 0e0 ELSE earned / greatest(least(90, span), 30) END * {_H}")} END AS income,
    CASE WHEN span IS NULL THEN 0e0 ELSE everyday / greatest(least(90, span), 1) END AS daily, coalesce(w, []) AS w, coalesce(s, []) AS s FROM bal LEFT JOIN sums USING (user_id) LEFT JOIN due USING (user_id) LEFT JOIN found USING (user_id)
), forecasts AS (
  SELECT *, {R2.format("balance + net")} AS remaining, {R2.format("balance + income - due - high")} AS remaining_low, {R2.format("balance + income - due - low")} AS remaining_high, greatest({R2.format(f"{R2.format('balance + net')} - buffer")}, 0e0) AS safe FROM (
    SELECT *, {R2.format("income - due - everyday")} AS net, CASE WHEN len(w) >= 2 THEN list_min(w) / 30 * {_H} ELSE everyday * 0.8e0 END AS low, CASE WHEN len(w) >= 2 THEN list_max(w) / 30 * {_H} ELSE everyday * 1.2e0 END AS high, {R2.format("CASE WHEN len(s) > 0 THEN list_sum(s) / len(s) ELSE 0e0 END * 0.1e0")} AS buffer FROM (SELECT *, {R2.format(f"daily * {_H}")} AS everyday FROM parts)))"""


def forecast_of(spark: SparkSession, d: str) -> DataFrame:
    rows = standing(spark, d)
    held = rows.groupBy("user_id").agg(F.sum(F.when(X.credit(), F.col("amount")).otherwise(-F.col("amount"))).cast("double").alias("balance"))
    return planning.forecast(rows, series_of(spark, d), items_of(spark, d), held, AS_OF, UNTIL)


query(
    "pln_forecast",
    f"""SELECT user_id, balance, income, due AS recurring, everyday, {R2.format("low")} AS everyday_low, {R2.format("high")} AS everyday_high, {R2.format("daily")} AS daily, net, remaining, remaining_low, remaining_high, buffer, safe, CAST(data_days AS INTEGER) AS data_days,
      CASE WHEN data_days >= 75 AND n_series >= 3 THEN 'Higher' WHEN data_days >= 30 THEN 'Medium' ELSE 'Low' END AS confidence FROM forecasts""",
    FORECAST,
)(forecast_of)
_BUDGET_CTE = f"""budgets AS (SELECT user_id, category, 5000e0 AS budget, CAST(coalesce(sum(amount) FILTER (date >= DATE '2000-12-01'), 0) AS DOUBLE) AS actual FROM ledger WHERE {SPENT} GROUP BY ALL)"""


def _budgets(spark: SparkSession, d: str) -> DataFrame:
    rows = standing(spark, d)
    wanted = rows.where(X.spending()).select("user_id", "category").distinct().withColumns({"budget": F.lit(5000.0), "alert": F.lit(0.8)})
    return planning.budget_variance(rows, wanted, AS_OF)


query(
    "pln_safe_to_spend",
    f"""SELECT user_id, balance, recurring, budgets, buffer, raw, greatest(raw, 0e0) AS safe, greatest(-raw, 0e0) AS short, income AS income_not_counted FROM (SELECT *, {R2.format("balance - recurring - budgets - buffer")} AS raw FROM (
      SELECT f.user_id, balance, due AS recurring, buffer, income, coalesce(b.total, 0e0) AS budgets FROM forecasts f LEFT JOIN (
        SELECT user_id, CAST(sum(CAST(greatest({R2.format("greatest(budget - actual, 0e0) - coalesce(counted, 0e0)")}, 0e0) AS DECIMAL(18,2))) AS DOUBLE) AS total FROM budgets LEFT JOIN (SELECT user_id, category, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS counted FROM items WHERE kind = 'expense' GROUP BY ALL) USING (user_id, category) GROUP BY user_id) b USING (user_id)))""",
    f"{FORECAST}, {_BUDGET_CTE}",
)(lambda spark, d: planning.safe_to_spend(forecast_of(spark, d), items_of(spark, d), _budgets(spark, d)))
query(
    "prj_path",
    f"""SELECT user_id, date, {R2.format("c")} AS committed, {R2.format("c - daily * n")} AS likely, {R2.format("c - h * n")} AS likely_low, {R2.format("c - l * n")} AS likely_high FROM (
      SELECT f.user_id, DATE '{AS_OF}' + CAST(n AS INTEGER) AS date, n, {R2.format("daily")} AS daily, low / {_H} AS l, high / {_H} AS h, balance + coalesce(sum(x) OVER (PARTITION BY f.user_id ORDER BY n), 0e0) AS c FROM (SELECT *, unnest(range(1, 31)) AS n FROM forecasts) f
      LEFT JOIN (SELECT user_id, date, CAST(sum(CAST(CASE WHEN kind = 'income' THEN amount ELSE -amount END AS DECIMAL(18,2))) AS DOUBLE) AS x FROM items GROUP BY ALL) i ON i.user_id = f.user_id AND i.date = DATE '{AS_OF}' + CAST(n AS INTEGER))""",
    FORECAST,
)(
    lambda spark, d: planning.projection(
        forecast_of(spark, d).select("user_id", F.lit(AS_OF).alias("date"), "balance"), items_of(spark, d).select("user_id", "date", F.when(F.col("kind") == "income", F.col("amount")).otherwise(-F.col("amount")).alias("amount")),
        forecast_of(spark, d).select("user_id", F.col("daily").alias("mean"), (F.col("everyday_low") / _H).alias("low"), (F.col("everyday_high") / _H).alias("high")), 30,
    )
)
SQL["prj_path"] = SQL["prj_path"].replace(f"low / {_H} AS l, high / {_H} AS h", f"{R2.format('low')} / {_H} AS l, {R2.format('high')} / {_H} AS h")
query("pln_goals", "SELECT c_custkey AS user_id, c_mktsegment AS name, 1000e0 AS target_amount, CAST(c_acctbal AS DOUBLE) AS current_amount, least(100e0, floor(c_acctbal / 1000 * 100 * 10 + 0.5) / 10) AS progress FROM customer", "unused AS (SELECT 1)")(
    lambda spark, d: planning.goals(table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("name"), F.lit(1000.0).alias("target_amount"), F.col("c_acctbal").alias("current_amount")))
)
_BUDGET_DAYS = {"early": dt.date(2000, 6, 4), "late": dt.date(2000, 6, 18)}
for _name, _day in _BUDGET_DAYS.items():
    for _first, _start, _len, _months in ((1, dt.date(2000, 6, 1), 30, ("2000-05-01", "2000-04-01", "2000-03-01", "2000-06-01")), (25, dt.date(2000, 5, 25), 31, ("2000-04-25", "2000-03-25", "2000-02-25", "2000-05-25"))):
        _elapsed = (_day - _start).days + 1
        _bounds = [f"date >= DATE '{a}' AND date < DATE '{b}'" for a, b in ((_months[0], _months[3]), (_months[1], _months[0]), (_months[2], _months[1]))]
        _end = _start + dt.timedelta(_len - 1)
        query(
            f"pln_budget_{_name}_{_first}",
            f"""SELECT user_id, category, budget, actual, budget - actual AS remaining, floor(actual / budget * 100 * 10 + 0.5) / 10 AS used, projected, floor(projected / budget * 100 * 10 + 0.5) / 10 AS projected_share, average, CASE WHEN actual > budget THEN 'over' WHEN projected > budget THEN 'projected_over' WHEN actual >= budget * 0.8 THEN 'warning' ELSE 'ok' END AS status FROM (
              SELECT *, {R2.format(f"CASE WHEN average > 0 THEN greatest(actual, actual / {_elapsed} * {_len} * {min(1.0, _elapsed / 10)!r}e0 + average * (1 - {min(1.0, _elapsed / 10)!r}e0)) ELSE greatest(actual, actual / {_elapsed} * {_len}) END")} AS projected FROM (
                SELECT user_id, category, 60000e0 AS budget, CAST(coalesce(sum(amount) FILTER (date BETWEEN DATE '{_start}' AND DATE '{_end}'), 0) AS DOUBLE) AS actual, coalesce({R2.format("CAST(sum(x) AS DOUBLE) / sum(c)")}, 0e0) AS average FROM ledger LEFT JOIN (
                  SELECT user_id, category, sum(x) AS x, count(*) FILTER (x > 0) AS c FROM ({" UNION ALL ".join(f"SELECT user_id, category, sum(amount) AS x FROM ledger WHERE {SPENT} AND {b} GROUP BY ALL" for b in _bounds)}) GROUP BY ALL) p USING (user_id, category) WHERE {SPENT} GROUP BY ALL))""".replace("CAST(sum(x) AS DOUBLE) / sum(c)", "CAST(any_value(x) AS DOUBLE) / any_value(c)"),
        )(
            lambda spark, d, day=_day, first=_first: planning.budget_variance(rows := sources.from_lineitem(spark, d), rows.where(X.spending()).select("user_id", "category").distinct().withColumns({"budget": F.lit(60000.0), "alert": F.lit(0.8)}), day, first)
        )

# unusual activity over everyday payments with planted events
DAY = dt.date(2000, 7, 28)
Z = "({0} - {1}) / greatest({2} / 0.6745e0, {3}e0 * {1}, 1e0)"
SEVERITY = "CASE WHEN {0} >= 8 OR {1} >= 6 THEN 'high' WHEN {0} >= 5 OR {1} >= 3.5 THEN 'medium' ELSE 'low' END"
CONFIDENCE = "floor(least({2}, 0.3e0 + 0.4e0 * least(1e0, {0} / 30e0) + 0.25e0 * least(1e0, greatest(0e0, ({1} - 3.5e0) / 8e0))) * 100 + 0.5) / 100"
PEOPLE = f"""{linked_sql(sources.ACTIVITY_SQL)}, people AS (
  SELECT *, category NOT IN ('TRANSFERS', 'INVESTMENTS') AS spends, category NOT IN ('TRANSFERS', 'INVESTMENTS', 'RENT', 'BILLS', 'UTILITIES', 'EDUCATION', 'SUBSCRIPTIONS') AND NOT is_recurring AS everyday, date BETWEEN DATE '{DAY - dt.timedelta(89)}' AND DATE '{DAY}' AS recent FROM (
    SELECT user_id, id, date, merchant, category, is_recurring, CAST(amount AS DOUBLE) AS amount, CAST(greatest(amount - coalesce(refunded, 0), 0) AS DOUBLE) AS net, first, of_user FROM linked
    JOIN (SELECT user_id, min(date) AS first, count(*) FILTER (direction = 'debit' AND category <> 'INVESTMENTS' AND amount > coalesce(refunded, 0)) AS of_user FROM linked GROUP BY user_id) USING (user_id) WHERE direction = 'debit' AND category <> 'INVESTMENTS' AND amount > coalesce(refunded, 0)) WHERE of_user >= 8)"""
MAD = "list_aggregate(list_transform({0}, lambda x: abs(x - {1})), 'median')"
_OUT = "user_id, id, type, severity, date, observed, baseline, ratio, score, sample, confidence, merchant, category, txn_id"


def _rated(kind: str, source: str, observed: str, floor: str, sample: str, most: str, per: int, keep: str, key: str, date: str = "date", shift: tuple[str, str] = ("", "")) -> str:
    """A finding's columns from (median, mad, x): x the measure."""
    z = Z.format("x", "median", "mad", floor)
    return f"""SELECT user_id, '{kind}:' || {key} AS id, '{kind}' AS type, {SEVERITY.format(f"(z{shift[0]})", "ratio")} AS severity, {date} AS date, {observed} AS observed, {R2.format("median")} AS baseline, ratio, {R2.format("z")} AS score, CAST({sample} AS BIGINT) AS sample,
      {CONFIDENCE.format(f"({sample} * {per})", f"(z{shift[1]})", most)} AS confidence, merchant, category, txn_id FROM (SELECT *, {z} AS z, {R2.format("x / median")} AS ratio FROM ({source})) WHERE z >= 3.5 AND median > 0 AND {keep}"""


_PEERS = """SELECT *, list_aggregate(l, 'median') AS median, {mad} AS mad, len(l) AS n, net AS x, id AS txn_id FROM (SELECT t.user_id, t.id, any_value(t.date) AS date, any_value(t.net) AS net, any_value(t.merchant) AS merchant, any_value(t.category) AS category, list(p.net) AS l FROM people t JOIN people p ON p.user_id = t.user_id AND p.id <> t.id AND {how} WHERE t.recent AND t.net >= 1000 AND NOT t.is_recurring {only} GROUP BY t.user_id, t.id)"""
_OWN = _PEERS.format(mad=MAD.format("l", "list_aggregate(l, 'median')"), how="p.category = t.category AND NOT p.is_recurring", only="")
_LENT = _PEERS.format(mad=MAD.format("l", "list_aggregate(l, 'median')"), how="p.everyday", only="AND t.everyday AND (SELECT count(*) FROM people q WHERE q.user_id = t.user_id AND q.category = t.category AND NOT q.is_recurring) <= 6")
LARGE = f"""{_rated("large_transaction", _OWN, "net", "0.05", "n", "0.95e0", 1, "n >= 6 AND x >= 2 * median", "id")} UNION ALL {_rated("large_transaction", _LENT, "net", "0.05", "n", "0.7e0", 1, "n >= 10 AND x >= 2 * median", "id")}"""
FREQUENT = f"""SELECT user_id, 'frequent_transactions:' || lower(merchant) || ':' || date AS id, 'frequent_transactions' AS type, {SEVERITY.format("(z + 2)", "ratio")} AS severity, date, w AS observed, {R2.format("mean")} AS baseline, ratio, {R2.format("z")} AS score, weeks AS sample, {CONFIDENCE.format("(weeks * 2)", "(z + 1)", "0.85e0")} AS confidence, merchant, category, last AS txn_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, merchant ORDER BY w DESC, date) AS nth FROM (SELECT *, (w - mean) / sqrt(greatest(mean, 0.5e0)) AS z, {R2.format("w / greatest(mean, 0.5e0)")} AS ratio FROM (SELECT *, (so_far - w) / weeks AS mean FROM (SELECT *, CAST(floor((date - since - 6) / 7) AS BIGINT) AS weeks FROM (
    SELECT user_id, merchant, date, recent, last, CAST(sum(n) OVER (PARTITION BY user_id, merchant ORDER BY date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS DOUBLE) AS w, CAST(sum(n) OVER (PARTITION BY user_id, merchant ORDER BY date) AS DOUBLE) AS so_far, min(date) OVER (PARTITION BY user_id, merchant) AS since, first_value(category) OVER (PARTITION BY user_id, merchant ORDER BY date) AS category
    FROM (SELECT user_id, merchant, date, bool_or(recent) AS recent, max(id) AS last, count(*) AS n, arg_min(category, id) AS category FROM people WHERE NOT starts_with(merchant, 'Unidentified') GROUP BY ALL))) WHERE recent AND weeks >= 3)) WHERE w >= 4 AND w >= 3 * greatest(mean, 0.5e0) AND z >= 3) WHERE nth = 1"""


def _spikes(key: str | None, days: int, windows: int, base: int, ratio: float, least: float, kind: str, per: int, rows: str, keep: str) -> str:
    keys = f"user_id, {key}" if key else "user_id"
    at = f"CAST(floor((DATE '{DAY}' - date) / {days}) AS INTEGER)"
    sums = ", ".join(f"CAST(coalesce(sum(CAST(net AS DECIMAL(18,2))) FILTER (k = {k}), 0) AS DOUBLE)" for k in range(1, windows + 1))
    names = {"merchant": "any_value(merchant) AS merchant, arg_min(category, (date, id)) AS category", "category": "NULL::VARCHAR AS merchant, any_value(category) AS category", None: "NULL::VARCHAR AS merchant, NULL::VARCHAR AS category"}[key]
    inner = f"""SELECT *, list_aggregate(l, 'median') AS median, {MAD.format("l", "list_aggregate(l, 'median')")} AS mad FROM (SELECT user_id, {names}, CAST(coalesce(sum(CAST(net AS DECIMAL(18,2))) FILTER (k = 0), 0) AS DOUBLE) AS x, list_slice([{sums}], 1, least({windows}, CAST(floor((DATE '{DAY}' - min(first) + 1) / {days}) AS INTEGER) - 1)) AS l,
      arg_min(id, (-net, date, id)) FILTER (k = 0) AS txn_id FROM (SELECT *, {at} AS k FROM people WHERE date <= DATE '{DAY}' AND {rows}) GROUP BY {"user_id, " + key if key else "user_id"}) WHERE len(l) >= {base} AND {keep}"""
    del keys
    label = (f"lower({key}) || ':' || " if key else "") + f"'{DAY}'"
    return _rated(kind, inner, R2.format("x"), "0.25", "len(l)", "0.85e0", per, f"ratio >= {ratio} AND x - median >= {least}", label, f"DATE '{DAY}'")


_NOT_LUMPY = "category NOT IN ('RENT', 'BILLS', 'UTILITIES', 'EDUCATION', 'INVESTMENTS', 'SUBSCRIPTIONS')"
MERCHANT_SPIKE = _spikes("merchant", 30, 6, 3, 1.75, 1000, "merchant_spike", 5, "spends AND NOT is_recurring", f"NOT starts_with(merchant, 'Unidentified') AND {_NOT_LUMPY}")
CATEGORY_SPIKE = _spikes("category", 30, 6, 3, 1.75, 1000, "category_spike", 5, "spends AND NOT is_recurring", _NOT_LUMPY)
WEEK_SPIKE = _spikes(None, 7, 8, 4, 1.8, 2000, "spending_spike", 4, "everyday", "true")
_DAYS = f"""SELECT *, list_aggregate(l, 'median') AS median, {MAD.format("l", "list_aggregate(l, 'median')")} AS mad, len(l) AS n FROM (SELECT t.user_id, t.date, any_value(t.total) AS x, any_value(t.top) AS txn_id, any_value(t.largest) AS largest, list(o.total) AS l, NULL::VARCHAR AS merchant, NULL::VARCHAR AS category FROM day_totals t JOIN day_totals o ON o.user_id = t.user_id AND o.date <> t.date WHERE t.recent AND t.total >= 2000 GROUP BY t.user_id, t.date)"""
DAY_CTE = "day_totals AS (SELECT user_id, date, CAST(sum(CAST(net AS DECIMAL(18,2))) AS DOUBLE) AS total, arg_min(id, (-net, id)) AS top, max(net) AS largest, bool_or(recent) AS recent FROM people WHERE everyday GROUP BY ALL)"
UNUSUAL_DAY = f"""SELECT * FROM ({_rated("unusual_day", _DAYS, R2.format("x"), "0.25", "n", "0.9e0", 1, "n >= 9 AND x >= 2.5 * median", "CAST(date AS VARCHAR)")}) d WHERE NOT EXISTS (SELECT 1 FROM ({LARGE}) b JOIN day_totals t ON t.user_id = b.user_id AND t.top = b.txn_id WHERE b.user_id = d.user_id AND t.date = d.date AND t.largest >= 0.7 * t.total)"""
DUPLICATE = """SELECT g.user_id, 'possible_duplicate:' || date || '|' || key || '|' || CAST(amount AS DECIMAL(18,2)) AS id, 'possible_duplicate' AS type, CASE WHEN amount >= 5000 THEN 'medium' ELSE 'low' END AS severity, date, CAST(n AS DOUBLE) AS observed, 1e0 AS baseline, CAST(n AS DOUBLE) AS ratio, NULL::DOUBLE AS score, s.all_rows AS sample,
  CASE WHEN amount >= 1000 THEN 0.6e0 ELSE 0.45e0 END AS confidence, merchant, category, txn_id FROM (SELECT user_id, date, lower(merchant) AS key, amount, count(*) AS n, min(id) AS txn_id, arg_min(merchant, id) AS merchant, arg_min(category, id) AS category FROM people WHERE recent AND net >= 100 AND NOT starts_with(merchant, 'Unidentified') GROUP BY user_id, date, lower(merchant), amount HAVING count(*) >= 2) g
  JOIN (SELECT user_id, count(*) AS all_rows FROM people GROUP BY user_id) s ON s.user_id = g.user_id"""


def people_of(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.population(refunds.given_back(sources.activity(spark, d)), DAY)


def _finding(name: str, sql: str, f: object) -> None:
    query(name, f"SELECT {_OUT} FROM ({sql})", f"{PEOPLE}, {DAY_CTE}")(lambda spark, d: f(people_of(spark, d)))


_finding("anm_large", LARGE, anomalies.large_transactions)
_finding("anm_frequent_payments", FREQUENT, anomalies.frequent_payments)
_finding("anm_merchant_spike", MERCHANT_SPIKE, lambda p: anomalies.merchant_spikes(p, DAY))
_finding("anm_category_spike", CATEGORY_SPIKE, lambda p: anomalies.category_spikes(p, DAY))
_finding("anm_weekly_spike", WEEK_SPIKE, lambda p: anomalies.weekly_spikes(p, DAY))
_finding("anm_unusual_day", UNUSUAL_DAY, lambda p: anomalies.unusual_days(p, anomalies.large_transactions(p)))
_finding("anm_possible_duplicates", DUPLICATE, anomalies.possible_duplicates)
ALL_FINDINGS = " UNION ALL ".join(f"SELECT {_OUT} FROM ({x})" for x in (LARGE, FREQUENT, MERCHANT_SPIKE, CATEGORY_SPIKE, WEEK_SPIKE, UNUSUAL_DAY, DUPLICATE))
query(
    "anm_unusual_activity", f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, date DESC, observed DESC, id) AS place FROM ({ALL_FINDINGS})", f"{PEOPLE}, {DAY_CTE}"
)(lambda spark, d: anomalies.unusual_activity(refunds.given_back(sources.activity(spark, d)), DAY))
query("jn_badges", f"SELECT user_id, txn_id, arg_max(severity, CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS severity FROM ({ALL_FINDINGS}) WHERE txn_id IS NOT NULL GROUP BY ALL", f"{PEOPLE}, {DAY_CTE}")(
    lambda spark, d: anomalies.badges(anomalies.unusual_activity(refunds.given_back(sources.activity(spark, d)), DAY))
)
query(
    "anm_outliers",
    f"""SELECT r.user_id, r.id, r.category, r.x AS amount FROM (SELECT user_id, id, category, CAST(amount AS DOUBLE) AS x FROM ledger WHERE {SPENT}) r
      JOIN (SELECT user_id, count(*) AS c, quantile_cont(CAST(amount AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(amount AS DOUBLE), 0.75) AS q3 FROM ledger WHERE {SPENT} GROUP BY user_id) u USING (user_id)
      JOIN (SELECT user_id, category, n, m, median(abs(x - m)) AS mad FROM (SELECT user_id, category, CAST(amount AS DOUBLE) AS x, median(CAST(amount AS DOUBLE)) OVER (PARTITION BY user_id, category) AS m, count(*) OVER (PARTITION BY user_id, category) AS n FROM ledger WHERE {SPENT}) GROUP BY ALL) g USING (user_id, category)
      WHERE c >= 8 AND x >= 1500 AND CASE WHEN n >= 6 AND mad > 0 THEN 0.6745 * (x - m) / mad > 3.5 AND x >= 2 * m WHEN n >= 6 AND mad = 0 AND x >= 3 * m AND m > 0 THEN true ELSE x > q3 + 3 * (q3 - q1) END""",
    sources.ACTIVITY_SQL,
)(lambda spark, d: anomalies.outliers(sources.activity(spark, d)))


