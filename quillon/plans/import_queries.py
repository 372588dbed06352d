"""Queries over statements and narrations: reading, classification, reconciliation, insights; each with its SQL oracle."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import expressions as X
from quillon.functions import narration as N
from quillon.operators import classify, compare, insights, refunds, statements
from quillon.plans import activity_queries as A
from quillon.plans.ledger_queries import NETTED_SQL, query
from quillon.session import table
from quillon.sources import ledger as sources

#: Narrations and, worked out by hand, what is to be read from them: direction, text, type, method, provider, reference, merchant, category, subcategory, confidence, method of classification.
NARRATIONS = [
    ("debit", "UPI-CITY CAFE-cafe.1@okaxis-HDFC0MERUPI-123456789012-LUNCH", "UPI", "UPI", "Google Pay", "123456789012", "City Cafe", "FOOD", "Cafes", 0.9, "merchant"),
    ("credit", "UPI-CITY CAFE-cafe.1@okaxis-HDFC0MERUPI-123456789012-LUNCH", "UPI", "UPI", "Google Pay", "123456789012", "City Cafe", "REFUNDS", "Refund", 0.85, "merchant"),
    ("debit", "UPI-ASHA RAO-asha@ybl-SBIN0001234-123456789012-dinner", "UPI", "UPI", "PhonePe", "123456789012", "Asha Rao", "TRANSFERS", "Person Transfer", 0.62, "rule"),
    ("debit", "UPI-RAZORPAY-pay.rzp@hdfcbank-HDFC0MERUPI-123456789012-PAY", "UPI", "UPI", "Razorpay", "123456789012", "Unidentified merchant (Razorpay)", "NEEDS_REVIEW", "Unresolved", 0.3, "rule"),
    ("debit", "ATW-416021XXXXXX1234-S1ANPN12-PUNE", "ATM", "ATM", None, None, "ATM Cash", "ATM/CASH", "Cash Withdrawal", 0.97, "rule"),
    ("credit", "NEFT CR-ICIC0000001-ACME INDUSTRIES 77-ONE-N12345", "NEFT", "NEFT", None, None, "Acme Industries 77", "SALARY/INCOME", None, None, "rule"),
    ("debit", "POS 416021XXXXXX1234 GREEN GROCER", "POS", "Debit Card", None, None, "Green Grocer", "GROCERIES", "Supermarket", 0.9, "merchant"),
    ("debit", "SMS ALERT CHGS OCT-DEC 25", "FEE", None, None, None, "Bank", "BANKING FEES", "Bank Charges", 0.95, "rule"),
    ("credit", "CREDIT INTEREST CAPITALISED", "INTEREST", None, None, None, "Bank Interest", "SALARY/INCOME", "Interest", 0.95, "rule"),
    ("debit", "EMI 12345 CHQ S0001", "EMI", "Auto-debit", None, None, "EMI Chq", "BILLS", "Loan EMI", 0.9, "rule"),
    ("credit", "NEFT CR-HDFC0000002-OMEGA TECH LTD-SALARY OCT-1", "NEFT", "NEFT", None, None, "Omega Tech LTD", "SALARY/INCOME", "Salary", 0.95, "rule"),
    ("debit", "UPI-ZED9-zed9@paytm-PYTM0123456-123456789012-course fee", "UPI", "UPI", "Paytm", "123456789012", "Zed9", "EDUCATION", "Courses", 0.7, "keyword"),
]


def statement_rows(spark: SparkSession, d: str) -> DataFrame:
    """Line items as parsed rows of bank statements, with one of the narrations each."""
    texts = F.broadcast(spark.createDataFrame([(k, n[0], n[1]) for k, n in enumerate(NARRATIONS)], "k int, side string, narration string"))
    money = F.col("l_extendedprice").cast("decimal(18,2)")
    rows = table(spark, d, "lineitem").join(texts, (F.col("l_orderkey") + F.col("l_linenumber")) % len(NARRATIONS) == F.col("k"))
    return rows.select(
        F.col("l_suppkey").alias("user_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", money.cast("string")).alias("id"), F.to_date("l_shipdate").alias("date"), F.lit(None).cast("date").alias("value_date"), "narration", F.lit(None).cast("string").alias("reference"),
        F.when(F.col("side") == "debit", money).alias("debit"), F.when(F.col("side") == "credit", money).alias("credit"), F.lit(None).cast("decimal(18,2)").alias("balance"),
    )


def _quoted(value: object) -> str:
    return "NULL" if value is None else repr(value) + ("e0" if isinstance(value, float) else "")


_TABLE = ", ".join(f"({k}, {', '.join(map(_quoted, n))})" for k, n in enumerate(NARRATIONS))
_ROWS = f"""read AS (
  SELECT l_suppkey AS user_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || CAST(l_extendedprice AS DECIMAL(18,2)) AS id, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, n.*
  FROM lineitem JOIN (VALUES {_TABLE}) n(k, direction, narration, type, payment_method, provider, reference, merchant, category, subcategory, confidence, method) ON (l_orderkey + l_linenumber) % {len(NARRATIONS)} = n.k)"""
query(
    "cls_narrations",
    """SELECT id, direction, type, payment_method, provider, reference, merchant, category, CASE WHEN k <> 5 THEN subcategory WHEN amount >= 15000 THEN 'Salary' ELSE 'Other Income' END AS subcategory, CASE WHEN k <> 5 THEN confidence WHEN amount >= 15000 THEN 0.62e0 ELSE 0.5e0 END AS confidence, method FROM read""",
    _ROWS,
)(
    lambda spark, d: classify.classify(classify.canonical_merchant(classify.normalise(statement_rows(spark, d))))
    .withColumn("provider", F.col("upi.provider"))
    .select("id", "direction", "type", "payment_method", "provider", "reference", "merchant", "category", "subcategory", "confidence", "method")
)
query(
    "cls_history",
    "SELECT user_id, substr(regexp_replace(upper(merchant), '[^A-Z0-9]+', '', 'g'), 1, 40) AS key, category, coalesce(subcategory, CASE WHEN amount >= 15000 THEN 'Salary' ELSE 'Other Income' END) AS subcategory, count(*) AS n FROM read GROUP BY ALL",
    _ROWS,
)(lambda spark, d: classify.learned(classify.classify(classify.canonical_merchant(classify.normalise(statement_rows(spark, d))))).drop("confidence"))


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    rows = classify.classify(classify.canonical_merchant(classify.normalise(statement_rows(spark, d))))
    counts = rows.where("direction = 'debit'").groupBy("user_id", X.merchant_key(F.col("merchant")).alias("key")).agg(F.count("*").alias("n"))
    return classify.flags(rows, counts).select("id", "is_refund", "recurring_candidate", "recurring_confidence", "needs_review")


query(
    "rec_import_flags",
    """SELECT id, category = 'REFUNDS' AS is_refund, direction = 'debit' AND c >= 2 AS recurring_candidate, CASE WHEN direction = 'debit' AND c >= 2 THEN 0.5e0 ELSE 0e0 END AS recurring_confidence, category = 'NEEDS_REVIEW' OR coalesce(confidence, CASE WHEN amount >= 15000 THEN 0.62 ELSE 0.5 END) < 0.6 OR k = 3 AS needs_review
      FROM read LEFT JOIN (SELECT user_id, merchant, count(*) AS c FROM read WHERE direction = 'debit' GROUP BY ALL) USING (user_id, merchant)""",
    _ROWS,
)(_flagged)
query("fn_labels", "SELECT DISTINCT category, array_to_string(list_transform(string_split(lower(replace(category, '_', ' ')), '/'), lambda p: array_to_string(list_transform(string_split(p, ' '), lambda w: upper(w[1]) || w[2:]), ' ')), '/') AS label FROM read", _ROWS)(
    lambda spark, d: classify.classify(classify.canonical_merchant(classify.normalise(statement_rows(spark, d)))).select("category", N.category_label(F.col("category")).alias("label")).distinct()
)


# statements with printed summaries, some of them wrong
def bank_rows(spark: SparkSession, d: str) -> DataFrame:
    """Line items as rows of a supplier's yearly statements with running balances; some balances are missing or off."""
    from pyspark.sql import Window

    money = F.col("l_extendedprice").cast("decimal(18,2)")
    day = F.to_date("l_shipdate")
    place = Window.partitionBy("statement_id").orderBy("date", "l_orderkey", "l_linenumber", "l_partkey", "amount")
    rows = table(spark, d, "lineitem").select(F.concat_ws("-", "l_suppkey", F.year(day).cast("string")).alias("statement_id"), day.alias("date"), "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", money.alias("amount"), "l_suppkey")
    back = F.col("l_returnflag") == "R"
    zero = F.lit(0).cast("decimal(18,2)")
    rows = rows.withColumns({"row_index": F.row_number().over(place), "debit": F.when(back, zero).otherwise(F.col("amount")), "credit": F.when(back, F.col("amount")).otherwise(zero)})
    running = F.sum(F.col("credit") - F.col("debit")).over(place.rowsBetween(Window.unboundedPreceding, 0)).cast("decimal(18,2)")
    return rows.withColumn("balance", F.when(F.col("row_index") % 5 > 0, running)).select("statement_id", "row_index", "date", "debit", "credit", "balance", "l_suppkey", F.array().cast("array<string>").alias("warnings"))


BANK_ROWS = """bank AS (
  SELECT statement_id, row_index, date, debit, credit, CASE WHEN row_index % 5 > 0 THEN CAST(sum(credit - debit) OVER (PARTITION BY statement_id ORDER BY row_index) AS DECIMAL(18,2)) END AS balance, l_suppkey FROM (
    SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY date, l_orderkey, l_linenumber, l_partkey, amount) AS row_index FROM (SELECT l_suppkey || '-' || year(l_shipdate) AS statement_id, CAST(l_shipdate AS DATE) AS date, l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
      CASE WHEN l_returnflag = 'R' THEN 0::DECIMAL(18,2) ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS debit, CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0::DECIMAL(18,2) END AS credit FROM lineitem)))"""


def swapped(rows: DataFrame) -> DataFrame:
    """The same rows as a reader might misread them: every seventh row's sides swapped, every eleventh without an amount."""
    k, zero = F.col("row_index"), F.lit(0).cast("decimal(18,2)")
    return rows.withColumns({"debit": F.when(k % 11 == 0, zero).when(k % 7 == 0, F.col("credit")).otherwise(F.col("debit")), "credit": F.when(k % 11 == 0, zero).when(k % 7 == 0, F.col("debit")).otherwise(F.col("credit"))})


query(
    "src_repaired_rows",
    """SELECT statement_id, row_index, CAST(CASE WHEN side THEN CASE WHEN delta > 0 THEN 0 ELSE a END WHEN gap THEN greatest(-delta, 0) ELSE d END AS DOUBLE) AS debit, CAST(CASE WHEN side THEN CASE WHEN delta > 0 THEN a ELSE 0 END WHEN gap THEN greatest(delta, 0) ELSE c END AS DOUBLE) AS credit, CASE WHEN side THEN 'side' WHEN gap THEN 'inferred' ELSE '' END AS repair FROM (
      SELECT *, coalesce(abs(delta - (c - d)) > 0.011 AND a > 0 AND abs(abs(delta) - a) < 0.011, false) AS side, coalesce(abs(delta - (c - d)) > 0.011 AND a = 0 AND delta <> 0, false) AS gap FROM (
        SELECT *, CASE WHEN d > 0 THEN d ELSE c END AS a, balance - coalesce(last_value(balance IGNORE NULLS) OVER (PARTITION BY statement_id ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS delta FROM (
          SELECT statement_id, row_index, balance, CASE WHEN row_index % 11 = 0 THEN 0 WHEN row_index % 7 = 0 THEN credit ELSE debit END AS d, CASE WHEN row_index % 11 = 0 THEN 0 WHEN row_index % 7 = 0 THEN debit ELSE credit END AS c FROM bank)))""",
    BANK_ROWS,
)(
    lambda spark, d: statements.repaired(swapped(bank_rows(spark, d)), bank_rows(spark, d).select("statement_id", F.lit(0).cast("decimal(18,2)").alias("opening")).distinct()).select(
        "statement_id", "row_index", F.col("debit").cast("double").alias("debit"), F.col("credit").cast("double").alias("credit"), F.when(F.size("warnings") == 0, "").when(F.get("warnings", F.lit(0)).contains("side"), "side").otherwise("inferred").alias("repair")
    )
)


def _printed(rows: DataFrame) -> DataFrame:
    """The true summary of each statement but those of every fifth supplier, wrong in one number for three kinds of others."""
    key = F.col("l_suppkey") % 5
    sums = rows.groupBy("statement_id", "l_suppkey").agg(F.count_if(F.col("debit") > 0).alias("debit_count"), F.count_if(F.col("credit") > 0).alias("credit_count"), F.sum("debit").alias("total_debits"), F.sum("credit").alias("total_credits"))
    one = F.lit("1.00").cast("decimal(18,2)")
    return sums.where(key > 0).select(
        "statement_id", F.lit(0).cast("decimal(18,2)").alias("opening_balance"), (F.col("debit_count") + F.when(key == 1, 1).otherwise(0)).alias("debit_count"), "credit_count", (F.col("total_debits") + F.when(key == 2, one).otherwise(F.lit(0))).alias("total_debits"), "total_credits",
        (F.col("total_credits") - F.col("total_debits") + F.when(key == 3, one).otherwise(F.lit(0))).alias("closing_balance"),
    )


query(
    "rcn_statements",
    """SELECT statement_id, CASE WHEN p THEN m <> 1 END AS debit_count, CASE WHEN p THEN true END AS credit_count, CASE WHEN p THEN m <> 2 END AS total_debits, CASE WHEN p THEN true END AS total_credits, CASE WHEN p THEN m NOT IN (2, 3) END AS printed_identity, CASE WHEN p THEN m <> 3 END AS closing_from_rows,
      CASE WHEN p THEN abs(c - d + CASE WHEN m = 3 THEN 1 ELSE 0 END - last_balance) <= 0.011 END AS last_row, CASE WHEN known > 0 THEN breaks = 0 END AS chain, breaks, 0::BIGINT AS corrections,
      CASE WHEN breaks > 0 OR (p AND (m IN (1, 2, 3) OR abs(c - d - last_balance) > 0.011)) THEN 'mismatch' WHEN p THEN 'reconciled' ELSE 'no_summary' END AS status FROM (
      SELECT statement_id, l_suppkey % 5 AS m, l_suppkey % 5 > 0 AS p, sum(credit) AS c, sum(debit) AS d, arg_max(balance, row_index) FILTER (balance IS NOT NULL) AS last_balance, count(balance) AS known,
        count(*) FILTER (balance IS NOT NULL AND abs(coalesce(prior, CASE WHEN l_suppkey % 5 > 0 THEN 0 ELSE balance - credit + debit END) + credit - debit - balance) > 0.011) AS breaks FROM (SELECT *, last_value(balance IGNORE NULLS) OVER (PARTITION BY statement_id ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM bank) GROUP BY statement_id, l_suppkey)""",
    BANK_ROWS,
)(lambda spark, d: statements.reconcile(rows := bank_rows(spark, d), _printed(rows)))
query("src_raw_rows", "SELECT statement_id, row_index, date, CAST(debit AS DOUBLE) AS debit, CAST(credit AS DOUBLE) AS credit, CAST(balance AS DOUBLE) AS balance, CASE WHEN row_index % 3 = 0 THEN 1 ELSE 0 END AS warned FROM bank", BANK_ROWS)(
    lambda spark, d: statements.typed(
        bank_rows(spark, d).select(
            "statement_id", "row_index", F.date_format("date", "dd/MM/yy").alias("date"), F.when(F.col("row_index") % 3 == 0, "31/02/26").otherwise(F.date_format("date", "d MMM yyyy")).alias("value_date"), F.lit("x").alias("narration"), F.lit(" 00 12 ").alias("reference"),
            F.when(F.col("debit") > 0, F.concat(F.lit("Rs. "), F.format_number("debit", 2))).alias("withdrawal"), F.when(F.col("credit") > 0, F.format_number("credit", 2)).alias("deposit"), F.concat(F.format_number(F.abs("balance"), 2), F.when(F.col("balance") < 0, " Dr").otherwise(" Cr")).alias("balance"),
        )
    ).select("statement_id", "row_index", "date", F.col("debit").cast("double").alias("debit"), F.col("credit").cast("double").alias("credit"), F.col("balance").cast("double").alias("balance"), F.size("warnings").alias("warned"))
)

# insights
NOW, THEN = compare.comparable("month", dt.date(2000, 6, 18))
_CHANGE = f"""SELECT user_id, {{key}}, a, b, n_now, n_then, pct, CASE WHEN b = 0 THEN 'new' WHEN a = 0 THEN 'stopped' WHEN a > b THEN 'increase' ELSE 'decrease' END AS kind FROM (SELECT *, CASE WHEN b > 0 THEN floor(CAST(a - b AS DOUBLE) / CAST(b AS DOUBLE) * 100 * 10 + 0.5) / 10 END AS pct FROM (
  SELECT user_id, {{key}}, coalesce(sum(net) FILTER (date BETWEEN DATE '{NOW.first}' AND DATE '{NOW.last}'), 0) AS a, coalesce(sum(net) FILTER (date BETWEEN DATE '{THEN.first}' AND DATE '{THEN.last}'), 0) AS b, count(*) FILTER (date BETWEEN DATE '{NOW.first}' AND DATE '{NOW.last}') AS n_now, count(*) FILTER (date BETWEEN DATE '{THEN.first}' AND DATE '{THEN.last}') AS n_then
  FROM netted WHERE date BETWEEN DATE '{NOW.first}' AND DATE '{NOW.last}' OR date BETWEEN DATE '{THEN.first}' AND DATE '{THEN.last}' GROUP BY ALL)) WHERE a <> b AND abs(a - b) >= 500 AND coalesce(abs(pct), 100) >= 25 AND greatest(n_now, n_then) >= 3"""
for _key in ("category", "merchant"):
    query(
        f"ins_{_key}_changes",
        f"""SELECT user_id, kind2 || ':' || {_key if _key == "category" else "lower(merchant)"} || ':{NOW.first}' AS id, severity, CAST(a AS DOUBLE) AS value, CAST(b AS DOUBLE) AS previous FROM (
          SELECT *, CASE WHEN up THEN '{_key}_spike' ELSE '{_key}_drop' END AS kind2, CASE WHEN NOT up THEN 'positive' WHEN {"coalesce(pct >= 75, false)" if _key == "category" else "false"} THEN 'attention' ELSE 'watch' END AS severity, row_number() OVER (PARTITION BY user_id, up ORDER BY abs(a - b) DESC, {_key}) AS place FROM (SELECT *, kind IN ('increase', 'new') AS up FROM ({_CHANGE.format(key=_key)})))
          WHERE (up AND place <= 3) OR (NOT up AND place <= {2 if _key == "category" else 0})""",
        NETTED_SQL,
    )(lambda spark, d, key=_key: insights.group_changes(refunds.net_rows(refunds.linked(sources.from_lineitem(spark, d))), key, NOW, THEN).select("user_id", "id", "severity", "value", "previous"))
query("ins_stale", "SELECT user_id, 'stale_data:' || max(date) AS id, CASE WHEN DATE '2001-12-20' - max(date) > 40 THEN 'attention' ELSE 'info' END AS severity, CAST(DATE '2001-12-20' - max(date) AS DOUBLE) AS value FROM ledger GROUP BY user_id HAVING DATE '2001-12-20' - max(date) > 10", sources.LEDGER_SQL)(
    lambda spark, d: insights.stale(sources.from_lineitem(spark, d), dt.date(2001, 12, 20)).select("user_id", "id", "severity", "value")
)
query("ins_recurring", "SELECT user_id, 'recurring_detected:' || count(*) || ':' || CAST(floor(sum(monthly) * 100 + 0.5) / 100 AS DECIMAL(18,2)) AS id, floor(sum(monthly) * 100 + 0.5) / 100 AS value FROM series WHERE direction = 'debit' AND NOT ended AND confidence >= 0.55 GROUP BY user_id", A.SERIES)(
    lambda spark, d: insights.recurring_found(A.series_of(spark, d)).select("user_id", "id", "value")
)
query(
    "ins_due_soon",
    f"SELECT user_id, 'upcoming_recurring:{A.AS_OF}:' || count(*) AS id, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS value FROM items WHERE kind = 'expense' AND date BETWEEN DATE '{A.AS_OF}' AND DATE '{A.AS_OF + dt.timedelta(7)}' GROUP BY user_id",
    A.ITEMS,
)(lambda spark, d: insights.due_soon(A.items_of(spark, d), A.AS_OF).select("user_id", "id", "value"))
query(
    "ins_cash_flow",
    f"""SELECT user_id, CASE WHEN least > 0 THEN 'positive_cashflow:' ELSE 'negative_cashflow:' END || period AS id, CAST(flow AS DOUBLE) AS value FROM (SELECT user_id, count(*) AS n, min(flow) AS least, arg_min(flow, k) AS flow, arg_min(period, k) AS period FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY period DESC) AS k FROM (SELECT user_id, strftime(date, '%Y-%m') AS period, count(*) AS n, min(date) AS first_date, sum(CASE WHEN direction = 'credit' THEN amount ELSE -amount END) AS flow FROM ledger GROUP BY ALL) JOIN (SELECT user_id, max(date) AS last FROM ledger GROUP BY user_id) USING (user_id)
      WHERE n >= 5 AND first_date < DATE '2000-06-01' AND last_day(first_date) <= last) WHERE k <= 3 GROUP BY user_id) WHERE n >= 2 AND (least > 0 OR flow < 0)""",
    sources.LEDGER_SQL,
)(lambda spark, d: insights.cash_flow(refunds.linked(sources.from_lineitem(spark, d)), dt.date(2000, 6, 18)).select("user_id", "id", "value"))


def _all_insights(spark: SparkSession, d: str) -> DataFrame:
    from quillon.operators import anomalies, planning

    rows = A.standing(spark, d)
    linked = refunds.linked(rows)
    items, forecast, budgets = A.items_of(spark, d), A.forecast_of(spark, d), A._budgets(spark, d)
    return insights.insights(linked, refunds.net_rows(linked), anomalies.unusual_activity(linked, A.AS_OF), A.series_of(spark, d), items, planning.safe_to_spend(forecast, items, budgets), budgets, A.AS_OF)


query("ins_all", None)(_all_insights)
