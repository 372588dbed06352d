"""Deterministic insights: one frame a rule, united, with one text each.

Every rule yields (user_id, id, kind, severity, value, previous, date, text);
the first of equal ids stays. Rules are joins and aggregates over all users.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.expressions import debit, half_up, spending
from quillon.operators import compare
from quillon.operators.aggregates import spend_series

# Order of severities, and how a finding's severity reads as an insight.
SEVERITIES = {"attention": 3, "watch": 2, "positive": 1, "info": 0}
OF_FINDING = {"high": "attention", "medium": "watch", "low": "info"}
LEAST_ROWS = 3


def _told(frame: DataFrame, kind: str | Column, key: Column, severity: str | Column, value: Column, date: Column, text: Column, previous: Column | None = None) -> DataFrame:
    lift = lambda x: x if isinstance(x, Column) else F.lit(x)
    before = F.lit(None).cast("double") if previous is None else half_up(previous.cast("double"), 2)
    return frame.select("user_id", F.concat_ws(":", lift(kind), key).alias("id"), lift(kind).alias("kind"), lift(severity).alias("severity"), half_up(value.cast("double"), 2).alias("value"), before.alias("previous"), date.alias("date"), text.alias("text"))


def stale(ledger: DataFrame, as_of: dt.date, days: int = 10, very: int = 40) -> DataFrame:
    """Users whose newest row is more than ``days`` days old."""
    last = ledger.groupBy("user_id").agg(F.max("date").alias("last")).withColumn("age", F.datediff(F.lit(as_of), "last")).where(F.col("age") > days)
    return _told(last, "stale_data", F.col("last").cast("string"), F.when(F.col("age") > very, "attention").otherwise("info"), F.col("age"), F.lit(as_of), F.format_string("No entries for %d days", F.col("age")))


def spending_change(linked: DataFrame, now: compare.Period, then: compare.Period, unit: str, least: float = 500.0, percent: float = 25.0) -> DataFrame:
    """Net spending up or down by both thresholds, where the history covers the whole earlier period."""
    sums = compare.period_totals(linked, now).select("user_id", F.col("net").alias("a")).join(compare.period_totals(linked, then).select("user_id", F.col("net").alias("b"), F.col("n_spending").alias("rows")), "user_id")
    covered = linked.groupBy("user_id").agg(F.min("date").alias("first")).where(F.col("first") <= F.lit(then.first))
    changed = sums.join(covered, "user_id", "left_semi").where((F.col("rows") >= LEAST_ROWS) & (F.col("b") > 0)).withColumn("d", half_up(F.col("a") - F.col("b"), 2)).withColumn("p", half_up(F.col("d") / F.col("b") * 100, 1))
    kept = changed.where((F.abs("d") >= least) & (F.abs("p") >= percent))
    kind = F.when(F.col("d") > 0, "spending_up").otherwise("spending_down")
    return _told(kept, kind, F.lit(f"{unit}:{now.first}"), F.when(F.col("d") > 0, "watch").otherwise("positive"), F.col("a"), F.lit(now.last), F.concat(F.lit("Spending changed by "), F.col("p").cast("string"), F.lit(" %")), F.col("b"))


def group_changes(netted: DataFrame, key: str, now: compare.Period, then: compare.Period, up: int = 3, down: int = 2, percent: float = 25.0) -> DataFrame:
    """The largest significant changes by category, or rises by merchant, of each user."""
    moved = compare.changes(netted, key, now, then).where("significant").withColumn("rise", F.col("kind").isin("increase", "new"))
    place = F.row_number().over(Window.partitionBy("user_id", "rise").orderBy(F.desc(F.abs("delta")), key))
    kept = moved.withColumn("place", place).where((F.col("rise") & (F.col("place") <= up)) | (~F.col("rise") & (F.col("place") <= (down if key == "category" else 0))))
    kind = F.when(F.col("rise"), f"{key}_spike").otherwise(f"{key}_drop")
    strong = F.coalesce(F.col("percent") >= 3 * percent, F.lit(False)) & F.lit(key == "category")
    severity = F.when(~F.col("rise"), "positive").when(strong, "attention").otherwise("watch")
    return _told(kept, kind, F.concat_ws(":", F.col(key) if key == "category" else F.lower(key), F.lit(str(now.first))), severity, F.col("now"), F.lit(now.last), F.concat(F.col(key), F.lit(": "), F.col("kind")), F.col("then"))


def unusual(findings: DataFrame, most: int = 8) -> DataFrame:
    """The first findings of anomalies.unusual_activity() of each user."""
    kept = findings.where(F.col("place") <= most)
    large = F.col("type") == "large_transaction"
    severity = F.coalesce(*[F.when(F.col("severity") == a, b) for a, b in OF_FINDING.items()])
    return _told(kept, F.when(large, "large_transaction").otherwise("unusual_activity"), F.col("id"), severity, F.col("observed"), F.col("date"), F.concat(F.col("type"), F.lit(" of "), F.col("observed").cast("string")), F.col("baseline"))


def recurring_found(series: DataFrame, sure: float = 0.55) -> DataFrame:
    """How many recurring payments a user has and what they come to a month."""
    kept = series.where((F.col("direction") == "debit") & ~F.col("ended") & (F.col("confidence") >= sure)).groupBy("user_id").agg(F.count("*").alias("n"), half_up(F.sum("monthly"), 2).alias("monthly"), F.max("last_date").alias("last"))
    return _told(kept, "recurring_detected", F.concat_ws(":", F.col("n").cast("string"), F.col("monthly").cast("decimal(18,2)").cast("string")), "info", F.col("monthly"), F.col("last"), F.format_string("%d recurring payments", F.col("n")))


def due_soon(items: DataFrame, as_of: dt.date, days: int = 7) -> DataFrame:
    """Payments of planning.upcoming() within ``days`` days."""
    near = items.where((F.col("kind") == "expense") & F.col("date").between(F.lit(as_of), F.lit(as_of + dt.timedelta(days)))).groupBy("user_id").agg(F.sum(F.col("amount").cast("decimal(18,2)")).alias("x"), F.count("*").alias("n"))
    return _told(near, "upcoming_recurring", F.concat_ws(":", F.lit(str(as_of)), F.col("n").cast("string")), "info", F.col("x"), F.lit(as_of), F.format_string("%d payments are due soon", F.col("n")))


def room(safe: DataFrame, as_of: dt.date) -> DataFrame:
    """Half of the balance or more is safe to spend, or it falls short of what is due. safe: planning.safe_to_spend()."""
    share = half_up(F.col("safe") / F.col("balance") * 100, 1)
    known = safe.where("balance > 0")
    plenty = _told(known.where((F.col("safe") > 0) & (share >= 50)), "high_discretionary", F.lit(str(as_of)), "positive", F.col("safe"), F.lit(as_of), F.concat(share.cast("string"), F.lit(" % of the balance is free")))
    short = _told(known.where("short > 0"), "high_discretionary", F.lit(f"short:{as_of}"), "attention", F.col("short"), F.lit(as_of), F.lit("Commitments exceed the balance"))
    return plenty.unionByName(short)


def cash_flow(linked: DataFrame, as_of: dt.date, first_day: int = 1) -> DataFrame:
    """More in than out in each of the last complete months (three at most), or less in the last one.

    A month counts with five rows or more, before the current one, if the
    ledger reaches its end.
    """
    now = compare.financial_month(as_of, first_day).first
    last = linked.groupBy("user_id").agg(F.max("date").alias("last"))
    months = spend_series(linked, "monthly", first_day).withColumn("month_start", F.to_date(F.concat("period", F.lit(f"-{first_day:02}"))))
    whole = months.join(last, "user_id").where((F.col("n") >= 5) & (F.col("first_date") < F.lit(now)) & (F.date_sub(F.add_months("month_start", 1), 1) <= F.col("last")))
    newest = whole.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("period")))).where("k <= 3")
    sums = newest.groupBy("user_id").agg(F.count("*").alias("n"), F.min("cash_flow").alias("least"), F.max(F.when(F.col("k") == 1, F.struct("period", "cash_flow", "first_date"))).alias("one"), F.max(F.when(F.col("k") == 2, F.col("cash_flow"))).alias("before")).where("n >= 2")
    up = _told(sums.where("least > 0"), "positive_cashflow", F.col("one.period"), "positive", F.col("one.cash_flow"), F.col("one.first_date"), F.format_string("More came in than went out in %d months", F.col("n")), F.col("before"))
    down = _told(sums.where("least <= 0 AND one.cash_flow < 0"), "negative_cashflow", F.col("one.period"), "watch", F.col("one.cash_flow"), F.col("one.first_date"), F.lit("More went out than came in"))
    return up.unionByName(down)


def over_budget(budgets: DataFrame, as_of: dt.date, first_day: int = 1) -> DataFrame:
    """Budgets that are exceeded or will be. budgets: planning.budget_variance()."""
    kept = budgets.where("status IN ('over', 'projected_over')")
    start = compare.financial_month(as_of, first_day).first
    return _told(kept, "budget", F.concat_ws(":", F.col("category"), F.lit(str(start))), F.when(F.col("status") == "over", "attention").otherwise("watch"), F.col("actual"), F.lit(as_of), F.concat(F.col("category"), F.lit(" is "), F.col("status")), F.col("budget"))


def commitments(series: DataFrame, manual: DataFrame) -> DataFrame:
    """Per user: monthly equivalents of detected series and of manual obligations (user_id, series, monthly) that aren't detected."""
    detected = series.where((F.col("direction") == "debit") & ~F.col("ended")).select("user_id", "series", "monthly")
    extra = manual.join(detected, ["user_id", "series"], "left_anti").select("user_id", "series", "monthly")
    return detected.unionByName(extra).groupBy("user_id").agg(half_up(F.sum("monthly"), 2).alias("monthly"), F.count("*").alias("n"))


def united(*rules: DataFrame) -> DataFrame:
    """All rules' insights: equal ids once, with each user's ``place``, newest and then most severe first."""
    told = rules[0]
    for more in rules[1:]:
        told = told.unionByName(more)
    rank = F.coalesce(*[F.when(F.col("severity") == s, k) for s, k in SEVERITIES.items()])
    single = told.withColumn("nth", F.row_number().over(Window.partitionBy("user_id", "id").orderBy(F.desc("date"), rank.desc(), "value"))).where("nth = 1").drop("nth")
    return single.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("date"), rank.desc(), "id")))


def insights(linked: DataFrame, netted: DataFrame, findings: DataFrame, series: DataFrame, items: DataFrame, safe: DataFrame, budgets: DataFrame, as_of: dt.date, unit: str = "month", first_day: int = 1) -> DataFrame:
    """Every rule at a date."""
    now, then = compare.comparable(unit, as_of, first_day)
    return united(
        stale(linked, as_of), spending_change(linked, now, then, unit), group_changes(netted, "category", now, then), group_changes(netted, "merchant", now, then), unusual(findings), recurring_found(series), due_soon(items, as_of), room(safe, as_of),
        cash_flow(linked, as_of, first_day), over_budget(budgets, as_of, first_day),
    )


def snapshot(linked: DataFrame, netted: DataFrame, findings: DataFrame, series: DataFrame, safe: DataFrame, as_of: dt.date, unit: str = "month") -> DataFrame:
    """One row a user: the period's totals and change, the top category, commitments, what is safe, how much is unusual."""
    now, then = compare.comparable(unit, as_of)
    totals = compare.period_totals(linked, now).select("user_id", "net", "income", "cash_flow")
    before = compare.period_totals(linked, then).select("user_id", F.col("net").alias("net_before"))
    sums = netted.where(now.holds(F.col("date"))).groupBy("user_id", "category").agg(F.sum("net").alias("x"))
    top = sums.groupBy("user_id").agg(F.min_by("category", F.struct(-F.col("x"), "category")).alias("top_category"))
    due = series.where((F.col("direction") == "debit") & ~F.col("ended")).groupBy("user_id").agg(half_up(F.sum("monthly"), 2).alias("committed"), F.count("*").alias("n_recurring"))
    odd = findings.groupBy("user_id").agg(F.count("*").alias("unusual"), F.count_if(F.col("severity") == "high").alias("unusual_high"))
    out = totals.join(before, "user_id", "left").join(top, "user_id", "left").join(due, "user_id", "left").join(odd, "user_id", "left").join(safe.select("user_id", "safe", "short"), "user_id", "left")
    return out.na.fill(0, ["n_recurring", "unusual", "unusual_high"]).na.fill(0.0, ["committed"])


def fees(ledger: DataFrame, as_of: dt.date, days: int = 90) -> DataFrame:
    """Bank fees of the last ``days`` days by user."""
    recent = ledger.where(debit() & (F.col("category") == "BANKING FEES") & F.col("date").between(F.lit(as_of - dt.timedelta(days)), F.lit(as_of)))
    return _told(recent.groupBy("user_id").agg(F.sum("amount").alias("x")), "fees", F.lit("bank"), "info", F.col("x"), F.lit(as_of), F.lit("Bank fees were charged"))


def top_category(ledger: DataFrame, now: compare.Period) -> DataFrame:
    """The category each user spends most in."""
    sums = ledger.where(spending() & now.holds(F.col("date"))).groupBy("user_id", "category").agg(F.sum("amount").alias("x"))
    best = sums.groupBy("user_id").agg(F.min_by(F.struct("category", "x"), F.struct(-F.col("x"), "category")).alias("b"))
    return _told(best, "top", F.col("b.category"), "info", F.col("b.x"), F.lit(now.last), F.concat(F.lit("Most is spent on "), F.col("b.category")))
