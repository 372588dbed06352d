"""Budgets, coming payments, forecast, projection and what is safe to spend; all estimates at a date that is a parameter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.expressions import half_up, income, percent, spending, total
from quillon.operators import recurring
from quillon.operators.aggregates import money
from quillon.operators.compare import Period, financial_month


def budget_variance(ledger: DataFrame, budgets: DataFrame, as_of: dt.date, first_day: int = 1) -> DataFrame:
    """Spending of the financial month against (user_id, category, budget, alert).

    The projection is the run-rate, blended with the mean of those of the three
    months before that had spending, whose weight falls to 0 by day ten; never
    under what is spent.
    """
    now = financial_month(as_of, first_day)
    before = [financial_month(now.first - dt.timedelta(1), first_day)]
    while len(before) < 3:
        before.append(financial_month(before[-1].first - dt.timedelta(1), first_day))
    days = (now.last - now.first).days + 1
    elapsed = min(days, max(1, (as_of - now.first).days + 1))
    day = F.col("date")
    span = Period(before[-1].first, now.last)
    sums = ledger.where(spending() & span.holds(day)).groupBy("user_id", "category").agg(total(F.col("amount"), now.holds(day)).alias("actual"), *(total(F.col("amount"), p.holds(day)).alias(f"m{k}") for k, p in enumerate(before)))
    joined = budgets.join(sums, ["user_id", "category"], "left")
    actual = F.coalesce(F.col("actual").cast("double"), F.lit(0.0))
    held = sum((F.when(F.col(f"m{k}") > 0, 1).otherwise(0) for k in range(3)), F.lit(0))
    average = F.when(held > 0, half_up((F.col("m0") + F.col("m1") + F.col("m2")).cast("double") / held, 2)).otherwise(0.0)
    rate = actual / elapsed * days
    weight = min(1.0, elapsed / 10)
    projected = half_up(F.when(average > 0, F.greatest(actual, rate * weight + average * (1 - weight))).otherwise(F.greatest(actual, rate)), 2)
    budget = F.col("budget").cast("double")
    status = F.when(actual > budget, "over").when(projected > budget, "projected_over").when(actual >= budget * F.col("alert"), "warning").otherwise("ok")
    share = lambda x: F.when(budget > 0, half_up(x / budget * 100, 1)).otherwise(0.0)
    return joined.select("user_id", "category", money("budget"), actual.alias("actual"), (budget - actual).alias("remaining"), share(actual).alias("used"), projected.alias("projected"), share(projected).alias("projected_share"), average.alias("average"), status.alias("status"))


def upcoming(series: DataFrame, manual: DataFrame, as_of: dt.date, last: dt.date, dismissed: DataFrame | None = None) -> DataFrame:
    """Coming payments of each user: manual obligations' dates and detected series that no obligation describes.

    manual: (user_id, id, name, amount, frequency, start_date, due_day, category, kind, merchant_key).
    """
    first, end = F.lit(as_of), F.lit(last)
    dates = recurring.upcoming(manual, first, end)
    entered = manual.join(dates, "id").select("user_id", F.col("name"), half_up(F.col("amount").cast("double"), 2).alias("amount"), F.col("due").alias("date"), "kind", F.lit("manual").alias("source"), "category", "frequency", F.lit("Manual").alias("confidence"), F.lit(False).alias("overdue"))
    own = series if dismissed is None else recurring.own_series(series, dismissed)
    own = own.join(recurring.same_obligation(own, manual), recurring.KEYS, "left_anti")
    coming = recurring.projected(own, first, end)
    kind = F.when(F.col("direction") == "credit", "income").otherwise("expense")
    found = coming.select("user_id", F.col("merchant").alias("name"), F.col("expected").alias("amount"), "date", kind.alias("kind"), F.lit("detected").alias("source"), "category", "frequency", F.col("label").alias("confidence"), F.col("late").alias("overdue"))
    return entered.unionByName(found)


def forecast(ledger: DataFrame, series: DataFrame, items: DataFrame, balances: DataFrame, as_of: dt.date, last: dt.date, buffer: float | None = None, planned: float = 0.0) -> DataFrame:
    """Per user: expected income, recurring and everyday spending up to a day, what remains and what is safe to spend.

    items: upcoming(); balances: (user_id, balance). Income follows the items
    if there is a pattern, else the mean of the last 90 days; everyday spending
    is what no series of payments explains, its range that of three 30-day windows.
    """
    horizon = max(1, (last - as_of).days + 1)
    since = as_of - dt.timedelta(89)
    history = ledger.where(F.col("date").between(F.lit(since), F.lit(as_of)))
    explained = recurring.members(ledger, series.where("direction = 'debit'")).withColumn("explained", F.lit(True))
    rows = history.join(explained, ["user_id", "id"], "left")
    window = [F.col("date").between(F.lit(as_of - dt.timedelta(30 * (w + 1) - 1)), F.lit(as_of - dt.timedelta(30 * w))) for w in range(3)]
    plain = spending() & F.col("explained").isNull()
    sums = rows.groupBy("user_id").agg(
        F.min("date").alias("first"), total(F.col("amount"), income()).alias("earned"), total(F.col("amount"), plain).alias("everyday"),
        *(total(F.col("amount"), plain & w).cast("double").alias(f"w{k}") for k, w in enumerate(window)), *(total(F.col("amount"), spending() & w).cast("double").alias(f"s{k}") for k, w in enumerate(window)),
    )
    due = items.groupBy("user_id").agg(F.coalesce(F.sum(F.when(F.col("kind") == "income", F.col("amount").cast("decimal(18,2)"))), F.lit(0)).cast("double").alias("income_due"), F.count_if(F.col("kind") == "income").alias("incomes"), F.coalesce(F.sum(F.when(F.col("kind") == "expense", F.col("amount").cast("decimal(18,2)"))), F.lit(0)).cast("double").alias("due"))
    regular = series.where(~F.col("ended")).groupBy("user_id").agg(F.count_if(F.col("direction") == "credit").alias("patterns"))
    counted = series.groupBy("user_id").agg(F.count("*").alias("n_series"))
    joined = balances.join(sums, "user_id", "left").join(due, "user_id", "left").join(regular, "user_id", "left").join(counted, "user_id", "left").na.fill(0.0, ["income_due", "due", *(f"{x}{k}" for x in "ws" for k in range(3))]).na.fill(0, ["incomes", "patterns", "n_series"])
    data_days = F.coalesce(F.least(F.lit(90), F.datediff(F.lit(as_of), "first") + 1), F.lit(0))
    per_day = F.when(data_days > 0, F.coalesce(F.col("earned").cast("double"), F.lit(0.0)) / F.greatest(data_days, F.lit(30))).otherwise(0.0)
    expected_income = F.when((F.col("incomes") > 0) | (F.col("patterns") > 0), F.col("income_due")).otherwise(half_up(per_day * horizon, 2))
    daily = F.when(data_days > 0, F.coalesce(F.col("everyday").cast("double"), F.lit(0.0)) / F.greatest(data_days, F.lit(1))).otherwise(0.0)
    everyday = half_up(daily * horizon, 2)
    some = lambda x: F.filter(F.array(*(F.col(f"{x}{k}") for k in range(3))), lambda v: v > 0)
    many = F.size(some("w")) >= 2
    low, high = F.when(many, F.array_min(some("w")) / 30 * horizon).otherwise(everyday * 0.8), F.when(many, F.array_max(some("w")) / 30 * horizon).otherwise(everyday * 1.2)
    usual = F.when(F.size(some("s")) > 0, F.aggregate(some("s"), F.lit(0.0), lambda a, v: a + v) / F.size(some("s"))).otherwise(0.0)
    kept = F.lit(float(buffer)) if buffer is not None else half_up(usual * 0.1, 2)
    net = half_up(expected_income - F.col("due") - everyday - planned, 2)
    remaining = half_up(F.col("balance") + net, 2)
    confidence = F.when((data_days >= 75) & (F.col("n_series") >= 3), "Higher").when(data_days >= 30, "Medium").otherwise("Low")
    return joined.select(
        "user_id", "balance", expected_income.alias("income"), F.col("due").alias("recurring"), everyday.alias("everyday"), half_up(low, 2).alias("everyday_low"), half_up(high, 2).alias("everyday_high"), half_up(daily, 2).alias("daily"),
        net.alias("net"), remaining.alias("remaining"), half_up(F.col("balance") + expected_income - F.col("due") - high - planned, 2).alias("remaining_low"), half_up(F.col("balance") + expected_income - F.col("due") - low - planned, 2).alias("remaining_high"),
        kept.alias("buffer"), F.greatest(half_up(remaining - kept, 2), F.lit(0.0)).alias("safe"), data_days.alias("data_days"), confidence.alias("confidence"),
    )


def projection(balances: DataFrame, due: DataFrame, daily: DataFrame, days: int) -> DataFrame:
    """A dense path of ``days`` days after each user's last known balance.

    balances: (user_id, date, balance); due: (user_id, date, amount), signed;
    daily: (user_id, mean, low, high) of everyday spending. Committed follows
    the due items, likely also takes the mean off each day, its range the others.
    """
    spine = balances.select("user_id", F.col("date").alias("start"), "balance", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("n")).withColumn("date", F.date_add("start", F.col("n")))
    items = due.groupBy("user_id", "date").agg(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("due"))
    path = spine.join(items, ["user_id", "date"], "left").join(daily, "user_id", "left").na.fill(0.0, ["due", "mean", "low", "high"])
    committed = F.col("balance") + F.sum("due").over(Window.partitionBy("user_id").orderBy("date"))
    return path.select("user_id", "date", half_up(committed, 2).alias("committed"), *(half_up(committed - F.col(c) * F.col("n"), 2).alias(name) for name, c in (("likely", "mean"), ("likely_low", "high"), ("likely_high", "low"))))


def safe_to_spend(forecasts: DataFrame, items: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per user: the balance less coming payments, the unspent budgets that these don't cover already, and the buffer.

    forecasts: forecast(); items: upcoming(); budgets: budget_variance(). Never
    under 0; what is short is told apart. Income still to come is not counted.
    """
    expenses = items.where("kind = 'expense'")
    counted = expenses.groupBy("user_id", "category").agg(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("counted"))
    left = F.greatest(F.col("remaining"), F.lit(0.0))
    reserved = F.greatest(half_up(left - F.coalesce("counted", F.lit(0.0)), 2), F.lit(0.0))
    reserve = budgets.join(counted, ["user_id", "category"], "left").groupBy("user_id").agg(F.sum(reserved.cast("decimal(18,2)")).cast("double").alias("budgets"))
    joined = forecasts.join(reserve, "user_id", "left").na.fill(0.0, ["budgets"])
    raw = half_up(F.col("balance") - F.col("recurring") - F.col("budgets") - F.col("buffer"), 2)
    return joined.select("user_id", "balance", "recurring", "budgets", "buffer", raw.alias("raw"), F.greatest(raw, F.lit(0.0)).alias("safe"), F.greatest(-raw, F.lit(0.0)).alias("short"), F.col("income").alias("income_not_counted"))


def goals(table: DataFrame) -> DataFrame:
    """(user_id, name, target_amount, current_amount) with how far each goal is, 100 % at most."""
    return table.select("user_id", "name", money("target_amount"), money("current_amount"), F.least(F.lit(100.0), percent(F.col("current_amount"), F.col("target_amount"))).alias("progress"))
