"""Ordered computations: running balances, dense calendars, checks of chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.expressions import amount, credit, debit, half_up, spending, total
from quillon.operators.aggregates import ORDER

def signed() -> Column:
    return F.when(credit(), amount()).otherwise(-amount())



def cumulative_flow(ledger: DataFrame) -> DataFrame:
    """Net flow by day, its running sum and the day's last known balance (null: none, if the ledger has any); days are aggregated before the window."""
    known = [F.max_by(F.when(F.col("balance_after").isNotNull(), F.col("balance_after")), F.when(F.col("balance_after").isNotNull(), F.struct("seq", "id"))).cast("double").alias("balance")] if "balance_after" in ledger.columns else []
    days = ledger.groupBy("user_id", "date").agg((total(amount(), credit()) - total(amount(), debit())).alias("net"), *known)
    running = F.sum("net").over(Window.partitionBy("user_id").orderBy("date"))
    return days.select("user_id", "date", F.col("net").cast("double").alias("net"), running.cast("double").alias("cumulative"), *(["balance"] if known else []))


def moving_average(series: DataFrame, value: str, points: int = 7) -> DataFrame:
    """``series`` (user_id, period, ...) with the mean of the last ``points`` points of ``value``."""
    last = Window.partitionBy("user_id").orderBy("period").rowsBetween(1 - points, 0)
    return series.withColumn("average", half_up(F.avg(value).over(last), 2))


def with_balance(ledger: DataFrame) -> DataFrame:
    """The ledger with ``balance_after``, every row's running sum."""
    return ledger.withColumn("balance_after", F.sum(signed()).over(Window.partitionBy("user_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)))


def balance_on(balanced: DataFrame, day) -> DataFrame:
    """Each user's last known balance on or before a day."""
    known = balanced.where((F.col("date") <= F.lit(day)) & F.col("balance_after").isNotNull())
    return known.groupBy("user_id").agg(F.max_by("balance_after", F.struct(*ORDER)).cast("double").alias("balance"), F.max("date").alias("date"))


def chain_breaks(balanced: DataFrame, tolerance: float = 0.011) -> DataFrame:
    """Per user: rows with a balance and those that don't follow from the last row that has one."""
    before = F.lag("balance_after").over(Window.partitionBy("user_id").orderBy(*ORDER))
    rows = balanced.where("balance_after IS NOT NULL").withColumn("expected", before + signed())
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("expected") - F.col("balance_after")) > tolerance).alias("breaks"))


def daily_strip(ledger: DataFrame, days: int) -> DataFrame:
    """A dense row for each of a user's last ``days`` days: in, spent, and the balance carried forward from before them."""
    last = ledger.groupBy("user_id").agg(F.max("date").alias("last"))
    spine = last.select("user_id", F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("date"))
    flows = ledger.groupBy("user_id", "date").agg(total(amount(), credit()).alias("money_in"), total(amount(), spending()).alias("spent"), (total(amount(), credit()) - total(amount(), debit())).alias("net"))
    # what came before the window is one sum for each user, so only the window's own days are ordered
    inside = flows.join(last, "user_id")
    seed = inside.where(F.col("date") < F.date_sub("last", days - 1)).groupBy("user_id").agg(F.sum("net").alias("seed"))
    recent = inside.where(F.col("date") >= F.date_sub("last", days - 1)).drop("last")
    dense = spine.join(recent, ["user_id", "date"], "left").join(seed, "user_id", "left")
    zero = F.lit(0).cast("decimal(28,2)")
    running = F.coalesce(F.sum("net").over(Window.partitionBy("user_id").orderBy("date")), zero) + F.coalesce("seed", zero)
    known = F.coalesce(F.col("seed"), F.first("net", ignorenulls=True).over(Window.partitionBy("user_id").orderBy("date"))).isNotNull()
    return dense.select("user_id", "date", F.coalesce(F.col("money_in").cast("double"), F.lit(0.0)).alias("money_in"), F.coalesce(F.col("spent").cast("double"), F.lit(0.0)).alias("spent"), F.when(known, running.cast("double")).alias("balance"))
