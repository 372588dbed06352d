"""Two periods side by side, and rankings that keep ties."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.expressions import amount, credit, debit, half_up, income, percent, refund, spending, total
from quillon.operators.aggregates import ORDER, group_stats, largest, money, spend_series


def own_transfer() -> Column:
    return F.coalesce(F.col("subcategory") == "Self Transfer", F.lit(False))



@dataclass(frozen=True)
class Period:
    first: dt.date
    last: dt.date

    def holds(self, day: Column) -> Column:
        return day.between(F.lit(self.first), F.lit(self.last))


def previous(period: Period) -> Period:
    """The period of the same length just before."""
    days = (period.last - period.first).days + 1
    return Period(period.first - dt.timedelta(days), period.first - dt.timedelta(1))


def _months_later(day: dt.date, months: int) -> dt.date:
    at = day.year * 12 + day.month - 1 + months
    return day.replace(year=at // 12, month=at % 12 + 1)


def financial_month(day: dt.date, first_day: int = 1) -> Period:
    """The month of ``day`` when months begin on ``first_day`` (1 to 28)."""
    first = day.replace(day=first_day)
    first = first if day.day >= first_day else _months_later(first, -1)
    return Period(first, _months_later(first, 1) - dt.timedelta(1))


def comparable(unit: str, as_of: dt.date, first_day: int = 1) -> tuple[Period, Period]:
    """The unit that holds ``as_of``, up to it, and as many days of the one before; only months honour ``first_day``."""
    if unit == "month":
        first = financial_month(as_of, first_day).first
        earlier = _months_later(first, -1)
    elif unit == "week":
        first = as_of - dt.timedelta(as_of.weekday())
        earlier = first - dt.timedelta(7)
    elif unit in ("quarter", "year"):
        months = 3 if unit == "quarter" else 12
        first = as_of.replace(month=months * ((as_of.month - 1) // months) + 1, day=1)
        earlier = _months_later(first, -months)
    else:
        raise ValueError(f"unknown unit {unit!r}")
    return Period(first, as_of), Period(earlier, min(earlier + (as_of - first), first - dt.timedelta(1)))


def unit_of(period: Period) -> str:
    """The calendar unit that a range is, else ``custom``."""
    day = period.first
    for unit in ("week", "month", "quarter", "year"):
        first = comparable(unit, day)[0].first
        months = {"month": 1, "quarter": 3, "year": 12}.get(unit)
        after = day + dt.timedelta(7) if months is None else _months_later(first, months)
        if first == day and after == period.last + dt.timedelta(1):
            return unit
    return "day" if period.first == period.last else "custom"


def changes(netted: DataFrame, key: str, current: Period, before: Period, least_percent: float = 25.0, least_amount: float = 500.0, least_rows: int = 3) -> DataFrame:
    """Amounts of a key in both periods in one pass, the change and whether it matters."""
    day = F.col("date")
    both = netted.where(current.holds(day) | before.holds(day)).groupBy("user_id", key)
    sums = both.agg(total(F.col("net"), current.holds(day)).alias("now"), total(F.col("net"), before.holds(day)).alias("then"), F.count_if(current.holds(day)).alias("n_now"), F.count_if(before.holds(day)).alias("n_then"))
    delta = F.col("now") - F.col("then")
    pct = F.when(F.col("then") > 0, half_up(delta.cast("double") / F.col("then").cast("double") * 100, 1))
    kind = F.when((F.col("then") == 0) & (F.col("now") > 0), "new").when((F.col("now") == 0) & (F.col("then") > 0), "stopped").when(delta > 0, "increase").when(delta < 0, "decrease").otherwise("flat")
    matters = (kind != "flat") & (F.abs(delta) >= least_amount) & (F.coalesce(F.abs(pct), F.lit(100.0)) >= least_percent) & (F.greatest("n_now", "n_then") >= least_rows)
    return sums.select("user_id", key, money("now"), money("then"), "n_now", "n_then", delta.cast("double").alias("delta"), pct.alias("percent"), kind.alias("kind"), matters.alias("significant"))


def period_totals(linked: DataFrame, period: Period) -> DataFrame:
    """Per user: a period's gross, refunded, unlinked and net spending, income, flows and counts; links are those of the full history.

    linked: rows of refunds.linked(); one pass.
    """
    zero = F.lit(0).cast("decimal(18,2)")
    net = F.greatest(amount() - F.coalesce("refunded", zero), zero)
    sums = linked.where(period.holds(F.col("date"))).groupBy("user_id").agg(
        total(amount(), spending()).alias("gross"), total(net, spending()).alias("netted"), total(amount(), refund() & F.col("refund_for").isNull()).alias("unlinked"),
        total(amount(), income()).alias("income"), total(amount(), credit()).alias("credits"), total(amount(), debit()).alias("debits"),
        total(amount(), debit() & (F.col("category") == "TRANSFERS")).alias("transfers_out"), total(amount(), debit() & (F.col("category") == "INVESTMENTS")).alias("investments_out"),
        F.count("*").alias("n"), F.count_if(spending() & (net > 0)).alias("n_spending"),
    )
    return sums.select(
        "user_id", money("gross"), (F.col("gross") - F.col("netted")).cast("double").alias("refunded"), money("unlinked"), F.greatest(F.col("netted") - F.col("unlinked"), F.lit(0).cast("decimal(28,2)")).cast("double").alias("net"),
        money("income"), money("credits"), money("debits"), (F.col("credits") - F.col("debits")).cast("double").alias("cash_flow"), money("transfers_out"), money("investments_out"), "n", "n_spending",
    )


def day_stats(linked: DataFrame) -> DataFrame:
    """Per user and day: counts of all rows, money without own transfers, netted spending, the largest payment and receipt.

    linked: rows of refunds.linked(); one pass. The largest payment is by netted
    spending, the largest receipt by amount; ties to the first in ledger order.
    """
    own = ~own_transfer()
    zero = F.lit(0).cast("decimal(18,2)")
    net = F.greatest(amount() - F.coalesce("refunded", zero), zero)
    paid = spending() & (net > 0)
    got = credit() & own
    sums = linked.groupBy("user_id", "date").agg(
        F.count("*").alias("n"), F.count_if(debit()).alias("debits"), F.count_if(credit()).alias("credits"), total(amount(), debit() & own).alias("money_out"), total(amount(), got).alias("money_in"),
        total(net, spending()).alias("spent"), total(amount(), refund() & F.col("refund_for").isNull()).alias("unlinked"), total(amount(), income() & own).alias("income"), total(amount(), refund() & own).alias("refunds"),
        total(amount(), got & (F.col("category") == "TRANSFERS")).alias("transfers_in"), F.min_by(F.when(paid, F.col("id")), F.when(paid, F.struct(-net, *ORDER))).alias("largest_payment"), largest(got).alias("largest_receipt"),
    )
    return sums.select(
        "user_id", "date", "n", "debits", "credits", money("money_out"), money("money_in"), F.greatest(F.col("spent") - F.col("unlinked"), F.lit(0).cast("decimal(28,2)")).cast("double").alias("spending"),
        money("income"), money("refunds"), money("transfers_in"), (F.col("money_out") + F.col("money_in")).cast("double").alias("value"), "largest_payment", "largest_receipt",
    )


def analysis(linked: DataFrame, netted: DataFrame, key: str, now: Period, then: Period, top: int | None = None) -> DataFrame:
    """The spending analysis of two periods by ``key``: this period's group stats with share, what it was before, and the change.

    Only groups of the current period are listed, the ``top`` largest of each user if given.
    """
    stats = group_stats(netted.where(now.holds(F.col("date"))), key)
    moved = changes(netted, key, now, then).select("user_id", key, F.col("then").alias("before"), F.col("n_then").alias("n_before"), "delta", "percent", "kind", "significant")
    order = Window.partitionBy("user_id").orderBy(F.desc("amount"), key)
    whole = F.sum(F.col("amount").cast("decimal(28,2)")).over(Window.partitionBy("user_id"))
    rows = stats.withColumns({"place": F.row_number().over(order), "share": percent(F.col("amount").cast("decimal(28,2)"), whole)}).join(moved, ["user_id", key])
    return rows if top is None else rows.where(F.col("place") <= top)


def period_ranking(linked: DataFrame, period: Period, grain: str, first_day: int = 1) -> DataFrame:
    """Weeks or months ranked by netted spending; only rows inside ``period`` are bucketed, so one at its edge counts in part."""
    series = spend_series(linked.where(period.holds(F.col("date"))), grain, first_day)
    place = F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("net")))
    return series.withColumn("place", place).select("user_id", "place", "period", "first_date", F.col("net").alias("spending"), "n")


def top_ties(frame: DataFrame, measure: str) -> DataFrame:
    """Each user's rows of the largest ``measure``, ties and all; none where it is not positive."""
    rank = F.rank().over(Window.partitionBy("user_id").orderBy(F.desc(measure)))
    return frame.where(F.col(measure) > 0).withColumn("place", rank).where("place = 1").drop("place")


def largest_transactions(ledger: DataFrame, n: int, direction: str | None = None) -> DataFrame:
    """The rows of the n largest amounts of each user, without own transfers; equal amounts share a place."""
    rows = ledger.where(~own_transfer()) if direction is None else ledger.where(~own_transfer() & (F.col("direction") == direction))
    place = F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("amount")))
    return rows.withColumn("place", place).where(F.col("place") <= n).select("user_id", "place", "id", "date", money("amount"), "merchant")


def merchant_ranking(netted: DataFrame, n: int) -> DataFrame:
    sums = netted.groupBy("user_id", "merchant").agg(F.sum("net").alias("amount"), F.count("*").alias("n"))
    shared = sums.withColumn("share", percent(F.col("amount"), F.sum("amount").over(Window.partitionBy("user_id"))))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("amount"), "merchant"))
    return shared.withColumn("place", place).where(F.col("place") <= n).select("user_id", "place", "merchant", money("amount"), "n", "share")
