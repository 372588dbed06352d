"""Aggregates of a ledger, each for all users at once.

Each is one pass with partial aggregation before its shuffle; groups are keyed
by user, so a user's rows meet only as partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.expressions import amount, credit, on, debit, income, refund, spending, bucket, half_up, percent, total

#: First of equals in (date, seq, id) order.
ORDER = ("date", "seq", "id")
#: Lower edges of the amount bands.
BANDS = (0, 100, 500, 1000, 2500, 5000, 10000, 25000)


def money(c: str) -> Column:
    return F.col(c).cast("double").alias(c)


def largest(when: Column, what: str = "id") -> Column:
    """``what`` of the largest row; ties to the first in ledger order."""
    return F.min_by(F.when(when, F.col(what)), F.when(when, F.struct(-amount(), *ORDER)))


def summary(ledger: DataFrame) -> DataFrame:
    """Per user: totals, counts, averages, savings, largest rows, the category most is spent in, dates.

    Gross spending by category is a second, small aggregate; everything else is one pass.
    """
    transfer = F.col("category") == "TRANSFERS"
    sums = ledger.groupBy("user_id").agg(
        F.count("*").alias("n"),
        F.count_if(credit()).alias("credits"),
        F.count_if(debit()).alias("debits"),
        F.count_if(income()).alias("incomes"),
        total(amount(), credit()).alias("total_credit"),
        total(amount(), debit()).alias("total_debit"),
        total(amount(), income()).alias("income"),
        total(amount(), spending()).alias("spending"),
        total(amount(), refund()).alias("refunds"),
        total(amount(), credit() & transfer).alias("transfers_in"),
        total(amount(), debit() & transfer).alias("transfers_out"),
        total(amount(), debit() & (F.col("category") == "INVESTMENTS")).alias("investments_out"),
        largest(debit()).alias("largest_debit"),
        largest(credit()).alias("largest_credit"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
    by_category = ledger.where(spending()).groupBy("user_id", "category").agg(F.sum("amount").alias("spent"))
    top = by_category.groupBy("user_id").agg(F.min_by(F.struct("category", "spent"), F.struct(-F.col("spent"), "category")).alias("top"))
    net = F.col("spending") - F.col("refunds")
    savings = F.col("income") - net
    other = F.col("total_credit") - F.col("income") - F.col("refunds") - F.col("transfers_in")
    return sums.join(top, "user_id", "left").select(
        "user_id", "n", "credits", "debits", "incomes", *map(money, ("total_credit", "total_debit", "income", "spending", "refunds", "transfers_in", "transfers_out", "investments_out")), other.cast("double").alias("other_credits"),
        net.cast("double").alias("net_spending"), (F.col("total_credit") - F.col("total_debit")).cast("double").alias("net_cash_flow"), savings.cast("double").alias("savings"),
        F.when(F.col("income") > 0, half_up(savings.cast("double") / F.col("income").cast("double") * 100, 1)).alias("savings_rate"),
        F.when(F.col("credits") > 0, half_up(F.col("total_credit").cast("double") / F.col("credits"), 2)).otherwise(0.0).alias("average_credit"),
        F.when(F.col("debits") > 0, half_up(F.col("total_debit").cast("double") / F.col("debits"), 2)).otherwise(0.0).alias("average_debit"),
        "largest_debit", "largest_credit", F.col("top.category").alias("top_category"), F.col("top.spent").cast("double").alias("top_amount"), "first_date", "last_date", (F.datediff("last_date", "first_date") + 1).alias("days"),
    )


def period_series(ledger: DataFrame, grain: str, first_day: int = 1) -> DataFrame:
    """Per user and period: income, spending, refunds, credits, debits, savings and its rate, transfers, net and count."""
    transfer = F.col("category") == "TRANSFERS"
    sums = ledger.groupBy("user_id", bucket(on(), grain, first_day).alias("period")).agg(
        total(amount(), income()).alias("income"), total(amount(), spending()).alias("spending"), total(amount(), refund()).alias("refunds"),
        total(amount(), credit()).alias("credit"), total(amount(), debit()).alias("debit"), total(amount(), credit() & transfer).alias("transfers_in"),
        total(amount(), debit() & transfer).alias("transfers_out"), F.count("*").alias("n"), F.min("date").alias("first_date"),
    )
    savings = F.col("income") - (F.col("spending") - F.col("refunds"))
    rate = F.when(F.col("income") > 0, half_up(savings.cast("double") / F.col("income").cast("double") * 100, 1))
    return sums.select(
        "user_id", "period", *map(money, ("income", "spending", "refunds", "credit", "debit")), (F.col("credit") - F.col("debit")).cast("double").alias("net"), savings.cast("double").alias("savings"), rate.alias("savings_rate"),
        *map(money, ("transfers_in", "transfers_out")), "n", "first_date",
    )


def monthly_average(series: DataFrame, measure: str) -> DataFrame:
    """The mean of a measure over each user's periods."""
    return series.groupBy("user_id").agg(F.count("*").alias("periods"), half_up(F.sum(F.col(measure).cast("decimal(28,2)")).cast("double") / F.count("*"), 2).alias("average"))


def latest_points(series: DataFrame, points: int) -> DataFrame:
    """The last ``points`` periods of each user."""
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("period")))
    return series.withColumn("nth", newest).where(F.col("nth") <= points).drop("nth")


def downsample(series: DataFrame, most: int) -> DataFrame:
    """Every k-th period of each user and the last one, so that about ``most`` stay."""
    user = Window.partitionBy("user_id")
    numbered = series.withColumns({"nth": F.row_number().over(user.orderBy("period")) - 1, "of": F.count("*").over(user)})
    step = F.greatest(F.lit(1), F.ceil(F.col("of") / most))
    return numbered.where((F.col("nth") % step == 0) | (F.col("nth") == F.col("of") - 1)).drop("nth", "of")


def category_spend(netted: DataFrame) -> DataFrame:
    """Per user and category of netted spending: amount, count, average and share. Needs ``net``."""
    sums = netted.groupBy("user_id", "category").agg(F.sum("net").alias("amount"), F.count("*").alias("n"))
    whole = F.sum("amount").over(Window.partitionBy("user_id"))
    return sums.select("user_id", "category", money("amount"), "n", half_up(F.col("amount").cast("double") / F.col("n"), 2).alias("average"), percent(F.col("amount"), whole).alias("share"))


def category_tree(netted: DataFrame) -> DataFrame:
    """Category spend with its subcategories, largest first, as text ``name=amount``."""
    parts = netted.groupBy("user_id", "category", "subcategory").agg(F.sum("net").alias("amount"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("amount")).alias("a"), F.col("subcategory").alias("s"))))
    return parts.groupBy("user_id", "category").agg(F.sum("amount").cast("double").alias("amount"), F.array_join(F.transform(rows, lambda r: F.concat(r["s"], F.lit("="), (-r["a"]).cast("string"))), ";").alias("subcategories"))


def merchant_spend(netted: DataFrame) -> DataFrame:
    """Per user and merchant: amount, count, average, last date and the category it is most spent in."""
    by_category = netted.groupBy("user_id", "merchant", "category").agg(F.sum("net").alias("amount"), F.count("*").alias("n"), F.max("date").alias("last_date"))
    sums = by_category.groupBy("user_id", "merchant").agg(
        F.sum("amount").alias("amount"), F.sum("n").alias("n"), F.max("last_date").alias("last_date"), F.min_by("category", F.struct(-F.col("amount"), "category")).alias("category")
    )
    return sums.select("user_id", "merchant", money("amount"), "n", half_up(F.col("amount").cast("double") / F.col("n"), 2).alias("average"), "last_date", "category")


def category_trend(ledger: DataFrame, grain: str, top: int) -> DataFrame:
    """Spending by period and category, the ``top`` categories of each user named, the rest together."""
    spent = ledger.where(spending()).groupBy("user_id", bucket(on(), grain).alias("period"), "category").agg(F.sum("amount").alias("amount"))
    overall = spent.groupBy("user_id", "category").agg(F.sum("amount").alias("whole"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("whole"), "category"))
    named = overall.select("user_id", "category", F.when(rank <= top, F.col("category")).otherwise("OTHER CATEGORIES").alias("name"))
    return spent.join(named, ["user_id", "category"]).groupBy("user_id", "period", "name").agg(F.sum("amount").cast("double").alias("amount"))


def zero_filled(series: DataFrame, name: str, *values: str) -> DataFrame:
    """A long series (user_id, period, name, ...) with a row of zeros wherever a user has the period and the name, but not both."""
    periods, names = (series.select("user_id", c).distinct() for c in ("period", name))
    return periods.join(names, "user_id").join(series, ["user_id", "period", name], "left").na.fill(0.0, list(values)).select(*series.columns)


def category_trend_wide(ledger: DataFrame, grain: str, categories: list[str]) -> DataFrame:
    """One row a period with a zero-filled column for each category."""
    spent = ledger.where(spending()).groupBy("user_id", bucket(on(), grain).alias("period")).pivot("category", categories).agg(F.sum(F.col("amount")).cast("double"))
    return spent.na.fill(0.0, categories)


#: What credits are called that aren't income; income goes by its subcategory.
CREDIT_KINDS = {"REFUNDS": "Refunds & cashback", "INVESTMENTS": "Investment proceeds"}


def income_sources(ledger: DataFrame) -> DataFrame:
    """Every credit by kind, with its share of all credits."""
    category = F.col("category")
    transfer = F.when(F.col("subcategory") == "Family", "Family transfers").otherwise("Transfers from people")
    kind = F.when(income(), F.col("subcategory")).when(category == "TRANSFERS", transfer).when(category == "REFUNDS", CREDIT_KINDS["REFUNDS"]).when(category == "INVESTMENTS", CREDIT_KINDS["INVESTMENTS"]).otherwise("Other credits")
    sums = ledger.where(credit()).groupBy("user_id", kind.alias("kind")).agg(F.sum("amount").alias("amount"), F.count("*").alias("n"))
    return sums.select("user_id", "kind", money("amount"), "n", percent(F.col("amount"), F.sum("amount").over(Window.partitionBy("user_id"))).alias("share"))


def _spine(frame: DataFrame, name: str, values: Column) -> DataFrame:
    return frame.select("user_id").distinct().select("user_id", F.explode(values).alias(name))


def weekday_profile(ledger: DataFrame) -> DataFrame:
    """Seven rows a user, Monday 1: spending, its count and average, empty days kept."""
    spent = ledger.where(spending()).groupBy("user_id", (F.weekday("date") + 1).alias("weekday")).agg(F.sum("amount").alias("amount"), F.count("*").alias("n"))
    return _spine(ledger, "weekday", F.sequence(F.lit(1), F.lit(7))).join(spent, ["user_id", "weekday"], "left").select("user_id", "weekday", F.coalesce(F.col("amount").cast("double"), F.lit(0.0)).alias("amount"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(half_up(F.col("amount").cast("double") / F.col("n"), 2), F.lit(0.0)).alias("average"))


def weekday_months(ledger: DataFrame) -> DataFrame:
    return ledger.where(spending()).groupBy("user_id", bucket(on(), "monthly").alias("period"), (F.weekday("date") + 1).alias("weekday")).agg(F.sum("amount").cast("double").alias("amount"))


def calendar_heat(ledger: DataFrame) -> DataFrame:
    return ledger.where(spending()).groupBy("user_id", "date").agg(F.sum("amount").cast("double").alias("amount"), F.count("*").alias("n"))


def amount_histogram(ledger: DataFrame) -> DataFrame:
    """Debits of spending by half-open amount bands; empty bands are kept."""
    band = F.coalesce(*[F.when(amount() >= low, k) for k, low in reversed(list(enumerate(BANDS)))], F.lit(0))
    spent = ledger.where(spending()).groupBy("user_id", band.alias("band")).agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount"))
    return _spine(ledger, "band", F.sequence(F.lit(0), F.lit(len(BANDS) - 1))).join(spent, ["user_id", "band"], "left").na.fill(0, ["n"]).na.fill(0.0, ["amount"])


def monthly_frequency(ledger: DataFrame, first_day: int = 1) -> DataFrame:
    return ledger.groupBy("user_id", bucket(on(), "monthly", first_day).alias("period")).agg(F.count("*").alias("n"), F.count_if(debit()).alias("debits"), F.count_if(credit()).alias("credits"))


def payment_methods(netted: DataFrame) -> DataFrame:
    """Netted spending by payment method with its share and average; none is ``Other``."""
    method = F.coalesce(F.nullif("payment_method", F.lit("")), F.lit("Other"))
    sums = netted.groupBy("user_id", method.alias("method")).agg(F.sum("net").alias("amount"), F.count("*").alias("n"))
    return sums.select("user_id", "method", money("amount"), "n", percent(F.col("amount"), F.sum("amount").over(Window.partitionBy("user_id"))).alias("share"), half_up(F.col("amount").cast("double") / F.col("n"), 2).alias("average"))


def spend_series(linked: DataFrame, grain: str, first_day: int = 1) -> DataFrame:
    """Netted spending less unlinked refunds, floored at 0, with income, cash flow and the count of all rows, by period.

    linked: rows of refunds.linked(), whose own links count; one pass.
    """
    key = bucket(on(), grain, first_day).alias("period")
    zero = F.lit(0).cast("decimal(18,2)")
    net = F.greatest(amount() - F.coalesce("refunded", zero), zero)
    flows = linked.groupBy("user_id", key).agg(
        total(net, spending()).alias("spent"), total(amount(), refund() & F.col("refund_for").isNull()).alias("unlinked"), total(amount(), income()).alias("income"),
        (total(amount(), credit()) - total(amount(), debit())).alias("cash_flow"), F.count("*").alias("n"), F.min("date").alias("first_date"),
    )
    return flows.select("user_id", "period", F.greatest(F.col("spent") - F.col("unlinked"), F.lit(0).cast("decimal(28,2)")).cast("double").alias("net"), money("income"), money("cash_flow"), "n", "first_date")


def merchant_months(netted: DataFrame, ledger: DataFrame, months: int = 6, first_day: int = 1) -> DataFrame:
    """Each merchant's netted spending in the last ``months`` months that the user's whole ledger has, zero-filled."""
    month = bucket(on(), "monthly", first_day).alias("period")
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("period")))
    recent = ledger.select("user_id", month).distinct().withColumn("nth", newest).where(F.col("nth") <= months).drop("nth")
    spent = netted.groupBy("user_id", "merchant", month).agg(F.sum("net").cast("double").alias("amount"))
    merchants = spent.select("user_id", "merchant").distinct()
    return merchants.join(recent, "user_id").join(spent, ["user_id", "merchant", "period"], "left").na.fill(0.0, ["amount"])


def group_stats(netted: DataFrame, key: str) -> DataFrame:
    """Netted spending by ``key`` (category or merchant): amount, count, average, largest row, first and last day, main category."""
    first = F.struct(-F.col("net"), *ORDER)
    by_category = netted.groupBy("user_id", key, *(["category"] if key != "category" else [])).agg(
        F.sum("net").alias("amount"), F.count("*").alias("n"), F.min(F.struct(first.alias("order"), F.col("net").alias("net"))).alias("top"), F.min("date").alias("first"), F.max("date").alias("last")
    )
    if key != "category":
        by_category = by_category.groupBy("user_id", key).agg(
            F.sum("amount").alias("total"), F.sum("n").alias("n"), F.min("top").alias("top"), F.min("first").alias("first"), F.max("last").alias("last"), F.min_by("category", F.struct(-F.col("amount"), "category")).alias("category")
        ).withColumnRenamed("total", "amount")
    return by_category.select(
        "user_id", *dict.fromkeys([key, "category"]), money("amount"), "n", half_up(F.col("amount").cast("double") / F.col("n"), 2).alias("average"), F.col("top.order.id").alias("largest"), F.col("top.net").cast("double").alias("largest_amount"), "first", "last",
    )
