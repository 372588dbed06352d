"""Recurring payments, found with windows and aggregates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.expressions import credit, debit, half_up, merchant_key, month_day

# Name, bounds of the median interval, nominal days, payments a month; sets of categories.
FREQUENCIES = (("weekly", 5, 9, 7, 52 / 12), ("biweekly", 12, 17, 14, 26 / 12), ("monthly", 26, 35, 30, 1.0), ("quarterly", 84, 100, 91, 1 / 3), ("yearly", 350, 380, 365, 1 / 12))
SKIPPED = ("ATM/CASH", "BANKING FEES", "REFUNDS", "OTHER")
BILLS = ("UTILITIES", "BILLS", "RENT", "SUBSCRIPTIONS", "EDUCATION", "INVESTMENTS")
DISCRETIONARY = ("FOOD", "GROCERIES", "SHOPPING", "TRANSPORTATION", "TRAVEL", "PERSONAL", "ENTERTAINMENT", "HEALTHCARE")
MONTHS = {"monthly": 1, "quarterly": 3, "yearly": 12}
KEYS = ["user_id", "direction", "series"]


def frequency(days: Column) -> Column:
    return F.coalesce(*[F.when(days.between(low, high), name) for name, low, high, _, _ in FREQUENCIES])


def _of(name: Column, column: int) -> Column:
    return F.coalesce(*[F.when(name == f[0], F.lit(float(f[column]))) for f in FREQUENCIES])


def monthly_equivalent(amount: Column, name: Column) -> Column:
    return amount * _of(name, 4)


def next_occurrence(last: Column, name: Column, day: Column) -> Column:
    """The date after ``last``; months keep to ``day`` or their last one."""
    months = F.coalesce(*[F.when(name == n, m) for n, m in MONTHS.items()])
    return F.when(months.isNotNull(), month_day(last, F.coalesce(months, F.lit(0)), day)).otherwise(F.date_add(last, _of(name, 3).cast("int")))


def candidates(ledger: DataFrame) -> DataFrame:
    """The rows that may belong to a series, with its key: every debit but of four categories, credits of two."""
    kept = ledger.where((debit() & ~F.col("category").isin(*SKIPPED)) | (credit() & F.col("category").isin("SALARY/INCOME", "TRANSFERS")))
    return kept.withColumn("series", F.lower("merchant"))


def intervals(ledger: DataFrame) -> DataFrame:
    """One row per series (direction, merchant) and day, same-day payments merged, with the days since the one before."""
    place = F.struct("seq", "id")
    days = candidates(ledger).groupBy(*KEYS, "date").agg(
        F.sum("amount").alias("amount"), F.count("*").alias("rows"), F.max_by(F.struct("category", "subcategory"), place).alias("kind"), F.min_by("merchant", place).alias("merchant"), F.count_if(F.col("payment_method") == "AUTOPAY").alias("autopays"),
    )
    own = Window.partitionBy(*KEYS).orderBy("date")
    return days.withColumns({"gap": F.datediff("date", F.lag("date").over(own)), "before": F.lag("amount").over(own)})


def detect(ledger: DataFrame, as_of: Column) -> DataFrame:
    """Series with a regular interval: frequency, amounts, confidence, next date, and whether it is overdue or ended.

    Three payment days, or a clean monthly pair; 60 % of the intervals near the
    median; amounts that vary little by what the category allows. One aggregate
    over the payment days; a series' gaps are an array of one number a day.
    """
    days = intervals(ledger)
    series = days.groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.sum("rows").alias("rows"), F.collect_list("gap").alias("gaps"), F.median("gap").alias("median_gap"), F.sum("amount").cast("double").alias("sum"),
        F.sum((F.col("amount") * F.col("amount")).cast("decimal(38,4)")).cast("double").alias("squares"), F.max("date").alias("last_date"), F.max_by(F.struct("amount", "before", "kind", "merchant"), "date").alias("last"),
        F.median(F.dayofmonth("date")).alias("day"), F.sum("autopays").alias("autopays"),
    ).where("n >= 2").withColumn("frequency", frequency(F.col("median_gap"))).where("frequency IS NOT NULL")
    tolerance = F.greatest(F.lit(3.0), 0.15 * _of(F.col("frequency"), 3))
    near = F.size(F.filter("gaps", lambda g: F.abs(g - F.col("median_gap")) <= tolerance))
    n, category, subcategory = F.col("n"), F.col("last.kind.category"), F.col("last.kind.subcategory")
    spread = F.sqrt(F.greatest(n * F.col("squares") - F.col("sum") * F.col("sum"), F.lit(0.0)))
    rated = series.withColumns({"regularity": near / F.size("gaps"), "mean": F.col("sum") / n, "cv": F.when(F.col("sum") > 0, spread / F.col("sum")).otherwise(1.0), "category": category, "subcategory": F.coalesce(subcategory, F.lit(""))})
    cv, weekly = F.col("cv"), F.col("frequency") == "weekly"
    bills = F.col("category").isin(*BILLS)
    casual = F.col("category").isin(*DISCRETIONARY) & ~((F.col("category") == "ENTERTAINMENT") & (F.col("subcategory") == "Streaming")) & ~((F.col("category") == "PERSONAL") & (F.col("subcategory") == "Fitness"))
    pair = (n == 2) & (F.col("frequency") == "monthly") & (cv < 0.01) & (F.col("regularity") == 1)
    steady = ~(weekly & (cv > 0.1)) & ~(casual & (cv > 0.15)) & ~((F.col("category") == "TRANSFERS") & (cv > 0.05)) & ~(~bills & (cv > 0.5))
    kept = rated.where(((n >= 3) | pair) & (F.col("regularity") >= 0.6) & steady)
    sure = 0.4 * F.col("regularity") + 0.3 * (1 - F.least(F.lit(1.0), cv / 0.5)) + 0.3 * F.least(F.lit(1.0), n / 6) + F.when(bills, 0.05).otherwise(0.0)
    confidence = half_up(F.least(F.lit(1.0), F.when(pair, F.least(sure, F.lit(0.5))).otherwise(sure)), 2)
    amount, before = F.col("last.amount").cast("double"), F.col("last.before").cast("double")
    coming = next_occurrence(F.col("last_date"), F.col("frequency"), F.floor(F.col("day") + 0.5).cast("int"))
    ended = F.datediff(as_of, "last_date") > 2.2 * F.col("median_gap")
    fixed = cv <= 0.05
    settled = (n >= 3) & (F.abs(amount - before) <= 0.01 * amount) & ~fixed
    kind = F.when((F.col("direction") == "debit") & (F.col("autopays") >= F.ceil(F.col("rows") / 2)), "AUTOPAY").when(fixed, "FIXED").otherwise("VARIABLE")
    out = kept.select(
        *KEYS, F.col("last.merchant").alias("merchant"), "category", "subcategory", "frequency", "n", half_up(F.col("mean"), 2).alias("average"), half_up(amount, 2).alias("last_amount"), F.when(fixed, "fixed").otherwise("variable").alias("pattern"),
        kind.alias("kind"), half_up(cv, 3).alias("variability"), half_up(F.when(fixed | settled, amount).otherwise(F.col("mean")), 2).alias("expected"),
        F.when((before > 0) & (F.abs(amount - before) / before >= 0.05), half_up(before, 2)).alias("changed_from"), "last_date", coming.alias("next_date"), F.floor(F.col("median_gap") + 0.5).cast("int").alias("interval_days"),
        confidence.alias("confidence"), (~ended & (coming < as_of)).alias("overdue"), ended.alias("ended"),
    )
    label = F.when(F.col("confidence") >= 0.75, "High").when(F.col("confidence") >= 0.55, "Medium").otherwise("Low")
    return out.withColumns({"label": label, "monthly": half_up(monthly_equivalent(F.col("average"), F.col("frequency")), 2)})


def members(ledger: DataFrame, series: DataFrame) -> DataFrame:
    """(user_id, id): the rows that make up the detected series, to be flagged as recurring."""
    return candidates(ledger).join(series.select(*KEYS), KEYS, "left_semi").select("user_id", "id")


def refreshed_flags(ledger: DataFrame, series: DataFrame, as_of: Column, sure: float = 0.55) -> DataFrame:
    """The ledger with ``is_recurring`` as the detected series say, and rows left unclassified put among subscriptions.

    A row of category OTHER is promoted if its merchant, taken by itself, pays
    as regularly and as evenly as a fixed series of confidence ``sure``.
    """
    plain = ledger.where(debit() & (F.col("category") == "OTHER"))
    hidden = detect(plain.withColumn("category", F.lit("SUBSCRIPTIONS")), as_of).where((F.col("confidence") >= sure) & (F.col("pattern") == "fixed")).select("user_id", "series", F.lit(True).alias("promoted"))
    flagged = members(ledger, series.where((F.col("direction") == "debit") & ~F.col("ended"))).withColumn("flag", F.lit(True))
    rows = ledger.withColumn("series", F.lower("merchant")).join(flagged, ["user_id", "id"], "left").join(hidden, ["user_id", "series"], "left")
    up = F.col("promoted").isNotNull() & debit() & (F.col("category") == "OTHER")
    rows = rows.withColumns({"is_recurring": F.col("flag").isNotNull() | up, "category": F.when(up, "SUBSCRIPTIONS").otherwise(F.col("category"))})
    return rows.select(*ledger.columns)


def upcoming(obligations: DataFrame, first: Column, last: Column) -> DataFrame:
    """(id, due) dates of manual obligations in a window.

    Weekly and biweekly ones count from their start, or from the first
    ``due_day`` (weekday 1 to 7, Monday by default) of the window; others fall
    on ``due_day`` (or the start's day), in phase with the start's month.
    """
    days = obligations.withColumn("due", F.explode(F.sequence(first, last)))
    step = F.when(F.col("frequency") == "weekly", 7).otherwise(14)
    weekday = F.when(F.col("due_day").between(1, 7), F.col("due_day")).otherwise(1)
    anchor = F.coalesce("start_date", F.date_add(first, F.pmod(weekday - (F.weekday(first) + 1), F.lit(7)).cast("int")))
    since = F.datediff("due", anchor)
    weekly = F.col("frequency").isin("weekly", "biweekly") & (since >= 0) & (since % step == 0)
    months = F.coalesce(*[F.when(F.col("frequency") == n, m) for n, m in MONTHS.items()])
    begins = F.coalesce("start_date", first)
    apart = (F.year("due") - F.year(begins)) * 12 + F.month("due") - F.month(begins)
    day = F.coalesce("due_day", F.dayofmonth(begins))
    by_month = months.isNotNull() & (F.pmod(apart, months) == 0) & (F.dayofmonth("due") == F.least(day, F.dayofmonth(F.last_day("due"))))
    return days.where(weekly | by_month).select("id", "due")


def projected(series: DataFrame, as_of: Column, last: Column, steps: int = 60) -> DataFrame:
    """Detected series' coming payments up to a day: from the next expected one, an overdue one on ``as_of``.

    The k-th date after the next is k intervals on; months keep to the day of the last payment.
    """
    day = F.dayofmonth("last_date")
    months = F.coalesce(*[F.when(F.col("frequency") == n, m) for n, m in MONTHS.items()])
    steps_ = series.where(~F.col("ended")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    later = F.when(months.isNotNull(), month_day(F.col("next_date"), F.col("k") * F.coalesce(months, F.lit(0)), day)).otherwise(F.date_add("next_date", (F.col("k") * _of(F.col("frequency"), 3)).cast("int")))
    due = F.when(F.col("k") == 0, F.col("next_date")).otherwise(later)
    rows = steps_.withColumn("due", due).where((F.col("due") <= last) & ((F.col("due") >= as_of) | F.col("overdue")))
    return rows.withColumns({"late": F.col("due") < as_of, "date": F.greatest("due", as_of)})


def same_obligation(series: DataFrame, manual: DataFrame) -> DataFrame:
    """The detected series (KEYS) that a manual obligation of the user describes too.

    By merchant key, by one name in the other, or by category, frequency and an
    amount within 15 % or 50. Both sides are few for each user.
    """
    s, m = series.alias("s"), manual.alias("m")
    mine, theirs = merchant_key(F.col("s.merchant")), merchant_key(F.col("m.name"))
    kind = F.when(F.col("s.direction") == "credit", "income").otherwise("expense")
    named = (theirs != "") & (mine.contains(theirs) | theirs.contains(mine))
    like = (F.col("m.category") == F.col("s.category")) & (F.col("m.frequency") == F.col("s.frequency")) & (F.abs(F.col("m.amount").cast("double") - F.col("s.average")) <= F.greatest(F.lit(50.0), 0.15 * F.col("s.average")))
    same = (F.col("s.user_id") == F.col("m.user_id")) & ((F.coalesce(F.col("m.merchant_key"), F.lit("")) == mine) | ((F.col("m.kind") == kind) & (named | like)))
    return s.join(m, same, "left_semi").select(*KEYS)


def own_series(frame: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Detected series that the user did not dismiss (user_id, merchant_key)."""
    return frame.withColumn("merchant_key", merchant_key(F.col("merchant"))).join(dismissed, ["user_id", "merchant_key"], "left_anti").select(*frame.columns)
