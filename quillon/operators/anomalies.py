"""Unusual activity: each detector is windows and aggregates over all users.

Detectors take rows of refunds.linked() with ``is_recurring`` and a date. What
they learn from are net debits (purchases less their refunds) without
investments; a user with fewer than ``LEAST_ROWS`` of these has no findings.
Findings share one schema, FINDING, and unusual_activity() unites them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.expressions import debit, half_up, spending
from quillon.session import durable

# Thresholds, and categories of few large payments or of no spending.
Z = 3.5
LEAST_ROWS = 8
LUMPY = ("RENT", "BILLS", "UTILITIES", "EDUCATION", "INVESTMENTS", "SUBSCRIPTIONS")
NON_SPENDING = ("TRANSFERS", "INVESTMENTS")
SEVERITIES = {"high": 3, "medium": 2, "low": 1}
FINDING = ("user_id", "id", "type", "severity", "date", "observed", "baseline", "ratio", "score", "sample", "confidence", "merchant", "category", "txn_id")


def robust_z(x: Column, median: Column, mad: Column, floor: float = 0.05) -> Column:
    return (x - median) / F.greatest(mad / 0.6745, floor * median, F.lit(1.0))


def severity(z: Column, ratio: Column) -> Column:
    return F.when((z >= 8) | (ratio >= 6), "high").when((z >= 5) | (ratio >= 3.5), "medium").otherwise("low")


def confidence(n: Column, z: Column, most: float | Column = 0.95) -> Column:
    """From the size of the history and the strength of the finding, at most ``most``."""
    strength = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (z - Z) / 8))
    return half_up(F.least(most if isinstance(most, Column) else F.lit(most), 0.3 + 0.4 * F.least(F.lit(1.0), n / 30) + 0.25 * strength), 2)


def outliers(ledger: DataFrame, least: float = 1500.0) -> DataFrame:
    """The simple detector over gross spending: far above the category's median, else beyond Q3 + 3 IQR of the user.

    With six rows or more and a MAD, by a modified z of 3.5 and twice the
    median; with a MAD of 0, three times the median; all others by the fence.
    """
    amount = F.col("amount").cast("double")
    rows = ledger.where(spending()).select("user_id", "id", "category", amount.alias("x"))
    users = rows.groupBy("user_id").agg(F.count("*").alias("of_user"), F.percentile("x", F.lit(0.25)).alias("q1"), F.percentile("x", F.lit(0.75)).alias("q3"))
    groups = rows.groupBy("user_id", "category").agg(F.count("*").alias("n"), F.median("x").alias("median"))
    centred = rows.join(groups, ["user_id", "category"])
    mads = centred.groupBy("user_id", "category").agg(F.median(F.abs(F.col("x") - F.col("median"))).alias("mad"))
    all_ = centred.where(F.col("x") >= least).join(mads, ["user_id", "category"]).join(users, "user_id")
    x, median, mad, many = F.col("x"), F.col("median"), F.col("mad"), F.col("n") >= 6
    fence = x > F.col("q3") + 3 * (F.col("q3") - F.col("q1"))
    unusual = F.when(many & (mad > 0), (0.6745 * (x - median) / mad > Z) & (x >= 2 * median)).when(many & (mad == 0) & (x >= 3 * median) & (median > 0), True).otherwise(fence)
    return all_.where((F.col("of_user") >= LEAST_ROWS) & unusual).select("user_id", "id", "category", F.col("x").alias("amount"))


def population(linked: DataFrame, as_of: dt.date, lookback: int = 90) -> DataFrame:
    """Net debits with ``net``, ``everyday`` and ``recent`` flags and the first date of the user's ledger.

    linked: rows up to any date; the detectors look at the ``lookback`` days up to ``as_of``.
    """
    zero = F.lit(0).cast("decimal(18,2)")
    net = F.greatest(F.col("amount") - F.coalesce("refunded", zero), zero)
    counted = debit() & (F.col("category") != "INVESTMENTS") & (net > 0)
    users = linked.groupBy("user_id").agg(F.min("date").alias("first"), F.count_if(counted).alias("of_user")).where(F.col("of_user") >= LEAST_ROWS).select("user_id", "first")
    # a task's users, one row each and written once, are looked up: sorting the rows for that would take far more
    rows = linked.withColumns({"net": net.cast("double"), "counted": counted}).where("counted").join(durable(users).hint("shuffle_hash"), "user_id")
    everyday = ~F.col("category").isin(*NON_SPENDING, *LUMPY) & ~F.col("is_recurring")
    recent = F.col("date").between(F.lit(as_of - dt.timedelta(lookback - 1)), F.lit(as_of))
    return rows.select(
        "user_id", "id", "date", "merchant", "category", "is_recurring", F.col("amount").cast("double").alias("amount"), "net", "first",
        everyday.alias("everyday"), (~F.col("category").isin(*NON_SPENDING)).alias("spends"), recent.alias("recent"),
    )


def leave_one_out(rows: DataFrame, keys: list[str], value: str, wanted: Column | None = None) -> DataFrame:
    """``rows`` with ``peers``, the median of the group's other values and their MAD about it; of ``wanted`` rows only, if given.

    Without one value, the median is one of two or three that follow from the
    three ranks in the middle; the deviations from each are ranked in the same
    way. So no group's values are ever held together; Spark counts equal ones
    and sorts the rest, the deviations only from medians that wanted rows have.
    Values are not null.
    """

    def ranked(frame: DataFrame, by: list[str], of: str, prefix: str) -> DataFrame:
        group = Window.partitionBy(*by)
        i, many = F.col(f"{prefix}i"), F.col("_many")
        own = frame.withColumn(f"{prefix}i", F.sum("_many").over(group.orderBy(of).rowsBetween(Window.unboundedPreceding, 0))).withColumn(f"{prefix}n", F.sum("_many").over(group))
        rank = F.floor(F.col(f"{prefix}n") / 2)
        return own.withColumns({f"{prefix}{x}": F.max(F.when((i - many < rank + k) & (rank + k <= i), F.col(of))).over(group) for k, x in enumerate("abc")})

    def without(prefix: str) -> Column:
        n, i, a, b, c = (F.col(f"{prefix}{x}") for x in "niabc")
        half = F.floor(n / 2)
        return F.when(n % 2 == 0, F.when(i <= half, b).otherwise(a)).when(i <= half, (b + c) / 2).when(i == half + 1, (a + c) / 2).otherwise((a + b) / 2)

    # equal values share what is made of them: taking out any one of them leaves the same others
    asks = F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))
    values = rows.groupBy(*keys, value).agg(F.count("*").alias("_many"), F.max(asks).alias("_wanted"))
    first = ranked(values, keys, value, "_")
    n, half = F.col("_n"), F.floor(F.col("_n") / 2)
    mine = F.when(n % 2 == 0, F.when(F.col("_i") <= half, 0).otherwise(1)).otherwise(F.when(F.col("_i") <= half, 0).when(F.col("_i") == half + 1, 1).otherwise(2))
    medians = F.when(n % 2 == 0, F.array("_b", "_a")).otherwise(F.array((F.col("_b") + F.col("_c")) / 2, (F.col("_a") + F.col("_c")) / 2, (F.col("_a") + F.col("_b")) / 2))
    asked = F.collect_set(F.when(F.col("_wanted"), F.col("_mine"))).over(Window.partitionBy(*keys))
    first = first.withColumns({"_mine": mine, "median": without("_"), "peers": F.col("_n") - 1}).withColumns({"_asked": asked, "_medians": medians})
    each = first.where("peers > 0").select(*keys, value, "peers", "median", "_many", "_mine", "_wanted", "_medians", F.explode("_asked").alias("_which")).withColumn("_about", F.get("_medians", F.col("_which"))).where("_about IS NOT NULL").withColumn("_d", F.abs(F.col(value) - F.col("_about")))
    second = ranked(each, [*keys, "_which"], "_d", "d_").withColumn("mad", without("d_"))
    return rows.where(asks).join(second.where("_wanted AND _which = _mine").select(*keys, value, "peers", "median", "mad"), [*keys, value]).select(*rows.columns, "peers", "median", "mad")


def _of_users(rows: DataFrame, of: DataFrame) -> DataFrame:
    """The rows of users that ``of`` has, which are written once."""
    return rows.join(durable(of.select("user_id").distinct()).hint("shuffle_hash"), "user_id", "left_semi")


def _finding(rows: DataFrame, kind: str, key: Column, **columns: Column) -> DataFrame:
    given = {"baseline": half_up(F.col("median"), 2), "ratio": F.lit(None).cast("double"), "score": F.lit(None).cast("double"), "merchant": F.lit(None).cast("string"), "category": F.lit(None).cast("string"), "txn_id": F.lit(None).cast("string")} | columns
    values = {"user_id": F.col("user_id"), "id": F.concat_ws(":", F.lit(kind), key), "type": F.lit(kind), "sample": given.pop("sample").cast("long"), "observed": given.pop("observed").cast("double")} | given
    return rows.select(*(values[c].alias(c) for c in FINDING))


def large_transactions(people: DataFrame, least: float = 1000.0) -> DataFrame:
    """Payments far above the others of their category: z of 3.5 and twice the median of the peers.

    With under six peers the user's everyday payments stand in (ten at least),
    but not for categories of few large payments.
    """
    z, ratio = robust_z(F.col("net"), F.col("median"), F.col("mad")), half_up(F.col("net") / F.col("median"), 2)
    wanted = F.col("recent") & (F.col("net") >= least) & ~F.col("is_recurring")
    plain = people.where(~F.col("is_recurring")).drop("first")
    # categories of a user are few
    held = durable(plain.groupBy("user_id", "category").agg(F.count("*").alias("held"), F.max(wanted).alias("asks"), F.max(wanted & F.col("everyday")).alias("lacks")).where("asks"))
    own = leave_one_out(_of_users(plain, held.where("held > 6")), ["user_id", "category"], "net", wanted).where(F.col("peers") >= 6).withColumn("most", F.lit(0.95))
    lacking = held.where("lacks AND held <= 6").groupBy("user_id").agg(F.collect_set("category").alias("lacking"))
    lent = plain.where("everyday").join(lacking.hint("shuffle_hash"), "user_id")
    lent = leave_one_out(lent, ["user_id"], "net", wanted & F.array_contains("lacking", F.col("category"))).where(F.col("peers") >= 10).select(*plain.columns, "peers", "median", "mad").withColumn("most", F.lit(0.7))
    found = own.select(*plain.columns, "peers", "median", "mad", "most").union(lent).where((z >= Z) & (F.col("median") > 0) & (F.col("net") >= 2 * F.col("median")))
    return _finding(found, "large_transaction", F.col("id"), severity=severity(z, ratio), date=F.col("date"), observed=F.col("net"), ratio=ratio, score=half_up(z, 2), sample=F.col("peers"), confidence=confidence(F.col("peers"), z, F.col("most")), merchant=F.col("merchant"), category=F.col("category"), txn_id=F.col("id"))


def frequent_payments(people: DataFrame) -> DataFrame:
    """Merchants paid at least four times in seven days and three times their weekly mean before, by a Poisson-like z of 3; each one's best week."""
    merchant = Window.partitionBy("user_id", "merchant")
    own = merchant.orderBy(F.datediff("date", F.lit("1970-01-01")))
    least = F.greatest("mean", F.lit(0.5))
    z = (F.col("week") - F.col("mean")) / F.sqrt(least)

    def hits_of(days: DataFrame) -> DataFrame:
        seen = days.withColumns({"week": F.sum("n").over(own.rangeBetween(-6, 0)), "so_far": F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, 0)), "since": F.min("date").over(merchant)})
        rated = seen.withColumn("weeks", F.floor((F.datediff("date", "since") - 6) / 7)).where("recent AND weeks >= 3").withColumn("mean", (F.col("so_far") - F.col("week")) / F.col("weeks"))
        return rated.where((F.col("week") >= 4) & (F.col("week") >= 3 * least) & (z >= 3))

    rows, counts = people.where(~F.col("merchant").startswith("Unidentified")), (F.count("*").alias("n"), F.max("recent").alias("recent"))
    # counts alone tell whose payments are looked at as a whole
    rows = _of_users(rows, hits_of(rows.groupBy("user_id", "merchant", "date").agg(*counts)))
    days = rows.groupBy("user_id", "merchant", "date").agg(*counts, F.max("id").alias("last"), F.min(F.struct("date", "id", "category")).alias("one"))
    hits = hits_of(days.withColumn("category", F.min("one").over(merchant)["category"]))
    best = hits.withColumn("nth", F.row_number().over(merchant.orderBy(F.desc("week"), "date"))).where("nth = 1").withColumn("median", F.col("mean"))
    ratio = half_up(F.col("week") / least, 2)
    return _finding(best, "frequent_transactions", F.concat_ws(":", F.lower("merchant"), F.col("date").cast("string")), severity=severity(z + 2, ratio), date=F.col("date"), observed=F.col("week"), ratio=ratio, score=half_up(z, 2), sample=F.col("weeks"), confidence=confidence(F.col("weeks") * 2, z + 1, 0.85), merchant=F.col("merchant"), category=F.col("category"), txn_id=F.col("last"))


def _middle(values: Column) -> Column:
    """The median of a short array."""
    ordered, n = F.array_sort(values), F.size(values)
    return (F.element_at(ordered, F.floor((n + 1) / 2).cast("int")) + F.element_at(ordered, F.floor(n / 2 + 1).cast("int"))) / 2


def window_spikes(people: DataFrame, key: str | None, as_of: dt.date, days: int, windows: int, base: int, ratio: float, least: float, kind: str, per_window: int) -> DataFrame:
    """The last ``days`` of spending far above the median of the windows of that length before, by key or in all.

    Only windows that the user's ledger covers count, ``base`` at least, empty
    ones as 0. A window is a conditional sum, so it is one aggregate.
    """
    keys = ["user_id", *([key] if key else [])]
    at = F.floor(F.datediff(F.lit(as_of), "date") / days)
    rows = people.where(F.col("date") <= F.lit(as_of))
    top = F.struct((-F.col("net")).alias("net"), F.col("date").alias("date"), F.col("id").alias("id"))
    full = F.least(F.floor((F.datediff(F.lit(as_of), "first") + 1) / days) - 1, F.lit(windows)).cast("int")
    z, times = robust_z(F.col("x0"), F.col("median"), F.col("mad"), 0.25), half_up(F.col("x0") / F.col("median"), 2)

    def spikes_of(rows: DataFrame, *more: Column) -> DataFrame:
        sums = rows.groupBy(*keys).agg(F.min("first").alias("first"), *more, *(F.coalesce(F.sum(F.when(at == k, F.col("net").cast("decimal(18,2)"))).cast("double"), F.lit(0.0)).alias(f"x{k}") for k in range(windows + 1)))
        kept = sums.withColumn("full", full).where(F.col("full") >= base).withColumn("before", F.slice(F.array(*(f"x{k}" for k in range(1, windows + 1))), F.lit(1), F.col("full")))
        kept = kept.withColumn("median", _middle(F.col("before"))).withColumn("mad", _middle(F.transform("before", lambda v: F.abs(v - F.col("median"))))).where("median > 0")
        if key == "merchant":
            kept = kept.where(~F.col("merchant").startswith("Unidentified"))
        elif key == "category":
            kept = kept.where(~F.col("category").isin(*LUMPY))
        return kept.where((z >= Z) & (times >= ratio) & (F.col("x0") - F.col("median") >= least))

    # sums alone tell whose payments are looked at as a whole
    found = spikes_of(_of_users(rows, spikes_of(rows)), F.min(F.struct("date", "id", "category")).alias("one"), F.min(F.when(at == 0, top)).alias("top"))
    if key == "merchant":
        found = found.where(~F.col("one.category").isin(*LUMPY))
    names = {"merchant": F.col("merchant"), "category": F.col("one.category")} if key == "merchant" else {"category": F.col("category")} if key else {}
    label = F.concat_ws(":", *([F.lower(key)] if key else []), F.lit(str(as_of)))
    return _finding(found, kind, label, severity=severity(z, times), date=F.lit(as_of), observed=half_up(F.col("x0"), 2), ratio=times, score=half_up(z, 2), sample=F.col("full"), confidence=confidence(F.col("full") * per_window, z, 0.85), txn_id=F.col("top.id"), **names)


def merchant_spikes(people: DataFrame, as_of: dt.date, least: float = 1000.0) -> DataFrame:
    return window_spikes(people.where("spends AND NOT is_recurring"), "merchant", as_of, 30, 6, 3, 1.75, least, "merchant_spike", 5)


def category_spikes(people: DataFrame, as_of: dt.date, least: float = 1000.0) -> DataFrame:
    return window_spikes(people.where("spends AND NOT is_recurring"), "category", as_of, 30, 6, 3, 1.75, least, "category_spike", 5)


def weekly_spikes(people: DataFrame, as_of: dt.date, least: float = 1000.0) -> DataFrame:
    return window_spikes(people.where("everyday"), None, as_of, 7, 8, 4, 1.8, 2 * least, "spending_spike", 4)


def unusual_days(people: DataFrame, large: DataFrame, least: float = 1000.0) -> DataFrame:
    """Everyday spending of a day 2.5 times the median of the user's other days and 3.5 deviations off.

    A day whose largest payment is 70 % of it and was reported in ``large`` is left out.
    """
    rows, spent = people.where("everyday"), F.sum(F.col("net").cast("decimal(18,2)")).cast("double").alias("total")
    high = F.col("total") >= 2 * least
    rows = _of_users(rows, rows.where("recent").groupBy("user_id", "date").agg(spent).where(high))
    days = rows.groupBy("user_id", "date").agg(spent, F.max("recent").alias("recent"))
    rated = leave_one_out(days, ["user_id"], "total", F.col("recent") & high).where(F.col("peers") >= 9)
    z, ratio = robust_z(F.col("total"), F.col("median"), F.col("mad"), 0.25), half_up(F.col("total") / F.col("median"), 2)
    unusual = durable(rated.where((z >= Z) & (F.col("total") >= 2.5 * F.col("median"))))
    # a user's unusual days are at most those of the lookback
    dates = unusual.groupBy("user_id").agg(F.collect_set("date").alias("dates"))
    tops = rows.join(dates.hint("shuffle_hash"), "user_id").where(F.array_contains("dates", F.col("date"))).groupBy("user_id", "date").agg(F.min(F.struct((-F.col("net")).alias("net"), F.col("id").alias("id"))).alias("top"))
    unusual = unusual.join(tops, ["user_id", "date"])
    told = large.select(F.col("user_id").alias("l_user"), F.col("txn_id").alias("l_id"))
    alone = (F.col("user_id") == F.col("l_user")) & (F.col("top.id") == F.col("l_id")) & (-F.col("top.net") >= 0.7 * F.col("total"))
    kept = unusual.join(told, alone, "left_anti")
    return _finding(kept, "unusual_day", F.col("date").cast("string"), severity=severity(z, ratio), date=F.col("date"), observed=half_up(F.col("total"), 2), ratio=ratio, score=half_up(z, 2), sample=F.col("peers"), confidence=confidence(F.col("peers"), z, 0.9), txn_id=F.col("top.id"))


def possible_duplicates(people: DataFrame, least: float = 100.0) -> DataFrame:
    """Payments of one day, merchant and gross amount that occur more than once."""
    rows = people.where(F.col("recent") & (F.col("net") >= least) & ~F.col("merchant").startswith("Unidentified"))
    sizes = people.groupBy("user_id").agg(F.count("*").alias("all_rows"))
    groups = rows.groupBy("user_id", "date", F.lower("merchant").alias("key"), "amount").agg(F.count("*").alias("n"), F.min(F.struct("id", "merchant", "category")).alias("one")).where("n >= 2").join(sizes, "user_id")
    amount = F.col("amount")
    label = F.concat_ws("|", F.col("date").cast("string"), F.col("key"), amount.cast("decimal(18,2)").cast("string"))
    return _finding(groups.withColumn("median", F.lit(1.0)), "possible_duplicate", label, severity=F.when(amount >= 5000, "medium").otherwise("low"), date=F.col("date"), observed=F.col("n"), ratio=F.col("n").cast("double"), sample=F.col("all_rows"), confidence=F.when(amount >= 1000, 0.6).otherwise(0.45), merchant=F.col("one.merchant"), category=F.col("one.category"), txn_id=F.col("one.id"))


def unusual_activity(linked: DataFrame, as_of: dt.date, lookback: int = 90, least: float = 1000.0) -> DataFrame:
    """All findings at a date with each user's ``place``: most severe, latest, largest first."""
    people = population(linked, as_of, lookback)
    large = large_transactions(people, least)
    found = large
    for more in (frequent_payments(people), merchant_spikes(people, as_of, least), category_spikes(people, as_of, least), unusual_days(people, large, least), weekly_spikes(people, as_of, least), possible_duplicates(people)):
        found = found.unionByName(more)
    rank = F.coalesce(*[F.when(F.col("severity") == s, k) for s, k in SEVERITIES.items()])
    return found.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(rank.desc(), F.desc("date"), F.desc("observed"), "id")))


def badges(findings: DataFrame) -> DataFrame:
    """(user_id, txn_id, severity): the strongest finding of each payment, to mark it where payments are listed."""
    rank = F.coalesce(*[F.when(F.col("severity") == s, k) for s, k in SEVERITIES.items()])
    return findings.where("txn_id IS NOT NULL").groupBy("user_id", "txn_id").agg(F.max_by("severity", rank).alias("severity"))
