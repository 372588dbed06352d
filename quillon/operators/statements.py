"""Statement rows before they become transactions: typing, repair by balances, reconciliation with what is printed.

Rows carry ``statement_id`` and ``row_index``; a statement is the unit of every
window and sum, and statements are many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.expressions import parse_amount, parse_date

TOLERANCE = 0.011
#: At most so many uncertain amounts are tried for a gap, as sums of all their subsets are.
SUBSET = 16


def typed(raw: DataFrame) -> DataFrame:
    """Printed cells as values: date, value_date, debit, credit, balance, with warnings; rows without a real date go.

    raw: statement_id, row_index, date, value_date, narration, reference,
    withdrawal, deposit, balance, all printed text.
    """
    debit, _ = parse_amount(F.col("withdrawal"))
    credit, _ = parse_amount(F.col("deposit"))
    balance, _ = parse_amount(F.col("balance"))
    zero = F.lit(0).cast("decimal(18,2)")
    d, c = F.coalesce(debit, zero), F.coalesce(credit, zero)
    value = parse_date(F.col("value_date"))
    told = F.coalesce(F.trim("value_date"), F.lit("")) != ""
    warnings = F.filter(
        F.array(
            F.when((d > 0) & (c > 0), "Both debit and credit present in one row"), F.when((d == 0) & (c == 0), "No amount found in row"), F.when(told & value.isNull(), "Value date could not be read"),
        ),
        lambda w: w.isNotNull(),
    )
    overdrawn = F.lower(F.trim("balance")).endswith("dr")
    rows = raw.select(
        "statement_id", "row_index", parse_date(F.col("date")).alias("date"), value.alias("value_date"), F.trim(F.regexp_replace("narration", r"\s+", " ")).alias("narration"), F.nullif(F.regexp_replace("reference", r"\s+", ""), F.lit("")).alias("reference"),
        d.alias("debit"), c.alias("credit"), F.when(overdrawn, -balance).otherwise(balance).cast("decimal(18,2)").alias("balance"), warnings.alias("warnings"),
    )
    return rows.where("date IS NOT NULL")


def repaired(rows: DataFrame, openings: DataFrame | None = None) -> DataFrame:
    """Debit and credit as the running balances prove them: a side corrected, or a missing amount inferred, each with a warning.

    openings: (statement_id, opening). The balance before a row is the last one known.
    """
    before = F.last("balance", ignorenulls=True).over(Window.partitionBy("statement_id").orderBy("row_index").rowsBetween(Window.unboundedPreceding, -1))
    held = rows if openings is None else rows.join(openings, "statement_id", "left")
    held = held.withColumn("prior", before if openings is None else F.coalesce(before, F.col("opening")))
    delta = F.col("balance") - F.col("prior")
    amount = F.when(F.col("debit") > 0, F.col("debit")).otherwise(F.col("credit"))
    off = F.coalesce(F.abs(delta - (F.col("credit") - F.col("debit"))) > TOLERANCE, F.lit(False))
    side = off & (amount > 0) & (F.abs(F.abs(delta) - amount) < TOLERANCE)
    missing = off & (amount == 0) & (delta != 0)
    zero = F.lit(0).cast("decimal(18,2)")
    size = F.when(side, amount).otherwise(F.abs(delta)).cast("decimal(18,2)")
    put = lambda mine, up: F.when(side | missing, F.when((delta > 0) == F.lit(up), size).otherwise(zero)).otherwise(F.col(mine))
    told = F.when(side, F.array(F.lit("Debit/credit side corrected using running balance"))).when(missing, F.array(F.lit("Amount inferred from balance change"))).otherwise(F.array().cast("array<string>"))
    return held.withColumns({"new_debit": put("debit", False), "new_credit": put("credit", True), "warnings": F.concat("warnings", told)}).select(*(F.col(f"new_{c}").alias(c) if c in ("debit", "credit") else F.col(c) for c in rows.columns))


def reconcile(rows: DataFrame, printed: DataFrame) -> DataFrame:
    """Each statement against its printed summary: seven checks, the balance chain, and a status.

    printed: (statement_id, opening_balance, debit_count, credit_count,
    total_debits, total_credits, closing_balance). Without a summary only the
    chain is checked; the opening then follows from the first known balance.
    """
    order = Window.partitionBy("statement_id").orderBy("row_index")
    known = F.col("balance").isNotNull()
    signed = F.col("credit") - F.col("debit")
    met = rows.join(printed, "statement_id", "left")
    first = F.first(F.when(known, F.col("balance") - signed), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = F.last("balance", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    chained = met.withColumn("opening", F.coalesce("opening_balance", first)).withColumn("prior", F.coalesce(before, F.col("opening")))
    broken = known & F.coalesce(F.abs(F.col("prior") + signed - F.col("balance")) > TOLERANCE, F.lit(False))
    corrected = F.exists("warnings", lambda w: w.contains("side corrected"))
    zero = F.lit(0).cast("decimal(28,2)")
    total = lambda c: F.coalesce(F.sum(c), zero)
    sums = chained.groupBy("statement_id").agg(
        F.count_if(F.col("debit") > 0).alias("debits"), F.count_if(F.col("credit") > 0).alias("credits"), total("debit").alias("debit"), total("credit").alias("credit"), F.max_by("balance", F.when(known, F.col("row_index"))).alias("last_balance"),
        F.first("opening").alias("opening"), F.count_if(broken).alias("breaks"), F.count_if(known).alias("chained"), F.count_if(corrected).alias("corrections"),
        *(F.first(c).alias(c) for c in ("opening_balance", "debit_count", "credit_count", "total_debits", "total_credits", "closing_balance")),
    )
    near = lambda a, b: F.abs(F.col(a) - b) <= TOLERANCE
    checks = {
        "debit_count": F.col("debit_count") == F.col("debits"), "credit_count": F.col("credit_count") == F.col("credits"), "total_debits": near("total_debits", F.col("debit")), "total_credits": near("total_credits", F.col("credit")),
        "printed_identity": near("closing_balance", F.col("opening_balance") + F.col("total_credits") - F.col("total_debits")), "closing_from_rows": near("closing_balance", F.col("opening") + F.col("credit") - F.col("debit")), "last_row": near("closing_balance", F.col("last_balance")),
        "chain": F.when(F.col("chained") > 0, F.col("breaks") == 0),
    }
    failed = F.exists(F.array(*checks.values()), lambda ok: ok == False)  # noqa: E712
    status = F.when(F.coalesce(failed, F.lit(False)) | (F.col("corrections") > 0), "mismatch").when(F.col("closing_balance").isNotNull(), "reconciled").otherwise("no_summary")
    return sums.select("statement_id", *(c.alias(name) for name, c in checks.items()), "breaks", "corrections", status.alias("status"))


def _explains(amounts: Column, gap: Column) -> Column:
    """Whether some of the amounts sum to the gap, which is positive; in cents.

    The sums of all subsets of either half are held against each other, 256 and
    256 instead of 65,536 subsets of sixteen.
    """
    cents = F.transform(amounts, lambda a: F.round(a * 100).cast("long"))
    n = F.size(amounts)
    wanted = F.round(gap * 100).cast("long")

    def sums(part: Column) -> Column:
        return F.aggregate(part, F.array(F.lit(0).cast("long")), lambda so_far, a: F.concat(so_far, F.transform(so_far, lambda s: s + a)))

    half = F.floor(n / 2).cast("int")
    rest = F.transform(sums(F.slice(cents, F.lit(1), half)), lambda s: wanted - s)
    return F.when((n > 0) & (wanted > 0), F.arrays_overlap(rest, sums(F.slice(cents, half + 1, n - half)))).otherwise(False)


def reconcile_wallet(rows: DataFrame, printed: DataFrame) -> DataFrame:
    """Sent and received sums, without own transfers, against the printed ones (statement_id, sent, received).

    A gap that some of the possible own transfers explain exactly needs review; any other is a mismatch.
    """
    counted = F.coalesce(F.col("semantic") != "SELF_TRANSFER", F.lit(True))
    maybe = F.col("semantic") == "POSSIBLE_SELF_TRANSFER"
    side = lambda d: F.col("direction") == d
    amounts = lambda d: F.slice(F.transform(F.array_sort(F.collect_list(F.when(maybe & side(d), F.struct("row_index", F.col("amount").cast("double").alias("amount"))))), lambda s: s["amount"]), 1, SUBSET)
    total = lambda d: F.coalesce(F.sum(F.when(counted & side(d), F.col("amount"))), F.lit(0)).cast("double")
    sums = rows.groupBy("statement_id").agg(total("debit").alias("sent_sum"), total("credit").alias("received_sum"), amounts("debit").alias("out"), amounts("credit").alias("back"))
    met = sums.join(printed, "statement_id", "left")
    gaps = {"sent": F.col("sent_sum") - F.col("sent"), "received": F.col("received_sum") - F.col("received")}
    good = {k: F.abs(g) < 0.005 for k, g in gaps.items()}
    fine = good["sent"] | ((gaps["sent"] > 0) & _explains(F.col("out"), gaps["sent"]))
    fine &= good["received"] | ((gaps["received"] > 0) & _explains(F.col("back"), gaps["received"]))
    some = F.size("out") + F.size("back") > 0
    status = F.when(F.col("sent").isNull(), "no_summary").when(good["sent"] & good["received"], "reconciled").when(fine & some, "requires_review").otherwise("mismatch")
    return met.select("statement_id", "sent_sum", "received_sum", status.alias("status"))
