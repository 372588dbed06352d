"""Column expressions of the ledger: predicates, periods, rounding, text keys.

All are built-in Spark functions, so they stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def credit() -> Column:
    return F.col("direction") == "credit"


def debit() -> Column:
    return F.col("direction") == "debit"


def income() -> Column:
    return credit() & (F.col("category") == "SALARY/INCOME")


def refund() -> Column:
    return credit() & (F.col("category") == "REFUNDS")


def spending() -> Column:
    return debit() & ~F.col("category").isin("TRANSFERS", "INVESTMENTS")


def on() -> Column:
    return F.col("date")


def amount() -> Column:
    return F.col("amount")


def total(value: Column, when: Column | None = None) -> Column:
    """The sum of a money column, 0 if there is none."""
    return F.coalesce(F.sum(value if when is None else F.when(when, value)), F.lit(0).cast("decimal(28,2)"))


def half_up(x: Column, places: int) -> Column:
    """Rounding with halves toward plus infinity."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / scale


def percent(part: Column, whole: Column) -> Column:
    """part of whole in percent to one place; 0 where the whole is not positive."""
    return F.when(whole > 0, half_up(part.cast("double") / whole.cast("double") * 100, 1)).otherwise(F.lit(0.0))


def month_start(day: Column, first: int = 1) -> Column:
    """A date in the financial month of ``day``, whose months begin on day ``first`` (1 to 28)."""
    return F.when(F.dayofmonth(day) >= first, day).otherwise(F.add_months(day, -1))


def bucket(day: Column, grain: str, first: int = 1) -> Column:
    """The key of the period that holds ``day``; financial months shift months and quarters only."""
    shifted = month_start(day, first)
    if grain == "daily":
        return F.date_format(day, "yyyy-MM-dd")
    if grain == "weekly":
        return F.concat(F.year(F.date_add(day, 3 - F.weekday(day))).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    if grain == "monthly":
        return F.date_format(shifted, "yyyy-MM")
    if grain == "quarterly":
        return F.concat(F.year(shifted).cast("string"), F.lit("-Q"), F.quarter(shifted).cast("string"))
    if grain == "yearly":
        return F.year(day).cast("string")
    raise ValueError(f"unknown period {grain!r}")


def month_day(day: Column, months: Column | int, preferred: Column) -> Column:
    """``months`` later, on day ``preferred`` of that month or its last day."""
    moved = F.trunc(F.add_months(day, months), "month")
    return F.date_add(moved, F.least(preferred, F.dayofmonth(F.last_day(moved))) - 1)


def merchant_key(name: Column) -> Column:
    """Upper-case letters and digits, at most 40."""
    return F.substring(F.regexp_replace(F.upper(name), "[^A-Z0-9]+", ""), 1, 40)


def narration_key(text: Column) -> Column:
    """Upper case, other characters to single blanks."""
    return F.trim(F.regexp_replace(F.upper(text), "[^A-Z0-9]+", " "))


def parse_amount(text: Column) -> tuple[Column, Column]:
    """(magnitude, sign hint 1 or -1) of a printed amount; null if it is none.

    Takes thousands commas, rupee marks, parentheses, a leading minus and Cr/Dr.
    """
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)(?:rs\.?|inr|₹)", ""), r"[,\s]", ""))
    digits = F.regexp_extract(bare, r"^[(+-]*([0-9]+(?:\.[0-9]+)?|\.[0-9]+)\)?(?i:cr|dr)?\.?$", 1)
    value = F.nullif(digits, F.lit("")).try_cast("decimal(18,2)")
    minus = bare.startswith("-") | bare.startswith("(") | F.lower(bare).endswith("dr")
    return value, F.when(value.isNotNull(), F.when(minus, -1).otherwise(1))


MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def parse_date(text: Column) -> Column:
    """A statement's date, null if it is no real day: day, month as a number or a name, year; or year-month-day.

    Two-digit years from 70 are 19xx. Of a month's name the first three letters count.
    """
    clean = F.trim(F.replace(text, F.lit(","), F.lit("")))
    numbers, names = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{2}|\d{4})$", r"^(\d{1,2})[\s\-/]([A-Za-z]{3,9})[\s\-/]*(\d{2}|\d{4})$"
    at = F.instr(F.lit(MONTHS), F.lower(F.substring(F.regexp_extract(clean, names, 2), 1, 3)))
    month = F.when(clean.rlike(numbers), F.regexp_extract(clean, numbers, 2)).when(clean.rlike(names) & (at % 3 == 1), ((at + 2) / 3).cast("int").cast("string"))
    part = lambda i: F.when(clean.rlike(numbers), F.regexp_extract(clean, numbers, i)).otherwise(F.regexp_extract(clean, names, i))
    short = part(3)
    year = F.when(F.length(short) == 4, short).when(short >= "70", F.concat(F.lit("19"), short)).otherwise(F.concat(F.lit("20"), short))
    day_first = F.when(month.isNotNull(), F.try_to_date(F.concat_ws("-", year, month, part(1)), "yyyy-M-d"))
    return F.coalesce(day_first, F.when(clean.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(clean, "yyyy-MM-dd")))


def masked(text: Column) -> Column:
    """Mail addresses, payment handles, bank codes and runs of nine or more digits made unreadable."""
    out = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z.]{2,}", "[email]")
    out = F.regexp_replace(out, r"[A-Za-z0-9._-]{2,}@[A-Za-z]{2,}", "[handle]")
    out = F.regexp_replace(out, r"\b[A-Z]{4}0[A-Z0-9]{6}\b", "[code]")
    return F.regexp_replace(out, r"\d{9,}", "[number]")


def csv_cell(value: Column) -> Column:
    """A cell that no spreadsheet takes for a formula, quoted where it must be."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    guarded = F.when(text.rlike(r"^[=+\-@\t\r]") & ~text.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(guarded.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(guarded)
