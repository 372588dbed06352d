"""The transaction explorer: filters, sorting, pages, totals, options, exports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.expressions import credit, csv_cell, debit, spending, total
from quillon.operators.aggregates import money

#: The columns that free text is looked for in.
TEXTS = ("description", "merchant", "subcategory", "reference")
SORTS = ("date", "amount", "merchant", "category")


@dataclass(frozen=True)
class Filter:
    """What a page shows; everything given must hold."""

    text: str | None = None
    first: dt.date | None = None
    last: dt.date | None = None
    category: str | None = None
    merchant: str | None = None
    direction: str | None = None
    least: float | None = None
    most: float | None = None
    subcategory: str | None = None
    statement: str | None = None
    review: bool = False  # only rows that are marked for review or classified with little confidence
    flag: str | None = None  # refund, recurring or moved
    basis: str = "date"  # or value: the value date where there is one

    def column(self, columns: Sequence[str] = TEXTS) -> Column:
        """The condition; columns: those the ledger has, where it lacks some that text is looked for in."""
        parts = [F.lit(True)]
        if self.text:  # literal text in any of these, whatever its case
            parts.append(F.coalesce(*[F.nullif(F.contains(F.lower(c), F.lower(F.lit(self.text))), F.lit(False)) for c in TEXTS if c in columns], F.lit(False)))
        if self.basis not in ("date", "value"):
            raise ValueError(f"no such basis: {self.basis!r}")
        day = F.col("date") if self.basis == "date" else F.coalesce("value_date", "date")
        if self.first:
            parts.append(day >= F.lit(self.first))
        if self.last:
            parts.append(day <= F.lit(self.last))
        if self.subcategory:
            parts.append(F.col("subcategory") == self.subcategory)
        if self.statement:
            parts.append(F.col("statement_id") == self.statement)
        if self.review:
            parts.append(F.col("confidence") < 0.6)
        if self.flag:
            parts.append({"refund": credit() & (F.col("category") == "REFUNDS"), "recurring": F.col("is_recurring"), "moved": F.col("category").isin("TRANSFERS", "INVESTMENTS")}[self.flag])
        if self.category:
            parts.append(F.col("category") == self.category)
        if self.merchant:
            parts.append(F.lower("merchant") == self.merchant.lower())
        if self.direction:
            parts.append(F.col("direction") == self.direction)
        if self.least is not None:
            parts.append(F.col("amount") >= F.lit(self.least).cast("decimal(18,2)"))
        if self.most is not None:
            parts.append(F.col("amount") <= F.lit(self.most).cast("decimal(18,2)"))
        out = parts[0]
        for part in parts[1:]:
            out = out & part
        return out


def page(ledger: DataFrame, wanted: Filter, sort: str = "date", descending: bool = True, number: int = 1, size: int = 50) -> DataFrame:
    """One page; at most 200 rows, stable by id. Spark keeps only the first number * size rows of each task."""
    if sort not in SORTS:
        raise ValueError(f"can't sort by {sort!r}")
    size = min(size, 200)
    order = [F.col(sort).desc() if descending else F.col(sort).asc(), F.col("id").asc()]
    return ledger.where(wanted.column(ledger.columns)).orderBy(*order).offset((number - 1) * size).limit(size)


def totals(ledger: DataFrame, wanted: Filter) -> DataFrame:
    return ledger.where(wanted.column(ledger.columns)).agg(F.count("*").alias("n"), total(F.col("amount"), debit()).cast("double").alias("debit"), total(F.col("amount"), credit()).cast("double").alias("credit"))


def merchant_options(ledger: DataFrame, n: int = 500) -> DataFrame:
    """Each user's most frequent merchants."""
    counts = ledger.groupBy("user_id", "merchant").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "merchant"))
    return counts.withColumn("place", place).where(F.col("place") <= n)


def data_range(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("user_id").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n"), (F.datediff(F.max("date"), F.min("date")) + 1).alias("days"))


def csv_rows(ledger: DataFrame) -> DataFrame:
    """Cells of the transactions export; amounts are blank on the side that has none."""
    text = F.col("amount").cast("string")
    cells = [F.col("date").cast("string"), F.col("merchant"), F.col("category"), F.col("subcategory"), F.when(debit(), text).otherwise(""), F.when(credit(), text).otherwise("")]
    return ledger.select("id", F.concat_ws(",", *[csv_cell(c) for c in cells]).alias("line"))


def export(ledger: DataFrame, wanted: Filter, most: int = 200_000) -> DataFrame:
    """The rows of an export, newest first, capped as the export is."""
    return ledger.where(wanted.column(ledger.columns)).orderBy(F.desc("date"), F.desc("seq"), "id").limit(most)


def with_source(ledger: DataFrame, source: str) -> DataFrame:
    """The rows of payments that ``source`` tells of, whichever source the row itself is from."""
    told = ledger.where(F.col("source") == source).select("user_id", "event_id").distinct()
    return ledger.join(told, ["user_id", "event_id"], "left_semi")


def listed(ledger: DataFrame) -> DataFrame:
    """Each row with the sources that tell of its payment, in order."""
    sources = ledger.groupBy("user_id", "event_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return ledger.join(sources, ["user_id", "event_id"]).select("id", "date", "merchant", money("amount"), "source", "sources")


def category_tree(ledger: DataFrame) -> DataFrame:
    """Categories in use with their subcategories, for the filter's options."""
    return ledger.groupBy("category").agg(F.array_join(F.array_sort(F.collect_set("subcategory")), ";").alias("subcategories"), F.count("*").alias("n"))


def scatter(ledger: DataFrame, outliers: DataFrame, most: int = 600) -> DataFrame:
    """The newest spending rows of each user with a mark on outliers (user_id, id)."""
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("date"), F.desc("seq"), "id"))
    rows = ledger.where(spending()).withColumn("nth", newest).where(F.col("nth") <= most)
    marks = outliers.select("user_id", "id", F.lit(True).alias("marked"))
    return rows.join(marks, ["user_id", "id"], "left").select("user_id", "id", "date", money("amount"), F.coalesce("marked", F.lit(False)).alias("outlier"))
