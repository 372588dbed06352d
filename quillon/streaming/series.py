"""The period series over a stream of ledger rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.expressions import credit, debit, total


def daily_flows(stream: DataFrame, time: str = "ts", late: str = "2 days") -> DataFrame:
    """Credits, debits and count by user and day; a day closes when the watermark passes it."""
    days = stream.withWatermark(time, late).groupBy("user_id", F.window(time, "1 day").alias("day"))
    sums = days.agg(F.count("*").alias("n"), total(F.col("amount"), credit()).alias("credit"), total(F.col("amount"), debit()).alias("debit"))
    return sums.select("user_id", F.to_date("day.start").alias("date"), "n", F.col("credit").cast("double").alias("credit"), F.col("debit").cast("double").alias("debit"))


def without_repeats(stream: DataFrame, time: str = "ts", late: str = "2 days") -> DataFrame:
    """A row per id within the watermark, for sources that send rows again."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["user_id", "id"])
