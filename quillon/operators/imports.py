"""Statement imports: duplicates, events of several sources, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.expressions import credit, debit, merchant_key, total


def dedupe_key(*columns: Column) -> Column:
    """A 40-digit key of a row's content."""
    return F.substring(F.sha2(F.concat_ws("|", *[c.cast("string") for c in columns]), 256), 1, 40)


def occurrences(rows: DataFrame, *base: str) -> DataFrame:
    """Numbers rows of equal content from 0 in order of their id, so that true repeats keep different keys."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*base).orderBy("id")) - 1)


def new_rows(batch: DataFrame, ledger: DataFrame, *key: str) -> DataFrame:
    """The rows of a batch whose key the ledger doesn't hold; append them to it."""
    return batch.join(ledger.select(*key).distinct(), list(key), "left_anti")


def known_rows(batch: DataFrame, ledger: DataFrame, *key: str) -> DataFrame:
    return batch.join(ledger.select(*key).distinct(), list(key), "left_semi")


def overlapping(statements: DataFrame) -> DataFrame:
    """Pairs of one user's statements (id, first, last) whose periods overlap, by month buckets rather than a nested loop."""
    months = statements.withColumn("month", F.explode(F.sequence(F.trunc("first", "month"), F.trunc("last", "month"), F.expr("interval 1 month"))))
    a, b = months.alias("a"), months.alias("b")
    met = a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.month") == F.col("b.month")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.first") <= F.col("b.last")) & (F.col("a.last") >= F.col("b.first")))
    return met.select(F.col("a.user_id").alias("user_id"), F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def rows_held(statements: DataFrame, ledger: DataFrame) -> DataFrame:
    """user_id, id, held: the ledger's rows within each statement's period (first, last), 0 for none.

    Rows are counted by day first, and days meet periods by month.
    """
    days = ledger.groupBy("user_id", "date").agg(F.count("*").alias("n")).withColumn("month", F.trunc("date", "month"))
    months = statements.withColumn("month", F.explode(F.sequence(F.trunc("first", "month"), F.trunc("last", "month"), F.expr("interval 1 month"))))
    met = months.join(days, ["user_id", "month"]).where("date BETWEEN first AND last").groupBy("user_id", "id").agg(F.sum("n").alias("held"))
    return statements.select("user_id", "id").join(met, ["user_id", "id"], "left").na.fill(0, ["held"])


def lookalikes(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of two sources with one direction, amount and merchant key at most a day apart, unique both ways: possible copies.

    ``has_id`` (optional column): rows that carry a payment id; of a pair, one at least has none.
    """
    def keyed(frame: DataFrame, name: str) -> DataFrame:
        has_id = F.col("has_id") if "has_id" in frame.columns else F.lit(False)
        return frame.select("user_id", "direction", "amount", merchant_key(F.col("merchant")).alias("key"), F.col("id").alias(name), F.col("date").alias(f"{name}_date"), has_id.alias(f"{name}_has"))

    near = keyed(incoming, "incoming").withColumn("day", F.explode(F.sequence(F.date_sub("incoming_date", 1), F.date_add("incoming_date", 1))))
    met = near.join(keyed(existing, "existing").withColumn("day", F.col("existing_date")), ["user_id", "direction", "amount", "key", "day"]).where("NOT (incoming_has AND existing_has)")
    counts = met.withColumns({"a": F.count("*").over(Window.partitionBy("user_id", "incoming")), "b": F.count("*").over(Window.partitionBy("user_id", "existing"))})
    return counts.where("a = 1 AND b = 1").select("user_id", "incoming", "existing")


def id_keys(*texts: Column) -> Column:
    """Distinct runs of 10 to 20 digits in the texts, without leading zeros, of ten digits at least."""
    runs = F.regexp_extract_all(F.concat_ws(" ", *texts), F.lit(r"(\d{10,20})"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(runs, lambda r: F.ltrim(r, F.lit("0"))), lambda r: F.length(r) >= 10))


def primaries(rows: DataFrame, priority: dict[str, int]) -> DataFrame:
    """One primary row per event (user_id, event_id): the source of highest priority, then the smallest id."""
    rank = F.coalesce(*[F.when(F.col("source") == s, p) for s, p in priority.items()], F.lit(99))
    first = F.row_number().over(Window.partitionBy("user_id", "event_id").orderBy(rank, "id"))
    return rows.withColumn("is_primary", first == 1)


def available(existing: DataFrame, claimed: DataFrame, separated: DataFrame, source: str) -> DataFrame:
    """Rows that a row of ``source`` may match: of no payment that has this source, not claimed and not set apart by the user (user_id, id)."""
    own = existing.where(F.col("source") == source).select("user_id", "event_id").distinct()
    return existing.join(own, ["user_id", "event_id"], "left_anti").join(claimed.select("user_id", "id"), ["user_id", "id"], "left_anti").join(separated.select("user_id", "id"), ["user_id", "id"], "left_anti")


def near_rows(batch: DataFrame, ledger: DataFrame, source: str, days: int = 3) -> DataFrame:
    """Ledger rows of other sources within ``days`` days of the batch's span, by user."""
    spans = batch.groupBy("user_id").agg(F.date_sub(F.min("date"), days).alias("from_day"), F.date_add(F.max("date"), days).alias("to_day"))
    return ledger.where(F.col("source") != source).join(spans, "user_id").where("date BETWEEN from_day AND to_day").drop("from_day", "to_day")


def provenance(rows: DataFrame, statements: DataFrame) -> DataFrame:
    """All rows of each payment with their statement (statement_id, name), the primary row first."""
    place = F.row_number().over(Window.partitionBy("user_id", "event_id").orderBy(F.desc("is_primary"), "id"))
    return rows.join(statements, "statement_id", "left").withColumn("place", place)


def preview(batch: DataFrame) -> DataFrame:
    """Counters of an import before it is confirmed: rows, duplicates, directions, bands of confidence, totals.

    batch: ledger rows with ``confidence``, ``is_duplicate`` and ``needs_review``.
    """
    fresh = ~F.col("is_duplicate")
    sure = F.col("confidence")
    return batch.groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(fresh).alias("fresh"), F.count_if("is_duplicate").alias("duplicates"), F.count_if(fresh & debit()).alias("debits"), F.count_if(fresh & credit()).alias("credits"),
        F.count_if(fresh & (F.col("category") == "REFUNDS")).alias("refunds"), F.count_if(fresh & (F.col("category") == "TRANSFERS")).alias("transfers"), F.count_if(fresh & F.col("is_recurring")).alias("recurring"),
        F.count_if(fresh & F.col("needs_review")).alias("review"), F.count_if(fresh & (sure >= 0.8)).alias("high"), F.count_if(fresh & (sure >= 0.6) & (sure < 0.8)).alias("medium"), F.count_if(fresh & (sure < 0.6)).alias("low"),
        F.countDistinct(F.when(fresh, F.lower("merchant"))).alias("merchants"), total(F.col("amount"), fresh & debit()).cast("double").alias("debit"), total(F.col("amount"), fresh & credit()).cast("double").alias("credit"), F.min("date").alias("first"), F.max("date").alias("last"),
    )


def merchant_counts(ledger: DataFrame) -> DataFrame:
    """How many debits each user has at each merchant key."""
    return ledger.where(debit()).groupBy("user_id", merchant_key(F.col("merchant")).alias("key")).agg(F.count("*").alias("n"))
