"""Queries over line items as a stream: what it has given once all files are read, for the days its watermark has closed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.ledger_queries import NETTED_SQL, query
from quillon.session import scratch, table
from quillon.sources import ledger as sources
from quillon.streaming import series, stateful


def closed(spark: SparkSession, d: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs ``make`` over the ledger as a stream of the table's files until there are no more; what it has written."""
    schema = table(spark, d, "lineitem").schema
    # a pattern, as a stream takes the table as one file only by a pattern; a folder of files is matched too
    items = spark.readStream.schema(schema).parquet(f"{d}/lineitem.parque[t]")
    made = make(sources.from_lineitem(spark, d, items).withColumn("ts", F.col("date").cast("timestamp")))
    folder = scratch(spark)
    made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{folder}/out")


# a day is closed when the watermark, two days behind the last row, has passed its end
query("str_daily_flows", "SELECT user_id, date, count(*) AS n, CAST(coalesce(sum(amount) FILTER (direction = 'credit'), 0) AS DOUBLE) AS credit, CAST(coalesce(sum(amount) FILTER (direction = 'debit'), 0) AS DOUBLE) AS debit FROM ledger WHERE date <= (SELECT max(date) FROM ledger) - 3 GROUP BY ALL")(
    lambda spark, d: closed(spark, d, series.daily_flows)
)
query("str_running_balance", "SELECT user_id, id, date, CAST(sum(CASE WHEN direction = 'credit' THEN amount ELSE -amount END) OVER (PARTITION BY user_id ORDER BY date, seq, id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS balance FROM ledger QUALIFY date <= (SELECT max(date) FROM ledger) - 3")(
    lambda spark, d: closed(spark, d, stateful.running_balance).select("user_id", "id", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int")).alias("date"), (F.col("balance") / 100).alias("balance"))
)
query("str_refund_links", "SELECT k.user_id, k.refund_id, k.debit_id FROM links k JOIN ledger r ON r.user_id = k.user_id AND r.id = k.refund_id WHERE r.date <= (SELECT max(date) FROM ledger WHERE direction = 'debit' OR category = 'REFUNDS') - 3", NETTED_SQL)(
    lambda spark, d: closed(spark, d, stateful.refund_links)
)
