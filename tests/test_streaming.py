"""Streams give what batches give, however rows fall into micro-batches and however late they come within the watermark."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillon.operators import balance, refunds
from quillon.streaming import series, stateful

SCHEMA = "user_id long, id string, ts timestamp, seq int, direction string, amount decimal(18,2), category string, merchant string, balance_after decimal(18,2)"


#: A row far ahead, whose own day stays open.
END = (99, "end", dt.datetime(2030, 1, 1), 0, "debit", Decimal(1), "FOOD", "end", None)


def drawn(seed, n=160):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        back = rng.random() < 0.35
        at = dt.datetime(2026, 1, 1) + dt.timedelta(days=rng.randrange(150), hours=rng.randrange(24))
        printed = rng.choice([None, Decimal(rng.randrange(3)), Decimal(rng.randrange(3))])
        rows.append((rng.randrange(3), f"r{i:03}", at, rng.randrange(2), "credit" if back else "debit", Decimal(rng.randrange(1, 4)), "REFUNDS" if back else "FOOD", rng.choice(["Shop", "shop", "Cafe"]), printed))
    return rows


def streamed(spark, rows, folder, seed, late_days, make):
    """Runs over files of rows sorted by time up to ``late_days``, one file a micro-batch, until a row far ahead closes all days."""
    rng = random.Random(seed)
    rows = sorted(rows, key=lambda r: r[2] + dt.timedelta(days=rng.uniform(0, late_days)))
    cuts = [0, *sorted(rng.sample(range(1, len(rows)), 4)), len(rows)]
    parts = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    parts.append([END])
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/part={i:03}")
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/in/*")
    run = make(files).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    return [tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_running_balance_equals_batch(spark, tmp_path, seed):
    rows = drawn(seed)
    got = streamed(spark, rows, str(tmp_path), seed, 2, lambda s: stateful.running_balance(s, late="3 days"))
    ledger = spark.createDataFrame(rows, SCHEMA).withColumn("date", F.to_date("ts"))
    want = {(r.user_id, r.id): int(r.balance_after * 100) for r in balance.with_balance(ledger).collect()}
    assert {(u, i): b for u, i, _, b, _ in got} == want and len(got) == len(rows)
    breaks = {r.user_id: (r.n, r.breaks) for r in balance.chain_breaks(ledger).collect()}
    assert {u: (sum(g[0] == u and g[4] is not None for g in got), sum(g[0] == u and bool(g[4]) for g in got)) for u in breaks} == breaks


@pytest.mark.parametrize("seed", [3, 4])
def test_refund_links_equal_batch(spark, tmp_path, seed):
    rows = drawn(seed)
    got = streamed(spark, rows, str(tmp_path), seed, 2, lambda s: stateful.refund_links(s, late="3 days"))
    want = {tuple(r) for r in refunds.greedy_links(spark.createDataFrame(rows, SCHEMA).withColumn("date", F.to_date("ts"))).collect()}
    assert set(got) == want and len(got) == len(want) > 20


def test_late_rows_are_dropped_and_repeats_too(spark, tmp_path):
    rows = drawn(5, 40)
    early = min(rows, key=lambda r: r[2])
    again = [(*early[:1], "late", *early[2:])]
    sent = sorted((r for r in rows if r is not early), key=lambda r: r[2])
    for i, part in enumerate([sent[:20], [*sent[15:], *sent[15:]], [early, *again], [END]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part={i:03}")
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for name, make in (("once", lambda s: series.without_repeats(s, late="2 days").select("user_id", "id")), ("balance", lambda s: stateful.running_balance(s, late="2 days").select("user_id", "id"))):
        make(files).writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-log").trigger(availableNow=True).start().awaitTermination()
        got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/{name}").collect() if r.user_id != 99)
        assert len(got) == len(set(got)) and {i for _, i in got} <= {r[1] for r in sent} and len(got) >= 20
