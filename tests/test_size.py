"""What keeps queries over activity within their disk and time on large tables: rows that don't move, and only those looked at that matter."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quillon.operators import anomalies, refunds
from quillon.sources import ledger as sources

DAY = dt.date(2000, 7, 28)


def test_wanted_rows_are_as_of_all_rows(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(rng.choice("abcdef"), str(i), float(rng.choice([1, 2, 2, 3, 7, 11, 20]))) for i in range(60)] + [("alone", "x", 1.0)], "g string, id string, x double")
    wanted = F.col("x") > 6
    some, every = anomalies.leave_one_out(rows, ["g"], "x", wanted).collect(), anomalies.leave_one_out(rows, ["g"], "x").where(wanted).collect()
    assert sorted(map(tuple, some)) == sorted(map(tuple, every)) and len(some) > 5


def test_rows_of_activity_move_once(spark, sf_dir):
    people = anomalies.population(refunds.given_back(sources.activity(spark, sf_dir)), DAY)
    days = people.groupBy("user_id", "merchant", "date").count()
    plan = days._jdf.queryExecution().executedPlan().toString().split("\n")
    moved = [line for line in plan if "Exchange hashpartitioning" in line]
    # customers before their rows are made, and the users, one row each; no sort of rows to join the two
    assert not any("SortMergeJoin" in line for line in plan)
    assert not any("merchant" in line or "date" in line for line in moved) and len(moved) == 2, moved


def test_what_few_refunds_give_back(spark, sf_dir):
    ledger = sources.activity(spark, sf_dir).where("user_id < 60")
    shown = ["user_id", "id", "refunded"]
    few = refunds.given_back(ledger)
    assert sorted(map(str, few.select(shown).where("refunded IS NOT NULL").collect())) == sorted(map(str, refunds.linked(ledger).select(shown).where("refunded IS NOT NULL").collect()))
    assert few.where("refunded IS NOT NULL").count() == 7 and few.count() == ledger.count()
    claims = refunds._claims(ledger, few=True)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in claims
