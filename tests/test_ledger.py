"""Ledger operators on small ledgers with expected values worked out by hand, and some oracles."""

import datetime as dt
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.functions import expressions as X
from quillon.operators import aggregates, balance, compare, explorer, imports, planning, recurring, refunds
from quillon.plans import registry

COLUMNS = "user_id long, id string, date date, seq int, direction string, amount decimal(18,2), category string, subcategory string, merchant string, payment_method string, is_recurring boolean, refund_for string"


def row(i, day, direction, amount, category, merchant, refund_for=None, subcategory=None, recurring_=False, user=1, method="UPI"):
    from decimal import Decimal

    return (user, i, dt.date.fromisoformat(day), 0, direction, Decimal(str(amount)), category, subcategory, merchant, method, recurring_, refund_for)


@pytest.fixture(scope="module")
def four(spark):
    """A ledger on which the four meanings of spending differ."""
    rows = [
        row("a", "2026-02-25", "debit", 500, "SHOPPING", "M1"), row("b", "2026-03-02", "credit", 200, "REFUNDS", "M1", "a"), row("c", "2026-03-05", "debit", 300, "FOOD", "M2"),
        row("d", "2026-03-06", "credit", 300, "REFUNDS", "M2", "c"), row("e", "2026-03-10", "credit", 50, "REFUNDS", "M3"), row("f", "2026-03-12", "debit", 1000, "TRANSFERS", "P1"),
        row("g", "2026-03-15", "debit", 400, "GROCERIES", "M4"), row("h", "2026-03-20", "credit", 5000, "SALARY/INCOME", "EMP"),
    ]
    return spark.createDataFrame(rows, COLUMNS)


def test_four_meanings_of_spending(four):
    march = four.where("date >= '2026-03-01'")
    s = aggregates.summary(march).first()
    assert (s.spending, s.net_spending, s.net_cash_flow, s.savings, s.savings_rate) == (700, 150, 3850, 4850, 97.0)
    assert sum(r.amount for r in aggregates.category_spend(refunds.netted(march)).collect()) == 400
    whole = refunds.marked(four)
    t = compare.period_totals(whole, compare.Period(dt.date(2026, 3, 1), dt.date(2026, 3, 31))).first()
    assert (t.gross, t.refunded, t.unlinked, t.net, t.n_spending) == (700, 300, 50, 350, 1)
    feb = compare.period_totals(whole, compare.Period(dt.date(2026, 2, 1), dt.date(2026, 2, 28))).first()
    assert (feb.gross, feb.net) == (500, 300)


def test_refund_links_claim_once(spark):
    rows = [row("d1", "2026-01-01", "debit", 100, "FOOD", "Shop"), row("d2", "2026-01-05", "debit", 100, "FOOD", "SHOP"), row("r1", "2026-01-10", "credit", 100, "REFUNDS", "shop"), row("r2", "2026-01-11", "credit", 90, "REFUNDS", "shop"), row("r3", "2026-06-11", "credit", 90, "REFUNDS", "shop")]
    ledger = spark.createDataFrame(rows, COLUMNS)
    assert dict(refunds.best_links(ledger).select("refund_id", "debit_id").collect()) == {"r1": "d2", "r2": "d2"}
    assert dict(refunds.greedy_links(ledger).select("refund_id", "debit_id").collect()) == {"r1": "d2", "r2": "d1"}
    linked = refunds.linked(ledger.drop("refund_for"))
    assert {r.id: (r.refund_for, r.refunded) for r in linked.collect()} == {"d1": (None, 90), "d2": (None, 100), "r1": ("d2", None), "r2": ("d1", None), "r3": (None, None)}
    assert [(r.id, r.net) for r in refunds.net_rows(linked).collect()] == [("d1", 10)]


def test_greedy_refund_links_make_no_pairs(spark):
    rng = random.Random(5)
    start = dt.date(2026, 1, 1)
    rows = []
    for i in range(1500):
        day = (start + dt.timedelta(days=rng.randrange(400))).isoformat()
        kind = ("credit", rng.choice([5, 10, 15, 20]), "REFUNDS") if rng.random() < 0.4 else ("debit", rng.choice([3, 5, 10, 12, 20]), "FOOD")
        rows.append((*row(f"t{i}", day, *kind, rng.choice(["Shop", "SHOP", "Bar"]))[:3], rng.randrange(3), *row(f"t{i}", day, *kind, rng.choice(["Shop", "SHOP", "Bar"]))[4:]))
    ledger = spark.createDataFrame(rows, COLUMNS).repartition(3)
    used, want = set(), {}
    for r in sorted((r for r in rows if r[4] == "credit"), key=lambda r: (r[2], r[3], r[1])):
        own = [d for d in rows if d[4] == "debit" and d[8].lower() == r[8].lower() and 0 <= (r[2] - d[2]).days <= 90 and d[5] >= r[5] and d[1] not in used]
        if own:
            own.sort(key=lambda d: d[1])
            want[r[1]] = max(own, key=lambda d: (d[5] == r[5], d[2], d[3]))[1]
            used.add(want[r[1]])
    links = refunds.greedy_links(ledger)
    assert {r.refund_id: r.debit_id for r in links.collect()} == want and len(want) > 300
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan and "Join Inner" not in plan


def test_period_keys(spark):
    days = spark.createDataFrame([(dt.date(2025, 12, 31),), (dt.date(2026, 3, 24),), (dt.date(2026, 3, 25),), (dt.date(2024, 3, 31),)], "date date")
    keys = days.select(*[X.bucket(F.col("date"), g, n).alias(f"{g}{n}") for g, n in (("weekly", 1), ("monthly", 25), ("quarterly", 25), ("yearly", 25))]).collect()
    assert [tuple(k) for k in keys] == [("2026-W01", "2025-12", "2025-Q4", "2025"), ("2026-W13", "2026-02", "2026-Q1", "2026"), ("2026-W13", "2026-03", "2026-Q1", "2026"), ("2024-W13", "2024-03", "2024-Q1", "2024")]
    now, then = compare.comparable("month", dt.date(2026, 3, 31))
    assert (now.first, then.first, then.last) == (dt.date(2026, 3, 1), dt.date(2026, 2, 1), dt.date(2026, 2, 28))


def test_amounts_dates_and_masks(spark):
    texts = spark.createDataFrame([("1,23,456.70",), ("(500.00)",), ("₹ 12 Cr",), ("75.5Dr",), ("-3",), ("abc",), (None,)], "t string")
    value, sign = X.parse_amount(F.col("t"))
    got = [(float(r.v) if r.v is not None else None, r.s) for r in texts.select(value.alias("v"), sign.alias("s")).collect()]
    assert got == [(123456.7, 1), (500.0, -1), (12.0, 1), (75.5, -1), (3.0, -1), (None, None), (None, None)]
    days = spark.createDataFrame([("05/03/26",), ("5-3-2026",), ("2026-03-05",), ("31/02/26",), ("05/03/71",), ("5 Mar 2026",), ("5-Sept-26",), ("7 august, 1971",), ("5 Xyz 26",), ("x",)], "t string")
    assert [r.d and r.d.isoformat() for r in days.select(X.parse_date(F.col("t")).alias("d")).collect()] == ["2026-03-05", "2026-03-05", "2026-03-05", None, "1971-03-05", "2026-03-05", "2026-09-05", "1971-08-07", None, None]
    secret = spark.createDataFrame([("mail me@x.co or me.you@okbank, HDFC0123456 ref 123456789012 ok 12345",)], "t string")
    assert secret.select(X.masked(F.col("t"))).first()[0] == "mail [email] or [handle], [code] ref [number] ok 12345"
    cells = spark.createDataFrame([("=1+1",), ("-5.20",), ('a,"b"',), (None,)], "t string")
    assert [r[0] for r in cells.select(X.csv_cell(F.col("t"))).collect()] == ["'=1+1", "-5.20", '"a,""b"""', ""]


def test_recurring_series(spark):
    rent = [row(f"r{k}", f"2026-{k:02}-03", "debit", 20000, "RENT", "Landlord") for k in range(1, 7)]
    power = [row(f"p{k}", f"2026-{k:02}-{10 + k % 2}", "debit", 900 + 150 * k, "UTILITIES", "Power", method="AUTOPAY") for k in range(1, 7)]
    food = [row(f"f{k}", str(dt.date(2026, 1, 1) + dt.timedelta(k)), "debit", 100 + 37 * (k % 5), "FOOD", "Eats") for k in range(40)]
    pay = [row(f"s{k}", f"2026-{k:02}-28", "credit", 90000, "SALARY/INCOME", "Employer") for k in range(1, 7)]
    end = [row(f"e{k}", dt.date(2026, k, 28 if k == 2 else 31 if k in (1, 3) else 30).isoformat(), "debit", 499, "SUBSCRIPTIONS", "Stream") for k in range(1, 5)]
    found = {r.series: r for r in recurring.detect(spark.createDataFrame(rent + power + food + pay + end, COLUMNS), F.lit(dt.date(2026, 6, 30))).collect()}
    assert set(found) == {"landlord", "power", "employer", "stream"}
    assert (found["landlord"].frequency, found["landlord"].kind, found["landlord"].next_date) == ("monthly", "FIXED", dt.date(2026, 7, 3))
    assert found["power"].kind == "AUTOPAY" and found["power"].changed_from == 1650 and not found["landlord"].ended and found["landlord"].changed_from is None
    assert found["stream"].next_date == dt.date(2026, 5, 31) and found["stream"].overdue and not found["stream"].ended
    ledger = spark.createDataFrame(rent + power + food + [row(f"o{k}", f"2026-{k:02}-05", "debit", 300, "OTHER", "Club") for k in range(1, 7)], COLUMNS)
    flagged = recurring.refreshed_flags(ledger, recurring.detect(ledger, F.lit(dt.date(2026, 6, 30))), F.lit(dt.date(2026, 6, 30)))
    assert {r.id[0]: (r.is_recurring, r.category) for r in flagged.collect()} == {"r": (True, "RENT"), "p": (True, "UTILITIES"), "f": (False, "FOOD"), "o": (True, "SUBSCRIPTIONS")}


def test_edges_of_recurring(spark):
    """Bands, pairs, gaps outside every band, and amounts that vary too much."""
    def series(name, days, amounts, category="SHOPPING"):
        return [row(f"{name}{k}", str(dt.date(2026, 1, 1) + dt.timedelta(d)), "debit", a, category, name) for k, (d, a) in enumerate(zip(days, amounts, strict=True))]

    rows = series("weekly", range(0, 70, 5), [100] * 14, "FOOD") + series("tenth", range(0, 100, 10), [100] * 10) + series("pair", (0, 31), (50, 50)) + series("unequal", (0, 31), (50, 60)) + series("wild", range(0, 180, 30), [100, 900, 100, 900, 100, 900])
    rows += series("quarter", (0, 84, 168, 252), [70] * 4) + series("fortnight", range(0, 120, 17), [40] * 8) + series("other", range(0, 180, 30), [9] * 6, "OTHER")
    found = {r.series: r for r in recurring.detect(spark.createDataFrame(rows, COLUMNS), F.lit(dt.date(2026, 4, 1))).collect()}
    assert {k: r.frequency for k, r in found.items()} == {"weekly": "weekly", "pair": "monthly", "quarter": "quarterly", "fortnight": "biweekly"}
    assert found["pair"].confidence == 0.5 and found["pair"].label == "Low" and found["weekly"].confidence == 1.0


def test_upcoming_and_projection(spark):
    items = spark.createDataFrame([("rent", "monthly", dt.date(2026, 1, 31), 31), ("gym", "weekly", dt.date(2026, 2, 2), None), ("tax", "quarterly", dt.date(2026, 1, 15), 15)], "id string, frequency string, start_date date, due_day int")
    due = {(r.id, r.due.isoformat()) for r in recurring.upcoming(items, F.lit(dt.date(2026, 2, 20)), F.lit(dt.date(2026, 4, 16))).collect()}
    assert {d for i, d in due if i == "rent"} == {"2026-02-28", "2026-03-31"} and {d for i, d in due if i == "tax"} == {"2026-04-15"} and ("gym", "2026-02-23") in due
    start = spark.createDataFrame([(1, dt.date(2026, 1, 1), 100.0)], "user_id long, date date, balance double")
    owed = spark.createDataFrame([(1, dt.date(2026, 1, 3), -40.0)], "user_id long, date date, amount double")
    daily = spark.createDataFrame([(1, 5.0, 4.0, 6.0)], "user_id long, mean double, low double, high double")
    assert [tuple(r)[2:] for r in planning.projection(start, owed, daily, 3).orderBy("date").collect()] == [(100.0, 95.0, 94.0, 96.0), (60.0, 50.0, 48.0, 52.0), (60.0, 45.0, 42.0, 48.0)]
    weekly = spark.createDataFrame([("gym", "weekly", None, 5)], "id string, frequency string, start_date date, due_day int")
    assert [str(r.due) for r in recurring.upcoming(weekly, F.lit(dt.date(2026, 2, 2)), F.lit(dt.date(2026, 2, 14))).collect()] == ["2026-02-06", "2026-02-13"]


def test_budget_blend_early_in_the_month(spark):
    rows = [row(f"a{k}", f"2026-0{k}-10", "debit", 900, "FOOD", "A") for k in (1, 2, 3)] + [row("b", "2026-04-02", "debit", 100, "FOOD", "A"), row("c", "2026-04-03", "debit", 20, "RENT", "B")]
    ledger = spark.createDataFrame(rows, COLUMNS)
    budgets = spark.createDataFrame([(1, "FOOD", 1000.0, 0.8), (1, "RENT", 25.0, 0.8), (1, "TRAVEL", 10.0, 0.8)], "user_id long, category string, budget double, alert double")
    got = {r.category: (r.actual, r.projected, r.average, r.status) for r in planning.budget_variance(ledger, budgets, dt.date(2026, 4, 4)).collect()}
    # day 4 of 30: run-rate 750 with weight 0.4, the mean of 900 with 0.6
    assert got == {"FOOD": (100.0, 840.0, 900.0, "ok"), "RENT": (20.0, 150.0, 0.0, "projected_over"), "TRAVEL": (0.0, 0.0, 0.0, "ok")}
    assert compare.financial_month(dt.date(2026, 3, 24), 25) == compare.Period(dt.date(2026, 2, 25), dt.date(2026, 3, 24))
    assert compare.unit_of(compare.Period(dt.date(2026, 4, 1), dt.date(2026, 6, 30))) == "quarter" and compare.unit_of(compare.Period(dt.date(2026, 4, 1), dt.date(2026, 6, 29))) == "custom"


def test_imports(spark, four):
    assert imports.new_rows(four, four.where("id < 'e'"), "user_id", "id").count() == 4
    statements = spark.createDataFrame([(1, "x", dt.date(2026, 1, 1), dt.date(2026, 1, 31)), (1, "y", dt.date(2026, 1, 31), dt.date(2026, 2, 28)), (1, "z", dt.date(2026, 3, 1), dt.date(2026, 3, 2))], "user_id long, id string, first date, last date")
    assert [tuple(r) for r in imports.overlapping(statements).collect()] == [(1, "x", "y")]
    days = spark.createDataFrame([(1, dt.date(2026, 1, 31)), (1, dt.date(2026, 1, 31)), (1, dt.date(2026, 2, 5)), (2, dt.date(2026, 3, 1)), (1, None)], "user_id long, date date")
    assert {r.id: r.held for r in imports.rows_held(statements, days).collect()} == {"x": 2, "y": 3, "z": 0}
    copies = spark.createDataFrame([(1, "e1", "wallet", "a"), (1, "e1", "bank", "b"), (1, "e2", "wallet", "c")], "user_id long, event_id string, source string, id string")
    assert {r.id for r in imports.primaries(copies, {"bank": 0, "wallet": 1}).where("is_primary").collect()} == {"b", "c"}


def test_balances_and_pages(four):
    balanced = balance.with_balance(four)
    assert balance.chain_breaks(balanced).first().breaks == 0
    assert balance.balance_on(balanced, dt.date(2026, 3, 6)).first().balance == -300
    assert [r.id for r in explorer.page(four, explorer.Filter(text="m1"), "date").collect()] == ["b", "a"]
    assert explorer.page(four, explorer.Filter(), size=999).count() == 8
    with pytest.raises(ValueError):
        explorer.page(four, explorer.Filter(), "id; drop")


def test_stream_of_days(spark, tmp_path):
    from quillon.streaming.series import daily_flows

    rows = [(1, "2026-01-01 10:00:00", "debit", "5.00"), (1, "2026-01-01 23:00:00", "credit", "7.00"), (1, "2026-01-09 00:00:00", "debit", "1.00")]
    spark.createDataFrame(rows, "user_id long, t string, direction string, a string").selectExpr("user_id", "cast(t as timestamp) ts", "direction", "cast(a as decimal(18,2)) amount").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp, direction string, amount decimal(18,2)").parquet(str(tmp_path / "in"))
    run = daily_flows(stream).writeStream.format("memory").queryName("flows").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert [(r.n, r.credit, r.debit) for r in spark.table("flows").collect()] == [(2, 7.0, 5.0)]


ORACLES = ["agg_summary", "agg_period_weekly", "agg_category_spend", "agg_category_changes", "agg_day_stats", "jn_refund_links", "jn_refund_links_greedy", "win_daily_strip", "anm_outliers", "rec_series", "pln_upcoming", "anm_unusual_activity", "cls_narrations", "rcn_statements", "src_repaired_rows"]


@pytest.mark.parametrize("name", ORACLES)
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("lineitem", "part", "orders", "events", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    rows = registry.queries()[name](spark, sf_dir)
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(rows.columns)
    assert sorted(map(repr, (tuple(r) for r in rows.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


NARRATED = "user_id long, id string, date date, value_date date, narration string, reference string, debit decimal(18,2), credit decimal(18,2), balance decimal(18,2)"


def narrated(spark, rows):
    from decimal import Decimal

    day = dt.date(2026, 1, 5)
    return spark.createDataFrame([(1, str(k), day, None, text, None, Decimal(d) if d else None, Decimal(c) if c else None, None) for k, (text, d, c) in enumerate(rows)], NARRATED)


def test_narrations(spark):
    from quillon.functions import narration as N
    from quillon.operators import classify

    rows = [
        ("UPI-AUTOPAY-GOOGLE PLAY-gp@okaxis-HDFC0MERUPI-111122223333-MANDATE", 5, None), ("UPI-A-B STORE-ab@ybl-123412341234-x - y", 5, None), ("UPI-NO ID HERE-FEE", 5, None), ("IMPS-512345678901-MR RAVI-HDFC-XX12-note", None, 5),
        ("ACH D- TP ACH POWER CO-12345", 5, None), ("50100012345678-TPT-RENT JAN-LANDLORD", 5, None), ("IB BILLPAY DR-HDFC1A-1234", 5, None), ("nothing", None, None), ("both", 7, 10),
    ]
    out = {r.id: r for r in classify.normalise(narrated(spark, rows)).collect()}
    assert set(out) == set("01234568") and (out["8"].direction, out["8"].amount) == ("credit", 3)
    assert (out["0"].counterparty, out["0"].payment_method, out["0"].reference, out["0"].upi.provider) == ("GOOGLE PLAY", "AUTOPAY", "111122223333", "Google Pay")
    assert (out["1"].counterparty, out["1"].upi.upi_id, out["1"].upi.note, out["1"].upi.provider) == ("A-B STORE", "ab@ybl", "x-y", "PhonePe")
    assert (out["2"].counterparty, out["2"].type, out["2"].upi.note) == ("NO ID HERE", "UPI", "FEE")
    assert (out["3"].counterparty, out["3"].payment_method) == ("MR RAVI", "IMPS") and (out["4"].counterparty, out["4"].payment_method) == ("POWER CO", "AUTOPAY")
    assert (out["5"].type, out["5"].counterparty) == ("TRANSFER", "LANDLORD") and out["6"].type == "BILLPAY"
    again = classify.normalise(narrated(spark, [("same", 5, None), ("same", 5, None)])).collect()
    assert len({r.dedupe_key for r in again}) == 2
    texts = spark.createDataFrame([("SWIGGY*12345 ab@ok 99887766 pvt ltd of it",)], "t string").select(N.title_case(N.clean_name(F.col("t"))), N.keyword_text(F.lit(None), F.lit("HDFC0001234 a@b 123456 4160XXXX12 food")), N.category_label(F.lit("SALARY/INCOME"))).first()
    assert tuple(texts) == ("Swiggy Ab PVT LTD of IT", "food", "Salary/Income")


def test_classification_order(spark):
    from quillon.operators import classify

    rows = narrated(spark, [
        ("UPI-CITY CAFE-c@okaxis-1-x", 10, None), ("UPI-CITY CAFE-c@okaxis-1-x", None, 10), ("UPI-ASHA RAO-a@ybl-1-food", 5, None), ("UPI-SMT DEVI-a@ybl-1-mother", 5, None), ("NEFT CR-ICIC0000001-X9 CO-2", None, 20000), ("NEFT CR-ICIC0000001-X9 CO-2", None, 2), ("UPI-OWN PICK 7-a@ybl-1-x", 1, None), ("UPI-Q1 AND CO 5-a@ybl-1-x", 1, None), ("UPI-PAYTM-a@paytm-1-refund", None, 3), ("odd 7 thing", 1, None),
    ])
    own = spark.createDataFrame([(1, "OWNPICK7", "PETS", None)], "user_id long, key string, category string, subcategory string")
    old = spark.createDataFrame([(1, "Q1ANDCO5", "GIFTS", "g", 3, 0.9), (1, "Q1ANDCO5", "FOOD", "f", 2, 0.95)], "user_id long, key string, category string, subcategory string, n long, confidence double")
    named = classify.canonical_merchant(classify.normalise(rows))
    got = {r.id: (r.category, r.subcategory, r.confidence, r.method) for r in classify.classify(named, own, old).collect()}
    assert got == {
        "0": ("FOOD", "Cafes", 0.9, "merchant"), "1": ("REFUNDS", "Refund", 0.85, "merchant"), "2": ("TRANSFERS", "Person Transfer", 0.62, "rule"), "3": ("TRANSFERS", "Family", 0.8, "rule"), "4": ("SALARY/INCOME", "Salary", 0.62, "rule"), "5": ("SALARY/INCOME", "Other Income", 0.5, "rule"),
        "6": ("PETS", "Unclassified", 0.99, "user"), "7": ("GIFTS", "g", 0.88, "history"), "8": ("REFUNDS", "Refund", 0.7, "rule"), "9": ("OTHER", "Unclassified", 0.4, "none"),
    }
    classified = classify.classify(named)
    assert classify.learned(classified).count() == 10
    changed = classify.reapplied(classified, spark.createDataFrame([(1, "CITYCAFE", "GIFTS", "g")], "user_id long, key string, category string, subcategory string"), spark.createDataFrame([(1, "1")], "user_id long, id string"))
    assert {r.id: r.category for r in changed.where("merchant = 'City Cafe'").collect()} == {"0": "GIFTS", "1": "REFUNDS"}


def test_wallet_reconciliation(spark):
    from quillon.operators import statements

    rows = [("a", 1, "debit", 10.0, None), ("a", 2, "debit", 5.0, "SELF_TRANSFER"), ("b", 1, "debit", 10.0, None), ("b", 2, "debit", 3.0, "POSSIBLE_SELF_TRANSFER"), ("b", 3, "debit", 4.0, "POSSIBLE_SELF_TRANSFER"), ("c", 1, "debit", 10.0, None), ("c", 2, "debit", 3.0, "POSSIBLE_SELF_TRANSFER"), ("d", 1, "credit", 1.0, None)]
    frame = spark.createDataFrame(rows, "statement_id string, row_index int, direction string, amount double, semantic string")
    printed = spark.createDataFrame([("a", 10.0, 0.0), ("b", 10.0, 0.0), ("c", 11.0, 0.0)], "statement_id string, sent double, received double")
    assert {r.statement_id: r.status for r in statements.reconcile_wallet(frame, printed).collect()} == {"a": "reconciled", "b": "requires_review", "c": "mismatch", "d": "no_summary"}


def test_id_keys(spark):
    keys = spark.createDataFrame([("ref 000123456789012 x", "123456789012"), ("none", None)], "a string, b string").select(imports.id_keys(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in keys] == [["123456789012"], []]


def test_unusual_activity(spark):
    from quillon.operators import anomalies

    as_of = dt.date(2026, 3, 1)
    rows = [row(f"x{k}", str(dt.date(2026, 1, 1) + dt.timedelta(k)), "debit", 300 + 10 * (k % 4), "FOOD", "Eats") for k in range(30)]
    rows += [row(f"y{k}", "2026-02-10", "debit", 900, "FOOD", "Eats") for k in range(4)] + [row("big", "2026-02-20", "debit", 9000, "FOOD", "Eats"), row("back", "2026-02-21", "debit", 9500, "FOOD", "Shop"), row("ref", "2026-02-22", "credit", 9500, "REFUNDS", "Shop", "back"), row("rent", "2026-02-01", "debit", 50000, "RENT", "Home")]
    ledger = refunds.marked(spark.createDataFrame(rows, COLUMNS))
    found = {r.id: r for r in anomalies.unusual_activity(ledger, as_of).collect()}
    # the refunded payment, the rent and the day that its one large payment explains are silent
    assert set(found) == {"large_transaction:big", "unusual_day:2026-02-10", "possible_duplicate:2026-02-10|eats|900.00"}
    assert found["large_transaction:big"].severity == "high" and found["large_transaction:big"].place == 1
    assert anomalies.unusual_activity(ledger.where("id < 'x'"), as_of).count() == 0
    shuffled = {tuple(r) for r in anomalies.unusual_activity(ledger.orderBy(F.rand(1)), as_of).collect()}
    assert shuffled == {tuple(r) for r in anomalies.unusual_activity(ledger, as_of).collect()}


@pytest.mark.parametrize("n", [2, 3, 4, 7, 12])
def test_leave_one_out(spark, n):
    from statistics import median

    from quillon.operators import anomalies

    rng = random.Random(n)
    rows = [(g, f"{g}{k}", float(rng.randrange(6))) for g in "ab" for k in range(n)]
    got = {r.id: (r.peers, r.median, r.mad) for r in anomalies.leave_one_out(spark.createDataFrame(rows, "g string, id string, x double"), ["g"], "x").collect()}
    for g, i, _ in rows:
        peers = [x for h, j, x in rows if h == g and j != i]
        assert got[i] == (n - 1, median(peers), median(abs(x - median(peers)) for x in peers))


def test_insights(spark):
    from quillon.operators import insights

    rows = [row("a0", "2026-01-10", "debit", 10, "FOOD", "A"), row("a1", "2026-02-10", "debit", 400, "FOOD", "A"), row("a2", "2026-02-11", "debit", 300, "FOOD", "A"), row("a3", "2026-02-12", "debit", 300, "FOOD", "A"), row("a4", "2026-03-05", "debit", 1000, "FOOD", "A"), row("a5", "2026-03-06", "debit", 900, "FOOD", "B"), row("a6", "2026-03-07", "debit", 800, "FOOD", "C"), row("b", "2026-01-01", "debit", 5, "BANKING FEES", "Z", user=2)]
    ledger = spark.createDataFrame(rows, COLUMNS)
    linked = refunds.marked(ledger)
    now, then = compare.comparable("month", dt.date(2026, 3, 15))
    told = insights.united(insights.stale(linked, dt.date(2026, 3, 15)), insights.spending_change(linked, now, then, "month"), insights.group_changes(refunds.net_rows(linked), "category", now, then), insights.group_changes(refunds.net_rows(linked), "merchant", now, then))
    got = [(r.user_id, r.id, r.severity, r.value, r.previous) for r in told.orderBy("user_id", "place").collect()]
    assert got == [(1, "category_spike:FOOD:2026-03-01", "attention", 2700.0, 1000.0), (1, "spending_up:month:2026-03-01", "watch", 2700.0, 1000.0), (2, "stale_data:2026-01-01", "attention", 73.0, None)]
    assert insights.fees(ledger, dt.date(2026, 3, 15)).first().value == 5 and insights.top_category(ledger, compare.Period(dt.date(2026, 3, 1), dt.date(2026, 3, 31))).first().id == "top:FOOD"
