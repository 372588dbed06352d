"""Rules as a table against a loop over all patterns."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quillon.operators import classify, rules
from quillon.plans import import_queries

RULE = "ord long, pattern string, whole boolean, direction string, category string, subcategory string, confidence double"
TEXT = "id long, text string, direction string"


def brute(text, direction, table, pick):
    hits = []
    for ord_, pattern, whole, holds, category, sub, sure in table:
        if ord_ is None or not pattern or text is None or (holds is not None and holds != direction):
            continue
        at = text.find(pattern)
        while at >= 0:
            end = at + len(pattern)
            alone = (at == 0 or not text[at - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
            if alone or not whole:
                hits.append((ord_, category, sub, sure))
                break
            at = text.find(pattern, at + 1)
    if not hits:
        return None
    return min(hits, key=lambda h: h[0]) if pick == "first" else min(hits, key=lambda h: (h[3] is None, -(h[3] or 0), h[0]))


def drawn(seed, n_rules, n_texts, letters="abc "):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    table = [(i, word(rng.randint(2, 5)).strip() or "x", rng.choice([True, False, None]), rng.choice([None, "debit", "credit"]), f"c{i}", None if i % 5 else f"s{i}", rng.choice([None, 0.5, 0.7, 0.9])) for i in range(n_rules)]
    rng.shuffle(table)
    table += [(None, "a", True, None, "n", "n", 1.0), (900, None, True, None, "n", "n", 1.0), (901, "", False, None, "n", "n", 1.0)]
    texts = [(i, word(rng.randint(0, 12)), rng.choice(["debit", "credit", None])) for i in range(n_texts)] + [(-1, None, "debit"), (-2, "", "debit"), (-3, "abc " * 5000, "debit")]
    return table, texts


@pytest.mark.parametrize(("pick", "block"), [("first", 1000), ("surest", 1000), ("first", 7), ("surest", 7)])
def test_against_all_patterns(spark, pick, block):
    table, texts = drawn(3, 30, 200)
    got = rules.matched(spark.createDataFrame(texts, TEXT).withColumn("ord", F.lit(1)), F.col("text"), F.col("direction"), spark.createDataFrame(table, RULE), pick, block=block).collect()
    want = {i: brute(t, d, table, pick) for i, t, d in texts}
    assert {r.id: tuple(r.rule) if r.rule else None for r in got} == want and len({str(w) for w in want.values()}) > 5


def test_ten_thousand_patterns(spark):
    rng = random.Random(1)
    table = [(i, f"shop {i:05}", True, None, f"c{i}", "s", 0.9) for i in range(10_000)]
    texts = [(i, f"paid to shop {rng.randrange(20_000):05} today" + " and more" * 10, "debit") for i in range(3000)]
    frame = spark.createDataFrame(texts, TEXT).coalesce(1)
    took = {}
    for n in (100, 10_000):
        few = spark.createDataFrame(table[:n], RULE)
        run = rules.matched(frame, F.col("text"), F.col("direction"), few, "first")
        run.count()
        began = time.perf_counter()
        got = {r.id: r.rule.category if r.rule else None for r in run.collect()}
        took[n] = time.perf_counter() - began
        assert got == {i: f"c{int(t.split()[3])}" if int(t.split()[3]) < n else None for i, t, _ in texts}
    assert took[10_000] < 10 * took[100] + 2


def test_no_rules_or_rows(spark):
    table, texts = drawn(1, 3, 3)
    frame, few = spark.createDataFrame(texts, TEXT), spark.createDataFrame(table, RULE)
    assert {r.rule for r in rules.matched(frame, F.col("text"), F.col("direction"), few.where("false"), "first").collect()} == {None}
    assert rules.matched(frame.where("false"), F.col("text"), F.col("direction"), few, "surest").count() == 0


def test_classification_by_tables_equals_the_built_in_rules(spark, sf_dir):
    rows = classify.canonical_merchant(classify.normalise(import_queries.statement_rows(spark, sf_dir)))
    shown = ["id", "category", "subcategory", "confidence", "method"]
    tables = {"merchant_rules": classify.rule_table(spark, classify.MERCHANTS, whole=False), "keyword_rules": classify.rule_table(spark, classify.KEYWORDS, whole=True)}
    got = sorted(map(tuple, classify.classify(rows, **tables).select(shown).collect()), key=str)
    assert got == sorted(map(tuple, classify.classify(rows).select(shown).collect()), key=str)
    assert {g[4] for g in got} >= {"merchant", "keyword", "rule"}
    own = spark.createDataFrame([(1, "CITYCAFE", False, None, "GIFTS", "Own", 0.9)], RULE)
    assert "GIFTS" in {r.category for r in classify.classify(rows, merchant_rules=own, keyword_rules=tables["keyword_rules"]).select("category").distinct().collect()}
