"""The transaction ledger: its schema, and adapters that read one from other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.session import table

MONEY = T.DecimalType(18, 2)

#: The fixed row of the ledger; every operator takes frames with these columns.
LEDGER = T.StructType(
    [
        T.StructField("user_id", T.LongType(), False),
        T.StructField("id", T.StringType(), False),
        T.StructField("date", T.DateType(), False),
        T.StructField("seq", T.IntegerType(), False),
        T.StructField("direction", T.StringType(), False),
        T.StructField("amount", MONEY, False),
        T.StructField("category", T.StringType(), False),
        T.StructField("subcategory", T.StringType(), True),
        T.StructField("merchant", T.StringType(), False),
        T.StructField("payment_method", T.StringType(), True),
        T.StructField("is_recurring", T.BooleanType(), False),
        T.StructField("value_date", T.DateType(), True),
        T.StructField("description", T.StringType(), True),
        T.StructField("reference", T.StringType(), True),
        T.StructField("event_id", T.StringType(), True),
        T.StructField("source", T.StringType(), True),
        T.StructField("statement_id", T.StringType(), True),
        T.StructField("confidence", T.DoubleType(), True),
    ]
)

#: Part types stand for spending categories.
CATEGORY_OF = {"ECONOMY": "FOOD", "SMALL": "GROCERIES", "MEDIUM": "SHOPPING", "PROMO": "ENTERTAINMENT", "STANDARD": "TRANSFERS", "LARGE": "INVESTMENTS"}


def from_lineitem(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    """A ledger of line items: suppliers are users, brands merchants, returns credits.

    Parts and orders join by key; Spark broadcasts them only under its own
    size threshold. The id is a hash of the row's content. items: the line
    items, if not the whole table; they may be a stream.
    """
    items = table(spark, sf_dir, "lineitem") if items is None else items
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    money = F.col("l_extendedprice").cast(MONEY)
    day = F.to_date("l_shipdate")
    cells = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast(MONEY), money, F.col("l_discount").cast("decimal(18,4)"), F.col("l_tax").cast("decimal(18,4)"), "l_returnflag", "l_linestatus", day]
    kind = F.split(F.col("p_type"), " ")[0]
    spent = F.coalesce(*[F.when(kind == k, v) for k, v in CATEGORY_OF.items()], F.lit("OTHER"))
    credit = F.col("l_returnflag") == "R"
    earned = F.when(F.col("l_linestatus") == "F", "REFUNDS").otherwise("SALARY/INCOME")
    return (
        items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_suppkey").alias("user_id"),
            F.substring(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cells]), 256), 1, 40).alias("id"),
            day.alias("date"),
            F.col("l_linenumber").cast("int").alias("seq"),
            F.when(credit, "credit").otherwise("debit").alias("direction"),
            money.alias("amount"),
            F.when(credit, earned).otherwise(spent).alias("category"),
            F.col("p_name").alias("subcategory"),
            F.coalesce(F.nullif(F.col("p_brand"), F.lit("")), F.lit("Unknown")).alias("merchant"),
            F.col("o_orderpriority").alias("payment_method"),
            (F.col("l_tax") > 0.07).alias("is_recurring"),
            F.when(F.col("l_partkey") % 5 > 0, F.date_add(day, (F.col("l_partkey") % 3).cast("int"))).alias("value_date"),
            F.concat_ws(" ", "p_type", "p_brand").alias("description"),
            F.col("l_orderkey").cast("string").alias("reference"),
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("event_id"),
            F.when(F.col("l_linestatus") == "F", "bank").otherwise("wallet").alias("source"),
            F.date_format(day, "yyyy-MM").alias("statement_id"),
            (F.col("l_discount").cast("decimal(18,4)") * 10).cast("double").alias("confidence"),
        )
    )


#: The same adapter for the SQL oracle.
LEDGER_SQL = """ledger AS (
  SELECT l_suppkey AS user_id,
    substr(sha256(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR),
      CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), CAST(CAST(l_discount AS DECIMAL(18,4)) AS VARCHAR), CAST(CAST(l_tax AS DECIMAL(18,4)) AS VARCHAR), l_returnflag, l_linestatus, CAST(CAST(l_shipdate AS DATE) AS VARCHAR))), 1, 40) AS id,
    CAST(l_shipdate AS DATE) AS date, CAST(l_linenumber AS INTEGER) AS seq,
    CASE WHEN l_returnflag = 'R' THEN 'credit' ELSE 'debit' END AS direction,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
    CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_linestatus = 'F' THEN 'REFUNDS' ELSE 'SALARY/INCOME' END
      ELSE CASE split_part(p_type, ' ', 1) WHEN 'ECONOMY' THEN 'FOOD' WHEN 'SMALL' THEN 'GROCERIES' WHEN 'MEDIUM' THEN 'SHOPPING' WHEN 'PROMO' THEN 'ENTERTAINMENT' WHEN 'STANDARD' THEN 'TRANSFERS' WHEN 'LARGE' THEN 'INVESTMENTS' ELSE 'OTHER' END END AS category,
    p_name AS subcategory, coalesce(nullif(p_brand, ''), 'Unknown') AS merchant, o_orderpriority AS payment_method, l_tax > 0.07 AS is_recurring,
    CASE WHEN l_partkey % 5 > 0 THEN CAST(l_shipdate AS DATE) + CAST(l_partkey % 3 AS INTEGER) END AS value_date, p_type || ' ' || p_brand AS description, CAST(l_orderkey AS VARCHAR) AS reference,
    l_orderkey || '-' || l_linenumber AS event_id, CASE WHEN l_linestatus = 'F' THEN 'bank' ELSE 'wallet' END AS source, strftime(CAST(l_shipdate AS DATE), '%Y-%m') AS statement_id,
    CAST(CAST(l_discount AS DECIMAL(18,4)) * 10 AS DOUBLE) AS confidence
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
)"""


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of events: purchases, views and clicks are debits, sign-ups and errors credits."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "user_id",
        F.col("event_id").cast("string").alias("id"),
        F.to_date("ts").alias("date"),
        F.lit(0).alias("seq"),
        F.when(kind.isin("signup", "error"), "credit").otherwise("debit").alias("direction"),
        F.col("value").cast(MONEY).alias("amount"),
        F.when(kind == "signup", "SALARY/INCOME").when(kind == "error", "REFUNDS").when(kind == "purchase", "SHOPPING").when(kind == "view", "FOOD").otherwise("TRANSFERS").alias("category"),
        F.lit(None).cast("string").alias("subcategory"),
        F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("long") % 10).cast("string")).alias("merchant"),
        F.lit(None).cast("string").alias("payment_method"),
        F.lit(False).alias("is_recurring"),
    )


EVENTS_SQL = """ledger AS (
  SELECT user_id, CAST(event_id AS VARCHAR) AS id, CAST(ts AS DATE) AS date, 0 AS seq, CASE WHEN event_type IN ('signup', 'error') THEN 'credit' ELSE 'debit' END AS direction,
    CAST(value AS DECIMAL(18,2)) AS amount,
    CASE event_type WHEN 'signup' THEN 'SALARY/INCOME' WHEN 'error' THEN 'REFUNDS' WHEN 'purchase' THEN 'SHOPPING' WHEN 'view' THEN 'FOOD' ELSE 'TRANSFERS' END AS category,
    'k' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS VARCHAR) AS merchant, CAST(NULL AS VARCHAR) AS subcategory, CAST(NULL AS VARCHAR) AS payment_method, false AS is_recurring
  FROM events
)"""


def by_value_date(ledger: DataFrame) -> DataFrame:
    """The ledger on its value-date basis: a row's date is its value date where it has one."""
    return ledger.withColumn("date", F.coalesce("value_date", "date"))


def primary_only(ledger: DataFrame) -> DataFrame:
    """One row of each payment, where several sources tell of it (``is_primary``)."""
    return ledger.where("is_primary")


def standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of standing payments: each customer pays, or is paid by, its market segment twelve times.

    By the customer's key: even rent, rising bills, weekly food, quarterly fees,
    a subscription whose price goes up, irregular shopping, a salary.
    """
    kind = F.col("c_custkey") % 7
    base = (100 + F.floor(F.abs("c_acctbal")) % 5000).cast(MONEY)
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (F.col("c_custkey") % 7 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select("*", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k"), F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("c_custkey") % 28).cast("int")).alias("start"))
    k = F.col("k")
    date = F.when(kind == 2, F.date_add("start", 7 * k)).when(kind == 3, F.add_months("start", 3 * k)).when(kind == 5, F.date_add("start", 10 * k + 9 * (k % 3))).otherwise(F.add_months("start", k))
    amount = F.when(kind == 1, base + 25 * k).when((kind == 4) & (k == 11), base * F.lit("1.25").cast("decimal(3,2)")).otherwise(base).cast(MONEY)
    return rows.select(
        F.col("c_custkey").alias("user_id"), F.concat_ws("-", "c_custkey", "k").alias("id"), date.alias("date"), F.lit(0).alias("seq"), F.when(kind == 6, "credit").otherwise("debit").alias("direction"), amount.alias("amount"),
        pick("RENT", "UTILITIES", "FOOD", "EDUCATION", "SUBSCRIPTIONS", "SHOPPING", "SALARY/INCOME").alias("category"), F.lit("").alias("subcategory"), F.col("c_mktsegment").alias("merchant"), F.when(kind == 4, "AUTOPAY").otherwise("UPI").alias("payment_method"), F.lit(False).alias("is_recurring"),
    )


#: Day 0 of the ledgers made of customers.
FIRST_DAY = "2000-01-01"
STANDING_SQL = f"""ledger AS (
  SELECT c_custkey AS user_id, c_custkey || '-' || k AS id,
    CAST(CASE p WHEN 2 THEN start + INTERVAL (7 * k) DAY WHEN 3 THEN start + INTERVAL (3 * k) MONTH WHEN 5 THEN start + INTERVAL (10 * k + 9 * (k % 3)) DAY ELSE start + INTERVAL (k) MONTH END AS DATE) AS date, 0 AS seq,
    CASE WHEN p = 6 THEN 'credit' ELSE 'debit' END AS direction, CAST(CASE WHEN p = 1 THEN base + 25 * k WHEN p = 4 AND k = 11 THEN base * 1.25 ELSE base END AS DECIMAL(18,2)) AS amount,
    ['RENT', 'UTILITIES', 'FOOD', 'EDUCATION', 'SUBSCRIPTIONS', 'SHOPPING', 'SALARY/INCOME'][p + 1] AS category, '' AS subcategory, c_mktsegment AS merchant, CASE WHEN p = 4 THEN 'AUTOPAY' ELSE 'UPI' END AS payment_method, false AS is_recurring
  FROM (SELECT *, CAST(c_custkey % 7 AS INTEGER) AS p, CAST(100 + CAST(floor(abs(c_acctbal)) AS BIGINT) % 5000 AS DECIMAL(18,2)) AS base, DATE '{FIRST_DAY}' + CAST(c_custkey % 28 AS INTEGER) AS start, CAST(unnest(range(12)) AS INTEGER) AS k FROM customer)
)"""

#: What is added to everyday payments, by customer key modulo 8: (modulo, day, nth, direction, merchant, category, amount).
PLANTED = [
    (0, 205, 0, "debit", "Big", "FOOD", 6000),
    *((1, k, 0, "debit", "Burst", "FOOD", 150) for k in [*range(10, 200, 14), *range(200, 206)]),
    *((2, k, 0, "debit", "Boutique", "SHOPPING", 300 if k < 181 else 900) for k in [*range(5, 181, 15), *range(181, 191)]),
    *((3, 203, j, "debit", "Fair", "FOOD", 400) for j in range(12)),
    *((4, k, 0, "debit", "Spree", "FOOD", 1500) for k in range(203, 210)),
    *((5, 200, j, "debit", "Twice", "FOOD", 1500) for j in range(2)),
    (6, 204, 0, "debit", "Back", "FOOD", 7000),
    (6, 206, 0, "credit", "Back", "REFUNDS", 7000),
]


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of 210 days of even everyday payments of each customer, with something unusual planted for seven of eight.

    Customers are dealt out by their key before their rows are made, so that
    whatever is grouped by user afterwards moves no row again.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    planted = sorted(PLANTED)
    row = lambda p: F.struct(F.lit(p[1]).alias("k"), F.lit(p[2]).alias("j"), F.lit(p[3]).alias("direction"), F.lit(p[4]).alias("merchant"), F.lit(p[5]).alias("category"), F.lit(p[6]).alias("x"))
    of = [[i for i, p in enumerate(planted) if p[0] == m] for m in range(8)]
    key, n, kind = F.col("c_custkey"), F.col("n"), (F.col("c_custkey") % 8).cast("int")
    many, since = (F.get(F.array(*map(F.lit, values)), kind) for values in ([len(x) for x in of], [min(x, default=0) for x in of]))
    dealt = table(spark, sf_dir, "customer").select("c_custkey").repartition(parts, "c_custkey")
    rows = dealt.select("c_custkey", F.explode(F.sequence(F.lit(0), 209 + F.coalesce(many, F.lit(0)))).alias("n"))
    rows = rows.withColumn("p", F.when(n > 209, F.get(F.array(*map(row, planted)), since + n - 210)))
    given = lambda name, plain: F.when(n > 209, F.col("p")[name]).otherwise(plain).alias(name)
    rows = rows.select(
        "c_custkey", given("k", n), given("j", F.lit(0)), given("direction", F.lit("debit")), given("merchant", F.concat(F.lit("M"), ((key + n) % 2).cast("string"))), given("category", F.lit("FOOD")), given("x", (200 + (key * 7 + n * 13) % 60).cast("int"))
    )
    return rows.select(
        key.alias("user_id"), F.concat_ws("-", "c_custkey", "k", "j", "merchant", "direction").alias("id"), F.date_add(F.lit(FIRST_DAY).cast("date"), F.col("k")).alias("date"), F.col("j").alias("seq"), "direction", F.col("x").cast(MONEY).alias("amount"),
        "category", F.lit("").alias("subcategory"), "merchant", F.lit("UPI").alias("payment_method"), F.lit(False).alias("is_recurring"),
    )


ACTIVITY_SQL = f"""ledger AS (
  SELECT c_custkey AS user_id, concat_ws('-', c_custkey, k, j, merchant, direction) AS id, DATE '{FIRST_DAY}' + CAST(k AS INTEGER) AS date, j AS seq, direction, CAST(x AS DECIMAL(18,2)) AS amount, category, '' AS subcategory, merchant, 'UPI' AS payment_method, false AS is_recurring
  FROM (SELECT c_custkey, k, 0 AS j, 'debit' AS direction, 'M' || ((c_custkey + k) % 2) AS merchant, 'FOOD' AS category, 200 + (c_custkey * 7 + k * 13) % 60 AS x FROM (SELECT c_custkey, unnest(range(210)) AS k FROM customer)
    UNION ALL SELECT c_custkey, p.k, p.j, p.direction, p.merchant, p.category, p.x FROM customer JOIN (VALUES {", ".join(map(str, PLANTED))}) p(m, k, j, direction, merchant, category, x) ON c_custkey % 8 = p.m)
)"""
