"""Classification of statement rows: ordered rules, the first confident hit wins.

Rules are data; each step is a nullable struct (category, subcategory,
confidence, method) and the steps are coalesced, so the whole pipeline is one
generated expression with no join but those to the user's own overrides and
history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import narration as N
from quillon.functions.expressions import merchant_key, narration_key
from quillon.operators import rules

#: Our own rule table: words of a merchant's name, its category and subcategory, confidence.
MERCHANTS = (
    ("GROCER", "GROCERIES", "Supermarket", 0.9), ("MARKET", "GROCERIES", "Supermarket", 0.85), ("PHARMAC", "HEALTHCARE", "Pharmacy", 0.9), ("CLINIC", "HEALTHCARE", "Doctor", 0.88), ("CAFE", "FOOD", "Cafes", 0.9), ("PIZZA", "FOOD", "Fast Food", 0.9),
    ("BURGER", "FOOD", "Fast Food", 0.9), ("CINEMA", "ENTERTAINMENT", "Movies", 0.9), ("STREAM", "SUBSCRIPTIONS", "Memberships", 0.88), ("TELECOM", "UTILITIES", "Mobile", 0.9), ("ELECTRIC", "UTILITIES", "Electricity", 0.9), ("AIRLINE", "TRAVEL", "Flights", 0.9),
    ("HOTEL", "TRAVEL", "Hotels", 0.88), ("FUEL", "TRANSPORTATION", "Fuel", 0.9), ("METRO", "TRANSPORTATION", "Metro", 0.85), ("INSUR", "BILLS", "Insurance", 0.88), ("BOOK", "EDUCATION", "Books", 0.8),
)
#: Our own rule table: words of a narration, direction it holds for (None: both), category and subcategory, confidence.
KEYWORDS = (
    ("DIVIDEND", "credit", "SALARY/INCOME", "Dividend", 0.8), ("REFUND", "credit", "REFUNDS", "Refund", 0.8), ("CASHBACK", "credit", "REFUNDS", "Cashback", 0.8), ("REDEMPTION", "credit", "INVESTMENTS", "Mutual Funds", 0.7),
    ("MAINTENANCE", "debit", "RENT", "Maintenance", 0.7), ("LOAN", "debit", "BILLS", "Loan EMI", 0.8), ("PREMIUM", "debit", "BILLS", "Insurance", 0.75), ("TAX", "debit", "BILLS", "Taxes", 0.7), ("SIP", "debit", "INVESTMENTS", "Mutual Funds", 0.75),
    ("SCHOOL", "debit", "EDUCATION", "College", 0.75), ("COURSE", "debit", "EDUCATION", "Courses", 0.7), ("RECHARGE", None, "UTILITIES", "Mobile", 0.75), ("FOOD", "debit", "FOOD", "Restaurants", 0.6), ("TRANSFER", None, "TRANSFERS", "Person Transfer", 0.6),
)
BUSINESS = ("STORE", "STORES", "SHOP", "MART", "PVT", "LTD", "LIMITED", "BANK", "SERVICES", "TRADERS", "ENTERPRISES", "CAFE", "HOTEL", "FOODS", "PAYMENTS", "TECH", "MARKET", "CLINIC", "COMPANY", "SOLUTIONS", "INDIA", "GROUP", "FINANCE", "INSURANCE", "ONLINE")
# Categories whose money back is a refund, payment rails, the amount from which a company's credit is a salary.
SPENT_ON = ("FOOD", "GROCERIES", "TRANSPORTATION", "SHOPPING", "ENTERTAINMENT", "EDUCATION", "SUBSCRIPTIONS", "UTILITIES", "HEALTHCARE", "TRAVEL", "PERSONAL")
RAILS = ("UPI", "IMPS", "NEFT", "RTGS", "TRANSFER")
LARGE_CREDIT = 15_000
FAMILY = r"(?i)\b(MOM|DAD|MOTHER|FATHER|BROTHER|SISTER|WIFE|HUSBAND|FAMILY|PAPA|MUMMY)\b"


def _hit(category: str | Column, subcategory: str | Column, confidence: float | Column, method: str) -> Column:
    lift = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lift(category).alias("category"), lift(subcategory).alias("subcategory"), lift(confidence).cast("double").alias("confidence"), F.lit(method).alias("method"))


def normalise(rows: DataFrame) -> DataFrame:
    """Parsed rows as transactions.

    rows: user_id, id, date, value_date, narration, reference, debit, credit,
    balance. Rows without an amount go; of one with both sides the net counts.
    Adds direction, amount, type, payment parts, method, counterparty, hints and
    a dedupe key that tells true repeats apart by their occurrence.
    """
    zero = F.lit(0).cast("decimal(18,2)")
    debit, credit = (F.abs(F.coalesce(F.col(c), zero)) for c in ("debit", "credit"))
    out = rows.withColumn("signed", (credit - debit).cast("decimal(18,2)")).where((debit > 0) | (credit > 0))
    text = N.tidy(F.col("narration"))
    out = out.withColumns({"direction": F.when(F.col("signed") > 0, "credit").otherwise("debit"), "amount": F.abs("signed").cast("decimal(18,2)"), "description": text, "type": N.transaction_type(text)}).drop("signed")
    out = out.withColumn("upi", F.when(F.col("type").isin("UPI", "REVERSAL"), N.upi(F.col("description"))))
    autopay = F.coalesce(F.col("upi.autopay"), F.lit(False)) | ((F.col("type") == "ACH") & (F.col("direction") == "debit")) | ((F.col("type") == "EMI") & F.col("description").rlike(f"(?i){N.AUTOPAY}"))
    hint = (F.col("type") == "REVERSAL") | F.coalesce(F.col("upi.note"), F.col("description")).rlike(f"(?i){N.REFUND_WORDS}")
    out = out.withColumns({"autopay": autopay, "reference": N.reference(F.col("description"), F.col("reference")), "counterparty": N.counterparty(F.col("description"), F.col("type"), F.col("upi.merchant")), "refund_hint": hint})
    out = out.withColumns({"payment_method": N.payment_method(F.col("type"), F.col("autopay")), "gateway": (F.col("type") == "UPI") & N.is_gateway(F.col("counterparty"))})
    base = F.concat_ws("|", F.col("date").cast("string"), F.coalesce(F.col("value_date").cast("string"), F.lit("")), "direction", F.col("amount").cast("string"), narration_key(F.col("description")), F.ltrim(F.coalesce("reference", F.lit("")), F.lit("0")), F.coalesce(F.col("balance").cast("string"), F.lit("")))
    out = out.withColumn("base", base)
    nth = F.row_number().over(Window.partitionBy("user_id", "base").orderBy("id"))
    return out.withColumn("dedupe_key", F.substring(F.sha2(F.concat_ws("#", "base", nth.cast("string")), 256), 1, 40)).drop("base")


def canonical_merchant(rows: DataFrame) -> DataFrame:
    """Normalised rows with ``merchant`` and ``merchant_confidence``; payment rails are never the merchant."""
    party = N.clean_name(F.coalesce("counterparty", F.lit("")))
    via = F.coalesce("upi.provider", N.title_case(F.nullif(party, F.lit(""))), F.lit("payment gateway"))
    words = F.array_join(F.slice(F.split(N.clean_name(F.col("description")), " "), 1, 3), " ")
    known = _known(party)["category"].isNotNull()
    name = F.when(F.col("type") == "ATM", "ATM Cash").when(F.col("gateway"), F.concat(F.lit("Unidentified merchant ("), via, F.lit(")"))).when(F.length(party) >= 2, N.title_case(party)).otherwise(F.coalesce(F.nullif(N.title_case(words), F.lit("")), F.lit("Unknown")))
    sure = F.when(F.col("type") == "ATM", 0.95).when(F.col("gateway"), 0.25).when(known, 0.95).when(F.length(party) >= 2, 0.6).otherwise(0.3)
    return rows.withColumns({"merchant": name, "merchant_confidence": sure})


def _known(merchant: Column) -> Column:
    key = merchant_key(merchant)
    return F.coalesce(*[F.when(key.contains(word), _hit(category, sub, sure, "merchant")) for word, category, sub, sure in MERCHANTS])


def merchant_step(merchant: Column, credit: Column) -> Column:
    """The first merchant rule that hits; money back from one that is spent at is a refund."""
    key = merchant_key(merchant)
    return F.coalesce(*[F.when(key.contains(word) & credit & F.lit(category in SPENT_ON), _hit("REFUNDS", "Refund", min(sure, 0.85), "merchant")).when(key.contains(word), _hit(category, sub, sure, "merchant")) for word, category, sub, sure in MERCHANTS])


def keyword_step(text: Column, direction: Column) -> Column:
    """The most confident keyword rule that hits as a whole word; the earlier of equals."""
    padded = F.concat(F.lit(" "), narration_key(text), F.lit(" "))
    order = sorted(range(len(KEYWORDS)), key=lambda k: (-KEYWORDS[k][4], k))
    return F.coalesce(*[F.when(padded.contains(f" {KEYWORDS[k][0]} ") & (F.lit(True) if KEYWORDS[k][1] is None else direction == KEYWORDS[k][1]), _hit(*KEYWORDS[k][2:], "keyword")) for k in order])


def rule_table(spark: SparkSession, rules: tuple, whole: bool) -> DataFrame:
    """A tuple of rules like ``MERCHANTS`` or ``KEYWORDS`` as a table for classify()."""
    rows = [(k, r[0], whole, r[1] if len(r) == 5 else None, *r[-3:]) for k, r in enumerate(rules)]
    return spark.createDataFrame(rows, "ord long, pattern string, whole boolean, direction string, category string, subcategory string, confidence double")


def _merchant_rule(credit: Column) -> Column:
    """As merchant_step, of the rule found in a table."""
    rule = F.col("_merchant_rule")
    back = _hit("REFUNDS", "Refund", F.least(rule["confidence"], F.lit(0.85)), "merchant")
    return F.when(rule.isNotNull(), F.when(credit & rule["category"].isin(*SPENT_ON), back).otherwise(_hit(rule["category"], rule["subcategory"], rule["confidence"], "merchant")))


def structural_step(kind: Column, text: Column, credit: Column) -> Column:
    """What the narration's form alone tells: cash, reversals, fees, interest, salary, rent, instalments."""
    d = F.upper(text)
    fee = F.when(d.rlike(r"\bGST\b|IGST|CGST|SGST"), "GST on Charges").when(d.rlike(r"PENAL|LATE|DISHONOU?R|RETURN|NON\s*MAINT|MIN\s*BAL"), "Penalties").when(d.rlike(r"INT(EREST)?\s*(CHRG|CHARGE|DEBIT)"), "Interest Charges").otherwise("Bank Charges")
    rule = "rule"
    return (
        F.when((kind == "ATM") & ~credit, _hit("ATM/CASH", "Cash Withdrawal", 0.97, rule))
        .when((kind == "CASH_DEPOSIT") & credit, _hit("ATM/CASH", "Cash Deposit", 0.9, rule))
        .when((kind == "REVERSAL") & credit, _hit("REFUNDS", "Reversal", 0.9, rule))
        .when((kind == "FEE") & credit, _hit("REFUNDS", "Reversal", 0.8, rule))
        .when(kind == "FEE", _hit("BANKING FEES", fee, 0.95, rule))
        .when((kind == "INTEREST") & credit, _hit("SALARY/INCOME", "Interest", 0.95, rule))
        .when(kind == "INTEREST", _hit("BANKING FEES", "Interest Charges", 0.9, rule))
        .when(credit & d.rlike(r"\b(SALARY|PAYROLL)\b"), _hit("SALARY/INCOME", "Salary", 0.95, rule))
        .when(~credit & d.rlike(r"\bRENT\b") & ~d.rlike(r"\bPARENT"), _hit("RENT", "Rent", 0.92, rule))
        .when(~credit & (kind == "EMI"), _hit("BILLS", "Loan EMI", 0.9, rule))
    )


def classify(rows: DataFrame, overrides: DataFrame | None = None, history: DataFrame | None = None, merchant_rules: DataFrame | None = None, keyword_rules: DataFrame | None = None) -> DataFrame:
    """rows with category, subcategory, confidence, method.

    rows: canonical_merchant(), or any with user_id, merchant, type,
    description, counterparty, direction, amount, gateway, refund_hint.
    overrides: (user_id, key, category, subcategory), the user's own
    corrections; history: (user_id, key, category, subcategory, n, confidence),
    what the user's ledger says. merchant_rules, keyword_rules: tables as
    ``rules.matched`` takes them, instead of the short ones of this module: the
    first merchant rule and the surest keyword rule that hit.
    """
    out = rows.withColumn("_key", merchant_key(F.col("merchant")))
    if merchant_rules is not None:
        out = rules.matched(out, merchant_key(F.coalesce("counterparty", "merchant")), F.col("direction"), merchant_rules, "first", "_merchant_rule")
    if keyword_rules is not None:
        out = rules.matched(out, narration_key(N.keyword_text(F.col("counterparty"), F.col("description"))), F.col("direction"), keyword_rules, "surest", "_keyword_rule")
    credit, kind, text, party = F.col("direction") == "credit", F.col("type"), F.col("description"), F.col("counterparty")
    steps = []
    if overrides is not None:
        own = overrides.select(F.col("user_id").alias("o_user"), F.col("key").alias("o_key"), F.col("category").alias("o_category"), F.coalesce(F.col("subcategory"), F.lit("Unclassified")).alias("o_sub"))
        out = out.join(own, (F.col("user_id") == F.col("o_user")) & (F.col("_key") == F.col("o_key")), "left")
        steps.append(F.when(F.col("o_category").isNotNull(), _hit(F.col("o_category"), F.col("o_sub"), 0.99, "user")))
    steps.append(structural_step(kind, text, credit))
    steps.append(F.when(F.col("gateway"), F.when(credit & F.col("refund_hint"), _hit("REFUNDS", "Refund", 0.7, "rule")).otherwise(_hit("NEEDS_REVIEW", "Unresolved", 0.3, "rule"))))
    steps.append(merchant_step(F.coalesce("counterparty", "merchant"), credit) if merchant_rules is None else _merchant_rule(credit))
    if history is not None:
        best = history.groupBy("user_id", "key").agg(F.max_by(F.struct("category", "subcategory", "n", "confidence"), F.struct("n", "confidence", "category")).alias("h"))
        out = out.join(best.select(F.col("user_id").alias("h_user"), F.col("key").alias("h_key"), "h"), (F.col("user_id") == F.col("h_user")) & (F.col("_key") == F.col("h_key")), "left")
        steps.append(F.when((F.col("h.n") >= 2) & (F.col("h.confidence") >= 0.75) & (F.col("h.category") != "OTHER"), _hit(F.col("h.category"), F.col("h.subcategory"), F.least(F.col("h.confidence"), F.lit(0.88)), "history")))
    rail = kind.isin(*RAILS)
    human, titled = N.person(party, BUSINESS)
    related = F.coalesce(party.rlike(FAMILY), F.lit(False)) | text.rlike(FAMILY)
    steps.append(F.when(rail & human, F.when(related, _hit("TRANSFERS", "Family", 0.8, "rule")).otherwise(_hit("TRANSFERS", "Person Transfer", F.when(titled, 0.72).otherwise(0.62), "rule"))))
    found = F.col("_keyword_rule")
    steps.append(keyword_step(N.keyword_text(party, text), F.col("direction")) if keyword_rules is None else F.when(found.isNotNull(), _hit(found["category"], found["subcategory"], found["confidence"], "keyword")))
    steps.append(F.when(rail & F.coalesce(party.rlike(FAMILY), F.lit(False)), _hit("TRANSFERS", "Family", 0.8, "rule")))
    steps.append(F.when(rail & credit & F.col("refund_hint"), _hit("REFUNDS", "Refund", 0.8, "rule")))
    company = rail & credit & kind.isin("NEFT", "RTGS") & party.isNotNull()
    steps.append(F.when(company & (F.col("amount") >= LARGE_CREDIT), _hit("SALARY/INCOME", "Salary", 0.62, "rule")).when(company, _hit("SALARY/INCOME", "Other Income", 0.5, "rule")))
    steps.append(_hit("OTHER", "Unclassified", F.when(credit, 0.35).otherwise(0.4), "none"))
    return out.withColumn("_c", F.coalesce(*steps)).select(*rows.columns, "_c.category", "_c.subcategory", "_c.confidence", "_c.method")


def flags(classified: DataFrame, counts: DataFrame) -> DataFrame:
    """Refund, recurring-candidate and review flags of an import. counts: (user_id, key, n), the debits each merchant key had before."""
    prior = counts.select(F.col("user_id").alias("p_user"), F.col("key").alias("p_key"), F.col("n").alias("p_n"))
    out = classified.join(prior, (F.col("user_id") == F.col("p_user")) & (merchant_key(F.col("merchant")) == F.col("p_key")), "left")
    debit = F.col("direction") == "debit"
    before = debit & F.coalesce(F.col("p_n") >= 2, F.lit(False))
    auto = debit & F.col("autopay")
    return out.withColumns({
        "is_refund": ~debit & (F.col("category") == "REFUNDS"), "recurring_candidate": auto | before, "recurring_confidence": F.when(auto & before, 0.75).when(auto, 0.4).when(before, 0.5).otherwise(0.0),
        "needs_review": (F.col("category") == "NEEDS_REVIEW") | (F.col("confidence") < 0.6) | (F.col("merchant_confidence") < 0.4),
    }).drop("p_user", "p_key", "p_n")


def learned(classified: DataFrame) -> DataFrame:
    """History for classify(): per user, merchant key, category and subcategory, the count and mean confidence."""
    return classified.groupBy("user_id", merchant_key(F.col("merchant")).alias("key"), "category", "subcategory").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"))


def reapplied(classified: DataFrame, overrides: DataFrame, edited: DataFrame) -> DataFrame:
    """Corrections (user_id, key, category, subcategory) put on all rows of their merchant that the user did not edit (user_id, id)."""
    own = overrides.select(F.col("user_id").alias("o_user"), F.col("key").alias("o_key"), F.col("category").alias("o_category"), F.col("subcategory").alias("o_sub"))
    kept = edited.select(F.col("user_id").alias("e_user"), F.col("id").alias("e_id"))
    out = classified.join(own, (F.col("user_id") == F.col("o_user")) & (merchant_key(F.col("merchant")) == F.col("o_key")), "left").join(kept, (F.col("user_id") == F.col("e_user")) & (F.col("id") == F.col("e_id")), "left")
    change = F.col("o_category").isNotNull() & F.col("e_id").isNull()
    put = {"category": F.col("o_category"), "subcategory": F.col("o_sub"), "confidence": F.lit(0.99), "method": F.lit("user")}
    return out.select(*(F.when(change, put[c]).otherwise(F.col(c)).alias(c) if c in put else F.col(c) for c in classified.columns))
