"""Column expressions that read bank narrations: type, counterparty, payment rails, references, names.

All are built-in Spark functions over one row, so they stay inside generated code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms that narrations have, in the order in which they are tried.
TYPES = (
    (r"^(REV[-\s]|REVERSAL|.*\bREVERSAL\b)", "REVERSAL"),
    (r"^UPI[-/ ]|\bUPI[-/]", "UPI"),
    (r"^(ATW|NWD|EAW|ATM|CASH\s*WDL|CASH\s*WITHDRAWAL)", "ATM"),
    (r"CASH\s*DEP|CDM\b|CASH\s*DEPOSIT", "CASH_DEPOSIT"),
    (r"^NEFT", "NEFT"),
    (r"^IMPS", "IMPS"),
    (r"^RTGS", "RTGS"),
    (r"^(POS|PCD|ECOM|E-?COM|PUR)\b", "POS"),
    (r"^ACH\s?[DC]|\bNACH\b|\bECS\b|^SI\b", "ACH"),
    (r"BILLPAY|BILL\s*PAY|\bBBPS\b", "BILLPAY"),
    (r"^EMI\b|\bEMI\b", "EMI"),
    (r"^(CHQ|CHEQUE|CLG|CTS)", "CHEQUE"),
    (r"INT\.?\s?PD|CREDIT\s*INTEREST|INTEREST\s*(PAID|CREDIT|CAPITALI[SZ]ED)", "INTEREST"),
    (r"CHGS|CHARGES|CHRG|\bFEE\b|\bGST\b|PENAL|SMS\s*ALERT|MIN\s*BAL", "FEE"),
    (r"FUNDS\s*TRANSFER|\bFT\b|\bTPT\b|IB\s*FUND|SELF", "TRANSFER"),
)
METHODS = {"NEFT": "NEFT", "IMPS": "IMPS", "RTGS": "RTGS", "POS": "Debit Card", "ATM": "ATM", "CHEQUE": "Cheque", "BILLPAY": "NetBanking", "TRANSFER": "NetBanking"}
AUTOPAY = r"\b(AUTOPAY|AUTO\s?PAY|UPI\s?MANDATE|UPIMANDATE|MANDATE)\b"
AUTOPAY_MARK = r"^(AUTOPAY|AUTO\s?PAY|UPI\s?AUTOPAY|UPI\s?MANDATE|MANDATE|SI)$"
BANK_CODE = r"\b([A-Z]{4}0[A-Z0-9]{5,7})\b"
REFUND_WORDS = r"\b(REFUND(?:ED)?|RFND|REVERSAL|REVERSED|REV|CANCELL?ED|CANCELLATION|RETURN(?:ED)?|CHARGEBACK)\b"
GATEWAYS = r"^(RAZORPAY|PAYU|PAYTM|PHONEPE|CASHFREE|BILLDESK|CCAVENUE|PINE ?LABS|JUSPAY|EASEBUZZ|INSTAMOJO|BHARATPE|GPAY|GOOGLE PAY|NPCI|BHARAT BILL PAY|BBPS|UPI)(\s+(PVT|PRIVATE|LTD|LIMITED|SOFTWARE|TECHNOLOGIES|PAYMENTS?|SERVICES)\b.*)?$"
PROVIDERS = ((r"RAZORPAY|\bRZP\b", "Razorpay"), (r"\bPAYU\b|PAYUMONEY", "PayU"), (r"CASHFREE", "Cashfree"), (r"BILLDESK", "BillDesk"), (r"CCAVENUE", "CCAvenue"), (r"PINE\s*LABS", "Pine Labs"), (r"JUSPAY", "Juspay"), (r"PHONEPE", "PhonePe"), (r"PAYTM", "Paytm"), (r"G\s?PAY|GOOGLE\s*PAY", "Google Pay"))
HANDLES = {"okhdfcbank": "Google Pay", "okaxis": "Google Pay", "oksbi": "Google Pay", "okicici": "Google Pay", "ybl": "PhonePe", "ibl": "PhonePe", "axl": "PhonePe", "paytm": "Paytm", "apl": "Amazon Pay", "yapl": "Amazon Pay", "rzp": "Razorpay", "payu": "PayU", "cashfree": "Cashfree", "billdesk": "BillDesk", "upi": "UPI"}
SMALL_WORDS = ("and", "of", "the", "in", "for", "on", "to", "at")
ACRONYMS = ("PVT", "LTD", "LLP", "IT", "UPI", "ATM", "IMPS", "NEFT", "RTGS", "GST", "EMI", "FD", "RD", "SIP", "NPS", "PPF", "OK")


def tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def transaction_type(text: Column) -> Column:
    """The first form that fits, else ``OTHER``."""
    return F.coalesce(*[F.when(F.trim(text).rlike(f"(?i){pattern}"), name) for pattern, name in TYPES], F.lit("OTHER"))


def payment_method(kind: Column, autopay: Column) -> Column:
    """How a payment of that type was made; null where the type doesn't say."""
    plain = F.coalesce(*[F.when(kind == k, v) for k, v in METHODS.items()])
    return F.when(kind == "UPI", F.when(autopay, "AUTOPAY").otherwise("UPI")).when(kind.isin("ACH", "EMI"), F.when(autopay, "AUTOPAY").otherwise("Auto-debit")).otherwise(plain)


def twelve_digits(text: Column) -> Column:
    """A run of exactly twelve digits, null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?<!\d)(\d{12})(?!\d)", 1), F.lit(""))


def reference(text: Column, printed: Column) -> Column:
    """The printed reference as it is, else one found in the narration."""
    return F.coalesce(F.nullif(F.regexp_replace(printed, r"\s+", ""), F.lit("")), twelve_digits(text), F.nullif(F.regexp_extract(text, r"\b([A-Z]{4}[NR]?\d{10,})\b", 1), F.lit("")))


def is_gateway(name: Column) -> Column:
    """A payment gateway's name, which is never a merchant."""
    bare = tidy(F.regexp_replace(name, "[^A-Za-z0-9 ]+", " "))
    return F.coalesce(bare.rlike(f"(?i){GATEWAYS}"), F.lit(False))


def provider(upi_id: Column, text: Column) -> Column:
    """Who carried the payment, from the payment id or from words of the narration."""
    local, handle = F.lower(F.element_at(F.split(upi_id, "@"), 1)), F.lower(F.try_element_at(F.split(upi_id, "@"), F.lit(2)))
    by_id = F.when(local.rlike(r"\brzp\b|[.\-_]rzp|razorpay"), "Razorpay").when(local.contains("payu"), "PayU")
    by_handle = F.coalesce(*[F.when(handle == h, p) for h, p in HANDLES.items()])
    return F.coalesce(by_id, by_handle, *[F.when(text.rlike(f"(?i){pattern}"), name) for pattern, name in PROVIDERS])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dashed(text: Column) -> Column:
    """The parts of a narration between dashes."""
    return F.transform(F.split(tidy(text), "-"), lambda p: F.trim(p))


def _from(parts: Column, place: Column) -> Column:
    """The parts from a place (from 0) on."""
    return F.slice(parts, place + 1, F.greatest(F.size(parts) - place, F.lit(0)))


def upi(text: Column) -> Column:
    """The parts of a UPI narration: struct(merchant, upi_id, bank_code, reference, note, autopay, provider); null if it is none.

    UPI-NAME-ID-BANK-REFERENCE-NOTE, where the name may hold dashes and an
    autopay mark may stand first.
    """

    def read(rest: Column, marked: Column) -> Column:
        place = F.array_position(F.transform(rest, lambda p: p.contains("@")), True).cast("int")
        merchant = F.when(place > 0, F.array_join(F.slice(rest, F.lit(1), F.greatest(place - 1, F.lit(0))), "-")).otherwise(F.get(rest, F.lit(0)))
        upi_id = F.when(place > 0, F.regexp_replace(F.get(rest, F.greatest(place - 1, F.lit(0))), r"\s+", ""))
        tail = F.when(place > 0, _from(rest, place)).otherwise(_from(rest, F.lit(1)))
        whole = F.array_join(rest, "-")
        digits = twelve_digits(whole)

        def noted(tail: Column) -> Column:
            held = F.coalesce(F.array_position(F.transform(tail, lambda p: p.contains(digits)), True), F.lit(0)).cast("int")
            return F.nullif(F.trim(F.array_join(F.when(held > 0, _from(tail, held)).otherwise(F.filter(tail, lambda p: ~p.rlike(BANK_CODE))), "-")), F.lit(""))

        return let(
            F.struct(F.nullif(F.trim(merchant), F.lit("")).alias("merchant"), upi_id.alias("upi_id"), digits.alias("reference"), let(tail, noted).alias("note"), whole.alias("whole")),
            lambda r: F.struct(
                r["merchant"].alias("merchant"), r["upi_id"].alias("upi_id"), F.nullif(F.regexp_extract(r["whole"], BANK_CODE, 1), F.lit("")).alias("bank_code"), r["reference"].alias("reference"), r["note"].alias("note"),
                (marked | F.coalesce(r["note"].rlike(f"(?i){AUTOPAY}"), F.lit(False))).alias("autopay"), provider(r["upi_id"], r["whole"]).alias("provider"),
            ),
        )

    def after_mark(after: Column) -> Column:
        return let(F.coalesce(F.get(after, F.lit(0)).rlike(f"(?i){AUTOPAY_MARK}"), F.lit(False)), lambda marked: let(F.when(marked, _from(after, F.lit(1))).otherwise(after), lambda rest: read(rest, marked)))

    def from_parts(parts: Column) -> Column:
        at = F.array_position(F.transform(parts, lambda p: F.upper(p)), "UPI").cast("int")
        return F.when(at > 0, let(_from(parts, at), after_mark))

    return let(dashed(text), from_parts)


def counterparty(text: Column, kind: Column, upi_merchant: Column, bank: str = "Bank") -> Column:
    """Who is named on the other side, by the layout of the narration's type; null if nobody is. upi_merchant: from upi()."""
    whole = tidy(text)

    def by_layout(parts: Column) -> Column:
        code = F.array_position(F.transform(parts, lambda p: p.rlike("(?i)^[A-Z]{4}0[A-Z0-9]{6}$")), True).cast("int")
        third = F.get(parts, F.lit(2))
        bill = F.get(F.filter(parts, lambda p: ~p.rlike(r"(?i)BILLPAY|^\d+$|^IB\b")), F.lit(0))
        return (
            F.when(kind.isin("UPI", "REVERSAL"), F.coalesce(upi_merchant, F.get(parts, F.lit(1))))
            .when(kind.isin("NEFT", "RTGS"), F.when(code > 0, F.get(parts, code)).otherwise(third))
            .when(kind == "IMPS", F.coalesce(F.when(F.length(third) >= 2, third), F.get(parts, F.lit(1))))
            .when(kind == "BILLPAY", bill)
        )

    pos = F.coalesce(F.nullif(F.regexp_extract(whole, r"(?i)^POS\s+\S*[X*]{2,}\d{2,6}\s+(.+)$", 1), F.lit("")), F.regexp_extract(whole, r"(?i)^POS\s+(.+)$", 1))
    ach = F.regexp_replace(F.regexp_extract(whole, r"(?i)^ACH\s?[DC]\s*-\s*(.+?)(?:-\d+)?$", 1), r"(?i)^TP ACH\s+", "")
    transfer = F.nullif(F.regexp_extract(whole, r"(?i)^[0-9]{6,}-TPT-(.+?)-(.+)$", 2), F.lit(""))
    named = (
        F.when(kind.isin("UPI", "REVERSAL", "NEFT", "RTGS", "IMPS", "BILLPAY"), let(dashed(text), by_layout))
        .when(kind == "POS", pos).when(kind == "ACH", ach)
        .when(kind == "ATM", "ATM").when(kind == "INTEREST", f"{bank} Interest").when(kind == "FEE", bank)
        .otherwise(F.coalesce(transfer, F.substring(whole, 1, 40)))
    )
    return let(tidy(named), lambda n: F.when(F.length(n) >= 2, n))


def clean_name(raw: Column) -> Column:
    """A counterparty without handles, starred references and long ids."""
    out = F.regexp_replace(F.upper(raw), r"@[A-Z0-9.]+|\*[A-Z0-9]+", " ")
    out = F.regexp_replace(out, r"\b(?:[A-Z]*\d{4,}[A-Z0-9]*)\b", " ")
    return tidy(F.regexp_replace(out, r"[^A-Z0-9&'.\s]", " "))


def title_case(text: Column) -> Column:
    """Words capitalised; acronyms stay, small words are lower but for the first."""
    words = F.split(F.trim(text), r"\s+")

    def one(word: Column, place: Column) -> Column:
        low = F.lower(word)
        return F.when(F.upper(word).isin(*ACRONYMS), F.upper(word)).when((place > 0) & low.isin(*SMALL_WORDS), low).otherwise(F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1000)))

    return F.array_join(F.transform(words, one), " ")


def category_label(name: Column) -> Column:
    """A category as it is shown: words capitalised after blanks and slashes."""
    return F.array_join(F.transform(F.split(F.lower(F.replace(name, F.lit("_"), F.lit(" "))), "/"), lambda p: F.initcap(p)), "/")


def keyword_text(party: Column, text: Column) -> Column:
    """Narration that keywords may be looked for in: no codes, handles, long numbers or masked cards."""
    out = F.concat_ws(" ", F.coalesce(party, F.lit("")), text)
    for pattern in (r"(?i)\b[A-Z]{4}0[A-Z0-9]{6}\b", r"[\w.\-]+@[\w.\-]+", r"\b\d{5,}\b", r"(?i)\b\d{4,6}X+\d*\b|X{4,}\d*"):
        out = F.regexp_replace(out, pattern, " ")
    return tidy(out)


def person(name: Column, business: tuple[str, ...]) -> tuple[Column, Column]:
    """(looks like a person, has a title): one to four alphabetic words, none of them of a business."""
    titled = F.coalesce(F.trim(name).rlike(r"(?i)^(MR|MRS|MS|MISS|SHRI|SMT|SRI|DR|KUM)\.?\s+"), F.lit(False))
    bare = F.regexp_replace(F.trim(name), r"(?i)^(MR|MRS|MS|MISS|SHRI|SMT|SRI|DR|KUM)\.?\s+", "")
    words = F.filter(F.split(bare, r"\s+"), lambda w: w != "")
    plain = ~bare.rlike(r"[\d@*_/]") & ~F.arrays_overlap(F.transform(words, lambda w: F.upper(w)), F.array(*map(F.lit, business))) & F.size(words).between(1, 4) & F.forall(words, lambda w: w.rlike(r"^[A-Za-z.'-]{2,}$|^[A-Za-z]\.?$"))
    return F.coalesce(plain & ((F.size(words) >= 2) | titled), F.lit(False)), titled


def self_transfer(party: Column, own_names: Column, own_masks: Column) -> Column:
    """SELF_TRANSFER if the other side is the user or one of their accounts, POSSIBLE_SELF_TRANSFER on weaker signs, else null."""
    c = tidy(F.regexp_replace(F.upper(party), "[^A-Z0-9 ]+", " "))
    names = F.filter(F.transform(own_names, lambda n: tidy(F.regexp_replace(F.upper(n), "[^A-Z0-9 ]+", " "))), lambda n: F.length(n) >= 4)
    same = F.array_contains(names, c) | (F.exists(own_masks, lambda m: (F.length(m) >= 4) & F.array_contains(F.split(c, " "), m)) & c.rlike(r"\b(BANK|ACCOUNT|AC|A C)\b"))
    tokens = F.filter(F.flatten(F.transform(names, lambda n: F.split(n, " "))), lambda t: F.length(t) >= 4)
    maybe = c.rlike("(^| )SELF( |$)") | (F.arrays_overlap(F.split(c, " "), tokens) & c.rlike("^[A-Z ]+$"))
    return F.when(F.length(c) > 0, F.when(same, "SELF_TRANSFER").when(maybe, "POSSIBLE_SELF_TRANSFER"))
