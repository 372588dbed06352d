"""Personal data: typed spans, and the terms that give protected entities away.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Each
different value of one is a protected entity. A term discloses an entity as far
as it tells which one is meant: with N documents, df(c) of them holding the
entity c, df(t) the term t, and df(c, t) both within ``window`` code points,

    disclosure(c, t) = PMI(c; t) / IC(c) = ln(N df(c,t) / (df(c) df(t))) / ln(N / df(c))

which is 1 where the term occurs with that entity alone. Pairs count from
``support`` different texts on, as one text and its copies are one piece of
evidence. A term whose largest disclosure reaches ``generalise_at`` is replaced
by its class wherever it stands, from ``remove_at`` on it is removed.

Everything is DataFrame functions. Base spans come from a row's own text; pairs
are emitted from the surroundings of entities, so their number is linear in the
text; term counts are map-side sums over all documents, restricted to the
candidate terms. These and the texts that hold a disclosing term are broadcast
only up to ``BROADCAST_ROWS`` rows, and joined by shuffle beyond.

The patterns are the plain ones with possessive repetition and a start only
where a run starts: they match the same spans, in linear time and without
recursion, so long runs of digits or letters do no harm.

Defined results: a null text is empty and has no spans; repeated rows are
documents each and get the same spans; a row without an id is treated as
others; an empty table gives an empty result. Other columns are not read.
Offsets are code points, from 0, the end exclusive. A term inside or across a
base span is no span of its own.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import durable

KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"[\p{L}\p{N}]+"
BROADCAST_ROWS = 200_000
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    turned = F.reverse(_digits(value))

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(turned, i, F.lit(1)).cast("int")
        twice = 2 * digit - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) % 10 == 0


_VALID = {
    "email": lambda value: F.lit(True),
    "ip": lambda value: value.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"),
    "card": lambda value: F.when(F.length(_digits(value)).between(14, 19), _luhn(value)).otherwise(False),
    "phone": lambda value: F.length(_digits(value)).between(10, 15),
}


def _placed(found: Column, gaps: Column, kind: int) -> Column:
    """Spans (start, kind, end, value) of all matches, from the matches and the text between them."""
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def step(so_far: Column, x: Column) -> Column:
        start = so_far["at"] + x["gap"]
        end = start + F.length(x["value"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        # the text behind the last match comes with a null value
        return F.when(x["value"].isNull(), so_far).otherwise(F.struct(end.alias("at"), F.concat(so_far["out"], F.array(span)).alias("out")))

    pairs = F.zip_with(gaps, found, lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value")))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]


def _matches(text: Column, pattern: Column | str, found: Column, kind: int) -> Column:
    return F.when(F.size(found) > 0, _placed(found, F.split(text, pattern, -1), kind)).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))


def _valid(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: _VALID[kind](s["value"]))


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (with text, not null) and its base spans in ``base``, by start and kind."""
    kinds = KINDS[:-1]
    sign = {"email": "@", "phone": "+"}
    may = {k: F.contains("text", F.lit(sign[k])) if k in sign else F.col("text").rlike("[0-9]") for k in kinds}
    none = F.array().cast("array<string>")
    seen = docs.select("*", *[F.when(may[k], F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))).otherwise(none).alias(f"found_{k}") for k in kinds])
    placed = [_valid(_matches(F.col("text"), PATTERNS[k], F.col(f"found_{k}"), n), k) for n, k in enumerate(kinds)]
    return seen.select(*docs.columns, F.array_sort(F.concat(*placed)).alias("base"))


def folded(text: Column) -> Column:
    """A-Z in lower case; every offset stays as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _entity(span: Column) -> Column:
    """One name for an entity however it is written."""
    value = F.when(span["kind"] == 0, F.lower(span["value"])).when(span["kind"] == 1, span["value"]).otherwise(_digits(span["value"]))
    return F.concat(span["kind"].cast("string"), F.lit(":"), value)


def _near(text: Column, span: Column, window: int) -> Column:
    """The different words that lie wholly within ``window`` code points of a span."""
    start, end = span["start"], span["end"]
    left = F.substring(text, F.greatest(start - window, F.lit(0)) + 1, F.least(start, F.lit(window)))
    left = F.when(start > window, F.regexp_replace(left, f"^{WORD}", "")).otherwise(left)
    right = F.substring(text, end + 1, F.lit(window))
    right = F.when(F.length(right) == window, F.regexp_replace(right, f"{WORD}$", "")).otherwise(right)
    return F.regexp_extract_all(F.concat(left, F.lit(" "), right), F.lit(WORD), F.lit(0))


def _small(df: DataFrame) -> DataFrame:
    """A written frame, broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _words_of(texts: DataFrame) -> DataFrame:
    """(key, term): the different words of each row of (key, text)."""
    words = F.array_distinct(F.regexp_extract_all(folded(F.col("text")), F.lit(WORD), F.lit(0)))
    return texts.select("key", F.explode(words).alias("term"))


def disclosing_terms(docs: DataFrame, window: int = 100, support: int = 3, generalise_at: float = 0.8) -> DataFrame:
    """(term, disclosure): the terms whose largest disclosure of an entity reaches ``generalise_at``."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.md5("text"))
    holding = base_spans(texts).where(F.size("base") > 0)
    hidden = F.aggregate("base", folded(F.col("text")), lambda text, s: F.overlay(text, F.repeat(F.lit(" "), s["end"] - s["start"]), s["start"] + 1, s["end"] - s["start"]))
    near = holding.select("key", "base", hidden.alias("text")).select(
        "key",
        F.array_distinct(F.transform("base", _entity)).alias("entities"),
        F.array_distinct(
            F.flatten(F.transform("base", lambda s: F.transform(_near(F.col("text"), s, window), lambda t: F.struct(_entity(s).alias("entity"), t.alias("term")))))
        ).alias("pairs"),
    )
    near = durable(near)
    held = near.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("df_c"))
    by_text = near.select("key", F.explode("pairs").alias("p")).groupBy("p.entity", "p.term", "key").agg(F.count("*").alias("n"))
    pairs = durable(by_text.groupBy("entity", "term").agg(F.sum("n").alias("df_ct"), F.count("*").alias("texts")).where(F.col("texts") >= support))
    candidates = durable(pairs.select("term").distinct())
    counts = _words_of(texts).join(_small(candidates), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df_t"))
    n = docs.count()
    bits = F.log(F.lit(float(n)) / F.col("df_c"))
    told = F.log(F.lit(float(n)) * F.col("df_ct") / (F.col("df_c") * F.col("df_t")))
    scored = pairs.join(held, "entity").join(counts, "term").where(bits > 0).select("term", (told / bits).alias("disclosure"))
    return scored.groupBy("term").agg(F.max("disclosure").alias("disclosure")).where(F.col("disclosure") >= generalise_at)


def find(docs: DataFrame, window: int = 100, support: int = 3, generalise_at: float = 0.8, remove_at: float = 0.95) -> DataFrame:
    """doc_id, text, base and all spans, and the text with them generalised or removed (``sanitised``).

    base, spans: arrays of (start, kind, end, value), kind an index into
    ``KINDS``; spans also holds ``remove`` for terms.
    """
    terms = durable(disclosing_terms(docs, window, support, generalise_at))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.md5("text"))
    hits = _words_of(rows.select("key", "text")).join(_small(terms), "term")
    # copies of a text have the same terms: one list for each text
    marked = hits.groupBy("key", "term").agg(F.max("disclosure").alias("disclosure")).groupBy("key").agg(
        F.array_sort(F.collect_list("term")).alias("terms"), F.array_sort(F.collect_list(F.when(F.col("disclosure") >= remove_at, F.col("term")))).alias("gone")
    )
    joined = rows.join(_small(durable(marked)), "key", "left")
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join("terms", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    seen = base_spans(joined.select("doc_id", "text", "terms", "gone", folded(F.col("text")).alias("plain"), pattern.alias("pattern")))
    found = F.when(F.col("pattern").isNull(), F.array().cast("array<string>")).otherwise(F.regexp_extract_all("plain", F.col("pattern"), F.lit(0)))
    seen = seen.select("*", found.alias("found"))
    extra = F.filter(
        _matches(F.col("plain"), F.col("pattern"), F.col("found"), len(KINDS) - 1),
        lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])),
    )
    marked_spans = F.transform(F.concat("base", extra), lambda s: F.struct(s["start"], s["kind"], s["end"], s["value"], F.coalesce(F.array_contains("gone", s["value"]), F.lit(False)).alias("remove")))
    done = seen.select("doc_id", "text", "base", F.array_sort(marked_spans).alias("spans"))
    return done.withColumn("sanitised", _sanitised(F.col("text"), F.col("spans")))


def _sanitised(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its class; overlapping spans are one, of the first one's class."""

    def label(s: Column) -> Column:
        named = F.concat(F.lit("["), F.upper(F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)), F.lit("]"))
        shape = F.when(s["value"].rlike("^[0-9]+$"), "[NUMBER]").otherwise("[WORD]")
        return F.when(s["remove"], F.lit("")).when(s["kind"] == len(KINDS) - 1, shape).otherwise(named)

    def step(so_far: Column, s: Column) -> Column:
        between = F.substring(text, so_far["at"] + 1, s["start"] - so_far["at"])
        fresh = F.struct(s["end"].alias("at"), F.concat(so_far["out"], between, label(s)).alias("out"))
        within = F.struct(F.greatest(so_far["at"], s["end"]).alias("at"), so_far["out"].alias("out"))
        return F.when(s["start"] >= so_far["at"], fresh).otherwise(within)

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in their order."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
