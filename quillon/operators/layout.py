"""Rows of printed statements from positioned text: lines, columns, rows over page breaks, rejoined narrations.

Input is a table of text items (file_id, page, str, x, y, w; y grows upwards).
Every step is a DataFrame function: what belongs to a page (its lines, its
header, its columns) is folded over arrays of that page's items, what runs over
a file (the region of the table, the row a line continues) is a window over its
lines in order. A file's lines are sorted by Spark, and only what is printed in
one row is gathered.

Defined results: items without text or place fall away; a file without a header
has no rows; a line above the first row of a file
continues nothing; equal items are printed once each; empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.expressions import parse_date
from quillon.session import durable

#: Shapes of cells, words of headers in the order they are tried, words that end a page's rows or the table.
DATE = r"^\d{1,2}[/.\-]\d{1,2}[/.\-](?:\d{2}|\d{4})$|^\d{1,2}[\s\-/][A-Za-z]{3,9}[\s\-/,]*(?:\d{2}|\d{4})$"
DECIMAL = r"(?i)^\(?-?(?:\d{1,3}(?:,\d{2,3})*|\d+)\.\d{1,2}\)?(?:\s?(?:Cr|Dr)\.?)?$"
REFERENCE = r"^\d{8,20}$"
HEADER = [
    ("value_date", r"\bvalue\b"),
    ("date", r"^(txn|transaction|posting)?\s*date$|^date$"),
    ("narration", r"narration|description|particulars|details|remarks"),
    ("ref", r"chq|cheque|ref|instrument"),
    ("debit", r"withdraw|debit|\bdr\b"),
    ("credit", r"deposit|credit|\bcr\b"),
    ("balance", r"balance|closing"),
]
FOOTER = r"(?i)page\s*no|page\s+\d+\s+of\s+\d+|generated\s*(on|by)|requesting\s*branch|registered\s*office|computer\s*generated|hdfc\s*bank\s*(limited|ltd)|contents\s*of\s*this\s*statement|\bgstn\b|synthetic\s*sample"
END = r"(?i)statement\s*summary|end\s*of\s*statement|\*+\s*end"
LINE_GAP, WORD_GAP, HEADER_GAP = 2.5, 1.2, 14.0
AMOUNTS = ("debit", "credit", "balance")
TEXTS = ("date", "narration", "ref", "value_date")
LEAST_WRAP = 20

_PARTS = "array<struct<x:double,w:double,str:string>>"
_KEYED = "struct<key:string,start:double,end:double>"


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _joined(parts: Column) -> Column:
    """The text of items in a row: a space only where there is a visible gap."""

    def step(so_far: Column, p: Column) -> Column:
        wide = (p["x"] - so_far["end"] > WORD_GAP) | so_far["out"].rlike(r"\s$") | p["str"].rlike(r"^\s")
        gap = F.when(so_far["end"].isNotNull() & wide, " ").otherwise("")
        return F.struct(F.concat(so_far["out"], gap, _trim(p["str"])).alias("out"), (p["x"] + p["w"]).alias("end"))

    start = F.struct(F.lit("").alias("out"), F.lit(None).cast("double").alias("end"))
    return F.aggregate(parts, start, step, lambda a: _trim(F.regexp_replace(a["out"], r"\s+", " ")))


def lines(items: DataFrame) -> DataFrame:
    """file_id, page, y, parts, text: items whose y is within ``LINE_GAP`` of a line's first one are that line, top to bottom."""
    whole = items.where("str IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND file_id IS NOT NULL AND page IS NOT NULL")
    heights = whole.groupBy("file_id", "page").agg(F.sort_array(F.collect_set("y"), asc=False).alias("ys"))

    def step(so_far: Column, y: Column) -> Column:
        anchor = F.when(so_far["anchor"] - y <= LINE_GAP, so_far["anchor"]).otherwise(y)
        return F.struct(anchor.alias("anchor"), F.concat(so_far["out"], F.array(F.struct(y.alias("y"), anchor.alias("anchor")))).alias("out"))

    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.array().cast("array<struct<y:double,anchor:double>>").alias("out"))
    anchored = heights.select("file_id", "page", F.explode(F.aggregate("ys", start, step)["out"]).alias("a")).select("file_id", "page", "a.y", "a.anchor")
    part = F.struct("x", F.coalesce("w", F.lit(0.0)).alias("w"), "str").alias("part")
    grouped = whole.join(anchored, ["file_id", "page", "y"]).groupBy("file_id", "page", "anchor").agg(F.sort_array(F.collect_list(part)).cast(_PARTS).alias("parts"))
    return grouped.select("file_id", "page", F.col("anchor").alias("y"), "parts", _joined(F.col("parts")).alias("text"))


def _key_of(text: Column) -> Column:
    """The column that a header's words name."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[.\s]+", " "))
    return F.coalesce(*[F.when(plain.rlike(pattern), key) for key, pattern in HEADER])


def _header(parts: Column) -> Column:
    """The columns (key, start, end) that a line names, null if it is no header."""
    named = F.transform(parts, lambda p: F.struct(_key_of(p["str"]).alias("key"), p["x"].alias("start"), (p["x"] + F.greatest(p["w"], F.lit(1.0))).alias("end")))

    def column(key: str) -> Column:
        def step(so_far: Column, p: Column) -> Column:
            wider = F.struct(F.lit(key).alias("key"), so_far["start"].alias("start"), F.when(p["start"] - so_far["end"] < HEADER_GAP, F.greatest(so_far["end"], p["end"])).otherwise(so_far["end"]).alias("end"))
            return F.when(so_far.isNull(), p).otherwise(wider).cast(_KEYED)

        return F.aggregate(F.filter(named, lambda p: p["key"] == key), F.lit(None).cast(_KEYED), step)

    found = F.array_compact(F.array(*[column(key) for key, _ in HEADER]))
    has = lambda key: F.exists(found, lambda c: c["key"] == key)
    core = has("date") & has("narration") & has("balance") & (has("debit") | has("credit"))
    return F.when(core, F.array_sort(F.transform(found, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["key"].alias("key")))))


def _starts_row(parts: Column) -> Column:
    """The leftmost item is a real date, and an amount stands behind it."""
    first = _trim(F.get(parts, F.lit(0))["str"])
    amount = F.exists(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: _trim(p["str"]).rlike(DECIMAL))
    return F.coalesce(first.rlike(DATE) & parse_date(first).isNotNull() & amount, F.lit(False))


def _columns(held: DataFrame) -> DataFrame:
    """Per page: its columns, whether its own rows, or an earlier page's, gave their places, and the height of its header."""
    rest = F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0)))
    kind = lambda p, pattern: _trim(p["str"]).rlike(pattern)
    first_x = lambda test: F.when(F.col("starts"), F.get(F.filter(rest, test), F.lit(0))["x"])
    seen = held.select(
        "file_id", "page", F.when(F.col("header").isNotNull(), F.struct("y", "header")).alias("found"), F.when(F.col("starts"), F.get("parts", F.lit(0))["x"]).alias("date_x"),
        first_x(lambda p: ~kind(p, DATE) & ~kind(p, DECIMAL) & ~kind(p, REFERENCE)).alias("narration_x"), first_x(lambda p: kind(p, REFERENCE)).alias("ref_x"), first_x(lambda p: kind(p, DATE)).alias("value_date_x"),
    )
    pages = seen.groupBy("file_id", "page").agg(F.max_by("found", "found.y").alias("found"), (F.min("date_x") - 1).alias("date_at"), *[(F.median(f"{k}_x") - 1).alias(f"{k}_at") for k in TEXTS[1:]])
    file = Window.partitionBy("file_id").orderBy("page")
    base = F.last("found.header", ignorenulls=True).over(file)
    pages = pages.withColumn("base", base).where("base IS NOT NULL")
    at = lambda c: F.coalesce(*[F.when(c["key"] == k, F.col(f"{k}_at")) for k in TEXTS], c["start"])
    moved = F.array_sort(F.transform("base", lambda c: F.struct(at(c).alias("start"), c["end"].alias("end"), c["key"].alias("key"))))
    place = lambda key: F.array_max(F.transform(F.filter(F.col("moved"), lambda c: c["key"] == key), lambda c: c["start"]))
    pages = pages.withColumn("moved", moved)
    texts = F.array_compact(F.array(*[place(k) for k in TEXTS]))
    ordered = (F.array_sort(texts) == texts) & (F.array_max(texts) < F.array_min(F.array_compact(F.array(*[place(k) for k in AMOUNTS]))))
    pages = pages.withColumn("own", F.when(F.col("date_at").isNotNull() & ordered, F.col("moved")))
    carried = F.last("own", ignorenulls=True).over(file)
    return pages.select("file_id", "page", F.coalesce(carried, "base").alias("columns"), carried.isNotNull().alias("calibrated"), F.col("found.y").alias("header_y"))


def _with_cells(told: DataFrame) -> DataFrame:
    """Lines (own: their items, columns) with ``c``, the text of each cell.

    Amounts go to the nearest amount column, else an item to the last text
    column at or left of it. Each step is a column of its own, so that none is
    worked out more than once for a line.
    """
    of = lambda keys: F.filter("columns", lambda c: c["key"].isin(*keys))
    told = told.withColumns({"amounts": of(AMOUNTS), "texts": of(TEXTS)})
    told = told.withColumn("zone", F.array_min(F.transform("amounts", lambda c: c["start"])) - 6)

    def key(p: Column) -> Column:
        right = p["x"] + p["w"]
        away = F.transform("amounts", lambda c, i: F.struct(F.least(F.abs(p["x"] + p["w"] / 2 - (c["start"] + c["end"]) / 2), F.abs(right - c["end"])).alias("d"), i.alias("i"), c["key"].alias("key")))
        left = F.array_max(F.transform(F.filter("texts", lambda c: c["start"] - 3 <= p["x"]), lambda c: F.struct(c["start"].alias("start"), c["key"].alias("key"))))["key"]
        amount = F.when(right >= F.col("zone"), _trim(p["str"]).rlike(DECIMAL)).otherwise(False)
        return F.when(amount, F.array_min(away)["key"]).otherwise(F.coalesce(left, F.get("texts", F.lit(0))["key"]))

    told = told.withColumn("keyed", F.transform("own", lambda p: F.struct(p["x"].alias("x"), p["w"].alias("w"), p["str"].alias("str"), key(p).alias("key"))))
    told = told.withColumns({f"in_{k}": _of_key(F.col("keyed"), k) for k in (*TEXTS, *AMOUNTS)})
    cells = {}
    for name in (*TEXTS, *AMOUNTS):
        mine = F.col(f"in_{name}")
        text = _joined(mine)
        if name == "narration":  # a space at the edge of a chunk says that no word was broken there
            text = F.concat(F.when(F.get(mine, F.lit(0))["str"].rlike(r"^\s"), " ").otherwise(""), text, F.when(F.get(mine, F.size(mine) - 1)["str"].rlike(r"\s$"), " ").otherwise(""))
        cells[name] = F.when(F.size(mine) > 0, F.nullif(text, F.lit("")))
    return told.withColumn("c", F.struct(*[c.alias(k) for k, c in cells.items()]))


def _of_key(keyed: Column, name: str) -> Column:
    return F.filter(keyed, lambda p: p["key"] == name)


def raw_rows(items: DataFrame) -> DataFrame:
    """file_id, row_index, page, date, value_date, chunks, refs, debit, credit, balance of each printed row, all as text.

    A row begins at a line with a date and an amount. Lines below continue it,
    over page breaks too, until a footer; the table ends for good at its summary.
    """
    # written: the columns of pages and the lines themselves both come from it
    held = durable(lines(items)).withColumns({"starts": _starts_row(F.col("parts")), "header": F.when(F.col("text").rlike("(?i)date") & F.col("text").rlike("(?i)balance|closing"), _header(F.col("parts")))})
    held = held.join(_columns(held), ["file_id", "page"]).where("header_y IS NULL OR y < header_y")
    order = Window.partitionBy("file_id").orderBy("page", F.desc("y"))
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("ended", F.max(F.col("text").rlike(END)).over(before)).where("NOT ended")
    edge = F.array_max(F.transform(F.filter("columns", lambda c: c["key"] == "narration"), lambda c: c["start"])) - 4
    low = F.col("calibrated") & F.exists("parts", lambda p: (p["x"] < edge) & (_trim(p["str"]) != ""))
    footer = ~F.col("starts") & (low | F.col("text").rlike(FOOTER))
    top = F.row_number().over(Window.partitionBy("file_id", "page").orderBy(F.desc("y"))) == 1
    event = F.when(F.col("starts"), True).when(footer, False).when(top, True)
    held = held.withColumn("event", event).withColumns({"row": F.sum(F.col("starts").cast("long")).over(before), "open": F.last("event", ignorenulls=True).over(before)})
    told = held.where("row > 0 AND open").withColumn("own", F.when(F.col("starts"), F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0)))).otherwise(F.col("parts")))
    cells = _with_cells(told).select("file_id", "row", "page", "y", "starts", _trim(F.get("parts", F.lit(0))["str"]).alias("printed"), "c")
    line = F.struct("page", (-F.col("y")).alias("down"), "starts", "printed", "c")
    rows = cells.groupBy("file_id", "row").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    first = F.get("lines", F.lit(0))
    every = lambda k: F.array_compact(F.transform("lines", lambda x: x["c"][k]))
    paid = F.get(F.filter("lines", lambda x: x["c"]["debit"].isNotNull() | x["c"]["credit"].isNotNull()), F.lit(0))["c"]
    return rows.select(
        "file_id", (F.col("row") - 1).cast("int").alias("row_index"), first["page"].alias("page"), first["printed"].alias("date"), F.get(every("value_date"), F.lit(0)).alias("value_date"),
        every("narration").alias("chunks"), every("ref").alias("refs"), paid["debit"].alias("debit"), paid["credit"].alias("credit"), F.get(every("balance"), F.lit(0)).alias("balance"),
    )


def wrap_widths(rows: DataFrame) -> DataFrame:
    """file_id, width: the commonest length, the larger of equally common ones, of chunks that another follows; 0 if it occurs once."""
    chunks = rows.select("file_id", F.explode(F.slice("chunks", 1, F.greatest(F.size("chunks") - 1, F.lit(0)))).alias("chunk"))
    sized = chunks.select("file_id", F.length(F.regexp_replace("chunk", r"\s+$", "")).alias("size")).where(F.col("size") >= LEAST_WRAP)
    counts = sized.groupBy("file_id", "size").agg(F.count("*").alias("n"))
    best = counts.groupBy("file_id").agg(F.max(F.struct("n", "size")).alias("best"))
    return best.select("file_id", F.when(F.col("best.n") >= 2, F.col("best.size")).otherwise(0).alias("width"))


def rejoined(chunks: Column, width: Column) -> Column:
    """A wrapped narration in one piece: a chunk as long as the width was broken within a word, others at a space."""

    def step(so_far: Column, chunk: Column) -> Column:
        hard = (width > 0) & (F.length(F.regexp_replace(so_far["last"], r"\s+$", "")) >= width) & ~so_far["last"].rlike(r"\s$") & ~chunk.rlike(r"^\s")
        gap = F.when(so_far["last"].isNull() | hard, "").otherwise(" ")
        return F.struct(F.concat(so_far["out"], gap, chunk).alias("out"), chunk.alias("last"))

    start = F.struct(F.lit("").alias("out"), F.lit(None).cast("string").alias("last"))
    return F.aggregate(chunks, start, step, lambda a: _trim(F.regexp_replace(a["out"], r"\s+", " ")))


def printed_rows(items: DataFrame) -> DataFrame:
    """The rows as ``statements.typed`` takes them: statement_id, row_index, date, value_date, narration, reference, withdrawal, deposit, balance."""
    rows = raw_rows(items)
    joined = rows.join(wrap_widths(rows), "file_id", "left")
    return joined.select(
        F.col("file_id").alias("statement_id"), "row_index", "date", "value_date", rejoined(F.col("chunks"), F.coalesce("width", F.lit(0))).alias("narration"), F.array_join("refs", "").alias("reference"), F.col("debit").alias("withdrawal"), F.col("credit").alias("deposit"), "balance",
    )
