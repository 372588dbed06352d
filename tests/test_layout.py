"""Printed statements as positioned text: lines, columns, rows over pages, rejoined narrations."""

from pyspark.sql import functions as F

from quillon.operators import layout

ITEMS = "file_id string, page int, str string, x double, y double, w double"
HEAD = [("Date", 32.0, 20.0), ("Narration", 150.0, 50.0), ("Value", 355.0, 20.0), ("Dt", 377.0, 10.0), ("Withdrawal Amt.", 410.0, 60.0), ("Deposit Amt.", 485.0, 55.0), ("Closing Balance", 545.0, 65.0)]


def header(file_id, page, y=700.0):
    return [(file_id, page, s, x, y, w) for s, x, w in HEAD]


def row(file_id, page, y, date, text, debit=None, credit=None, balance=None):
    y = float(y)
    out = [(file_id, page, date, 30.0, y, 40.0), (file_id, page, text, 80.0, y + 1.5, 5.0 * len(text)), (file_id, page, date, 352.0, y, 40.0)]
    for value, edge in ((debit, 470.0), (credit, 540.0), (balance, 610.0)):
        if value:
            out.append((file_id, page, value, edge - 5 * len(value), y - 0.9, 5.0 * len(value)))
    return out


def test_lines_keep_to_their_first_item(spark):
    items = [("f", 1, "a", 10.0, 100.0, 5.0), ("f", 1, "b", 20.0, 98.0, 5.0), ("f", 1, "c", 30.0, 97.4, 5.0), ("f", 1, "d", 15.5, 100.0, 3.0), ("f", 1, "e", 36.0, 97.0, 2.0), ("f", 2, "a", 10.0, 99.0, 5.0), ("f", 2, None, 1.0, 1.0, 1.0)]
    got = [(r.page, r.y, r.text) for r in layout.lines(spark.createDataFrame(items, ITEMS)).orderBy("page", F.desc("y")).collect()]
    # c is within the gap of b, but not of the line's first item; d nearly touches a, and e c, so no space is between them
    assert got == [(1, 100.0, "ad b"), (1, 97.4, "ce"), (2, 99.0, "a")]


def test_rows_over_pages(spark):
    items = [("f", 1, "01/02/24", 30.0, 760.0, 40.0), ("f", 1, "9.99", 450.0, 760.0, 20.0), *header("f", 1)]
    items += row("f", 1, 680, "01/02/24", "UPI-FIRST SHOP", debit="10.00", balance="1,990.00")
    items += row("f", 1, 660, "02 Feb 24", "SALARY OF A ", credit="5,000.00", balance="6,990.00 Cr")
    items += [("f", 1, "COMPANY", 80.0, 646.0, 35.0), ("f", 1, "Page No 1", 430.0, 60.0, 45.0), ("f", 1, "after the footer", 80.0, 46.0, 80.0)]
    # the second page has no header and begins with the rest of a row; 31/02 is no day
    items += [("f", 2, " LIMITED", 80.0, 700.0, 40.0), *row("f", 2, 680, "31/02/24", "no day", debit="1.00")[:1], *row("f", 2, 660, "03/02/24", "LAST", debit="7.50")]
    items += [("f", 2, "STATEMENT SUMMARY", 30.0, 640.0, 80.0), *row("f", 2, 620, "04/02/24", "NOT A ROW", debit="1.00")]
    items += [("g", 1, "01/02/24", 30.0, 700.0, 40.0), ("g", 1, "no header", 80.0, 700.0, 40.0), ("g", 1, "1.00", 450.0, 700.0, 20.0)]
    got = [tuple(r) for r in layout.raw_rows(spark.createDataFrame(items, ITEMS)).orderBy("file_id", "row_index").collect()]
    assert got == [
        ("f", 0, 1, "01/02/24", "01/02/24", ["UPI-FIRST SHOP"], [], "10.00", None, "1,990.00"),
        ("f", 1, 1, "02 Feb 24", "02 Feb 24", ["SALARY OF A ", "COMPANY", " LIMITED"], [], None, "5,000.00", "6,990.00 Cr"),
        ("f", 2, 2, "03/02/24", "03/02/24", ["LAST"], [], "7.50", None, None),
    ]


def test_wrap_width_and_joins(spark):
    a, b = "x" * 25, "y" * 22
    rows = spark.createDataFrame([("f", [a, "tail"]), ("f", [a, b, "z"]), ("f", [b, "short", "z"]), ("g", [a, "t"]), ("h", ["alone"]), ("h", [])], "file_id string, chunks array<string>")
    assert {r.file_id: r.width for r in layout.wrap_widths(rows).collect()} == {"f": 25, "g": 0}
    frame = spark.createDataFrame([(["abcde", "fgh"], 5), (["abcde", "fgh"], 0), (["abcd", "fgh"], 5), (["abcd ", "fgh"], 5), (["abcde", " fgh"], 5), (["abcdef", "g", "h"], 5), ([], 5)], "chunks array<string>, width int")
    assert [r[0] for r in frame.select(layout.rejoined(F.col("chunks"), F.col("width"))).collect()] == ["abcdefgh", "abcde fgh", "abcd fgh", "abcd fgh", "abcde fgh", "abcdefg h", ""]


def test_no_items(spark):
    assert layout.printed_rows(spark.createDataFrame([], ITEMS)).count() == 0


def test_subset_sums_equal_all_subsets(spark):
    import itertools
    import random

    from quillon.operators import statements

    rng = random.Random(7)
    rows = []
    for n in (0, 1, 2, 5, 9, 16, 16):
        amounts = [rng.randrange(1, 5000) / 100 for _ in range(n)]
        sums = {round(sum(c), 2) for k in range(1, n + 1) for c in itertools.combinations(amounts, k)}
        some = rng.sample(sorted(sums), min(3, len(sums)))
        rows += [(amounts, gap, gap in sums) for gap in [*some, 0.01, round(sum(amounts) + 0.01, 2)]]
    frame = spark.createDataFrame(rows, "amounts array<double>, gap double, want boolean")
    got = frame.select(statements._explains(F.col("amounts"), F.col("gap")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got) and {r.want for r in got} == {True, False}
