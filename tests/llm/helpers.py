"""Small tables for the tests: every odd case the operators must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD_DOCS = [
    (1, "Alpha beta gamma.\nSecond line of the text.", "en", "a", 42),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, "   \n\t ", "en", "b", 6),
    (5, "Alpha beta gamma.\nSecond line of the text.", "en", "a", 42),
    (5, "Alpha beta gamma.\nSecond line of the text.", "en", "a", 42),
    (6, "It's élan — naïve 汉字 words; don't split'em, we'll see.", "fr", "c", 50),
    (7, "word " * 3000, "en", None, 15000),
    (None, "a document without an id", "en", "c", 24),
]


def odd_docs(spark):
    return spark.createDataFrame(ODD_DOCS, DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
