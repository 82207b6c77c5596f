"""A small table with every awkward case, under columns whose names clash with internal ones."""

LONG = "very long text with a few words, " * 8000
COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, kind int, bucket int, ids string, keep string, band string, digest string, weight double, "
    "shard string, sid string, at string, dir string, own string, host string, e string, rest string, predicted string, size string, name string, u string, v string"
)


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), 1, 2, "x", "x", "x", "x", 1.0, *["x"] * 13)


def edge(spark, more=()):
    rows = [
        row(1, "the cat sat on the mat and then the dog came in from the rain"),
        row(2, None),
        row(3, ""),
        row(4, LONG),
        row(None, "a text without an id of its own"),
        row(5, "der hund und die katze sind nicht zu hause", None),
        row(6, "the cat sat on the mat and then the dog came in from the rain"),
        row(6, "the cat sat on the mat and then the dog came in from the rain"),
        row(7, "   \n\n \t "),
        row(8, "$$$ %%% 123", "de", None),
        *more,
    ]
    return spark.createDataFrame(rows, COLUMNS)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)
