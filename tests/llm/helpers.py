"""Documents with every odd case, and plain counterparts of the shared text rules."""

WS = " \t\n\x0b\x0c\r"
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def lower(text):
    return text.translate(_LOWER)


def words(text):
    return (text or "").encode().split()


def odd_documents(spark, extra=()):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with results."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, "   \n\t ", None, "b"),
        (4, "one two three four five six seven eight nine ten", "en", None),
        (4, "one two three four five six seven eight nine ten", "en", None),
        (5, long, "de", "b"),
        (None, "a document without an id, but with some words in it", "en", "a"),
        *extra,
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, n_words string, row string, token string, label int"
    return spark.createDataFrame([(*r, len(r[1] or ""), 7, "x", "y", "z", "t", 3) for r in rows], schema)


def empty_documents(spark):
    return odd_documents(spark).limit(0)
