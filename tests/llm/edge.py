"""Documents with every edge: null and empty texts, null ids and sources, repeats, one very long text, clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __id long, __sha string, size long, fp long, i long, node long, copies long"
LONG = " ".join(f"word{i % 977} and{i % 131}" for i in range(60_000))


def rows(extra=()):
    base = [
        (1, "the cat sat on the mat", "en", "a"), (2, "the cat sat on the mat", "en", "a"), (2, "the cat sat on the mat", "en", "a"),
        (3, None, None, None), (4, "", "en", "b"), (5, " \t\n ", "fr", None), (None, "the cat sat on the mat", None, "a"), (None, None, None, "c"),
        (6, LONG, "en", "b"), (7, LONG + " end", "en", "b"), (8, "12345 !!", "de", "b"), (9, "größe ñandú 中文 \U0001f600", "de", "c"),
    ]
    return [(*r, None if r[1] is None else len(r[1]), 1, "x", 2, 3, 4, 5, 6) for r in [*base, *extra]]


def documents(spark, extra=()):
    return spark.createDataFrame(rows(extra), SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
