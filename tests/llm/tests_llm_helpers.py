"""Small documents tables."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null and empty texts, null and repeated ids, repeated rows, a very long text, white space alone.
ODD = [(1, None), (None, "a b c"), (2, ""), (2, "a b c"), (2, "a b c"), (3, "word " * 30000), (4, " \t\n")]


def docs(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, lang, source)."""
    full = [r if len(r) == 4 else (*r, "en", "s0") for r in rows]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in full], DOCS)
