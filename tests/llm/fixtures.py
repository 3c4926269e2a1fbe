"""Small tables with awkward rows."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=""):
    """rows: (doc_id, text) pairs; columns whose names the operators use themselves ride along."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 1) for i, t in rows], DOCS + ", key string, n long, part int")


AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog."), (2, None), (3, ""), (4, "  \n\t "), (5, "The quick brown fox jumps over the lazy dog."),
    (5, "The quick brown fox jumps over the lazy dog."), (None, "no id"), (-9, "naïve café ½ 日本語 'tis it's </s> <|endoftext|>"), (7, "word " * 30_000),
    (8, "x" * 50_000), (9, "one two three four"), (10, "One TWO three four"), (11, "\x00\x1c  ok then  ..."), (2**62, "big"),
]
