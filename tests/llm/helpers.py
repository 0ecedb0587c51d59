"""Fixtures of the text operators' tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None, extra=()):
    """A documents table; extra: names of further columns, whatever an operator calls its own."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "s", None if t is None else len(t), *["x"] * len(extra)) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOCS + "".join(f", `{c}` string" for c in extra))
