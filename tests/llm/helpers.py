"""Small fixtures shared by the tests of the training-data operators."""
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, texts, ids=None, extra=""):
    """A documents table of the given texts (ids 0.. unless given)."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in zip(ids, texts, strict=True)]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", *extra.split(";")) if extra else df


def rows_of(df):
    return sorted((r.asDict() for r in df.collect()), key=repr)
