"""Small tables for the tests of the training-data operators."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, first=0, extra=None):
    """Documents with ids from ``first`` on; texts may be null."""
    rows = [(first + i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df if extra is None else df.selectExpr("*", *extra)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def words(n, seed=0, vocabulary=4000):
    import random

    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
