"""Fixtures of the operators' tests: awkward documents, and documents of the small tables."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n ", "en", None, 4),
    (4, "one two three four five", "en", "a", 23),
    (4, "one two three four five", "en", "a", 23),
    (5, "one two three four five", "fr", "b", 23),
    (None, "password = 'abcd1234efgh' ünï", None, "b", 29),
    (6, "ÀÉ ßß 123 … x" * 3000, "de", "c", 39000),
    (7, "a\nb\nc\nd\na\nb\nc\nd\n", "en", "c", 16),
]


def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


def extra(spark):
    """The same with columns whose names an operator may use itself."""
    from pyspark.sql import functions as F

    df = awkward(spark)
    for name in ("shard", "slot", "size", "copies", "fingerprint", "component_id", "n_words", "position", "key", "id"):
        df = df.withColumn(name, F.lit("mine"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)
