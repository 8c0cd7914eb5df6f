"""Small documents tables with every edge case that the operators define."""

from pyspark.sql import types as T

CLASHES = ["key", "part", "guard", "h", "spans", "score", "fp", "k1", "size", "component_id"]
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in CLASHES],
    ]
)


def docs(spark, rows):
    """rows of (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None, *["x"] * len(CLASHES)) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def edge_rows(long_text):
    """Null id, null and empty text, blanks, one word, a very long text, repeated rows."""
    return [(None, "no id here"), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, long_text), (6, "twice the same row"), (6, "twice the same row"), (7, "Ünï çödé \U0001F600 x")]
