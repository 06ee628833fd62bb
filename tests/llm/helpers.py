"""Hand-built tables with the awkward cases every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(texts, first=0):
    return [(first + i, t, "en", f"src{i % 3}" if i % 4 else None, None) for i, t in enumerate(texts)]


def docs(spark, data):
    return spark.createDataFrame(data, SCHEMA)
