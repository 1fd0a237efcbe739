"""Tables with the cases that every operator has to stand."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t in enumerate(texts)], SCHEMA)


def odd_documents(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and repeated ids, odd characters."""

    long = " ".join(f"word{i % 977} and {i}" for i in range(30_000))
    rows = [
        (1, None, "en", "a", None), (2, "", None, None, 0), (3, " \n\t ", "en", "a", 4), (None, "no id here at all", "en", "a", 17),
        (None, None, None, None, None), (4, long, "en", "a", len(long)), (5, "same text twice", "de", "b", 15), (5, "same text twice", "de", "b", 15),
        (5, "same id, other text", "de", "b", 19), (6, "a\x00b 😀\x1c é<|endoftext|>".encode("utf-16", "surrogatepass").decode("utf-16"), "xx", "b", 3),
        (7, "Ünïcode ΣΑΣ straße", "de", "b", 18), (2**62, "x" * 5000, "en", "a", 5000),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def with_clashes(df):
    """Further columns that have the names of results and helpers."""

    for name in ("n_tokens", "kept", "fp", "tie", "row", "found", "score", "component_id", "fingerprint", "item_id", "ids", "before", "u", "root", "value", "n_words"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
