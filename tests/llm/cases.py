"""Documents with the awkward rows that every operator must take: nulls, empty and long texts, ties, repeated rows."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward():
    word = "The harvest of the valley was good and the people were glad that it is over for a year at last."
    long_text = " ".join(f"{word} {i}" for i in range(4000))
    rows = [
        (1, None, "en", "src_0"), (2, "", "en", "src_0"), (3, " \t\n ", "de", "src_1"), (4, "one two", None, None),
        (5, long_text, "en", "src_1"), (6, long_text, "en", "src_1"), (7, long_text + " end", "en", "src_2"), (7, long_text + " end", "en", "src_2"),
        (8, "café 中文 \U0001f600 naïve  nbsp <|endoftext|> x", "fr", "src_2"), (9, "a\na\n\na\nb\n", "xx", ""),
        (None, "a row without an id but with quite a few words in it", "en", "src_0"), (10, word, "en", "src_0"), (11, word, "en", "src_0"), (12, word.upper(), "en", "src_0"),
    ]
    return [(i, t, l, s, None if t is None else len(t)) for i, t, l, s in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def with_clashes(docs, *names):
    """Extra columns under the operator's own names, and one that only differs in case."""
    from pyspark.sql import functions as F

    for name in names:
        docs = docs.withColumn(name, F.lit("theirs"))
    return docs.withColumn("Extra Col", F.lit(1))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def documents(spark, folder):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
