import pytest

#: Nulls in any column, empty and blank texts, repeated rows, ties, a long text, and columns with clashing names.
EDGE = [
    (1, "the cat sat on the mat and the dog ran off into the dark wood", "en", "a", 5), (1, "the cat sat on the mat and the dog ran off into the dark wood", "en", "a", 5),
    (2, None, "en", "a", None), (3, "", None, None, 0), (4, " \n\t ", "fr", "b", 4), (5, "12 34 !", "fr", "b", 7), (6, "le chat est sur la table et le chien est dans la rue", "fr", "b", 9),
    (None, "no id here at all but some text of its own", "en", "c", 1), (7, "word " * 30_000, "en", None, 1), (8, "x", "en", "a", 1), (9, "the cat sat on the mat and the dog ran off into the dark wood", None, "c", 5),
]
CLASH = ("size", "key", "row", "raw", "label", "n", "s", "h", "bucket", "at", "tie", "text_crc32", "score", "lang_pred", "taken", "shard", "__at", "__row_key", "row_key", "may", "whole", "spans")


@pytest.fixture(scope="session")
def edge(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(None).cast("string") for c in CLASH})


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    from compare import SF

    return spark.read.parquet(f"{SF}/documents.parquet")
