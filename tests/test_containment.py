from pyspark.sql import functions as F

from lexloom.operators import relational as R


def test_both_branches_are_exact(spark):
    needles = ["", "x", "cat sat", "the cat sat", "the cat sat o", "e cat sat on the m", "the cat\u00a0sat on the mat", "cat  sat on the mat and", " cat sat on the ", "no such words in any text", "the cat sat", None]
    texts = ["the cat sat on the mat", "the cat\u00a0sat on the mat", "the cat  sat on the mat and", "the cat sat on the mat the cat sat on the mat", "x", "", None, "concatenate the cat sat oxen"]
    items = spark.createDataFrame(list(enumerate(needles)), "item_id int, needle string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = sorted((i, d) for i, n in enumerate(needles) for d, t in enumerate(texts) if n is not None and t is not None and n in t)
    for most in (10_000, 5, 2):
        assert sorted(map(tuple, R.contained(docs, items, most).collect())) == want
