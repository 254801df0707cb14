import math

from pyspark.sql import functions as F

from lexloom.operators import metrics as M


def test_perfect_and_empty():
    s = M.bleu_row("the cat sat on the mat", "the cat sat on the mat")
    assert math.isclose(M.bleu_score(s), 100.0)
    assert math.isclose(M.chrf_score(M.chrf_row("abc def", "abc def")), 100.0)
    assert M.bleu_score(M.bleu_row("", "a b c d")) == 0.0


def test_bleu_by_hand():
    # 5 tokens each; matches 4, 2, 1 and 0 of 5, 4, 3 and 2; the last order is smoothed to 1 / (2 * 2)
    s = M.bleu_row("a b c x e", "a b c d e")
    assert s == [5, 5, 4, 5, 2, 4, 1, 3, 0, 2]
    assert math.isclose(M.bleu_score(s), 100 * (4 / 5 * 2 / 4 * 1 / 3 * 1 / 4) ** 0.25)


def test_tokens_13a():
    assert M.tokens_13a("Hello, world! 3.5 a.b") == ["Hello", ",", "world", "!", "3.5", "a", ".", "b"]


def test_bootstrap_finds_a_clear_gain(spark):
    df = spark.createDataFrame([(i, "x y z w", f"a b c {i} e f", f"a b c {i} e f") for i in range(60)], "i long, base string, other string, ref string")
    out = {r["metric"]: r for r in M.paired_bootstrap(df, F.col("i"), F.col("base"), F.col("other"), F.col("ref"), 100).collect()}
    assert out["bleu"]["low"] > 50 and out["bleu"]["p"] <= 0.02 and out["chrf"]["low"] > 50


def test_scores_by_class_and_all(spark):
    df = spark.createDataFrame([("a", "x y z w v", "x y z w v"), ("b", "q", "x y z w v")], "class string, h string, r string")
    out = {r["class"]: r for r in M.corpus_scores(df, "h", "r", "class").collect()}
    assert math.isclose(out["a"]["bleu"], 100.0) and out["all"]["n"] == 2
