import unicodedata

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import similarity as S


def values(spark, column, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(column(F.col("t"))).collect()]


# The number cases that the grammar must meet.
@pytest.mark.parametrize("raw, want", [
    ("1.000", "1000"), ("1.000,50", "1000.5"), ("15,5", "15.5"), ("2024", "2024"), ("1.250,50", "1250.5"), ("1 000,50", "1000.5"), ("1.234.567", "1234567"),
    ("0,5", "0.5"), ("007", "7"), ("12345.678", "12345.678"), ("", ""),
])
def test_plain_number(raw, want):
    assert T.plain_number(raw) == want


def test_families(spark):
    text = "Со членот 17 став 3 од 04.09.2019 се плаќа 82.300,75 денари, односно 40%."
    for family, want in (("article", ["17"]), ("paragraph", ["3"]), ("money", ["82300.75 MKD"]), ("percent", ["40"]), ("date", ["4-9-2019"])):
        assert values(spark, lambda t, f=family: T.family_values(t, f), text) == [want]
    assert values(spark, lambda t: T.family_values(t, "numeral"), "точка 8, 82.300,75 евра, 40%", "точки 8, 9 и 12") == [["40", "8", "82300.75"], ["12", "8", "9"]]
    assert values(spark, lambda t: T.family_values(t, "article"), "Neni 31 dhe nenet 4", None) == [["31", "4"], None]
    assert values(spark, lambda t: T.family_values(t, "money"), "3 EUR, 3,0 euro; 1 000 mkd", "") == [["1000 MKD", "3 EUR"], []]


def test_normal_forms(spark):
    texts = ["ﬁne  Straße X", "", "  ÇË ", "éA"]
    assert values(spark, T.norm_nfkc_casefold, *texts) == [" ".join(unicodedata.normalize("NFKC", x).casefold().split()) for x in texts]
    assert values(spark, T.norm_nfc_lower, *texts) == [" ".join(unicodedata.normalize("NFC", x).lower().split()) for x in texts]
    assert values(spark, T.norm_casefold_nopunct, "A, b!  C", "") == ["a b c", ""]
    assert values(spark, T.norm_casefold_nonword, "A--b! C") == ["a b c"]
    assert values(spark, T.norm_lower_digit0, "Art 12/3") == ["art 00/0"]


def test_repair_and_release(spark):
    assert values(spark, T.repair_bracket, "M[ pas dit[s, sht[pi [3] a[[b") == ["Më pas ditës, shtëpi [3] aëëb"]
    assert values(spark, T.fold_mixed_words, "librаt книга door") == ["librat книга door"]
    assert values(spark, T.redact, "id 9876543210987, doc XY7654321, 98765432109876") == ["id [ID-NUMBER], doc [DOC-NUMBER], 98765432109876"]
    assert values(spark, lambda t: T.person_cues(t, F.lit("")), "издадена на име Ана", "стар пасош", "одлука") == [["issued in the name of"], ["passport"], []]
    assert values(spark, T.clean_headword, "Q (1) (2)", "GUR,-I", "LULËKUQE,-JA", "bar; ", None) == ["Q", "GUR", "lulëkuqe", "bar", None]
    assert values(spark, T.clean_field, " а\u00a0 b ") == ["a b"]


def test_three_valued_contradiction(spark):
    df = spark.createDataFrame([("25-309/1", "Nr. 25-309/1"), ("25-309/1", "121/07"), ("5", "121/07")], "a string, b string")
    assert [r[0] for r in df.select(T.contradicts(F.col("a"), F.col("b"))).collect()] == [False, True, None]


def test_words_and_shingles(spark):
    assert values(spark, T.word_count, "", " a  b ", None) == [0, 2, None]
    assert values(spark, S.char_shingles, "abc", "", "abcdef") == [["abc"], [], ["abcde", "bcdef"]]
