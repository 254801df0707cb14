"""Scalar text functions as Catalyst expressions; pandas UDFs only where Spark has no built-in."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType

# Alphabets, thresholds and tables of the corpus rules.
CYRILLIC_WIDE, LATIN_WIDE = "[\\u0400-\\u04FF\\u0500-\\u052F]", "[A-Za-z\\u00C0-\\u024F]"
NUMERAL = r"(\d+(?:[./\-]\d+)*)"
RICH_NUMERAL = r"(\d+(?:[./\-]\d+)+|\d{3,})"
NO_EVIDENCE = 0.5
MATCH_RAMP, OCR_RAMP, GALE_CHURCH_PENALTY = (0.76, 0.95), (0.50, 0.85), 0.35
TEXT_WEIGHTS = {"numeric_overlap": 0.35, "lingua_agreement": 0.30, "script_purity": 0.20, "length_ratio": 0.15}
HOMOGLYPHS = ("АВЕКМНОРСТУХаеорсухіјѕЁё", "ABEKMHOPCTYXaeopcyxijsËë")
NUMBER = r"\d+(?:[.,]\d+|[  ]\d{3}(?!\d))*"
FAMILIES = {
    "article": rf"(?iu)(?:член(?:от|овите|ови)?|nen(?:i|in|it|e|et)?)\s*({NUMBER})",
    "paragraph": rf"(?iu)(?:став(?:от|овите)?|paragraf(?:i|in|it|e)?)\s*({NUMBER})",
    "date": r"\b(\d{1,2})\s*[.\-/]\s*(\d{1,2})\s*[.\-/]\s*(\d{4})\b",
    "money": rf"(?iu)({NUMBER})\s*(денар[иа]?|denar[ëe]?v?|MKD|EUR|евр[оаи]|euro?)\b",
    "percent": rf"({NUMBER})\s*%",
    "numeral": f"({NUMBER})",
}
CURRENCIES = {
    "денар": "MKD", "денари": "MKD", "денара": "MKD", "mkd": "MKD", "denar": "MKD", "denare": "MKD", "denarë": "MKD", "denarëv": "MKD",
    "eur": "EUR", "евро": "EUR", "евра": "EUR", "еври": "EUR", "euro": "EUR", "eur o": "EUR",
}
LANGUAGE_SCORES = {"MK": 1.0, "SR": 0.4}
CYRILLIC_NARROW, LATIN_NARROW = "[\\u0400-\\u04FF]", "[A-Za-zÇçËë]"
_LETTERS = "A-Za-zÇçËë"
REDACTIONS = (("national_id", r"(?<!\d)\d{13}(?!\d)", "[ID-NUMBER]"), ("passport", r"(?U)\b[A-ZА-Шa-zа-ш]{1,2}\d{6,9}\b", "[DOC-NUMBER]"))
PERSON_CUES = (
    ("first", r"на\s+име\b", "issued in the name of"), ("first", r"\bизгубен[аиo]?\b", "lost document notice"), ("first", r"\bроден[аи]?\s+на\b", "born on"),
    ("first", r"лична\s+карта", "identity card"), ("first", r"\bпасош", "passport"), ("first", r"\b(?:диплома|свидетелств)", "diploma / certificate"),
    ("second", r"\b[ie]\s+humbur\b", "lost"), ("second", r"shpallet\s+i\s+pavlefsh", "declared invalid"), ("second", r"\bpasaport", "passport"),
    ("second", r"\bletërnjoftim", "identity card"), ("second", r"\bdiplom", "diploma"),
)


# -- six normalisations ----------------------------------------------------------------------------------------------


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


@F.pandas_udf(StringType())
def _nfkc_casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))


@F.pandas_udf(StringType())
def _nfc_lower(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFC", x).lower().split()))


@F.pandas_udf(StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else x.casefold())


def norm_nfkc_casefold(text: Column) -> Column:
    return _nfkc_casefold(text)


def norm_nfc_lower(text: Column) -> Column:
    return _nfc_lower(text)


def norm_lower_ws(text: Column) -> Column:
    return collapse(F.lower(text))


def norm_casefold_nopunct(text: Column, fold=casefold) -> Column:
    """fold=F.lower stays in the JVM, where the alphabet has no letters that lower() leaves apart."""
    return collapse(F.regexp_replace(fold(text), r"(?U)[^\w\s]", ""))


def norm_casefold_nonword(text: Column, fold=casefold) -> Column:
    return F.trim(F.regexp_replace(fold(text), r"(?U)\W+", " "))


def norm_lower_digit0(text: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(text), r"(?U)\d", "0"))


# -- counts, shares, overlaps ----------------------------------------------------------------------------------------


def words(text: Column) -> Column:
    """White-space tokens; none for the empty text."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    """Null for null text."""
    return F.when(text.isNotNull(), F.size(words(text)))


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1))


def length_ratio(a: Column, b: Column) -> Column:
    x, y = F.length(a), F.length(b)
    return F.when(F.greatest(x, y) > 0, F.least(x, y) / F.greatest(x, y)).otherwise(0.0)


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def share(text: Column, mine: str, other: str) -> Column:
    """Share of `mine` among letters of both patterns; null without any."""
    a, b = count_of(text, mine), count_of(text, other)
    return F.when(a + b > 0, a / (a + b))


def script_purity(first_share: Column, second_share: Column) -> Column:
    return (F.coalesce(first_share, F.lit(NO_EVIDENCE)) + F.coalesce(second_share, F.lit(NO_EVIDENCE))) / 2


def numerals(text: Column, pattern: str = NUMERAL) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def set_jaccard(a: Column, b: Column) -> Column:
    """Null if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), None).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both)


def contradicts(a: Column, b: Column) -> Column:
    """Three-valued: unknown if either side has no rich numeral."""
    x, y = numerals(a, RICH_NUMERAL), numerals(b, RICH_NUMERAL)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(None).cast("boolean")).otherwise(~F.arrays_overlap(x, y))


def same_digit_runs(a: Column, b: Column) -> Column:
    x, y = (F.array_sort(F.regexp_extract_all(t, F.lit(r"(\d+)"), F.lit(1))) for t in (a, b))
    return x == y


def overlap_category(value: Column) -> Column:
    return F.when(value.isNull(), "no numerals").when(value == 1, "full").when(value == 0, "none").otherwise("partial")


# -- numbers ---------------------------------------------------------------------------------------------------------


def plain_number(raw: str) -> str:
    """1.000,50 and 1 000,50 become 1000.5. The last separator is decimal, unless it is the only kind and has exactly
    three digits after it (one group after at most three digits, or one of several groups): then it groups thousands."""
    text = re.sub("[  ]", "", raw).strip(".,")
    if not text:
        return ""
    seps = [i for i, c in enumerate(text) if c in ".,"]
    decimal = None
    if seps:
        last, kinds = seps[-1], {text[i] for i in seps}
        grouped = len(kinds) == 1 and len(text) - last - 1 == 3 and (len(seps) > 1 or last <= 3 or sum(c.isdigit() for c in text[:last]) <= 3)
        decimal = None if grouped else last
    whole = re.sub("[^0-9]", "", text if decimal is None else text[:decimal]).lstrip("0") or "0"
    part = "" if decimal is None else re.sub("[^0-9]", "", text[decimal + 1 :]).rstrip("0")
    return f"{whole}.{part}" if part else whole


@F.pandas_udf(ArrayType(StringType()))
def normalise_numbers(values: pd.Series) -> pd.Series:
    return values.map(lambda xs: None if xs is None else sorted({y for x in xs if (y := plain_number(x))}))


@F.pandas_udf(ArrayType(StringType()))
def money_values(amounts: pd.Series, units: pd.Series) -> pd.Series:
    """Sums of money as "amount code"; a unit outside CURRENCIES is its own code."""
    out = []
    for numbers, names in zip(amounts, units):
        if numbers is None:
            out.append(None)
            continue
        codes = (CURRENCIES.get(n.casefold()) or n.upper() for n in names)
        out.append(sorted({" ".join(x) for x in zip(map(plain_number, numbers), codes)}))
    return pd.Series(out)


def family_values(text: Column, family: str) -> Column:
    """The distinct comparable values of one pattern family."""
    pattern, group = F.lit(FAMILIES[family]), lambda n: F.regexp_extract_all(text, F.lit(FAMILIES[family]), F.lit(n))
    if family == "date":
        parts = F.arrays_zip(group(1).alias("d"), group(2).alias("m"), group(3).alias("y"))
        return F.array_distinct(F.transform(parts, lambda p: F.concat_ws("-", p["d"].cast("int"), p["m"].cast("int"), p["y"].cast("int"))))
    if family == "money":
        return money_values(group(1), group(2))
    return normalise_numbers(F.regexp_extract_all(text, pattern, F.lit(1)))


# -- scores ----------------------------------------------------------------------------------------------------------


def ramp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))


def matcher_term(match: Column, ocr_a: Column, ocr_b: Column, inferred: Column, empty: Column) -> Column:
    ocr = F.least(ocr_a, ocr_b)
    ocr_term = F.when(ocr.isNull(), 1.0).otherwise(ramp(ocr, *OCR_RAMP))
    return ramp(F.coalesce(match, F.lit(0.0)), *MATCH_RAMP) * ocr_term * F.when(inferred, GALE_CHURCH_PENALTY).otherwise(1.0) * F.when(empty, 0.0).otherwise(1.0)


def text_term(**values: Column) -> Column:
    out = F.lit(0.0)
    for name, weight in TEXT_WEIGHTS.items():
        out = out + values[name] * weight
    return out


def language_score(lang: Column) -> Column:
    out = F.when(lang.isNull(), NO_EVIDENCE)
    for name, value in LANGUAGE_SCORES.items():
        out = out.when(lang == name, value)
    return out.otherwise(0.0)


def gale_church_inferred(method: Column, confidence: Column, floor: float = 0.76) -> Column:
    """A link by length alone: its method says so, or its confidence is under the matcher's floor. NaN counts as null."""
    return F.coalesce((method == "gale_church") | (F.nanvl(confidence, F.lit(None).cast("double")) < floor), F.lit(False))


def degeneracy(a: Column, b: Column) -> dict[str, Column]:
    empty = (F.trim(a) == "") | (F.trim(b) == "")
    letters = lambda t: count_of(t, CYRILLIC_WIDE) + count_of(t, LATIN_WIDE)
    return {
        "either_empty": empty, "very_short": (F.length(a) < 20) | (F.length(b) < 20), "no_letters": (letters(a) == 0) | (letters(b) == 0),
        "copy_through": (a == b) & ~empty, "copy_through_norm": (norm_casefold_nopunct(a) == norm_casefold_nopunct(b)) & ~empty,
    }


def length_bin(n: Column) -> Column:
    return F.when(n < 20, "<20").when(n < 80, "20-79").when(n < 300, "80-299").otherwise("300+")


def approx_tokens(text: Column, per_token: float) -> Column:
    return F.bround(F.length(text) / per_token).cast("int")


def preview(text: Column, size: int = 60) -> Column:
    return F.substring(collapse(text), 1, size)


# -- repair and release ----------------------------------------------------------------------------------------------

def repair_bracket(text: Column) -> Column:
    """A [ that touches a Latin letter is a misread letter."""
    return F.regexp_replace(text, rf"(?<=[{_LETTERS}])\[|\[(?=[{_LETTERS}])", "ë")


def fold_homoglyphs(text: Column) -> Column:
    return F.translate(text, *HOMOGLYPHS)


def fold_mixed_words(text: Column) -> Column:
    """Homoglyphs are folded only in words that mix both scripts."""
    parts = F.regexp_extract_all(text, F.lit(rf"([{_LETTERS}Ѐ-ӿ]+|[^{_LETTERS}Ѐ-ӿ]+)"), F.lit(1))
    mixed = lambda w: F.regexp_like(w, F.lit("[Ѐ-ӿ]")) & F.regexp_like(w, F.lit(f"[{_LETTERS}]"))
    return F.array_join(F.transform(parts, lambda w: F.when(mixed(w), fold_homoglyphs(w)).otherwise(w)), "")


def clean_field(text: Column) -> Column:
    return collapse(fold_homoglyphs(text))


def redact(text: Column) -> Column:
    for _, pattern, placeholder in REDACTIONS:
        text = F.regexp_replace(text, pattern, placeholder.replace("[", "\\[").replace("]", "\\]"))
    return text


def redaction_counts(text: Column) -> dict[str, Column]:
    out = {}
    for name, pattern, placeholder in REDACTIONS:
        out[name] = count_of(text, pattern)
        text = F.regexp_replace(text, pattern, placeholder)
    return out


def residual_identifiers(text: Column) -> Column:
    out = F.lit(0)
    for _, pattern, _ in REDACTIONS:
        out = out + count_of(text, pattern)
    return out


def is_redacted(a: Column, b: Column) -> Column:
    return F.greatest(*[x.contains(mark) for x in (a, b) for _, _, mark in REDACTIONS])


def person_cues(first: Column, second: Column) -> Column:
    """The labels of the person-context cues that fire."""
    side = {"first": first, "second": second}
    return F.array_compact(F.array(*[F.when(F.regexp_like(F.coalesce(side[s], F.lit("")), F.lit("(?iuU)" + p)), label) for s, p, label in PERSON_CUES]))


#: What may end a headword without being part of it: bracketed notes, inflections, separators.
HEADWORD_TAILS = r"(?:\s*\([^()]*\)[\s;:,.]*|,\s*-\s*[^\s,]+|[;:,]+|\s+)+$"


def clean_headword(text: Column) -> Column:
    """The entry without its tails, however many follow each other; words in capitals of over four characters become
    lower-case."""
    bare = collapse(F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), "(?U)" + HEADWORD_TAILS, ""))
    capitals = (F.upper(bare) == bare) & (F.lower(bare) != bare) & (F.length(bare) > 4)
    return F.when(capitals, F.lower(bare)).otherwise(bare)


def term_hit(tokens: Column, need: Column) -> Column:
    """Every needed token has a hypothesis token that starts as it does, up to two letters from its end."""
    starts = lambda t: F.exists(tokens, lambda h: F.startswith(h, F.substring(t, F.lit(1), F.greatest(F.lit(4), F.length(t) - 2))))
    return (F.size(need) > 0) & F.forall(need, starts)
