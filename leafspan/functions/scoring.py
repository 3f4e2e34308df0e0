"""Answer scoring expressions: normalisation, edit similarity, token and list measures."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from leafspan.functions import text as T

NOT_ANSWERABLE = "Not answerable"
ANLS_THRESHOLD = 0.5

# Answers of these forms are compared exactly.
EXACT_PATTERNS = [
    r"https://", r"\.py$", r"ipynb$", r"^page", r"^\d+(-\d+|\s\d+)?$", r"a\.m\.", r"p\.m\.",
    r"^\d{4}[-\s]\d{2}[-\s]\d{2}$", r"^\d{4}[-\s]\d{2}$", r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
]


def normalise_answer(text: Column) -> Column:
    """Lower-case, drop punctuation and articles, squeeze blanks."""
    plain = F.regexp_replace(F.lower(text), T.PUNCTUATION, "")
    return T.squeeze(F.regexp_replace(plain, r"(?U)\b(a|an|the)\b", " "))


def clean_answer(text: Column) -> Column:
    """Lower-case and trim, drop bracketed remarks, one quote at each end, leading ``$`` and trailing ``%``."""
    kept = F.regexp_replace(T.strip(F.lower(text)), r"\s*\([^)]*\)", "")
    kept = T.strip(F.regexp_replace(T.strip(kept), "^['\"]|['\"]$", ""))
    kept = T.strip(F.regexp_replace(kept, r"^\$+", ""))
    return T.strip(F.regexp_replace(kept, "%+$", ""))


def wants_exact_match(text: Column) -> Column:
    return F.rlike(text, F.lit("|".join(EXACT_PATTERNS)))


def anls(gold: Column, predicted: Column, threshold: float = ANLS_THRESHOLD) -> Column:
    """Normalised edit similarity; values up to the threshold count as 0, two empty strings as 1."""
    longest = F.greatest(F.length(F.upper(gold)), F.length(F.upper(predicted)))
    value = F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(gold, predicted) / longest)
    return F.when(value <= threshold, 0.0).otherwise(value)


def _decimals(number: Column) -> Column:
    """Digits after the point in the shortest decimal form, at most 15; whole numbers have one."""
    text = F.regexp_extract(number.cast("string"), r"\.(\d+)", 1)
    return F.greatest(F.length(text), F.lit(1))


def _rounded_equal(left: Column, right: Column, digits: Column) -> Column:
    scale = F.pow(F.lit(10.0), digits)
    return F.bround(left * scale) == F.bround(right * scale)


def float_equal(gold: Column, predicted: Column, percentage: bool = True, tolerance: float = 0.01) -> Column:
    """Numeric equality within 1 %, or after rounding to the coarser precision, at least two digits.

    With ``percentage`` the gold value may also be meant as a share or as a percentage of it.
    """
    candidates = [gold / 100, gold, gold * 100] if percentage else [gold]
    tests = []
    for item in candidates:
        close = F.abs(item - predicted) <= tolerance * F.greatest(F.abs(item), F.abs(predicted))
        digits = F.greatest(F.least(_decimals(predicted), _decimals(item)), F.lit(2))
        tests.append(close | _rounded_equal(item, predicted, digits))
    result = tests[0]
    for test in tests[1:]:
        result = result | test
    return F.coalesce(result, F.lit(False))


def parse_list(text: Column) -> Column:
    """Items of a literal list such as ``['a', "b", 3]``; any other text is a list of one."""
    inner = F.regexp_extract(T.strip(text), r"(?s)^\[(.*)\]$", 1)
    pattern = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[^,\s'\"\[\]][^,\[\]]*"
    items = F.transform(
        F.regexp_extract_all(inner, F.lit(pattern), F.lit(0)), lambda x: F.regexp_replace(T.strip(x), "^['\"]|['\"]$", "")
    )
    return F.when(F.startswith(text, F.lit("[")), items).otherwise(F.array(text))


def typed_score(gold: Column, predicted: Column, kind: Column) -> Column:
    """Score of an answer by its declared type: Int, Float, Str, None or List."""
    gold_number, predicted_number = T.parse_number(gold), T.parse_number(predicted)
    gold_int = F.when(gold.rlike(r"^\s*[-+]?\d+\s*$"), F.trim(gold).try_cast("bigint"))
    int_score = F.coalesce(gold_int == predicted_number.cast("bigint"), F.lit(False)).cast("double")
    float_score = float_equal(T.parse_number(clean_answer(gold)), T.parse_number(clean_answer(predicted))).cast("double")
    g, p = clean_answer(gold), clean_answer(predicted)
    text_score = F.when(wants_exact_match(g), (g == p).cast("double")).otherwise(anls(g, p))
    golds = F.array_sort(F.transform(parse_list(gold), clean_answer))
    predictions = F.array_sort(F.transform(parse_list(predicted), clean_answer))
    first = F.get(golds, F.lit(0))
    exact_list = T.parse_number(first).isNotNull() | wants_exact_match(first)
    list_score = F.when(F.size(golds) != F.size(predictions), 0.0).when(
        exact_list, (F.array_join(golds, "-") == F.array_join(predictions, "-")).cast("double")
    ).otherwise(F.array_min(F.zip_with(golds, predictions, lambda a, b: anls(a, b))))
    return (
        F.when(kind == "Int", int_score).when(kind == "Float", float_score)
        .when(kind.isin("Str", "None"), text_score).otherwise(list_score)
    )


def token_f1(predicted: Column, gold: Column) -> Column:
    """F1 over normalised tokens counted with multiplicity; 0 without a common token."""
    ours, theirs = T.words(normalise_answer(predicted)), T.words(normalise_answer(gold))
    same, total = _shared_tokens(ours, theirs), F.size(ours) + F.size(theirs)
    return F.when(same == 0, 0.0).otherwise(2 * same / total)


@F.pandas_udf(LongType())
def _shared_tokens(ours: pd.Series, theirs: pd.Series) -> pd.Series:
    shared = [sum((Counter(a) & Counter(b)).values()) for a, b in zip(ours, theirs, strict=True)]
    return pd.Series(shared, dtype="int64")


def evidence_f1(predicted: Column, gold: Column) -> Column:
    """F1 of two evidence lists as sets; two empty lists agree."""
    same = F.size(F.array_intersect(predicted, gold))
    precision, recall = same / F.size(predicted), same / F.size(gold)
    return (
        F.when((F.size(predicted) == 0) & (F.size(gold) == 0), 1.0).when(same == 0, 0.0)
        .otherwise(2 * precision * recall / (precision + recall))
    )


def containment(predicted: Column, golds: Column) -> Column:
    """1 when the normalised prediction contains some normalised gold answer."""
    answer = normalise_answer(predicted)
    return F.exists(golds, lambda g: F.contains(answer, normalise_answer(g))).cast("int")


def references(answers: Column) -> Column:
    """Reference strings of structured answers, in the order unanswerable, extractive, free-form, yes or no."""
    def one(a: Column) -> Column:
        return (
            F.when(a["unanswerable"], NOT_ANSWERABLE)
            .when(F.size(a["extractive_spans"]) > 0, F.array_join(a["extractive_spans"], ", "))
            .when(a["free_form_answer"] != "", a["free_form_answer"])
            .when(a["yes_no"], "Yes").otherwise("No")
        )

    return F.transform(answers, one)


def text_evidence(answers: Column) -> Column:
    """Evidence paragraphs of structured answers without references to floats."""
    return F.transform(answers, lambda a: F.filter(a["evidence"], lambda e: ~F.contains(e, F.lit("FLOAT SELECTED"))))


# Keys of a judge's reply and what stands in for a missing one.
JUDGE_DEFAULTS = {"extracted results": "Failed to extract", "format": "Failed to extract", "score": "0.0"}


def parse_judgement(text: Column) -> Column:
    """Struct of the ``key: value`` lines a judge returns; the last line with a key counts."""
    fields = []
    for key, default in JUDGE_DEFAULTS.items():
        found = F.regexp_extract_all(text, F.lit(rf"(?im)^[ \t]*{key}[ \t]*:(.*)$"), F.lit(1))
        value = F.when(F.size(found) > 0, T.strip(F.element_at(found, -1))).otherwise(default)
        fields.append(value.alias(key.replace(" ", "_")))
    return F.struct(*fields)
