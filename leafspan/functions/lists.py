"""List answers: number-aware normalisation and the best one-to-one alignment of predicted and gold items."""

from __future__ import annotations

import re
import string

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

# Number words.
UNITS = {
    w: i for i, w in enumerate(
        "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
        "eighteen nineteen".split()
    )
}
TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), start=2)}
SCALES = {"thousand": 10**3, "million": 10**6, "billion": 10**9}


def _number(token: str) -> float | None:
    try:
        return float(token)
    except ValueError:
        pass
    if token in UNITS:
        return float(UNITS[token])
    if token in TENS:
        return float(TENS[token])
    return float({"hundred": 100, **SCALES}[token]) if token in SCALES or token == "hundred" else None


def normalise_item(text: str) -> str:
    """Tokens split at blanks and dashes; numbers and number words become floats, articles and punctuation go."""
    kept = []
    for token in re.split("[ -]", text.lower()):
        if _number(token) is None:
            token = "".join(c for c in token if c not in string.punctuation)
        value = _number(token)
        token = str(value) if value is not None else re.sub(r"\b(a|an|the)\b", " ", token)
        kept += token.split()
    return " ".join(kept)


def _pair_score(predicted: set, gold: set) -> float:
    numbers = {t for t in gold if _number(t) is not None}
    if numbers and not numbers & predicted:
        return 0.0
    shared = len(predicted & gold)
    precision = shared / len(predicted) if predicted else 1.0
    recall = shared / len(gold) if gold else 1.0
    return 2 * precision * recall / (precision + recall) if precision + recall else 0.0


def best_alignment(scores: np.ndarray) -> float:
    """Largest total score of a one-to-one assignment, by shortest augmenting paths on potentials."""
    size = max(scores.shape)
    cost = np.zeros((size + 1, size + 1))
    cost[1 : scores.shape[0] + 1, 1 : scores.shape[1] + 1] = -scores
    row_potential, column_potential = np.zeros(size + 1), np.zeros(size + 1)
    match = np.zeros(size + 1, dtype=int)
    for row in range(1, size + 1):
        match[0], column = row, 0
        slack, used, came = np.full(size + 1, np.inf), np.zeros(size + 1, dtype=bool), np.zeros(size + 1, dtype=int)
        while match[column]:
            used[column] = True
            reduced = cost[match[column]] - row_potential[match[column]] - column_potential
            better = ~used & (reduced < slack)
            slack[better], came[better] = reduced[better], column
            step_to = int(np.argmin(np.where(used, np.inf, slack)))
            delta = slack[step_to]
            row_potential[match[used]] += delta
            column_potential[used] -= delta
            slack[~used] -= delta
            column = step_to
        while column:
            match[column] = match[came[column]]
            column = came[column]
    return float(-sum(cost[match[c], c] for c in range(1, size + 1)))


@F.pandas_udf(DoubleType())
def list_f1(predicted: pd.Series, gold: pd.Series) -> pd.Series:
    """Mean item F1 under the best alignment, rounded to two digits; 0 when a list has no items, null when one is null."""
    def one(ours, theirs) -> float | None:
        if ours is None or theirs is None:
            return None
        if not len(ours) or not len(theirs):
            return 0.0
        ours = [set(normalise_item(x).split()) for x in ours]
        theirs = [set(normalise_item(x).split()) for x in theirs]
        scores = np.array([[_pair_score(p, g) for p in ours] for g in theirs])
        return float(round(best_alignment(scores) / max(len(ours), len(theirs)), 2))

    return pd.Series([one(p, g) for p, g in zip(predicted, gold, strict=True)], dtype="float64")


@F.pandas_udf(ArrayType(StringType()))
def normalise_items(items: pd.Series) -> pd.Series:
    return items.map(lambda values: None if values is None else [normalise_item(v) for v in values])


def list_exact(predicted, gold):
    """1 when both lists hold the same normalised items and have the same length."""
    ours, theirs = normalise_items(predicted), normalise_items(gold)
    same = F.array_sort(F.array_distinct(ours)) == F.array_sort(F.array_distinct(theirs))
    return (same & (F.size(ours) == F.size(theirs))).cast("double")
