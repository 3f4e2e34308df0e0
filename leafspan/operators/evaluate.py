"""Evaluation aggregates over scored answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspan.functions.lists import list_exact, list_f1
from leafspan.functions.scoring import NOT_ANSWERABLE, containment, token_f1, typed_score


def accuracy_and_f1(samples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy over all samples; F1 of recall over answerable and precision over answered samples.

    Samples without a score do not count. Without answerable or answered samples F1 is 0.
    """
    answerable = F.col("answer") != NOT_ANSWERABLE
    answered = F.col("pred") != NOT_ANSWERABLE
    hits = F.coalesce(F.sum(F.when(answerable, F.col("score"))), F.lit(0.0))
    recall, precision = hits / F.nullif(F.count_if(answerable), F.lit(0)), hits / F.nullif(F.count_if(answered), F.lit(0))
    f1 = F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0)
    return samples.filter(F.col("score").isNotNull()).groupBy(*keys).agg(
        F.avg("score").alias("accuracy"), F.coalesce(f1, F.lit(0.0)).alias("f1")
    )


def mean_scores(samples: DataFrame, measures: Sequence[str], keys: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Mean of each measure over all and over answerable samples, and both counts."""
    answerable = F.col("answer") != NOT_ANSWERABLE
    columns = [F.count("*").alias("n_all"), F.count_if(answerable).alias("n_answerable")]
    for measure in measures:
        columns.append(F.round(F.avg(measure), digits).alias(f"{measure}_all"))
        columns.append(F.round(F.avg(F.when(answerable, F.col(measure))), digits).alias(f"{measure}_answerable"))
    return samples.groupBy(*keys).agg(*columns)


def best_over_references(results: DataFrame, key: str, predicted: str, references: str) -> DataFrame:
    """Highest token F1 and containment of each prediction over its list of reference answers."""
    pairs = results.select(key, predicted, F.explode(references).alias("__gold"))
    return (
        pairs.select(
            key, token_f1(F.col(predicted), F.col("__gold")).alias("__f1"),
            containment(F.col(predicted), F.array("__gold")).alias("__accuracy"),
        )
        .groupBy(key).agg(F.max("__f1").alias("f1"), F.max("__accuracy").alias("accuracy"))
    )


def score_answers(results: DataFrame, dataset: str) -> DataFrame:
    """Score ``results`` by the rules of a dataset kind.

    ``typed``: ``answer, pred, answer_format`` give ``score`` and ``f1_token``. ``lists``: arrays ``answers`` and
    ``pred_list`` give ``em`` and ``f1``. ``references``: ``key, pred, references`` give ``accuracy`` and ``f1``.
    """
    if dataset == "typed":
        pair = F.col("answer"), F.col("pred")
        return results.withColumns({
            "score": typed_score(*pair, F.col("answer_format")), "f1_token": token_f1(F.col("pred"), F.col("answer"))
        })
    if dataset == "lists":
        return results.withColumns({"em": list_exact(F.col("pred_list"), F.col("answers")), "f1": list_f1("pred_list", "answers")})
    if dataset == "references":
        return best_over_references(results, "key", "pred", "references")
    raise ValueError(f"unknown dataset kind {dataset}")
