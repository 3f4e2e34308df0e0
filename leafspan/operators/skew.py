"""Joins that keep working when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(
    large: DataFrame, small: DataFrame, on: Sequence[str], salt_from: Sequence[str], how: str = "inner", salts: int = 16
) -> DataFrame:
    """Equi-join that spreads each key of ``large`` over ``salts`` partitions.

    ``salt_from`` names columns of ``large`` that vary within a hot key. ``small`` is replicated per salt, so it
    should be the side with few rows per key. ``how`` may be inner, left, left_semi or left_anti.
    """
    left = large.withColumn("__salt", F.pmod(F.xxhash64(*salt_from), F.lit(salts)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "__salt"], how).drop("__salt")
