"""Usage accounting, deduplication and sharding of question sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafspan.operators.scan import Running, prefix_scan, quantile_segment


def totals(usage: DataFrame, measures: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Summed cost measures; a missing value counts as 0."""
    return usage.groupBy(*keys).agg(*[F.sum(F.coalesce(F.col(m), F.lit(0))).alias(m) for m in measures])


def stage_deltas(snapshots: DataFrame, run: str, order: str, total: str, segment: Column | None = None) -> DataFrame:
    """Usage per stage from the running totals recorded after each stage of a run."""
    before = {"__before": Running("last", F.col(total), inclusive=False)}
    scanned = prefix_scan(snapshots, [run], [order], before, segment)
    return scanned.withColumn("delta", F.col(total) - F.coalesce("__before", F.lit(0))).drop("__before")


def merge_runs(entries: DataFrame, keys: Sequence[str], sequence: str, timing: str, tokens: str) -> DataFrame:
    """Statistics over repeated runs: the first timing stays, the last non-zero token count wins."""
    return entries.groupBy(*keys).agg(
        F.min_by(timing, F.when(F.col(timing).isNotNull(), F.col(sequence))).alias(timing),
        F.max_by(tokens, F.when(F.col(tokens) != 0, F.col(sequence))).alias(tokens),
    )


def accumulate(previous: DataFrame, current: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Cost of resumed runs: old and new records are added."""
    return totals(previous.unionByName(current), measures, keys)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in an explicit order, as one aggregation that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col("first")[c].alias(c) for c in rest])


def value_counts(df: DataFrame, column: str, unit: str) -> DataFrame:
    """Rows and distinct units per value."""
    return df.groupBy(column).agg(F.count("*").alias("n"), F.countDistinct(unit).alias("n_units"))


def questions_per_document(questions: DataFrame, keys: Sequence[str]) -> DataFrame:
    return questions.groupBy(*keys).agg(F.count("*").alias("n_questions"))


def assign_shards(documents: DataFrame, key: str, shards: int) -> DataFrame:
    """Contiguous shard numbers 1..n over the sorted distinct documents.

    The document positions come from counts of range partitions, so no task sorts all documents.
    """
    ids = documents.select(key).distinct()
    cuts = ids.count()
    size = max(1, -(-cuts // shards))
    parts = max(1, min(1_000, -(-cuts // 1_000_000)))
    if parts == 1:
        numbered = ids.withColumn("nth", F.row_number().over(Window.orderBy(key)) - 1)
    else:
        numbered = _numbered_by_range(ids, key, parts)
    return numbered.select(key, (F.floor(F.col("nth") / size) + 1).cast("int").alias("shard"))


def _numbered_by_range(ids: DataFrame, key: str, parts: int) -> DataFrame:
    segment = quantile_segment(ids, key, max(1, ids.count() // parts))
    return prefix_scan(ids, [], [key], {"nth": Running("sum", F.lit(1), inclusive=False)}, segment).withColumn(
        "nth", F.coalesce("nth", F.lit(0))
    )


def sample_by_hash(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Reproducible sample of ``n`` rows in the order of a seeded hash; executed as a bounded top-n."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
