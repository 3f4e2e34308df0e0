"""Combining rankings: score merge, skyline, fallback and score cut-offs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafspan.operators.scan import Running, prefix_scan, quantile_segment
from leafspan.session import cut_stage

BLOCK_ROWS = 8_192
# Rows that a task holds back while it looks for those that cannot be in a result.
HELD_ROWS = 200_000


def merge_scores(rankings: Sequence[DataFrame], keys: Sequence[str], score: str = "score") -> DataFrame:
    """Full outer merge of several rankings into ``score_1 .. score_n``, 0.0 where a ranking lacks the row.

    One union and one aggregation instead of a chain of outer joins.
    """
    tagged = [r.select(*keys, F.lit(i).alias("ranking"), F.col(score).alias("value")) for i, r in enumerate(rankings)]
    union = tagged[0]
    for other in tagged[1:]:
        union = union.unionByName(other)
    columns = [
        F.coalesce(F.max(F.when(F.col("ranking") == i, F.col("value"))), F.lit(0.0)).alias(f"score_{i + 1}")
        for i in range(len(rankings))
    ]
    return union.groupBy(*keys).agg(*columns)


def skyline_two(df: DataFrame, keys: Sequence[str], x: str, y: str, segment=None) -> DataFrame:
    """Rows no other row of the same group dominates in two dimensions (both larger is better).

    Rows are first reduced to the best ``y`` per distinct ``x``; a segmented running maximum from the largest ``x``
    down then replaces the quadratic comparison. Equal points survive together.
    """
    steps = df.groupBy(*keys, x).agg(F.max(y).alias("__own"))
    segment = quantile_segment(steps, x) if segment is None else segment
    scanned = prefix_scan(
        steps, keys, [x], {"__above": Running("max", F.col("__own"), inclusive=False)}, segment, reverse=True
    )
    kept = scanned.filter(F.col("__above").isNull() | (F.col("__above") < F.col("__own")))
    return df.join(kept.select(*keys, x, F.col("__own").alias(y)), [*keys, x, y], "left_semi")


def skyline(df: DataFrame, keys: Sequence[str], dims: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Skyline in any number of dimensions.

    Distinct points are filtered inside bounded blocks first; the surviving candidates of a group are then compared
    block against block. A task holds two blocks, and only dominated points leave it.
    """
    keys, dims = list(keys), list(dims)
    points = df.select(*keys, *dims).distinct().withColumn("__id", F.xxhash64(*keys, *dims))
    if not keys:
        points = points.withColumn("__group", F.lit(0))
    group = keys or ["__group"]

    def blocked(rows: DataFrame, seed: int) -> DataFrame:
        sizes = rows.groupBy(*group).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("__blocks"))
        return rows.join(sizes, group).withColumn(
            "__block", F.pmod(F.xxhash64("__id", F.lit(seed)), F.col("__blocks")).cast("int")
        )

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf[dims].to_numpy(dtype=np.float64)
        return pdf[~_dominated(values, values)]

    first = blocked(points, 1)
    candidates = first.groupBy(*group, "__block").applyInPandas(local, first.schema).drop("__block", "__blocks")
    candidates = blocked(candidates, 2).persist()
    single = candidates.filter(F.col("__blocks") == 1)
    # A group that fits one block is done after one more local pass over the survivors of its first blocks.
    final = single.groupBy(*group, "__block").applyInPandas(local, candidates.schema)

    several = candidates.filter(F.col("__blocks") > 1)
    challenged = several.withColumn("__rival", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    rivals = challenged.select(
        *[F.col(c).alias(c) for c in group], F.col("__block").alias("__rival"), F.col("__rival").alias("__block"),
        *[F.col(c).alias(c) for c in dims],
    )

    def losers(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return left.iloc[:0]
        return left[_dominated(left[dims].to_numpy(dtype=np.float64), right[dims].to_numpy(dtype=np.float64))]

    beaten = (
        challenged.groupBy(*group, "__block", "__rival")
        .cogroup(rivals.groupBy(*group, "__block", "__rival"))
        .applyInPandas(losers, challenged.schema)
    )
    unbeaten = several.join(beaten.select(*group, *dims).distinct(), [*group, *dims], "left_anti")
    winners = final.select(*keys, *dims).unionByName(unbeaten.select(*keys, *dims))
    return df.join(winners, [*keys, *dims], "left_semi")


def _dominated(points: np.ndarray, rivals: np.ndarray, stripe: int = 256) -> np.ndarray:
    """Which points some rival dominates; works in stripes so that memory stays bounded."""
    result = np.zeros(len(points), dtype=bool)
    for start in range(0, len(points), stripe):
        chunk = points[start : start + stripe, None, :]
        result[start : start + stripe] = ((rivals >= chunk).all(-1) & (rivals > chunk).any(-1)).any(1)
    return result


def _contenders(rows: pd.DataFrame, keys: list[str], item: str, x: str, y: str, top: int) -> pd.DataFrame:
    """Rows in the skyline or among the ``top`` of a score within ``rows``; the first of a group takes over its ``__pool``."""
    group = rows.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
    one, two, place = rows[x].to_numpy(), rows[y].to_numpy(), np.empty(len(rows), dtype=np.int64)
    place[np.argsort(rows[item].to_numpy(), kind="stable")] = np.arange(len(rows))
    kept = np.zeros(len(rows), dtype=bool)
    for score in (one, two):
        order = np.lexsort((place, -score, group))
        first = np.searchsorted(group[order], group[order])
        kept[order[np.arange(len(rows)) - first < top]] = True
    # Steps are the best second score of each first score, the largest first; one has to beat those before it.
    order = np.lexsort((-two, -one, group))
    g, u, v = group[order], one[order], two[order]
    starts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (u[1:] != u[:-1])])
    step = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(g)]))
    best = pd.Series(v[starts])
    before = best.groupby(g[starts]).cummax().groupby(g[starts]).shift().to_numpy()
    kept[order[((v == v[starts][step]) & ~(before >= v[starts])[step])]] = True
    pool = np.bincount(group, rows["__pool"].to_numpy()).astype(np.int64)
    leads = np.unique(group[kept], return_index=True)
    counts = np.zeros(int(kept.sum()), dtype=np.int64)
    counts[leads[1]] = pool[leads[0]]
    return rows[kept].assign(__pool=counts)


def contenders(merged: DataFrame, keys: Sequence[str], item: str, x: str, y: str, top: int) -> DataFrame:
    """``merged`` without rows that are neither in a skyline nor among the ``top`` of a score, with ``__pool``.

    A task leaves out what other rows of its own already beat, so that the pairs of a group are not kept. The sum of ``__pool`` is the
    number of rows that a group had. Rows without an item or a score stay.
    """
    keys, limit = list(keys), HELD_ROWS

    def run(batches):
        held, n, schema = [], 0, None

        def told(rows: pd.DataFrame) -> pa.RecordBatch:
            return pa.RecordBatch.from_pandas(rows, schema, preserve_index=False)

        def fewer() -> pd.DataFrame:
            return _contenders(pd.concat(held, ignore_index=True), keys, item, x, y, top)

        for batch in batches:
            schema = batch.schema.append(pa.field("__pool", pa.int64()))
            # Whole numbers stay what they are beside nulls.
            rows = batch.to_pandas(integer_object_nulls=True).assign(__pool=1)
            plain = rows[[item, x, y]].notna().all(axis=1)
            if not plain.all():
                yield told(rows[~plain])
            held.append(rows[plain])
            n += len(held[-1])
            if n >= limit:
                held, n = [fewer()], 0
                if len(held[0]) > limit // 2:
                    yield told(held.pop())
        if sum(map(len, held)):
            yield told(fewer())

    rows = merged.select(*keys, item, x, y)
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "__pool long"])
    return rows.mapInArrow(run, fields)


def skyline_with_fallback(
    merged: DataFrame, keys: Sequence[str], item: str, graph: str, text: str, k: int, top: int = 5
) -> DataFrame:
    """Skyline of two scores, topped up with the best of each ranking when it is too small.

    The top-up happens for groups whose skyline holds fewer than ``k`` of at least ``k`` candidates.
    """
    # Read by every branch below, which need no row that others of its task beat.
    merged = cut_stage(contenders(merged, keys, item, graph, text, top))
    winners = cut_stage(skyline_two(merged, keys, graph, text).select(*keys, item))
    size = winners.groupBy(*keys).agg(F.count("*").alias("__winners"))
    pool = merged.groupBy(*keys).agg(F.sum("__pool").alias("__pool"))
    short = size.join(pool, list(keys)).filter((F.col("__winners") < k) & (F.col("__pool") >= k)).select(*keys)
    lists = [winners]
    for column in (graph, text):
        order = Window.partitionBy(*keys).orderBy(F.col(column).desc(), F.col(item).asc())
        leaders = merged.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= top)
        lists.append(leaders.join(short, list(keys), "left_semi").select(*keys, item))
    return lists[0].unionByName(lists[1]).unionByName(lists[2]).distinct()


def top_k(df: DataFrame, keys: Sequence[str], score: str, tie: str, k: int) -> DataFrame:
    """Best ``k`` rows per group with ties by ``tie``; the limit is applied before the shuffle as well."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(tie).asc())
    return df.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)


def gradient_cut(
    df: DataFrame, keys: Sequence[str], score: str, ratio: float = 0.6, minimum: float = 0.5, segment=None
) -> DataFrame:
    """Keep a descending list until a score falls below ``ratio`` times its predecessor.

    Lists whose best score is under ``minimum`` are dropped. Equal scores never break a list, so the scan runs over
    the distinct scores of a group and is segmented like every other ordered operator.
    """
    steps = df.groupBy(*keys, score).agg(F.count("*").alias("__rows")).withColumn("__down", -F.col(score))
    segment = quantile_segment(steps, "__down") if segment is None else segment
    value = F.col(score)
    steps = prefix_scan(
        steps, keys, ["__down"],
        {"__previous": Running("last", value, inclusive=False), "__best": Running("max", value)},
        segment,
    )
    broken = F.when(value < F.col("__previous") * ratio, 1).otherwise(0)
    steps = prefix_scan(steps, keys, ["__down"], {"__broken": Running("max", broken)}, segment)
    kept = steps.filter((F.col("__broken") == 0) & (F.col("__best") >= minimum))
    return df.join(kept.select(*keys, score), [*keys, score], "left_semi")
