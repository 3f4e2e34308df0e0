"""Ordered prefix operators that never put a whole group into one task.

``Window.partitionBy(doc)`` sends a document to a single task, which fails when one document holds a large
share of all rows. Here such a group is cut into segments; the window runs per segment, a short table carries one
row per segment, and the running value of the earlier segments is joined back. The segment column must be
monotone in the order columns. Callers that have checked that no group is large pass no segment and get one plain
window, which keeps consecutive scans on one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafspan.session import cut_lineage

ROWS_PER_SEGMENT = 65_536
# Groups up to this many rows run as one sorted window without trouble.
ROWS_PER_WINDOW = 1_000_000


@dataclass(frozen=True)
class Running:
    """A running value: ``sum``, ``max``, ``min`` or ``last`` (last non-null) of ``value``."""

    kind: str
    value: Column
    inclusive: bool = True

    def over(self, window) -> Column:
        frame = window.rowsBetween(Window.unboundedPreceding, 0 if self.inclusive else -1)
        if self.kind == "last":
            return F.last(self.value, ignorenulls=True).over(frame)
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.kind](self.value).over(frame)


def segment_rows(largest_group: int | None) -> int | None:
    """Segment length for a known largest group: none needed when it fits a single window."""
    return None if (largest_group or 0) <= ROWS_PER_WINDOW else ROWS_PER_SEGMENT


def position_segment(position: str, rows: int | None = ROWS_PER_SEGMENT) -> Column | None:
    """Segment number of a dense integer position, or none for groups known to be small."""
    return None if rows is None else F.floor(F.col(position) / F.lit(rows))


def quantile_segment(df: DataFrame, column: str, rows: int = ROWS_PER_WINDOW) -> Column | None:
    """Segment number of a numeric column from approximate quantiles, or none when all rows fit one window."""
    total = df.count()
    parts = min(2_000, -(-total // rows))
    if parts <= 1:
        return None
    cuts = df.stat.approxQuantile(column, [i / parts for i in range(1, parts)], 0.1 / parts)
    bounds = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))])
    return F.size(F.filter(bounds, lambda b: b <= F.col(column)))


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    running: dict[str, Running],
    segment: Column | None,
    reverse: bool = False,
) -> DataFrame:
    """Add one column per entry of ``running``, evaluated in ``order`` (or backwards) within ``keys``.

    ``order`` must be a total order within a group.
    """
    keys = list(keys)
    ordering = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    if segment is None:
        whole = Window.partitionBy(*keys).orderBy(*ordering)
        return df.select("*", *[spec.over(whole).alias(out) for out, spec in running.items()])

    names = {out: f"__value_{i}" for i, out in enumerate(running)}
    base = df.select("*", segment.alias("__segment"), *[spec.value.alias(names[out]) for out, spec in running.items()])
    # The rows are read twice below, for the segment totals and for the scan itself.
    base = cut_lineage(base)
    local = Window.partitionBy(*keys, "__segment").orderBy(*ordering)
    across = (
        Window.partitionBy(*keys)
        .orderBy(F.col("__segment").desc() if reverse else F.col("__segment").asc())
    )
    position = F.struct(*[F.col(c) for c in order])
    nearest = F.min_by if reverse else F.max_by

    totals, carries, scanned = [], [], base
    for out, spec in running.items():
        value, carry = F.col(names[out]), f"__carry_{names[out]}"
        scanned = scanned.withColumn(out, Running(spec.kind, value, spec.inclusive).over(local))
        carries.append(Running(spec.kind, value, inclusive=False).over(across).alias(carry))
        if spec.kind == "last":
            totals.append(nearest(value, F.when(value.isNotNull(), position)).alias(names[out]))
        else:
            totals.append({"sum": F.sum, "max": F.max, "min": F.min}[spec.kind](value).alias(names[out]))

    summary = base.groupBy(*keys, "__segment").agg(*totals).select(*keys, "__segment", *carries)
    joined = scanned.join(summary, [*keys, "__segment"])
    for out, spec in running.items():
        carry = F.col(f"__carry_{names[out]}")
        if spec.kind == "last":
            merged = F.coalesce(F.col(out), carry)
        elif spec.kind == "sum":
            merged = F.when(
                F.col(out).isNull() & carry.isNull(), F.lit(None)
            ).otherwise(F.coalesce(F.col(out), F.lit(0)) + F.coalesce(carry, F.lit(0)))
        else:
            merged = (F.greatest if spec.kind == "max" else F.least)(F.col(out), carry)
        joined = joined.withColumn(out, merged)
    return joined.drop("__segment", *names.values(), *[f"__carry_{n}" for n in names.values()])


def dense_number(df: DataFrame, keys: Sequence[str], position: str, out: str, rows: int | None = ROWS_PER_SEGMENT) -> DataFrame:
    """Number the rows of each group 1..n in ``position`` order, keeping every other column."""
    numbered = prefix_scan(df, keys, [position], {out: Running("sum", F.lit(1))}, position_segment(position, rows))
    return numbered.withColumn(out, F.col(out).cast("int"))
