"""Hard negatives against brute force: ties, repeated rows, nulls, non-finite and unequal vectors, blocks of anchors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafspan.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, id string, part int, vector int, anchor string, score int"


def table(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], SCHEMA).repartition(parts)


def made(n, seed, spread=3):
    draw = np.random.default_rng(seed)
    centre = draw.normal(0, 0.3, 8)
    return [(i, int(draw.integers(0, spread)), [float(np.float32(v)) for v in np.round(centre + draw.normal(0, 0.2, 8), 1)]) for i in range(n)]


def brute(rows, positives=5, count=5, low=80, high=100):
    good = [
        (i, label, [math.floor(256 * v) for v in vector]) for i, label, vector in rows
        if i is not None and label is not None and vector is not None and all(v is not None and math.isfinite(v) for v in vector)
    ]
    out = []
    for i, label, own in good:
        if i % 10:
            continue
        scored = [(-sum(a * b for a, b in zip(own, v)), j, other) for j, other, v in good if len(v) == len(own) and j != i]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            s = -s
            fits = sorted(x for x in scored if x[2] != label and low * s <= -100 * x[0] <= high * s)
            out += [(i, p, n, j, s, -m) for n, (m, j, _) in enumerate(fits[:count], 1)]
    return sorted(out)


def mine(df, **more):
    return sorted(tuple(r) for r in negatives.hard_negatives(df, F.coalesce(F.col("vec_id") % 10 == 0, F.lit(False)), **more).collect())


@pytest.mark.parametrize("block_bytes", [300, 4_000_000])
def test_equal_to_brute_force(spark, block_bytes):
    rows = made(160, 3)
    rows += [(200 + i, i % 2, rows[20][2]) for i in range(40)]  # many equal vectors
    rows += [(300, 0, None), (310, None, rows[1][2]), (None, 1, rows[2][2]), (320, 1, [float("nan")] * 8), (330, 1, [1.0, None] * 4), (340, 2, [float("inf")] * 8)]
    rows += [(350, 0, []), (360, 1, []), (370, 0, [0.5, 0.5]), (371, 0, [0.5, 0.25]), (372, 1, [0.4, 0.3]), (380, 1, [-v for v in rows[0][2]])]
    got = mine(table(spark, rows), block_bytes=block_bytes)
    assert got == brute(rows) and len(got) > 300


def test_repeated_rows_count_each(spark):
    rows = made(60, 8)
    rows += [rows[10], rows[10], rows[11], rows[12]]
    assert mine(table(spark, rows)) == brute(rows)


def test_other_windows_and_sizes(spark):
    rows = made(120, 5, spread=2)
    assert mine(table(spark, rows), positives=7, negatives=3, low=50, high=90) == brute(rows, 7, 3, 50, 90)


def test_large_components_stay_exact(spark):
    rows = [(i, i % 2, [float(v) * 2**18 for v in vector]) for i, _, vector in made(40, 6)]
    rows = [(i, label, [v + 2.0**-3 * (j % 2) for j, v in enumerate(vector)]) for i, label, vector in rows]
    assert mine(table(spark, rows)) == brute([(i, label, [float(np.float32(v)) for v in vector]) for i, label, vector in rows])
    with pytest.raises(Exception, match="do not fit a long"):
        mine(table(spark, [(0, 0, [1e30] * 8), (1, 0, [1e30] * 8)]))


def test_no_rows(spark):
    rows = made(30, 2)
    assert mine(table(spark, rows).limit(0)) == []
    assert mine(table(spark, [r for r in rows if r[0] % 10])) == []
    assert mine(table(spark, [(0, 0, [0.1] * 8)])) == []


def test_suffixes_of_slots():
    slots = {0: [(9, 1), (8, 2)], 2: [(5, 4), (5, 7), (1, 3)]}
    assert negatives.suffix_best(slots, 3, 3) == [[(9, 1), (8, 2), (5, 4)], [(5, 4), (5, 7), (1, 3)], [(5, 4), (5, 7), (1, 3)]]
    assert negatives.limits_of(-10, 80, 100) == (-8, -10) and negatives.limits_of(7, 80, 100) == (6, 7)
