"""Segmented scans must equal plain windows, including when one group holds most rows."""

import random

import pytest
from leafspan.operators.ranking import gradient_cut, skyline, skyline_two
from leafspan.operators.scan import Running, position_segment, prefix_scan
from leafspan.operators.skew import salted_join
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for group, size in (("hot", 120), ("b", 7), ("c", 1)):
        data += [(group, i, rng.choice([None, rng.randint(0, 50)])) for i in range(1, size + 1)]
    return spark.createDataFrame(data, "g string, pos int, v int").cache()


@pytest.mark.parametrize("kind", ["sum", "max", "min", "last"])
@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("reverse", [True, False])
def test_segments_equal_window(rows, kind, inclusive, reverse):
    spec = {"out": Running(kind, F.col("v"), inclusive)}
    plain = prefix_scan(rows, ["g"], ["pos"], spec, None, reverse)
    cut = prefix_scan(rows, ["g"], ["pos"], spec, position_segment("pos", 5), reverse)
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, cut.select(plain.columns).collect()), key=str)


def _dominated(p, points):
    return any(all(a >= b for a, b in zip(s, p)) and any(a > b for a, b in zip(s, p)) for s in points)


@pytest.mark.parametrize("seed", [1, 2])
def test_skylines_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    data = [("hot" if i % 3 else "cold", i, rng.randint(0, 12), rng.randint(0, 12), rng.randint(0, 4)) for i in range(150)]
    df = spark.createDataFrame(data, "g string, id int, x int, y int, z int")
    groups = {g: [r for r in data if r[0] == g] for g in ("hot", "cold")}
    two = {r[1] for rs in groups.values() for r in rs if not _dominated(r[2:4], [s[2:4] for s in rs])}
    three = {r[1] for rs in groups.values() for r in rs if not _dominated(r[2:5], [s[2:5] for s in rs])}
    segment = F.floor(F.col("x") / 3)
    assert {r.id for r in skyline_two(df, ["g"], "x", "y").collect()} == two
    assert {r.id for r in skyline_two(df, ["g"], "x", "y", segment).collect()} == two
    assert {r.id for r in skyline(df, ["g"], ["x", "y", "z"], block_rows=10).collect()} == three


def test_gradient_cut(spark):
    data = [("a", 0.9), ("a", 0.6), ("a", 0.35), ("a", 0.34), ("b", 0.49), ("c", 0.8), ("c", 0.8), ("c", 0.47)]
    df = spark.createDataFrame(data, "g string, score double")
    kept = sorted(map(tuple, gradient_cut(df, ["g"], "score").collect()))
    assert kept == [("a", 0.6), ("a", 0.9), ("c", 0.8), ("c", 0.8)]
    cut = gradient_cut(df, ["g"], "score", segment=F.floor(F.col("__down") * 4))
    assert sorted(map(tuple, cut.collect())) == kept


def test_salted_join_keeps_left_rows(spark):
    large = spark.range(200).select((F.col("id") % 2).alias("k"), "id")
    small = spark.createDataFrame([(0, "zero")], "k long, name string")
    joined = salted_join(large, small, ["k"], ["id"], "left", salts=7).collect()
    assert len(joined) == 200 and sum(r.name == "zero" for r in joined) == 100
