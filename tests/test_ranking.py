"""Combined rankings read their scores once."""

import random

from leafspan.operators import ranking
from pyspark.sql import functions as F


def test_fallback_evaluates_the_scores_once(spark):
    read = spark.sparkContext.accumulator(0)

    def scored(i):
        read.add(1)
        return ("q", i, float(i % 7), float(i % 5))

    rows = spark.sparkContext.parallelize(range(20), 2).map(scored)
    merged = spark.createDataFrame(rows, "qid string, item int, graph double, text double")
    found = {r.item for r in ranking.skyline_with_fallback(merged, ["qid"], "item", "graph", "text", 8, top=3).collect()}
    # The skyline is short, so that the first three of each ranking are added.
    points = {i: (i % 7, i % 5) for i in range(20)}
    best = {i for i, p in points.items() if not any(o[0] >= p[0] and o[1] >= p[1] and o != p for o in points.values())}
    leaders = {i for side in (0, 1) for i in sorted(points, key=lambda i: (-points[i][side], i))[:3]}
    assert found == best | leaders and read.value == 20


def test_beaten_rows_are_not_kept_and_still_count(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(q, i, float(rng.randint(0, 30)), float(rng.randint(0, 30))) for q in ("a", "b") for i in range(600)] + [("c", 1, 2.0, 3.0), ("c", 2, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "q string, i long, x double, y double")
    kept = ranking.contenders(df, ["q"], "i", "x", "y", 5)
    assert kept.count() < 400
    assert {r.q: r.n for r in kept.groupBy("q").agg(F.sum("__pool").alias("n")).collect()} == {"a": 600, "b": 600, "c": 2}
    monkeypatch.setattr(ranking, "HELD_ROWS", 50)
    for k in (2, 50):
        found = {tuple(r) for r in ranking.skyline_with_fallback(df, ["q"], "i", "x", "y", k).collect()}
        expected = set()
        for q in "abc":
            own = [r for r in rows if r[0] == q]
            best = {r[:2] for r in own if not any(s[2] >= r[2] and s[3] >= r[3] and s[2:] != r[2:] for s in own)}
            if len(best) < k <= len(own):
                for at in (2, 3):
                    best |= {r[:2] for r in sorted(own, key=lambda r: (-r[at], r[1]))[:5]}
            expected |= best
        assert found == expected
