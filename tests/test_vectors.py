"""The pruned neighbour join must equal brute force."""

import numpy as np
import pytest
from leafspan.operators import vectors
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(240, 8))
    base[100:180] = base[100]  # one vector holds a third of all rows
    base[7] = 0.0
    rows = [(int(i), [float(x) for x in v], "hot" if i % 3 else "cold") for i, v in enumerate(base)]
    return base, rows, spark.createDataFrame(rows, "id long, v array<double>, s string").cache()


def brute(base, rows, k, same_scope, minimum=-2.0):
    size = np.linalg.norm(base, axis=1, keepdims=True)
    unit = np.divide(base, size, out=np.zeros_like(base), where=size > 0)
    scores = np.round(unit @ unit.T, 9)
    expected = {}
    for i in range(len(base)):
        others = [j for j in range(len(base)) if j != i and (not same_scope or rows[i][2] == rows[j][2]) and scores[i, j] >= minimum]
        expected[i] = sorted(others, key=lambda j: (-scores[i, j], j))[:k]
    return expected


@pytest.mark.parametrize("scope,minimum", [(None, None), ("s", None), ("s", 0.3)])
def test_neighbours(data, scope, minimum):
    base, rows, df = data
    asked = df.selectExpr("id AS q", "v", "s")
    found = vectors.nearest(
        asked, df, "q", "v", "id", "v", 4, scope=scope, min_similarity=minimum, exclude_same_id=True, block_rows=16, pivot_count=6
    ).collect()
    ours = {i: [] for i in range(len(base))}
    for r in sorted(found, key=lambda r: (r.q, r.rank)):
        ours[r.q].append(r.id)
    assert ours == brute(base, rows, 4, scope is not None, -2.0 if minimum is None else minimum)


@pytest.mark.parametrize("block_rows", [4, 4_096])
def test_each_query_has_its_own_list_length(spark, block_rows):
    rng = np.random.default_rng(5)
    rows = [(f"v{i:02d}", i % 2, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, doc_id int, v array<double>")
    asked = df.select(F.col("id").alias("asked"), "doc_id", "v", (1 + F.substring("id", 2, 2).cast("int") % 7).alias("n"))
    got = {}
    for r in vectors.nearest(asked, df, "asked", "v", "id", "v", "n", scope="doc_id", exclude_same_id=True, block_rows=block_rows).collect():
        got.setdefault(r.asked, {})[r.rank] = r.id
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    scope = {i: s for i, s, _ in rows}
    for i in unit:
        others = sorted((j for j in unit if j != i and scope[j] == scope[i]), key=lambda j: (-round(float(unit[i] @ unit[j]), 9), j))
        assert [got[i][r] for r in sorted(got[i])] == others[: 1 + int(i[1:]) % 7]


def test_neighbours_are_searched_once_for_near_and_forced_matches(spark, monkeypatch):
    searched = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(similarity):
        searched.add(1)
        return similarity

    found = spark.createDataFrame([(1, 1, 7, 0.9), (2, 1, 8, 0.1), (3, 1, 9, 0.2)], "q int, rank int, v int, similarity double")
    monkeypatch.setattr(vectors, "nearest", lambda *_, **__: found.withColumn("similarity", counted("similarity")))
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "q int, g string")
    rows = vectors.nearest_within(asked, found, "q", "e", "v", "e", 0.3, group="g").collect()
    assert sorted((r.q, r.v, r.forced) for r in rows) == [(1, 7, False), (3, 9, True)]
    assert searched.value == 3


def test_a_query_travels_once_a_shelf(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    sent, compare = [], vectors._compare

    def counted(queries, *rest):
        sent.append(queries.count())
        return compare(queries, *rest)

    monkeypatch.setattr(vectors, "_compare", counted)
    found = vectors.nearest(df.selectExpr("id AS q", "v"), df, "q", "v", "id", "v", 3, exclude_same_id=True, block_rows=4, pivot_count=4).collect()
    # There are 60 blocks and more, which all queries visit; the visits to a shelf are one row.
    assert max(sent) <= 240 * (vectors.LEAST_PIECES + 1)
    unit = np.array([v / np.linalg.norm(v) for _, v in rows])
    scores = np.round(unit @ unit.T, 9)
    expected = {(i, j) for i in range(240) for j in sorted((j for j in range(240) if j != i), key=lambda j: (-scores[i, j], j))[:3]}
    assert {(r.q, r.id) for r in found} == expected
