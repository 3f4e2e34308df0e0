"""Mixtures per group: the number of clusters, no mixing of groups, parts of large groups, and summaries of one document each."""

import numpy as np
from leafspan.models.base import ExtractiveGenerator, HashEmbedder
from leafspan.operators import mixtures, summaries


def blobs(n, centres, seed):
    draw = np.random.default_rng(seed)
    return [[float(v) for v in np.array(centres[i % len(centres)]) + draw.normal(0, 0.03, len(centres[0]))] for i in range(n)]


AXES = np.eye(6).tolist()


def test_numbers_of_clusters_follow_the_size():
    assert mixtures.cluster_counts(7) == [1] and mixtures.cluster_counts(100) == list(range(1, 10))
    assert mixtures.cluster_counts(5_000) == list(range(1, 50)) and mixtures.cluster_counts(6_000) == [59, 60]


def test_the_smallest_bic_decides_and_may_be_one_cluster():
    one = mixtures.memberships(np.random.default_rng(2).normal(0, 1, (60, 6)))
    three = mixtures.memberships(np.array(blobs(90, AXES[:3], 1)))
    assert one.sum(axis=1).min() >= 1 and one.any(axis=0).sum() == 1
    assert three.any(axis=0).sum() == 3 and len({tuple(np.flatnonzero(r)) for r in three[:3]}) == 3
    assert mixtures.memberships(np.ones((2, 4))).shape == (2, 1) and mixtures.memberships(np.ones((40, 4))).sum(axis=1).min() >= 1


def test_groups_are_fitted_apart_and_large_ones_in_parts(spark):
    rows = [("a", i, v) for i, v in enumerate(blobs(60, AXES[:2], 3))] + [("b", i, v) for i, v in enumerate(blobs(90, AXES[3:6], 4))]
    rows += [("c", i, [1.0] * 6) for i in range(70)] + [("d", 0, None), (None, 1, [1.0] * 6)]
    df = spark.createDataFrame(rows, "doc_id string, nth long, v array<double>").repartition(4)
    found = mixtures.grouped_clusters(df, "doc_id", "nth", "v").collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, {}).setdefault(r.cluster, set()).add(r.nth)
    assert set(by) == {"a", "b", "c"} and len(by["a"]) == 2 and len(by["b"]) == 3
    assert all(len({n % 3 for n in members}) == 1 for members in by["b"].values())
    cut = mixtures.grouped_clusters(df, "doc_id", "nth", "v", part_items=25).collect()
    sizes = {}
    for r in cut:
        sizes.setdefault((r.doc_id, r.cluster.rstrip("0123456789")), set()).add(r.nth)
    assert max(map(len, sizes.values())) <= 25
    assert {(r.doc_id, r.nth) for r in cut} == {(r[0], r[1]) for r in rows if r[0] and r[2]}


def test_summaries_stay_within_a_document_and_in_order(spark):
    texts = [(d, i, f"{d}word{i % 2} {d}item{i}") for d in ("x", "y") for i in range(30)] + [("z", 0, "zword zonly")]
    levels = summaries.document_levels(spark.createDataFrame(texts, "doc_id string, nth int, text string"), HashEmbedder(8), ExtractiveGenerator(200)).collect()
    assert all(w.startswith(r.doc_id) for r in levels for w in r.text.split())
    top = {d: max(r.depth for r in levels if r.doc_id == d) for d in "xyz"}
    assert top["z"] == 0 and top["x"] >= 1
    covered = {w for r in levels if r.doc_id == "x" and r.depth == 1 for w in r.text.split()}
    assert {f"xitem{i}" for i in range(30)} <= covered
    for r in levels:
        if r.depth == 1:
            numbers = [int(w.split("item")[1]) for w in r.text.split() if "item" in w]
            assert numbers == sorted(numbers)
