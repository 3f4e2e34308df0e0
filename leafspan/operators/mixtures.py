"""Gaussian mixtures of many groups at once: every document's texts are clustered on their own.

A group of ordinary size is fitted inside one task, all numbers of clusters that its size allows being tried. A larger one
is first cut in two halves along its widest direction, again and again until its parts are of ordinary size; the halves are
found by distributed medians, so no task ever holds more than one part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspan.session import cut_lineage

# Reduced dimensions, least probability of a member, and how many clusters a group may have.
DIMENSIONS = 5
MEMBERSHIP = 0.1
MOST_CLUSTERS = 50
ITEMS_PER_CLUSTER = 10
LARGE_GROUP = 5_000
ITEMS_PER_CLUSTER_LARGE = 100
REGULARISATION = 1e-6
# Items of a part that is fitted in one task.
PART_ITEMS = 10_000
ITERATIONS = 50


def cluster_counts(n: int) -> list[int]:
    """Numbers of clusters to try for a group of ``n`` items."""
    if n > LARGE_GROUP:
        most = n // ITEMS_PER_CLUSTER_LARGE
        return list(range(max(2, most - 1), most + 1))
    return list(range(1, max(2, min(MOST_CLUSTERS, n // ITEMS_PER_CLUSTER))))


def reduced(vectors: np.ndarray, dimensions: int) -> np.ndarray:
    """Principal components of unit vectors; the sign of a component makes its largest weight positive."""
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    centred = vectors / np.where(length > 0, length, 1)
    centred = centred - centred.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :dimensions]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return centred @ axes


def _log_densities(points: np.ndarray, means: np.ndarray, covariances: np.ndarray, shares: np.ndarray) -> np.ndarray:
    out = np.empty((len(points), len(means)))
    for k, (mean, covariance) in enumerate(zip(means, covariances)):
        factor = np.linalg.cholesky(covariance)
        scaled = np.linalg.solve(factor, (points - mean).T)
        out[:, k] = -0.5 * ((scaled**2).sum(axis=0) + len(mean) * np.log(2 * np.pi)) - np.log(np.diag(factor)).sum() + np.log(shares[k])
    return out


def fit_mixture(points: np.ndarray, count: int, seed: int = 0) -> tuple[np.ndarray, float]:
    """Probabilities of ``count`` clusters for every point, and the BIC of the fitted mixture."""
    n, d = points.shape
    draw = np.random.default_rng(seed)
    chosen = [int(draw.integers(n))]
    while len(chosen) < count:
        distance = np.min([((points - points[c]) ** 2).sum(axis=1) for c in chosen], axis=0)
        total = distance.sum()
        chosen.append(int(draw.choice(n, p=distance / total)) if total > 0 else int(draw.integers(n)))
    nearest = ((points[:, None, :] - points[chosen][None]) ** 2).sum(axis=2).argmin(axis=1)
    weights, before, likelihood = np.eye(count)[nearest], -np.inf, -np.inf
    for _ in range(ITERATIONS):
        size = weights.sum(axis=0) + 1e-10
        means = weights.T @ points / size[:, None]
        covariances = np.stack([
            (weights[:, k, None] * (points - means[k])).T @ (points - means[k]) / size[k] + REGULARISATION * np.eye(d) for k in range(count)
        ])
        joint = _log_densities(points, means, covariances, size / size.sum())
        top = joint.max(axis=1, keepdims=True)
        each = top[:, 0] + np.log(np.exp(joint - top).sum(axis=1))
        weights, likelihood = np.exp(joint - each[:, None]), float(each.sum())
        if likelihood - before < 1e-4 * n:
            break
        before = likelihood
    free = count * (d + d * (d + 1) / 2) + count - 1
    return weights, -2 * likelihood + free * np.log(n)


def memberships(vectors: np.ndarray, seed: int = 0) -> np.ndarray:
    """Which of the clusters of the mixture with the smallest BIC each vector belongs to; one cluster is a model like others."""
    n = len(vectors)
    dimensions = min(DIMENSIONS, vectors.shape[1], n - 2)
    if dimensions < 1:
        return np.ones((n, 1), bool)
    points = reduced(vectors, dimensions)
    fitted = [fit_mixture(points, count, seed) for count in cluster_counts(n)]
    weights = min(fitted, key=lambda f: f[1])[0]
    # With many clusters no probability need pass the limit; the likeliest cluster holds the item then.
    return (weights > MEMBERSHIP) | (weights == weights.max(axis=1, keepdims=True))


def grouped_clusters(items: DataFrame, group: str, item: str, vector: str, part_items: int = PART_ITEMS, seed: int = 0) -> DataFrame:
    """``(group, item, cluster)``: soft clusters of every group's items; ``cluster`` is text, unique within the group.

    Items must be numbered without repeats within their group. Items without a vector, and groups of them, are left out; all
    vectors of a group have one length. An item may belong to several clusters, and to at least one.
    """
    kinds = dict(items.dtypes)
    rows = items.filter(F.col(group).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(group).alias("group"), F.col(item).alias("item"), F.col(vector).cast("array<double>").alias("vector"), F.lit("").alias("part")
    )
    rows = _parted(cut_lineage(rows), part_items)

    def run(table: pa.Table) -> pa.Table:
        out_group, out_item, out_cluster = [], [], []
        name = pc.binary_join_element_wise(table.column("key"), table.column("part"), "#").to_pylist()
        at: dict[str, list[int]] = {}
        for i, key in enumerate(name):
            at.setdefault(key, []).append(i)
        groups, ids, vectors, parts = (table.column(c).to_pylist() for c in ("group", "item", "vector", "part"))
        for own in at.values():
            own.sort(key=lambda i: ids[i])
            member = memberships(np.array([vectors[i] for i in own], float), seed)
            # A cluster that no item belongs to has no number.
            number = np.cumsum(member.any(axis=0)) - 1
            for i, row in zip(own, member):
                for c in np.flatnonzero(row):
                    out_group.append(groups[i])
                    out_item.append(ids[i])
                    out_cluster.append(f"{parts[i]}{number[c]}")
        return pa.table({
            "group": pa.array(out_group, table.schema.field("group").type), "item": pa.array(out_item, table.schema.field("item").type),
            "cluster": pa.array(out_cluster, pa.string()),
        })

    tasks = max(64, rows.count() // part_items)
    task = F.pmod(F.xxhash64("key", "part"), F.lit(tasks))
    keyed = rows.withColumn("key", F.col("group").cast("string")).withColumn("task", task)
    found = keyed.groupBy("task").applyInArrow(run, f"group {kinds[group]}, item {kinds[item]}, cluster string")
    return found.select(F.col("group").alias(group), F.col("item").alias(item), "cluster")


def _parted(rows: DataFrame, part_items: int) -> DataFrame:
    """Parts of at most ``part_items`` items: large ones are halved at the median of their widest component until none is left."""
    while True:
        large = rows.groupBy("group", "part").agg(F.count("*").alias("n")).filter(F.col("n") > part_items)
        if large.isEmpty():
            return rows
        flat = rows.join(large.drop("n"), ["group", "part"], "left_semi").select("group", "part", F.posexplode("vector").alias("at", "x"))
        spread = flat.groupBy("group", "part", "at").agg(F.var_pop("x").alias("spread"))
        widest = spread.groupBy("group", "part").agg(F.max_by("at", F.struct("spread", -F.col("at"))).alias("at"), F.max("spread").alias("spread"))
        middle = flat.join(widest.select("group", "part", "at"), ["group", "part", "at"]).groupBy("group", "part").agg(
            F.percentile_approx("x", 0.5, 10_000).alias("middle")
        )
        cut = widest.join(middle, ["group", "part"]).select("group", "part", "at", "middle", "spread")
        # Where many items share the median value, a hash of the item halves them.
        halves = rows.join(cut, ["group", "part"], "left")
        value = F.get("vector", F.col("at"))
        even = F.when(F.pmod(F.xxhash64("item", "part"), F.lit(2)) == 0, "l").otherwise("r")
        side = F.when(F.col("at").isNull(), "").when(value < F.col("middle"), "l").when(value > F.col("middle"), "r").otherwise(even)
        rows = cut_lineage(halves.select("group", "item", "vector", F.concat("part", side).alias("part")))
