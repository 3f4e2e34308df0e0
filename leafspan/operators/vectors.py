"""Exact nearest-neighbour joins in cosine space.

A brute-force join compares every query with every vector. Here vectors are grouped into cells around a bounded
set of pivots, cells are cut into blocks of bounded size, and the triangle inequality of the angular distance
decides which blocks a query has to visit. Blocks are compared as matrices inside Arrow batches and only the best
``k`` per query and shelf, a bounded run of blocks, leave a task, so no pair table is ever materialised and no task receives
more than one shelf of vectors and one part of its visitors. A query travels once a shelf with the list of blocks it has to
visit there, and a shelf once a part; both are large, because what is shuffled grows with their numbers. Equal vectors are
compared once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafspan.session import cut_lineage, cut_stage

PIVOTS = 64
BLOCK_ROWS = 4_096
# Vectors of a shelf and visitors of a part at most; numbers in a shelf; rows that are compared at once.
SHELF_ROWS = 32_768
PART_ROWS = 16_384
SHELF_NUMBERS = 4_194_304
STRIPE_ROWS = 2_048
# Shelves, and parts of a shelf's visitors, that a scope is dealt into where it has so many blocks.
LEAST_PIECES = 8
ANGLE_SLACK = 1e-6
SIMILARITY_DIGITS = 9
ROUNDING = 1e-9


def _unit(rows: pd.Series) -> np.ndarray:
    matrix = np.array(rows.tolist(), dtype=np.float64)
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)


def _choose_pivots(vectors: DataFrame, count: int) -> np.ndarray:
    """A bounded, reproducible set of vectors that depends on the values only."""
    rows = vectors.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(count).collect()
    return _unit(pd.Series([r.vector for r in rows])) if rows else np.zeros((0, 0))


def _angles(matrix: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(matrix @ pivots.T, -1.0, 1.0))


def _angles_to_pivots(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the angle of each row's ``vector`` to every pivot."""

    def measure(batches):
        for batch in batches:
            batch["angles"] = list(_angles(_unit(batch["vector"]), pivots)) if len(batch) else []
            yield batch

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema]
    return rows.mapInPandas(measure, ", ".join([*fields, "angles array<double>"]))


def similarities(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``pairs`` with the cosine ``similarity`` of two vector columns of one width in their place, 0 for a vector of length 0."""
    kept = [f for f in pairs.schema if f.name not in (left, right)]
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "similarity double"])

    def matrix(column: pa.Array) -> np.ndarray:
        rows = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        size = np.linalg.norm(rows, axis=1, keepdims=True)
        return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)

    def measure(batches):
        for batch in batches:
            if batch.num_rows:
                cosine = np.einsum("ij,ij->i", matrix(batch.column(left)), matrix(batch.column(right)))
                columns = [batch.column(f.name) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.round(cosine, SIMILARITY_DIGITS))], [*(f.name for f in kept), "similarity"])

    return pairs.mapInArrow(measure, fields)


def _best_cells(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` largest scores of each row, and of those equal to the last of them."""
    width = scores.shape[1]
    if k >= width:
        return tuple(x.ravel() for x in np.indices(scores.shape))
    valid = np.where(np.isnan(scores), -np.inf, scores)
    return np.nonzero(valid >= np.partition(valid, width - k, axis=1)[:, width - k, None])


def _compare(
    queries: DataFrame, base: DataFrame, id_type: str, query_type: str, minimum: float | None
) -> DataFrame:
    """Best ``wanted`` of each shelf of base blocks for the queries routed to it; ``visits`` lists the blocks a query meets.

    A task takes the rows of one ``(bundle, shelf, part)``; a bundle holds many small scopes, or the shelves of a
    large one next to a few small ones, and is compared scope by scope.
    """

    def best_of_scope(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, ...]:
        keys = right["vector_key"].to_numpy()
        order = np.argsort(keys, kind="stable")
        keys, there = keys[order], _unit(right["vector"])[order]
        blocks, of = np.unique(right["block"].to_numpy()[order], return_inverse=True)
        members = [np.flatnonzero(of == b) for b in range(len(blocks))]
        here, wanted, visits = _unit(left["vector"]), left["wanted"].to_numpy(), left["visits"].to_numpy()
        meets = np.zeros((len(left), len(blocks)), dtype=bool)
        asked = np.repeat(np.arange(len(left)), [len(v) for v in visits])
        meets[asked, np.searchsorted(blocks, np.concatenate(visits))] = True
        found = []
        for start in range(0, len(left), STRIPE_ROWS):
            parts = []
            for b, columns in enumerate(members):
                rows = start + np.flatnonzero(meets[start : start + STRIPE_ROWS, b])
                if len(rows):
                    scores = np.round(here[rows] @ there[columns].T, SIMILARITY_DIGITS)
                    r, c = _best_cells(scores, int(wanted[rows].max()))
                    parts.append((rows[r], columns[c], scores[r, c]))
            row, column, score = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, int)] * 3
            sorting = np.lexsort((column, -score, row))
            row, column, score = row[sorting], column[sorting], score[sorting]
            inside = np.arange(len(row)) - np.searchsorted(row, row) < wanted[row]
            found.append((row[inside], column[inside], score[inside]))
        row, column, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return left["query_id"].to_numpy()[row], wanted[row], keys[column], score

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        base = dict(list(right.groupby("scope", sort=False)))
        found = [best_of_scope(rows, base[scope]) for scope, rows in left.groupby("scope", sort=False) if scope in base]
        columns = [np.concatenate(parts) for parts in zip(*found, strict=True)] or [[]] * 4
        if found and minimum is not None:
            columns = [c[columns[3] >= minimum] for c in columns]
        # Some versions of pandas hand over empty columns of strings in a form that Arrow refuses.
        return pd.DataFrame(dict(zip(["query_id", "wanted", "vector_key", "similarity"], columns, strict=True)), dtype=None if len(columns[0]) else object)

    address = ["bundle", "shelf", "part"]
    return (
        queries.groupBy(*address)
        .cogroup(base.groupBy(*address))
        .applyInPandas(best, f"query_id {query_type}, wanted int, vector_key {id_type}, similarity double")
    )


def nearest(
    queries: DataFrame,
    vectors: DataFrame,
    query_id: str,
    query_vector: str,
    vector_id: str,
    vector: str,
    k: int | str,
    scope: str | None = None,
    min_similarity: float | None = None,
    exclude_same_id: bool = False,
    block_rows: int = BLOCK_ROWS,
    pivot_count: int = PIVOTS,
) -> DataFrame:
    """Exact ``(query_id, rank, vector_id, similarity)`` of the ``k`` most similar vectors per query.

    ``k`` is a number, or the column of ``queries`` that holds each query's own number, at least 1. Ties are broken by vector id. With ``scope``, a column of both inputs, a query only meets vectors of its own
    scope (a document); ids must then be unique over all scopes. ``min_similarity`` drops matches below it and then
    bounds the search directly; without it a first visit to one block of the query's nearest cell yields the bound.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[vector_id].dataType.simpleString()
    query_type = queries.schema[query_id].dataType.simpleString()
    spare = 1 if exclude_same_id else 0
    own = isinstance(k, str)
    # Copies beyond the longest list are never asked for.
    most = (queries.agg(F.max(k)).first()[0] or 1) if own else k

    def scoped(df: DataFrame, id_column: str, vector_column: str, name: str, *more: Column) -> DataFrame:
        return df.select(
            (F.col(scope) if scope else F.lit(0)).alias("scope"),
            F.col(id_column).alias(name), F.col(vector_column).cast("array<double>").alias("vector"), *more,
        )

    # Copies of one vector are compared once, under the smallest id that carries it. Ties go to smaller ids, so the
    # first k copies are all a result can ever use.
    same = Window.partitionBy("scope", "vector").orderBy("vector_id")
    copies = (
        scoped(vectors, vector_id, vector, "vector_id")
        .withColumn("nth", F.row_number().over(same))
        .filter(F.col("nth") <= most + spare)
        .withColumn("vector_key", F.first("vector_id").over(same))
        .persist()
    )
    distinct = copies.filter(F.col("nth") == 1).select("scope", "vector_key", "vector")
    # Pivots pay off once a scope holds several blocks; smaller scopes are compared in one visit.
    sizes = distinct.groupBy("scope").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"))
    total, largest, width = sizes.agg(F.sum("n"), F.max("n"), F.max("width")).first()
    wanted = -(-(largest or 0) * 4 // block_rows)
    bundle = F.pmod(F.xxhash64("scope"), F.lit(max(1, 4 * (total or 0) // block_rows))).cast("int")
    if not total:
        return spark.createDataFrame([], f"{query_id} {query_type}, rank int, {vector_id} {id_type}, similarity double")
    wanted_rows = ((F.col(k) if own else F.lit(k)) + spare).cast("int").alias("wanted")
    asking = scoped(queries, query_id, query_vector, "query_id", wanted_rows)

    def ranked(matches: DataFrame) -> DataFrame:
        best = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("vector_key").asc())
        leaders = matches.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= F.col("wanted")).drop("rank")
        # Bring the copies back: the k best distinct vectors hold at least the k best ids.
        expanded = leaders.join(copies.select("vector_key", "vector_id"), "vector_key").drop("vector_key")
        if exclude_same_id:
            expanded = expanded.filter(F.col("query_id") != F.col("vector_id"))
        final = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("vector_id").asc())
        return (
            expanded.withColumn("rank", F.row_number().over(final).cast("int"))
            .filter(F.col("rank") <= F.col("wanted") - spare)
            .select(F.col("query_id").alias(query_id), "rank", F.col("vector_id").alias(vector_id), "similarity")
        )

    if largest <= block_rows and (asking.groupBy("scope").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= block_rows:
        # Every scope is one block, which all its queries visit: nothing is routed.
        address = [bundle.alias("bundle"), *(F.lit(0).alias(name) for name in ("shelf", "part"))]
        block = F.lit(0).cast("long")
        return ranked(_compare(
            asking.select("query_id", "vector", "wanted", "scope", F.array(block).alias("visits"), *address),
            distinct.select("vector_key", "vector", "scope", block.alias("block"), *address),
            id_type, query_type, min_similarity,
        ))

    pivots = _choose_pivots(distinct, min(pivot_count, wanted) if wanted > 4 else 1)
    placed = _angles_to_pivots(distinct, pivots).withColumn("angle", F.array_min("angles"))
    placed = placed.withColumn("cell", (F.array_position("angles", F.col("angle")) - 1).cast("int")).drop("angles").persist()
    # Blocks of a scope in order of their cells fill its shelves.
    most = max(block_rows, min(SHELF_ROWS, SHELF_NUMBERS // max(1, width or 0)))
    whole, earlier = Window.partitionBy("scope"), Window.partitionBy("scope").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    held = F.sum("n").over(whole)
    shelves = F.greatest(F.ceil(held / most), F.least(F.lit(LEAST_PIECES), F.ceil(held / block_rows)))
    limits = (
        placed.groupBy("scope", "cell")
        .agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
        .withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int"))
        .withColumns({"start": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "shelf_rows": F.ceil(held / shelves)})
        .persist()
    )

    def shelved(df: DataFrame) -> DataFrame:
        """``shelf`` and number ``code`` of a block, from the columns of ``limits``."""
        first = F.col("start") + F.floor(F.col("n") * F.col("block") / F.col("blocks"))
        return df.withColumns({"shelf": F.floor(first / F.col("shelf_rows")).cast("int"), "code": F.shiftleft(F.col("cell").cast("long"), 32) + F.col("block")})

    placed = shelved(placed.join(limits.drop("low", "high"), ["scope", "cell"]).withColumn(
        "block", F.pmod(F.xxhash64("vector"), F.col("blocks")).cast("int")
    ))
    asked = _angles_to_pivots(asking, pivots)
    reach = (
        asked.select("scope", "query_id", F.posexplode("angles").alias("cell", "angle"))
        .join(limits, ["scope", "cell"])
        .withColumn("gap", F.greatest(F.col("angle") - F.col("high"), F.col("low") - F.col("angle"), F.lit(0.0)))
    )
    questions = asked.select("query_id", "vector", "wanted")

    def visit(targets: DataFrame) -> DataFrame:
        """Compare targets, queries with the columns of ``limits`` and a ``block``; shelves with many visitors are visited in parts."""
        targets = shelved(targets).groupBy("scope", "query_id", "shelf").agg(F.collect_set("code").alias("visits"), F.count("*").alias("times"))
        # Repeated queries stay repeated. Read for the number of visitors and for the visits.
        targets = cut_stage(targets.withColumn("times", F.explode(F.array_repeat(F.lit(0), (F.col("times") / F.size("visits")).cast("int")))).drop("times"))
        visitors = targets.groupBy("scope", "shelf").agg(F.count("*").alias("n"))
        parts = visitors.withColumn(
            "parts", F.greatest(F.ceil(F.col("n") / max(block_rows, PART_ROWS)), F.least(F.lit(LEAST_PIECES), F.ceil(F.col("n") / block_rows))).cast("int")
        ).drop("n")
        left = (
            targets.join(parts, ["scope", "shelf"])
            .withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
            .join(questions, "query_id")
        )
        right = placed.join(parts, ["scope", "shelf"]).withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        )
        return _compare(
            left.select("query_id", "vector", "wanted", "scope", "visits", bundle.alias("bundle"), "shelf", "part"),
            right.select("vector_key", "vector", "scope", F.col("code").alias("block"), bundle.alias("bundle"), "shelf", "part"),
            id_type, query_type, min_similarity,
        )

    if len(pivots) == 1:
        bounded = reach.withColumn("bound", F.lit(float(np.pi)))
    elif min_similarity is not None:
        bounded = reach.withColumn("bound", F.lit(float(np.arccos(np.clip(min_similarity - ROUNDING, -1.0, 1.0)))))
    else:
        home = reach.groupBy("scope", "query_id").agg(F.min(F.struct("angle", "cell", "blocks", "n", "start", "shelf_rows")).alias("home"))
        first = visit(
            home.select("scope", "query_id", "home.*").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
        )
        kth = first.groupBy("query_id").agg(
            F.when(F.count("*") >= F.max("wanted"), F.acos(F.greatest(F.min("similarity") - ROUNDING, F.lit(-1.0))))
            .otherwise(F.lit(float(np.pi))).alias("bound")
        )
        bounded = reach.join(kth, "query_id")
    matches = visit(
        bounded.filter(F.col("gap") <= F.col("bound") + ANGLE_SLACK)
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    return ranked(matches)


def nearest_within(
    queries: DataFrame, vectors: DataFrame, query_id: str, query_vector: str, vector_id: str, vector: str,
    max_distance: float = 0.3, group: str | None = None, exclude_same_id: bool = False,
) -> DataFrame:
    """Map each query to its nearest vector when the cosine distance is below ``max_distance``.

    With ``group`` (the question a query entity belongs to), a question none of whose entities qualifies is mapped
    through its single globally nearest pair, so that every question keeps one starting point.
    """
    top = cut_lineage(nearest(queries, vectors, query_id, query_vector, vector_id, vector, 1, exclude_same_id=exclude_same_id))
    top = top.withColumn("distance", F.round(1 - F.col("similarity"), SIMILARITY_DIGITS)).drop("rank", "similarity")
    if group is None:
        return top.filter(F.col("distance") < max_distance).withColumn("forced", F.lit(False))
    top = top.join(queries.select(query_id, group), query_id)
    closest = top.groupBy(group).agg(
        F.min(F.struct("distance", query_id, vector_id)).alias("closest")
    )
    forced = closest.filter(F.col("closest.distance") >= max_distance).select(
        F.col(f"closest.{query_id}").alias(query_id), F.col(f"closest.{vector_id}").alias(vector_id),
        F.col("closest.distance").alias("distance"), F.lit(True).alias("forced"), group,
    )
    near = top.filter(F.col("distance") < max_distance).withColumn("forced", F.lit(False))
    return near.unionByName(forced)


def search_one(vectors: DataFrame, vector_id: str, vector: str, question: list[float], k: int) -> DataFrame:
    """Top ``k`` for one question vector: a scan with a bounded heap per task."""
    from leafspan.functions.vectors import cosine

    literal = F.array(*[F.lit(float(x)) for x in question])
    similarity = F.round(cosine(F.col(vector), literal), SIMILARITY_DIGITS)
    return (
        vectors.select(vector_id, similarity.alias("similarity"))
        .orderBy(F.col("similarity").desc(), F.col(vector_id).asc())
        .limit(k)
    )
