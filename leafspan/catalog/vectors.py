"""Vector search over ``embeddings``."""

from leafspan.catalog.base import query, table
from leafspan.functions import vectors as V
from leafspan.operators import vectors
from pyspark.sql import functions as F

WIDE = "wide AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"

CENTROIDS = f"""{WIDE},
parts AS (SELECT label, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM wide),
means AS (SELECT label, i, round(avg(x), 9) AS x FROM parts GROUP BY ALL),
centroids AS (SELECT label, list(x ORDER BY i) AS v FROM means GROUP BY label)"""

EACH_PAIR = f"""{WIDE},
pairs AS (
  SELECT a.vec_id AS query_id, a.label, b.vec_id, round(list_cosine_similarity(a.v, b.v), 9) AS similarity
  FROM wide a JOIN wide b ON a.vec_id <> b.vec_id)"""


def centroids(spark, sf):
    """One mean vector per label."""
    parts = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.round(F.avg("x"), 9).alias("x"))
    return means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("centroid")
    )


@query(
    "vector_topk_batch",
    f"""WITH {CENTROIDS}
SELECT label, CAST(rank AS INTEGER) AS rank, vec_id, round(similarity, 9) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS rank FROM (
    SELECT c.label, w.vec_id, round(list_cosine_similarity(c.v, w.v), 9) AS similarity FROM centroids c, wide w))
WHERE rank <= 10""",
)
def vector_topk_batch(spark, sf):
    found = vectors.nearest(centroids(spark, sf), table(spark, sf, "embeddings"), "label", "centroid", "vec_id", "embedding", 10)
    return found.withColumn("similarity", F.round("similarity", 9))


@query(
    "vector_neighbours",
    f"""WITH {EACH_PAIR}
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(similarity, 9) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 5""",
)
def vector_neighbours(spark, sf):
    data = table(spark, sf, "embeddings")
    asked = data.select(F.col("vec_id").alias("query_id"), "embedding")
    found = vectors.nearest(asked, data, "query_id", "embedding", "vec_id", "embedding", 5, exclude_same_id=True)
    return found.withColumn("similarity", F.round("similarity", 9))


NEAREST = f"""{EACH_PAIR},
nearest AS (
  SELECT query_id, label, vec_id, round(1 - similarity, 9) AS distance FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM pairs)
  WHERE rank = 1)"""


@query(
    "vector_nearest_within",
    f"WITH {NEAREST} SELECT query_id, vec_id, round(distance, 9) AS distance, FALSE AS forced FROM nearest WHERE distance < 0.62",
)
def vector_nearest_within(spark, sf):
    data = table(spark, sf, "embeddings")
    asked = data.select(F.col("vec_id").alias("query_id"), "embedding")
    found = vectors.nearest_within(asked, data, "query_id", "embedding", "vec_id", "embedding", 0.62, exclude_same_id=True)
    return found.withColumn("distance", F.round("distance", 9))


@query(
    "vector_force_one",
    f"""WITH {NEAREST},
closest AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, query_id, vec_id) AS rank FROM nearest)
SELECT query_id, vec_id, label, round(distance, 9) AS distance, distance >= 0.53 AS forced
FROM closest WHERE distance < 0.53 OR rank = 1""",
)
def vector_force_one(spark, sf):
    data = table(spark, sf, "embeddings")
    asked = data.select(F.col("vec_id").alias("query_id"), "embedding", "label")
    found = vectors.nearest_within(
        asked, data, "query_id", "embedding", "vec_id", "embedding", 0.53, group="label", exclude_same_id=True
    )
    return found.withColumn("distance", F.round("distance", 9))


@query(
    "vector_normalise",
    f"""WITH {WIDE}
SELECT vec_id, round(sqrt(list_dot_product(v, v)), 9) AS length,
       round(v[1] / sqrt(list_dot_product(v, v)), 9) AS first_component,
       round(list_sum(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 9) AS component_sum
FROM wide""",
)
def vector_normalise(spark, sf):
    data = table(spark, sf, "embeddings").select("vec_id", V.as_double(F.col("embedding")).alias("v"))
    data = data.select("vec_id", V.norm(F.col("v")).alias("size"), V.normalise(F.col("v")).alias("unit"))
    return data.select(
        "vec_id", F.round("size", 9).alias("length"), F.round(F.get("unit", F.lit(0)), 9).alias("first_component"),
        F.round(F.aggregate("unit", F.lit(0.0), lambda a, x: a + x), 9).alias("component_sum"),
    )


@query(
    "vector_label_similarity",
    f"""WITH {CENTROIDS}
SELECT w.vec_id, w.label, round((list_cosine_similarity(w.v, c.v) + 1) / 2, 9) AS positive_similarity
FROM wide w JOIN centroids c USING (label)""",
)
def vector_label_similarity(spark, sf):
    data = table(spark, sf, "embeddings")
    scored = V.positive_similarity(V.cosine(F.col("embedding"), F.col("centroid")))
    return data.join(centroids(spark, sf), "label").select("vec_id", "label", F.round(scored, 9).alias("positive_similarity"))


@query(
    "vector_neighbours_in_scope",
    f"""WITH {WIDE}
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(similarity, 9) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM (
    SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.v, b.v), 9) AS similarity
    FROM wide a JOIN wide b ON a.label = b.label AND a.vec_id <> b.vec_id))
WHERE rank <= 3 AND similarity >= 0.2""",
)
def vector_neighbours_in_scope(spark, sf):
    data = table(spark, sf, "embeddings")
    asked = data.select(F.col("vec_id").alias("query_id"), "embedding", "label")
    found = vectors.nearest(
        asked, data, "query_id", "embedding", "vec_id", "embedding", 3, scope="label", min_similarity=0.2, exclude_same_id=True
    )
    return found.withColumn("similarity", F.round("similarity", 9))
