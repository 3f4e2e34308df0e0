"""Recursive cluster summaries and bottom-up tree summaries."""

from __future__ import annotations

import math

from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafspan.functions import text as T
from leafspan.functions.chunks import chunks
from leafspan.models.base import Embedder, Generator
from leafspan.operators.mixtures import grouped_clusters
from leafspan.operators.scan import Running, dense_number, position_segment, prefix_scan
from leafspan.session import cut_lineage, cut_stage

# Limits of the clustering and of the recursion.
REDUCED_DIMENSIONS = 5
MEMBERSHIP = 0.1
SMALL_LAYER = 5
MAX_LEVELS = 20
MAX_CLUSTERS = 50
SUMMARY_WORDS = 1200


def soft_clusters(items: DataFrame, item: str, vector: str, cluster_counts: list[int] | None = None, seed: int = 0) -> DataFrame:
    """``(item, cluster)`` memberships with probability above 0.1 under the mixture with the smallest BIC.

    The distributed mixture model runs on a seeded linear reduction to five dimensions; both keep only small
    per-cluster statistics on the driver.
    """
    total = items.count()
    width = items.select(F.size(vector)).first()[0]
    if total <= REDUCED_DIMENSIONS + 1:
        return items.select(item, F.lit(0).alias("cluster"))
    features = items.select(item, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    dims = min(REDUCED_DIMENSIONS, width, total - 1)
    reduced = PCA(k=dims, inputCol="features", outputCol="reduced").fit(features).transform(features).select(item, "reduced").persist()
    most = max(2, min(MAX_CLUSTERS, total // 10))
    counts = cluster_counts or list(range(1, most))
    best, best_bic = None, None
    for count in counts:
        if count == 1:
            continue
        model = GaussianMixture(featuresCol="reduced", k=count, seed=seed, maxIter=30).fit(reduced)
        free = count * (dims + dims * (dims + 1) / 2) + count - 1
        bic = -2 * model.summary.logLikelihood + free * math.log(total)
        if best_bic is None or bic < best_bic:
            best, best_bic = model, bic
    if best is None:
        return items.select(item, F.lit(0).alias("cluster"))
    shares = best.transform(reduced).select(item, F.posexplode(vector_to_array("probability")).alias("cluster", "share"))
    return shares.filter(F.col("share") > MEMBERSHIP).select(item, "cluster")


def summarise_clusters(members: DataFrame, texts: DataFrame, item: str, generator: Generator, per_part: int = 64) -> DataFrame:
    """One summary per cluster.

    Texts of a cluster are joined in parts of bounded length, each part is summarised, and the part summaries are
    reduced the same way until one is left.
    """
    state = cut_lineage(members.join(texts, item).select("cluster", F.col(item).cast("string").alias("nth"), "text"))
    while True:
        largest = state.groupBy("cluster").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        parts = max(1, -(-largest // per_part))
        part = F.pmod(F.xxhash64("nth"), F.lit(parts)).alias("part")
        ordered = F.array_sort(F.collect_list(F.struct("nth", "text")))
        grouped = state.groupBy("cluster", part).agg(F.array_join(F.transform(ordered, lambda s: s["text"]), "\n").alias("joined"))
        summary = T.truncate_words(generator.complete(F.concat(F.lit("Summarise.\nEvidence:\n"), F.col("joined"))), SUMMARY_WORDS)
        state = cut_lineage(grouped.select("cluster", F.col("part").cast("string").alias("nth"), summary.alias("text")))
        if parts == 1:
            return state.select("cluster", "text")


def summary_levels(
    chunks: DataFrame, embedder: Embedder, generator: Generator, cluster_counts: list[int] | None = None, levels: int = MAX_LEVELS
) -> DataFrame:
    """``(chunk_id, depth, source, text)``: chunks and the summaries above them, until a layer holds at most five texts."""
    layer = cut_lineage(chunks.select(F.col("chunk_id").cast("bigint").alias("chunk_id"), "text"))
    everything = layer.select("chunk_id", F.lit(0).alias("depth"), F.lit("document").alias("source"), "text")
    for depth in range(1, levels + 1):
        size = layer.count()
        if size <= SMALL_LAYER:
            break
        offset = everything.agg(F.max("chunk_id")).first()[0] + 1
        embedded = cut_lineage(layer.withColumn("embedding", embedder.embed(F.col("text"))))
        counts = [c for c in cluster_counts if c < size] if cluster_counts else None
        members = soft_clusters(embedded.select("chunk_id", "embedding"), "chunk_id", "embedding", counts or ([1] if cluster_counts else None))
        summaries = summarise_clusters(members, layer, "chunk_id", generator)
        layer = cut_lineage(summaries.select((F.col("cluster") + F.lit(offset)).cast("bigint").alias("chunk_id"), "text"))
        everything = everything.unionByName(
            layer.select("chunk_id", F.lit(depth).alias("depth"), F.lit(f"depth_{depth}").alias("source"), "text")
        )
    return everything


def reduce_in_order(texts: DataFrame, keys: list[str], generator: Generator, per_part: int = 64, rows: int | None = None) -> DataFrame:
    """One summary ``(*keys, text)`` per group of ``(*keys, nth, text)``.

    Runs of ``per_part`` texts are summarised in the order of ``nth``, then the summaries in the same order, until one is left.
    """
    state = texts.select(*keys, "nth", "text")
    while True:
        numbered = dense_number(state, keys, "nth", "place", rows)
        ordered = F.array_sort(F.collect_list(F.struct("place", "text")))
        grouped = numbered.groupBy(*keys, F.floor((F.col("place") - 1) / per_part).alias("nth")).agg(
            F.array_join(F.transform(ordered, lambda s: s["text"]), "\n").alias("joined")
        )
        summary = T.truncate_words(generator.complete(F.concat(F.lit("Summarise.\nEvidence:\n"), F.col("joined"))), SUMMARY_WORDS)
        state = cut_stage(grouped.select(*keys, "nth", summary.alias("text")))
        if (state.agg(F.max("nth")).first()[0] or 0) == 0:
            return state.drop("nth")


def document_levels(chunks: DataFrame, embedder: Embedder, generator: Generator, levels: int = MAX_LEVELS, rows: int | None = None) -> DataFrame:
    """``(doc_id, depth, nth, source, text)``: each document's chunks ``(doc_id, nth, text)`` and the summaries above them.

    Documents are clustered and summarised on their own, all in the same rounds; one whose layer holds at most five texts is
    done. Summaries are numbered in the order of the first text that they cover.
    """
    layer = cut_lineage(chunks.select("doc_id", F.col("nth").cast("long").alias("nth"), "text"))
    everything = layer.select("doc_id", F.lit(0).alias("depth"), "nth", F.lit("document").alias("source"), "text")
    for depth in range(1, levels + 1):
        open_ = layer.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") > SMALL_LAYER)
        layer = cut_lineage(layer.join(open_.select("doc_id"), "doc_id", "left_semi"))
        if layer.isEmpty():
            break
        embedded = layer.select("doc_id", "nth", embedder.embed(F.col("text")).alias("embedding"))
        members = cut_lineage(grouped_clusters(embedded, "doc_id", "nth", "embedding"))
        told = reduce_in_order(members.join(layer, ["doc_id", "nth"]), ["doc_id", "cluster"], generator, rows=rows)
        first = members.groupBy("doc_id", "cluster").agg(F.min("nth").alias("first"))
        order = Window.partitionBy("doc_id").orderBy("first", "cluster")
        placed = first.select("doc_id", "cluster", F.row_number().over(order).cast("long").alias("nth"))
        layer = cut_lineage(told.join(placed, ["doc_id", "cluster"]).select("doc_id", "nth", "text"))
        everything = everything.unionByName(
            layer.select("doc_id", F.lit(depth).alias("depth"), "nth", F.lit(f"depth_{depth}").alias("source"), "text")
        )
    return everything


def tree_summaries(nodes: DataFrame, generator: Generator, words: int = 400, per_part: int = 8, rows: int | None = None) -> DataFrame:
    """Add ``summary`` level by level from the leaves up; a title is summarised from its text and its children's summaries.

    One round per depth; nodes outside the tree (depth 0 or none) are summarised from their own text. A child without a summary
    stands in with its text. Texts are cut into chunks of ``words`` words, and ``per_part`` chunks or summaries at a time are
    reduced in order until one is left, so nothing is left out of a long text.
    """
    placed = nodes.withColumn("__depth", F.coalesce("depth", F.lit(0)))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    keys = ["doc_id", "index_id"]
    below, told = None, None
    for depth in range(deepest, -1, -1):
        own = cut_stage(placed.filter(F.col("__depth") == depth).select(*keys, "parent_id", F.coalesce("content", F.lit("")).alias("content")))
        texts = own.select(*keys, F.lit(-1).cast("long").alias("child"), F.col("content").alias("text"))
        if below is not None:
            summary = F.when(F.coalesce("summary", F.lit("")) != "", F.col("summary")).otherwise(F.col("content"))
            children = below.select("doc_id", F.col("parent_id").alias("index_id"), F.col("index_id").cast("long").alias("child"), summary.alias("text"))
            texts = texts.unionByName(children.join(own.select(*keys), keys, "left_semi"))
        cut = F.when(T.word_count(F.col("text")) > words, chunks(words)(F.col("text"))).otherwise(F.array("text"))
        pieces = texts.select(*keys, "child", F.posexplode(cut).alias("at", "text"))
        numbered = prefix_scan(pieces, keys, ["child", "at"], {"nth": Running("sum", F.lit(1))}, position_segment("child", rows))
        made = reduce_in_order(numbered, keys, generator, per_part, rows).withColumnRenamed("text", "summary")
        below = cut_stage(own.join(made, keys))
        level = below.select(*keys, "summary")
        told = level if told is None else told.unionByName(level)
    return nodes.join(told, keys, "left")
