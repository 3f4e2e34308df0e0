"""Graph operators over entity, edge and bridge tables keyed by ``doc_id``."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafspan.functions.vectors import cosine
from leafspan.operators import vectors
from leafspan.operators.skew import salted_join
from leafspan.operators.tree import ancestor_at
from leafspan.session import cut_lineage, cut_stage

# Convergence rule of the rank iteration.
TOLERANCE = 1e-6
MAX_ITERATIONS = 100
EDGES_PER_SALT = 1_000_000
# Nodes and edges of a graph that is ranked inside a task, and of the graphs that a task ranks side by side.
ROWS_PER_GRAPH = 20_000
ROWS_PER_BUNDLE = 50_000


def linked_entities(bridge: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entities any of the given tree nodes mentions."""
    return bridge.join(nodes.select("doc_id", "index_id"), ["doc_id", "index_id"], "left_semi").select("doc_id", "node_name").distinct()


def induced_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges whose two ends are both among ``entities``."""
    for side in ("src", "tgt"):
        kept = entities.select("doc_id", F.col("node_name").alias(side)).distinct()
        edges = edges.join(kept, ["doc_id", side], "left_semi")
    return edges


def node_entity_counts(bridge: DataFrame, mapped: DataFrame) -> DataFrame:
    """Tree nodes mentioning mapped entities, with the number of distinct entities."""
    return (
        bridge.join(mapped.select("doc_id", "node_name").distinct(), ["doc_id", "node_name"], "left_semi")
        .groupBy("doc_id", "index_id").agg(F.count("*").alias("n_entities"))
    )


def section_entities(bridge: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """Sections at ``depth`` and the entities mentioned below them; a node above that depth has no section."""
    placed = nodes.select("doc_id", "index_id", ancestor_at(depth).alias("section_id")).filter(F.col("section_id") > 0)
    return placed.join(bridge, ["doc_id", "index_id"]).select("doc_id", "section_id", "node_name").distinct()


def split_sections(sections: DataFrame, linked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections reached through entities and the remaining ones."""
    keys = ["doc_id", "section_id"]
    return sections.join(linked, keys, "left_semi"), sections.join(linked, keys, "left_anti")


def self_loops_removed(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("src") != F.col("tgt"))


def degree_cap(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """New edges allowed per source: the average degree rounded up, at least one."""
    n_nodes = nodes.groupBy("doc_id").agg(F.count("*").alias("n_nodes"))
    n_edges = edges.groupBy("doc_id").agg(F.count("*").alias("n_edges"))
    return n_nodes.join(n_edges, "doc_id", "left").select(
        "doc_id",
        F.greatest(F.lit(1), F.ceil(2 * F.coalesce("n_edges", F.lit(0)) / F.col("n_nodes"))).cast("int").alias("cap"),
    )


def similarity_threshold(similar_edges: DataFrame, documents: DataFrame, share: float = 0.85) -> DataFrame:
    """Percentile of the similarities of existing edges per document, 1.0 without edges.

    ``percentile`` counts equal values before it sorts, and similarities are rounded, which bounds its state.
    """
    if not 0 <= share <= 1:
        raise ValueError("share is a fraction between 0 and 1")
    limits = similar_edges.groupBy("doc_id").agg(F.percentile("similarity", share).alias("threshold"))
    return documents.select("doc_id").distinct().join(limits, "doc_id", "left").select(
        "doc_id", F.coalesce("threshold", F.lit(1.0)).alias("threshold")
    )


def edge_similarities(edges: DataFrame, embedded: DataFrame) -> DataFrame:
    """Cosine similarity of the two ends of every edge; ``embedded`` is ``(doc_id, node_name, embedding)``."""
    for side in ("src", "tgt"):
        ends = embedded.select("doc_id", F.col("node_name").alias(side), F.col("embedding").alias(f"__{side}"))
        other = "tgt" if side == "src" else "src"
        edges = salted_join(edges, ends, ["doc_id", side], [other], salts=4)
    return edges.withColumn("similarity", F.round(cosine(F.col("__src"), F.col("__tgt")), vectors.SIMILARITY_DIGITS)).drop("__src", "__tgt")


def semantic_edges(embedded: DataFrame, edges: DataFrame, share: float = 0.85) -> DataFrame:
    """New edges ``(doc_id, src, tgt, weight)`` between similar, unconnected entities of a document.

    Each entity proposes its most similar partners above the similarity threshold of the existing edges, up to the
    average degree. A partner list is long enough when it holds the cap plus the entity's own neighbours; one neighbour
    search answers lists of all lengths.
    """
    nodes = embedded.select("doc_id", "node_name", "embedding")
    limits = similarity_threshold(edge_similarities(edges, nodes), nodes, share).join(degree_cap(nodes, edges), "doc_id")
    both = edges.select("doc_id", F.col("src").alias("node_name"), F.col("tgt").alias("partner")).unionByName(
        edges.select("doc_id", F.col("tgt").alias("node_name"), F.col("src").alias("partner"))
    ).distinct()
    degrees = both.groupBy("doc_id", "node_name").agg(F.count("*").alias("degree"))
    keyed = nodes.withColumn("key", F.to_json(F.struct("doc_id", "node_name")))
    wanted = cut_stage(
        keyed.join(degrees, ["doc_id", "node_name"], "left").join(limits, "doc_id")
        .withColumn("length", (F.col("cap") + F.coalesce("degree", F.lit(0))).cast("int"))
    )
    found = vectors.nearest(
        wanted.select("doc_id", F.col("key").alias("asked"), "embedding", "length"), keyed.select("doc_id", "key", "embedding"),
        "asked", "embedding", "key", "embedding", "length", scope="doc_id", exclude_same_id=True,
    )
    named = found.join(wanted.select(F.col("key").alias("asked"), "doc_id", "node_name", "threshold", "cap"), "asked")
    named = named.join(keyed.select("key", F.col("node_name").alias("partner")), "key").filter(F.col("similarity") > F.col("threshold"))
    fresh = named.join(both, ["doc_id", "node_name", "partner"], "left_anti")
    order = Window.partitionBy("doc_id", "node_name").orderBy(F.col("similarity").desc(), F.col("partner").asc())
    kept = fresh.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= F.col("cap"))
    return kept.select(
        "doc_id", F.least("node_name", "partner").alias("src"), F.greatest("node_name", "partner").alias("tgt"),
        F.col("similarity").alias("weight"),
    ).distinct()


def pagerank(
    nodes: DataFrame, edges: DataFrame, alpha: float = 0.5, tolerance: float = TOLERANCE, max_iterations: int = MAX_ITERATIONS,
    whole: int = 0,
) -> DataFrame:
    """Personalised, weighted, undirected rank of every graph at once: ``(doc_id, node_name, rank)``.

    ``nodes`` holds every node with its non-negative start ``weight`` (normalised per document); a document whose
    weights sum to zero yields no rows. ``edges`` holds one row per pair. A document stops as soon as its change falls
    below ``tolerance`` times its node count, independently of the others. Rank of nodes without edges flows back to
    the start weights.

    Documents of at most ``whole`` nodes and edges are dealt out in bundles and iterated inside tasks; any larger one is iterated
    by joins, in the same steps. Callers with many small graphs pass ``ROWS_PER_GRAPH``.
    """
    # Both are read several times: callers hand over materialised edges, and the nodes are kept here.
    nodes = cut_lineage(nodes.select("doc_id", "node_name", "weight"))
    edges = edges.select("doc_id", "src", "tgt", "weight")
    if not whole:
        return _joined_ranks(nodes, edges, alpha, tolerance, max_iterations)
    sizes = nodes.select("doc_id").unionByName(edges.select("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n"))
    small = F.col("n") <= whole
    rows, n_small, n_large = sizes.agg(F.sum(F.when(small, F.col("n"))), F.count_if(small), F.count_if(~small)).first()
    if not n_large:
        return _small_ranks(nodes, edges, rows or 0, alpha, tolerance, max_iterations)
    if not n_small:
        return _joined_ranks(nodes, edges, alpha, tolerance, max_iterations)
    large = cut_lineage(sizes.filter(~small).select("doc_id"))
    there, rest = (lambda df: df.join(large, "doc_id", "left_semi")), (lambda df: df.join(large, "doc_id", "left_anti"))
    return _joined_ranks(there(nodes), there(edges), alpha, tolerance, max_iterations).unionByName(
        _small_ranks(rest(nodes), rest(edges), rows, alpha, tolerance, max_iterations)
    )


def _small_ranks(nodes: DataFrame, edges: DataFrame, rows: int, alpha: float, tolerance: float, max_iterations: int) -> DataFrame:
    """Ranks of documents whose graphs are small; a task takes a bundle of them, whose graphs have no edge in common."""

    def ranked(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        # As objects, because some versions of pandas hand over empty columns of strings in a form that Arrow refuses.
        told, n = left[["doc_id", "node_name"]].astype(object), len(left)
        if not n:
            return told.assign(rank=0.0)
        docs, found = pd.factorize(pd.concat([left["doc_id"], right["doc_id"], right["doc_id"]], ignore_index=True))
        names, known = pd.factorize(pd.concat([left["node_name"], right["src"], right["tgt"]], ignore_index=True))
        places, keys = pd.factorize(docs.astype(np.int64) * (len(known) + 1) + names)
        # Nodes come first; ends that are no nodes get places after them, and what flows there is lost.
        doc, weight = docs[:n], left["weight"].to_numpy(dtype=np.float64)
        u, v = np.split(places[n:], 2)
        u, v, share = np.concatenate([u, v]), np.concatenate([v, u]), np.tile(right["weight"].fillna(0).to_numpy(dtype=np.float64), 2)
        out = np.bincount(u, share, len(keys))
        flows = (u < n) & (v < n) & (out[u] > 0)
        u, v, share = u[flows], v[flows], share[flows] / out[u[flows]]
        ends, size, total = out[:n] <= 0, np.bincount(doc, minlength=len(found)), np.bincount(doc, weight, len(found))
        kept = total[doc] > 0
        start = np.divide(weight, total[doc], out=np.zeros(n), where=kept)
        rank, before = 1 / size[doc], np.full(n, np.inf)
        for _ in range(max_iterations + 1):
            done = (np.bincount(doc, np.abs(rank - before), len(found)) < size * tolerance) | (total <= 0)
            if done.all():
                return told.assign(rank=rank)[kept]
            inflow = np.bincount(v, rank[u] * share, n) + np.bincount(doc, rank * ends, len(found))[doc] * start
            rank, before = np.where(done[doc], rank, alpha * inflow + (1 - alpha) * start), rank
        raise RuntimeError(f"rank iteration did not converge within {max_iterations} iterations")

    bundle = F.pmod(F.xxhash64("doc_id"), F.lit(-(-rows // ROWS_PER_BUNDLE) or 1)).alias("bundle")
    kinds = ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in ("doc_id", "node_name"))
    left, right = (df.filter("doc_id IS NOT NULL").select("*", bundle).groupBy("bundle") for df in (nodes, edges))
    # Read for the scores and for the best entities.
    return cut_stage(left.cogroup(right).applyInPandas(ranked, f"{kinds}, rank double"))


def _joined_ranks(nodes: DataFrame, edges: DataFrame, alpha: float, tolerance: float, max_iterations: int) -> DataFrame:
    """Ranks of documents of any size.

    Each iteration is two aggregations that combine before the shuffle, and its result is checkpointed. The out-edges
    of a hub are split over salts in proportion to its degree. Edges are dealt out by their source once and kept there; an
    iteration moves ranks only. Documents that are done leave the iteration, and their ranks are put together at the end.
    """
    ends = F.array(F.struct(F.col("src").alias("u"), F.col("tgt").alias("v")), F.struct(F.col("tgt").alias("u"), F.col("src").alias("v")))
    both = edges.select("doc_id", F.explode(ends).alias("end"), "weight").select("doc_id", "end.u", "end.v", "weight")
    out = both.groupBy("doc_id", "u").agg(
        F.sum("weight").alias("out"), F.ceil(F.count("*") / EDGES_PER_SALT).cast("int").alias("salts")
    ).filter("out > 0")
    totals = nodes.groupBy("doc_id").agg(F.sum("weight").alias("total"), F.count("*").alias("n")).filter("total > 0")
    state = (
        nodes.join(totals, "doc_id")
        .join(out.select("doc_id", F.col("u").alias("node_name"), "salts"), ["doc_id", "node_name"], "left")
        .select(
            "doc_id", "node_name", (F.col("weight") / F.col("total")).alias("start"), "n", "salts",
            (1 / F.col("n")).alias("rank"), F.lit(None).cast("double").alias("before"), F.lit(False).alias("done"),
        )
    )
    shares = cut_lineage(
        both.join(out, ["doc_id", "u"])
        .select(
            "doc_id", "u", "v", (F.col("weight") / F.col("out")).alias("share"),
            F.pmod(F.xxhash64("v"), F.col("salts")).cast("int").alias("salt"),
        )
    )
    shares = placed_edges(shares).persist()
    state = cut_lineage(state)
    finished = []
    try:
        for _ in range(max_iterations + 1):
            state = cut_lineage(_rank_step(state, shares, alpha, tolerance))
            finished.append(state.filter("done").select("doc_id", "node_name", "rank"))
            state = state.filter(~F.col("done"))
            if state.isEmpty():
                return reduce(DataFrame.unionByName, finished)
    finally:
        shares.unpersist()
    raise RuntimeError(f"rank iteration did not converge within {max_iterations} iterations")


def placed_edges(shares: DataFrame) -> DataFrame:
    """Edges in a fixed number of partitions by document, source and salt, which the joins of all iterations ask for."""
    partitions = int(shares.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shares.repartition(partitions, "doc_id", "u", "salt")


def _rank_step(state: DataFrame, shares: DataFrame, alpha: float, tolerance: float) -> DataFrame:
    """One iteration over documents that are not done; one whose last change was small enough keeps its ranks and is done."""
    spread = state.filter(F.col("salts").isNotNull()).select(
        "doc_id", F.col("node_name").alias("u"), "rank", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    )
    received = (
        shares.join(spread, ["doc_id", "u", "salt"])
        .groupBy("doc_id", F.col("v").alias("node_name")).agg(F.sum(F.col("rank") * F.col("share")).alias("received"))
    )
    per_document = state.groupBy("doc_id").agg(
        F.sum(F.when(F.col("salts").isNull(), F.col("rank")).otherwise(0.0)).alias("dangling"),
        F.coalesce(F.sum(F.abs(F.col("rank") - F.col("before"))) < F.max("n") * tolerance, F.lit(False)).alias("settled"),
    )
    inflow = F.coalesce("received", F.lit(0.0)) + F.col("dangling") * F.col("start")
    return state.join(per_document, "doc_id").join(received, ["doc_id", "node_name"], "left").select(
        "doc_id", "node_name", "start", "n", "salts",
        F.when(F.col("settled"), F.col("rank")).otherwise(alpha * inflow + (1 - alpha) * F.col("start")).alias("rank"),
        F.col("rank").alias("before"), F.col("settled").alias("done"),
    )


def node_scores(ranks: DataFrame, bridge: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Sum of the ranks of the entities a tree node mentions.

    With ``targets`` every target appears, with 0.0 when it mentions no ranked entity, and no other node does.
    """
    scored = salted_join(bridge, ranks, ["doc_id", "node_name"], ["index_id"], salts=4)
    sums = scored.groupBy("doc_id", "index_id").agg(F.round(F.sum("rank"), 12).alias("score"))
    if targets is None:
        return sums
    return targets.select("doc_id", "index_id").distinct().join(sums, ["doc_id", "index_id"], "left").withColumn(
        "score", F.coalesce("score", F.lit(0.0))
    )


def start_weights(entities: DataFrame, mapped: DataFrame) -> DataFrame:
    """Start weight per entity: the summed ``(cosine + 1) / 2`` of the question entities mapped to it."""
    sums = mapped.groupBy("doc_id", "node_name").agg(F.sum((F.col("similarity") + 1) / 2).alias("weight"))
    return entities.select("doc_id", "node_name").join(sums, ["doc_id", "node_name"], "left").withColumn(
        "weight", F.coalesce("weight", F.lit(0.0))
    )
