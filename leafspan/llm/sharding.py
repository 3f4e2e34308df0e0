"""K-d tree sharding: split at distributed weighted medians along the widest metadata dimension until leaves have the target bytes.

Points are groups of equal texts, so that copies share a shard; a group above a sixteenth of a shard's bytes is dealt into parts.
Dimensions are a group's first id, size, language and source, each as a 63-bit integer whose high half is the value's place
in the dimension and whose low half is a hash that breaks ties. A weighted median is found by narrowing histograms, so the
driver sees a bounded number of sums, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafspan.llm.common import query, table
from leafspan.session import cut_lineage

SHARDS = 24
BUCKETS = 2048
# A cut is exact enough once the bucket that holds it has this share of its node's bytes.
EXACT = 0.0005
PARTS_PER_SHARD = 16
IDENTITY = ["__hash", "__crc", "__length", "__part"]


@dataclass
class Node:
    leaves: int
    dimension: int = 0
    cut: int = 0
    left: int = -1
    right: int = -1


def _points(docs: DataFrame, shards: int, id_col: str, text_col: str, lang_col: str | None, source_col: str | None) -> tuple[DataFrame, DataFrame]:
    """Rows (without texts) and the groups of equal texts they belong to, with bytes and dimensions."""
    text = F.col(text_col).cast("string")
    label = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("__hash"),
        label(lang_col).alias("__lang"),
        label(source_col).alias("__source"),
    ).select("*", F.col("text_crc32").alias("__crc"), F.col("size").alias("__length"))
    total, ids = rows.agg(F.sum("size"), F.count("*")).first()
    bound = max(1, (total or 0) // (shards * PARTS_PER_SHARD))
    # At most shards * PARTS_PER_SHARD groups are above the bound.
    large = rows.groupBy("__hash", "__crc", "__length").agg(F.sum("size").alias("n")).where(F.col("n") > bound)
    spark = docs.sparkSession
    named = [(r["__hash"], r["__crc"], r["__length"], -(-r["n"] // bound)) for r in large.collect()]
    parts = spark.createDataFrame(named, "__hash long, __crc long, __length long, __parts long")
    rows = rows.join(F.broadcast(parts), ["__hash", "__crc", "__length"], "left").withColumn(
        "__part", F.when(F.col("__parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id", "__source"), F.col("__parts"))).cast("long")
    ).drop("__parts")
    numeric = dict(rows.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint")
    first_id = F.min(F.col("doc_id").cast("double") if numeric else F.xxhash64("doc_id").cast("double"))
    groups = rows.groupBy(*IDENTITY).agg(
        F.sum("size").alias("bytes"),
        F.coalesce(first_id, F.lit(0.0)).alias("__d0"),
        F.log2(F.max("size")).alias("__d1"),
        F.xxhash64(F.min("__lang")).cast("double").alias("__d2"),
        F.xxhash64(F.min("__source")).cast("double").alias("__d3"),
    )
    return rows, groups


def _dimensions(groups: DataFrame) -> DataFrame:
    """Each dimension as a long: 32 bits for the place between the least and the largest value, 31 bits of a hash."""
    names = [f"__d{i}" for i in range(4)]
    ends = groups.agg(*[f(n).alias(f"{n}{f.__name__}") for n in names for f in (F.min, F.max)]).first()
    tie = F.shiftrightunsigned(F.xxhash64(*IDENTITY), 33)
    columns = []
    for n in names:
        low, high = ends[f"{n}min"] or 0.0, ends[f"{n}max"] or 0.0
        width = (high - low) or 1.0
        place = F.floor((F.col(n) - low) / width * float((1 << 32) - 1)).cast("long")
        columns.append((F.shiftleft(place, 31) + tie).alias(f"c{n[3:]}"))
    return cut_lineage(groups.select(*IDENTITY, "bytes", *columns))


def _by_node(nodes: dict[int, object]) -> Column:
    """The value of each node of a small tree level."""
    return F.element_at(F.create_map(*[x for k, v in nodes.items() for x in (F.lit(k), F.lit(v))]), F.col("node"))


def _medians(points: DataFrame, wanted: dict[int, tuple[int, float, int, int]]) -> dict[int, int]:
    """Cuts by node: the coordinate up to which about the wanted bytes lie; ``wanted`` has dimension, bytes, least and largest."""
    cuts: dict[int, int] = {}
    open_ = {k: (d, w, lo, hi, 0.0) for k, (d, w, lo, hi) in wanted.items()}
    while open_:
        at = F.element_at(F.array("c0", "c1", "c2", "c3"), _by_node({k: v[0] + 1 for k, v in open_.items()}))
        low, high = _by_node({k: v[2] for k, v in open_.items()}), _by_node({k: v[3] for k, v in open_.items()})
        here = points.where(F.col("node").isin(list(open_))).withColumn("at", at).withColumn("low", low).withColumn("high", high)
        here = here.where(F.col("at").between(F.col("low"), F.col("high")))
        bucket = F.floor((F.col("at") - F.col("low")) / (F.col("high") - F.col("low") + 1.0) * BUCKETS).cast("int")
        sums = here.groupBy("node", bucket.alias("bucket")).agg(F.sum("bytes").alias("bytes"), F.min("at").alias("lo"), F.max("at").alias("hi"))
        by_node: dict[int, list] = {}
        for r in sums.collect():  # at most BUCKETS rows for each of the nodes of a level
            by_node.setdefault(r["node"], []).append(r)
        for node, rows in by_node.items():
            dimension, want, lo, _, before = open_.pop(node)
            rows.sort(key=lambda r: r["bucket"])
            previous = lo - 1
            for r in rows:
                if before + r["bytes"] >= want:
                    break
                before, previous = before + r["bytes"], r["hi"]
            if r["lo"] == r["hi"] or r["bytes"] <= EXACT * wanted[node][1]:
                cuts[node] = r["hi"] if before + r["bytes"] - want < want - before else previous
            else:
                open_[node] = (dimension, want, r["lo"], r["hi"], before)
    return cuts


def kd_tree(points: DataFrame, shards: int) -> tuple[list[Node], DataFrame]:
    """Split until every leaf is one shard; points get the number of their leaf's node."""
    nodes, level = [Node(shards)], [0]
    points = points.withColumn("node", F.lit(0))
    while level:
        split = [k for k in level if nodes[k].leaves > 1]
        if not split:
            break
        ends = points.where(F.col("node").isin(split)).groupBy("node").agg(
            F.sum("bytes").alias("bytes"), *[f(f"c{i}").alias(f"{f.__name__}{i}") for i in range(4) for f in (F.min, F.max)]
        )
        wanted = {}
        for r in ends.collect():
            node = nodes[r["node"]]
            widths = [r[f"max{i}"] - r[f"min{i}"] for i in range(4)]
            node.dimension = max(range(4), key=lambda i: widths[i])
            share = (node.leaves // 2) / node.leaves
            wanted[r["node"]] = (node.dimension, r["bytes"] * share, r[f"min{node.dimension}"], r[f"max{node.dimension}"])
        cuts = _medians(points, wanted)
        level = []
        for k in split:
            node = nodes[k]
            node.cut = cuts.get(k, 0)
            node.left, node.right = len(nodes), len(nodes) + 1
            nodes += [Node(node.leaves // 2), Node(node.leaves - node.leaves // 2)]
            level += [node.left, node.right]
        if wanted:
            at = F.element_at(F.array("c0", "c1", "c2", "c3"), _by_node({k: nodes[k].dimension + 1 for k in split}))
            goes_left = at <= _by_node({k: nodes[k].cut for k in split})
            child = F.when(goes_left, _by_node({k: nodes[k].left for k in split})).otherwise(_by_node({k: nodes[k].right for k in split}))
            points = cut_lineage(points.withColumn("node", F.when(F.col("node").isin(split), child).otherwise(F.col("node"))))
    return nodes, points


def _leaf_numbers(nodes: list[Node]) -> dict[int, int]:
    order, stack = [], [0]
    while stack:
        k = stack.pop()
        if nodes[k].left < 0:
            order.append(k)
        else:
            stack += [nodes[k].right, nodes[k].left]
    return {k: i for i, k in enumerate(order)}


def shard(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", source_col: str | None = "source"
) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, shard, slot``; shards have nearly equal bytes.

    ``size`` is the bytes of the UTF-8 text and 8 more; a null text has none and the checksum 0. Equal texts share a shard unless
    their group is larger than a sixteenth of a shard, then it is dealt by id. Null ids, languages and sources are values like
    others; repeated rows take a slot each; an empty table gives no rows; other columns are not looked at. Slots of a shard are
    gapless from 0, in the order of the partitions.
    """
    rows, groups = _points(docs, shards, id_col, text_col, lang_col, source_col)
    nodes, points = kd_tree(_dimensions(groups), shards)
    numbers = _leaf_numbers(nodes)
    leaf = F.element_at(F.create_map(*[x for k, v in numbers.items() for x in (F.lit(k), F.lit(v))]), F.col("node"))
    placed = rows.join(points.select(*IDENTITY, leaf.alias("shard")), IDENTITY).select("doc_id", "size", "text_crc32", "shard")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for batch in batches:
            own = batch.column("shard").to_numpy()
            order = np.argsort(own, kind="stable")
            counts = np.bincount(own, minlength=shards)
            ranks = np.empty(len(own), np.int64)
            ranks[order] = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(seen, counts)
            seen += counts
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ranks), pa.array(np.full(len(own), part, np.int32))], names=[*batch.schema.names, "__rank", "__task"]
            )

    kind = dict(placed.dtypes)["doc_id"]
    ranked = cut_lineage(placed.mapInArrow(rank, f"doc_id {kind}, size long, text_crc32 long, shard int, __rank long, __task int"))
    before = Window.partitionBy("shard").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranked.groupBy("shard", "__task").agg(F.count("*").alias("n"))
    counts = counts.select("shard", "__task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    slots = ranked.join(counts, ["shard", "__task"])
    return slots.select("doc_id", "size", "text_crc32", "shard", (F.col("__rank") + F.col("__before")).alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, folder: str, id_col: str = "doc_id", files: int = 8) -> None:
    """Write the documents (with unique ids) as one folder of ``files`` files per shard, each in slot order."""
    rows = docs.join(placed.select(F.col("doc_id").alias(id_col), "shard", "slot"), id_col)
    rows.withColumn("__file", F.pmod("slot", F.lit(files))).repartition("shard", "__file").drop("__file").sortWithinPartitions(
        "shard", "slot"
    ).write.partitionBy("shard").parquet(folder)


@query("op8_sharding")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return shard(table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
