"""Entity merging to rows: the decisions of a resolver applied to mentions, bridge and edges.

A decision names two entities that are one and the name that they get. That name may belong to a third entity, or be the
result of another decision; then these are one as well. All names that decisions connect are therefore one entity, which the
latest of its decisions names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspan.functions import text as T
from leafspan.operators import entities
from leafspan.operators.scan import ROWS_PER_SEGMENT
from leafspan.operators.skew import salted_join
from leafspan.session import cut_lineage

SALTS = 16


def final_names(decisions: DataFrame) -> DataFrame:
    """``(doc_id, old_key, new_key, entity_name, entity_type)`` for every key that a decision touches.

    ``decisions`` is ``(doc_id, seq, old_name, old_type, new_name, new_type, merged_name, merged_type)``; of a component's
    decisions the one with the highest ``seq`` names it, of several the one with the greatest name.
    """
    key = lambda side: T.entity_key(F.col(f"{side}_name"), F.col(f"{side}_type"))
    keyed = cut_lineage(decisions.select(
        "doc_id", "seq", key("old").alias("old"), key("new").alias("new"), key("merged").alias("merged"), "merged_name", "merged_type"
    ))
    links = keyed.select("doc_id", F.col("old").alias("left"), F.explode(F.array("new", "merged")).alias("right"))
    roots = entities.clusters(links).select("doc_id", F.col("name").alias("old"), "root")
    # A key that decisions link with nothing but itself is a component of its own.
    alone = links.filter(F.col("left") == F.col("right")).select("doc_id", F.col("left").alias("old")).distinct()
    alone = alone.join(roots, ["doc_id", "old"], "left_anti")
    roots = cut_lineage(roots.unionByName(alone.withColumn("root", F.col("old"))))
    named = keyed.join(roots, ["doc_id", "old"])
    last = F.max(F.struct("seq", "merged_name", "merged_type")).alias("last")
    told = named.groupBy("doc_id", "root").agg(last).select("doc_id", "root", F.col("last.merged_name").alias("entity_name"), F.col("last.merged_type").alias("entity_type"))
    return roots.join(told, ["doc_id", "root"]).select(
        "doc_id", F.col("old").alias("old_key"), T.entity_key(F.col("entity_name"), F.col("entity_type")).alias("new_key"), "entity_name", "entity_type"
    )


@dataclass
class Merged:
    """``mentions`` under their final names, ``entities`` and their ``descriptions`` by part, the ``bridge`` and the ``edges``."""

    mentions: DataFrame
    entities: DataFrame
    descriptions: DataFrame
    bridge: DataFrame
    edges: DataFrame


def merge(mentions: DataFrame, edges: DataFrame, decisions: DataFrame, rows: int | None = ROWS_PER_SEGMENT) -> Merged:
    """Apply ``decisions``: names, counts, joined descriptions and united sources of entities, and rewired edges.

    ``edges`` are ``(doc_id, seq, src, tgt, ...)`` between entity keys. Ends move to their final keys, loops go, and of the
    edges of a pair the latest stays. Descriptions are joined in mention order.
    """
    names = cut_lineage(final_names(decisions))
    own = T.entity_key(F.col("entity_name"), F.col("entity_type"))
    renamed = names.select("doc_id", F.col("old_key").alias("__key"), F.col("entity_name").alias("__name"), F.col("entity_type").alias("__type"))
    moved = salted_join(mentions.withColumn("__key", own), renamed, ["doc_id", "__key"], ["node_id", "seq"], "left", SALTS)
    moved = moved.withColumns({"entity_name": F.coalesce("__name", "entity_name"), "entity_type": F.coalesce("__type", "entity_type")})
    moved = cut_lineage(moved.drop("__key", "__name", "__type"))
    rewired = entities.relabel_edges(edges, names.select("doc_id", F.col("old_key").alias("old_name"), F.col("new_key").alias("latest_name")))
    return Merged(moved, entities.merge_entities(moved), entities.entity_descriptions(moved, rows), entities.entity_sources(moved), rewired)
