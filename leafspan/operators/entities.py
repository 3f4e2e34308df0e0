"""Entities and relations: cleaning, merging, endpoint repair, alias resolution and clustering.

Mentions are rows ``doc_id, node_id, seq, entity_name, entity_type, description``; relations carry
``src_entity_name, tgt_entity_name, relation_name, weight, description`` and the same position columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspan.functions import text as T
from leafspan.operators.scan import ROWS_PER_SEGMENT, Running, position_segment, prefix_scan
from leafspan.operators.skew import salted_join
from leafspan.session import cut_lineage, cut_round

# Separators of merged descriptions.
NODE_SEPARATOR = " "
GRAPH_SEPARATOR = "<SEP>"
DESCRIPTIONS_PER_PART = 1_000
MIN_ENDPOINT_SIMILARITY = 0.9


def clean_mentions(mentions: DataFrame) -> DataFrame:
    return mentions.withColumn("entity_name", T.clean_entity_name(F.col("entity_name"))).withColumn(
        "entity_type", T.clean_entity_type(F.col("entity_type"))
    )


def merge_in_node(mentions: DataFrame) -> DataFrame:
    """One row per entity and tree node, descriptions joined by a blank in mention order.

    The list gathered per row is bounded by what one node mentions.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "description")))
    return mentions.groupBy("doc_id", "node_id", "entity_name", "entity_type").agg(
        F.min("seq").alias("seq"), F.array_join(F.transform(ordered, lambda s: s["description"]), NODE_SEPARATOR).alias("description")
    )


def merge_entities(mentions: DataFrame) -> DataFrame:
    """One row per ``(doc_id, entity_name, entity_type)``: counts, first and last node, longest description.

    All measures combine before the shuffle, so an entity mentioned everywhere costs no more than any other. The
    unbounded parts of an entity live in :func:`entity_sources` and :func:`entity_descriptions`.
    """
    longest = F.max(F.struct(F.length("description"), -F.col("node_id"), -F.col("seq"), "description"))
    return mentions.groupBy("doc_id", "entity_name", "entity_type").agg(
        F.count("*").alias("n_mentions"), F.min("node_id").alias("first_node"), F.max("node_id").alias("last_node"),
        longest["description"].alias("longest_description"),
    ).withColumn("node_name", T.entity_key(F.col("entity_name"), F.col("entity_type")))


def entity_sources(mentions: DataFrame) -> DataFrame:
    """The bridge between entities and tree nodes, one row per pair."""
    key = T.entity_key(F.col("entity_name"), F.col("entity_type"))
    return mentions.select("doc_id", key.alias("node_name"), F.col("node_id").alias("index_id")).distinct()


def entity_descriptions(
    mentions: DataFrame, rows: int | None = ROWS_PER_SEGMENT, per_part: int = DESCRIPTIONS_PER_PART
) -> DataFrame:
    """Merged descriptions ``(doc_id, entity_name, entity_type, part, description)``.

    Descriptions are joined in mention order. An entity gets one part per ``per_part`` descriptions, so an ordinary
    entity has exactly one row and a very frequent one is never gathered into a single value.
    """
    keys = ["doc_id", "entity_name", "entity_type"]
    numbered = prefix_scan(
        mentions, keys, ["node_id", "seq"], {"nth": Running("sum", F.lit(1))}, position_segment("node_id", rows)
    )
    ordered = F.array_sort(F.collect_list(F.struct("nth", "description")))
    part = F.floor((F.col("nth") - 1) / per_part).cast("int").alias("part")
    return numbered.groupBy(*keys, part).agg(
        F.array_join(F.transform(ordered, lambda s: s["description"]), GRAPH_SEPARATOR).alias("description")
    )


def deduplicate_relations(relations: DataFrame) -> DataFrame:
    """First relation per node, endpoints and name."""
    keys = ["doc_id", "node_id", "src_entity_name", "tgt_entity_name", "relation_name"]
    rest = [c for c in relations.columns if c not in keys and c != "seq"]
    first = F.min_by(F.struct(*rest), F.col("seq")).alias("first")
    return relations.groupBy(*keys).agg(F.min("seq").alias("seq"), first).select(*keys, "seq", *[F.col("first")[c].alias(c) for c in rest])


def _close_pairs(missing: DataFrame, known: DataFrame) -> DataFrame:
    """``(doc_id, node_id, name, candidate, distance)`` of all pairs within ``length / 9`` edits, among others."""
    keys = ["doc_id", "node_id"]
    size = F.length("candidate")
    pieces = F.floor(size / 8).cast("int") + 1
    cut = lambda i: F.floor(F.col("size") * i / F.col("pieces")).cast("int")
    indexed = (
        known.withColumn("size", size).withColumn("pieces", pieces)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .withColumn("piece", F.substring(F.col("candidate"), cut(F.col("i")) + 1, cut(F.col("i") + 1) - cut(F.col("i"))))
    )
    reach = F.floor(F.length("name") / 9).cast("int")
    probes = (
        missing.withColumn("reach", reach).filter("reach > 0")
        .withColumn("size", F.explode(F.sequence(F.length("name") - F.col("reach"), F.length("name") + F.col("reach"))))
        .withColumn("pieces", F.floor(F.col("size") / 8).cast("int") + 1)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .withColumn("shift", F.explode(F.sequence(-F.col("reach"), F.col("reach"))))
        .withColumn("at", cut(F.col("i")) + 1 + F.col("shift"))
        .filter((F.col("at") >= 1) & (F.col("at") <= F.length("name")))
        .withColumn("piece", F.substring(F.col("name"), F.col("at"), cut(F.col("i") + 1) - cut(F.col("i"))))
    )
    return (
        probes.join(indexed.drop("pieces"), [*keys, "size", "i", "piece"])
        .select(*keys, "name", "candidate").distinct()
        .withColumn("distance", F.levenshtein("name", "candidate"))
    )


def unknown_endpoints(endpoints: DataFrame, entities: DataFrame) -> DataFrame:
    """Endpoints ``(doc_id, node_id, name)`` for which no entity of the node at the smallest edit distance is similar enough.

    Of several entities at that distance the longest is the most similar, so it decides.
    """
    keys = ["doc_id", "node_id"]
    known = entities.select(*keys, F.col("entity_name").alias("candidate")).distinct()
    missing = endpoints.select(*keys, "name").distinct().join(known.withColumnRenamed("candidate", "name"), [*keys, "name"], "left_anti")
    nearest = F.min(F.struct("distance", (-F.length("candidate")).alias("shorter"))).alias("best")
    close = _close_pairs(missing, known).groupBy(*keys, "name").agg(nearest).filter(
        1 - F.col("best.distance") / F.greatest(F.length("name"), -F.col("best.shorter")) >= MIN_ENDPOINT_SIMILARITY
    )
    return missing.join(close, [*keys, "name"], "left_anti")


def repair_endpoints(endpoints: DataFrame, entities: DataFrame) -> DataFrame:
    """Map relation endpoints ``(doc_id, node_id, name)`` to entities of the same node.

    Adds ``repaired_name`` and ``is_new``. An exact match wins; otherwise the entity at the smallest edit distance is
    taken if the similarity ``1 - distance / longer length`` reaches 0.9; otherwise the name becomes a new UNKNOWN
    entity. A similarity of 0.9 allows at most ``length / 9`` edits, so one of a few pieces of the entity name must
    occur in the endpoint almost in place; the pieces are joined by equality and no pair table is built.
    """
    keys = ["doc_id", "node_id"]
    asked = endpoints.select(*keys, "name").distinct()
    known = entities.select(*keys, F.col("entity_name").alias("candidate")).distinct()
    exact = asked.join(known.withColumnRenamed("candidate", "name"), [*keys, "name"], "left_semi")
    missing = asked.join(known.withColumnRenamed("candidate", "name"), [*keys, "name"], "left_anti")

    close = (
        _close_pairs(missing, known).groupBy(*keys, "name").agg(F.min(F.struct("distance", "candidate")).alias("best"))
        .filter(
            1 - F.col("best.distance") / F.greatest(F.length("name"), F.length("best.candidate")) >= MIN_ENDPOINT_SIMILARITY
        )
        .select(*keys, "name", F.col("best.candidate").alias("repaired_name"))
    )
    settled = missing.join(close, [*keys, "name"], "left").select(
        *keys, "name", F.coalesce("repaired_name", "name").alias("repaired_name"),
        F.col("repaired_name").isNull().alias("is_new"),
    )
    return exact.select(*keys, "name", F.col("name").alias("repaired_name"), F.lit(False).alias("is_new")).unionByName(settled)


def resolve_aliases(aliases: DataFrame) -> DataFrame:
    """``(doc_id, old_name, latest_name)`` from ``(doc_id, old_name, new_name)`` by pointer doubling.

    A name that maps to itself or has no entry is final. Where a walk never ends, because it comes to a cycle, all names
    connected with that cycle get the smallest of them.
    """
    state = cut_lineage(aliases.select("doc_id", "old_name", F.col("new_name").alias("at"), F.lit(False).alias("done")))
    rounds, limit = 0, max(1, state.count()).bit_length() + 1
    while rounds < limit:
        jump = state.select("doc_id", F.col("old_name").alias("at"), F.col("at").alias("next"))
        moved = salted_join(state.filter(~F.col("done")), jump, ["doc_id", "at"], ["old_name"], "left", salts=4)
        moved = moved.select(
            "doc_id", "old_name", F.coalesce("next", "at").alias("at"),
            (F.col("next").isNull() | (F.col("next") == F.col("at"))).alias("done"),
        )
        state = cut_round(state.filter("done").unionByName(moved))
        rounds += 1
        if state.filter(~F.col("done")).isEmpty():
            break
    # A walk that stopped at a name with another successor went round a cycle.
    onward = aliases.filter("old_name <> new_name").select("doc_id", F.col("old_name").alias("at"), F.lit(True).alias("endless")).distinct()
    state = cut_lineage(salted_join(state, onward, ["doc_id", "at"], ["old_name"], "left", salts=4))
    endless = state.filter("endless").select("doc_id", "old_name")
    if endless.isEmpty():
        return state.select("doc_id", "old_name", F.col("at").alias("latest_name"))
    steps = aliases.join(endless, ["doc_id", "old_name"], "left_semi")
    roots = clusters(steps.select("doc_id", F.col("old_name").alias("left"), F.col("new_name").alias("right")))
    roots = roots.select("doc_id", F.col("name").alias("old_name"), "root")
    return state.join(roots, ["doc_id", "old_name"], "left").select("doc_id", "old_name", F.coalesce("root", "at").alias("latest_name"))


def relabel_edges(edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """Move edge endpoints to their latest names, drop self-loops and keep the last edge per pair."""
    for side in ("src", "tgt"):
        names = resolved.select("doc_id", F.col("old_name").alias(side), F.col("latest_name").alias("__latest"))
        edges = salted_join(edges, names, ["doc_id", side], ["seq"], "left", salts=4)
        edges = edges.withColumn(side, F.coalesce("__latest", side)).drop("__latest")
    return last_edges(edges)


def last_edges(edges: DataFrame) -> DataFrame:
    """Undirected simple graph: one row per unordered pair, the latest by ``seq`` wins, self-loops dropped."""
    rest = [c for c in edges.columns if c not in ("doc_id", "src", "tgt", "seq")]
    pair = [F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")]
    last = F.max_by(F.struct(*rest), F.col("seq")).alias("last")
    return (
        edges.filter(F.col("src") != F.col("tgt")).groupBy("doc_id", *pair).agg(last)
        .select("doc_id", F.col("a").alias("src"), F.col("b").alias("tgt"), *[F.col("last")[c].alias(c) for c in rest])
    )


def clusters(pairs: DataFrame) -> DataFrame:
    """Connected components ``(doc_id, name, root)`` of accepted merge pairs ``(doc_id, left, right)``.

    Alternating star contractions: each round links a name's neighbours to the smallest of them. Every round is
    built from minimum aggregations that combine before the shuffle, so hub names stay cheap.
    """
    def smallest(directed: DataFrame) -> DataFrame:
        return directed.groupBy("doc_id", "u").agg(F.min("v").alias("m"))

    def join_min(directed: DataFrame) -> DataFrame:
        low = smallest(directed).withColumn("m", F.least("m", "u"))
        return salted_join(directed, low, ["doc_id", "u"], ["v"], salts=4)

    edges = cut_round(
        pairs.filter(F.col("left") != F.col("right"))
        .select("doc_id", F.greatest("left", "right").alias("u"), F.least("left", "right").alias("v")).distinct()
    )
    while True:
        both = edges.unionByName(edges.select("doc_id", F.col("v").alias("u"), F.col("u").alias("v")))
        large = join_min(both).filter(F.col("v") > F.col("u")).select("doc_id", F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        small = join_min(large)
        small = (
            small.select("doc_id", F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("doc_id", "u", F.col("m").alias("v")))
            .filter(F.col("u") != F.col("v")).distinct()
        )
        following = cut_round(small)
        changed = not following.exceptAll(edges).isEmpty() or not edges.exceptAll(following).isEmpty()
        edges = following
        if not changed:
            break
    tops = edges.select("doc_id", F.col("v").alias("name")).distinct()
    return edges.select("doc_id", F.col("u").alias("name"), F.col("v").alias("root")).unionByName(
        tops.select("doc_id", "name", F.col("name").alias("root"))
    )
