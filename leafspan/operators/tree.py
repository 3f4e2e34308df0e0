"""Document trees as node tables: ``doc_id, index_id, parent_id, type, depth, outline_node`` plus metadata.

The root of a document is index 0. ``path`` lists the ids from the first level down to the node itself, root
excluded, and turns ancestor, subtree and section operators into scans without self-joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafspan.operators.scan import ROWS_PER_SEGMENT, Running, dense_number, position_segment, prefix_scan
from leafspan.operators.skew import salted_join
from leafspan.session import cut_lineage

# Node types.
NODE_TYPES = ["root", "text", "image", "table", "equation", "title", "unknown"]


def node_columns(is_title: Column) -> dict[str, Column]:
    """Node metadata from a content block, by block type."""
    kind = F.col("type")
    visual = kind.isin("image", "table")
    joined = lambda c: F.coalesce(F.array_join(F.col(c), " "), F.lit(""))
    level = F.col("text_level").cast("string").try_cast("int")
    title = is_title & (kind == "text") & level.isNotNull()
    return {
        "node_type": F.when(title, "title").when(kind.isin("image", "table", "equation"), kind).otherwise("text"),
        "outline_node": title,
        "title_level": F.when(title, level),
        "content": F.when(visual, F.concat(joined("caption"), joined("footnote"))).otherwise(
            F.coalesce(F.col("text"), F.lit(""))
        ),
        "caption_text": F.when(visual, joined("caption")),
        "footnote_text": F.when(visual, joined("footnote")),
        "img_path": F.when(visual, F.coalesce(F.col("img_path"), F.lit(""))),
        "table_body": F.when(kind == "table", F.coalesce(F.col("table_body"), F.lit(""))),
        "page_idx": F.coalesce(F.col("page_idx"), F.lit(-1)),
    }


def build(assigned: DataFrame, outline: DataFrame, rows: int | None = ROWS_PER_SEGMENT) -> DataFrame:
    """Node table without roots from blocks that carry ``title_id`` and ``in_outline``.

    Blocks before the first title are left out. A level-0 title hangs on the root; any other title on its parent,
    and one whose parent does not come before it is an orphan of depth 0.
    """
    inside = assigned.filter(F.col("title_id").isNotNull())
    columns = node_columns(F.col("in_outline"))
    plain = [c for c in ("doc_id", "pdf_id", "title_id", "in_outline") if c not in columns]
    nodes = inside.select(*plain, *[c.alias(n) for n, c in columns.items()])
    nodes = dense_number(nodes, ["doc_id"], "pdf_id", "index_id", rows)

    heads = (
        nodes.filter("in_outline").select("doc_id", "pdf_id", "index_id")
        .join(outline.select("doc_id", "pdf_id", "text_level", "parent_id"), ["doc_id", "pdf_id"])
    )
    above = heads.select("doc_id", F.col("pdf_id").alias("parent_id"), F.col("index_id").alias("__above"))
    linked = heads.join(above, ["doc_id", "parent_id"], "left")
    parent = (
        F.when((F.col("text_level") == 0) | F.col("parent_id").isNull(), 0)
        .when(F.col("__above") < F.col("index_id"), F.col("__above"))
    )
    linked = linked.select("doc_id", "index_id", parent.alias("parent_id"))
    linked = root_paths(linked, ["doc_id"], "index_id", "parent_id")

    # A body block sits directly below its title: carry the path of the nearest title along the block order.
    own = nodes.join(linked, ["doc_id", "index_id"], "left")
    carried = prefix_scan(
        own, ["doc_id"], ["index_id"],
        {"__title": Running("last", F.when(F.col("in_outline"), F.struct("index_id", "path", "orphan")))},
        position_segment("index_id", rows),
    )
    title, is_title = F.col("__title"), F.col("in_outline")
    path = F.when(is_title, title["path"]).otherwise(F.array_append(title["path"], F.col("index_id")))
    return carried.select(
        "doc_id", "index_id",
        F.when(is_title, F.col("parent_id")).otherwise(title["index_id"]).alias("parent_id"),
        F.col("node_type").alias("type"),
        F.when(title["orphan"], F.size(path) - 1).otherwise(F.size(path)).alias("depth"),
        "outline_node", "title_level", "pdf_id", "page_idx", "content", "caption_text", "footnote_text", "img_path",
        "table_body", path.alias("path"), title["orphan"].alias("orphan"),
    )


def roots(nodes: DataFrame) -> DataFrame:
    """One root row per document, shaped like ``nodes``."""
    fixed = {
        "index_id": F.lit(0), "type": F.lit("root"), "depth": F.lit(0), "outline_node": F.lit(False),
        "pdf_id": F.lit(0), "page_idx": F.lit(-1), "content": F.lit(""), "path": F.array().cast("array<int>"),
        "orphan": F.lit(False),
    }
    docs = nodes.select("doc_id").distinct()
    return docs.select(
        *[
            F.col("doc_id") if f.name == "doc_id" else fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in nodes.schema
        ]
    )


def root_paths(nodes: DataFrame, keys: Sequence[str], node: str, parent: str) -> DataFrame:
    """Add ``path`` (first level down to the node, root excluded) and ``orphan`` to any parent table.

    Pointer doubling: each round joins a node with the node its pointer reaches and doubles the distance, so a tree
    of depth d needs log2(d) joins. Parent 0 is the root; a NULL or unknown parent makes an orphan whose path starts
    at itself. On a parent cycle the walk stops at the first repeated node.
    """
    keys = list(keys)
    nothing = F.array().cast(f"array<{nodes.schema[node].dataType.simpleString()}>")
    state = nodes.select(
        *keys, F.col(node).alias("__node"),
        F.when(F.col(parent) > 0, F.col(parent)).alias("__up"),
        F.array(F.col(node)).alias("__path"), F.col(parent).isNull().alias("__orphan"),
    )
    state = cut_lineage(state)
    while not state.filter(F.col("__up").isNotNull()).isEmpty():
        target = state.select(
            *keys, F.col("__node").alias("__up"), F.col("__up").alias("__next"), F.col("__path").alias("__front"),
            F.col("__orphan").alias("__lost"),
        )
        pending = state.filter(F.col("__up").isNotNull())
        walked = F.concat(F.coalesce(F.col("__front"), nothing), F.col("__path"))
        moved = salted_join(pending, target, [*keys, "__up"], ["__node"], "left", salts=4).select(
            *keys, "__node", F.col("__next"), walked.alias("__walk"),
            (F.col("__orphan") | F.coalesce(F.col("__lost"), F.lit(True))).alias("__orphan"),
        )
        once = F.reverse(F.array_distinct(F.reverse(F.col("__walk"))))
        moved = moved.withColumn("__once", once).withColumn("__loop", F.size("__once") < F.size("__walk"))
        moved = moved.select(
            *keys, "__node", F.when(~F.col("__loop"), F.col("__next")).alias("__up"), F.col("__once").alias("__path"),
            (F.col("__orphan") | F.col("__loop")).alias("__orphan"),
        )
        state = cut_lineage(state.filter(F.col("__up").isNull()).unionByName(moved))
    done = state.select(*keys, F.col("__node").alias(node), F.col("__path").alias("path"), F.col("__orphan").alias("orphan"))
    return nodes.join(done, [*keys, node])


def siblings(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """``(doc_id, index_id, sibling_id)`` for the asked nodes; node and sibling share the parent and differ."""
    asked = ids.join(nodes.select("doc_id", "index_id", "parent_id"), ["doc_id", "index_id"])
    others = nodes.select("doc_id", "parent_id", F.col("index_id").alias("sibling_id"))
    return asked.join(others, ["doc_id", "parent_id"]).filter(F.col("index_id") != F.col("sibling_id")).select(
        "doc_id", "index_id", "sibling_id"
    )


def adjacent_titles(nodes: DataFrame, rows: int | None = ROWS_PER_SEGMENT) -> DataFrame:
    """Nearest sibling titles before and after every title, NULL at the ends."""
    heads = nodes.filter(F.col("type") == "title").select("doc_id", "parent_id", "index_id")
    segment = position_segment("index_id", rows)
    before = prefix_scan(
        heads, ["doc_id", "parent_id"], ["index_id"],
        {"previous_id": Running("last", F.col("index_id"), inclusive=False)}, segment,
    )
    return prefix_scan(
        before, ["doc_id", "parent_id"], ["index_id"],
        {"next_id": Running("last", F.col("index_id"), inclusive=False)}, segment, reverse=True,
    )


def subtree(nodes: DataFrame, top: DataFrame) -> DataFrame:
    """Nodes at or below the given ``(doc_id, index_id)``, without repetition.

    The paths are exploded and semi-joined, so nested tops need no extra deduplication of whole rows.
    """
    wanted = top.select("doc_id", F.col("index_id").alias("__ancestor")).distinct()
    below = (
        nodes.select("doc_id", "index_id", F.explode("path").alias("__ancestor"))
        .join(wanted, ["doc_id", "__ancestor"], "left_semi")
        .select("doc_id", "index_id").distinct()
    )
    return nodes.join(below, ["doc_id", "index_id"], "left_semi")


def ancestor_at(depth: int) -> Column:
    """Id of the ancestor at ``depth``; the node itself at its own depth, NULL above the path."""
    if depth == 0:
        return F.lit(0)
    return F.get(F.col("path"), F.lit(depth - 1))


def at_depth(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.filter(F.col("depth") == depth) if depth >= 0 else nodes.limit(0)


def title_paths(nodes: DataFrame) -> DataFrame:
    """Add ``title_path``: the lower-cased contents of all titles on the root path, joined without a separator.

    Only titles have children, so a path holds at most one entry per outline level.
    """
    heads = nodes.filter(F.col("type") == "title").select(
        "doc_id", F.col("index_id").alias("__title"), F.lower("content").alias("__text")
    )
    title_texts = (
        nodes.filter(F.col("type") == "title")
        .select("doc_id", "index_id", F.posexplode("path").alias("__level", "__title"))
        .join(heads, ["doc_id", "__title"])
        .groupBy("doc_id", "index_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__level", "__text"))), lambda s: s["__text"]), "").alias("title_path"))
    )
    own = F.when(F.col("type") == "title", F.col("index_id")).otherwise(F.col("parent_id"))
    keyed = nodes.withColumn("__own", own)
    return keyed.join(
        title_texts.withColumnRenamed("index_id", "__own"), ["doc_id", "__own"], "left"
    ).drop("__own").withColumn("title_path", F.coalesce("title_path", F.lit("")))


@dataclass(frozen=True)
class StructuralFilter:
    """One condition of an aggregate question: ``image``, ``table``, ``page`` or ``section``."""

    filter_type: str
    filter_value: str | None = None


def structural_filter(nodes: DataFrame, filters: Sequence[StructuralFilter]) -> DataFrame:
    """Apply filters in order to the non-root nodes.

    A page is 1-based, either ``n`` or ``a-b``. A page or section filter without a usable value changes nothing.
    """
    kept = nodes.filter(F.col("index_id") > 0)
    for condition in filters:
        value = condition.filter_value
        if condition.filter_type in ("image", "table"):
            kept = kept.filter(F.col("type") == condition.filter_type)
        elif condition.filter_type == "page" and value is not None:
            limits = _page_limits(value)
            if limits:
                kept = kept.filter((F.col("page_idx") + 1).between(*limits))
        elif condition.filter_type == "section" and value is not None:
            if "title_path" not in kept.columns:
                kept = title_paths(kept)
            kept = kept.filter(F.contains(F.col("title_path"), F.lit(value.lower())))
    return kept


def _page_limits(value: str) -> tuple[int, int] | None:
    parts = value.split("-") if "-" in value else [value, value]
    try:
        low, high = (int(p) for p in parts)
    except ValueError:
        return None
    return low, high


def outline_lines(nodes: DataFrame) -> DataFrame:
    """One row per outline entry that is reachable through titles only, in reading order: depth, title and id."""
    heads = nodes.filter(F.col("outline_node") & ~F.col("orphan"))
    return heads.select(
        "doc_id", "index_id", F.concat_ws("\t", F.col("depth").cast("string"), "content", F.col("index_id").cast("string")).alias("line")
    )


def depth_summary(nodes: DataFrame) -> DataFrame:
    """Deepest level and node count per document."""
    return nodes.groupBy("doc_id").agg(F.max("depth").alias("max_depth"), F.count("*").alias("n_nodes"))


def children_summaries(nodes: DataFrame) -> DataFrame:
    """``(doc_id, index_id, child_id, line)``: the summary lines of one level, own line first (child 0)."""
    line = F.concat(F.col("index_id").cast("string"), F.lit(": "), F.coalesce(F.col("summary"), F.lit("")))
    own = nodes.select("doc_id", "index_id", F.lit(0).alias("child_id"), line.alias("line"))
    below = nodes.filter(F.col("summary").isNotNull() & (F.col("summary") != "") & F.col("parent_id").isNotNull()).select(
        "doc_id", F.col("parent_id").alias("index_id"), F.col("index_id").alias("child_id"), line.alias("line")
    )
    return own.unionByName(below)
