"""Document trees over the outline of ``documents`` and a generic tree over region, nation, customer and order."""

from leafspan.catalog.base import query, table
from leafspan.catalog.blocks import OUTLINE, numbered, outline_of, segment_length
from leafspan.operators import outline, tree
from leafspan.operators.tree import StructuralFilter
from leafspan.session import cut_lineage
from pyspark.sql import functions as F

TREE = f"""{OUTLINE},
assigned AS (
  SELECT n.*, max(o.pdf_id) OVER (PARTITION BY n.doc_id ORDER BY n.pdf_id ROWS UNBOUNDED PRECEDING) AS title_id,
         o.pdf_id IS NOT NULL AS in_outline, o.parent_id AS outline_parent, o.text_level AS outline_level
  FROM numbered n LEFT JOIN outline o ON o.doc_id = n.doc_id AND o.pdf_id = n.pdf_id),
indexed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pdf_id) AS INTEGER) AS index_id
  FROM assigned WHERE title_id IS NOT NULL),
linked AS (
  SELECT i.*, CASE WHEN i.in_outline AND i.outline_level = 0 THEN 0 WHEN i.in_outline THEN p.index_id ELSE t.index_id END AS parent_id,
         CASE WHEN i.in_outline THEN 'title' WHEN i.type IN ('image', 'table', 'equation') THEN i.type ELSE 'text' END AS node_type,
         CASE WHEN i.type IN ('image', 'table') THEN i.caption || i.footnote ELSE coalesce(i.text, '') END AS content
  FROM indexed i
  LEFT JOIN indexed p ON p.doc_id = i.doc_id AND p.pdf_id = i.outline_parent AND i.in_outline
  LEFT JOIN indexed t ON t.doc_id = i.doc_id AND t.pdf_id = i.title_id AND NOT i.in_outline),
nodes AS (
  SELECT doc_id, index_id, parent_id, node_type, 1 AS depth, [index_id] AS path, page_idx, content, pdf_id,
         CASE WHEN node_type = 'title' THEN lower(content) ELSE '' END AS title_path FROM linked WHERE parent_id = 0
  UNION ALL
  SELECT c.doc_id, c.index_id, c.parent_id, c.node_type, n.depth + 1, list_append(n.path, c.index_id), c.page_idx, c.content, c.pdf_id,
         n.title_path || CASE WHEN c.node_type = 'title' THEN lower(c.content) ELSE '' END
  FROM linked c JOIN nodes n ON n.doc_id = c.doc_id AND n.index_id = c.parent_id)
"""


def nodes_of(spark, sf):
    rows = segment_length(spark, sf)
    # The numbered blocks are a stage table of their own: outline, assignment and tree all read it.
    made = cut_lineage(numbered(spark, sf))
    entries = outline_of(made, rows)
    return tree.build(outline.assign_blocks(made, entries, rows), entries, rows)


@query(
    "tree_nodes",
    f"""WITH RECURSIVE {TREE}
SELECT doc_id, index_id, parent_id, node_type AS type, CAST(depth AS INTEGER) AS depth, pdf_id, page_idx, content FROM nodes""",
)
def tree_nodes(spark, sf):
    return nodes_of(spark, sf).select("doc_id", "index_id", "parent_id", "type", "depth", "pdf_id", "page_idx", "content")


@query(
    "tree_with_roots",
    f"""WITH RECURSIVE {TREE}
SELECT doc_id, index_id, node_type AS type, CAST(depth AS INTEGER) AS depth FROM nodes
UNION ALL SELECT DISTINCT doc_id, 0, 'root', 0 FROM nodes""",
)
def tree_with_roots(spark, sf):
    made = nodes_of(spark, sf)
    return made.unionByName(tree.roots(made)).select("doc_id", "index_id", "type", "depth")


@query(
    "tree_root_path",
    f"WITH RECURSIVE {TREE} SELECT doc_id, index_id, list_aggregate(path, 'string_agg', '/') AS path FROM nodes",
)
def tree_root_path(spark, sf):
    return nodes_of(spark, sf).select("doc_id", "index_id", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


@query(
    "tree_ancestor",
    f"WITH RECURSIVE {TREE} SELECT doc_id, index_id, path[1] AS section_1, path[2] AS section_2 FROM nodes",
)
def tree_ancestor(spark, sf):
    return nodes_of(spark, sf).select(
        "doc_id", "index_id", tree.ancestor_at(1).alias("section_1"), tree.ancestor_at(2).alias("section_2")
    )


@query(
    "tree_subtree",
    f"""WITH RECURSIVE {TREE},
chosen AS (SELECT doc_id, index_id FROM nodes WHERE node_type = 'title' AND depth = 2)
SELECT doc_id, index_id FROM nodes n
WHERE EXISTS (SELECT 1 FROM chosen t WHERE t.doc_id = n.doc_id AND list_contains(n.path, t.index_id))""",
)
def tree_subtree(spark, sf):
    made = nodes_of(spark, sf)
    return tree.subtree(made, made.filter("type = 'title' AND depth = 2")).select("doc_id", "index_id")


@query(
    "tree_siblings",
    f"""WITH RECURSIVE {TREE},
asked AS (SELECT doc_id, min(index_id) AS index_id FROM nodes WHERE depth = 2 GROUP BY doc_id)
SELECT a.doc_id, a.index_id, s.index_id AS sibling_id FROM asked a
JOIN nodes n ON n.doc_id = a.doc_id AND n.index_id = a.index_id
JOIN nodes s ON s.doc_id = n.doc_id AND s.parent_id = n.parent_id AND s.index_id <> n.index_id""",
)
def tree_siblings(spark, sf):
    made = nodes_of(spark, sf)
    asked = made.filter("depth = 2").groupBy("doc_id").agg(F.min("index_id").alias("index_id"))
    return tree.siblings(made, asked)


@query(
    "tree_adjacent_titles",
    f"""WITH RECURSIVE {TREE}
SELECT doc_id, parent_id, index_id, lag(index_id) OVER w AS previous_id, lead(index_id) OVER w AS next_id
FROM nodes WHERE node_type = 'title' WINDOW w AS (PARTITION BY doc_id, parent_id ORDER BY index_id)""",
)
def tree_adjacent_titles(spark, sf):
    return tree.adjacent_titles(nodes_of(spark, sf), segment_length(spark, sf))


@query(
    "tree_nodes_at_depth",
    f"WITH RECURSIVE {TREE} SELECT doc_id, index_id, node_type AS type FROM nodes WHERE depth = 2",
)
def tree_nodes_at_depth(spark, sf):
    return tree.at_depth(nodes_of(spark, sf), 2).select("doc_id", "index_id", "type")


@query(
    "tree_depth_summary",
    f"WITH RECURSIVE {TREE} SELECT doc_id, CAST(max(depth) AS INTEGER) AS max_depth, count(*) AS n_nodes FROM nodes GROUP BY doc_id",
)
def tree_depth_summary(spark, sf):
    return tree.depth_summary(nodes_of(spark, sf))


@query(
    "tree_outline_lines",
    f"""WITH RECURSIVE {TREE}
SELECT doc_id, index_id, depth || chr(9) || content || chr(9) || index_id AS line FROM nodes WHERE node_type = 'title'""",
)
def tree_outline_lines(spark, sf):
    return tree.outline_lines(nodes_of(spark, sf))


@query(
    "tree_child_summaries",
    f"""WITH RECURSIVE {TREE},
told AS (SELECT doc_id, index_id, parent_id, CASE WHEN node_type = 'title' THEN content ELSE '' END AS summary FROM nodes)
SELECT doc_id, index_id, 0 AS child_id, index_id || ': ' || summary AS line FROM told
UNION ALL SELECT doc_id, parent_id, index_id, index_id || ': ' || summary FROM told WHERE summary <> ''""",
)
def tree_child_summaries(spark, sf):
    made = nodes_of(spark, sf).withColumn("summary", F.when(F.col("type") == "title", F.col("content")).otherwise(""))
    return tree.children_summaries(made)


@query(
    "filter_type",
    f"WITH RECURSIVE {TREE} SELECT doc_id, index_id, content FROM nodes WHERE node_type = 'table'",
)
def filter_type(spark, sf):
    return tree.structural_filter(nodes_of(spark, sf), [StructuralFilter("table")]).select("doc_id", "index_id", "content")


@query(
    "filter_page_range",
    f"WITH RECURSIVE {TREE} SELECT doc_id, index_id, page_idx + 1 AS page FROM nodes WHERE page_idx + 1 BETWEEN 2 AND 3",
)
def filter_page_range(spark, sf):
    kept = tree.structural_filter(nodes_of(spark, sf), [StructuralFilter("page", "2-3"), StructuralFilter("page", "all")])
    return kept.select("doc_id", "index_id", (F.col("page_idx") + 1).alias("page"))


@query(
    "filter_section",
    f"WITH RECURSIVE {TREE} SELECT doc_id, index_id, title_path FROM nodes WHERE contains(title_path, 'the ')",
)
def filter_section(spark, sf):
    kept = tree.structural_filter(nodes_of(spark, sf), [StructuralFilter("section", "The ")])
    return kept.select("doc_id", "index_id", "title_path")


@query(
    "global_count",
    f"""WITH RECURSIVE {TREE}
SELECT d.doc_id, count(n.index_id) AS matches,
  'Based on my analysis of the document, I found ' || count(n.index_id)
  || ' items that answer the question: ''How many images are on pages 1 to 4?''' AS answer
FROM (SELECT DISTINCT doc_id FROM nodes) d
LEFT JOIN nodes n ON n.doc_id = d.doc_id AND n.node_type = 'image' AND n.page_idx + 1 BETWEEN 1 AND 4 GROUP BY d.doc_id""",
)
def global_count(spark, sf):
    from leafspan.plans.answers import count_answers

    made = nodes_of(spark, sf)
    kept = tree.structural_filter(made, [StructuralFilter("page", "1-4"), StructuralFilter("image")])
    question = F.lit("How many images are on pages 1 to 4?")
    return count_answers(made.select("doc_id").distinct().withColumn("question", question), kept).drop("question")


PLACES = """
places AS (
  SELECT 1 + r_regionkey AS id, CAST(0 AS BIGINT) AS parent, r_name AS name FROM region UNION ALL
  SELECT 1000 + n_nationkey, 1 + n_regionkey, n_name FROM nation UNION ALL
  SELECT 1000000 + c_custkey, 1000 + c_nationkey, c_name FROM customer UNION ALL
  SELECT 1000000000000 + o_orderkey, 1000000 + o_custkey, o_orderstatus FROM orders),
walked AS (
  SELECT id, CAST(id AS VARCHAR) AS path, 1 AS depth FROM places WHERE parent = 0 UNION ALL
  SELECT p.id, w.path || '/' || p.id, w.depth + 1 FROM places p JOIN walked w ON p.parent = w.id)"""


@query(
    "hierarchy_root_path",
    f"WITH RECURSIVE {PLACES} SELECT id, path, CAST(depth AS INTEGER) AS depth FROM walked",
)
def hierarchy_root_path(spark, sf):
    read = lambda n: table(spark, sf, n)
    big = lambda c: F.col(c).cast("bigint")
    places = (
        read("region").select((big("r_regionkey") + 1).alias("id"), F.lit(0).cast("bigint").alias("parent"))
        .union(read("nation").select(big("n_nationkey") + 1000, big("n_regionkey") + 1))
        .union(read("customer").select(big("c_custkey") + 1000000, big("c_nationkey") + 1000))
        .union(read("orders").select(big("o_orderkey") + 1000000000000, big("o_custkey") + 1000000))
    )
    found = tree.root_paths(places, [], "id", "parent").filter(~F.col("orphan"))
    return found.select("id", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), F.size("path").alias("depth"))
