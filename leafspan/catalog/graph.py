"""Rank iteration over supplier-part graphs, semantic edges over ``embeddings``, section linking over the tree."""

from leafspan.catalog.base import query, table
from leafspan.catalog.tree import TREE, nodes_of
from leafspan.functions.text import WHITESPACE
from leafspan.models.base import NameExtractor
from leafspan.operators import graph
from leafspan.operators.ranking import top_k
from leafspan.plans import strategies
from leafspan.session import cut_lineage
from pyspark.sql import Window
from pyspark.sql import functions as F

# One graph per return flag: suppliers and parts, weighted by shipments. Start weights come from supplier discounts.
RANK_GRAPH = """
edges AS (
  SELECT l_returnflag AS doc_id, 'S' || l_suppkey AS src, 'P' || l_partkey AS tgt, CAST(count(*) AS DOUBLE) AS weight FROM lineitem GROUP BY ALL),
ends AS (SELECT doc_id, src AS u, tgt AS v, weight FROM edges UNION ALL SELECT doc_id, tgt, src, weight FROM edges),
outs AS (SELECT doc_id, u, sum(weight) AS total FROM ends GROUP BY ALL),
discounts AS (SELECT l_returnflag AS doc_id, 'S' || l_suppkey AS node_name, sum(l_discount) AS weight FROM lineitem GROUP BY ALL),
all_nodes AS (
  SELECT doc_id, u AS node_name FROM outs UNION SELECT f.doc_id, 'P' || p_partkey FROM part, (SELECT DISTINCT doc_id FROM edges) f),
nodes AS (
  SELECT a.doc_id, a.node_name, coalesce(d.weight, 0) / sum(coalesce(d.weight, 0)) OVER (PARTITION BY a.doc_id) AS start,
         count(*) OVER (PARTITION BY a.doc_id) AS n, o.u IS NULL AS dangling
  FROM all_nodes a LEFT JOIN discounts d ON d.doc_id = a.doc_id AND d.node_name = a.node_name
  LEFT JOIN outs o ON o.doc_id = a.doc_id AND o.u = a.node_name),
shares AS (SELECT e.doc_id, e.u, e.v, e.weight / o.total AS share FROM ends e JOIN outs o ON o.doc_id = e.doc_id AND o.u = e.u),
r0 AS (SELECT doc_id, node_name, 1.0 / n AS rank, FALSE AS done FROM nodes)"""

STEPS = 24


def _rank_steps() -> str:
    """One step per iteration; a graph that has settled keeps its ranks."""
    text = ""
    for i in range(STEPS):
        text += f""",
f{i + 1} AS MATERIALIZED (
  SELECT s.doc_id, s.v AS node_name, sum(r.rank * s.share) AS received FROM shares s
  JOIN r{i} r ON r.doc_id = s.doc_id AND r.node_name = s.u GROUP BY ALL),
n{i + 1} AS MATERIALIZED (
  SELECT r.doc_id, r.node_name, r.rank AS before, r.done, n.n, CASE WHEN r.done THEN r.rank ELSE
    0.5 * (coalesce(f.received, 0) + n.start * sum(CASE WHEN n.dangling THEN r.rank ELSE 0 END) OVER (PARTITION BY r.doc_id)) + 0.5 * n.start END AS rank
  FROM r{i} r JOIN nodes n ON n.doc_id = r.doc_id AND n.node_name = r.node_name
  LEFT JOIN f{i + 1} f ON f.doc_id = r.doc_id AND f.node_name = r.node_name),
r{i + 1} AS MATERIALIZED (
  SELECT doc_id, node_name, rank, done OR sum(abs(rank - before)) OVER (PARTITION BY doc_id) < n * 1e-6 AS done FROM n{i + 1})"""
    return text


RANKS = f"{RANK_GRAPH}{_rank_steps()}, ranks AS (SELECT doc_id, node_name, rank FROM r{STEPS})"


def rank_inputs(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_suppkey", "l_partkey", "l_discount")
    supplier = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    part = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    edges = lines.groupBy(F.col("l_returnflag").alias("doc_id"), supplier.alias("src"), part.alias("tgt")).agg(
        F.count("*").cast("double").alias("weight")
    )
    # Read for both ends of the nodes and in both directions by the ranks.
    edges = cut_lineage(edges)
    discounts = lines.groupBy(F.col("l_returnflag").alias("doc_id"), supplier.alias("node_name")).agg(F.sum("l_discount").alias("weight"))
    flags = F.collect_set("l_returnflag")
    parts = table(spark, sf, "part").select(
        F.explode(lines.agg(flags).scalar()).alias("doc_id"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("node_name")
    )
    nodes = (
        edges.select("doc_id", F.col("src").alias("node_name")).unionByName(edges.select("doc_id", F.col("tgt").alias("node_name")))
        .unionByName(parts).distinct().join(discounts, ["doc_id", "node_name"], "left")
        .withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    )
    return nodes, edges


def ranks_of(spark, sf):
    return graph.pagerank(*rank_inputs(spark, sf), alpha=0.5)


@query("ppr_entities", f"WITH {RANKS} SELECT doc_id, node_name, round(rank, 9) AS rank FROM ranks")
def ppr_entities(spark, sf):
    return ranks_of(spark, sf).withColumn("rank", F.round("rank", 9))


@query(
    "ppr_top_entities",
    f"""WITH {RANKS} SELECT doc_id, node_name, round(rank, 9) AS rank, CAST(nth AS INTEGER) AS nth FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(rank, 12) DESC, node_name) AS nth FROM ranks) WHERE nth <= 5""",
)
def ppr_top_entities(spark, sf):
    order = Window.partitionBy("doc_id").orderBy(F.round("rank", 12).desc(), "node_name")
    best = ranks_of(spark, sf).withColumn("nth", F.row_number().over(order).cast("int")).filter("nth <= 5")
    return best.withColumn("rank", F.round("rank", 9))


BRIDGE = """bridge AS (SELECT DISTINCT l_returnflag AS doc_id, 'P' || l_partkey AS node_name, l_orderkey AS index_id FROM lineitem)"""


def order_bridge(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("doc_id"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("node_name"),
        F.col("l_orderkey").alias("index_id"),
    ).distinct()


@query(
    "ppr_node_scores",
    f"""WITH {RANKS}, {BRIDGE},
targets AS (SELECT f.doc_id, o_orderkey AS index_id FROM orders, (SELECT DISTINCT doc_id FROM edges) f),
sums AS (SELECT b.doc_id, b.index_id, sum(r.rank) AS score FROM bridge b JOIN ranks r ON r.doc_id = b.doc_id AND r.node_name = b.node_name GROUP BY ALL)
SELECT t.doc_id, t.index_id, round(coalesce(s.score, 0), 12) AS score FROM targets t
LEFT JOIN sums s ON s.doc_id = t.doc_id AND s.index_id = t.index_id""",
)
def ppr_node_scores(spark, sf):
    flags = table(spark, sf, "lineitem").agg(F.collect_set("l_returnflag")).scalar()
    targets = table(spark, sf, "orders").select(F.explode(flags).alias("doc_id"), F.col("o_orderkey").alias("index_id"))
    return graph.node_scores(ranks_of(spark, sf), order_bridge(spark, sf), targets)


@query(
    "ppr_top_nodes",
    f"""WITH {RANKS}, {BRIDGE},
sums AS (SELECT b.doc_id, b.index_id, round(sum(r.rank), 12) AS score FROM bridge b JOIN ranks r ON r.doc_id = b.doc_id AND r.node_name = b.node_name GROUP BY ALL)
SELECT doc_id, index_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, index_id) AS rank FROM sums) WHERE rank <= 7""",
)
def ppr_top_nodes(spark, sf):
    return top_k(graph.node_scores(ranks_of(spark, sf), order_bridge(spark, sf)), ["doc_id"], "score", "index_id", 7)


SIMILAR = """
wide AS (SELECT label AS doc_id, vec_id AS node_name, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
edges AS (
  SELECT doc_id, node_name AS src, lead(node_name) OVER (PARTITION BY doc_id ORDER BY node_name) AS tgt FROM wide QUALIFY tgt IS NOT NULL),
edge_similarity AS (
  SELECT e.doc_id, e.src, e.tgt, round(list_cosine_similarity(a.v, b.v), 9) AS similarity
  FROM edges e JOIN wide a ON a.node_name = e.src JOIN wide b ON b.node_name = e.tgt),
limits AS (
  SELECT w.doc_id, coalesce(quantile_cont(similarity, 0.85), 1.0) AS threshold FROM (SELECT DISTINCT doc_id FROM wide) w
  LEFT JOIN edge_similarity e ON e.doc_id = w.doc_id GROUP BY w.doc_id),
caps AS (
  SELECT w.doc_id, CAST(greatest(1, ceil(2 * count(e.src) / CAST(count(*) AS DOUBLE))) AS INTEGER) AS cap
  FROM wide w LEFT JOIN edges e ON e.src = w.node_name GROUP BY w.doc_id)"""


def similar_inputs(spark, sf):
    nodes = table(spark, sf, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("node_name"), "embedding")
    order = Window.partitionBy("doc_id").orderBy("node_name")
    edges = nodes.select("doc_id", F.col("node_name").alias("src"), F.lead("node_name").over(order).alias("tgt")).filter("tgt IS NOT NULL")
    return nodes, edges


@query("edge_similarity", f"WITH {SIMILAR} SELECT doc_id, src, tgt, round(similarity, 9) AS similarity FROM edge_similarity")
def edge_similarity(spark, sf):
    nodes, edges = similar_inputs(spark, sf)
    return graph.edge_similarities(edges, nodes).select("doc_id", "src", "tgt", F.round("similarity", 9).alias("similarity"))


@query("edge_percentile", f"WITH {SIMILAR} SELECT doc_id, round(threshold, 9) AS threshold FROM limits")
def edge_percentile(spark, sf):
    nodes, edges = similar_inputs(spark, sf)
    return graph.similarity_threshold(graph.edge_similarities(edges, nodes), nodes).withColumn("threshold", F.round("threshold", 9))


@query("degree_cap", f"WITH {SIMILAR} SELECT doc_id, cap FROM caps")
def degree_cap(spark, sf):
    return graph.degree_cap(*similar_inputs(spark, sf))


@query(
    "semantic_edges",
    f"""WITH {SIMILAR},
fresh AS (
  SELECT a.doc_id, a.node_name, b.node_name AS partner, round(list_cosine_similarity(a.v, b.v), 9) AS similarity
  FROM wide a JOIN wide b ON b.doc_id = a.doc_id AND b.node_name <> a.node_name
  WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = least(a.node_name, b.node_name) AND e.tgt = greatest(a.node_name, b.node_name))),
ranked AS (
  SELECT f.*, cap, row_number() OVER (PARTITION BY f.doc_id, node_name ORDER BY similarity DESC, partner) AS nth
  FROM fresh f JOIN limits l ON l.doc_id = f.doc_id JOIN caps c ON c.doc_id = f.doc_id WHERE similarity > threshold)
SELECT DISTINCT doc_id, least(node_name, partner) AS src, greatest(node_name, partner) AS tgt, round(similarity, 9) AS weight FROM ranked WHERE nth <= cap""",
)
def semantic_edges(spark, sf):
    nodes, edges = similar_inputs(spark, sf)
    return graph.semantic_edges(nodes, edges).withColumn("weight", F.round("weight", 9))


NODE_BRIDGE = f"""{TREE},
bridge AS (
  SELECT DISTINCT doc_id, index_id, lower(unnest(regexp_extract_all(content, '[A-Z][a-z]{{3,}}'))) AS node_name FROM nodes)"""


def tree_bridge(nodes):
    # A node is one row, so its names are made distinct in place.
    names = F.transform(F.expr("regexp_extract_all(content, '[A-Z][a-z]{3,}', 0)"), lambda n: F.lower(n))
    return nodes.select("doc_id", "index_id", F.explode(F.array_distinct(names)).alias("node_name"))


@query(
    "section_entities",
    f"WITH RECURSIVE {NODE_BRIDGE} SELECT DISTINCT n.doc_id, n.path[2] AS section_id, b.node_name FROM nodes n JOIN bridge b ON b.doc_id = n.doc_id AND b.index_id = n.index_id WHERE n.path[2] IS NOT NULL",
)
def section_entities(spark, sf):
    nodes = nodes_of(spark, sf)
    return graph.section_entities(tree_bridge(nodes), nodes, 2)


@query(
    "section_split",
    f"""WITH RECURSIVE {NODE_BRIDGE},
sections AS (SELECT doc_id, index_id AS section_id FROM nodes WHERE depth = 2),
reached AS (SELECT DISTINCT n.doc_id, n.path[2] AS section_id FROM nodes n JOIN bridge b ON b.doc_id = n.doc_id AND b.index_id = n.index_id)
SELECT s.doc_id, s.section_id, EXISTS (SELECT 1 FROM reached l WHERE l.doc_id = s.doc_id AND l.section_id = s.section_id) AS linked FROM sections s""",
)
def section_split(spark, sf):
    nodes = nodes_of(spark, sf)
    sections = nodes.filter("depth = 2").select("doc_id", F.col("index_id").alias("section_id"))
    found, rest = graph.split_sections(sections, graph.section_entities(tree_bridge(nodes), nodes, 2))
    return found.withColumn("linked", F.lit(True)).unionByName(rest.withColumn("linked", F.lit(False)))


def words_of(column):
    return f"list_filter(regexp_split_to_array(lower({column}), '{WHITESPACE}+'), lambda x: x <> '')"


@query(
    "section_selection",
    f"""WITH RECURSIVE {NODE_BRIDGE},
last_titles AS (SELECT doc_id, arg_max(content, index_id) AS question FROM nodes WHERE node_type = 'title' GROUP BY doc_id),
asked_names AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(question, '[A-Z][a-z]{{3,}}'))) AS node_name FROM last_titles),
reached_sections AS (
  SELECT DISTINCT n.doc_id, n.path[2] AS section_id FROM asked_names m JOIN bridge b ON b.doc_id = m.doc_id AND b.node_name = m.node_name
  JOIN nodes n ON n.doc_id = b.doc_id AND n.index_id = b.index_id WHERE n.path[2] IS NOT NULL),
offered_sections AS (
  SELECT n.doc_id, n.index_id AS section_id, n.content AS title FROM nodes n ANTI JOIN reached_sections l ON l.doc_id = n.doc_id AND l.section_id = n.index_id WHERE n.depth = 2)
SELECT doc_id, section_id, TRUE AS linked FROM reached_sections UNION ALL
SELECT o.doc_id, o.section_id, FALSE FROM offered_sections o JOIN last_titles h ON h.doc_id = o.doc_id
WHERE len(list_intersect({words_of("h.question")}, {words_of("coalesce(o.title, '')")})) > 0""",
)
def section_selection(spark, sf):
    """The last title of every document asks; its names are the mapped entities."""
    nodes = cut_lineage(nodes_of(spark, sf))
    # Read for the sections that names reach and for the names that are known.
    bridge = cut_lineage(tree_bridge(nodes))
    last = nodes.filter("type = 'title'").groupBy("doc_id").agg(F.max_by("content", "index_id").alias("question"))
    asked = cut_lineage(last.select(F.col("doc_id").cast("string").alias("qid"), "doc_id", "question"))
    named = asked.select("qid", "doc_id", F.explode(NameExtractor().names(F.col("question"))).alias("node_name"))
    index = strategies.Index(nodes, bridge.select("doc_id", "node_name").distinct(), bridge.limit(0), bridge)
    return strategies.select_sections(asked, named, index, strategies.Models(), 2).select("doc_id", "section_id", "linked")


@query(
    "start_weights",
    f"""WITH {RANK_GRAPH},
mapped AS (SELECT l_returnflag AS doc_id, 'S' || l_suppkey AS node_name, sum((l_discount * 10 - 0.5 + 1) / 2) AS weight FROM lineitem GROUP BY ALL)
SELECT a.doc_id, a.node_name, round(coalesce(m.weight, 0), 9) AS weight FROM all_nodes a LEFT JOIN mapped m ON m.doc_id = a.doc_id AND m.node_name = a.node_name""",
)
def start_weights(spark, sf):
    nodes, _ = rank_inputs(spark, sf)
    mapped = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("doc_id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("node_name"),
        (F.col("l_discount") * 10 - 0.5).alias("similarity"),
    )
    return graph.start_weights(nodes, mapped).withColumn("weight", F.round("weight", 9))
