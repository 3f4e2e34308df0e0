"""Entities and relations from the capitalised words of ``documents``."""

from leafspan.catalog.base import query, table
from leafspan.catalog.blocks import segment_length
from leafspan.functions import text as T
from leafspan.operators import entities, graph
from leafspan.sources.corpus import mentions_from_documents, relations_from_documents, type_of
from pyspark.sql import Window
from pyspark.sql import functions as F

MENTIONS = """
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
         CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS node_id FROM documents),
names AS (SELECT doc_id, node_id, regexp_extract_all(raw, '[A-Z][a-z]{3,}') AS names FROM lines),
mentions AS (
  SELECT doc_id, node_id, seq, lower(name) AS entity_name,
         CASE length(name) % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORGANIZATION' ELSE 'GEOGRAPHIC_PLACE' END AS entity_type,
         'named in line ' || node_id AS description
  FROM (SELECT doc_id, node_id, unnest(names) AS name, CAST(generate_subscripts(names, 1) - 1 AS INTEGER) AS seq FROM names)),
relations AS (
  SELECT doc_id, node_id, CAST(i AS INTEGER) AS seq, lower(names[i + 1]) AS src_entity_name,
         lower(names[i + 2]) || CASE WHEN i % 4 = 0 THEN 's' ELSE '' END AS tgt_entity_name,
         CASE WHEN i % 2 = 0 THEN 'follows' ELSE 'near' END AS relation_name, CAST(1 + i % 9 AS DOUBLE) AS weight,
         'side by side in line ' || node_id AS description
  FROM (SELECT *, unnest(range(0, len(names) - 1)) AS i FROM names))
"""


def mentions(spark, sf):
    return entities.clean_mentions(mentions_from_documents(table(spark, sf, "documents", spread=True)))


def relations(spark, sf):
    raw = relations_from_documents(table(spark, sf, "documents", spread=True))
    for side in ("src_entity_name", "tgt_entity_name"):
        raw = raw.withColumn(side, T.clean_entity_name(F.col(side)))
    return raw


@query(
    "entity_merge_in_node",
    f"""WITH {MENTIONS}
SELECT doc_id, node_id, entity_name, entity_type, min(seq) AS seq, string_agg(description, ' ' ORDER BY seq) AS description
FROM mentions GROUP BY ALL""",
)
def entity_merge_in_node(spark, sf):
    return entities.merge_in_node(mentions(spark, sf))


@query(
    "entity_merge",
    f"""WITH {MENTIONS}
SELECT doc_id, entity_name, entity_type, count(*) AS n_mentions, min(node_id) AS first_node, max(node_id) AS last_node,
  first(description ORDER BY length(description) DESC, node_id, seq) AS longest_description,
  'Name: ' || entity_name || chr(10) || 'Type: ' || entity_type AS node_name
FROM mentions GROUP BY doc_id, entity_name, entity_type""",
)
def entity_merge(spark, sf):
    return entities.merge_entities(mentions(spark, sf))


@query(
    "entity_descriptions",
    f"""WITH {MENTIONS},
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, entity_name, entity_type ORDER BY node_id, seq) AS nth FROM mentions)
SELECT doc_id, entity_name, entity_type, CAST((nth - 1) // 1000 AS INTEGER) AS part, string_agg(description, '<SEP>' ORDER BY nth) AS description
FROM placed GROUP BY ALL""",
)
def entity_descriptions(spark, sf):
    return entities.entity_descriptions(mentions(spark, sf), segment_length(spark, sf))


@query(
    "entity_sources",
    f"""WITH {MENTIONS}
SELECT DISTINCT doc_id, 'Name: ' || entity_name || chr(10) || 'Type: ' || entity_type AS node_name, node_id AS index_id FROM mentions""",
)
def entity_sources(spark, sf):
    return entities.entity_sources(mentions(spark, sf))


@query(
    "relation_dedup",
    f"""WITH {MENTIONS}
SELECT doc_id, node_id, src_entity_name, tgt_entity_name, relation_name, seq, weight, description FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, node_id, src_entity_name, tgt_entity_name, relation_name ORDER BY seq) AS nth
  FROM relations) WHERE nth = 1""",
)
def relation_dedup(spark, sf):
    return entities.deduplicate_relations(relations(spark, sf))


@query(
    "endpoint_repair",
    f"""WITH {MENTIONS},
ends AS (SELECT DISTINCT doc_id, node_id, tgt_entity_name AS name FROM relations),
known AS (SELECT DISTINCT doc_id, node_id, entity_name FROM mentions),
best AS (
  SELECT e.doc_id, e.node_id, e.name, k.entity_name, levenshtein(e.name, k.entity_name) AS d,
         row_number() OVER (PARTITION BY e.doc_id, e.node_id, e.name ORDER BY levenshtein(e.name, k.entity_name), k.entity_name) AS nth
  FROM ends e JOIN known k USING (doc_id, node_id))
SELECT doc_id, node_id, name,
  CASE WHEN 1 - d / CAST(greatest(length(name), length(entity_name)) AS DOUBLE) >= 0.9 THEN entity_name ELSE name END AS repaired_name,
  1 - d / CAST(greatest(length(name), length(entity_name)) AS DOUBLE) < 0.9 AS is_new
FROM best WHERE nth = 1""",
)
def endpoint_repair(spark, sf):
    ends = relations(spark, sf).select("doc_id", "node_id", F.col("tgt_entity_name").alias("name"))
    return entities.repair_endpoints(ends, mentions(spark, sf))


EDGES = f"""{MENTIONS},
named AS (
  SELECT doc_id, CAST(node_id AS BIGINT) * 100000 + seq AS seq, src_entity_name AS src, tgt_entity_name AS tgt, weight, relation_name FROM relations),
edges AS (
  SELECT doc_id, least(src, tgt) AS src, greatest(src, tgt) AS tgt, arg_max(weight, seq) AS weight, arg_max(relation_name, seq) AS relation_name
  FROM named WHERE src <> tgt GROUP BY ALL)"""


def named_edges(spark, sf):
    return relations(spark, sf).select(
        "doc_id", (F.col("node_id").cast("bigint") * 100000 + F.col("seq")).alias("seq"), F.col("src_entity_name").alias("src"),
        F.col("tgt_entity_name").alias("tgt"), "weight", "relation_name",
    )


@query("edge_last_wins", f"WITH {EDGES} SELECT * FROM edges")
def edge_last_wins(spark, sf):
    return entities.last_edges(named_edges(spark, sf))


@query("self_loops", f"WITH {EDGES} SELECT doc_id, seq, src, tgt FROM named WHERE src <> tgt")
def self_loops(spark, sf):
    return graph.self_loops_removed(named_edges(spark, sf)).select("doc_id", "seq", "src", "tgt")


ALIASES = """
aliases AS (
  SELECT c_mktsegment AS doc_id, 'E' || c_custkey AS old_name, 'E' || (c_custkey // 3) AS new_name FROM customer),
walk AS (
  SELECT doc_id, old_name, new_name AS here FROM aliases UNION
  SELECT w.doc_id, w.old_name, a.new_name FROM walk w JOIN aliases a ON a.doc_id = w.doc_id AND a.old_name = w.here),
resolved AS (
  SELECT w.doc_id, w.old_name, w.here AS latest_name FROM walk w
  LEFT JOIN aliases a ON a.doc_id = w.doc_id AND a.old_name = w.here WHERE a.old_name IS NULL OR a.new_name = w.here)"""


def aliases(spark, sf):
    name = lambda c: F.concat(F.lit("E"), c.cast("string"))
    return table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("doc_id"), name(F.col("c_custkey")).alias("old_name"),
        name(F.floor(F.col("c_custkey") / 3)).alias("new_name"),
    )


@query("alias_closure", f"WITH RECURSIVE {ALIASES} SELECT * FROM resolved")
def alias_closure(spark, sf):
    return entities.resolve_aliases(aliases(spark, sf))


@query(
    "alias_relabel",
    f"""WITH RECURSIVE {ALIASES},
bought AS (
  SELECT c_mktsegment AS doc_id, o_orderkey AS seq, 'E' || o_custkey AS src, 'E' || ((o_custkey * 7) % (SELECT count(*) FROM customer)) AS tgt,
         o_totalprice AS weight FROM orders JOIN customer ON c_custkey = o_custkey),
moved AS (
  SELECT b.doc_id, b.seq, coalesce(s.latest_name, b.src) AS src, coalesce(t.latest_name, b.tgt) AS tgt, b.weight
  FROM bought b LEFT JOIN resolved s ON s.doc_id = b.doc_id AND s.old_name = b.src
  LEFT JOIN resolved t ON t.doc_id = b.doc_id AND t.old_name = b.tgt)
SELECT doc_id, least(src, tgt) AS src, greatest(src, tgt) AS tgt, arg_max(weight, seq) AS weight FROM moved WHERE src <> tgt GROUP BY ALL""",
)
def alias_relabel(spark, sf):
    customers, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    n = customers.agg(F.count("*")).scalar()
    name = lambda c: F.concat(F.lit("E"), c.cast("string"))
    bought = orders.join(customers, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_mktsegment").alias("doc_id"), F.col("o_orderkey").alias("seq"), name(F.col("o_custkey")).alias("src"),
        name((F.col("o_custkey") * 7) % n).alias("tgt"), F.col("o_totalprice").alias("weight"),
    )
    return entities.relabel_edges(bought, entities.resolve_aliases(aliases(spark, sf)))


@query(
    "entity_clusters",
    """WITH RECURSIVE same AS (
  SELECT lang, doc_id, lag(doc_id) OVER (PARTITION BY lang, text ORDER BY doc_id) AS copy,
         lag(doc_id) OVER (PARTITION BY lang, n_chars // 10, source ORDER BY doc_id) AS alike FROM documents),
pairs AS (SELECT lang, doc_id, copy AS other FROM same WHERE copy IS NOT NULL UNION SELECT lang, doc_id, alike FROM same WHERE alike IS NOT NULL),
both_ways AS (SELECT lang, doc_id AS a, other AS b FROM pairs UNION SELECT lang, other, doc_id FROM pairs),
reach AS (SELECT lang, a, a AS b FROM both_ways UNION SELECT r.lang, r.a, e.b FROM reach r JOIN both_ways e ON e.lang = r.lang AND e.a = r.b)
SELECT lang AS doc_id, a AS name, min(b) AS root FROM reach GROUP BY ALL""",
)
def entity_clusters(spark, sf):
    docs = table(spark, sf, "documents")
    before = lambda *keys: F.lag("doc_id").over(Window.partitionBy(*keys).orderBy("doc_id"))
    # Equal texts are grouped by digest and length, which keeps the texts out of the shuffle.
    same = docs.select("lang", "doc_id", "source", "n_chars", F.sha2("text", 256).alias("digest")).withColumn(
        "copy", before("lang", "digest")
    ).withColumn("alike", before("lang", F.floor(F.col("n_chars") / 10), "source"))
    pairs = same.select(F.col("lang").alias("doc_id"), F.col("doc_id").alias("left"), F.explode(F.array("copy", "alike")).alias("right"))
    return entities.clusters(pairs.filter("right IS NOT NULL"))


GRAPH = f"""{EDGES},
bridge AS (SELECT DISTINCT doc_id, node_id AS index_id, entity_name AS node_name FROM mentions),
chosen AS (SELECT doc_id, max(index_id) AS index_id FROM bridge GROUP BY doc_id),
linked AS (SELECT DISTINCT b.doc_id, b.node_name FROM bridge b JOIN chosen c ON c.doc_id = b.doc_id AND c.index_id = b.index_id)"""


def bridge_of(spark, sf):
    return mentions(spark, sf).select("doc_id", F.col("node_id").alias("index_id"), F.col("entity_name").alias("node_name")).distinct()


def last_nodes(bridge):
    return bridge.groupBy("doc_id").agg(F.max("index_id").alias("index_id"))


@query(
    "induced_subgraph",
    f"""WITH {GRAPH}
SELECT e.doc_id, e.src, e.tgt, e.weight FROM edges e
JOIN linked s ON s.doc_id = e.doc_id AND s.node_name = e.src JOIN linked t ON t.doc_id = e.doc_id AND t.node_name = e.tgt""",
)
def induced_subgraph(spark, sf):
    bridge = bridge_of(spark, sf)
    linked = graph.linked_entities(bridge, last_nodes(bridge))
    return graph.induced_edges(entities.last_edges(named_edges(spark, sf)), linked).select("doc_id", "src", "tgt", "weight")


@query(
    "entity_node_counts",
    f"""WITH {GRAPH}
SELECT b.doc_id, b.index_id, count(*) AS n_entities FROM bridge b JOIN linked l ON l.doc_id = b.doc_id AND l.node_name = b.node_name GROUP BY ALL""",
)
def entity_node_counts(spark, sf):
    bridge = bridge_of(spark, sf)
    return graph.node_entity_counts(bridge, graph.linked_entities(bridge, last_nodes(bridge)))


@query(
    "entity_unknown",
    f"""WITH {MENTIONS},
ends AS (
  SELECT doc_id, node_id, src_entity_name AS name FROM relations UNION SELECT doc_id, node_id, tgt_entity_name FROM relations)
SELECT e.doc_id, e.node_id, e.name FROM ends e
WHERE NOT EXISTS (SELECT 1 FROM mentions m WHERE m.doc_id = e.doc_id AND m.node_id = e.node_id
  AND 1 - levenshtein(m.entity_name, e.name) / CAST(greatest(length(m.entity_name), length(e.name)) AS DOUBLE) >= 0.9
  AND levenshtein(m.entity_name, e.name) = (SELECT min(levenshtein(k.entity_name, e.name)) FROM mentions k WHERE k.doc_id = e.doc_id AND k.node_id = e.node_id))""",
)
def entity_unknown(spark, sf):
    found = relations(spark, sf)
    ends = found.select("doc_id", "node_id", F.explode(F.array("src_entity_name", "tgt_entity_name")).alias("name"))
    return entities.unknown_endpoints(ends, mentions(spark, sf))
