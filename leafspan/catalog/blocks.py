"""Block repair, outline and tree construction over the lines of ``documents``."""

from leafspan.catalog.base import query, table
from leafspan.functions import text as T
from leafspan.functions.text import CONNECTORS, WHITESPACE
from leafspan.models.base import OutlineJudge
from leafspan.operators import blocks, outline
from leafspan.operators.scan import segment_rows
from leafspan.session import cut_lineage
from leafspan.sources.corpus import blocks_from_documents
from pyspark.sql import functions as F

BLOCKS = rf"""
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
         CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS pos FROM documents),
typed AS (
  SELECT *, CASE WHEN contains(raw, ' | ') THEN 'table' WHEN pos % 11 = 5 THEN 'image'
                 WHEN contains(raw, '=') OR contains(raw, '@') THEN 'equation' ELSE 'text' END AS type,
         CAST(len(list_filter(regexp_split_to_array(raw, '{WHITESPACE}+'), lambda x: x <> '')) AS INTEGER) AS n_words,
         string_split(raw, ' | ') AS cells
  FROM lines),
blocks AS (
  SELECT doc_id, pos, type, CASE WHEN type IN ('text', 'equation') THEN raw END AS text,
         CASE WHEN type = 'text' AND pos = 1 THEN 0 WHEN type = 'text' AND n_words <= 6 THEN 1 + n_words % 3 END AS text_level,
         CAST((pos - 1) // 8 AS INTEGER) AS page_idx,
         CASE WHEN type = 'image' THEN 'images/' || doc_id || '_' || pos || '.png' END AS img_path,
         CASE WHEN type = 'image' THEN raw WHEN type = 'table' AND pos % 2 = 0 THEN 'Table ' || pos ELSE '' END AS caption,
         CASE WHEN type = 'table' AND pos % 3 = 0 THEN 'Source ' || pos ELSE '' END AS footnote,
         CASE WHEN type = 'table' THEN '<table>' || list_aggregate(list_transform(range(0, len(cells), 4), lambda i:
           '<tr><td>' || list_aggregate(list_transform(cells[i + 1:i + 4], lambda c:
             replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')), 'string_agg', '</td><td>') || '</td></tr>'),
           'string_agg', '') || '</table>' END AS table_body,
         CASE WHEN type = 'table' THEN least(4, len(cells)) END AS n_columns,
         n_words <= 1 AS invalid
  FROM typed)
"""

NUMBERED = f"""{BLOCKS},
numbered AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS pdf_id
  FROM blocks WHERE NOT invalid)
"""


def segment_length(spark, sf):
    """Segment length for per-document scans, from the longest document."""
    longest = table(spark, sf, "documents").agg(F.max(F.size(F.split("text", "\n")))).first()[0]
    return segment_rows(longest)


def numbered(spark, sf, rows=-1):
    """Numbered blocks; callers that know the segment length pass it."""
    made = blocks_from_documents(table(spark, sf, "documents", spread=True))
    return blocks.renumber(made, segment_length(spark, sf) if rows == -1 else rows)


@query(
    "blocks_construct",
    f"""WITH {BLOCKS} SELECT doc_id, pos, type, text, text_level, page_idx, img_path, caption, footnote, table_body,
 CAST(n_columns AS INTEGER) AS n_columns, invalid FROM blocks""",
)
def blocks_construct(spark, sf):
    made = blocks_from_documents(table(spark, sf, "documents", spread=True))
    return made.withColumn("caption", F.array_join("caption", "")).withColumn("footnote", F.array_join("footnote", ""))


@query("blocks_renumber", f"WITH {NUMBERED} SELECT doc_id, pos, pdf_id, type FROM numbered")
def blocks_renumber(spark, sf):
    return numbered(spark, sf).select("doc_id", "pos", "pdf_id", "type")


@query(
    "blocks_dash_repair",
    f"WITH lines AS (SELECT doc_id, regexp_replace(text, '-{WHITESPACE}+', '-', 'g') AS text FROM documents) SELECT doc_id, text, CAST(length(text) AS INTEGER) AS n_chars FROM lines",
)
def blocks_dash_repair(spark, sf):
    docs = table(spark, sf, "documents", spread=True)
    return docs.select("doc_id", T.repair_dashes(F.col("text")).alias("text")).withColumn("n_chars", F.length("text"))


@query(
    "blocks_garbage_cut",
    f"""WITH split AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{WHITESPACE}+'), lambda x: x <> '') AS w FROM documents),
found AS (
  SELECT *, list_filter(range(1, len(w) - 13), lambda i:
    len(list_filter(w[i:i + 14], lambda x: length(x) = 1)) >= 14)[1] AS first FROM split)
SELECT doc_id, CASE WHEN first IS NULL THEN text WHEN first = 1 THEN ''
  ELSE list_aggregate(w[1:first - 1], 'string_agg', ' ') END AS text FROM found""",
)
def blocks_garbage_cut(spark, sf):
    docs = table(spark, sf, "documents", spread=True)
    return docs.select("doc_id", T.cut_garbage_tail(F.col("text")).alias("text"))


CONNECTOR_LIST = ", ".join(f"'{w}'" for w in CONNECTORS)
INCOMPLETE = f"""{NUMBERED},
trimmed AS (SELECT *, regexp_replace(coalesce(text, ''), '^{WHITESPACE}+|{WHITESPACE}+$', '', 'g') AS body FROM numbered),
unquoted AS (SELECT *, regexp_replace(body, '[''"]+$', '') AS bare FROM trimmed),
flagged AS (
  SELECT *, type = 'text' AND text_level IS NULL AND length(body) >= 25
    AND len(list_filter(regexp_split_to_array(body, '{WHITESPACE}+'), lambda x: x <> '')) >= 5
    AND (body LIKE '%-' OR regexp_matches(bare, '[,:;]$') OR NOT regexp_matches(bare, '[.!?]$')
         OR lower(regexp_extract(bare, '([0-9A-Za-z_]+)[^0-9A-Za-z_]*$', 1)) IN ({CONNECTOR_LIST})) AS incomplete
  FROM unquoted)"""


@query("blocks_incomplete", f"WITH {INCOMPLETE} SELECT doc_id, pdf_id, incomplete FROM flagged")
def blocks_incomplete(spark, sf):
    return blocks.mark_incomplete(numbered(spark, sf)).select("doc_id", "pdf_id", "incomplete")


# The search walks forward from an incomplete paragraph and may stop at any block, so it is a recursion.
CANDIDATES = f"""{INCOMPLETE},
kinds AS (
  SELECT doc_id, pdf_id, page_idx, incomplete,
    CASE WHEN type IN ('table', 'image') OR text_level IS NOT NULL THEN 'skip' WHEN type = 'equation' THEN 'take'
         WHEN length(body) < 3 THEN 'skip'
         WHEN lower(body[1]) <> upper(body[1]) AND body[1] = lower(body[1]) THEN 'take'
         WHEN length(head) > 1 AND head = upper(head) AND head <> lower(head) THEN 'take'
         WHEN lower(body[1]) <> upper(body[1]) THEN 'capital' ELSE 'stop' END AS kind
  FROM (SELECT *, list_filter(regexp_split_to_array(body, '{WHITESPACE}+'), lambda x: x <> '')[1] AS head FROM flagged)),
walk AS (
  SELECT doc_id, pdf_id AS start, page_idx AS start_page, pdf_id AS at, FALSE AS taken, 0 AS n, FALSE AS done, FALSE AS capital
  FROM kinds WHERE incomplete
  UNION ALL
  SELECT w.doc_id, w.start, w.start_page, k.pdf_id,
    k.kind = 'take' OR (k.kind = 'capital' AND w.n = 0 AND NOT w.capital),
    w.n + CASE WHEN k.kind = 'take' OR (k.kind = 'capital' AND w.n = 0 AND NOT w.capital) THEN 1 ELSE 0 END,
    k.incomplete, w.capital OR k.kind = 'capital'
  FROM walk w JOIN kinds k ON k.doc_id = w.doc_id AND k.pdf_id = w.at + 1
  WHERE NOT w.done AND k.page_idx <= w.start_page + 2 AND k.kind <> 'stop'
    AND NOT (k.kind = 'capital' AND (w.n > 0 OR w.capital)))"""


@query(
    "blocks_continuations",
    f"WITH RECURSIVE {CANDIDATES} SELECT w.doc_id, w.start AS pdf_id, w.at AS candidate_id FROM walk w WHERE taken",
)
def blocks_continuations(spark, sf):
    return blocks.continuation_candidates(numbered(spark, sf), rows=segment_length(spark, sf))


@query(
    "blocks_stitch",
    f"""WITH RECURSIVE {CANDIDATES},
tails AS (
  SELECT w.doc_id, w.start AS pdf_id, string_agg(CASE WHEN n.text LIKE '%-' THEN n.text[:-2] ELSE n.text || ' ' END, '' ORDER BY w.at) AS tail
  FROM walk w JOIN numbered n ON n.doc_id = w.doc_id AND n.pdf_id = w.at WHERE w.taken GROUP BY ALL),
gone AS (SELECT DISTINCT w.doc_id, w.at AS pdf_id FROM walk w JOIN numbered n ON n.doc_id = w.doc_id AND n.pdf_id = w.at WHERE w.taken AND n.type = 'text')
SELECT n.doc_id, n.pdf_id,
  CASE WHEN t.tail IS NULL THEN n.text ELSE regexp_replace(
    (CASE WHEN n.text LIKE '%-' THEN n.text[:-2] ELSE n.text || ' ' END) || t.tail, '^{WHITESPACE}+|{WHITESPACE}+$', '', 'g') END AS text,
  g.pdf_id IS NOT NULL AS invalid
FROM numbered n LEFT JOIN tails t ON t.doc_id = n.doc_id AND t.pdf_id = n.pdf_id
LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.pdf_id = n.pdf_id""",
)
def blocks_stitch(spark, sf):
    rows = segment_length(spark, sf)
    # Read by the search, for the texts of the candidates and for the result.
    made = cut_lineage(numbered(spark, sf, rows).select("doc_id", "pdf_id", "type", "text", "text_level", "page_idx", "invalid"))
    found = blocks.continuation_candidates(made, rows=rows)
    return blocks.stitch(made, found).select("doc_id", "pdf_id", "text", "invalid")


@query(
    "blocks_previous_table",
    f"""WITH {NUMBERED},
tables AS (
  SELECT *, lag(pdf_id) OVER w AS previous_id, lag(page_idx) OVER w AS previous_page, lag(n_columns) OVER w AS previous_columns
  FROM numbered WHERE type = 'table' WINDOW w AS (PARTITION BY doc_id ORDER BY pdf_id))
SELECT doc_id, pdf_id, previous_id FROM tables
WHERE caption = '' AND footnote = '' AND page_idx > 0 AND previous_page = page_idx - 1 AND previous_columns = n_columns""",
)
def blocks_previous_table(spark, sf):
    return blocks.previous_table(numbered(spark, sf), rows=segment_length(spark, sf))


OUTLINE = f"""{NUMBERED},
heads AS (SELECT doc_id, pdf_id, text_level, text FROM numbered WHERE text_level IS NOT NULL),
parented AS (
  SELECT h.doc_id, h.pdf_id, h.text_level, coalesce(max(p.pdf_id), 0) AS parent_id
  FROM heads h LEFT JOIN heads p ON p.doc_id = h.doc_id AND p.pdf_id < h.pdf_id AND p.text_level < h.text_level
  GROUP BY ALL),
tops AS (
  SELECT doc_id, min(pdf_id) AS first_id, min(CASE WHEN text_level = 0 THEN pdf_id END) AS top_id FROM parented GROUP BY doc_id),
leveled AS (
  SELECT doc_id, pdf_id, CASE WHEN top_id IS NULL AND pdf_id = first_id THEN 0 ELSE text_level END AS text_level, parent_id,
         coalesce(top_id, first_id) AS top FROM parented JOIN tops USING (doc_id)),
outline AS (
  SELECT doc_id, pdf_id, text_level, CASE WHEN text_level <> 0 AND parent_id = 0 THEN top ELSE parent_id END AS parent_id FROM leveled)
"""


def outline_of(made, rows):
    return outline.repair(outline.parents_by_level(outline.titles(made), rows)).select("doc_id", "pdf_id", "text_level", "parent_id", "text")


@query("outline_parents", f"WITH {OUTLINE} SELECT doc_id, pdf_id, text_level, parent_id FROM parented")
def outline_parents(spark, sf):
    return outline.parents_by_level(outline.titles(numbered(spark, sf)), segment_length(spark, sf)).select("doc_id", "pdf_id", "text_level", "parent_id")


@query(
    "outline_judged",
    f"""WITH {OUTLINE},
told AS (
  SELECT p.* FROM parented p JOIN heads h ON h.doc_id = p.doc_id AND h.pdf_id = p.pdf_id
  WHERE len(list_filter(regexp_split_to_array(h.text, '{WHITESPACE}+'), lambda x: x <> '')) BETWEEN 3 AND 1999),
firsts AS (
  SELECT doc_id, min(pdf_id) AS first_id, min(CASE WHEN text_level = 0 THEN pdf_id END) AS top_id FROM told GROUP BY doc_id),
placed AS (
  SELECT t.doc_id, t.pdf_id, CASE WHEN top_id IS NULL AND t.pdf_id = first_id THEN 0 ELSE text_level END AS text_level, parent_id, coalesce(top_id, first_id) AS top
  FROM told t JOIN firsts f ON f.doc_id = t.doc_id)
SELECT doc_id, pdf_id, text_level, CASE WHEN text_level <> 0 AND parent_id = 0 THEN top ELSE parent_id END AS parent_id FROM placed""",
)
def outline_judged(spark, sf):
    rows = segment_length(spark, sf)
    # Read for the levels present and for the parents.
    heads = cut_lineage(outline.titles(numbered(spark, sf)).select("doc_id", "pdf_id", "text", "text_level"))
    found = outline.parents_by_level(heads, rows)
    return outline.judge_in_rounds(found, OutlineJudge(), rows=rows).select("doc_id", "pdf_id", "text_level", "parent_id")


@query("outline_repair", f"WITH {OUTLINE} SELECT doc_id, pdf_id, text_level, parent_id FROM outline")
def outline_repair(spark, sf):
    return outline_of(numbered(spark, sf), segment_length(spark, sf)).drop("text")


@query(
    "outline_ranges",
    f"""WITH {OUTLINE}
SELECT o.doc_id, o.pdf_id, CAST(coalesce(lead(o.pdf_id) OVER (PARTITION BY o.doc_id ORDER BY o.pdf_id), n + 1) AS INTEGER) AS end_id
FROM outline o JOIN (SELECT doc_id, count(*) AS n FROM numbered GROUP BY doc_id) c ON c.doc_id = o.doc_id""",
)
def outline_ranges(spark, sf):
    made, rows = numbered(spark, sf), segment_length(spark, sf)
    counts = made.groupBy("doc_id").agg(F.count("*").alias("n_blocks"))
    return outline.ranges(outline_of(made, rows), counts, rows).select("doc_id", "pdf_id", "end_id")


@query(
    "outline_assign",
    f"""WITH {OUTLINE}
SELECT n.doc_id, n.pdf_id, max(o.pdf_id) AS title_id FROM numbered n
LEFT JOIN outline o ON o.doc_id = n.doc_id AND o.pdf_id <= n.pdf_id GROUP BY ALL""",
)
def outline_assign(spark, sf):
    made, rows = numbered(spark, sf), segment_length(spark, sf)
    return outline.assign_blocks(made, outline_of(made, rows), rows).select("doc_id", "pdf_id", "title_id")


@query(
    "outline_levels",
    f"WITH {OUTLINE} SELECT doc_id, count(*) AS n_titles, max(text_level) AS max_level FROM outline GROUP BY doc_id",
)
def outline_levels(spark, sf):
    return outline.level_summary(outline_of(numbered(spark, sf), segment_length(spark, sf)))


@query(
    "outline_context",
    f"""WITH {OUTLINE},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, text_level ORDER BY pdf_id) AS up,
         row_number() OVER (PARTITION BY doc_id, text_level ORDER BY pdf_id DESC) AS down,
         row_number() OVER (PARTITION BY doc_id ORDER BY pdf_id DESC) AS tail,
         max(CASE WHEN text_level = 1 THEN pdf_id END) OVER (PARTITION BY doc_id) AS last_one FROM outline)
SELECT doc_id, pdf_id, text_level FROM ranked
WHERE text_level = 0 OR (text_level = 1 AND (up <= 3 OR down <= 5)) OR (tail <= 5 AND (last_one IS NULL OR pdf_id >= last_one))""",
)
def outline_context(spark, sf):
    return outline.chunk_context(outline_of(numbered(spark, sf), segment_length(spark, sf)))


@query(
    "outline_line_height",
    f"""WITH {NUMBERED},
boxed AS (
  SELECT doc_id, pdf_id, text, CAST(60 + pdf_id % 400 AS DOUBLE) AS width, CAST(8 + (pdf_id * 7) % 90 AS DOUBLE) AS height,
         length(text) AS chars FROM numbered WHERE type = 'text'),
lined AS (
  SELECT *, CASE WHEN width / height > 15 THEN 1.0 ELSE round_even(greatest(1.0, sqrt(chars * height / width * 0.5)), 0) END AS line_count FROM boxed)
SELECT doc_id, pdf_id, round(height / line_count, 6) AS line_height FROM lined""",
)
def outline_line_height(spark, sf):
    made = numbered(spark, sf).filter("type = 'text'")
    zero = F.lit(0.0)
    box = F.array(zero, zero, (60 + F.col("pdf_id") % 400).cast("double"), (8 + (F.col("pdf_id") * 7) % 90).cast("double"))
    return made.select("doc_id", "pdf_id", F.round(outline.effective_height(box, F.col("text")), 6).alias("line_height"))
