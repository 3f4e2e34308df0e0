"""Text functions over ``documents``, usage ledgers over ``events`` and question-set operators over ``orders``."""

from leafspan.catalog.base import query, table
from leafspan.functions import chunks
from leafspan.functions import text as T
from leafspan.functions.text import WHITESPACE
from leafspan.operators import ledger
from leafspan.operators.scan import Running, prefix_scan, quantile_segment
from pyspark.sql import functions as F

WORDS = f"w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{WHITESPACE}+'), lambda x: x <> '') AS w FROM documents)"


def documents(spark, sf):
    return table(spark, sf, "documents", spread=True)


@query(
    "text_truncate",
    f"""WITH {WORDS} SELECT doc_id, CASE WHEN len(w) > 100 THEN list_aggregate(w[1:100], 'string_agg', ' ') ELSE text END AS short,
  CASE WHEN len(w) > 50 THEN list_aggregate(w[1:50], 'string_agg', ' ') || '...' ELSE text END AS preview,
  CAST(len(w) AS INTEGER) AS n_tokens, greatest(4096 - CAST(len(w) AS INTEGER) - 3, 0) AS tokens_left FROM w""",
)
def text_truncate(spark, sf):
    body = F.col("text")
    return documents(spark, sf).select(
        "doc_id", T.truncate_words(body, 100).alias("short"), T.preview(body, 50).alias("preview"),
        T.word_count(body).alias("n_tokens"), F.greatest(4096 - T.word_count(body) - 3, F.lit(0)).alias("tokens_left"),
    )


@query(
    "text_clip",
    f"""WITH {WORDS}, c AS (SELECT doc_id, CASE WHEN len(w) > 1000 THEN list_aggregate(w[1:1000], 'string_agg', ' ') || '...' ELSE text END AS t FROM w)
SELECT doc_id, CASE WHEN length(t) > 10000 THEN t[1:10000] || '...' ELSE t END AS clipped FROM c""",
)
def text_clip(spark, sf):
    return documents(spark, sf).select("doc_id", T.clip(F.col("text")).alias("clipped"))


@query(
    "text_clean_record",
    r"""SELECT page_id, trim(regexp_replace(lower(regexp_replace(
  replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '^\s+|\s+$', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'),
  '[\x00-\x1f\x7f-\x{9f}]', '', 'g')), '[^A-Za-z0-9 ]', ' ', 'g')) AS cleaned FROM pages""",
)
def text_clean_record(spark, sf):
    return table(spark, sf, "pages", spread=True).select("page_id", T.clean_record_field(F.col("html")).alias("cleaned"))


@query(
    "text_split_markers",
    f"""SELECT doc_id, CAST(len(p) AS INTEGER) AS n_parts, p[1] AS first_part FROM (
  SELECT doc_id, list_filter(list_transform(string_split(replace(replace(text, ' | ', chr(1)), chr(10), chr(1)), chr(1)),
    lambda x: regexp_replace(x, '^{WHITESPACE}+|{WHITESPACE}+$', '', 'g')), lambda x: x <> '') AS p FROM documents)""",
)
def text_split_markers(spark, sf):
    made = documents(spark, sf).select("doc_id", T.split_markers(F.col("text"), [" | ", "\n"]).alias("p"))
    return made.select("doc_id", F.size("p").alias("n_parts"), F.get("p", F.lit(0)).alias("first_part"))


# Sentences end at . ! or ? before whitespace; a marker takes the place of a look-behind.
CHUNKS = f"""WITH RECURSIVE sentences AS (
  SELECT doc_id, i, s, CAST(len(list_filter(regexp_split_to_array(s, '{WHITESPACE}+'), lambda x: x <> '')) AS INTEGER) AS n FROM (
    SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (
      SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '^{WHITESPACE}+|{WHITESPACE}+$', '', 'g'),
        '([.!?]){WHITESPACE}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS p FROM documents))),
long_words AS (
  SELECT doc_id, i, list_filter(regexp_split_to_array(s, '{WHITESPACE}+'), lambda x: x <> '') AS w FROM sentences WHERE n > 60),
long_parts AS (
  SELECT doc_id, i, unnest(range(0, CAST(ceil(len(w) / 60.0) AS BIGINT))) AS j, w FROM long_words),
units AS (
  SELECT doc_id, i, 0 AS j, s, n, FALSE AS long FROM sentences WHERE n <= 60 UNION ALL
  SELECT doc_id, i, j, list_aggregate(w[j * 60 + 1:j * 60 + 60], 'string_agg', ' '), 60, TRUE FROM long_parts),
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS place FROM units),
packed AS (
  SELECT doc_id, place, s, n, 1 AS chunk, n AS used, long FROM ordered WHERE place = 1
  UNION ALL
  SELECT o.doc_id, o.place, o.s, o.n, p.chunk + CASE WHEN o.long OR p.long OR p.used + o.n > 60 THEN 1 ELSE 0 END,
    CASE WHEN o.long OR p.long OR p.used + o.n > 60 THEN o.n ELSE p.used + o.n END, o.long
  FROM packed p JOIN ordered o ON o.doc_id = p.doc_id AND o.place = p.place + 1)"""


@query(
    "chunk_pack",
    f"{CHUNKS} SELECT doc_id, CAST(chunk - 1 AS INTEGER) AS chunk_id, string_agg(s, ' ' ORDER BY place) AS chunk FROM packed GROUP BY doc_id, chunk",
)
def chunk_pack(spark, sf):
    made = documents(spark, sf).select("doc_id", chunks.chunks(60)(F.col("text")).alias("parts"))
    return made.select("doc_id", F.posexplode("parts").alias("chunk_id", "chunk"))


@query(
    "pack_groups",
    f"""{CHUNKS.replace("WHERE n > 60", "WHERE FALSE").replace("WHERE n <= 60", "WHERE TRUE")} SELECT doc_id, CAST(place - 1 AS INTEGER) AS sentence_id, n AS size, CAST(chunk - 1 AS INTEGER) AS batch FROM packed""",
)
def pack_groups(spark, sf):
    parts = F.split(F.regexp_replace(T.strip(F.col("text")), f"([.!?]){T.WHITESPACE}+", "$1\u0001"), "\u0001")
    sizes = F.transform(F.array_remove(parts, ""), T.word_count)
    made = documents(spark, sf).select("doc_id", sizes.alias("sizes")).withColumn("batches", chunks.pack_groups("sizes", 60))
    zipped = F.posexplode(F.arrays_zip("sizes", "batches")).alias("sentence_id", "z")
    return made.select("doc_id", zipped).select("doc_id", "sentence_id", F.col("z.sizes").alias("size"), F.col("z.batches").alias("batch"))


@query(
    "ledger_totals",
    "SELECT event_type, round(sum(coalesce(value, 0)), 4) AS value, count(*) AS calls FROM events GROUP BY event_type",
)
def ledger_totals(spark, sf):
    usage = table(spark, sf, "events").withColumn("calls", F.lit(1).cast("bigint"))
    return ledger.totals(usage, ["value", "calls"], ["event_type"]).withColumn("value", F.round("value", 4))


RUNNING = "running AS (SELECT event_id, user_id, sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS total FROM events)"


@query(
    "ledger_stage_deltas",
    f"WITH {RUNNING} SELECT event_id, user_id, CAST(total - coalesce(lag(total) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS BIGINT) AS delta FROM running",
)
def ledger_stage_deltas(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id")
    segment = quantile_segment(events, "event_id")
    running = {"total": Running("sum", F.col("event_id"))}
    snapshots = prefix_scan(events, ["user_id"], ["event_id"], running, segment)
    return ledger.stage_deltas(snapshots, "user_id", "event_id", "total", segment).select("event_id", "user_id", "delta")


@query(
    "ledger_merge_runs",
    """SELECT user_id, event_type, arg_min(value, event_id) AS seconds,
  arg_max(CAST(json_extract(props, '$.k') AS BIGINT), event_id) FILTER (CAST(json_extract(props, '$.k') AS BIGINT) <> 0) AS tokens
FROM events GROUP BY user_id, event_type""",
)
def ledger_merge_runs(spark, sf):
    entries = table(spark, sf, "events").select(
        "user_id", "event_type", "event_id", F.col("value").alias("seconds"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens"),
    )
    return ledger.merge_runs(entries, ["user_id", "event_type"], "event_id", "seconds", "tokens")


@query(
    "ledger_accumulate",
    """SELECT user_id, round(sum(value), 4) AS value FROM events GROUP BY user_id""",
)
def ledger_accumulate(spark, sf):
    usage = table(spark, sf, "events").select("user_id", "event_type", "value")
    added = ledger.accumulate(usage.filter("event_type = 'click'"), usage.filter("event_type <> 'click'"), ["user_id"], ["value"])
    return added.withColumn("value", F.round("value", 4))


@query(
    "dedup_first",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth FROM orders) WHERE nth = 1""",
)
def dedup_first(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return ledger.keep_first(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("value_counts", "SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS n_units FROM orders GROUP BY ALL")
def value_counts(spark, sf):
    return ledger.value_counts(table(spark, sf, "orders"), "o_orderpriority", "o_custkey")


@query("questions_per_document", "SELECT conv_id, role, count(*) AS n_questions FROM conversations GROUP BY ALL")
def questions_per_document(spark, sf):
    return ledger.questions_per_document(table(spark, sf, "conversations"), ["conv_id", "role"])


@query(
    "shard_assign",
    """SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // CAST(ceil((SELECT count(*) FROM documents) / 7.0) AS BIGINT) + 1 AS INTEGER) AS shard FROM documents""",
)
def shard_assign(spark, sf):
    return ledger.assign_shards(table(spark, sf, "documents"), "doc_id", 7)


@query("sample_by_hash")
def sample_by_hash(spark, sf):
    return ledger.sample_by_hash(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 200)


@query(
    "json_projection",
    """SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS record FROM orders""",
)
def json_projection(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.to_json(F.struct("o_orderkey", "o_orderstatus")).alias("record"))
