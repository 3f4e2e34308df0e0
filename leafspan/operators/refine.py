"""Block refinement: model judgements on pairs of blocks in batches, and merging of whole chains of texts and tables.

Accepted pairs link neighbours. A block that takes another may itself be taken by an earlier one, so the links form chains;
the members of a chain are found as islands over the ordered blocks and merged at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafspan.functions import tables
from leafspan.functions import text as T
from leafspan.functions.replies import parsed
from leafspan.models.base import Generator
from leafspan.operators import blocks as B
from leafspan.operators.packing import greedy_groups
from leafspan.operators.scan import ROWS_PER_SEGMENT, Running, dense_number, position_segment, prefix_scan
from leafspan.session import cut_lineage

PAIRS_PER_PROMPT = 3
TRIES = 2
PROMPT_WORDS = 4_000
PAIRS_MARKER = "Pairs:\n"
JUDGMENTS = "judgments array<struct<merged_id:long,stitched_pdf_ids:array<long>>>"

TABLE_TASK = "For each pair of tables say whether the second continues the first. merged_id is pdf_id_1 if it does and -1 if not.\n"
TEXT_TASK = "For each cut-off text list the candidates that continue it as stitched_pdf_ids, or -1 alone if none does.\n"


def pair_groups(pairs: DataFrame, budget: int = PROMPT_WORDS, most: int = PAIRS_PER_PROMPT, rows: int | None = ROWS_PER_SEGMENT) -> DataFrame:
    """Pairs ``(doc_id, pdf_id, words, ...)`` with ``nth`` and ``group``: runs of pairs that share a prompt.

    A group holds at most ``most`` pairs and stays under ``budget`` words, unless a single pair does not.
    """
    # Packing reads the sizes first and the pairs again at its end.
    numbered = cut_lineage(dense_number(pairs, ["doc_id"], "pdf_id", "nth", rows))
    return greedy_groups(numbered, ["doc_id"], "nth", "words", budget - 1, most, rows)


def pair_batches(pairs: DataFrame, budget: int = PROMPT_WORDS, most: int = PAIRS_PER_PROMPT, rows: int | None = ROWS_PER_SEGMENT) -> DataFrame:
    """``(doc_id, group, batch)``: the groups of pairs ``(doc_id, pdf_id, payload)`` as arrays in order, see :func:`pair_groups`."""
    grouped = pair_groups(pairs.withColumn("words", T.word_count(F.col("payload"))), budget, most, rows)
    return grouped.groupBy("doc_id", "group").agg(F.array_sort(F.collect_list(F.struct("nth", "pdf_id", "payload"))).alias("batch"))


def judged(
    pairs: DataFrame, task: str, generator: Generator, budget: int = PROMPT_WORDS, tries: int = TRIES, rows: int | None = ROWS_PER_SEGMENT
) -> DataFrame:
    """``(doc_id, pdf_id, judgment)`` of the pairs whose batch got as many judgements as it holds pairs.

    A batch with another number, or a reply that is no such object, is asked again up to ``tries`` times and then left out.
    """
    pending = cut_lineage(pair_batches(pairs, budget, rows=rows))
    done = None
    for _ in range(tries):
        listed = F.array_join(F.transform("batch", lambda p: p["payload"]), ",")
        prompt = F.concat(F.lit(task + PAIRS_MARKER + "["), listed, F.lit("]"))
        asked = cut_lineage(pending.withColumn("judgments", parsed(generator.complete(prompt), JUDGMENTS)["judgments"]))
        good = F.coalesce(F.size("judgments") == F.size("batch"), F.lit(False))
        told = asked.filter(good).select("doc_id", F.explode(F.arrays_zip(F.col("batch.pdf_id").alias("pdf_id"), F.col("judgments").alias("judgment"))).alias("z"))
        told = told.select("doc_id", "z.pdf_id", "z.judgment")
        done = told if done is None else done.unionByName(told)
        pending = asked.filter(~good).drop("judgments")
        if pending.isEmpty():
            break
    return done


def accepted_continuations(made: DataFrame, generator: Generator, rows: int | None = ROWS_PER_SEGMENT, budget: int = PROMPT_WORDS) -> DataFrame:
    """Continuations ``(doc_id, pdf_id, candidate_id)`` that the model takes for a cut-off paragraph."""
    found = cut_lineage(B.continuation_candidates(made, rows=rows))
    texts = made.select("doc_id", F.col("pdf_id").alias("candidate_id"), F.coalesce("text", F.lit("")).alias("text"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("candidate_id").alias("pdf_id"), "text")))
    # A search never passes two pages, which bounds the list.
    offered = found.join(texts, ["doc_id", "candidate_id"]).groupBy("doc_id", "pdf_id").agg(listed.alias("candidate_list"))
    own = made.select("doc_id", "pdf_id", F.col("text").alias("incomplete_text"))
    pairs = offered.join(own, ["doc_id", "pdf_id"]).select(
        "doc_id", "pdf_id", F.to_json(F.struct("incomplete_text", "candidate_list")).alias("payload")
    )
    told = judged(pairs, TEXT_TASK, generator, budget, rows=rows)
    chosen = told.select("doc_id", "pdf_id", F.explode("judgment.stitched_pdf_ids").alias("candidate_id"))
    return found.join(chosen.withColumn("candidate_id", F.col("candidate_id").cast("int")).distinct(), ["doc_id", "pdf_id", "candidate_id"], "left_semi")


def accepted_tables(made: DataFrame, generator: Generator, rows: int | None = ROWS_PER_SEGMENT, budget: int = PROMPT_WORDS) -> DataFrame:
    """Tables ``(doc_id, pdf_id, previous_id)`` that the model takes for the continuation of the table before."""
    found = B.previous_table(made, rows=rows)
    side = lambda name, html: made.select("doc_id", F.col("pdf_id").alias(name), F.col("table_body").alias(html), *(["caption"] if name == "previous_id" else []))
    joined = found.join(side("previous_id", "table_1_html"), ["doc_id", "previous_id"]).join(side("pdf_id", "table_2_html"), ["doc_id", "pdf_id"])
    joined = joined.filter("table_1_html <> '' AND table_2_html <> ''")
    payload = F.to_json(F.struct(F.col("previous_id").alias("pdf_id_1"), "table_1_html", "table_2_html", "caption"))
    told = judged(joined.select("doc_id", "pdf_id", payload.alias("payload")), TABLE_TASK, generator, budget, rows=rows)
    chosen = told.select("doc_id", "pdf_id", F.col("judgment.merged_id").alias("previous_id"))
    return found.join(chosen, ["doc_id", "pdf_id", "previous_id"], "left_semi")


def stitch_chains(made: DataFrame, accepted: DataFrame, rows: int | None = ROWS_PER_SEGMENT) -> DataFrame:
    """Append accepted continuations to their paragraphs, through chains of cut-off paragraphs, and mark merged texts invalid.

    A paragraph that is taken brings along what it has taken itself. Equations are appended and stay valid.
    """
    into = accepted.select("doc_id", F.col("candidate_id").alias("pdf_id"), F.lit(True).alias("taken"))
    owners = accepted.select("doc_id", "pdf_id").distinct().join(into, ["doc_id", "pdf_id"], "left")
    # Searches end at the next cut-off paragraph, so an owner can only be taken by the owner before it.
    headed = prefix_scan(
        owners, ["doc_id"], ["pdf_id"], {"head": Running("last", F.when(F.col("taken").isNull(), F.col("pdf_id")))}, position_segment("pdf_id", rows)
    )
    texts = made.select("doc_id", F.col("pdf_id").alias("candidate_id"), "text", "type")
    pieces = accepted.join(headed.select("doc_id", "pdf_id", "head"), ["doc_id", "pdf_id"]).join(texts, ["doc_id", "candidate_id"])
    own = owners.select("doc_id", F.col("pdf_id").alias("candidate_id"), F.lit(True).alias("owns"))
    pieces = cut_lineage(pieces.join(own, ["doc_id", "candidate_id"], "left"))
    ordered = F.array_sort(F.collect_list(F.struct("candidate_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("owns", F.lit(False)).alias("owns"))))
    tail = F.aggregate(F.reverse(ordered), F.lit(""), lambda after, p: F.when(
        p["owns"], B._joinable(T.strip(F.concat(B._joinable(p["text"]), after)))
    ).otherwise(F.concat(B._joinable(p["text"]), after)))
    tails = pieces.groupBy("doc_id", F.col("head").alias("pdf_id")).agg(tail.alias("__tail"))
    gone = pieces.filter(F.col("type") == "text").select("doc_id", F.col("candidate_id").alias("pdf_id"), F.lit(True).alias("__gone")).distinct()
    joined = made.join(tails, ["doc_id", "pdf_id"], "left").join(gone, ["doc_id", "pdf_id"], "left")
    text = F.when(F.col("__tail").isNotNull(), T.strip(F.concat(B._joinable(F.col("text")), F.col("__tail")))).otherwise(F.col("text"))
    return _marked(joined.withColumn("text", text).drop("__tail"))


def merge_table_chains(made: DataFrame, accepted: DataFrame, rows: int | None = ROWS_PER_SEGMENT) -> DataFrame:
    """Append the rows of accepted tables to the first table of their chain and mark them invalid."""
    tabled = made.filter("type = 'table'").select("doc_id", "pdf_id", "table_body").join(accepted, ["doc_id", "pdf_id"], "left")
    first = F.when(F.col("previous_id").isNull(), F.col("pdf_id"))
    chained = prefix_scan(tabled, ["doc_id"], ["pdf_id"], {"head": Running("last", first)}, position_segment("pdf_id", rows))
    members = chained.join(chained.filter("previous_id IS NOT NULL").select("doc_id", "head").distinct(), ["doc_id", "head"], "left_semi")
    members = cut_lineage(members.select("doc_id", "pdf_id", "head", "table_body"))
    bodies = F.transform(F.array_sort(F.collect_list(F.struct("pdf_id", "table_body"))), lambda t: t["table_body"])
    merged = members.groupBy("doc_id", F.col("head").alias("pdf_id")).agg(bodies.alias("bodies"))
    merged = merged.select("doc_id", "pdf_id", appended(F.col("bodies")).alias("__body"))
    gone = members.filter("pdf_id <> head").select("doc_id", "pdf_id", F.lit(True).alias("__gone"))
    joined = made.join(merged, ["doc_id", "pdf_id"], "left").join(gone, ["doc_id", "pdf_id"], "left")
    return _marked(joined.withColumn("table_body", F.coalesce("__body", "table_body")).drop("__body"))


def appended(bodies: Column) -> Column:
    """The first of an array of tables with the rows of the others, in order."""
    rest = F.reverse(F.slice(bodies, 2, F.greatest(F.size(bodies) - 1, F.lit(0))))
    joined = F.aggregate(F.slice(rest, 2, F.greatest(F.size(rest) - 1, F.lit(0))), F.get(rest, F.lit(0)), lambda after, body: tables.append_rows(body, after))
    return F.when(F.size(bodies) == 1, F.get(bodies, F.lit(0))).otherwise(tables.append_rows(F.get(bodies, F.lit(0)), joined))


def _marked(joined: DataFrame) -> DataFrame:
    gone = F.coalesce(F.col("invalid"), F.lit(False)) | F.coalesce(F.col("__gone"), F.lit(False))
    return joined.withColumn("invalid", gone).drop("__gone")


def refined(made: DataFrame, generator: Generator, rows: int | None = ROWS_PER_SEGMENT, budget: int = PROMPT_WORDS) -> DataFrame:
    """Repair texts, number blocks, merge cut-off paragraphs and continued tables, and number what is left."""
    numbered = cut_lineage(B.renumber(B.repair_text(made), rows))
    stitched = cut_lineage(stitch_chains(numbered, cut_lineage(accepted_continuations(numbered, generator, rows, budget)), rows))
    merged = merge_table_chains(stitched, cut_lineage(accepted_tables(stitched, generator, rows, budget)), rows)
    return B.renumber(merged.withColumn("pos", F.col("pdf_id")), rows)
