"""Content blocks: construction, repair and numbering.

A block table holds one row per content block with ``doc_id`` and a dense 1-based ``pos`` that keeps list order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspan.functions import text as T
from leafspan.operators.scan import ROWS_PER_SEGMENT, Running, dense_number, position_segment, prefix_scan
from leafspan.session import cut_lineage

MAX_PAGE_GAP = 2


def merge_parser_outputs(middle: DataFrame, content: DataFrame, image_root: str) -> DataFrame:
    """Join the layout list and the content list of a parsed file by document and position.

    Documents whose lists differ in length are an input error and fail the job.
    """
    joined = middle.join(content, ["doc_id", "pos"], "full")
    complete = F.col("middle_json").isNotNull() & F.col("type").isNotNull()
    path = F.when(F.col("img_path") != "", F.concat(F.lit(image_root.rstrip("/") + "/"), F.col("img_path")))
    return joined.withColumn(
        "img_path",
        F.when(complete, path).otherwise(
            F.raise_error(F.concat(F.lit("parser outputs differ in length for document "), F.col("doc_id").cast("string")))
        ),
    )


def renumber(blocks: DataFrame, rows: int | None = ROWS_PER_SEGMENT) -> DataFrame:
    """Drop invalid blocks and number the rest 1..n per document as ``pdf_id``."""
    kept = blocks.filter(~F.coalesce(F.col("invalid"), F.lit(False)))
    return dense_number(kept.drop("pdf_id"), ["doc_id"], "pos", "pdf_id", rows)


def repair_text(blocks: DataFrame) -> DataFrame:
    """Undo line-break dashes and cut trailing recognition garbage in text blocks."""
    repaired = T.cut_garbage_tail(T.repair_dashes(F.col("text")))
    return blocks.withColumn("text", F.when(F.col("type") == "text", repaired).otherwise(F.col("text")))


def mark_incomplete(blocks: DataFrame) -> DataFrame:
    """Flag body paragraphs that seem cut off."""
    body = (F.col("type") == "text") & F.col("text_level").isNull()
    return blocks.withColumn("incomplete", F.coalesce(body & T.looks_incomplete(F.col("text")), F.lit(False)))


def continuation_candidates(
    blocks: DataFrame, max_page_gap: int = MAX_PAGE_GAP, rows: int | None = ROWS_PER_SEGMENT
) -> DataFrame:
    """Blocks that may continue an incomplete paragraph, as ``(doc_id, pdf_id, candidate_id)``.

    The search runs from an incomplete paragraph to the next one. Tables, images, titles and very short texts are
    passed over; equations and texts opening in lower case or with an acronym are taken; the first text opening with
    a capital is taken only when nothing was taken before it; any other text, or a block more than ``max_page_gap``
    pages on, ends the search. Stop and take rules depend on earlier blocks only through counts, so they become
    running sums over the span that starts at the incomplete paragraph.
    """
    text = T.strip(F.coalesce(F.col("text"), F.lit("")))
    first = F.substring(text, 1, 1)
    cased = F.lower(first) != F.upper(first)
    passed = F.col("type").isin("table", "image") | F.col("text_level").isNotNull()
    equation = F.col("type") == "equation"
    short = ~passed & ~equation & (F.length(text) < 3)
    open_ = ~passed & ~equation & ~short
    joining = open_ & ((cased & (first == F.lower(first))) | T.first_word_is_acronym(text))
    kind = (
        F.when(passed | short, "skip").when(equation | joining, "take").when(cased, "capital").otherwise("stop")
    )
    marked = mark_incomplete(blocks).select("doc_id", "pdf_id", "page_idx", "incomplete", kind.alias("kind"))

    # Every block belongs to the span of the nearest incomplete paragraph before it; a span includes the next
    # incomplete paragraph.
    owner = prefix_scan(
        marked, ["doc_id"], ["pdf_id"],
        {
            "owner": Running("last", F.when(F.col("incomplete"), F.col("pdf_id")), inclusive=False),
            "owner_page": Running("last", F.when(F.col("incomplete"), F.col("page_idx")), inclusive=False),
        },
        position_segment("pdf_id", rows),
    ).filter(F.col("owner").isNotNull())
    far = F.col("page_idx") > F.col("owner_page") + max_page_gap
    counted = prefix_scan(
        owner.withColumn("far", far), ["doc_id", "owner"], ["pdf_id"],
        {
            "taken": Running("sum", F.when(F.col("kind") == "take", 1).otherwise(0), inclusive=False),
            "capitals": Running("sum", F.when(F.col("kind") == "capital", 1).otherwise(0), inclusive=False),
            "stops": Running("sum", F.when(F.col("far") | (F.col("kind") == "stop"), 1).otherwise(0)),
        },
        position_segment("pdf_id", rows),
    )
    taken, capitals = F.coalesce(F.col("taken"), F.lit(0)), F.coalesce(F.col("capitals"), F.lit(0))
    # A capital ends the search unless it is the first one and nothing was taken so far.
    fatal = F.when((F.col("kind") == "capital") & ((capitals > 0) | (taken > 0)), 1).otherwise(0)
    ended = prefix_scan(
        counted.withColumn("fatal", fatal), ["doc_id", "owner"], ["pdf_id"],
        {"ended": Running("sum", F.col("fatal"))}, position_segment("pdf_id", rows),
    )
    return ended.filter(
        (F.col("stops") == 0) & (F.col("ended") == 0) & F.col("kind").isin("take", "capital")
    ).select("doc_id", F.col("owner").alias("pdf_id"), F.col("pdf_id").alias("candidate_id"))


def stitch(blocks: DataFrame, accepted: DataFrame) -> DataFrame:
    """Append accepted continuations to their paragraph and mark merged text blocks invalid.

    ``accepted`` is ``(doc_id, pdf_id, candidate_id)``. A trailing dash is dropped and joins without a blank.
    Continuations never pass two pages, which bounds the list gathered per paragraph.
    """
    texts = blocks.select("doc_id", F.col("pdf_id").alias("candidate_id"), "text", "type")
    # Read for the tails and for the merged blocks.
    pieces = cut_lineage(accepted.join(texts, ["doc_id", "candidate_id"]).select(
        "doc_id", "pdf_id", "candidate_id", "type", _joinable(F.col("text")).alias("piece")
    ))
    tails = pieces.groupBy("doc_id", "pdf_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("candidate_id", "piece"))), lambda s: s.piece), ""
        ).alias("tail")
    )
    merged = pieces.filter(F.col("type") == "text").select("doc_id", F.col("candidate_id").alias("pdf_id")).distinct()
    head = _joinable(F.col("text"))
    return (
        blocks.join(tails, ["doc_id", "pdf_id"], "left")
        .withColumn("text", F.when(F.col("tail").isNotNull(), T.strip(F.concat(head, F.col("tail")))).otherwise(F.col("text")))
        .drop("tail")
        .join(merged.withColumn("merged", F.lit(True)), ["doc_id", "pdf_id"], "left")
        .withColumn("invalid", F.coalesce(F.col("invalid"), F.lit(False)) | F.coalesce(F.col("merged"), F.lit(False)))
        .drop("merged")
    )


def _joinable(text):
    """A text ready for another to follow: a trailing dash goes, otherwise a blank is added."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.endswith("-"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(
        F.concat(text, F.lit(" "))
    )


def previous_table(blocks: DataFrame, columns: str = "n_columns", rows: int | None = ROWS_PER_SEGMENT) -> DataFrame:
    """Pairs ``(doc_id, pdf_id, previous_id)`` of a table without caption and footnote and the table it may continue.

    The nearest earlier table must sit on the page before and have the same number of columns.
    """
    is_table = F.col("type") == "table"
    nearest = F.struct("pdf_id", "page_idx", columns)
    # A page that goes missing or lies too far back between the two tables ends the search.
    bad_page = F.when(F.col("page_idx") < 0, F.col("pdf_id"))
    scanned = prefix_scan(
        blocks, ["doc_id"], ["pdf_id"],
        {
            "__table": Running("last", F.when(is_table, nearest), inclusive=False),
            "__bad": Running("last", bad_page, inclusive=False),
        },
        position_segment("pdf_id", rows),
    )
    bare = (
        is_table
        & (F.coalesce(F.size("caption"), F.lit(0)) <= 0)
        & (F.coalesce(F.size("footnote"), F.lit(0)) <= 0)
    )
    before = F.col("__table")
    return scanned.filter(
        bare
        & (F.col("page_idx") > 0)
        & (before["page_idx"] == F.col("page_idx") - 1)
        & (before[columns] == F.col(columns))
        & (F.col(columns) > 0)
        & (F.col("__bad").isNull() | (F.col("__bad") < before["pdf_id"]))
    ).select("doc_id", "pdf_id", before["pdf_id"].alias("previous_id"))
