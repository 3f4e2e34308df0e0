"""Content blocks from the given ``documents`` table: one block per line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspan.functions import text as T

LINES_PER_PAGE = 8
CELLS_PER_ROW = 4


def blocks_from_documents(documents: DataFrame) -> DataFrame:
    """Blocks with list position, type, level, page, captions and table markup derived from each line.

    The first line is the document title, short lines are headings, lines of ``|`` cells are tables, lines with a
    formula or address sign are equations and every eleventh line stands for a figure. Lines of at most one word are
    marked invalid.
    """
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "raw")).withColumn(
        "pos", F.col("at") + 1
    )
    kind = (
        F.when(F.contains("raw", F.lit(" | ")), "table")
        .when(F.col("pos") % 11 == 5, "image")
        .when(F.col("raw").rlike("[=@]"), "equation")
        .otherwise("text")
    )
    typed = lines.withColumn("type", kind).withColumn("n_words", T.word_count(F.col("raw")))
    is_text, is_table, is_image = (F.col("type") == t for t in ("text", "table", "image"))
    none = F.array().cast("array<string>")
    cells = F.transform(F.split("raw", r" \| "), _escape)
    return typed.select(
        "doc_id", "pos", "type",
        F.when(~is_table & ~is_image, F.col("raw")).alias("text"),
        F.when(is_text & (F.col("pos") == 1), 0)
        .when(is_text & (F.col("n_words") <= 6), 1 + F.col("n_words") % 3)
        .alias("text_level"),
        F.floor((F.col("pos") - 1) / LINES_PER_PAGE).cast("int").alias("page_idx"),
        F.when(is_image, F.concat(F.lit("images/"), F.col("doc_id").cast("string"), F.lit("_"), F.col("pos").cast("string"), F.lit(".png"))).alias("img_path"),
        F.when(is_image, F.array("raw"))
        .when(is_table & (F.col("pos") % 2 == 0), F.array(F.concat(F.lit("Table "), F.col("pos").cast("string"))))
        .otherwise(none).alias("caption"),
        F.when(is_table & (F.col("pos") % 3 == 0), F.array(F.concat(F.lit("Source "), F.col("pos").cast("string"))))
        .otherwise(none).alias("footnote"),
        F.when(is_table, _markup(cells)).alias("table_body"),
        F.when(is_table, F.least(F.lit(CELLS_PER_ROW), F.size(F.split("raw", r" \| ")))).alias("n_columns"),
        (F.col("n_words") <= 1).alias("invalid"),
    )


def _escape(text):
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def _markup(cells):
    """HTML table of an array of cells, a fixed number per row."""
    starts = F.sequence(F.lit(1), F.size(cells), F.lit(CELLS_PER_ROW))
    row = lambda i: F.concat(
        F.lit("<tr><td>"), F.array_join(F.slice(cells, i, CELLS_PER_ROW), "</td><td>"), F.lit("</td></tr>")
    )
    return F.concat(F.lit("<table>"), F.array_join(F.transform(starts, row), ""), F.lit("</table>"))


NAME_PATTERN = "[A-Z][a-z]{3,}"


def _named_lines(documents: DataFrame) -> DataFrame:
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    return lines.select(
        "doc_id", (F.col("at") + 1).alias("node_id"), F.expr(f"regexp_extract_all(raw, '{NAME_PATTERN}', 0)").alias("names")
    )


def type_of(name):
    """Entity type of a name, by its length."""
    return (
        F.when(F.length(name) % 3 == 0, "person").when(F.length(name) % 3 == 1, "organization").otherwise("geographic place")
    )


def mentions_from_documents(documents: DataFrame) -> DataFrame:
    """Capitalised words as raw entity mentions of the line they stand in."""
    return _named_lines(documents).select("doc_id", "node_id", F.posexplode("names").alias("seq", "entity_name")).select(
        "doc_id", "node_id", "seq", "entity_name", type_of(F.col("entity_name")).alias("entity_type"),
        F.concat(F.lit("named in line "), F.col("node_id").cast("string")).alias("description"),
    )


def relations_from_documents(documents: DataFrame) -> DataFrame:
    """Consecutive names of a line as raw relations; every fourth target is misspelt by a plural."""
    pairs = F.expr(
        "transform(sequence(0, greatest(size(names) - 2, 0)), i -> named_struct('src', get(names, i), 'tgt', get(names, i + 1)))"
    )
    rows = _named_lines(documents).select("doc_id", "node_id", F.posexplode(pairs).alias("seq", "pair")).filter("pair.tgt IS NOT NULL")
    return rows.select(
        "doc_id", "node_id", "seq", F.col("pair.src").alias("src_entity_name"),
        F.when(F.col("seq") % 4 == 0, F.concat("pair.tgt", F.lit("s"))).otherwise(F.col("pair.tgt")).alias("tgt_entity_name"),
        F.when(F.col("seq") % 2 == 0, "follows").otherwise("near").alias("relation_name"),
        (1 + F.col("seq") % 9).cast("double").alias("weight"),
        F.concat(F.lit("side by side in line "), F.col("node_id").cast("string")).alias("description"),
    )
