"""Readers for question sets, parser outputs, document files and markdown text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_questions(spark: SparkSession, path: str, schema: StructType | str, lines: bool = False) -> DataFrame:
    """A question set as one JSON array per file, or one record per line."""
    return spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path)


def read_block_lists(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """Every block list of a folder, one JSON array per document, with list positions and the file stem as ``doc_id``.

    The whole array is parsed as one value so that list order survives.
    """
    files = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(folder)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    item = schema.simpleString() if isinstance(schema, StructType) else schema
    parsed = files.select(stem.alias("doc_id"), F.from_json("value", f"array<{item}>").alias("blocks"))
    return parsed.select("doc_id", F.posexplode("blocks").alias("at", "block")).select(
        "doc_id", (F.col("at") + 1).alias("pos"), "block.*"
    )


def pending_files(spark: SparkSession, folder: str, done: DataFrame, pattern: str = "*.pdf") -> DataFrame:
    """Document files ``(doc_id, path, length, content)`` that have not been parsed yet."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    named = files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("doc_id"), "path", "length", "content")
    return named.join(done.select("doc_id"), "doc_id", "left_anti")


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """One row per markdown file of a folder."""
    files = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").text(folder)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1).alias("doc_id"), F.col("value").alias("text"))


# Fixed value: the DNS namespace of name-based identifiers.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def name_based_uuid(name: Column) -> Column:
    """Version 5 identifier of a name in the DNS namespace, in JVM code."""
    digest = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128))
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(F.lower(F.hex(variant)), F.substring(digest, 19, 2)), F.substring(digest, 21, 12),
    )


def is_slide_deck(width: Column, height: Column, words_per_page: Column, pages: Column) -> Column:
    """Landscape pages, or several pages with little text."""
    return (width / height > 1.1) | ((words_per_page < 200) & (pages > 2))
