"""Records in extraction replies and chat message lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafspan.functions import text as T

# Delimiters of extraction replies.
FIELD_DELIMITER = "<|>"
RECORD_DELIMITER = "##"
COMPLETION_DELIMITER = "<|COMPLETE|>"


def parse_records(replies: DataFrame, reply: str) -> DataFrame:
    """One row per bracketed record of a reply, with its position ``seq`` and array of trimmed ``fields``."""
    records = T.split_markers(F.col(reply), [RECORD_DELIMITER, COMPLETION_DELIMITER])
    rows = replies.select("*", F.posexplode(records).alias("seq", "record")).drop(reply)
    inner = F.regexp_extract("record", r"\((.*)\)", 1)
    return rows.filter(F.col("record").rlike(r"\(.*\)")).withColumn("fields", T.split_markers(inner, [FIELD_DELIMITER])).drop("record")


def record_entities(records: DataFrame) -> DataFrame:
    """Entity rows; records with fewer than four fields or an empty name are dropped."""
    field = lambda i: T.clean_record_field(F.get("fields", F.lit(i)))
    kept = records.filter((F.size("fields") >= 4) & (F.get("fields", F.lit(0)) == '"entity"'))
    named = kept.withColumns({"entity_name": field(1), "entity_type": field(2), "description": field(3)}).drop("fields")
    return named.filter(F.col("entity_name") != "")


def record_relations(records: DataFrame) -> DataFrame:
    """Relation rows; a last field that is no plain number leaves weight 1.0."""
    field = lambda i: T.clean_record_field(F.get("fields", F.lit(i)))
    last = F.element_at("fields", -1)
    kept = records.filter((F.size("fields") >= 5) & (F.get("fields", F.lit(0)) == '"relationship"'))
    return kept.withColumns({
        "src_entity_name": field(1), "tgt_entity_name": field(2), "description": field(3),
        "weight": F.when(T.is_plain_float(last), last.try_cast("double")).otherwise(F.lit(1.0)),
    }).drop("fields")


def remember(messages: Column, message: Column) -> Column:
    """Add a message unless the list already holds it."""
    return F.when(F.array_contains(messages, message), messages).otherwise(F.array_append(messages, message))


def recall(messages: Column, keyword: Column) -> Column:
    """Messages whose content holds a keyword."""
    return F.filter(messages, lambda m: F.contains(m["content"], keyword))


def recent(messages: Column, k: int = 0) -> Column:
    """The last ``k`` messages, all of them for 0."""
    return messages if k == 0 else F.slice(messages, F.greatest(F.size(messages) - k + 1, F.lit(1)), k)


def unseen(messages: Column, observed: Column, k: int = 0) -> Column:
    """Observed messages that the last ``k`` messages do not contain."""
    return F.filter(observed, lambda m: ~F.array_contains(recent(messages, k), m))
