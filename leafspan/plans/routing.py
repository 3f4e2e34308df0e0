"""Question routing: simple, complex or global, with sub-questions, structural filters and an operation.

The default router works by rules so that it runs offline; a model-backed one returns the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafspan.functions import text as T

# The vocabulary of a plan.
QUERY_TYPES = ["simple", "complex", "global"]
FILTER_TYPES = ["section", "image", "table", "page"]
OPERATIONS = ["COUNT", "LIST", "SUMMARIZE", "ANALYZE"]
SUB_QUESTION_TYPES = ["retrieval", "synthesis"]

FILTER_SCHEMA = "array<struct<filter_type:string,filter_value:string>>"
SUB_QUESTION_SCHEMA = "array<struct<question:string,type:string>>"


def route(questions: DataFrame, question: str = "question") -> DataFrame:
    """Add ``query_type``, ``operation``, ``filters`` and ``sub_questions``."""
    asked = F.lower(F.col(question))
    operation = (
        F.when(asked.rlike("how many|count "), "COUNT").when(asked.rlike(r"^list |list all"), "LIST")
        .when(asked.rlike("summari[sz]e"), "SUMMARIZE").when(asked.rlike("analy[sz]e"), "ANALYZE")
    )
    pages = F.regexp_extract(asked, r"pages? (\d+)(?:\s*(?:-|to|and)\s*(?:page )?(\d+))?", 1)
    last = F.regexp_extract(asked, r"pages? (\d+)\s*(?:-|to|and)\s*(?:page )?(\d+)", 2)
    section = F.regexp_extract(F.col(question), r"(?i)['\"]([^'\"]+)['\"] section", 1)
    entry = lambda kind, value: F.struct(F.lit(kind).alias("filter_type"), value.cast("string").alias("filter_value"))
    filters = F.array_compact(F.array(
        F.when(asked.rlike("figure|image|picture|plot"), entry("image", F.lit(None))),
        F.when(asked.rlike("tables?\\b"), entry("table", F.lit(None))),
        F.when(pages != "", entry("page", F.when(last != "", F.concat_ws("-", pages, last)).otherwise(pages))),
        F.when(section != "", entry("section", section)).when(asked.rlike("sections|chapters"), entry("section", F.lit(None))),
    )).cast(FILTER_SCHEMA)
    pieces = F.filter(F.transform(F.split(F.col(question), r"(?i)\?\s+|;\s+|, and then "), T.strip), lambda p: p != "")
    is_global = operation.isNotNull() & (F.size(filters) > 0)
    is_complex = ~is_global & (F.size(pieces) > 1)
    steps = F.array_append(
        F.transform(pieces, lambda p: F.struct(p.alias("question"), F.lit("retrieval").alias("type"))),
        F.struct(F.col(question).alias("question"), F.lit("synthesis").alias("type")),
    ).cast(SUB_QUESTION_SCHEMA)
    return questions.withColumns({
        "query_type": F.when(is_global, "global").when(is_complex, "complex").otherwise("simple"),
        "operation": F.when(is_global, operation), "filters": F.when(is_global, filters),
        "sub_questions": F.when(is_complex, steps),
    })


def is_valid() -> Column:
    """Whether the plan columns agree: each type carries its own parts and only allowed values."""
    kind = F.col("query_type")
    filters_ok = F.forall("filters", lambda f: f["filter_type"].isin(FILTER_TYPES) & (
        ~f["filter_type"].isin("image", "table") | f["filter_value"].isNull()))
    steps_ok = F.forall("sub_questions", lambda s: s["type"].isin(SUB_QUESTION_TYPES))
    return F.coalesce(
        F.when(kind == "complex", (F.size("sub_questions") > 0) & steps_ok)
        .when(kind == "global", F.col("operation").isin(OPERATIONS) & F.col("filters").isNotNull() & filters_ok)
        .otherwise(kind == "simple"),
        F.lit(False),
    )


def retrieval_steps(planned: DataFrame, key: str, question: str = "question") -> DataFrame:
    """One row per retrieval to run: the question itself, or the retrieval sub-questions of a complex one."""
    own = F.array(F.struct(F.col(question).alias("question"), F.lit("retrieval").alias("type"))).cast(SUB_QUESTION_SCHEMA)
    steps = F.when(F.col("query_type") == "complex", F.col("sub_questions")).otherwise(own)
    rows = planned.filter("query_type <> 'global'").select(key, "doc_id", F.posexplode(steps).alias("step", "s"))
    return rows.filter("s.type = 'retrieval'").select(key, "doc_id", "step", F.col("s.question").alias("question"))


def apply_filters(planned: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """``(key, doc_id, index_id)`` of the nodes each global question selects, all questions in one join.

    Same rules as :func:`leafspan.operators.tree.structural_filter`, with the filters as data. ``nodes`` carries
    ``title_path``.
    """
    asked = planned.filter("query_type = 'global'").select(key, "doc_id", "filters")
    joined = asked.join(nodes.select("doc_id", "index_id", "type", "page_idx", "title_path"), "doc_id")
    page = F.col("page_idx") + 1

    def holds(f: Column) -> Column:
        low, high = (F.try_element_at(F.split(f["filter_value"], "-"), F.lit(i)).try_cast("int") for i in (1, 2))
        single = F.when(low.isNotNull(), page == low).otherwise(True)
        ranged = F.when(low.isNotNull() & high.isNotNull(), page.between(low, high)).otherwise(True)
        return (
            F.when(f["filter_type"].isin("image", "table"), F.col("type") == f["filter_type"])
            .when(f["filter_value"].isNull(), True)
            .when(f["filter_type"] == "page", F.when(F.contains(f["filter_value"], F.lit("-")), ranged).otherwise(single))
            .when(f["filter_type"] == "section", F.contains(F.col("title_path"), F.lower(f["filter_value"])))
            .otherwise(True)
        )

    return joined.filter(F.forall("filters", holds)).select(key, "doc_id", "index_id")
