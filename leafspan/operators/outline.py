"""Document outline: line height, parents by level, ranges and repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafspan.functions import text as T
from leafspan.functions.replies import parsed
from leafspan.models.base import Generator
from leafspan.operators.scan import ROWS_PER_SEGMENT, Running, dense_number, position_segment, prefix_scan
from leafspan.session import cut_lineage, cut_round

# Words and titles of one judgement.
BATCH_WORDS = 2_000
BATCH_TITLES = 51
OUTLINE_TASK = "Give the level and the parent of every title as outline. Level -1 is no title.\nTitles:\n"


def effective_height(bbox: Column, text: Column) -> Column:
    """Single-line height of a block: its height divided by the estimated number of lines.

    Characters are taken to be half as wide as they are high; boxes more than 15 times wider than high count as one
    line. Rounding is half-even.
    """
    width, height = F.get(bbox, F.lit(2)) - F.get(bbox, F.lit(0)), F.get(bbox, F.lit(3)) - F.get(bbox, F.lit(1))
    chars = F.length(text)
    lines = F.bround(F.greatest(F.lit(1.0), F.sqrt(chars * height / width * 0.5)))
    lines = F.when(width / height > 15, 1.0).otherwise(lines)
    return (
        F.when(bbox.isNull() | (F.size(bbox) != 4), 0.0)
        .when((width > 0) & (height > 0) & (chars > 0), height / lines)
        .otherwise(F.greatest(height, F.lit(0.0)))
    )


def titles(blocks: DataFrame) -> DataFrame:
    return blocks.filter(F.col("text").isNotNull() & F.col("text_level").isNotNull())


def parents_by_level(titles_: DataFrame, rows: int | None = ROWS_PER_SEGMENT) -> DataFrame:
    """Add ``parent_id``: the nearest earlier title of a smaller level, 0 when there is none.

    One running maximum per level present in the data replaces a stack that would have to walk a document in order.
    """
    levels = sorted(r[0] for r in titles_.select("text_level").distinct().collect())
    running = {
        f"__last_{i}": Running("max", F.when(F.col("text_level") == level, F.col("pdf_id")), inclusive=False)
        for i, level in enumerate(levels)
    }
    scanned = prefix_scan(titles_, ["doc_id"], ["pdf_id"], running, position_segment("pdf_id", rows))
    parent = F.lit(None).cast("int")
    for i, level in enumerate(levels):
        candidate = F.when(F.col("text_level") > level, F.col(f"__last_{i}"))
        parent = candidate if i == 0 else F.greatest(parent, candidate)
    return scanned.withColumn("parent_id", F.coalesce(parent, F.lit(0)).cast("int")).drop(*running)


def repair(outline: DataFrame) -> DataFrame:
    """Ensure each outline has a level-0 entry and that deeper entries do not hang on the missing parent 0."""
    per_doc = outline.groupBy("doc_id").agg(
        F.min("pdf_id").alias("__first"), F.min(F.when(F.col("text_level") == 0, F.col("pdf_id"))).alias("__top")
    )
    promoted = F.col("__top").isNull() & (F.col("pdf_id") == F.col("__first"))
    level = F.when(promoted, 0).otherwise(F.col("text_level"))
    parent = F.when((level != 0) & (F.col("parent_id") == 0), F.coalesce("__top", "__first")).otherwise(F.col("parent_id"))
    return (
        outline.join(per_doc, "doc_id")
        .withColumn("parent_id", parent.cast("int"))
        .withColumn("text_level", level.cast("int"))
        .drop("__first", "__top")
    )


def apply_judgement(outline: DataFrame, judged: DataFrame) -> DataFrame:
    """Replace level and parent by a model's ``(doc_id, pdf_id, level, parent_id)``; level -1 drops the title."""
    better = judged.select("doc_id", "pdf_id", F.col("level").alias("__level"), F.col("parent_id").alias("__parent"))
    return (
        outline.join(better, ["doc_id", "pdf_id"])
        .filter(F.col("__level") != -1)
        .withColumn("text_level", F.col("__level"))
        .withColumn("parent_id", F.col("__parent"))
        .drop("__level", "__parent")
    )


def ranges(outline: DataFrame, block_counts: DataFrame, rows: int | None = ROWS_PER_SEGMENT) -> DataFrame:
    """Add ``end_id``: the id of the next title, one past the last block for the last title."""
    following = prefix_scan(
        outline, ["doc_id"], ["pdf_id"], {"__next": Running("last", F.col("pdf_id"), inclusive=False)},
        position_segment("pdf_id", rows), reverse=True,
    )
    return (
        following.join(block_counts.select("doc_id", "n_blocks"), "doc_id")
        .withColumn("end_id", F.coalesce(F.col("__next"), F.col("n_blocks") + 1).cast("int"))
        .drop("__next", "n_blocks")
    )


def assign_blocks(blocks: DataFrame, outline: DataFrame, rows: int | None = ROWS_PER_SEGMENT) -> DataFrame:
    """Add ``title_id`` to each block: the nearest outline title at or before it, NULL before the first title.

    Title ranges tile a document, so the range join is a running last value.
    """
    flagged = blocks.join(
        outline.select("doc_id", "pdf_id", F.lit(True).alias("in_outline")), ["doc_id", "pdf_id"], "left"
    ).withColumn("in_outline", F.coalesce("in_outline", F.lit(False)))
    return prefix_scan(
        flagged, ["doc_id"], ["pdf_id"],
        {"title_id": Running("last", F.when(F.col("in_outline"), F.col("pdf_id")))},
        position_segment("pdf_id", rows),
    )


def level_summary(outline: DataFrame) -> DataFrame:
    """Titles and deepest level per document."""
    return outline.groupBy("doc_id").agg(F.count("*").alias("n_titles"), F.max("text_level").alias("max_level"))


def chunk_context(outline: DataFrame) -> DataFrame:
    """Titles shown as context when the next chunk of a long outline is judged.

    All level-0 titles, the first three and last five of level 1, and up to five titles at the end reaching back to
    the nearest level-1 title. Each rule is a bounded per-document list of extreme ids.
    """
    level_one = F.when(F.col("text_level") == 1, F.col("pdf_id"))
    last_level_one = outline.groupBy("doc_id").agg(F.max(level_one).alias("__last_one"))
    first = F.row_number().over(Window.partitionBy("doc_id", "text_level").orderBy("pdf_id"))
    final = F.row_number().over(Window.partitionBy("doc_id", "text_level").orderBy(F.desc("pdf_id")))
    tail = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("pdf_id")))
    parts = [
        outline.filter("text_level = 0"),
        outline.filter("text_level = 1").withColumn("__n", first).filter("__n <= 3").drop("__n"),
        outline.filter("text_level = 1").withColumn("__n", final).filter("__n <= 5").drop("__n"),
        outline.withColumn("__n", tail).filter("__n <= 5").drop("__n")
        .join(last_level_one, "doc_id").filter("__last_one IS NULL OR pdf_id >= __last_one").drop("__last_one"),
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.select("doc_id", "pdf_id", "text_level").distinct()


def judge_in_rounds(
    titles_: DataFrame, generator: Generator, words: int = BATCH_WORDS, most: int = BATCH_TITLES, rows: int | None = ROWS_PER_SEGMENT
) -> DataFrame:
    """The outline ``(doc_id, pdf_id, text, text_level, parent_id, ...)`` as a model judges it, batch by batch.

    Every round judges the next batch of every document that has titles left: at most ``most`` titles, which together with the
    context from the outline so far hold at most ``words`` words, each title counting one more. A title that does not fit by
    itself is left out. Of a reply only titles of the batch count, and level -1 drops one; where the reply is no such object,
    the batch keeps the levels and parents it had. The outline is repaired after each round, as context for the next.
    """
    numbered = dense_number(titles_, ["doc_id"], "pdf_id", "__nth", rows)
    waiting = cut_lineage(numbered.withColumn("__words", T.word_count(F.coalesce("text", F.lit(""))) + 1))
    columns = titles_.columns
    done = waiting.select("doc_id").distinct().withColumn("__done", F.lit(0))
    outline = cut_lineage(waiting.select(*columns).limit(0))
    while not waiting.isEmpty():
        context = chunk_context(outline).select("doc_id", "pdf_id").join(outline, ["doc_id", "pdf_id"])
        shown = context.groupBy("doc_id").agg(
            F.sum(T.word_count(F.coalesce("text", F.lit(""))) + 1).alias("__shown"), _listed().alias("__context")
        )
        # Only the next few titles of a document can be in its batch, which bounds the window.
        near = waiting.join(done, "doc_id").filter(F.col("__nth") <= F.col("__done") + most).join(shown, "doc_id", "left")
        running = F.sum("__words").over(Window.partitionBy("doc_id").orderBy("__nth")) + F.coalesce("__shown", F.lit(0))
        near = cut_lineage(near.withColumn("__fits", running <= words))
        batch = near.filter("__fits")
        asked = batch.groupBy("doc_id").agg(_listed().alias("__new"), F.max("__nth").alias("__last"), F.first("__context").alias("__context"))
        payload = F.to_json(F.struct(F.coalesce("__context", F.array().cast(LISTED)).alias("context"), F.col("__new").alias("titles")))
        reply = parsed(generator.complete(F.concat(F.lit(OUTLINE_TASK), payload)), "outline array<struct<pdf_id:int,level:int,parent_id:int>>")
        told = cut_lineage(asked.select("doc_id", "__last", reply["outline"].alias("__told")))
        judged = told.select("doc_id", F.explode("__told").alias("j")).select("doc_id", "j.*").filter("pdf_id IS NOT NULL")
        judged = judged.groupBy("doc_id", "pdf_id").agg(F.first("level").alias("level"), F.first("parent_id").alias("parent_id"))
        judged = judged.select("doc_id", "pdf_id", F.coalesce("level", F.lit(-1)).alias("level"), F.coalesce("parent_id", F.lit(-1)).alias("parent_id"))
        silent = told.filter(F.coalesce(F.size("__told"), F.lit(0)) <= 0).select("doc_id")
        new = apply_judgement(batch.select(*columns), judged).select(*columns)
        kept = batch.select(*columns).join(silent, "doc_id", "left_semi")
        outline = cut_round(repair(outline.unionByName(new).unionByName(kept)).select(*columns))
        # A document whose next title does not fit goes past it.
        done = cut_round(
            done.join(told.select("doc_id", "__last"), "doc_id", "left")
            .select("doc_id", F.coalesce("__last", F.col("__done") + 1).cast("int").alias("__done"))
        )
        waiting = cut_round(waiting.join(done, "doc_id").filter(F.col("__nth") > F.col("__done")).drop("__done"))
    return outline


LISTED = "array<struct<pdf_id:int,text:string,level:int,parent_id:int>>"


def _listed() -> Column:
    return F.array_sort(F.collect_list(F.struct("pdf_id", "text", F.col("text_level").alias("level"), "parent_id")))
