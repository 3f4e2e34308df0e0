"""The corpus pipeline: language, repeated lines, near duplicates, benchmark passages, packing.

Each stage takes the documents its predecessor kept and returns those it keeps with all columns of ``documents``; the last
returns the packed pieces. Stages are written and read again, so each works on a table and none is computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspan.llm.common import table
from leafspan.llm.decontamination import remove_spans
from leafspan.llm.language import fit, held_out, predict
from leafspan.llm.lines import remove_lines
from leafspan.llm.minhash import near_duplicate_classes
from leafspan.llm.packing import pack, public_vocabulary
from leafspan.session import ensure_checkpoint_dir



def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those that identification rejects go. Without a label to learn from, those with a letter stay."""
    model = fit(docs.where(~held_out()), order=F.col("doc_id"))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    # Other names keep the caller's columns apart from the prediction's.
    names = [f"column_{i}" for i in range(len(docs.columns))]
    found = predict(docs.toDF(*names), model, names[docs.columns.index("text")])
    return found.where(~F.col("rejected")).select(*names).toDF(*docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; one of which no word is left goes."""
    also = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = remove_lines(docs, also=tuple(also), whole=True)
    kept = kept.where((F.col("n_removed") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    places = {"doc_id": "doc_id", "text": "kept"}
    return _counted(kept.select(*[F.col(places.get(c, f"also.`{c}`")).alias(c) for c in docs.columns]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates."""
    classes = near_duplicate_classes(docs, also=tuple(docs.columns))
    return classes.where(F.col("key") == F.col("class_key")).select("also.*")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark windows; one of which no word is left goes."""
    return _counted(remove_spans(docs, table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of the kept documents and their places in sequences."""
    return pack(docs, public_vocabulary())


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else docs


STAGES = [
    ("language", language),
    ("line_dedup", repeated_lines),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_passages),
    ("packing", packing),
]

# Learning and tokenising cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written to the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{spark._jvm.java.util.UUID.randomUUID()}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
