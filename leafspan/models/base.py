"""Model back ends as column factories, with deterministic offline stand-ins.

Every model-shaped operator takes one of these objects. A real model is wrapped by :func:`batched`, which hands Arrow
batches to a Python callable inside the tasks.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType

from leafspan.functions import text as T


class Embedder(Protocol):
    def embed(self, text: Column) -> Column: ...


class Reranker(Protocol):
    def score(self, question: Column, text: Column) -> Column: ...


class Generator(Protocol):
    def complete(self, prompt: Column) -> Column: ...


class VisionGenerator(Protocol):
    def describe(self, prompt: Column, image_path: Column) -> Column: ...


def batched(
    call: Callable[[Sequence], Sequence], returns: DataType, batch_size: int = 16, tries: int = 3, pause: float = 1.0
):
    """Column function around a batch model call with retries.

    A batch that keeps failing yields ``Error: ...`` strings for a string model and NULL otherwise, so that one bad
    batch does not fail the job.
    """
    is_text = returns.simpleString() == "string"

    def attempt(batch: list) -> list:
        for remaining in range(tries - 1, -1, -1):
            try:
                return list(call(batch))
            except Exception as error:
                if remaining == 0:
                    return [f"Error: {error}" if is_text else None] * len(batch)
                time.sleep(pause)
        return []

    @F.pandas_udf(returns)
    def run(values: pd.Series) -> pd.Series:
        rows = values.tolist()
        return pd.Series([r for i in range(0, len(rows), batch_size) for r in attempt(rows[i : i + batch_size])])

    return run


def once_per_value(df: DataFrame, inputs: Sequence[str], output: str, model: Callable[..., Column]) -> DataFrame:
    """Call a model once per distinct input and join the result back."""
    answers = df.select(*inputs).distinct().withColumn(output, model(*[F.col(c) for c in inputs]))
    return df.join(answers, list(inputs), "left")


class HashEmbedder:
    """Bag of hashed words, scaled to unit length."""

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions = dimensions

    def embed(self, text: Column) -> Column:
        size = self.dimensions

        @F.pandas_udf(ArrayType(DoubleType()))
        def run(word_lists: pd.Series) -> pd.Series:
            places: dict[str, int] = {}  # of the words of this batch

            def place(word: str) -> int:
                found = places.get(word)
                if found is None:
                    found = places[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % size
                return found

            def one(words) -> np.ndarray:
                vector = np.bincount([place(word) for word in words], minlength=size).astype(np.float64)
                length = np.linalg.norm(vector)
                return vector / length if length else vector

            return word_lists.map(one)

        return run(T.terms(F.coalesce(text, F.lit(""))))


class OverlapReranker:
    """Share of the distinct question words found in the text."""

    def score(self, question: Column, text: Column) -> Column:
        asked = F.array_distinct(T.terms(question))
        shared = F.size(F.array_intersect(asked, T.terms(F.coalesce(text, F.lit("")))))
        return F.when(F.size(asked) > 0, shared / F.size(asked)).otherwise(F.lit(0.0))


class ExtractiveGenerator:
    """Answers with the first words of the evidence that follows the marker in the prompt."""

    MARKER = "Evidence:\n"

    def __init__(self, words: int = 30) -> None:
        self.words = words

    def complete(self, prompt: Column) -> Column:
        evidence = F.substring_index(prompt, self.MARKER, -1)
        return T.truncate_words(T.squeeze(evidence), self.words)

    def describe(self, prompt: Column, image_path: Column) -> Column:
        return F.concat(F.lit("Image "), image_path, F.lit(": "), self.complete(prompt))


class PairJudge:
    """Judges pairs by a plain rule: a table or text continues one that is at least half as long."""

    PAIRS = (
        "array<struct<pdf_id_1:long,table_1_html:string,table_2_html:string,"
        "incomplete_text:string,candidate_list:array<struct<pdf_id:long,text:string>>>>"
    )

    def complete(self, prompt: Column) -> Column:
        pairs = F.from_json(F.substring_index(prompt, "Pairs:\n", -1), self.PAIRS)
        none = F.array(F.lit(-1).cast("long"))

        def judgment(pair: Column) -> Column:
            fits = F.filter(pair["candidate_list"], lambda c: F.length(c["text"]) <= 2 * F.length(pair["incomplete_text"]))
            ids = F.transform(fits, lambda c: c["pdf_id"])
            merged = F.when(F.length(pair["table_2_html"]) <= 2 * F.length(pair["table_1_html"]), pair["pdf_id_1"]).otherwise(F.lit(-1).cast("long"))
            return F.struct(merged.alias("merged_id"), F.when(F.size(ids) > 0, ids).otherwise(none).alias("stitched_pdf_ids"))

        return F.to_json(F.struct(F.transform(pairs, judgment).alias("judgments")))


class OutlineJudge:
    """Leaves titles as they are and takes those of at most two words for no titles."""

    TITLES = "struct<titles:array<struct<pdf_id:int,text:string,level:int,parent_id:int>>>"

    def complete(self, prompt: Column) -> Column:
        titles = F.from_json(F.substring_index(prompt, "Titles:\n", -1), self.TITLES)["titles"]
        level = lambda t: F.when(T.word_count(F.coalesce(t["text"], F.lit(""))) <= 2, -1).otherwise(t["level"])
        judged = F.transform(titles, lambda t: F.struct(t["pdf_id"].alias("pdf_id"), level(t).alias("level"), t["parent_id"].alias("parent_id")))
        return F.to_json(F.struct(judged.alias("outline")))


class SectionChooser:
    """Chooses the offered sections whose title shares a word with the question."""

    INPUT = "struct<question:string,remaining:array<struct<section_id:long,title:string>>>"

    def complete(self, prompt: Column) -> Column:
        given = F.from_json(F.substring_index(prompt, "Input:\n", -1), self.INPUT)
        # Bound to a variable, so that the prompt is read and the question split once and not for every section.
        asked = F.transform(F.array(given), lambda g: F.struct(T.terms(g["question"]).alias("terms"), g["remaining"].alias("remaining")))
        chosen = F.transform(asked, lambda a: F.transform(
            F.filter(a["remaining"], lambda s: F.arrays_overlap(a["terms"], T.terms(s["title"]))), lambda s: s["section_id"]
        ))
        return F.to_json(F.struct(F.get(chosen, F.lit(0)).alias("supplementary_ids")))


class NameExtractor:
    """Capitalised words stand in for the entities a language model would name."""

    def names(self, text: Column) -> Column:
        return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("[A-Z][a-z]{3,}"), F.lit(0)), lambda n: F.lower(n)))
