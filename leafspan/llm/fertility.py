"""Quality rules from tokeniser fertility: characters per token, byte-fallback share and token entropy, with bands per language."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspan.llm.common import as_bytes, flat_words, mix, query, slices, table, window_hashes, worker_state
from leafspan.llm.packing import public_vocabulary
from leafspan.llm.tokens import Pieces
from leafspan.operators.skew import salted_join
from leafspan.session import cut_lineage

# A document fails where a measure lies further from its group's median than so many times the 5 to 95 % range.
WIDTH = 2.0
MEASURES = ("chars_per_token", "byte_share", "entropy")
# Least half-width of each band, for groups in which nearly all documents have one value: characters per token; the share of one
# character of four byte tokens in the shortest text that passes the base rules (50 words); entropy relative to its maximum.
LEAST_WIDTH = {"chars_per_token": 0.25, "byte_share": 0.075, "entropy": 0.02}

SCHEMA = (
    "doc_id {id}, band_group string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, chars_per_token double, byte_share double, entropy double"
)


def script_of(text: str) -> str:
    """Script of the first letter, as the first word of its Unicode name; ``none`` without a letter."""
    for c in text:
        if c.isalpha():
            return unicodedata.name(c, "OTHER").split(" ")[0].lower()
    return "none"


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def repeated_words(hashes: np.ndarray, counts: np.ndarray, size: int = 3) -> np.ndarray:
    """Per document, the words that lie in a ``size``-word window found twice or more in that document."""
    values, document, begin = window_hashes(hashes, counts, size)
    keys = mix(values + document.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    first = np.cumsum(counts) - counts
    at = (begin + first[document])[again] if len(keys) else np.zeros(0, np.int64)
    marks = np.zeros(len(hashes), bool)
    for i in range(size):
        marks[at + i] = True
    return np.bincount(np.repeat(np.arange(len(counts)), counts), marks, len(counts)).astype(np.int64)


def token_measures(coded: list[bytes], is_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token count, share of byte tokens and entropy in bits, relative to the most that so many tokens can have."""
    sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 2
    ids = np.frombuffer(b"".join(coded), "<u2").astype(np.int64)
    document = np.repeat(np.arange(len(coded)), sizes)
    held = np.maximum(sizes, 1)
    share = np.bincount(document, is_byte[ids], len(coded)) / held
    kinds, n = np.unique(document << 16 | ids, return_counts=True)
    owner = kinds >> 16
    p = n / held[owner]
    bits = np.bincount(owner, -p * np.log2(p), len(coded))
    most = np.log2(np.minimum(held, len(is_byte)))
    return sizes, share, np.where(most > 0, bits / np.where(most > 0, most, 1), 1.0)


def measures(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Counts and fertility measures of every whole text; the group of its bands is its language or else its script."""
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = worker_state(f"pieces {vocabulary}", lambda: Pieces(vocabulary))
        is_byte = np.array(pieces.is_byte)
        for batch in slices(batches):
            texts = as_bytes(batch)
            words = [t.split() for t in texts]
            hashes, counts = flat_words(words)
            chars = np.array([len(b"".join(w).decode()) for w in words], np.int64)
            sizes, share, entropy = token_measures(pieces.encode(words), is_byte)
            groups = [
                f"lang {lang}" if lang is not None else f"script {script_of(t.decode())}"
                for lang, t in zip(batch.column("lang").to_pylist(), texts)
            ]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "band_group": pa.array(groups, pa.string()),
                "n_words": pa.array(counts),
                "word_chars": pa.array(chars),
                "n_symbols": pa.array([len(t) - len(t.translate(None, b"#*$%&|<>")) for t in texts], pa.int64()),
                "n_dup_lines": pa.array([repeated_lines(t) for t in texts], pa.int64()),
                "n_repeat_words": pa.array(repeated_words(hashes, counts)),
                "n_tokens": pa.array(sizes),
                "chars_per_token": pa.array(chars / np.maximum(sizes, 1)),
                "byte_share": pa.array(share),
                "entropy": pa.array(entropy),
            })

    return rows.mapInArrow(run, SCHEMA.format(id=dict(rows.dtypes)["doc_id"]))


def bands(measured: DataFrame, width: float = WIDTH) -> DataFrame:
    """Lowest and highest accepted value of each measure per group, from the measures of all documents that pass the base rules."""
    quantiles = [F.percentile_approx(m, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)), 1000).alias(m) for m in MEASURES]
    by_group = measured.where(~F.col("base_failed")).groupBy("band_group").agg(*quantiles)
    half = {m: F.greatest(width * (F.col(m)[2] - F.col(m)[0]), F.lit(LEAST_WIDTH[m])) + 1e-9 for m in MEASURES}
    low = [(F.col(m)[1] - half[m]).alias(f"{m}_low") for m in MEASURES]
    high = [(F.col(m)[1] + half[m]).alias(f"{m}_high") for m in MEASURES]
    return by_group.select("band_group", *low, *high)


def judge(docs: DataFrame, vocabulary: str, width: float = WIDTH, **columns) -> DataFrame:
    """One row per document with its counts, measures and ``base_failed``, ``kept`` and ``reasons``.

    Base rules: at least 50 words, at most half of the words in repeated three-word windows. The method's rules: each measure
    inside its group's bands. Null texts have no words and fail; repeated rows are judged each; a group whose documents all
    fail the base rules has no bands and needs none; a null language falls back to the script; other columns are not looked at.
    """
    measured = measures(docs, vocabulary, **columns)
    measured = cut_lineage(measured.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))))
    # A language may hold most documents, so each group is spread over several tasks.
    joined = salted_join(measured, bands(measured, width), ["band_group"], ["doc_id", "n_tokens", "entropy"], "left", salts=64)
    reasons = F.array_compact(F.array(
        F.when(F.col("base_failed"), F.lit("base")),
        *[F.when(~F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high")), F.lit(m)) for m in MEASURES],
    ))
    return joined.withColumn("reasons", reasons).withColumn("kept", F.size("reasons") == 0).select(*measured.columns, "kept", "reasons")


@query("op10_quality_rules")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "documents"), public_vocabulary("piece_bpe_32k.model")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_tokens", "chars_per_token", "byte_share", "entropy",
    )
