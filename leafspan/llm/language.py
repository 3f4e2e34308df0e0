"""Language identification: averaged hashed subword embeddings with a linear softmax, trained in numpy, with calibrated rejection."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafspan.llm.common import as_bytes, query, slices, table

GRAMS = (3, 4)
BITS = 15  # buckets for each length of subword, as a power of two
DIMENSION = 16
# Labelled rows that the classifier is fitted on: about so many for each of at most so many languages.
ROWS_PER_LANGUAGE = 500
MAX_LANGUAGES = 200
EPOCHS = 12
CALIBRATION_SHARE = 0.25
# Share of rightly classified calibration rows that rejection may cost, and the highest threshold.
REJECTED_SHARE = 0.002
HIGHEST_THRESHOLD = 0.5

# ASCII letters in lower case and everything outside ASCII stay, the rest becomes a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode())


def subwords(texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each length of subword, the bucket of every subword of a list of texts and its text's number.

    A subword is a run of bytes of a word with its borders; it holds no space but at its ends.
    """
    plain = [b" " + b" ".join(t.translate(_LETTERS).split()) + b" " for t in texts]
    sizes = np.fromiter(map(len, plain), np.int64, len(plain))
    data = np.frombuffer(b"".join(plain), np.uint8)
    owner = np.repeat(np.arange(len(plain), dtype=np.int32), sizes)
    space = data == 32
    wide = data.astype(np.uint32)
    buckets, owners = [], []
    for number, n in enumerate(GRAMS):
        count = max(0, len(data) - n + 1)
        code, inner = np.zeros(count, np.uint32), np.zeros(count, bool)
        for i in range(n):
            code = (code << np.uint32(8)) | wide[i : i + count]
            if 0 < i < n - 1:
                inner |= space[i : i + count]
        good = ~inner
        code = code[good] * np.uint32(2654435761) >> np.uint32(32 - BITS)
        buckets.append(code.astype(np.int64) + (number << BITS))
        owners.append(owner[:count][good])
    return buckets, owners


def bags(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their counts."""
    buckets, owners = subwords(texts)
    keys, n = np.unique(np.concatenate(owners).astype(np.int64) << 32 | np.concatenate(buckets), return_counts=True)
    cuts = np.searchsorted(keys >> 32, np.arange(len(texts) + 1))
    return [(keys[a:b] & 0xFFFFFFFF, n[a:b]) for a, b in zip(cuts, cuts[1:])]


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # embeddings times the softmax layer, a row for each bucket
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """Average of the subwords' scores; a text without subwords has the bias alone."""
        buckets, owners = subwords(texts)
        total, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for own, text in zip(buckets, owners):
            if len(own):
                first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
                total[text[first]] += np.add.reduceat(self.scores[own], first, axis=0)
                n += np.bincount(text, minlength=len(texts))
        return total / np.maximum(n, 1)[:, None] + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        scaled = logits / self.temperature
        scaled = np.exp(scaled - scaled.max(axis=1, keepdims=True))
        return scaled / scaled.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """Stochastic gradient descent over (language, buckets, counts), then temperature and threshold on rows set aside."""
    languages = sorted({r[0] for r in rows})
    number = {name: i for i, name in enumerate(languages)}
    random = np.random.default_rng(seed)
    order = random.permutation(len(rows))
    aside = order[: int(len(rows) * CALIBRATION_SHARE)] if len(rows) >= 20 else order[:0]
    used = order[len(aside) :]
    embedding = random.normal(0, 0.1, (len(GRAMS) << BITS, DIMENSION))
    layer, bias = random.normal(0, 0.3, (DIMENSION, len(languages))), np.zeros(len(languages))
    for epoch in range(EPOCHS):
        rate = 0.5 * (1 - epoch / EPOCHS)
        for i in random.permutation(used):
            name, buckets, counts = rows[i]
            if not len(buckets):
                continue
            share = counts / counts.sum()
            mean = share @ embedding[buckets]
            p = mean @ layer + bias
            p = np.exp(p - p.max())
            p /= p.sum()
            p[number[name]] -= 1
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= 0.05 * rate * p
            # Rare subwords would hardly move by their share alone.
            embedding[buckets] -= rate * np.outer(np.sqrt(share), back)
    model = Model(languages, (embedding @ layer).astype(np.float32), bias)
    if len(aside):
        truth = np.array([number[rows[i][0]] for i in aside])
        logits = np.stack([
            (rows[i][2] / max(1, rows[i][2].sum())) @ model.scores[rows[i][1]] + bias if len(rows[i][1]) else bias for i in aside
        ])
        best = np.inf
        for temperature in np.geomspace(0.05, 10, 60):
            model_p = Model(languages, model.scores, bias, temperature).probabilities(logits)
            loss = -np.log(np.maximum(model_p[np.arange(len(truth)), truth], 1e-12)).mean()
            if loss < best:
                best, model.temperature = loss, float(temperature)
        p = model.probabilities(logits)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth])
        if len(right):
            model.threshold = float(min(HIGHEST_THRESHOLD, right[int(len(right) * REJECTED_SHARE)]))
    return model


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", order: Column | None = None, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    """Fit on a bounded sample: about ``rows_per_language`` rows of each language, picked by a hash of ``order``.

    Only counts of subwords reach the driver, at most one for each bucket and row. Rows without text or language are left out;
    without any labelled row there is no model.
    """
    rows = labelled.select(
        F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"),
        F.xxhash64(order if order is not None else F.col(text_col), F.lit(3)).alias("__order"),
    ).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    if not counts:
        return None
    wanted = F.lit(False)
    for r in counts:
        share = min(1.0, rows_per_language / r["count"])
        wanted = wanted | ((F.col("lang") == r["lang"]) & (F.pmod("__order", F.lit(1_000_000_007)) < int(share * 1_000_000_007)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = bags(as_bytes(batch))
            yield pa.RecordBatch.from_pydict({
                "lang": batch.column("lang"),
                "buckets": pa.array([b.astype("<u4").tobytes() for b, _ in found], pa.binary()),
                "counts": pa.array([c.astype("<u4").tobytes() for _, c in found], pa.binary()),
            })

    sample = rows.where(wanted).select("text", "lang").mapInArrow(run, "lang string, buckets binary, counts binary")
    taken = sample.limit(2 * rows_per_language * len(counts)).collect()
    taken.sort(key=lambda r: (r["lang"], bytes(r["buckets"]), bytes(r["counts"])))
    return train([(r["lang"], np.frombuffer(r["buckets"], "<u4").astype(np.int64), np.frombuffer(r["counts"], "<u4").astype(np.int64)) for r in taken])


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The documents with ``lang_pred``, ``score`` and ``rejected``.

    A null text, one without a letter, or any text without a model is ``und`` with score 0 and rejected; otherwise a text is
    rejected where its calibrated score is under the model's threshold. Whole texts are read, repeated rows are predicted each.
    """
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.scores, model.bias, model.temperature, model.threshold) if model else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*shared.value) if shared.value else None
        for batch in slices(batches, text_col, limit=1_000_000):
            texts = as_bytes(batch, text_col)
            letters = np.array([has_letter(t) for t in texts])
            if known:
                p = known.probabilities(known.logits(texts))
                best = p.argmax(axis=1)
                score = np.where(letters, np.clip(p.max(axis=1), 0, 1), 0.0)
                name = [known.languages[b] if ok else "und" for b, ok in zip(best, letters)]
            else:
                score, name = np.zeros(len(texts)), ["und"] * len(texts)
            rejected = [n == "und" or bool(s < known.threshold) for n, s in zip(name, score)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(name, pa.string()), pa.array(score), pa.array(rejected)], names=[*names, "lang_pred", "score", "rejected"])

    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that the classifier never learns from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the documents' labels outside the held-out part and predict all of them; see :func:`predict`."""
    learned = fit(docs.where(~held_out(id_col)), text_col, lang_col, F.col(id_col))
    return predict(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), learned)


@query("op3_language_id")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = identify(table(spark, folder, "documents"))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
