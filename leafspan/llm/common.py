"""Shared pieces: row keys, slices of Arrow batches, word splitting and the registry of this package's queries."""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspan.session import cut_lineage, ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Text handled at once inside a task; it bounds the size of the arrays, not the length of a text.
SLICE_BYTES = 2_000_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def query(name: str, sql: str | None = None):
    """Register a query of this package and, where SQL can say it, the statement it must match."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: Iterable[str] = ()) -> DataFrame:
    """Columns ``key``, ``doc_id``, ``text`` and, as the struct ``also``, those in ``also``; ``key`` is a unique integer in document order.

    Unique integer ids serve as keys themselves. Otherwise (null, repeated or non-integer ids) the rows are ordered by id,
    nulls first, then by a hash of the text, and numbered once; equal rows are then documents of their own.
    """
    # A struct keeps names of the caller's columns apart from ours.
    more = [F.struct(*also).alias("also")] if also else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)
    if dict(rows.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint"):
        total, present, distinct = rows.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
        if total == present == distinct:
            return rows.select(F.col("doc_id").cast("long").alias("key"), "*")
    ordered = cut_lineage(rows.sort(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.length("text")))
    return cut_lineage(ordered.select(F.monotonically_increasing_id().alias("key"), "*"))


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffle and checkpoint files that no plan refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batches: Iterable[pa.RecordBatch], text_col: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows that hold about ``limit`` bytes of text; a longer text is a run of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield batch.slice(start, end - start)


def as_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    return pc.fill_null(batch.column(column).cast(pa.binary()), b"").to_pylist()


def flat_words(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a list of documents, and the documents' word counts."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(counts.sum()))
    return hashes, counts


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (finaliser of a multiply-and-shift hash)."""
    values = values ^ (values >> np.uint64(30))
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def window_hashes(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Polynomial (Rabin-Karp) hashes of every ``size`` consecutive words that lie in one document.

    Returns hash, document number and start word of each window, in order.
    """
    starts = np.maximum(counts - size + 1, 0)
    document = np.repeat(np.arange(len(counts)), starts)
    first = np.cumsum(counts) - counts
    begin = np.arange(len(document)) - np.repeat(np.cumsum(starts) - starts, starts)
    at = begin + np.repeat(first, starts)
    if not len(at):
        return np.zeros(0, np.uint64), document, begin
    base, total = np.uint64(0x9E3779B97F4A7C15), len(hashes) - size + 1
    rolled = np.zeros(total, np.uint64)
    for i in range(size):
        rolled *= base
        rolled += hashes[i : i + total]
    return mix(rolled[at]), document, begin


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open ranges given in order of their starts; touching ranges become one."""
    out: list[tuple[int, int]] = []
    for start, end in zip(starts.tolist(), ends.tolist()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def worker_state(name: str, build: Callable):
    """An object built once per Python worker and kept for its later tasks."""
    import sys
    import types

    held = sys.modules.setdefault("__leafspan_worker_state__", types.ModuleType("__leafspan_worker_state__"))
    if not hasattr(held, name):
        setattr(held, name, build())
    return getattr(held, name)


def pack_ints(values: np.ndarray) -> bytes:
    """Non-negative integers in the fewest of 1, 2, 4 or 8 bytes each, after a byte that says how many."""
    top = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpack_ints(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


class Places:
    """(key, position) pairs as a compact row: a base key, the distinct keys above it, a count for each, and the positions."""

    FIELDS = "base long, keys binary, counts binary, at binary"

    @staticmethod
    def pack(keys: np.ndarray, at: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
        """Pairs of equal keys must be next to each other."""
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        base = int(keys.min())
        counts = np.diff(np.append(cuts, len(keys)))
        return base, pack_ints(keys[cuts] - base), pack_ints(counts), pack_ints(at)

    @staticmethod
    def unpack(base: int, keys: bytes, counts: bytes, at: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(unpack_ints(keys) + base, unpack_ints(counts)), unpack_ints(at)

    @staticmethod
    def unpack_all(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        rows = zip(*(part.column(c).to_pylist() for c in ("base", "keys", "counts", "at")))
        pairs = [Places.unpack(*row) for row in rows]
        if not pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers of each bucket, in their order."""
    order = np.argsort(bucket, kind="stable")
    ordered = bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    for start, end in zip(cuts, np.append(cuts[1:], len(ordered))):
        yield int(ordered[start]), order[start:end]


def bucket_count(rows: DataFrame, bytes_each: int = 8_000_000, least: int = 64) -> int:
    """Buckets that each take about ``bytes_each`` bytes of text."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, -(-total // bytes_each))


def key_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def later_copies(hashes: np.ndarray, keys: np.ndarray, at: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
    """Which of the (key, position) places have a place with the same hash (and the same ``more``) before them."""
    more = np.zeros(len(hashes), np.uint8) if more is None else more
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    several = np.zeros(len(hashes), bool)
    several[order[1:][same]] = True
    several[order[:-1][same]] = True
    some = np.flatnonzero(several)
    some = some[np.lexsort((at[some], keys[some], more[some], hashes[some]))]
    later = np.zeros(len(hashes), bool)
    later[some[1:][(hashes[some][1:] == hashes[some][:-1]) & (more[some][1:] == more[some][:-1])]] = True
    return later


class Workspace:
    """Tables of one run of an iterative operator, in the folder that all executors share.

    Unlike a checkpoint, a table that is read again carries no constraints of the plan that made it; these would grow with
    every round until planning takes longer than the work.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark, self.number = spark, 0
        self.folder = f"{spark.sparkContext.getCheckpointDir()}/tables-{spark._jvm.java.util.UUID.randomUUID()}"

    def keep(self, df: DataFrame) -> DataFrame:
        self.number += 1
        path = f"{self.folder}/{self.number}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Delete the run's tables."""
        self._delete(self.folder)

    def drop(self, name: str) -> None:
        """Delete one table, which no later plan may read."""
        self._delete(f"{self.folder}/{name}")

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
