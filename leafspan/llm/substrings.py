"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark, merged into maximal removal ranges.

Hashes travel in compact blocks, one per task, flush and bucket. Of windows that a task meets several times only the earliest
travels on; the others already have an earlier copy. A bucket's task finds the windows that also start earlier elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspan.llm.common import (
    Places, as_bytes, bucket_count, by_bucket, flat_words, keyed, key_bucket, later_copies, query, release, slices, table,
    window_hashes,
)
from leafspan.session import cut_lineage

WINDOW_WORDS = 20
FLUSH_WINDOWS = 1_000_000

BLOCKS = f"bucket long, {Places.FIELDS}, hashes binary"
FLAGS = f"bucket long, {Places.FIELDS}"
FLAG_NAMES = ["bucket", "base", "keys", "counts", "at"]


def _rows(names: list[str], rows: list[tuple]) -> dict:
    return {name: [row[i] for row in rows] for i, name in enumerate(names)}


def flag_rows(keys: np.ndarray, at: np.ndarray, buckets: int) -> list[tuple]:
    """Flagged places, packed by the bucket of their document."""
    order = np.lexsort((at, keys))
    keys, at = keys[order], at[order]
    return [(bucket, *Places.pack(keys[rows], at[rows])) for bucket, rows in by_bucket(key_bucket(keys, buckets))]


FLAG_SCHEMA = pa.schema([("bucket", pa.int64()), ("base", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("at", pa.binary())])
BLOCK_SCHEMA = FLAG_SCHEMA.append(pa.field("hashes", pa.binary()))


def _blocks(rows: DataFrame, size: int, buckets: int) -> DataFrame:
    """Blocks of window hashes by bucket; blocks without hashes hold places that are later copies within their task."""

    def flush(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        hashes, keys, at = (np.concatenate([h[i] for h in held]) for i in range(3))
        later = later_copies(hashes, keys, at)
        out = [(*row, None) for row in flag_rows(keys[later], at[later], buckets)] if later.any() else []
        hashes, keys, at = hashes[~later], keys[~later], at[~later]
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        for number, own in by_bucket(bucket):
            out.append((number, *Places.pack(keys[own], at[own]), hashes[own].tobytes()))
        return pa.RecordBatch.from_pydict(_rows(BLOCK_SCHEMA.names, out), schema=BLOCK_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in slices(batches):
            hashes, document, begin = window_hashes(*flat_words([t.split() for t in as_bytes(batch)]), size)
            if len(hashes):
                held.append((hashes, batch.column("key").to_numpy()[document], begin))
                waiting += len(hashes)
            if waiting >= FLUSH_WINDOWS:
                yield flush(held)
                held, waiting = [], 0
        if held:
            yield flush(held)

    return rows.select("key", "text").mapInArrow(run, BLOCKS)


def _resolve(buckets: int):
    """Within a bucket, the places whose hash also occurs at an earlier place."""

    def run(part: pa.Table) -> pa.Table:
        known = part.column("hashes").is_valid()
        ready, blocks = part.filter(pc.invert(known)).select(FLAG_NAMES), part.filter(known)
        keys, at = Places.unpack_all(blocks)
        hashes = np.frombuffer(b"".join(blocks.column("hashes").to_pylist()), "<u8")
        later = later_copies(hashes, keys, at)
        found = pa.Table.from_pydict(_rows(FLAG_NAMES, flag_rows(keys[later], at[later], buckets) if later.any() else []), schema=FLAG_SCHEMA)
        return pa.concat_tables([ready.cast(FLAG_SCHEMA), found])

    return run


def ranges_of(flags: DataFrame, size: int) -> DataFrame:
    """``key, removed``: the union of flagged windows of each document, as merged half-open ranges."""

    def run(part: pa.Table) -> pa.Table:
        keys, at = Places.unpack_all(part)
        order = np.lexsort((at, keys))
        keys, at = keys[order], at[order]
        # A range starts where the last window of the same document ends before this one.
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (at[1:] > at[:-1] + size)]) if len(keys) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(keys)) - 1
        owners, starts, ends = keys[first], at[first], at[last] + size
        cuts = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]])) if len(owners) else np.zeros(0, np.int64)
        ranges = pa.StructArray.from_arrays([pa.array(starts), pa.array(ends)], ["start", "end"])
        return pa.table({
            "key": pa.array(owners[cuts]),
            "removed": pa.ListArray.from_arrays(pa.array(np.append(cuts, len(owners)), pa.int32()), ranges),
        })

    return flags.groupBy("bucket").applyInArrow(run, "key long, removed array<struct<start:long,end:long>>")


def repeated_ranges(rows: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """``key, removed`` for every document with a window that also starts earlier; ``rows`` has ``key`` and ``text``."""
    buckets = bucket_count(rows)
    flags = _blocks(rows, size, buckets).groupBy("bucket").applyInArrow(_resolve(buckets), FLAGS)
    ranges = cut_lineage(ranges_of(flags, size))
    release(rows.sparkSession)
    return ranges


def remove_repeats(docs: DataFrame, size: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, removed, kept``, where ``kept`` is the text's words that stay.

    A word goes where a window of ``size`` words covers it that also starts earlier: in a smaller id (null ids first, equal
    ids in the order of a hash of the text) or earlier in the document. Null and empty texts have no words, texts shorter than a
    window stay whole, repeated rows are documents of their own, an empty table gives no rows, other columns are not looked at.
    """
    rows = keyed(docs, id_col, text_col)
    joined = rows.join(repeated_ranges(rows, size), "key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_words, n_removed, kept = [], [], []
            for text, ranges in zip(as_bytes(batch), batch.column("removed").to_pylist()):
                words = text.split()
                n_words.append(len(words))
                gone, left, at = 0, [], 0
                for r in ranges or ():
                    left += words[at : r["start"]]
                    gone, at = gone + r["end"] - r["start"], r["end"]
                n_removed.append(gone)
                kept.append(b" ".join(left + words[at:]).decode())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "removed": batch.column("removed"),
                "kept": pa.array(kept, pa.string()),
            })

    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string"
    return joined.select("doc_id", "text", "removed").mapInArrow(run, schema)


SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM doc, unnest(range(1, len(w) - 18)) AS t(i) WHERE len(w) >= 20),
flagged AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, j FROM flagged, unnest(range(i, i + 20)) AS t(j)),
word AS (SELECT doc_id, j, w[j] AS word FROM doc, unnest(range(1, len(w) + 1)) AS t(j)),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS text FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""


@query("op9_substring_dedup", SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )
