"""Benchmark decontamination: broadcast hash sets of normalised benchmark n-grams, scanned over every document window."""

from __future__ import annotations

import pickle
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspan.llm.common import as_bytes, flat_words, keyed, query, release, slices, table, window_hashes
from leafspan.session import cut_lineage

WINDOW_WORDS = 10
# Most benchmark words in one broadcast; a larger benchmark is scanned in several blocks.
BLOCK_WORDS = 250_000

# Word bytes: digits, letters of either case and everything outside ASCII; A-Z become a-z.
_NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_WORD = re.compile(rb"[^ ]+")

SCAN_SCHEMA = (
    "key long, doc_id {id}, n_words long, spans array<struct<start:long,end:long>>, items array<string>, clean string"
)


def split_words(text: bytes) -> list[bytes]:
    """Normalised words of a text."""
    return text.translate(_NORMAL).split()


class NgramSet:
    """Windows of a block of benchmark items, by length and hash, with the items each one occurs in."""

    def __init__(self, items: Iterable[tuple[str, str]], size: int):
        self.items: list[str] = []
        self.windows: dict[int, dict[int, list[tuple[bytes, set[int]]]]] = defaultdict(dict)
        for item_id, text in items:
            words = split_words(text.encode())
            if not words:
                continue
            number = len(self.items)
            self.items.append(item_id)
            length = min(size, len(words))
            hashes, _, begins = window_hashes(*flat_words([words]), length)
            for value, begin in zip(hashes.tolist(), begins.tolist()):
                content = b" ".join(words[begin : begin + length])
                known = self.windows[length].setdefault(value, [])
                for other, owners in known:
                    if other == content:
                        owners.add(number)
                        break
                else:
                    known.append((content, {number}))
        self.filters = {}
        for length, known in self.windows.items():
            bits = max(16, len(known).bit_length() + 4)
            bitmap = np.zeros(1 << bits, bool)
            bitmap[np.fromiter(known, np.uint64, len(known)) >> np.uint64(64 - bits)] = True
            self.filters[length] = (np.uint64(64 - bits), bitmap)

    def find(self, words: list[list[bytes]]) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set[int]]]:
        """Verified hits of a list of documents: word ranges and item numbers by document number."""
        ranges, owners = defaultdict(list), defaultdict(set)
        hashes, counts = flat_words(words)
        for length, (shift, bitmap) in self.filters.items():
            values, document, begin = window_hashes(hashes, counts, length)
            known = self.windows[length]
            for i in np.flatnonzero(bitmap[values >> shift]).tolist():
                for content, items in known.get(int(values[i]), ()):
                    number, start = int(document[i]), int(begin[i])
                    if b" ".join(words[number][start : start + length]) == content:
                        ranges[number].append((start, start + length))
                        owners[number] |= items
        return ranges, owners


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _without(text: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from the first to the last word of each span."""
    places = [m.span() for m in _WORD.finditer(text.translate(_NORMAL))]
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return (b"".join(kept) + text[at:]).decode()


def _scan(rows: DataFrame, ngrams, clean: bool) -> DataFrame:
    """Hit words and items of every document for one broadcast set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: NgramSet = pickle.loads(ngrams.value)
        for batch in slices(batches):
            texts = as_bytes(batch)
            words = [split_words(t) for t in texts]
            ranges, owners = known.find(words)
            spans = [_union(ranges[i]) if i in ranges else [] for i in range(len(words))]
            yield pa.RecordBatch.from_pydict({
                "key": batch.column("key"),
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array([len(w) for w in words], pa.int64()),
                "spans": pa.array(
                    [[{"start": a, "end": b} for a, b in s] for s in spans],
                    pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
                ),
                "items": pa.array([sorted({known.items[x] for x in owners[i]}) if i in owners else [] for i in range(len(words))], pa.list_(pa.string())),
                "clean": pa.array([_without(texts[i], s) if clean and s else None for i, s in enumerate(spans)], pa.string()),
            })

    return rows.select("key", "doc_id", "text").mapInArrow(run, SCAN_SCHEMA.format(id=dict(rows.dtypes)["doc_id"]))


def _shared(spark: SparkSession, block: NgramSet):
    """Broadcast a set together with its code."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(block))


def _blocks(benchmark: DataFrame, size: int, block_words: int, item_col: str, text_col: str) -> Iterator[NgramSet]:
    """The benchmark in blocks of about ``block_words`` words, each small enough to broadcast."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    items = items.where(F.col("item").isNotNull() & F.col("text").isNotNull())
    # No word is shorter than a byte and two words need a byte between them.
    words = items.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    count = max(1, int(-(-words // block_words)))
    for block in range(count):
        part = items if count == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == block)
        yield NgramSet(((r["item"], r["text"]) for r in part.toLocalIterator()), size)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW_WORDS,
    block_words: int = BLOCK_WORDS,
    clean: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document: ``key, doc_id, n_words, spans, items, clean``.

    ``spans`` are merged ranges of hit words, ``items`` the ids (as text) of items with an occurring window, ``clean`` the text
    without the spans (asked for with ``clean``, null where nothing was hit). A window is ``window`` consecutive words of an
    item; a shorter item is one window. Every hash hit is verified against the words. Null or word-less texts have no words;
    items without id or text are no items; rows of an item that occur twice count once; repeated documents are documents of
    their own; other columns of either table are not looked at.
    """
    return _found_in(keyed(docs, id_col, text_col), _blocks(benchmark, window, block_words, item_col, item_text_col), clean)


def _found_in(rows: DataFrame, blocks: Iterator[NgramSet], clean: bool) -> DataFrame:
    """:func:`contamination` of keyed rows."""
    spark = rows.sparkSession
    found = []
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return _scan(rows, _shared(spark, first), clean)
    for block in (first, second):
        found.append(_hits_of(spark, rows, block))
    for block in blocks:
        found.append(_hits_of(spark, rows, block))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    # A document has at most one row per block.
    together = hits.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("__spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("__items"))
    return _finish(rows.join(together, "key", "left"), clean)


def _hits_of(spark: SparkSession, rows: DataFrame, block: NgramSet) -> DataFrame:
    shared = _shared(spark, block)
    hits = cut_lineage(_scan(rows, shared, False).where(F.size("spans") > 0).select("key", "spans", "items"))
    shared.unpersist()
    release(spark)
    return hits


def _finish(joined: DataFrame, clean: bool) -> DataFrame:
    """Merge the ranges that several blocks found in a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = as_bytes(batch)
            spans = [_union([(s["start"], s["end"]) for s in found or ()]) for found in batch.column("__spans").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "key": batch.column("key"),
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array([len(split_words(t)) for t in texts], pa.int64()),
                "spans": pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "items": pa.array([x or [] for x in batch.column("__items").to_pylist()], pa.list_(pa.string())),
                "clean": pa.array([_without(t, s) if clean and s else None for t, s in zip(texts, spans)], pa.string()),
            })

    columns = joined.select("key", "doc_id", "text", "__spans", "__items")
    return columns.mapInArrow(run, SCAN_SCHEMA.format(id=dict(joined.dtypes)["doc_id"]))


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of :func:`contamination`, one row per document."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, **options) -> DataFrame:
    """The documents with hit words cut out; a document that has no word left is removed. All columns stay."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    spark = docs.sparkSession
    blocks = _blocks(
        benchmark, window, options.get("block_words", BLOCK_WORDS), options.get("item_col", "item_id"), options.get("item_text_col", "text")
    )
    first = next(blocks)
    second = next(blocks, None)
    schema, names = docs.schema, docs.columns

    def run_with(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: NgramSet = pickle.loads(shared.value)
            for batch in slices(batches, text_col):
                texts = as_bytes(batch, text_col)
                words = [split_words(t) for t in texts]
                ranges, _ = known.find(words)
                kept, new = [], batch.column(text_col).to_pylist()
                for i, found in ranges.items():
                    new[i] = _without(texts[i], _union(found))
                for i in range(len(new)):
                    kept.append(i not in ranges or bool(split_words(new[i].encode())))
                at = names.index(text_col)
                columns = list(batch.columns)
                columns[at] = pa.array(new, batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(kept))

        return run

    if second is None:
        return docs.mapInArrow(run_with(_shared(spark, first)), schema)
    # Hits are judged on the whole text, so the blocks' hits are merged before anything is cut. Rows are keyed once: numbers given
    # to null or repeated ids by another sort could differ.
    rows = keyed(docs, id_col, text_col, [c for c in names if c not in (id_col, text_col)])
    found = _found_in(rows, chain((first, second), blocks), True)
    marks = found.select("key", (F.size("spans") > 0).alias("__hit"), F.col("clean").alias("__clean"))
    joined = rows.join(marks, "key").withColumn("text", F.coalesce("__clean", "text"))
    joined = joined.where(~F.col("__hit") | (F.regexp_instr("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")) > 0))
    return joined.select(*[F.col({id_col: "doc_id", text_col: "text"}.get(c, f"also.`{c}`")).alias(c) for c in names])


SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
grams AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM grams),
windows AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM doc, lengths, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hits AS (SELECT doc_id, item_id, i, windows.n FROM windows JOIN grams ON windows.g = grams.g AND windows.n = grams.n),
hit_words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(j) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


@query("op7_benchmark_decontamination", SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return report(contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")))
