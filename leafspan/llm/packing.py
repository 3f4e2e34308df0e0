"""Best-fit decreasing packing of tokenised documents into sequences of a fixed capacity.

Lengths are integers up to the capacity, so the packing is planned on the histogram of lengths: a segment tree over remaining
capacities finds the tightest open sequences for each length in logarithmic time, and sequences with equal remaining capacity
are filled together. The plan is what the document-by-document method gives, and its size depends on the capacity, not on the
number of documents. Documents find their place by their rank among pieces of equal length, counted per partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafspan.llm.common import as_bytes, query, slices, table, worker_state
from leafspan.llm.tokens import WordBpe
from leafspan.session import cut_lineage

CAPACITY = 4096
END_ID = 1
# Bytes of text encoded at once: larger slices hold fewer distinct words in all.
SLICE = 3_000_000


class CapacityTree:
    """Segment tree over remaining capacities; a leaf is set while sequences with that capacity are open."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.full = [False] * (2 * self.leaves)

    def set(self, at: int, value: bool) -> None:
        at += self.leaves
        self.full[at] = value
        while at > 1:
            at //= 2
            self.full[at] = self.full[2 * at] or self.full[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest open capacity that is at least ``least``."""
        at = least + self.leaves
        if self.full[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.full[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.full[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


@dataclass(frozen=True)
class Run:
    """Pieces of one length, ``count`` from rank ``rank`` on, go ``each`` to a sequence from ``sequence`` on, at ``base``."""

    length: int
    rank: int
    count: int
    sequence: int
    each: int
    base: int


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """Best-fit decreasing over ``counts`` pieces of each length; the runs and the number of sequences."""
    tree, open_, runs, sequences = CapacityTree(capacity), {}, [], 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            open_.setdefault(left, []).append((first, n))
            tree.set(left, True)

    for length in sorted(counts, reverse=True):
        rank, waiting = 0, counts[length]
        while waiting:
            room = tree.tightest(length)
            if room is None:
                room, n = capacity, -(-waiting // (capacity // length))
                first, sequences = sequences, sequences + n
            else:
                first, n = open_[room].pop()
                if not open_[room]:
                    tree.set(room, False)
            each, base = room // length, capacity - room
            filled = min(n, waiting // each)
            if filled:
                runs.append(Run(length, rank, filled * each, first, each, base))
                put(room - each * length, first, filled)
                rank, waiting = rank + filled * each, waiting - filled * each
            if filled < n and waiting:
                runs.append(Run(length, rank, waiting, first + filled, waiting, base))
                put(room - waiting * length, first + filled, 1)
                filled, waiting = filled + 1, 0
            put(room, first + filled, n - filled)
    return runs, sequences


PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long, __part int, __rank long"


def token_pieces(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document, with their partition and their rank of their length in it."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_state(f"word_bpe {vocabulary}", lambda: WordBpe(vocabulary))
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, limit=SLICE):
            coded = [ids + end for ids in bpe.encode(as_bytes(batch))]
            places, pieces, starts, lengths, sums, ranks, ids = [], [], [], [], [], [], []
            for i, data in enumerate(coded):
                for number, at in enumerate(range(0, len(data), 4 * capacity)):
                    cut = data[at : at + 4 * capacity]
                    length = len(cut) // 4
                    places.append(i)
                    pieces.append(number)
                    starts.append(at // 4)
                    lengths.append(length)
                    sums.append(zlib.crc32(cut))
                    ranks.append(int(seen[length]))
                    seen[length] += 1
                    if with_ids:
                        ids.append(cut)
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(places, pa.int64())),
                "piece": pa.array(pieces, pa.int32()),
                "start": pa.array(starts, pa.int64()),
                "length": pa.array(lengths, pa.int64()),
                "ids_crc32": pa.array(sums, pa.int64()),
                "__part": pa.array([part] * len(pieces), pa.int32()),
                "__rank": pa.array(ranks, pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array(ids, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, PIECES.format(id=dict(rows.dtypes)["doc_id"]) + (", ids binary" if with_ids else ""))


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pack all documents into as few sequences as best-fit decreasing needs; one row per piece.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, with ``with_ids``, ``ids`` (little-endian
    unsigned 32-bit). A document is its ids and ``end_id``; only one longer than ``capacity`` is cut. A null or empty text is
    a piece that holds ``end_id`` alone; pieces of equal length take places in the order of their partitions; repeated rows
    are packed each, a null ``doc_id`` stays null, an empty table gives no rows, other columns are not looked at.
    """
    pieces = cut_lineage(token_pieces(docs, vocabulary, capacity, end_id, with_ids, id_col, text_col))
    counts = pieces.groupBy("length", "__part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "__part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    # At most one row for each possible length.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = best_fit_plan(histogram, capacity)
    runs.sort(key=lambda r: (r.length, r.rank))
    at = np.array([(r.length << 48) + r.rank for r in runs], np.int64)
    rank, sequence, each, base = (np.array([getattr(r, f) for r in runs], np.int64) for f in ("rank", "sequence", "each", "base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            mine = batch.column("__rank").to_numpy() + batch.column("__before").to_numpy()
            run = np.searchsorted(at, (length << 48) + mine, side="right") - 1
            nth = mine - rank[run]
            columns = {n: batch.column(n) for n in batch.schema.names if not n.startswith("__")}
            columns["sequence_id"] = pa.array(sequence[run] + nth // each[run])
            columns["offset"] = pa.array(base[run] + nth % each[run] * length)
            yield pa.RecordBatch.from_pydict(columns)

    ids = ", ids binary" if with_ids else ""
    schema = PIECES.format(id=dict(pieces.dtypes)["doc_id"]).split(", __part")[0] + ids + ", sequence_id long, offset long"
    return pieces.join(counts.drop("n"), ["length", "__part"]).select(*pieces.columns, "__before").mapInArrow(place, schema)


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_best_fit_packing")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_vocabulary())
