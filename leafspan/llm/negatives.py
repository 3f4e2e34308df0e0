"""Hard-negative mining: slot-decomposed selection of the best negatives inside the score window of every positive.

The windows of an anchor overlap. Their upper limits cut the scores into disjoint slots; tasks keep the best few rows of each
slot, the parts of all tasks are combined, and merging the slots from the lowest upwards gives the best rows under every
limit, from which each window takes those above its lower limit. Anchors are taken in packed blocks of bounded size; a block
is broadcast and meets all rows, so no vector is ever shuffled or paired by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspan.llm.common import Workspace, query, table
from leafspan.session import cut_lineage

POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100  # a window's limits, as per cent of the positive's score
SCALE = 256
# Vectors of the anchors that are broadcast together, scores that a task holds at once, and anchors whose parts meet in a group.
BLOCK_BYTES = 4_000_000
CELLS = 1_000_000
ANCHORS_PER_GROUP = 8

LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
PARTS = "part long, anchor binary, slot binary, score binary, id binary"


def quantised(vectors: pa.Array, scale: int = SCALE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, row numbers and matrix of floor(scale * x) of the rows without null or non-finite component."""
    rows = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)[rows].astype(np.int64)
    values = pc.fill_null(vectors.flatten(), float("nan")).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(rows)), lengths)
    good = np.bincount(owner[~np.isfinite(values)], minlength=len(rows)) == 0
    first = np.cumsum(lengths) - lengths
    for length in np.unique(lengths[good]).tolist():
        own = np.flatnonzero(good & (lengths == length))
        yield length, rows[own], np.floor(values[first[own][:, None] + np.arange(length)] * scale)


def inner_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer products of two matrices of whole numbers; a product that may pass a long is an error."""
    bound = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(1, left.shape[1])
    if bound < 2.0**53:
        return (left @ right.T).astype(np.int64)
    if bound < 2.0**63:
        return left.astype(np.int64) @ right.astype(np.int64).T
    raise OverflowError("inner products of these vectors do not fit a long")


class Best:
    """The best ``k`` (score, id) of each cell met so far: higher scores, then smaller ids; equal pairs count each."""

    def __init__(self, cells: int, k: int):
        self.k = k
        self.score = np.full((cells, k), LEAST, np.int64)
        self.id = np.full((cells, k), MOST, np.int64)

    def add(self, cell: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        last = self.score[cell, -1]
        enters = (score > last) | ((score == last) & (ids < self.id[cell, -1]))
        cell, score, ids = cell[enters], score[enters], ids[enters]
        if not len(cell):
            return
        met = np.unique(cell)
        cell = np.concatenate([cell, np.repeat(met, self.k)])
        score = np.concatenate([score, self.score[met].ravel()])
        ids = np.concatenate([ids, self.id[met].ravel()])
        order = np.lexsort((ids, ~score, cell))
        cell = cell[order]
        begins = np.searchsorted(cell, met)
        best = order[(begins[:, None] + np.arange(self.k)).ravel()]
        self.score[met], self.id[met] = score[best].reshape(-1, self.k), ids[best].reshape(-1, self.k)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cell, rank = np.nonzero((self.score != LEAST) | (self.id != MOST))
        return cell, self.score[cell, rank], self.id[cell, rank]


@dataclass
class Block:
    """Anchors that are compared together: ids, labels as text and, by length, row numbers and matrix."""

    ids: np.ndarray
    labels: list[str]
    vectors: dict[int, tuple[np.ndarray, np.ndarray]]

    def codes(self) -> tuple[list[str], np.ndarray]:
        names = sorted(set(self.labels))
        number = {name: i for i, name in enumerate(names)}
        return names, np.array([number[x] for x in self.labels], np.int64)


@dataclass
class Windows:
    """Descending distinct upper limits of each anchor (filled up with the least long) and its lowest lower limit."""

    upper: np.ndarray
    lowest: np.ndarray


def _blocks(rows: DataFrame, work: Workspace, block_bytes: int) -> DataFrame:
    """The anchors packed into rows of about ``block_bytes``: ``block, ids, labels, lengths, components``."""
    size = rows.agg(F.sum(8 * F.size("vector") + 16)).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, waiting = TaskContext.get().partitionId() << 32, [], 0

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "block": [number],
                "ids": [np.concatenate([h[0] for h in held]).tobytes()],
                "labels": [[x for h in held for x in h[1]]],
                "lengths": [np.concatenate([np.full(len(h[0]), h[2].shape[1], np.int64) for h in held]).tobytes()],
                "components": [b"".join(h[2].tobytes() for h in held)],
            })

        for batch in batches:
            for piece in _pieces(batch):
                for _, at, matrix in quantised(piece.column("vector")):
                    some = piece.take(pa.array(at))
                    held.append((some.column("id").to_numpy(), some.column("label").to_pylist(), matrix))
                    waiting += matrix.nbytes + 16 * len(at)
                    if waiting >= block_bytes:
                        yield packed()
                        number, held, waiting = number + 1, [], 0
        if held:
            yield packed()

    return work.keep(rows.repartition(int(-(-size // block_bytes)) or 1).mapInArrow(run, "block long, ids binary, labels array<string>, lengths binary, components binary"))


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with a bounded number of components."""
    longest = pc.max(pc.list_value_length(batch.column("vector"))).as_py() or 1
    step = max(1, CELLS // longest)
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def _unpacked(row) -> Block:
    ids, lengths = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lengths"], np.int64)
    data, first, vectors = np.frombuffer(row["components"], np.float64), np.cumsum(lengths) - lengths, {}
    for length in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == length)
        vectors[length] = own, data[first[own][:, None] + np.arange(length)]
    return Block(ids, list(row["labels"]), vectors)


def _selected(rows: DataFrame, block, windows, k: int, slots: int) -> DataFrame:
    """Each task's best ``k`` rows of every anchor and slot, packed by groups of anchors.

    Without ``windows`` those are the best rows of the anchor's own label, all in one slot; with them, of the other labels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = block.value
        limits = windows.value if windows else None
        names, codes = own.codes()
        best = Best(len(own.ids) * slots, k)
        for batch in batches:
            label = pc.fill_null(pc.index_in(batch.column("label"), pa.array(names, pa.string())), -1).to_numpy(zero_copy_only=False)
            ids = batch.column("id").to_numpy()
            at = 0
            for piece in _pieces(batch):
                for length, found, matrix in quantised(piece.column("vector")):
                    if length in own.vectors:
                        numbers, anchors = own.vectors[length]
                        step = max(1, CELLS // len(numbers))
                        for start in range(0, len(found), step):
                            row = found[start : start + step] + at
                            score = inner_products(anchors, matrix[start : start + step])
                            same = codes[numbers][:, None] == label[row][None, :]
                            if limits is None:
                                slot = None
                                fits = same & (own.ids[numbers][:, None] != ids[row][None, :])
                            else:
                                slot = sum((score <= limits.upper[numbers, j][:, None]).astype(np.int8) for j in range(slots)) - 1
                                fits = ~same & (slot >= 0) & (score >= limits.lowest[numbers][:, None])
                            x, y = np.nonzero(fits)
                            best.add(numbers[x] * slots + (0 if slot is None else slot[x, y].astype(np.int64)), score[x, y], ids[row[y]])
                at += piece.num_rows
        cell, score, ids = best.entries()
        anchor, slot = cell // slots, cell % slots
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(anchor // ANCHORS_PER_GROUP) != 0])) if len(anchor) else np.zeros(0, np.int64)
        out = {name: [] for name in ("part", "anchor", "slot", "score", "id")}
        for a, b in zip(cuts, np.append(cuts[1:], len(anchor))):
            out["part"].append(int(anchor[a]) // ANCHORS_PER_GROUP)
            for name, values in (("anchor", anchor), ("slot", slot), ("score", score), ("id", ids)):
                out[name].append(values[a:b].astype(np.int64).tobytes())
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("part", pa.int64()), *[(c, pa.binary()) for c in ("anchor", "slot", "score", "id")]]))

    return rows.mapInArrow(run, PARTS)


def _combined(part: pa.Table, k: int) -> dict[int, dict[int, list[tuple[int, int]]]]:
    """Of all tasks' parts, the best ``k`` (score, id) of each anchor and slot, best first."""
    anchor, slot, score, ids = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.int64) for c in ("anchor", "slot", "score", "id"))
    order = np.lexsort((ids, ~score, slot, anchor))
    found: dict[int, dict[int, list[tuple[int, int]]]] = {}
    for a, s, value, i in zip(anchor[order].tolist(), slot[order].tolist(), score[order].tolist(), ids[order].tolist()):
        held = found.setdefault(a, {}).setdefault(s, [])
        if len(held) < k:
            held.append((value, i))
    return found


def limits_of(score: int, low: int, high: int) -> tuple[int, int]:
    """Lowest and highest whole score of the window of a positive."""
    return -(-low * score // 100), high * score // 100


def suffix_best(slots: dict[int, list[tuple[int, int]]], count: int, k: int) -> list[list[tuple[int, int]]]:
    """For each slot, the best ``k`` of it and all slots under it; slots with higher numbers hold lower scores."""
    merged: list[list[tuple[int, int]]] = [[]] * (count + 1)
    for slot in range(count - 1, -1, -1):
        merged[slot] = (slots.get(slot, []) + merged[slot + 1])[:k]
    return merged[:count]


def hard_negatives(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | Column = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for every row for which ``anchors`` holds.

    A score is the inner product of the vectors' ``floor(scale * x)``; higher scores come first, ties by the smaller id. An
    anchor's positives are its best ``positives`` rows of the same label and another id, each with the best ``negatives`` rows of
    other labels whose score lies between ``low`` and ``high`` per cent of the positive's (none, where that score is negative).

    Rows with a null id, label, vector or component, or a non-finite component, take no part. Vectors meet those of their own
    length only; empty vectors score 0. Repeated rows count each: a repeated anchor gives its rows again, a repeated candidate
    takes a rank for every copy. An empty table, or one without anchors, gives no rows; other columns are not looked at.
    Scores beyond 63 bits stop the run.
    """
    spark = vectors.sparkSession
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    all_rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"), anchors.alias("anchor"),
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
    rows = all_rows.drop("anchor")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    work = Workspace(spark)
    blocks = _blocks(all_rows.where("anchor").drop("anchor"), work, block_bytes)
    paths = []
    for row in blocks.select("block").collect():
        block = _unpacked(blocks.where(F.col("block") == row["block"]).first())
        paths.append(_mined(rows, block, work, positives, negatives, low, high, schema))
    if not paths:
        work.close()
        return spark.createDataFrame([], schema)
    found = cut_lineage(spark.read.schema(schema).parquet(*paths))
    work.close()
    return found


def _mined(rows: DataFrame, block: Block, work: Workspace, positives: int, negatives: int, low: int, high: int, schema: str) -> str:
    """Mine for one block of anchors; the path of its table."""
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(block)

    def best(part: pa.Table) -> pa.Table:
        flat = [(a, s, i) for a, slots in _combined(part, positives).items() for s, i in slots[0]]
        return pa.table({name: pa.array([x[n] for x in flat], pa.int64()) for n, name in enumerate(("anchor", "score", "id"))})

    found = _selected(rows, shared, None, positives, 1).groupBy("part").applyInArrow(best, "anchor long, score long, id long").collect()
    chosen: dict[int, list[tuple[int, int]]] = {}
    for r in sorted(found, key=lambda r: (r["anchor"], -r["score"], r["id"])):
        chosen.setdefault(r["anchor"], []).append((r["score"], r["id"]))
    upper = np.full((len(block.ids), positives), LEAST, np.int64)
    lowest = np.full(len(block.ids), MOST, np.int64)
    slot_of: dict[int, dict[int, int]] = {}
    for a, own in chosen.items():
        windows = [limits_of(s, low, high) for s, _ in own]
        tops = sorted({u for l, u in windows if l <= u}, reverse=True)
        slot_of[a] = {u: n for n, u in enumerate(tops)}
        upper[a, : len(tops)] = tops
        lowest[a] = min((l for l, u in windows if l <= u), default=MOST)
    limits = context.broadcast(Windows(upper, lowest))
    wanted = context.broadcast((block.ids, chosen, slot_of))

    def windows_of(part: pa.Table) -> pa.Table:
        ids, positives_of, numbers = wanted.value
        out = []
        for a, slots in _combined(part, negatives).items():
            merged = suffix_best(slots, len(numbers[a]), negatives)
            for score, positive in positives_of[a]:
                l, u = limits_of(score, low, high)
                under = merged[numbers[a][u]] if l <= u else []
                out += [(int(ids[a]), positive, n, i, score, s) for n, (s, i) in enumerate((x for x in under if x[0] >= l), 1)]
        columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        return pa.table({c: pa.array([x[n] for x in out], pa.int32() if c == "rank" else pa.int64()) for n, c in enumerate(columns)})

    work.keep(_selected(rows, shared, limits, negatives, positives).groupBy("part").applyInArrow(windows_of, schema))
    for sent in (shared, limits, wanted):
        sent.destroy()
    return f"{work.folder}/{work.number}"


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_inner_product(a.q, r.q)::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id AND len(a.q) = len(r.q)),
pos AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.id AS positive_id,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank,
    n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM pos p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 100 * n.score BETWEEN 80 * p.score AND 100 * p.score)
SELECT * FROM ranked WHERE rank <= 5
"""


@query("op11_hard_negatives", SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, folder, "embeddings"), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)), label_col=label)
