"""Suffix-array dedup of byte strings with a logarithmic family of indexes.

Suffixes are sampled by content: of the grams (a third of the match length) in a window of the match length, the one with the
least hash is the window's anchor. Consecutive windows with one anchor form a zone; a text has a zone for about every third
of the match length, and equal windows always lie in zones with equal anchors. A batch's suffix array holds its zones in the
order of their anchor's suffix (first bytes, gram, whole zone), cut into buckets by gram.

A new batch is merge-scanned with every level of the family. A zone found whole at an earlier place is a match in all its
windows; where an anchor occurs in different zones, its windows are compared one by one, as are those of a zone in which its anchor recurs. Then the batch becomes the smallest
level, and levels of equal size are merged, so that a suffix is rewritten a logarithmic number of times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspan.llm.common import (
    Places, as_bytes, bucket_count, by_bucket, key_bucket, keyed, later_copies, merged, mix, pack_ints, query, release, slices, table,
    unpack_ints, worker_state,
)
from leafspan.session import cut_lineage

MATCH_BYTES = 100
BATCHES = 4
SLICE = 1_000_000
FLUSH_ZONES = 400_000
FLUSH_WINDOWS = 1_000_000
# Different zones of one anchor that a flush sends to the anchor's bucket. Beyond it the anchor is known to occur in different
# zones: a mark goes there, and all of them are compared window by window, which is spread by window.
ZONES_PER_ANCHOR = 64

SUFFIXES, FLAGGED, DOUBTFUL = 0, 1, 2
NAMES = ["kind", "bucket", "base", "keys", "at", "n", "anchor", "head", "sides", "gram", "zone"]
SCHEMA = pa.schema([
    ("kind", pa.int32()), ("bucket", pa.int64()), ("base", pa.int64()), *[(n, pa.binary()) for n in NAMES[3:]],
])
ROWS = "kind int, bucket long, base long, keys binary, at binary, n binary, anchor binary, head binary, sides binary, gram binary, zone binary"


class Powers:
    """Powers of the hash base and of its inverse, modulo 2^64, and a random value for each byte."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)
        self.values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", self.BASE), ("down", pow(self.BASE, -1, 1 << 64))):
                powers = np.full(n, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers))

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        self.grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=out[1:])
        return out

    def between(self, prefixes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefixes[end] - prefixes[start]) * self.down[start])


def _powers() -> Powers:
    return worker_state("powers", Powers)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def zones_of(texts: list[bytes], match: int) -> dict[str, np.ndarray] | None:
    """Zones of a list of texts: whether windows of the zone may be equal, document number, first window, number of windows,
    and of the anchor its place, first bytes, hashes of the sides and of the gram, and the hash of the whole zone."""
    gram = max(1, match // 3)
    width = match - gram + 1
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    windows = len(data) - match + 1
    if windows <= 0:
        return None
    offsets = np.cumsum(lengths) - lengths
    long = lengths >= match
    edge = np.zeros(windows + 1, np.int32)
    np.add.at(edge, offsets[long], 1)
    np.add.at(edge, (offsets + lengths - match + 1)[long], -1)
    valid = np.cumsum(edge[:-1]) > 0
    powers = _powers()
    prefixes = powers.prefixes(data)
    # The hash of every gram, without gathers.
    grams = mix((prefixes[gram:] - prefixes[:-gram]) * powers.down[: len(prefixes) - gram])
    least = sliding_least(grams, width)
    first = np.zeros(windows, bool)
    first[offsets[long]] = True
    first[1:] |= (least[1:] != least[:-1]) | ~valid[:-1]
    first[0] = True
    first &= valid
    follows = np.append(first[1:] | ~valid[1:], True) & valid
    start, end = np.flatnonzero(first), np.flatnonzero(follows) + 1
    if not len(start):
        return None
    hashes = least[start]
    anchor = np.full(len(start), -1, np.int64)
    for step in range(width):
        open_ = anchor < 0
        anchor[open_ & (grams[start + step] == hashes)] = step
    anchor += start
    # Where the gram occurs twice in a zone's windows, these may equal one another.
    last, found = end - 1, np.zeros(len(start), np.int32)
    for step in range(width):
        found += grams[last + step] == hashes
    padded = np.append(data, np.zeros(4, np.uint8))
    head = np.zeros(len(start), np.uint32)
    for step in range(4):
        head = (head << np.uint32(8)) | padded[anchor + step]
    document = np.searchsorted(offsets, start, side="right") - 1
    # Half of what a window has besides the gram: at least so many bytes of it lie on one side of the gram.
    beside = (match - gram + 1) // 2
    low, high = anchor - beside, anchor + gram + beside
    sides = np.zeros(len(start), np.uint32)
    for inside, begin, end_, shift in (
        (low >= offsets[document], low, anchor, 16), (high <= (offsets + lengths)[document], anchor + gram, high, 0),
    ):
        # Zero stands for a side that the text is too short for.
        short = powers.between(prefixes, begin[inside], end_[inside]) >> np.uint64(48)
        sides[inside] |= np.maximum(short, np.uint64(1)).astype(np.uint32) << np.uint32(shift)
    # Windows of a periodic zone may have another occurrence of the gram than the one whose sides these are. No other zone has
    # zero on both sides, since its text is at least a window long.
    periodic = (found > 1) | (anchor < last)
    sides[periodic] = 0
    zone = mix(powers.between(prefixes, start, end - 1 + match) + (end - start).astype(np.uint64))
    return {"periodic": periodic, "document": document, "at": start - offsets[document], "n": end - start, "anchor": anchor - start, "head": head, "sides": sides, "gram": hashes, "zone": zone}


class Suffixes:
    """A part of a suffix array: places with their anchor's first bytes, gram and zone, as numpy columns."""

    COLUMNS = ("key", "at", "n", "anchor", "head", "sides", "gram", "zone")

    def __init__(self, key, at, n, anchor, head, sides, gram, zone):
        self.key, self.at, self.n, self.anchor = key, at, n, anchor
        self.head, self.sides, self.gram, self.zone = head, sides, gram, zone

    @staticmethod
    def bare(key, at, n) -> Suffixes:
        empty = np.zeros(len(key), np.uint32)
        return Suffixes(key, at, n, empty, empty, empty, empty, empty)

    def __len__(self) -> int:
        return len(self.key)

    def take(self, rows) -> Suffixes:
        return Suffixes(*(getattr(self, c)[rows] for c in self.COLUMNS))

    def sorted(self) -> Suffixes:
        """In the order of suffix and then of place."""
        return self.take(np.lexsort((self.at, self.key, self.zone, self.gram, self.head)))

    def row(self, kind: int, bucket: int) -> tuple:
        base = int(self.key.min())
        bare = kind != SUFFIXES
        return (
            kind, bucket, base, pack_ints(self.key - base), pack_ints(self.at), pack_ints(self.n),
            None if bare else pack_ints(self.anchor),
            *(None if bare else getattr(self, c).tobytes() for c in ("head", "sides", "gram", "zone")),
        )

    def rows(self, kind: int, bucket: np.ndarray) -> list[tuple]:
        return [self.take(own).row(kind, number) for number, own in by_bucket(bucket)]

    @staticmethod
    def together(parts: list[Suffixes]) -> Suffixes:
        return Suffixes(*(np.concatenate([getattr(p, c) for p in parts]) for c in Suffixes.COLUMNS))

    @staticmethod
    def of(part: pa.Table) -> Suffixes:
        """Every place of the rows of a table; bare rows get zeros for what they lack."""
        columns = {c: part.column(c).to_pylist() for c in NAMES[2:]}
        if not part.num_rows:
            return Suffixes(*(np.zeros(0, t) for t in 4 * [np.int64] + 2 * [np.uint32] + 2 * [np.uint64]))
        at = [unpack_ints(x) for x in columns["at"]]
        raw = [
            np.concatenate([np.frombuffer(x, t) if x is not None else np.zeros(len(a), t) for x, a in zip(columns[c], at)])
            for c, t in (("head", np.uint32), ("sides", np.uint32), ("gram", np.uint64), ("zone", np.uint64))
        ]
        anchor = np.concatenate([unpack_ints(x) if x is not None else np.zeros(len(a), np.int64) for x, a in zip(columns["anchor"], at)])
        keys = np.concatenate([unpack_ints(x) + b for x, b in zip(columns["keys"], columns["base"])])
        return Suffixes(keys, np.concatenate(at), np.concatenate([unpack_ints(x) for x in columns["n"]]), anchor, *raw)

    def repeats(self) -> np.ndarray:
        """In sorted order: whether the suffix before has the same zone."""
        return np.concatenate([[False], (self.gram[1:] == self.gram[:-1]) & (self.zone[1:] == self.zone[:-1])])


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({name: [r[i] for r in rows] for i, name in enumerate(NAMES)}, schema=SCHEMA)


def _class_sizes(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of sorted grams, how often it occurs and how many of it are before."""
    cuts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    sizes = np.diff(np.append(cuts, len(gram)))
    return np.repeat(sizes, sizes), np.arange(len(gram)) - np.repeat(cuts, sizes)


def _suffix_arrays(rows: DataFrame, match: int, buckets: int) -> DataFrame:
    """Suffix arrays of a batch by bucket, with the places already found in the task that made them."""

    def flush(held: list[Suffixes]) -> pa.RecordBatch:
        array = Suffixes.together(held).sorted()
        again = array.repeats()
        out = array.take(again).rows(FLAGGED, key_bucket(array.key[again], buckets)) if again.any() else []
        array = array.take(~again)
        size, before = _class_sizes(array.gram)
        crowded = size > ZONES_PER_ANCHOR
        if crowded.any():
            out += array.take(crowded).rows(DOUBTFUL, key_bucket(array.key[crowded], buckets))
            # A mark without windows stands for the crowded anchor.
            marks = array.take(crowded & (before < 1))
            marks.n, marks.zone = np.zeros(len(marks), np.int64), np.zeros(len(marks), np.uint64)
            array = Suffixes.together([array.take(~crowded), marks]).sorted()
        return _batch_of(out + array.rows(SUFFIXES, (array.gram % np.uint64(buckets)).astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in slices(batches, limit=SLICE):
            found = zones_of(as_bytes(batch), match)
            if found is not None:
                periodic = found.pop("periodic")
                keys = batch.column("key").to_numpy()[found.pop("document")]
                held.append(Suffixes(keys, **found))
                if periodic.any():
                    own = held[-1].take(periodic)
                    yield _batch_of(own.rows(DOUBTFUL, key_bucket(own.key, buckets)))
                waiting += len(keys)
            if waiting >= FLUSH_ZONES:
                yield flush(held)
                held, waiting = [], 0
        if held:
            yield flush(held)

    return rows.select("key", "text").mapInArrow(run, ROWS)


def _shared(array: Suffixes, value: np.ndarray) -> np.ndarray:
    """Which suffixes have another of the same gram with the same value; zero is no value."""
    order = np.lexsort((value, array.gram))
    gram, value = array.gram[order], value[order]
    same = (gram[1:] == gram[:-1]) & (value[1:] == value[:-1]) & (value[1:] > 0)
    out = np.zeros(len(order), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _doubtful(array: Suffixes, new: np.ndarray, match: int) -> Suffixes:
    """Windows that may occur in another zone of their anchor, of anchors that the batch has.

    A window has at least half of its other bytes on one side of the gram, so a zone that shares neither side with another one
    has no such window, and one that shares only one side has them on that side. Anchors crowded in a task, and those with a
    periodic zone, are compared whole.
    """
    size, before = _class_sizes(array.gram)
    number = np.cumsum(before == 0) - 1
    fresh = (size > 1) & (np.bincount(number, new)[number] > 0)
    array, size = array.take(fresh), size[fresh]
    if not len(array):
        return array
    gram = max(1, match // 3)
    beside = (match - gram + 1) // 2
    whole = np.bincount(number[fresh], (array.n == 0) | (array.sides == 0))[number[fresh]] > 0
    left = _shared(array, array.sides >> np.uint32(16)) | whole
    right = _shared(array, array.sides & np.uint32(0xFFFF)) | whole
    first = np.where(left, 0, np.maximum(0, array.anchor + gram + beside - match))
    last = np.where(right, array.n - 1, np.minimum(array.n - 1, array.anchor - beside))
    keep = (left | right) & (first <= last) & (array.n > 0)
    return Suffixes.bare((array.key)[keep], (array.at + first)[keep], (last - first + 1)[keep])


def _merge_scan(buckets: int, after: int, match: int):
    """Scan a bucket of a batch (keys from ``after`` on) against the levels; what is new in it is its part of the new level."""

    def run(part: pa.Table) -> pa.Table:
        arrays = pc.equal(part.column("kind"), SUFFIXES)
        ready = part.filter(pc.invert(arrays)).select(NAMES).cast(SCHEMA)
        array = Suffixes.of(part.filter(arrays)).sorted()
        if not len(array):
            return ready
        new = array.key >= after
        again = array.repeats()
        found = again & new & (array.n > 0)
        out = array.take(found).rows(FLAGGED, key_bucket(array.key[found], buckets)) if found.any() else []
        array, new = array.take(~again), new[~again]
        doubt = _doubtful(array, new, match)
        if len(doubt):
            out += doubt.rows(DOUBTFUL, key_bucket(doubt.key, buckets))
        if new.any():
            out.append(array.take(new).row(SUFFIXES, part.column("bucket")[0].as_py()))
        return pa.concat_tables([ready, pa.Table.from_batches([_batch_of(out)])])

    return run


def _merge_levels(part: pa.Table) -> pa.Table:
    row = Suffixes.of(part).sorted().row(SUFFIXES, part.column("bucket")[0].as_py())
    return pa.Table.from_batches([_batch_of([row])])


class SuffixIndexes:
    """A family of suffix-array levels with sizes that double; batches come in the order of their keys."""

    def __init__(self, spark: SparkSession, match: int, buckets: int):
        self.spark, self.match, self.buckets = spark, match, buckets
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, batch: DataFrame, after: int) -> DataFrame:
        """Scan a batch whose keys start at ``after``, make it a level, and return the places found or in doubt."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, one), (_, other) = self.levels.pop(), self.levels.pop()
            merged_level = cut_lineage(one.unionByName(other).groupBy("bucket").applyInArrow(_merge_levels, ROWS))
            self.levels.append((2 * size, merged_level))
            del one, other, merged_level
            release(self.spark)
        together = _suffix_arrays(batch, self.match, self.buckets)
        for _, level in self.levels:
            together = together.unionByName(level)
        scanned = cut_lineage(together.groupBy("bucket").applyInArrow(_merge_scan(self.buckets, after, self.match), ROWS))
        self.levels.append((1, scanned.where(F.col("kind") == SUFFIXES)))
        # Kept apart, so that the batch's own copy goes when its level is merged.
        found = cut_lineage(scanned.where(F.col("kind") != SUFFIXES))
        del together
        release(self.spark)
        return found


def _doubtful_places(part: pa.Table) -> pa.Table:
    """Per document, the doubtful windows as disjoint runs, of a first window and a number of windows."""
    zones = Suffixes.of(part)
    order = np.lexsort((zones.at, zones.key))
    key, at, end = zones.key[order], zones.at[order], (zones.at + zones.n)[order]
    owner = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) << 40
    reach = np.maximum.accumulate(owner + end)
    first = np.flatnonzero(np.concatenate([[True], (owner + at)[1:] > reach[:-1]]))
    n = (reach - owner)[np.append(first[1:], len(key)) - 1] - at[first]
    key, at = key[first], at[first]
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    ends = np.append(cuts[1:], len(key))
    return pa.table({
        "key": pa.array(key[cuts]),
        "at": pa.array([pack_ints(at[a:b]) for a, b in zip(cuts, ends)], pa.binary()),
        "n": pa.array([pack_ints(n[a:b]) for a, b in zip(cuts, ends)], pa.binary()),
    })


def spread(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``at, at + 1 ... at + n - 1`` for each pair."""
    return np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


WINDOWS = "kind int, bucket long, base long, keys binary, counts binary, at binary, one binary, two binary"
WINDOW_SCHEMA = pa.schema([
    ("kind", pa.int32()), ("bucket", pa.int64()), ("base", pa.int64()), *[(n, pa.binary()) for n in ("keys", "counts", "at", "one", "two")],
])


def _runs(keys: np.ndarray, at: np.ndarray, buckets: int) -> list[tuple]:
    """Single windows of documents as rows of kind FLAGGED with runs of windows."""
    order = np.lexsort((at, keys))
    keys, at = keys[order], at[order]
    cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (at[1:] != at[:-1] + 1)]))
    n = np.diff(np.append(cuts, len(keys)))
    runs = Suffixes.bare(keys[cuts], at[cuts], n)
    return runs.rows(FLAGGED, key_bucket(runs.key, buckets))


def _window_blocks(joined: DataFrame, match: int, buckets: int) -> DataFrame:
    """96-bit hashes of all windows of the doubtful zones, by bucket of the hash."""

    def flush(held) -> pa.RecordBatch:
        keys, at, one, two = (np.concatenate([h[i] for h in held]) for i in range(4))
        later = later_copies(one, keys, at, two)
        out = []
        for row in _runs(keys[later], at[later], buckets) if later.any() else []:
            out.append((FLAGGED, row[1], row[2], row[3], row[5], row[4], None, None))
        keys, at, one, two = keys[~later], at[~later], one[~later], two[~later]
        for number, own in by_bucket(two.astype(np.int64) % buckets):
            base, packed, counts, places = Places.pack(keys[own], at[own])
            out.append((DOUBTFUL, number, base, packed, counts, places, one[own].tobytes(), two[own].tobytes()))
        names = WINDOW_SCHEMA.names
        return pa.RecordBatch.from_pydict({n: [r[i] for r in out] for i, n in enumerate(names)}, schema=WINDOW_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, waiting = _powers(), [], 0
        for batch in slices(batches, limit=SLICE):
            texts = as_bytes(batch)
            data = np.frombuffer(b"".join(texts), np.uint8)
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            places = [spread(unpack_ints(a), unpack_ints(n)) for a, n in zip(batch.column("at").to_pylist(), batch.column("n").to_pylist())]
            counts = np.fromiter(map(len, places), np.int64, len(places))
            at = np.concatenate(places)
            start = at + np.repeat(np.cumsum(lengths) - lengths, counts)
            prefixes = powers.prefixes(data)
            one = powers.between(prefixes, start, start + match)
            half = start + match // 2
            two = mix(powers.between(prefixes, start, half) * np.uint64(3) + powers.between(prefixes, half, start + match))
            two = (two >> np.uint64(32)).astype(np.uint32)
            held.append((np.repeat(batch.column("key").to_numpy(), counts), at, one, two))
            waiting += len(at)
            if waiting >= FLUSH_WINDOWS:
                yield flush(held)
                held, waiting = [], 0
        if held:
            yield flush(held)

    return joined.select("key", "text", "at", "n").mapInArrow(run, WINDOWS)


def _resolve_windows(buckets: int):
    def run(part: pa.Table) -> pa.Table:
        blocks = part.filter(pc.equal(part.column("kind"), DOUBTFUL))
        ready = part.filter(pc.equal(part.column("kind"), FLAGGED))
        out = [
            (FLAGGED, r["bucket"], r["base"], r["keys"], r["at"], r["counts"], None, None, None, None, None)
            for r in ready.select(["bucket", "base", "keys", "at", "counts"]).to_pylist()
        ]
        if blocks.num_rows:
            keys, at = Places.unpack_all(blocks)
            one, two = (np.frombuffer(b"".join(blocks.column(c).to_pylist()), t) for c, t in (("one", "<u8"), ("two", "<u4")))
            later = later_copies(one, keys, at, two)
            if later.any():
                out += _runs(keys[later], at[later], buckets)
        return pa.Table.from_batches([_batch_of(out)])

    return run


def _ranges(match: int):
    """Per document, the union of the bytes of all found windows."""

    def run(part: pa.Table) -> pa.Table:
        places = Suffixes.of(part)
        order = np.lexsort((places.at, places.key))
        key, start = places.key[order], places.at[order]
        end = start + places.n[order] - 1 + match
        keys, removed = [], []
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        for a, b in zip(cuts, np.append(cuts[1:], len(key))):
            keys.append(int(key[a]))
            removed.append([{"start": x, "end": y} for x, y in merged(start[a:b], end[a:b])])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"key": pa.array(keys, pa.int64()), "removed": pa.array(removed, kind)})

    return run


def repeated_bytes(rows: DataFrame, match: int = MATCH_BYTES, batches: int = BATCHES) -> DataFrame:
    """``key, removed`` for every document with bytes in a ``match``-byte string that also starts earlier."""
    spark = rows.sparkSession
    buckets = bucket_count(rows)
    cuts = rows.stat.approxQuantile("key", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    bounds = sorted({int(c) for c in cuts})
    family, found = SuffixIndexes(spark, match, buckets), None
    low = -(1 << 63)
    for high in [*bounds, None]:
        batch = rows.where(F.col("key") >= low) if high is None else rows.where((F.col("key") >= low) & (F.col("key") < high))
        places = family.add(batch, low)
        found = places if found is None else found.unionByName(places)
        low = high
    del family, places
    found = cut_lineage(found)
    release(spark)
    doubtful = cut_lineage(
        found.where(F.col("kind") == DOUBTFUL).groupBy("bucket").applyInArrow(_doubtful_places, "key long, at binary, n binary")
    )
    windows = _window_blocks(rows.join(doubtful, "key"), match, buckets)
    resolved = cut_lineage(windows.groupBy("bucket").applyInArrow(_resolve_windows(buckets), ROWS))
    flagged = found.where(F.col("kind") == FLAGGED).unionByName(resolved)
    ranges = cut_lineage(flagged.groupBy("bucket").applyInArrow(_ranges(match), "key long, removed array<struct<start:long,end:long>>"))
    del found, doubtful, windows, resolved, flagged
    release(spark)
    return ranges


def remove_repeated_bytes(
    docs: DataFrame, match: int = MATCH_BYTES, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, removed, kept`` (the remaining bytes, which may cut a character).

    A byte of the UTF-8 text goes where a string of ``match`` bytes covers it that also starts earlier: in a smaller id (null ids
    first, equal ids in the order of a hash of the text) or earlier in the document. Null and empty texts have no bytes, shorter
    texts than ``match`` stay whole, overlapping repeats count, repeated rows are documents of their own, an empty table gives no
    rows, other columns are not looked at.
    """
    rows = keyed(docs, id_col, text_col)
    joined = rows.join(repeated_bytes(rows, match, batches), "key", "left")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(parts):
            texts, removed = as_bytes(batch), batch.column("removed").to_pylist()
            kept = []
            for text, ranges in zip(texts, removed):
                left, at = [], 0
                for r in ranges or ():
                    left.append(text[at : r["start"]])
                    at = r["end"]
                kept.append(b"".join(left) + text[at:])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                "n_removed": pa.array([len(t) - len(k) for t, k in zip(texts, kept)], pa.int64()),
                "removed": batch.column("removed"),
                "kept": pa.array(kept, pa.binary()),
            })

    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept binary"
    return joined.select("doc_id", "text", "removed").mapInArrow(run, schema)


SQL = """
WITH doc AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (
  SELECT doc_id, i, substring(h, 2 * i + 1, 200) AS g FROM doc, unnest(range(0, length(h) // 2 - 99)) AS t(i) WHERE length(h) >= 200),
flagged AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
runs AS (
  SELECT doc_id, i, i > coalesce(max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 100, -1)
    AS fresh FROM flagged),
numbered AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM runs),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM numbered GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, run, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY run) AS before FROM spans),
kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS tail,
    string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY run) AS h FROM pieces JOIN doc USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(doc.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept.h, '') || substring(doc.h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""


@query("op6_suffix_array_dedup", SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, folder, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
