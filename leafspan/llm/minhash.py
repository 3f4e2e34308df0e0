"""Near-duplicate detection: ProbMinHash signatures of weighted word shingles, banding, and exact verification.

Each shingle of a document emits exponential arrivals at a rate that grows with its count; an arrival goes to a random register,
which keeps the shingle of its earliest arrival. A shingle stops as soon as its next arrival is later than every register.
Two documents agree in a register with the probability Jaccard similarity of their weighted shingles.

Documents that agree in all registers of a band are candidates. First every member of a bucket is compared with the bucket's
first one, and links join components; that settles most buckets. In those that still hold several components, the shingles that
only one of the remaining texts has are counted: they lie outside every intersection, so a text of which more than a fifth is
its own cannot be linked and leaves. What remains is compared in blocks of bounded size: a task intersects the sets of two blocks
of a bucket and returns only links that join components, so no pairs are made into rows, and every member meets every other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspan.llm.common import Workspace, as_bytes, flat_words, keyed, mix, query, release, slices, table, window_hashes
from leafspan.session import cut_lineage

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
# A block has about so many texts of a bucket and so many shingles at most; a longer text is a block of its own size.
BLOCK_TEXTS, BLOCK_SHINGLES = 512, 1_000_000


def shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a list of documents, in order of document and hash: document number, hash and count.

    A document of fewer words than ``size``, but not none, is one shingle.
    """
    words = [t.split() for t in texts]
    hashes, counts = flat_words(words)
    parts = []
    values, document, _ = window_hashes(hashes, counts, size)
    parts.append((document, values))
    for n in range(1, size):
        short = counts == n
        if short.any():
            first = (np.cumsum(counts) - counts)[short]
            rolled = np.full(len(first), n, np.uint64)
            for i in range(n):
                rolled = mix(rolled ^ hashes[first + i])
            parts.append((np.flatnonzero(short), rolled))
    document, values = (np.concatenate([p[i] for p in parts]) for i in range(2))
    order = np.lexsort((values, document))
    document, values = document[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], (document[1:] != document[:-1]) | (values[1:] != values[:-1])])) if len(order) else order
    return document[first], values[first], np.diff(np.append(first, len(order)))


def signatures(document: np.ndarray, values: np.ndarray, counts: np.ndarray, documents: int, registers: int) -> np.ndarray:
    """ProbMinHash registers of each document (a row each); rows of documents without shingles are zero."""
    earliest = np.full(documents * registers, np.inf)
    holder = np.zeros(documents * registers, np.uint64)
    rate = 1.0 + np.log(np.maximum(counts, 1))
    time, state = np.zeros(len(values)), values.copy()
    present = np.bincount(document, minlength=documents)
    # The only shingle of a document holds every register.
    alone = present[document] == 1
    for i in np.flatnonzero(alone):
        holder[document[i] * registers : (document[i] + 1) * registers] = values[i]
    active = np.flatnonzero(~alone)
    while len(active):
        state[active] = mix(state[active] + np.uint64(0x9E3779B97F4A7C15))
        uniform = ((state[active] >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
        time[active] -= np.log(uniform) / rate[active]
        register = (mix(state[active] ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(registers)).astype(np.int64)
        place = document[active] * registers + register
        won = np.flatnonzero(time[active] < earliest[place])
        # Of several arrivals at one register the earliest is written last.
        won = won[np.argsort(-time[active[won]], kind="stable")]
        earliest[place[won]] = time[active[won]]
        holder[place[won]] = values[active[won]]
        latest = earliest.reshape(documents, registers).max(axis=1)
        active = active[time[active] < latest[document[active]]]
    return holder.reshape(documents, registers)


def band_hashes(registers: np.ndarray, bands: int) -> np.ndarray:
    rows = registers.shape[1] // bands
    out = np.zeros((len(registers), bands), np.uint64)
    for band in range(bands):
        value = np.full(len(registers), band + 1, np.uint64)
        for row in range(rows):
            value = mix(value ^ registers[:, band * rows + row])
        out[:, band] = value
    return out


def _banded(rows: DataFrame, size: int, bands: int, per_band: int) -> DataFrame:
    """``key, a, b, n, bands``: a 128-bit digest of the text, its number of shingles and the hash of each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            document, values, counts = shingles(as_bytes(batch), size)
            found = band_hashes(signatures(document, values, counts, batch.num_rows, bands * per_band), bands)
            yield pa.RecordBatch.from_pydict({
                "key": batch.column("key"),
                "a": batch.column("a"),
                "b": batch.column("b"),
                "n": pa.array(np.bincount(document, minlength=batch.num_rows).astype(np.int64)),
                "bands": pa.ListArray.from_arrays(
                    pa.array(np.arange(0, found.size + 1, bands), pa.int32()), pa.array(found.view(np.int64).ravel())
                ),
            })

    text = F.coalesce("text", F.lit(""))
    # The second half hashes the text from another seed; a number after the text would only hash the first half.
    digested = rows.select("key", text.alias("text"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(17), text).alias("b"))
    return digested.mapInArrow(run, "key long, a long, b long, n long, bands array<long>")


def _shingle_sets(rows: DataFrame, size: int) -> DataFrame:
    """``key, shingles``: sorted distinct shingle hashes, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            document, values, _ = shingles(as_bytes(batch), size)
            cuts = np.searchsorted(document, np.arange(batch.num_rows + 1))
            sets = [values[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "shingles": pa.array(sets, pa.binary())})

    return rows.select("key", "text").mapInArrow(run, "key long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``left, right`` whose shingle sets have at least the asked Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, other in zip(batch.column("one").to_pylist(), batch.column("other").to_pylist()):
                x, y = np.frombuffer(one, "<u8"), np.frombuffer(other, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["left", "right"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("key").alias("left"), F.col("shingles").alias("one"))
    other = sets.select(F.col("key").alias("right"), F.col("shingles").alias("other"))
    return pairs.join(one, "left").join(other, "right").select("left", "right", "one", "other").mapInArrow(run, "left long, right long")


def _own_shingles(sets: DataFrame, reps: DataFrame) -> DataFrame:
    """``rep, own``: how many shingles of a text none of the other texts ``reps`` has; a text without one has no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("shingles").to_pylist()
            ends = np.cumsum([0, *map(len, parts)]) // 8
            values = pa.array(np.frombuffer(b"".join(parts), "<i8"))
            yield pa.RecordBatch.from_pydict({"rep": batch.column("rep"), "s": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)})

    of_texts = sets.withColumnRenamed("key", "rep").join(reps, "rep").select("rep", "shingles")
    held = of_texts.mapInArrow(run, "rep long, s array<long>").select("rep", F.explode("s").alias("s"))
    once = held.groupBy("s").agg(F.count("*").alias("texts"), F.min("rep").alias("rep")).where("texts = 1")
    return once.groupBy("rep").agg(F.count("*").alias("own"))


def near_duplicate_classes(
    docs: DataFrame,
    size: int = SHINGLE_WORDS,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    per_band: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    also: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: ``key, doc_id, class_key`` and the struct ``also`` of the columns named in ``also``.

    ``class_key`` is the least key of the documents that are connected by links: equal texts, or candidates of the bands whose
    sets of ``size``-word shingles have a Jaccard similarity of at least ``similarity``. Null counts as an empty text; texts
    without a word only link to equal texts, shorter ones than a shingle are one shingle; repeated rows are copies; an empty
    table gives no rows. Keys are the ids where these are unique integers, see ``common.keyed``.
    """
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col, also)
    signed = cut_lineage(_banded(rows, size, bands, per_band))
    # Equal texts have equal bands, so one of them stands for all.
    texts = cut_lineage(signed.groupBy("a", "b").agg(F.min("key").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    entries = texts.where("n > 0").select("rep", "n", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    open_ = cut_lineage(entries.join(shared.select("band"), "band"))
    release(spark)
    sets = cut_lineage(_shingle_sets(rows.join(open_.select(F.col("rep").alias("key")).distinct(), "key"), size))
    release(spark)
    work = Workspace(spark)
    links = _links(open_, sets, similarity, work)
    member = components(links, work).withColumnRenamed("label", "class_key")
    classes = texts.select("a", "b", "rep").join(member, "rep", "left").select("a", "b", F.coalesce("class_key", "rep").alias("class_key"))
    by_key = cut_lineage(signed.select("key", "a", "b").join(classes, ["a", "b"]).select("key", "class_key"))
    del signed, texts, sets, links, member, classes, open_, entries, shared
    work.close()
    release(spark)
    return rows.select("key", "doc_id", *(["also"] if also else [])).join(by_key, "key")


def components(links: DataFrame, work: Workspace) -> DataFrame:
    """``rep, label``: for every end of a link the least end of its component.

    Each round takes the least label among a node's neighbours and then that label's own, so paths shorten quickly; both are
    minimum aggregations and joins, and a round is one small plan on a written table.
    """
    both = work.keep(links.select("left", "right").unionByName(links.select(F.col("right").alias("left"), F.col("left").alias("right"))))
    labels = work.keep(both.groupBy("left").agg(F.min("right").alias("m")).select(F.col("left").alias("rep"), F.least("left", "m").alias("label")))
    while True:
        heard = both.join(labels.select(F.col("rep").alias("right"), "label"), "right").groupBy("left").agg(F.min("label").alias("heard"))
        near = labels.join(heard.withColumnRenamed("left", "rep"), "rep").select("rep", F.col("label").alias("was"), F.least("label", "heard").alias("via"))
        jump = labels.select(F.col("rep").alias("via"), F.col("label").alias("top"))
        following = work.keep(near.join(jump, "via").select("rep", F.least("via", "top").alias("label"), (F.least("via", "top") < F.col("was")).alias("moved")))
        labels = following.select("rep", "label")
        if following.where("moved").isEmpty():
            return labels


def _links(open_: DataFrame, sets: DataFrame, similarity: float, work: Workspace) -> DataFrame:
    """Verified links that connect what all candidate pairs of the buckets would connect."""
    first = open_.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("c")).select("band", F.col("c.rep").alias("left"), F.col("c.n").alias("left_n"))
    near = F.least("n", "left_n") >= similarity * F.greatest("n", "left_n") - 1e-9
    stars = open_.join(first, "band").where((F.col("rep") != F.col("left")) & near).select("left", F.col("rep").alias("right")).distinct()
    links = work.keep(_verified(work.keep(stars), sets, similarity))
    release(open_.sparkSession)
    labelled = open_.join(components(links, work), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    labelled = _split(labelled, work)
    own = _own_shingles(sets, labelled.select("rep").distinct())
    shared = F.col("n") - F.coalesce("own", F.lit(0))
    labelled = labelled.join(own, "rep", "left").where(shared >= similarity * F.col("n") - 1e-9)
    labelled = _split(work.keep(labelled.select("band", "rep", "n", "label")), work)
    release(open_.sparkSession)
    return work.keep(links.unionByName(_links_of_blocks(labelled, sets, similarity)))


def _links_of_blocks(labelled: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between the members of each bucket that lie in different components; of several between two, one."""
    size = labelled.groupBy("band").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK_TEXTS, F.col("shingles") / BLOCK_SHINGLES))
    placed = labelled.join(size.select("band", blocks.alias("blocks")), "band")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("blocks")))
    placed = placed.withColumn("met", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pair = [F.least("block", "met").alias("low"), F.greatest("block", "met").alias("high")]
    placed = placed.select("band", *pair, "block", "rep", "label", "n")
    total = placed.agg(F.sum("n")).first()[0] or 0
    # Small buckets share a task; a part takes about as much as a block.
    parts = max(64, total // BLOCK_SHINGLES)
    placed = placed.withColumn("part", F.pmod(F.xxhash64("band", "low", "high"), F.lit(parts)))
    held = placed.join(sets.withColumnRenamed("key", "rep"), "rep")

    def run(part: pa.Table) -> pa.Table:
        links: list[tuple[int, int]] = []
        band, low, high, block, rep, label = (part.column(c).to_numpy() for c in ("band", "low", "high", "block", "rep", "label"))
        order = np.lexsort((high, low, band))
        same = (np.diff(band[order]) == 0) & (np.diff(low[order]) == 0) & (np.diff(high[order]) == 0)
        found = part.column("shingles")
        for rows in np.split(order, np.flatnonzero(~same) + 1):
            if len(np.unique(label[rows])) > 1:
                links += joining(rep[rows], label[rows], block[rows] == low[rows[0]], found.take(rows).to_pylist(), low[rows[0]] == high[rows[0]], similarity)
        left, right = (pa.array([link[i] for link in links], pa.int64()) for i in range(2))
        return pa.table({"left": left, "right": right})

    return held.groupBy("part").applyInArrow(run, "left long, right long").distinct()


def joining(
    rep: np.ndarray, label: np.ndarray, lower: np.ndarray, found: list[bytes], alike: bool, similarity: float
) -> list[tuple[int, int]]:
    """Links between the texts of two blocks (``alike``: of one) that join all components which these blocks' links join."""
    sets = [np.frombuffer(f, "<u8") for f in found]
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    one = np.arange(len(sets)) if alike else np.flatnonzero(lower)
    other = one if alike else np.flatnonzero(~lower)
    if not len(one) or not len(other):
        return []
    values, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    # Only shingles that two of the texts have meet; they are taken in stripes, so the matrices stay small.
    several = often[column] > 1
    row, column = row[several], (np.cumsum(often > 1) - 1)[column[several]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(one), len(other)), np.float32)
    width = 4096
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [start, start + width])
        has = np.zeros((len(sets), width), np.float32)
        has[row[a:b], column[a:b] - start] = 1
        both += has[one] @ has[other].T
    linked = both >= similarity * (n[one][:, None] + n[other][None, :] - both) - 1e-6
    x, y = np.nonzero(linked & (label[one][:, None] != label[other][None, :]))
    x, y = one[x], other[y]
    ends = np.sort(np.stack([label[x], label[y]], axis=1), axis=1)
    _, first = np.unique(ends, axis=0, return_index=True)
    top: dict[int, int] = {}

    def root(at: int) -> int:
        while (up := top.setdefault(at, at)) != at:
            top[at] = at = top[up]
        return at

    links = []
    for i in first.tolist():
        p, q = root(int(ends[i, 0])), root(int(ends[i, 1]))
        if p != q:
            top[p] = q
            links.append((int(min(rep[x[i]], rep[y[i]])), int(max(rep[x[i]], rep[y[i]]))))
    return links


def _split(labelled: DataFrame, work: Workspace) -> DataFrame:
    """The members of the buckets that hold two components."""
    split = labelled.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("band")
    return work.keep(labelled.join(split, "band"))


@query("op1_minhash_near_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicate_classes(table(spark, folder, "documents"))
    return found.select("doc_id", F.col("class_key").alias("class_id"), (F.col("key") == F.col("class_key")).alias("kept"))
