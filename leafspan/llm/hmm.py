"""Hidden Markov language model: Baum-Welch counts aggregated across partitions, exact sequence likelihoods by scaled forward recursion.

The vocabulary is every word of the corpus, so emissions are a table and never broadcast. Texts are written once as blocks of
word numbers, each block with the list of its distinct words, cut by the words' buckets. An iteration deals every block the
expected counts of its own words, runs forward and backward over the block's training texts, sends the new expected counts of
each distinct word (not of each occurrence) to the word's bucket, and adds them up there. A word that the training texts lack
has the share that add-one smoothing leaves for unknown words in every state.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspan.llm.common import Workspace, as_bytes, bucket_count, by_bucket, keyed, mix, query, release, slices, table
from leafspan.session import cut_lineage

STATES = 8
ITERATIONS = 6
# Text of a block, and text for each bucket of words.
BLOCK_BYTES = 16_000_000
BUCKET_BYTES, LEAST_BUCKETS = 64_000_000, 256
# Training texts are cut into runs of so many tokens; a task holds the recursion of so many tokens at once.
RUN_TOKENS = 128
HELD_TOKENS = 150_000
# Longer texts are scored in pieces whose transfer matrices are multiplied up.
LONG_TOKENS, PIECE_TOKENS = 32_768, 512
END = b""  # no word is empty
STATS = 64  # groups that add up the blocks' transition counts

BLOCKS = "kind int, block long, bucket long, at int, keys binary, counts binary, train binary, low binary, rare binary, homes binary, hashes binary, seen binary"


def squeezed(*columns: np.ndarray) -> bytes:
    """Columns of numbers by byte planes, compressed."""
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns if len(c))
    return zstandard.ZstdCompressor(level=1).compress(planes)


def widened(data: bytes, *kinds: str) -> list[np.ndarray]:
    """The columns of :func:`squeezed`, which must be of equal length."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    count, at, out = len(planes) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes):
        part = np.ascontiguousarray(planes[at : at + count * size].reshape(size, count).T)
        out.append(part.reshape(-1).view(kind))
        at += count * size
    return out


def packed_counts(n: np.ndarray) -> bytes:
    """Expected counts by word and state: each word's total, and its shares as 16-bit roots, which resolve small shares finely."""
    total = n.sum(axis=1)
    roots = np.rint(65_535 * np.sqrt(n.T / np.maximum(total, 1e-30))).astype(np.uint16)
    high, low = (roots >> 8).astype(np.uint8), roots.astype(np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(total.astype(np.float32).tobytes() + high.tobytes() + low.tobytes())


def unpacked_counts(data: bytes, states: int) -> np.ndarray:
    """The counts that :func:`packed_counts` packed; a word's shares add up to its total."""
    plain = zstandard.ZstdDecompressor().decompress(data)
    count = len(plain) // (4 + 2 * states)
    total = np.frombuffer(plain, np.float32, count)
    high, low = np.frombuffer(plain, np.uint8, offset=4 * count).reshape(2, states, count)
    shares = ((high.astype(np.uint16) << 8) | low).astype(np.float64)
    shares *= shares
    shares *= total / np.maximum(shares.sum(axis=0), 1e-30)
    return shares.T


class _Numbers(dict):
    """Words numbered by first appearance."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _packed(held: list[tuple[int, bool, np.ndarray]], numbers: _Numbers, block: int, buckets: int) -> Iterator[dict]:
    """A block's row and those of its words; words are numbered by frequency in the texts and placed by bucket, then number."""
    counts = np.array([len(h[2]) for h in held], np.int64)
    train = np.array([h[1] for h in held], bool)
    tokens = np.concatenate([h[2] for h in held])
    often = np.bincount(tokens, minlength=len(numbers))
    seen = np.bincount(tokens[np.repeat(train, counts)], minlength=len(numbers))
    hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, numbers)), np.uint64).reshape(-1, 2)
    bucket = (hashes[:, 0] % np.uint64(buckets)).astype(np.int64)
    frequent = np.argsort(-often, kind="stable")
    bucket, rank = bucket[frequent], np.empty(len(numbers), np.int64)
    rank[frequent] = np.arange(len(numbers))
    tokens = rank[tokens]
    low = np.minimum(tokens, 65_535)
    yield {
        "kind": 0, "block": block, "keys": np.array([h[0] for h in held], np.int64).tobytes(), "counts": counts.tobytes(),
        "train": train.tobytes(), "low": squeezed(low.astype(np.uint16)), "rare": squeezed(tokens[low == 65_535].astype(np.uint32)),
        "homes": squeezed(bucket.astype(np.uint32)),
    }
    at = 0
    for number, ranks in by_bucket(bucket):
        own = frequent[ranks]
        yield {"kind": 1, "block": block, "bucket": number, "at": at, "hashes": hashes[own].tobytes(), "seen": squeezed(seen[own].astype(np.int64))}
        at += len(own)


def _blocks(rows: DataFrame, buckets: int, block_bytes: int) -> DataFrame:
    schema = pa.schema([
        ("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int64()), ("at", pa.int32()),
        *[(c, pa.binary()) for c in ("keys", "counts", "train", "low", "rare", "homes", "hashes", "seen")],
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, numbers, waiting = TaskContext.get().partitionId() << 32, [], _Numbers(), 0
        for batch in slices(batches):
            for key, train, text in zip(batch.column("key").to_pylist(), batch.column("train").to_pylist(), as_bytes(batch)):
                words = text.lower().split()
                words.append(END)
                held.append((key, train, np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))))
                waiting += len(text) + 8
                if waiting >= block_bytes:
                    yield pa.RecordBatch.from_pylist(list(_packed(held, numbers, block, buckets)), schema=schema)
                    block, held, numbers, waiting = block + 1, [], _Numbers(), 0
        if held:
            yield pa.RecordBatch.from_pylist(list(_packed(held, numbers, block, buckets)), schema=schema)

    return rows.select("key", "text", "train").mapInArrow(run, BLOCKS)


def first_weights(bucket: int, words: np.ndarray, states: int) -> np.ndarray:
    """A fixed random share of each word of a bucket for each state."""
    with np.errstate(over="ignore"):
        named = mix(words.astype(np.uint64) + (np.uint64(bucket) << np.uint64(32)))
        drawn = np.stack([mix(named + np.uint64(977 * (s + 1))) for s in range(states)], axis=1)
    share = -np.log((drawn >> np.uint64(11)).astype(np.float64) / 2.0**53 + 2.0**-54)
    return share / share.sum(axis=1, keepdims=True)


INDEX = "bucket long, block long, at int, word binary, seen binary, words long, tokens long, mass array<double>"


def _index(words: DataFrame, states: int) -> DataFrame:
    """Per block and bucket: the words' numbers within the bucket, and their training counts in the corpus."""

    def run(part: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(h, np.uint64).reshape(-1, 2) for h in part.column("hashes").to_pylist()]
        own = np.concatenate([widened(s, "<i8")[0] for s in part.column("seen").to_pylist()])
        sizes, every = [len(h) for h in hashes], np.concatenate(hashes)
        order = np.lexsort((every[:, 1], every[:, 0]))
        new = np.concatenate([[True], (every[order][1:] != every[order][:-1]).any(axis=1)])
        begins = np.flatnonzero(new)
        total = np.add.reduceat(own[order], begins)
        word = np.empty(len(every), np.int64)
        word[order] = np.cumsum(new) - 1
        first = first_weights(part.column("bucket")[0].as_py(), np.arange(len(total)), states) * total[:, None]
        cuts = np.cumsum(sizes)[:-1]
        pieces, rows = np.split(word, cuts), part.num_rows
        none = [0] * (rows - 1)
        return pa.table({
            "bucket": part.column("bucket"), "block": part.column("block"), "at": part.column("at"),
            "word": pa.array([squeezed(p.astype(np.uint32)) for p in pieces], pa.binary()),
            "seen": pa.array([squeezed(total[p]) for p in pieces], pa.binary()),
            "words": pa.array([int((total > 0).sum()), *none], pa.int64()), "tokens": pa.array([int(total.sum()), *none], pa.int64()),
            "mass": pa.array([first.sum(axis=0).tolist(), *[None] * (rows - 1)], pa.list_(pa.float64())),
        })

    return words.groupBy("bucket").applyInArrow(run, INDEX)


@dataclass
class Parameters:
    """The small part of the model: first states of texts and of runs within texts, transitions, mass of each state, corpus counts."""

    first: np.ndarray
    inner: np.ndarray
    step: np.ndarray
    mass: np.ndarray
    tokens: int
    words: int

    def base(self, seen: np.ndarray) -> np.ndarray:
        """Probability of words with add-one smoothing, one share being left for unknown words."""
        return (seen + 1.0) / (self.tokens + self.words + 1.0)

    def emissions(self, n: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """P(word | state) for rows of expected counts: each state's counts, and as many of the base as there are words for a state."""
        weight = (self.words + 1.0) / len(self.mass)
        out = n + weight * self.base(seen)[:, None]
        out /= self.mass + weight
        return out


def start(states: int, mass: np.ndarray, tokens: int, words: int) -> Parameters:
    even = np.full(states, 1 / states)
    return Parameters(even, even, 0.9 * np.eye(states) + 0.1 / states, mass, tokens, words)


def forward_backward(emit: np.ndarray, tokens: np.ndarray, begins: np.ndarray, lengths: np.ndarray, heads: np.ndarray, p: Parameters):
    """Expected counts over runs of tokens (``heads``: those that begin a text).

    Returns counts by word and state, transition counts, counts of the first states of texts, and the natural log-likelihood.
    """
    states, by_state = len(p.mass), np.ascontiguousarray(emit.T)
    by_word, step = np.zeros((states, len(emit))), np.zeros((states, states))
    first, likelihood = np.zeros(states), 0.0
    move = p.step.astype(emit.dtype)
    order = np.argsort(-lengths, kind="stable")
    begins, lengths, heads = begins[order], lengths[order], heads[order]
    for part in np.split(np.arange(len(lengths)), np.flatnonzero(np.diff(np.cumsum(lengths) // HELD_TOKENS)) + 1):
        own, long, head = begins[part], lengths[part], heads[part]
        if not len(long):
            continue
        # One row for each state and one column for each run that is still going on.
        live = np.searchsorted(-long, -np.arange(1, long[0] + 1), side="right")
        words, alphas, scales, seen = [], [], [], []
        for t, n in enumerate(live.tolist()):
            word = tokens[own[:n] + t]
            here = by_state.take(word, axis=1)
            before = move.T @ alphas[-1][:, :n] if t else np.where(head, p.first[:, None], p.inner[:, None]).astype(emit.dtype)
            alpha = np.multiply(before, here, out=before)
            scale = alpha.sum(axis=0)
            alpha /= scale
            words.append(word)
            seen.append(here)
            alphas.append(alpha)
            scales.append(scale)
        likelihood += float(np.log(np.concatenate(scales).astype(np.float64)).sum())
        beta = np.ones_like(alphas[-1])
        gammas = [None] * len(alphas)
        for t in range(len(alphas) - 1, -1, -1):
            gammas[t] = alphas[t] * beta
            if t:
                ahead = np.multiply(beta, seen[t], out=beta)
                ahead /= scales[t]
                step += alphas[t - 1][:, : ahead.shape[1]] @ ahead.T
                beta = np.ones_like(alphas[t - 1])
                beta[:, : ahead.shape[1]] = move @ ahead
        first += gammas[0][:, head].sum(axis=1)
        del alphas, seen, scales
        at, gamma = np.concatenate(words), np.concatenate(gammas, axis=1)
        for s in range(states):
            by_word[s] += np.bincount(at, gamma[s], len(emit))
    return by_word.T, step * p.step, first, likelihood


def runs_of(counts: np.ndarray, train: np.ndarray, size: int = RUN_TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and lengths of the training texts' runs of at most ``size`` tokens, and whether each begins a text."""
    first = np.cumsum(counts) - counts
    first, counts = first[train], counts[train]
    runs = -(-counts // size)
    number = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    begins = np.repeat(first, runs) + number * size
    return begins, np.minimum(size, np.repeat(first + counts, runs) - begins), number == 0


def log_likelihoods(emit: np.ndarray, tokens: np.ndarray, counts: np.ndarray, p: Parameters, long: int = LONG_TOKENS, piece: int = PIECE_TOKENS) -> np.ndarray:
    """Exact log10 probability of every text by the scaled forward recursion over all its tokens.

    Texts are taken side by side. For those of over ``long`` tokens the recursion of each piece is run from every state at once,
    and the pieces' matrices are applied one after another, which is the same recursion.
    """
    out = np.zeros(len(counts))
    begins = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] <= long]
    live = np.searchsorted(-counts[order], -np.arange(1, (counts[order][0] if len(order) else 0) + 1), side="right")
    alpha, total, by_state = None, np.zeros(len(order)), np.ascontiguousarray(emit.T)
    first = begins[order]
    for t, n in enumerate(live.tolist()):
        before = p.step.T @ alpha[:, :n] if t else np.tile(p.first[:, None], n)
        alpha = np.multiply(before, by_state.take(tokens[first[:n] + t], axis=1), out=before)
        scale = alpha.sum(axis=0)
        alpha /= scale
        total[:n] += np.log10(scale)
    out[order] = total
    _add_long(out, emit, tokens, begins, counts, np.flatnonzero(counts > long), p, piece)
    return out


def _add_long(out: np.ndarray, emit: np.ndarray, tokens: np.ndarray, begins: np.ndarray, counts: np.ndarray, texts: np.ndarray, p: Parameters, piece: int) -> None:
    """Score long texts: the matrices of all their pieces side by side, then each text's product of them."""
    states = len(p.mass)
    pieces = -(-(counts[texts] - 1) // piece)
    number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    owner = np.repeat(np.arange(len(texts)), pieces)
    first = begins[texts][owner] + 1 + number * piece
    lengths = np.minimum(piece, (begins + counts)[texts][owner] - first)
    alpha, total = np.zeros((len(texts), states)), np.zeros(len(texts))
    for i, text in enumerate(texts.tolist()):
        start_of = p.first * emit[tokens[begins[text]]]
        alpha[i], total[i] = start_of / start_of.sum(), np.log10(start_of.sum())
    for part in np.array_split(np.arange(len(owner)), max(1, -(-len(owner) * piece // HELD_TOKENS))):
        order = part[np.argsort(-lengths[part], kind="stable")]
        live = np.searchsorted(-lengths[order], -np.arange(1, (lengths[order][0] if len(order) else 0) + 1), side="right")
        matrix, scales = np.tile(np.eye(states), (len(order), 1, 1)), np.zeros(len(order))
        for t, n in enumerate(live.tolist()):
            moved = (matrix[:n].reshape(-1, states) @ p.step).reshape(n, states, states) * emit[tokens[first[order[:n]] + t]][:, None, :]
            size = moved.reshape(n, -1).sum(axis=1)
            matrix[:n] = moved / size[:, None, None]
            scales[:n] += np.log10(size)
        for i in np.argsort(order).tolist():
            own = owner[order[i]]
            ahead = alpha[own] @ matrix[i]
            alpha[own] = ahead / ahead.sum()
            total[own] += scales[i] + np.log10(ahead.sum())
    out[texts] = total


def _texts_of(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, token counts, training flags, word numbers and the places of the numbered words."""
    keys, counts = np.frombuffer(block["keys"], np.int64), np.frombuffer(block["counts"], np.int64)
    tokens = widened(block["low"], "<u2")[0].astype(np.int32)
    tokens[tokens == 65_535] = widened(block["rare"], "<u4")[0]
    order = np.argsort(widened(block["homes"], "<u4")[0], kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return keys, counts, np.frombuffer(block["train"], bool), tokens, place


def _first_counts(index: DataFrame, states: int) -> DataFrame:
    """The expected counts that training begins with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [
                packed_counts(first_weights(bucket, widened(word, "<u4")[0], states) * widened(seen, "<i8")[0][:, None])
                for bucket, word, seen in zip(*(batch.column(c).to_pylist() for c in ("bucket", "word", "seen")))
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("bucket", "block", "at")), pa.array(n, pa.binary())], names=COUNT_SCHEMA.names)

    return index.select("bucket", "block", "at", "word", "seen").mapInArrow(run, COUNTS)


COUNTS = "bucket long, block long, at int, n binary"
COUNT_SCHEMA = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("at", pa.int32()), ("n", pa.binary())])


def _expect(p: Parameters):
    """A block's expected counts, by bucket of words; its transition and first counts go to a group with a negative number."""
    states = len(p.mass)

    def run(blocks: pa.Table, dealt: pa.Table) -> pa.Table:
        out, rows = [], sorted(dealt.to_pylist(), key=lambda r: r["at"])
        for block in blocks.to_pylist():
            _, counts, train, tokens, place = _texts_of(block)
            n = np.concatenate([unpacked_counts(r["n"], states) for r in rows])[place]
            emit = p.emissions(n, n.sum(axis=1)).astype(np.float32)
            del n
            by_word, step, first, likelihood = forward_backward(emit, tokens, *runs_of(counts, train), p)
            placed = np.empty((len(place), states))
            placed[place] = by_word
            for r, end in zip(rows, [*[r["at"] for r in rows[1:]], len(place)]):
                out.append((r["bucket"], block["block"], r["at"], packed_counts(placed[r["at"] : end])))
            stats = np.concatenate([step.ravel(), first, by_word.sum(axis=0), [likelihood]])
            out.append((-1 - block["block"] % STATS, block["block"], 0, stats.tobytes()))
        return pa.table([pa.array([o[i] for o in out], f.type) for i, f in enumerate(COUNT_SCHEMA)], schema=COUNT_SCHEMA)

    return run


def _add(states: int):
    """The sum of all blocks' expected counts of each word of a bucket, sent back to each block that has the word."""

    def run(counts: pa.Table, index: pa.Table) -> pa.Table:
        rows = sorted(counts.to_pylist(), key=lambda r: r["block"])
        if not index.num_rows:
            total = np.sum([np.frombuffer(r["n"], np.float64) for r in rows], axis=0)
            return pa.table([[rows[0]["bucket"]], [-1], pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], schema=COUNT_SCHEMA)
        words = {b: widened(w, "<u4")[0] for b, w in zip(index.column("block").to_pylist(), index.column("word").to_pylist())}
        total = np.zeros((1 + max(int(w.max()) for w in words.values()), states))
        for r in rows:
            total[words[r["block"]]] += unpacked_counts(r["n"], states)
        sent = [packed_counts(total[words[r["block"]]]) for r in rows]
        columns = [[r["bucket"] for r in rows], [r["block"] for r in rows], pa.array([r["at"] for r in rows], pa.int32()), pa.array(sent, pa.binary())]
        return pa.table(columns, schema=COUNT_SCHEMA)

    return run


@dataclass
class Model:
    """A fitted model and the coded corpus it came from: ``blocks``, ``index`` and the last expected counts ``dealt``."""

    parameters: Parameters
    blocks: DataFrame
    index: DataFrame
    dealt: DataFrame
    likelihoods: list[float]  # natural log-likelihood of the training runs before each iteration


def fit(rows: DataFrame, work: Workspace, states: int = STATES, iterations: int = ITERATIONS, block_bytes: int = BLOCK_BYTES) -> Model:
    """Code ``rows`` (``key, text, train``) and train on those with ``train``; every training token counts in every iteration."""
    spark = rows.sparkSession
    buckets = bucket_count(rows, BUCKET_BYTES, LEAST_BUCKETS)
    path = f"{work.folder}/coded"
    _blocks(rows, buckets, block_bytes).write.partitionBy("kind").parquet(path)
    read = lambda kind, *columns: spark.read.schema(BLOCKS).parquet(f"{path}/kind={kind}").select(*columns)
    if rows.isEmpty():
        nothing = spark.createDataFrame([], BLOCKS)
        read = lambda kind, *columns: nothing.select(*columns)
    blocks = read(0, "block", "keys", "counts", "train", "low", "rare", "homes")
    index = work.keep(_index(read(1, "bucket", "block", "at", "hashes", "seen"), states))
    work.drop("coded/kind=1")
    sums = index.agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens"), *[F.sum(F.col("mass")[s]).alias(f"m{s}") for s in range(states)]).first()
    p = start(states, np.array([sums[f"m{s}"] or 0.0 for s in range(states)]), sums["tokens"] or 0, sums["words"] or 0)
    dealt, likelihoods = _first_counts(index, states), []
    numbers = index.select("bucket", "block", "word")
    for _ in range(iterations):
        counts = blocks.groupBy("block").cogroup(dealt.groupBy("block")).applyInArrow(_expect(p), COUNTS)
        new = work.keep(counts.groupBy("bucket").cogroup(numbers.groupBy("bucket")).applyInArrow(_add(states), COUNTS))
        stats = [np.frombuffer(r["n"], np.float64) for r in new.where("bucket < 0").select("n").collect()]
        if not stats:
            break
        total = np.sum(stats, axis=0)
        step, first, mass = total[: states**2].reshape(states, states) + 1, total[states**2 : states**2 + states] + 1, total[-states - 1 : -1]
        likelihoods.append(float(total[-1]))
        p = Parameters(first / first.sum(), (mass + 1) / (mass + 1).sum(), step / step.sum(axis=1, keepdims=True), mass, p.tokens, p.words)
        dealt = new.where("bucket >= 0")
        if len(likelihoods) > 1:
            work.drop(str(work.number - 1))
        release(spark)
    return Model(p, blocks, index, dealt, likelihoods)


SCORES = "key long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(model: Model) -> DataFrame:
    """``key, n_tokens, n_known, train_tokens, base_score, score`` of every coded text."""
    p = model.parameters
    states = len(p.mass)

    def run(blocks: pa.Table, dealt: pa.Table) -> pa.Table:
        rows, out = sorted(dealt.to_pylist(), key=lambda r: r["at"]), []
        for block in blocks.to_pylist():
            keys, counts, _, tokens, place = _texts_of(block)
            n = np.concatenate([unpacked_counts(r["n"], states) for r in rows if r["n"] is not None])[place]
            seen = np.concatenate([widened(r["seen"], "<i8")[0] for r in rows if r["seen"] is not None])[place]
            first = np.cumsum(counts) - counts
            known = np.add.reduceat((seen > 0)[tokens].astype(np.int64), first)
            base = np.add.reduceat(np.log10(p.base(seen))[tokens], first)
            score = log_likelihoods(p.emissions(n, seen), tokens, counts, p)
            out.append(pa.table({
                "key": keys, "n_tokens": counts, "n_known": known, "train_tokens": np.full(len(keys), p.tokens, np.int64),
                "base_score": base, "score": score,
            }))
        return pa.concat_tables(out)

    nothing = F.lit(None).cast("binary")
    dealt = model.dealt.select("block", "at", "n", nothing.alias("seen"))
    dealt = dealt.unionByName(model.index.select("block", "at", nothing.alias("n"), "seen"))
    return model.blocks.groupBy("block").cogroup(dealt.groupBy("block")).applyInArrow(run, SCORES)


def score_texts(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, iterations: int = ITERATIONS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: ``doc_id, train, n_tokens, n_known, train_tokens, base_score, score``.

    The model learns from the rows for which ``train`` holds (null counts as false). Tokens are a text's words, A to Z in lower
    case, and one end; ``n_known`` of them occur in training texts. ``base_score`` is the log10 probability by add-one counts,
    ``score`` that of the hidden Markov model, both over the whole text. Null and empty texts have the end alone, very long texts
    are read whole, repeated rows are documents of their own, null and repeated ids are allowed, other columns are not looked at.
    Without a training row all scores are 0; an empty table gives no rows. Words are told apart by 128-bit hashes.
    """
    spark = docs.sparkSession
    wanted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    rows = keyed(wanted, also=("train",)).select("key", "doc_id", "text", F.col("also.train").alias("train"))
    work = Workspace(spark)
    model = fit(rows, work, states, iterations, block_bytes)
    found = cut_lineage(scored(model).join(rows.select("key", "doc_id", "train"), "key").drop("key"))
    work.close()
    return found.select("doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op13_hidden_markov_model")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return score_texts(table(spark, folder, "documents"), ~held_out).select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
