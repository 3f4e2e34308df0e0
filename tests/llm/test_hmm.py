"""The hidden Markov model against sums over all state paths, plain Baum-Welch on one machine, and counts by hand."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafspan.llm import hmm
from leafspan.llm.common import Workspace

SCHEMA = "doc_id long, text string, lang string, key long, train int, block long, kind int"


def parameters(states, draw, words=5):
    share = lambda *s: (lambda x: x / x.sum(axis=-1, keepdims=True))(draw.random(s) + 0.05)
    return hmm.Parameters(share(states), share(states), share(states, states), draw.random(states) * 50 + 1, 60, words)


def paths(emit, tokens, p, first):
    """Probability of every state path."""
    for path in itertools.product(range(len(p.mass)), repeat=len(tokens)):
        value = first[path[0]] * emit[tokens[0], path[0]]
        for i in range(1, len(tokens)):
            value *= p.step[path[i - 1], path[i]] * emit[tokens[i], path[i]]
        yield path, value


def test_scores_are_sums_over_all_paths():
    draw = np.random.default_rng(3)
    p = parameters(3, draw)
    emit = draw.random((5, 3)) + 0.01
    counts = np.array([1, 7, 4, 6, 1])
    tokens = draw.integers(0, 5, counts.sum())
    want = [math.log10(sum(v for _, v in paths(emit, t, p, p.first))) for t in np.split(tokens, np.cumsum(counts)[:-1])]
    assert np.allclose(hmm.log_likelihoods(emit, tokens, counts, p), want)
    # Texts that are cut into pieces give the same.
    for long, piece in ((3, 2), (0, 3), (5, 5)):
        assert np.allclose(hmm.log_likelihoods(emit, tokens, counts, p, long, piece), want)
    counts = np.array([9_000, 5])
    tokens = draw.integers(0, 5, counts.sum())
    assert np.allclose(hmm.log_likelihoods(emit, tokens, counts, p), hmm.log_likelihoods(emit, tokens, counts, p, long=10_000))


@pytest.mark.parametrize("held", [7, 400_000])
def test_expected_counts_are_those_of_all_paths(monkeypatch, held):
    monkeypatch.setattr(hmm, "HELD_TOKENS", held)
    draw = np.random.default_rng(5)
    p = parameters(2, draw)
    emit = draw.random((5, 2)) + 0.01
    counts = np.array([6, 1, 5, 8])
    train = np.array([True, True, False, True])
    tokens = draw.integers(0, 5, counts.sum())
    begins, lengths, heads = hmm.runs_of(counts, train, 4)
    assert (begins.tolist(), lengths.tolist(), heads.tolist()) == ([0, 4, 6, 12, 16], [4, 2, 1, 4, 4], [True, False, True, True, False])
    by_word, step, first, likelihood = np.zeros((5, 2)), np.zeros((2, 2)), np.zeros(2), 0.0
    for b, n, head in zip(begins, lengths, heads):
        run = tokens[b : b + n]
        every = list(paths(emit, run, p, p.first if head else p.inner))
        total = sum(v for _, v in every)
        likelihood += math.log(total)
        for path, v in every:
            first[path[0]] += head * v / total
            for i, s in enumerate(path):
                by_word[run[i], s] += v / total
                if i:
                    step[path[i - 1], s] += v / total
    got = hmm.forward_backward(emit, tokens, begins, lengths, heads, p)
    for a, b in zip(got, (by_word, step, first, likelihood)):
        assert np.allclose(a, b)


def test_emissions_are_a_distribution():
    draw = np.random.default_rng(2)
    seen = np.array([3, 1, 9, 2, 5])
    n = draw.dirichlet(np.ones(4), 5) * seen[:, None]
    p = hmm.Parameters(np.ones(4) / 4, np.ones(4) / 4, np.eye(4), n.sum(axis=0), 20, 5)
    known, unknown = p.emissions(n, seen), p.emissions(np.zeros((1, 4)), np.zeros(1))
    assert np.allclose(known.sum(axis=0) + unknown[0], 1) and (unknown > 0).all()


def corpus(n=150):
    draw = np.random.default_rng(9)
    texts = []
    for i in range(n):
        kind = "ab"[i % 2]
        texts.append(" ".join(f"{kind}{min(draw.integers(1, 30), draw.integers(1, 30))}" for _ in range(int(draw.integers(0, 60)))))
    texts += [None, "", " \n\t ", "NEW Word new", texts[0], texts[0], "é İ ALİ. é", "long\n" * 9_000]
    return texts


def scores(spark, texts, parts=3, **more):
    df = spark.createDataFrame([(i, t, "x", 7, 1, 2, 3) for i, t in enumerate(texts)], SCHEMA).repartition(parts)
    return sorted(hmm.score_texts(df, F.col("doc_id") % 5 != 2, **more).collect(), key=lambda r: r["doc_id"])


def test_counts_base_and_gain(spark):
    texts = corpus()
    got = scores(spark, texts, block_bytes=2_000)
    tokens = [[*(t or "").encode().lower().split(), b""] for t in texts]
    seen = Counter(w for i, t in enumerate(tokens) if i % 5 != 2 for w in t)
    total, distinct = sum(seen.values()), len(seen)
    for r, own in zip(got, tokens):
        base = sum(math.log10((seen[w] + 1) / (total + distinct + 1)) for w in own)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in seen for w in own), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isfinite(r["score"]) and r["score"] <= 0
        assert r["train"] == (r["doc_id"] % 5 != 2)
    held = [r for r in got if not r["train"] and r["doc_id"] < 150]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 5 * len(held)
    assert got[0]["score"] == pytest.approx(got[154]["score"]) == pytest.approx(got[155]["score"])


def test_partitions_and_blocks_do_not_matter(spark):
    texts = corpus(60)
    one, many = scores(spark, texts, 1), scores(spark, texts, 7, block_bytes=500)
    assert np.allclose([r["score"] for r in one], [r["score"] for r in many], rtol=1e-3)


def test_iterations_raise_the_likelihood(spark):
    rows = spark.createDataFrame([(i, t, i % 5 != 2) for i, t in enumerate(corpus())], "key long, text string, train boolean")
    work = Workspace(spark)
    model = hmm.fit(rows, work, states=3, iterations=5, block_bytes=3_000)
    assert all(b > a - 1 for a, b in zip(model.likelihoods, model.likelihoods[1:])) and model.likelihoods[-1] > model.likelihoods[0] + 100
    p = model.parameters
    assert np.allclose(p.step.sum(axis=1), 1) and np.isclose(p.mass.sum(), p.tokens, rtol=1e-4)
    work.close()


def test_nulls_repeats_and_nothing_to_learn(spark):
    rows = [(None, "a b"), (1, "a b"), (1, "a b"), (1, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = hmm.score_texts(df, F.col("doc_id") == 1).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == [(0, 3, 3, 7), (1, 1, 1, 7), (1, 3, 3, 7), (1, 3, 3, 7), (2, 1, 1, 7)]
    assert {(r["base_score"], round(r["score"], 9) + 0.0, r["train_tokens"]) for r in hmm.score_texts(df, F.lit(False)).collect()} == {(0.0, 0.0, 0)}
    assert hmm.score_texts(df.limit(0), F.lit(True)).count() == 0


def test_held_out_rows_of_the_query(spark):
    ids = spark.range(40).select(F.col("id").alias("doc_id"), (F.crc32(F.col("id").cast("string").cast("binary")) % 7 == 2).alias("out"))
    assert all(r["out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in ids.collect())
