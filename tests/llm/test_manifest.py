"""Merkle manifest and multiproofs against a plain tree: widths around runs and partitions, nulls, repeated rows, least coordinates."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafspan.llm import manifest
from leafspan.llm.common import Workspace

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, part int, leaf string, position long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def digest(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def up(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def way(levels, at):
    out = []
    for level in levels[:-1]:
        out.append((level[at ^ 1] if at ^ 1 < len(level) else None, bool(at & 1)))
        at >>= 1
    return out


def brute(rows, tamper):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    names = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for own in by_lang.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
    trees = {n: up([digest(r) for r in by_lang[n]]) for n in names}
    top = up([trees[n][-1][0] for n in names])
    root, out = top[-1][0], []
    for t, n in enumerate(names):
        for i, r in enumerate(by_lang[n]):
            path = way(trees[n], i) + way(top, t)
            folded = digest(tamper(r))
            for s, left in path:
                folded = sha(folded) if s is None else sha(s, folded) if left else sha(folded, s)
            proof = sha(*[s for s, _ in path if s is not None])
            out.append((r[0], digest(r), trees[n][-1][0], root, proof, folded, folded == root))
    return sorted(out, key=repr)


def rows_of(n, seed):
    draw = np.random.default_rng(seed)
    names = [None, "a", "b", "é", "zz", ""]
    return [(i, f"s{i % 3}" if i % 7 else None, names[int(draw.integers(0, 6) * (draw.random() < 0.4))], None if i % 11 == 0 else i, None if i % 13 == 0 else "é" * (i % 5)) for i in range(n)]


def tamper(r):
    return (*r[:3], None if r[3] is None else r[3] + 1, r[4]) if r[0] is not None and r[0] % 4 == 1 else r


def proved(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x", 5) for r in rows], SCHEMA).repartition(3)
    claims = {"n_chars": F.when(F.col("doc_id") % 4 == 1, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    found = manifest.verified_rows(df, claims, **more).drop("n_siblings").collect()
    return sorted(map(tuple, found), key=repr)


@pytest.mark.parametrize("height,partition_leaves", [(2, 5), (3, 8), (10, 4096)])
def test_equal_to_a_plain_tree(spark, height, partition_leaves):
    rows = rows_of(150, height)
    rows += [rows[5], rows[5], (None, None, None, None, None), (None, "s", "a", 3, ""), (None, "s", "a", 3, "")]
    got = proved(spark, rows, height=height, partition_leaves=partition_leaves)
    assert got == brute(rows, tamper) and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 16, 17])
def test_few_rows(spark, n):
    rows = [(i, "s", "one", i, "text") for i in range(n)]
    got = proved(spark, rows, height=2, partition_leaves=4)
    assert got == (brute(rows, tamper) if rows else [])


def test_long_texts_and_many_groups(spark):
    rows = [(i, "s", f"g{i:03d}", 1, "x" * (400_000 if i == 3 else i)) for i in range(40)]
    assert proved(spark, rows, height=2, partition_leaves=7) == brute(rows, tamper)


def test_fewest_coordinates():
    draw = np.random.default_rng(1)
    for _ in range(200):
        width = int(draw.integers(1, 40))
        known = np.unique(draw.integers(0, width, int(draw.integers(1, width + 1))))
        levels = up([str(i) for i in range(width)])
        # All nodes on the ways of the leaves can be derived; a sibling is needed exactly where it is none of them.
        own = {(n, int(i) >> n) for i in known for n in range(len(levels))}
        beside = {(n, i ^ 1) for n, i in own if n < len(levels) - 1 and i ^ 1 < len(levels[n])} - own
        assert set(manifest.missing(known, width)) == beside
        fetched = {(n, i): levels[n][i] for n, i in beside}
        derived, widths = manifest.proofs({int(i): levels[0][i] for i in known}, width, fetched)
        assert derived[-1][0] == levels[-1][0]
        for i in known.tolist():
            assert manifest.siblings(derived, widths, i) == way(levels, i)


def test_some_leaves_ask_for_less_than_their_single_proofs(spark):
    work = Workspace(spark)
    df = spark.createDataFrame([(i, sha(str(i))) for i in range(200)], "id long, leaf string").select("id", F.lit("l").alias("name"), "leaf", F.col("leaf").alias("also"))
    made = manifest.manifest(df, work, height=3)
    some = made.leaves.where("id % 3 = 0 or id > 150")
    asked = manifest.needed(some, made.trees, 64)
    found = manifest.prove(made, some, "long", work, 64, 3).collect()
    assert len(found) == some.count() and all(r["verified"] for r in found)
    assert asked.count() == asked.distinct().count() and asked.count() < sum(r["n_siblings"] for r in found) / 3
    work.close()
