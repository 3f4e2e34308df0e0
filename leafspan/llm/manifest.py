"""Merkle manifest of a dataset with octopus multiproofs.

Every group (language) of rows is a tree of its leaves in order, the trees' roots are the leaves of one top tree. Trees are
built in rounds: aligned runs of leaves become the levels above them inside tasks, and the next round goes on from their tops.

Proofs are made per leaf partition, a run of consecutive leaves: the partition works out the least set of node coordinates
that it can neither hold nor derive, these are fetched by one join, the inner nodes that its leaves share are derived once,
and each leaf's own proof is expanded from them where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspan.llm.common import Workspace, query, table
from leafspan.session import cut_lineage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Levels that a task builds at once, leaves of a task, leaves that are proved together.
HEIGHT = 10
ROWS_PER_TASK = 16_384
PARTITION_LEAVES = 4_096
# Nodes that many partitions ask for are kept this many times.
SALTS = 16
TOP = -1  # number of the tree over the groups' roots

NODES = "tree long, level int, at long, width long, digest string"


def leaf_digest(values: Iterable[Column]) -> Column:
    """SHA-256 over the values, each as its UTF-8 byte count, ``:`` and itself, or ``-`` for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def node_digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def numbered(rows: DataFrame, order: list[Column], work: Workspace, name: str = "position") -> DataFrame:
    """The rows in a global order with a gapless ``name`` from 0; no task holds more than one range of them."""
    placed = work.keep(rows.sort(*order).select("*", F.monotonically_increasing_id().alias("__place")))
    part = F.shiftright("__place", 33)
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("part")).count().collect())
    starts, total = [], 0
    for number, count in counts:
        starts.append((number, total))
        total += count
    offsets = rows.sparkSession.createDataFrame(starts or [(0, 0)], "__part long, __start long")
    joined = placed.withColumn("__part", part).join(offsets, "__part")
    return joined.withColumn(name, F.col("__start") + F.col("__place").bitwiseAND((1 << 33) - 1)).drop("__part", "__start", "__place")


def _levels(height: int, base: int):
    """The up to ``height`` levels above aligned runs of nodes of level ``base``, of one or many trees."""
    schema = pa.schema([("tree", pa.int64()), ("level", pa.int32()), ("at", pa.int64()), ("width", pa.int64()), ("digest", pa.string())])

    def run(part: pa.Table) -> pa.Table:
        tree, at, width = (part.column(c).to_numpy() for c in ("tree", "at", "width"))
        order = np.lexsort((at, tree))
        tree, at, width = tree[order], at[order], width[order]
        digests = part.column("digest").take(pa.array(order)).to_pylist()
        out = [schema.empty_table()]
        for level in range(base + 1, base + height + 1):
            more = width > 1
            if not more.any():
                break
            digests = [d for d, m in zip(digests, more.tolist()) if m]
            tree, above, width = tree[more], at[more] >> 1, width[more]
            begins = np.flatnonzero(np.concatenate([[True], (tree[1:] != tree[:-1]) | (above[1:] != above[:-1])]))
            ends = np.append(begins[1:], len(tree))
            digests = [node_digest(*digests[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
            tree, at, width = tree[begins], above[begins], (width[begins] + 1) >> 1
            out.append(pa.table([tree, np.full(len(tree), level, np.int32), at, width, pa.array(digests, pa.string())], schema=schema))
        return pa.concat_tables(out)

    return run


def build(leaves: DataFrame, work: Workspace, height: int = HEIGHT) -> DataFrame:
    """All nodes above ``leaves`` (``tree, at, width, digest``; ``width`` is the number of the tree's leaves), with their levels."""
    count, widest = leaves.agg(F.count("*"), F.max("width")).first()
    made, base, rows = None, 0, leaves.select("tree", "at", "width", "digest")
    while (widest or 0) > 1:
        tasks = max(64, count // ROWS_PER_TASK)
        task = F.pmod(F.xxhash64("tree", F.shiftright("at", height)), F.lit(tasks))
        grouped = rows.where("width > 1").groupBy(task.alias("task"))
        new = work.keep(grouped.applyInArrow(_levels(height, base), NODES))
        made = new if made is None else made.unionByName(new)
        base, widest = base + height, -(-widest // (1 << height))
        rows = new.where(F.col("level") == base)
    return made if made is not None else leaves.sparkSession.createDataFrame([], NODES)


@dataclass
class Manifest:
    """``leaves``: ``id, leaf, also, position, tree, at, width``; ``nodes``: all nodes of all trees; ``root``: None without rows."""

    leaves: DataFrame
    nodes: DataFrame
    trees: int
    root: str | None


def manifest(rows: DataFrame, work: Workspace, height: int = HEIGHT) -> Manifest:
    """Trees over ``rows`` (``id, name, leaf, also``), one for each ``name`` (null is one of them), ordered by it, bytewise.

    Leaves ascend by ``id``, nulls first; rows of the same id by their digest. A single leaf is its tree's root, and a single
    tree's root is the root.
    """
    narrow = work.keep(rows.select("id", "name", "leaf", "also"))
    order = [F.col(c).asc_nulls_first() for c in ("name", "id", "leaf")]
    placed = numbered(narrow, order, work)
    groups = work.keep(placed.groupBy("name").agg(F.min("position").alias("first"), F.count("*").alias("width")))
    groups = work.keep(numbered(groups, [F.col("first")], work, "tree"))
    trees = groups.count()
    joined = placed.join(groups.withColumnRenamed("name", "__name"), F.col("name").eqNullSafe(F.col("__name")))
    leaves = work.keep(joined.select("id", "leaf", "also", "position", "tree", (F.col("position") - F.col("first")).alias("at"), "width"))
    own = leaves.select("tree", F.lit(0).alias("level"), "at", "width", F.col("leaf").alias("digest"))
    inner = build(own, work, height)
    nodes = own.unionByName(inner)
    roots = nodes.where("width = 1").select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("at"), F.lit(trees).cast("long").alias("width"), "digest"
    )
    roots = work.keep(roots)
    top = roots.unionByName(build(roots, work, height))
    root = top.where("width = 1").select("digest").first()
    return Manifest(leaves, nodes.unionByName(top), trees, root["digest"] if root else None)


def missing(at: np.ndarray, width: int) -> list[tuple[int, int]]:
    """The fewest (level, place) of nodes that lead from the leaves ``at`` of a tree of ``width`` leaves to its root."""
    known, level, out = np.unique(at), 0, []
    while width > 1:
        beside = known ^ 1
        out += [(level, int(i)) for i in np.setdiff1d(beside[beside < width], known)]
        known, level, width = np.unique(known >> 1), level + 1, (width + 1) >> 1
    return out


def _trees_of(part: pa.Table, trees: int) -> list[tuple[int, int, np.ndarray]]:
    """Number, width and known leaves of each tree that a partition of leaves touches, the top tree last."""
    tree, at, width = (part.column(c).to_numpy() for c in ("tree", "at", "width"))
    numbers, first = np.unique(tree, return_index=True)
    return [(int(n), int(width[f]), at[tree == n]) for n, f in zip(numbers, first)] + [(TOP, trees, numbers)]


def proofs(tree: dict[int, str], width: int, fetched: dict[tuple[int, int], str]) -> tuple[list[dict[int, str]], list[int]]:
    """Nodes by level that follow from leaves and fetched nodes, up to the root, and the levels' widths."""
    levels, widths = [dict(tree)], [width]
    while widths[-1] > 1:
        level = len(levels) - 1
        below = levels[level]
        for i in list(below):
            if i ^ 1 < widths[level] and i ^ 1 not in below:
                below[i ^ 1] = fetched[level, i ^ 1]
        pairs = {i >> 1 for i in below}
        levels.append({i: node_digest(*[below[j] for j in (2 * i, 2 * i + 1) if j in below]) for i in pairs})
        widths.append((widths[-1] + 1) >> 1)
    return levels, widths


def siblings(levels: list[dict[int, str]], widths: list[int], at: int) -> list[tuple[str | None, bool]]:
    """On the way from a leaf to the root, the sibling (None: there is none) and whether it stands to the left."""
    return [(levels[level].get(at >> level ^ 1), bool(at >> level & 1)) for level in range(len(levels) - 1)]


def fold(leaf: str, path: list[tuple[str | None, bool]]) -> str:
    """The root that a leaf and the siblings on its way lead to."""
    for sibling, left in path:
        leaf = node_digest(leaf) if sibling is None else node_digest(sibling, leaf) if left else node_digest(leaf, sibling)
    return leaf


def needed(leaves: DataFrame, trees: int, partition_leaves: int = PARTITION_LEAVES) -> DataFrame:
    """``part, tree, level, at``: for every partition of leaves, the least union of coordinates that its proofs need."""

    def run(part: pa.Table) -> pa.Table:
        found = [(tree, *node) for tree, width, at in _trees_of(part, trees) for node in missing(at, width)]
        number = part.column("part")[0].as_py()
        return pa.table({
            "part": pa.array([number] * len(found), pa.int64()), "tree": pa.array([f[0] for f in found], pa.int64()),
            "level": pa.array([f[1] for f in found], pa.int32()), "at": pa.array([f[2] for f in found], pa.int64()),
        })

    rows = leaves.select(F.floor(F.col("position") / partition_leaves).alias("part"), "tree", "at", "width")
    return rows.groupBy("part").applyInArrow(run, "part long, tree long, level int, at long")


def prove(
    made: Manifest, claimed: DataFrame, id_type: str, work: Workspace, partition_leaves: int = PARTITION_LEAVES, height: int = HEIGHT
) -> DataFrame:
    """Proofs of the leaves in ``claimed`` (rows of ``made.leaves``, all or some), each folded from the digest in ``also``.

    Returns ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, n_siblings``.
    """
    asked = work.keep(needed(claimed, made.trees, partition_leaves))
    parts = -(-claimed.count() // partition_leaves)
    top_salts = max(1, min(SALTS, parts // max(1, made.trees)))
    salts = F.when(F.col("tree") == TOP, top_salts).when(F.col("level") >= height, SALTS).otherwise(1)
    nodes = made.nodes.select("tree", "level", "at", "digest", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    fetched = asked.withColumn("salt", F.pmod(F.col("part"), salts).cast("int")).join(nodes, ["tree", "level", "at", "salt"])
    fetched = fetched.select("part", "tree", "level", "at", "digest")
    root, trees = made.root, made.trees

    def run(own: pa.Table, sent: pa.Table) -> pa.Table:
        held: dict[int, dict[tuple[int, int], str]] = {}
        for tree, level, at, digest in zip(*(sent.column(c).to_pylist() for c in ("tree", "level", "at", "digest"))):
            held.setdefault(tree, {})[level, at] = digest
        tree, at, leaf, also = (own.column(c).to_pylist() for c in ("tree", "at", "leaf", "also"))
        leaves: dict[int, dict[int, str]] = {}
        for t, a, digest in zip(tree, at, leaf):
            leaves.setdefault(t, {})[a] = digest
        known, subroots = {}, {}
        for number, width, _ in _trees_of(own, trees):
            levels, widths = proofs(leaves[number] if number != TOP else subroots, width, held.get(number, {}))
            known[number] = levels, widths
            subroots[number] = levels[-1][0]
        out = {c: [] for c in ("subroot", "proof_sha256", "folded_root", "verified", "n_siblings")}
        for t, a, digest in zip(tree, at, also):
            path = siblings(*known[t], a) + siblings(*known[TOP], t)
            there = [s for s, _ in path if s is not None]
            folded = fold(digest, path)
            for name, value in zip(out, (subroots[t], node_digest(*there), folded, folded == root, len(there))):
                out[name].append(value)
        return pa.table({
            "doc_id": own.column("id"), "leaf": own.column("leaf"), "subroot": pa.array(out["subroot"], pa.string()),
            "root": pa.array([root] * len(tree), pa.string()), "proof_sha256": pa.array(out["proof_sha256"], pa.string()),
            "folded_root": pa.array(out["folded_root"], pa.string()), "verified": pa.array(out["verified"], pa.bool_()),
            "n_siblings": pa.array(out["n_siblings"], pa.int32()),
        })

    rows = claimed.withColumn("part", F.floor(F.col("position") / partition_leaves))
    schema = f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, n_siblings int"
    return rows.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(run, schema)


def verified_rows(
    docs: DataFrame, claims: dict[str, Column] | None = None, id_col: str = "doc_id", group_col: str = "lang",
    fields: tuple[str, ...] = FIELDS, height: int = HEIGHT, partition_leaves: int = PARTITION_LEAVES,
) -> DataFrame:
    """A manifest over ``docs`` and, for each row, its proof, checked against the row in which ``claims`` replace fields.

    One row per row: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, n_siblings``. Nulls count as ``-`` in a
    leaf; null groups form a tree, null ids come first in it; empty texts have length 0; rows of the same id are ordered by their
    digest, and rows that are equal throughout are leaves of their own. An empty table gives no rows; other columns are not
    looked at.
    """
    claims = claims or {}
    work = Workspace(docs.sparkSession)
    leaf = leaf_digest([F.col(c) for c in fields])
    also = leaf_digest([claims.get(c, F.col(c)) for c in fields]) if claims else leaf
    rows = docs.select(F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("name"), leaf.alias("leaf"), also.alias("also"))
    made = manifest(rows, work, height)
    found = cut_lineage(prove(made, made.leaves, dict(rows.dtypes)["id"], work, partition_leaves, height))
    work.close()
    return found


# CRC-32 of the decimal id, and the trees level by level.
SQL = """
WITH RECURSIVE doc AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
      lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT) AS crc
  FROM documents),
field AS (
  SELECT doc_id, lang, crc,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS n,
    coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)::VARCHAR, '-') AS n1,
    coalesce(strlen(text) || ':' || text, '-') AS b
  FROM doc),
leaf AS (
  SELECT doc_id, lang, sha256(a || n || b) AS leaf, sha256(a || CASE WHEN crc % 7 = 0 THEN n1 ELSE n END || b) AS claimed,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM field),
node AS (
  SELECT lang, 0 AS level, i, n, leaf AS digest FROM leaf
  UNION ALL
  SELECT lang, level + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY lang, level, i // 2),
tree AS (SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM node WHERE n = 1),
top AS (
  SELECT 0 AS level, i, n, digest FROM tree
  UNION ALL
  SELECT level + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 2),
step AS (
  SELECT doc_id, own.level, b.digest AS sibling, own.i % 2 = 1 AS is_left
  FROM leaf JOIN node own ON own.lang IS NOT DISTINCT FROM leaf.lang AND own.i = leaf.i >> own.level AND own.n > 1
  LEFT JOIN node b ON b.lang IS NOT DISTINCT FROM own.lang AND b.level = own.level AND b.i = xor(own.i, 1)
  UNION ALL
  SELECT doc_id, 100 + own.level, b.digest, own.i % 2 = 1
  FROM leaf JOIN tree ON tree.lang IS NOT DISTINCT FROM leaf.lang JOIN top own ON own.i = tree.i >> own.level AND own.n > 1
  LEFT JOIN top b ON b.level = own.level AND b.i = xor(own.i, 1)),
path AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY level) AS k FROM step),
proof AS (SELECT doc_id, string_agg(sibling, '' ORDER BY k) AS p, max(k) AS k FROM path GROUP BY doc_id),
folded AS (
  SELECT doc_id, 0::BIGINT AS k, claimed AS digest FROM leaf
  UNION ALL
  SELECT f.doc_id, p.k, sha256(CASE WHEN is_left THEN coalesce(sibling, '') || digest ELSE digest || coalesce(sibling, '') END)
  FROM folded f JOIN path p ON p.doc_id = f.doc_id AND p.k = f.k + 1),
result AS (
  SELECT leaf.doc_id, leaf.leaf, tree.digest AS subroot, (SELECT digest FROM top WHERE n = 1) AS root,
    sha256(coalesce(p, '')) AS proof_sha256, f.digest AS folded_root
  FROM leaf JOIN tree ON tree.lang IS NOT DISTINCT FROM leaf.lang LEFT JOIN proof ON proof.doc_id = leaf.doc_id
  JOIN folded f ON f.doc_id = leaf.doc_id AND f.k = coalesce(proof.k, 0))
SELECT *, folded_root = root AS verified FROM result
"""


@query("op12_merkle_manifest", SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    claims = {"n_chars": F.when(touched, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    return verified_rows(table(spark, folder, "documents"), claims).drop("n_siblings")
