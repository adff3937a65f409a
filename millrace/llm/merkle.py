"""Merkle manifest of a dataset: a tree for each group of rows, the groups' roots below one root.

Rows are numbered by a range sort, cut into aligned blocks, and blocks become nodes of
the next level until a group has one. Going down again, each block walks its leaves by
fractal traversal, which keeps a small subtree at each layer of the block, and appends
the proof of the block's own root to each path.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import bounded, discard, materialise

BLOCK_LEVELS = 12  # a block has 2**12 nodes at most: what a task holds
LAYER = 3  # levels of a traversal's subtrees
_NODE = "grp string, idx long, digest string, width long"
_PROOF = "grp string, idx long, proof string, subroot string, root string"


def digest(text: bytes) -> bytes:
    return sha256(text).hexdigest().encode()


def joined(left: bytes | None, right: bytes | None) -> bytes | None:
    """The node above a run; beyond the last node there is nothing."""
    return None if left is None else digest(left + right) if right is not None else digest(left)


class _Growing:
    """The nodes of levels [base, top) below one node of level `top`, made as leaves come one by one."""

    def __init__(self, base: int, top: int):
        self.base, self.top = base, top
        self.nodes: list[list] = [[] for _ in range(base, top)]
        self.stack: list[tuple[int, bytes | None]] = []

    def feed(self, node: bytes | None) -> None:
        level = 0
        while True:
            if level >= self.base:
                self.nodes[level - self.base].append(node)
            if level == self.top - 1:
                return
            if not self.stack or self.stack[-1][0] != level:
                self.stack.append((level, node))
                return
            node = joined(self.stack.pop()[1], node)
            level += 1


def fractal_paths(leaves: list[bytes], height: int, layer: int = LAYER) -> Iterator[list[bytes]]:
    """The steps from each leaf in turn to the root of a block, `height` levels up.

    A step is b"L" or b"R" and the sibling on that side, or b"N" where the node is alone.
    Every `layer` levels have an existing subtree around the current leaf and, but for the
    top ones, a desired one to its right, which takes one leaf a step and so is complete
    when the traversal gets there.
    """
    bounds = [(base, min(base + layer, height)) for base in range(0, height, layer)]
    existing, desired = [], []
    for base, top in bounds:
        tree = _Growing(base, top)
        for i in range(1 << top):
            tree.feed(leaves[i] if i < len(leaves) else None)
        existing.append(tree)
        desired.append(_Growing(base, top))
    for j in range(len(leaves)):
        path = []
        for k, (base, top) in enumerate(bounds):
            span = 1 << top
            if j and j % span == 0:
                existing[k], desired[k] = desired[k], _Growing(base, top)
            inside = j % span
            for level in range(base, top):
                at = inside >> level
                sibling = existing[k].nodes[level - base][at ^ 1]
                path.append(b"N" if sibling is None else (b"L" if at & 1 else b"R") + sibling)
            if j - inside + span < len(leaves):
                ahead = j + span
                desired[k].feed(leaves[ahead] if ahead < len(leaves) else None)
        yield path


def fold(node: bytes, steps: list[bytes]) -> bytes:
    """The root that a node and its steps give."""
    for step in steps:
        node = digest(step[1:] + node if step[:1] == b"L" else node + step[1:])
    return node


def steps_of(proof: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(proof):
        end = at + (1 if proof[at : at + 1] == b"N" else 65)
        out.append(proof[at:end])
        at = end
    return out


def _height(width: int, bits: int) -> int:
    """Levels of a block in a group with `width` nodes on its level."""
    return min(bits, (width - 1).bit_length())


def _numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, tuple]:
    """`rows`, a written table with `grp`, with idx and width: the place in its group by `order`, and the group's size;
    and the tables that it reads.

    A range sort gives the order; a group's rows in earlier partitions are counted. Rows that
    agree in all of `order` are dealt by a seeded number, so that copies of one row don't meet in one task.
    """
    keys = ["grp", *order]
    first = [F.asc_nulls_first(k) for k in keys]
    pos = rows.withColumn("_salt", F.rand(7)).repartitionByRange(*first, "_salt").sortWithinPartitions(*first).drop("_salt").withColumn("_pos", F.monotonically_increasing_id())
    placed = materialise(pos.withColumn("_part", F.shiftright("_pos", 33)), "merkle-order")
    earlier = Window.partitionBy("grp").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy("grp", "_part").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    runs = runs.withColumns({"_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "width": F.sum("_n").over(Window.partitionBy("grp"))})
    runs = materialise(runs.drop("_n"), "merkle-runs")
    out = placed.join(bounded(runs, 100_000), ["grp", "_part"]).withColumn("idx", F.col("_pos") - F.col("_first") + F.col("_before"))
    return out.drop("_pos", "_part", "_first", "_before"), (placed, runs)


def _above(nodes: DataFrame, bits: int) -> DataFrame:
    """The level that the blocks of `nodes` make."""

    def root(key, table):
        table = table.sort_by("idx")
        width = table["width"][0].as_py()
        level = [x.encode() for x in table["digest"].to_pylist()]
        for _ in range(_height(width, bits)):
            level = [joined(level[i], level[i + 1] if i + 1 < len(level) else None) for i in range(0, len(level), 2)]
        return pa.table({"grp": [key[0].as_py()], "idx": [key[1].as_py()], "digest": [level[0].decode()], "width": [-(-width >> bits)]})

    blocks = nodes.select("grp", "idx", "digest", "width", F.shiftright("idx", bits).alias("block"))
    return blocks.groupBy("grp", "block").applyInArrow(root, _NODE)


def _climb(nodes: DataFrame, bits: int, name: str) -> list[DataFrame]:
    """All levels, from `nodes` to the one where each group has a single node, which is its root."""
    levels = [nodes]
    while levels[-1].where("width > 1").limit(1).count():
        levels.append(materialise(_above(levels[-1], bits), f"merkle-{name}"))
    return levels


def _below(nodes: DataFrame, parents: DataFrame, bits: int) -> DataFrame:
    """The proofs of a level's nodes: each block's paths, followed by the block's own proof."""

    def walk(key, left, right):
        left = left.sort_by("idx")
        above = right["proof"][0].as_py()
        leaves = [x.encode() for x in left["digest"].to_pylist()]
        proofs = [b"".join(path).decode() + above for path in fractal_paths(leaves, _height(left["width"][0].as_py(), bits))]
        same = {c: [right[c][0].as_py()] * len(proofs) for c in ("subroot", "root")}
        return pa.table({"grp": [key[0].as_py()] * len(proofs), "idx": left["idx"], "proof": pa.array(proofs, pa.string()), **same})

    blocks = nodes.select("grp", "idx", "digest", "width", F.shiftright("idx", bits).alias("block"))
    return blocks.groupBy("grp", "block").cogroup(parents.groupBy("grp", "idx")).applyInArrow(walk, _PROOF)


def _descend(levels: list[DataFrame], proofs: DataFrame, bits: int, name: str) -> DataFrame:
    """Proofs of level 1 (of level 0 where that is all) from those of the roots."""
    for nodes in levels[-2:0:-1]:
        before, proofs = proofs, materialise(_below(nodes, proofs, bits), f"merkle-{name}-proofs")
        discard(before)
    return proofs


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, one after the other: `-` for null, else the UTF-8 byte count, `:` and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def merkle_manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    group_col: str = "lang",
    audited: dict[str, Column] | None = None,
    keep_proof: bool = True,
    block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """The leaf, roots and authentication path of every row, and the root that an audited copy of the row folds to.

    A leaf is `leaf_digest` of `fields`. A group's leaves ascend by id (nulls first; rows of one id by
    their leaf), and every two consecutive nodes become one until one is left; the last node of an odd
    level is hashed alone. Groups' roots, ordered by group (null first, then by UTF-8 bytes), likewise
    give the root. `audited` maps fields to the values found now; without it nothing has changed.

    Returns doc_id, grp_index (the place in its group), leaf, subroot, root, proof (a step a level from
    the leaf to the root: `L` or `R` and the sibling's digest, or `N` for a node alone; with
    `keep_proof`), proof_sha256 (of the siblings, one after the other), folded_root and verified
    (folded_root equals root). Null ids, groups and fields are values of their own; rows that repeat are
    leaves of their own; an empty table gives no rows; texts of any length are hashed whole; other columns
    of `docs` are ignored. A task holds one block of 2**`block_levels` nodes, or one of its rows' texts.
    """
    col = lambda name: F.col(f"`{name}`")
    audited = audited or {}
    leaf = leaf_digest([col(f) for f in fields])
    changed = reduce(lambda a, b: a | b, [~audited[f].eqNullSafe(col(f)) for f in fields if f in audited], F.lit(False))
    found = F.when(changed, leaf_digest([audited.get(f, col(f)) for f in fields]))
    group = col(group_col).cast("string")
    rows = docs.select(col(id_col).alias("doc_id"), F.when(group.isNull(), "-").otherwise(F.concat(F.lit("="), group)).alias("grp"), leaf.alias("leaf"), found.alias("found"))
    rows = materialise(rows, "merkle-leaves")  # texts are read and hashed once; the range sort samples what it sorts
    leaves, _ = _numbered(rows, ["doc_id", "leaf"])
    levels = _climb(leaves.withColumn("digest", F.col("leaf")), block_levels, "nodes")

    roots = materialise(levels[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), "merkle-subroots")
    groups, held = _numbered(roots, ["name"])
    tops = _climb(groups, block_levels, "top")
    top = tops[-1].select("grp", "idx", F.lit("").alias("proof"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    top = _descend(tops, top, block_levels, "top")
    if len(tops) > 1:
        top = _below(groups, top, block_levels)
    own = groups.select("idx", "name", "digest").join(top.select("idx", "proof", "root"), "idx")
    own = materialise(own.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("idx"), "proof", F.col("digest").alias("subroot"), "root"), "merkle-groups")
    proofs = _descend(levels, own, block_levels, "nodes")

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, grp_index long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (", proof string" if keep_proof else "")

    def manifest(key, left, right):
        left = left.sort_by("idx")
        leaves = [x.encode() for x in left["leaf"].to_pylist()]
        found = [x and x.encode() for x in left["found"].to_pylist()]
        upper = steps_of(right["proof"][0].as_py().encode())
        subroot, root = right["subroot"][0].as_py(), right["root"][0].as_py()
        siblings, folded, kept = [], [], []
        for own, now, path in zip(leaves, found, fractal_paths(leaves, _height(left["width"][0].as_py(), block_levels))):
            path = path + upper
            siblings.append(sha256(b"".join([step[1:] for step in path])).hexdigest())
            folded.append(fold(now or own, path).decode())
            if keep_proof:
                kept.append(b"".join(path).decode())
        n = len(leaves)
        out = {"doc_id": left["doc_id"], "grp_index": left["idx"], "leaf": left["leaf"], "subroot": pa.array([subroot] * n, pa.string()), "root": pa.array([root] * n, pa.string())}
        out |= {"proof_sha256": pa.array(siblings, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([x == root for x in folded], pa.bool_())}
        return pa.table(out | ({"proof": pa.array(kept, pa.string())} if keep_proof else {}))

    blocks = leaves.select("doc_id", "grp", "idx", "leaf", "found", "width", F.shiftright("idx", block_levels).alias("block"))
    out = blocks.groupBy("grp", "block").cogroup(proofs.groupBy("grp", "idx")).applyInArrow(manifest, schema)
    discard(rows, roots, *levels[1:], *tops[1:], *held)
    return out
