"""Merkle manifest of a table: checkpoint-and-recompute.

Every row is a leaf. Each source has a tree over its leaves in id order, and one
tree over the sources' roots gives the root of the table. Every run of three
neighbours has one parent. Only every ``stride``-th level is stored, as aligned
blocks of 3 ** stride neighbours. A proof needs the levels between too: they are
regenerated block by block from the stored descendants, give the siblings of
each node of the block, and are discarded.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.llm.common import written

ARITY = 3
#: levels between two stored ones: blocks of at most 27 nodes
STRIDE = 3
#: blocks whose proofs go into one Arrow batch
BLOCKS_A_BATCH = 256
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def leaf_digest(**instead: Column) -> Column:
    """Lower-case hex SHA-256 of a row's fields, each ``-`` if null, else its bytes in UTF-8, ``:``, its value.

    ``instead``: a column to take for a field.
    """

    def field(name: str) -> Column:
        value = instead.get(name, F.col(name)).cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*[field(f) for f in FIELDS]), 256)


def tree_of(source: Column) -> Column:
    """A text that isn't null and sorts as the source does: null first, then bytewise."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source.cast("string")))


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows(tree, ...) with pos, a row's place in its tree, and n, the rows of the tree.

    Rows are dealt out by ranges of (tree, order), so a hot tree lies in many
    tasks; equal rows, which are alike in every column, part by their place in the
    input. A range's first place in a tree is the sum of the ranges before it.
    """
    keys = ["tree", *order, "_row"]
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
    rows, _ = written(rows.withColumn("_at", F.monotonically_increasing_id()), "merkle-ordered")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    ranges = rows.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
    tree = Window.partitionBy("tree")
    before = F.sum("_size").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("tree", "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_size").over(tree).alias("n"))
    placed = rows.join(ranges, ["tree", "_part"])
    return placed.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_first", "_before")


def _blocks(nodes: DataFrame, stride: int, payload: list[str]) -> DataFrame:
    """nodes(tree, pos, n, digest, payload) -> stored blocks (tree, block, n, up, nodes).

    ``up``: the levels from the block's nodes to its top, none in a tree of one node.
    """
    up = sum((F.when(F.col("n") > ARITY**t, 1).otherwise(0) for t in range(stride)), F.lit(0))
    return (
        nodes.groupBy("tree", F.expr(f"pos div {ARITY**stride}").alias("block"))
        .agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "digest", *payload))).alias("nodes"))
        .select("tree", "block", "n", up.cast("int").alias("up"), "nodes")
    )


def climb(digests: list[str], up: int) -> list[list[str]]:
    """A block's levels from its nodes to its top."""
    levels = [digests]
    for _ in range(up):
        below = levels[-1]
        levels.append([sha256("".join(below[i : i + ARITY]).encode()).hexdigest() for i in range(0, len(below), ARITY)])
    return levels


def _digests(batch: pa.RecordBatch) -> list[list[str]]:
    """The digests of each block of a batch."""
    nodes = batch.column("nodes")
    flat = nodes.flatten().field("digest").to_pylist()
    ends = np.cumsum(nodes.value_lengths().to_numpy(zero_copy_only=False))
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _tops(blocks: DataFrame, stride: int) -> DataFrame:
    """(tree, pos, n, digest) of the blocks' tops, the nodes of the next stored level."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                tops = [climb(d, up)[-1][0] for d, up in zip(_digests(batch), batch.column("up").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("tree", "pos", "n")), pa.array(tops)], names=["tree", "pos", "n", "digest"])

    n = F.ceil(F.col("n") / F.lit(ARITY**stride)).cast("long").alias("n")
    # a block's nodes travel without what the leaves carry beside their digest
    digests = F.transform("nodes", lambda x: F.struct(x["digest"].alias("digest"))).alias("nodes")
    rows = blocks.select("tree", F.col("block").alias("pos"), n, "up", digests)
    return rows.mapInArrow(run, "tree string, pos long, n long, digest string")


@dataclass
class Forest:
    """The stored levels of some trees, as blocks, and each tree's root (tree, digest)."""

    levels: list[DataFrame]
    roots: DataFrame


def _grown(nodes: DataFrame, stride: int, payload: list[str]) -> Forest:
    levels = []
    while True:
        blocks, _ = written(_blocks(nodes, stride, payload if not levels else []), f"merkle-level-{stride * len(levels)}")
        levels.append(blocks)
        nodes = _tops(blocks, stride)
        # the tops of the largest tree are many unless its blocks are one
        if (blocks.agg(F.max("n")).first()[0] or 0) <= ARITY**stride:
            roots, _ = written(nodes.select("tree", "digest"), "merkle-roots")
            return Forest(levels, roots)


def _paths(forest: Forest, above: DataFrame, carried: list[str]) -> DataFrame:
    """(tree, carried, path, node) of every leaf; path: the siblings (left, right) of each level up to above's.

    above(tree, carried, path) holds what follows a tree's own levels.
    """
    path_type = pa.list_(pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, BLOCKS_A_BATCH):
                batch = whole.slice(a, BLOCKS_A_BATCH)
                paths = []
                for digests, up in zip(_digests(batch), batch.column("up").to_pylist(), strict=True):
                    levels = climb(digests, up)
                    own = []
                    for j in range(len(digests)):
                        steps, i = [], j
                        for level in levels[:-1]:
                            run_ = i // ARITY * ARITY
                            steps.append({"left": "".join(level[run_:i]), "right": "".join(level[i + 1 : run_ + ARITY])})
                            i //= ARITY
                        own.append(steps)
                    paths.append(own)
                kept = [batch.column(c) for c in ("tree", *carried, "path", "nodes")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(paths, path_type)], names=["tree", *carried, "path", "nodes", "own"])

    parents = above.withColumn("block", F.lit(0).cast("long"))
    for k in reversed(range(len(forest.levels))):
        rows = forest.levels[k].join(parents, ["tree", "block"]).select("tree", "up", *carried, "path", "nodes")
        types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        schema = ", ".join(f"{c} {types[c]}" for c in ("tree", *carried, "path", "nodes")) + f", own array<{PATH}>"
        each = rows.mapInArrow(run, schema).select("tree", *carried, "path", F.explode(F.arrays_zip("nodes", "own")).alias("z"))
        each = each.select("tree", *carried, F.concat("z.own", "path").alias("path"), F.col("z.nodes").alias("node"))
        parents = each.select("tree", *carried, "path", F.col("node.pos").alias("block"))
    return each


@dataclass
class Manifest:
    """Trees of the sources, the tree over their roots, and the columns that leaves carry."""

    sources: Forest
    top: Forest
    payload: list[str]


def build(docs: DataFrame, stride: int = STRIDE, **carry: Column) -> Manifest:
    """The stored levels for docs(doc_id, source, lang, n_chars, text).

    Leaves of a source ascend by doc_id (null first), equal ids by their digest.
    ``carry``: further columns, from those of docs, that each leaf keeps. Null
    fields are part of the digest, a null source is a source of its own before all
    others, repeated rows are a leaf each, other columns are not read. An empty
    table has no roots.
    """
    payload = ["doc_id", *carry]
    leaves = docs.select(tree_of(F.col("source")).alias("tree"), leaf_digest().alias("digest"), "doc_id", *[c.alias(k) for k, c in carry.items()])
    leaves, _ = written(leaves, "merkle-leaves")  # hashed once: a range exchange reads its input twice
    sources = _grown(_numbered(leaves, ["doc_id", "digest"]), stride, payload)
    # the members' own names are the order of the one tree over them
    members = sources.roots.select(F.lit("").alias("tree"), F.col("tree").alias("member"), "digest")
    top = _grown(_numbered(members, ["member"]), stride, ["member"])
    return Manifest(sources, top, payload)


def proofs(manifest: Manifest) -> DataFrame:
    """(doc_id, carried columns, leaf, subroot, root, path) of every leaf.

    path: (left, right) of each level, leaf to root, the hex digests of the siblings
    before and after the node in its run, joined; both empty for a run of one.
    """
    root = manifest.top.roots.select("tree", F.col("digest").alias("root"))
    above = root.withColumn("path", F.array().cast(PATH))
    over = _paths(manifest.top, above, ["root"]).select(
        F.col("node.member").alias("tree"), F.col("node.digest").alias("subroot"), "root", "path"
    )
    rows = _paths(manifest.sources, over, ["subroot", "root"])
    return rows.select(*[F.col(f"node.{c}").alias(c) for c in manifest.payload], F.col("node.digest").alias("leaf"), "subroot", "root", "path")


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))
