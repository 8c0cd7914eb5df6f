"""Trees and proofs against plain Python."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from docs_of import docs, edge_rows
from gridpulse.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def tree(nodes):
    """Root, and for each node its siblings level by level as (before, after)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            a = at[i] // 3 * 3
            path.append(("".join(nodes[a : at[i]]), "".join(nodes[at[i] + 1 : a + 3])))
            at[i] //= 3
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute(rows, changed):
    """(doc_id, leaf, subroot, root, proof, folded root) of every row; changed(row) is its text after tampering."""
    of = {}
    for r in rows:
        of.setdefault((r["source"] is not None, (r["source"] or "").encode()), []).append(r)
    trees = []
    for _, members in sorted(of.items()):
        members.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees.append((members, *tree([leaf(r, r["text"]) for r in members])))
    root, tops = tree([t[1] for t in trees])
    out = []
    for (members, subroot, paths), top in zip(trees, tops, strict=True):
        for r, path in zip(members, paths, strict=True):
            node = leaf(r, changed(r))
            for before, after in path + top:
                node = h(before, node, after)
            out.append((r["doc_id"], leaf(r, r["text"]), subroot, root, h(*(x for s in path + top for x in s)), node))
    return out


def cut(r):
    even = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
    return r["text"].replace("\n", "") if even and r["text"] is not None else r["text"]


def results(frame, stride):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    digest = merkle.leaf_digest(text=F.replace("text", F.lit("\n"), F.lit("")))
    proven = merkle.proofs(merkle.build(frame, stride, tampered=F.when(even, digest)))
    folded = merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    got = proven.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), folded).collect()
    return sorted(map(tuple, got), key=str)


@pytest.mark.parametrize("stride", [1, 2, 3])
def test_trees_and_proofs_equal_brute_force(spark, stride):
    rng = random.Random(stride)
    rows = [(i, f"line {i}\nline", rng.choice(["a", "a", "a", None, "", "é", "B"])) for i in range(120)]
    rows += [(1000 + i, "x", "z") for i in range(28)] + [(2000, "alone\n", "one"), (2001, "a", "two"), (2002, "b", "two")]
    frame = docs(spark, rows)
    assert results(frame, stride) == sorted(brute(frame.collect(), cut), key=str)


def test_edge_rows_and_repeats(spark):
    rows = [*edge_rows("very long\n" * 50_000), (8, "same id", "b"), (8, "same id, other text", "b"), (None, "no id", "b")]
    rows += [(9, "the same row\n", "hot")] * 200
    frame = docs(spark, rows)
    assert results(frame, 2) == sorted(brute(frame.collect(), cut), key=str)


def test_one_row_and_none(spark):
    frame = docs(spark, [(3, "only\n")])
    got = results(frame, 3)
    assert got == brute(frame.collect(), cut) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == h("")
    assert results(docs(spark, []), 3) == []


def test_only_every_third_level_is_stored(spark):
    manifest = merkle.build(docs(spark, [(i, "t") for i in range(100)]), 3)
    stored = manifest.sources.levels
    # 100 leaves in blocks of 27, then their 4 tops: the levels of 34 and 12 nodes between aren't kept
    assert [b.selectExpr("sum(size(nodes))").first()[0] for b in stored] == [100, 4]
    assert stored[0].selectExpr("max(size(nodes))").first()[0] == 27
    assert manifest.sources.roots.count() == 1


def test_a_hot_source_lies_in_many_tasks(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        rows = spark.range(10_000).selectExpr("'1a' AS tree", "id AS doc_id", "string(id) AS digest")
        placed = merkle._numbered(rows, ["doc_id", "digest"])
        assert placed.where("pos <> doc_id OR n <> 10000").count() == 0
        same = merkle._numbered(spark.range(10_000).selectExpr("'1a' AS tree", "7 AS doc_id", "'x' AS digest"), ["doc_id", "digest"])
        assert same.select("pos").distinct().count() == 10_000
        assert len(placed.inputFiles()) > 2 and len(same.inputFiles()) > 2
    finally:
        spark.conf.unset(key)
