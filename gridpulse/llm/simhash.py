"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within distance r have a point between them within r / 2 of
both. Every fingerprint emits all variants of itself within half the radius;
fingerprints that share a variant are candidates and are verified by their
distance. The default radius of 3 is odd: 22 of the bits are masked in turn, so
that the odd differing bit falls under a mask at least once and the other two
meet at variants of one flip. That is 3 x 43 = 129 variants a
fingerprint instead of the 2,081 of a ball of radius 2, and no link is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.common import NOT_BLANK, Words, as_bytes, sliced, written
from gridpulse.llm.components import connected_components

# XXH64 constants (fixed values)
P1, P2, P3, P4, P5 = (
    np.uint64(x)
    for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)
SEED = 42


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of ``buf[start:end]`` for every span; spans of 32 bytes and more one by one."""
    size = end - start
    pad = np.concatenate([buf, np.zeros(8, dtype=np.uint8)])
    u64 = np.ndarray(len(buf) + 1, dtype="<u8", buffer=pad, strides=(1,))
    u32 = np.ndarray(len(buf) + 1, dtype="<u4", buffer=pad, strides=(1,))
    h = np.uint64(seed) + P5 + size.astype(np.uint64)
    for k in range(3):
        i = np.flatnonzero(size >= 8 * k + 8)
        lane = _rotl(u64[start[i] + 8 * k] * P2, 31) * P1
        h[i] = _rotl(h[i] ^ lane, 27) * P1 + P4
    at = size & ~7
    i = np.flatnonzero(size & 4)
    h[i] = _rotl(h[i] ^ (u32[start[i] + at[i]].astype(np.uint64) * P1), 23) * P2 + P3
    at = size & ~3
    for k in range(3):
        i = np.flatnonzero((size & 3) > k)
        h[i] = _rotl(h[i] ^ (buf[start[i] + at[i] + k].astype(np.uint64) * P5), 11) * P1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    h ^= h >> np.uint64(32)
    raw = buf.tobytes()
    for j in np.flatnonzero(size >= 32):
        h[j] = xxhash.xxh64_intdigest(raw[start[j] : end[j]], seed)
    return h


# a byte's eight bits, one in each byte of a word: up to 255 of them add up without carry
_LANES = np.zeros(256, dtype=np.uint64)
for _bit in range(8):
    _LANES |= ((np.arange(256, dtype=np.uint64) >> np.uint64(_bit)) & np.uint64(1)) << np.uint64(8 * _bit)


def fingerprints(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """A 64-bit fingerprint of each text (zero where there are no words)."""
    out = np.zeros(len(texts), dtype=np.uint64)
    w = Words(texts, NOT_BLANK)
    n_words = len(w.start)
    if not n_words:
        return out
    size = w.end - w.start
    order = np.arange(n_words)
    first = np.cumsum(size) - size + order  # in the buffer of words that one space parts
    joined = np.full(int(size.sum()) + n_words, 0x20, dtype=np.uint8)
    joined[np.arange(int(size.sum())) + np.repeat(order, size)] = w.buf[NOT_BLANK[w.buf]]
    last = first + size
    n = np.maximum(np.where(w.count > 0, 1, 0), w.count - shingle + 1)  # shingles of each text
    doc = np.repeat(np.arange(len(texts)), n)
    begin = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + w.first[doc]
    stop = np.minimum(begin + shingle, w.first[doc] + w.count[doc]) - 1
    h = xxh64_spans(joined, first[begin], last[stop])
    blocks = -(-n // 255)
    at = np.repeat(np.cumsum(n) - n, blocks) + 255 * (
        np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    )
    lanes = _LANES[h.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, at, axis=0).view(np.uint8).reshape(-1, 64).astype(np.int64)
    full = np.flatnonzero(n)
    counts = np.add.reduceat(sums, (np.cumsum(blocks) - blocks)[full], axis=0)
    bits = (2 * counts > n[full, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def with_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long) of every row."""
    schema = f"doc_id {docs.schema[id_column].dataType.simpleString()}, fp long"

    def run(batches):
        for batch in sliced(batches):
            fp = fingerprints(as_bytes(batch.column("text")), shingle)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, schema)


# ---------------------------------------------------------------------------
# ball hashing
# ---------------------------------------------------------------------------


def ball(bits: int, radius: int, low: int) -> list[int]:
    """All flips of at most ``radius`` of the bits low..bits-1."""
    out = [0]
    for _ in range(radius):
        out = list(dict.fromkeys(x ^ f for x in out for f in (0, *(1 << b for b in range(low, bits)))))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants(nodes: DataFrame, distance: int) -> DataFrame:
    """(key, fp): each fingerprint at every variant within half the distance.

    Odd distances: the fingerprint is turned so that the bits from 0, 21 and 42 on
    lie lowest in turn; 22 are masked, so that every bit is under a mask at least
    once, and hold the number of the turn.
    """
    half = distance // 2
    low = 22 if distance % 2 else 0
    flips = F.array(*[F.lit(_signed(x)) for x in ball(64, half, low)])
    if not low:
        return nodes.select("fp", F.explode(flips).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("key"), "fp")
    fp = F.col("fp")
    turned = [fp] + [F.shiftrightunsigned(fp, s).bitwiseOR(F.shiftleft(fp, 64 - s)) for s in (21, 42)]
    tops = [t.bitwiseAND(F.lit(-1 << low)).bitwiseOR(F.lit(i)) for i, t in enumerate(turned)]
    return nodes.select("fp", F.explode(F.array(*tops)).alias("top")).select(
        "fp", F.col("top"), F.explode(flips).alias("flip")
    ).select(F.col("top").bitwiseXOR(F.col("flip")).alias("key"), "fp")


def _spanning(fps: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is linked among the fingerprints of one variant (no more than one a member).

    Breadth first from the smallest one left: each step compares the frontier
    with those not reached yet, so one large group takes a few vector passes.
    """
    left, out = np.sort(fps), []
    while len(left) > 1:
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            nxt = []
            for f in frontier:
                near = np.bitwise_count(left ^ f) <= distance
                if near.any():
                    got = left[near]
                    out.append((np.full(len(got), f), got))
                    nxt.append(got)
                    left = left[~near]
                    if not len(left):
                        break
            frontier = np.concatenate(nxt) if nxt else left[:0]
    return out


def _links_of_sorted(keys: np.ndarray, fps: np.ndarray, distance: int):
    """Links of whole runs of equal keys."""
    cut = np.flatnonzero(np.diff(keys)) + 1
    start = np.concatenate([[0], cut])
    size = np.diff(np.append(start, len(keys)))
    two = start[size == 2]
    a, b = fps[two], fps[two + 1]
    near = np.bitwise_count(a ^ b) <= distance
    pairs = [(np.minimum(a[near], b[near]), np.maximum(a[near], b[near]))]
    for s, n in zip(start[size > 2], size[size > 2], strict=True):
        pairs += _spanning(fps[s : s + n], distance)
    x = np.concatenate([p[0] for p in pairs])
    y = np.concatenate([p[1] for p in pairs])
    return np.unique(np.stack([x, y], axis=1), axis=0) if len(x) else np.empty((0, 2), dtype=np.uint64)


def ball_links(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``distance``; nodes(fp) are distinct."""

    def run(batches):
        keys, fps = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)

        def answer(k, f):
            got = _links_of_sorted(k, f, distance).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            if not len(keys):
                continue
            whole = np.searchsorted(keys, keys[-1])  # the last run may go on in the next batch
            if whole:
                yield answer(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield answer(keys, fps)

    met = variants(nodes, distance).repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, distance: int = 3
) -> DataFrame:
    """(doc_id, fp long, component_id) of every row.

    component_id is the smallest id reachable by links of ``distance`` or fewer
    differing bits; equal fingerprints are linked. Null and empty texts have the
    fingerprint zero and are linked like any other. Rows with equal ids keep a row
    each; null ids get the smallest id that isn't null, if there is one. Other
    columns are not read. An empty table gives an empty table.
    """
    fps, _ = written(with_fingerprints(docs, id_column, text_column, shingle), "fingerprints")
    nodes, _ = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = connected_components(ball_links(nodes.select("fp"), distance)).withColumnsRenamed({"node": "fp"})
    named = nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(best, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def one_of_each(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, distance: int = 3
) -> DataFrame:
    """The rows of docs, all columns, one of each group of ``near_duplicates``.

    Rows are told apart by id and text, so that texts of one id may be in several
    groups. The row of the smallest id stays, rows without an id come after all
    ids; of equal ids a text before a null one, then the smaller SHA-256 of the
    text. Of rows with equal id and text one stays. An empty table stays empty.
    """
    row_id, text = F.col(id_column), F.col(text_column).cast("string")
    key = F.struct(
        row_id.isNull().alias("nameless"),
        row_id.alias("id"),
        text.isNull().alias("missing"),
        F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("digest"),
    )
    keyed = docs.withColumn("_near_key", key)
    found = near_duplicates(keyed, "_near_key", text_column, shingle, distance)
    keep = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_near_key")).distinct()
    return keyed.join(keep, "_near_key", "left_semi").dropDuplicates(["_near_key"]).select(docs.columns)
