"""Document fingerprints by locally consistent parsing.

A text is a row of symbols. On each level, runs of one symbol become one; then
each symbol is labelled by deterministic coin tossing against its left
neighbour (where their lowest differing bit is, and its value) until six labels
are left, and a phrase begins at every local maximum. Phrases are named by their
contents and are the symbols of the next level. Whether a phrase begins depends
on a few symbols round it, so equal substrings have equal phrases inside,
wherever they stand. The fingerprint is a sketch of the names of every level, from the
coarsest that has enough phrases and the two below it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.llm.common import BASE, BASE_INVERSE, CHUNK_BYTES, as_bytes, drop, mixed, powers, shared, sliced, text_or_empty, written

#: a level is fine enough with so many phrases; a sketch keeps so many of the least
#: names of the two highest levels, and fewer of the third
PHRASES, SKETCH, BELOW = 32, 32, 8
#: so few names are compared together with those of the level below
FEW = 8
MAX_LEVEL = 16


def _toss(now: np.ndarray, before: np.ndarray) -> np.ndarray:
    """2 x the place of the lowest differing bit, plus that bit of ``now``."""
    x = now ^ before
    low = np.bitwise_count((x & -x) - x.dtype.type(1)).astype(np.uint8)
    return (2 * low + ((now >> low.astype(now.dtype)) & now.dtype.type(1)).astype(np.uint8)).astype(np.uint8)


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))


def _next_level(symbols: np.ndarray, text: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and texts of the phrases of a row of symbols (bytes or names); ``text`` ascends."""
    # runs of one symbol
    head = np.ones(len(symbols), dtype=bool)
    head[1:] = (symbols[1:] != symbols[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(head)
    length = np.diff(np.append(at, len(symbols)))
    symbols, text = symbols[at], text[at]
    first = np.ones(len(symbols), dtype=bool)
    first[1:] = text[1:] != text[:-1]
    # labels; the first symbol of a text is set against itself with the last bit turned.
    # 64 bits give labels below 128, then 14, 8 and 6; bytes below 16, 8 and 6
    label = symbols
    for _ in range(3 if symbols.dtype == np.uint8 else 4):
        before = np.concatenate([label[:1], label[:-1]])
        before[first] = label[first] ^ label.dtype.type(1)
        label = _toss(label, before)
    # phrases begin at local maxima and at the first symbol
    begin = first.copy()
    begin[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~first[2:]
    start = np.flatnonzero(begin)
    end = np.append(start[1:], len(symbols))
    n = len(symbols)
    value = _BYTES[symbols] if symbols.dtype == np.uint8 else mixed(symbols)
    value += (length - 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    value *= powers(BASE, n)[:n]
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(value, out=prefix[1:])
    h = (prefix[end] - prefix[start]) * powers(BASE_INVERSE, n)[start]
    salt = np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return mixed(h + salt + (end - start).astype(np.uint64)), text[start]


def _sketches(names: np.ndarray, text: np.ndarray, wanted: np.ndarray, keep: int) -> list[str]:
    """The ``keep`` least distinct names of each wanted text, eight hex digits each."""
    pick = wanted[text]
    names, text = names[pick], text[pick]
    names = (_BYTES[names] if names.dtype == np.uint8 else names) >> np.uint64(32)
    key = np.sort((text.astype(np.uint64) << np.uint64(32)) | names)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    which = np.flatnonzero(wanted).astype(np.uint64)
    edge = np.searchsorted(key, np.concatenate([which, which + np.uint64(1)]) << np.uint64(32))
    digits = (key & np.uint64(0xFFFFFFFF)).astype(">u4")
    return [digits[a : min(b, a + keep)].tobytes().hex() for a, b in zip(edge[: len(which)], edge[len(which) :], strict=True)]


def fingerprints(texts: list[bytes]) -> list[str]:
    """``level:names|names|names`` from the highest level of PHRASES phrases or more (or 1) downwards.

    An empty text has the fingerprint ``0:``.
    """
    n = len(texts)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=n)
    out = ["0:"] * n
    open_ = size > 0
    levels = [(np.frombuffer(b"".join(texts), dtype=np.uint8), np.repeat(np.arange(n, dtype=np.int32), size))]
    while open_.any():
        level = len(levels) - 1
        names, text = _next_level(*levels[-1], level + 1)
        # a text whose phrases are too few above stays on this level
        ends = open_ & ((np.bincount(text, minlength=n) < PHRASES) | (level == MAX_LEVEL)) & (level > 0)
        if ends.any():
            parts = [_sketches(*of, ends, k) for of, k in zip(levels[: -4 : -1], (SKETCH, SKETCH, BELOW), strict=False)]
            for t, *sketches in zip(np.flatnonzero(ends), *parts, strict=True):
                out[t] = f"{level}:{'|'.join(sketches)}"
            open_ &= ~ends
            stays = open_[text]
            names, text = names[stays], text[stays]
        levels.append((names, text))
    return out


def likeness(a: str, b: str) -> float:
    """Estimated share of common names, 0 to 1, on the highest level that both have.

    With few names there, those of the levels below count as well.
    """
    if a == b:
        return 1.0
    held = []
    for f in (a, b):
        level, _, names = f.partition(":")
        held.append({int(level) - i: ({x[j : j + 8] for j in range(0, len(x), 8)}, (SKETCH, SKETCH, BELOW)[i]) for i, x in enumerate(names.split("|")) if x})
    common = total = 0
    for level in sorted(held[0].keys() & held[1].keys(), reverse=True):
        if total >= FEW:
            break
        (left, most), (right, other) = held[0][level], held[1][level]
        least = sorted(left | right)[: min(most, other)]
        common, total = common + sum(n in left and n in right for n in least), total + len(least)
    return common / total if total else 0.0


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row; null and empty texts are alike. Other columns are not read."""
    def run(batches):
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(fingerprints(as_bytes(batch.column("text"))), pa.string())], names=["doc_id", "fingerprint"]
            )

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


# ---------------------------------------------------------------------------
# each document beside the next one
# ---------------------------------------------------------------------------

#: text that one range holds; with more text than MAX_RANGES such ranges, ranges grow so that their bounds stay broadcast
RANGE_BYTES = 16 << 20
MAX_RANGES = 1 << 20
#: characters by which texts of one id are ordered, before their SHA-256
HEAD = 64
KEY = ["doc_id", "head", "digest"]


def _with_key(rows: DataFrame) -> DataFrame:
    """Adds what orders texts of one id: the text's head and its SHA-256."""
    return rows.withColumns({"head": F.substring("text", 1, HEAD), "digest": F.unhex(F.sha2("text", 256))})


def _first_of_ranges(rows: DataFrame) -> pa.Table:
    """The key of the first row of each range, in order: ranges hold about equal bytes of text."""
    keys, path = written(_with_key(rows).select(*KEY, F.octet_length("text").alias("size")), "parsing-keys")
    total, n = keys.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not n:
        return keys.select(*KEY).limit(0).toArrow()
    width = max(RANGE_BYTES, total // MAX_RANGES, 1)
    spread = keys.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("at", F.monotonically_increasing_id())
    spread, spread_path = written(spread, "parsing-order")
    spread = spread.withColumn("part", F.shiftright("at", 33))
    part = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # one row a partition: where its bytes begin
    sizes = spread.groupBy("part").agg(F.sum("size").alias("size")).orderBy("part").collect()
    begins = np.cumsum([0, *(r["size"] for r in sizes)])[:-1]
    starts = rows.sparkSession.createDataFrame([(r["part"], int(b)) for r, b in zip(sizes, begins, strict=True)], "part long, begin long")
    placed = spread.join(starts, "part").withColumn("before", F.col("begin") + F.coalesce(F.sum("size").over(part), F.lit(0)))
    firsts = placed.groupBy(F.expr(f"before div {width}").alias("range")).agg(F.min(F.struct(*KEY)).alias("k"))
    cuts = firsts.select("k.*").distinct().orderBy(F.col("doc_id").asc_nulls_first(), "head", "digest").toArrow()
    for p in (path, spread_path):
        drop(rows.sparkSession, p)
    return cuts


def in_order(docs: DataFrame, use, schema: str) -> DataFrame:
    """``use(rows)`` over all rows in ascending order of doc_id (long), in ranges.

    ``use`` gets, for each run of neighbouring rows, [(doc_id, text), ...] whose
    last row belongs to the next run; the row after the last is the first again.
    Null ids come first; equal ids are ordered by the first 64 characters of their
    texts and then by their SHA-256. Ranges hold about equal bytes: their bounds
    come from the sizes of all rows, so that many rows of one id, or without an id,
    are split as well; only rows equal in id and text stay together, and stream.
    Texts are dealt once; the first row of a range goes to the range before it as
    well. Tasks hold about CHUNK_BYTES of text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    cuts = _first_of_ranges(rows)
    if not len(cuts):
        return rows.limit(0).mapInArrow(lambda batches: iter(()), schema)
    keys = list(zip(*(cuts.column(c).to_pylist() for c in KEY), strict=True))
    edges = [(i, head.encode(), bytes(digest)) for i, head, digest in keys[1:]]
    n_null = sum(i is None for i, *_ in edges)
    held = shared(spark, (n_null, np.array([i for i, *_ in edges[n_null:]], dtype=np.int64), [e[1:] for e in edges]))

    def deal(batches):
        n_null, ids, rest = held()
        for batch in batches:
            of = batch.column("doc_id")
            known = of.is_valid().to_numpy(zero_copy_only=False)
            value = of.fill_null(0).to_numpy()
            low = np.where(known, n_null + np.searchsorted(ids, value, side="left"), 0)
            high = np.where(known, n_null + np.searchsorted(ids, value, side="right"), n_null)
            part = high.copy()
            heads, digests = batch.column("head"), batch.column("digest")
            for i in np.flatnonzero(high > low).tolist():  # ids at which a range begins: the texts decide
                part[i] = bisect_right(rest, (heads[i].as_py().encode(), digests[i].as_py()), int(low[i]), int(high[i]))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *batch.columns], names=["part", *batch.schema.names])

    def run(batches):
        pending, size, part = [], 0, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "guard", "doc_id", "text")]
            for p, guard, i, text in zip(*columns, strict=True):
                if p != part:
                    pending, size, part = [], 0, p
                pending.append((i, text))
                size += len(text)
                if guard or size >= CHUNK_BYTES:
                    if len(pending) > 1:
                        yield from use(pending)
                    pending, size = pending[-1:], 0

    dealt = _with_key(rows).mapInArrow(deal, "part int, doc_id long, text string, head string, digest binary")
    # each range's first row, once more for the range before it
    first = spark.createDataFrame([(i, (k - 1) % len(keys), h, bytes(d)) for k, (i, h, d) in enumerate(keys)], "f_id long, part int, f_head string, f_digest binary")
    near = rows.join(F.broadcast(first.select("f_id").distinct()), F.col("doc_id").eqNullSafe(F.col("f_id")), "left_semi")
    same = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("head") == F.col("f_head")) & (F.col("digest") == F.col("f_digest"))
    guards = _with_key(near).join(F.broadcast(first), same).groupBy("part", *KEY).agg(F.first("text").alias("text"))
    names = ["part", "guard", "doc_id", "text", "head", "digest"]
    both = dealt.withColumn("guard", F.lit(False)).select(names).unionByName(guards.withColumn("guard", F.lit(True)).select(names))
    laid = both.repartition("part").sortWithinPartitions("part", "guard", F.col("doc_id").asc_nulls_first(), "head", "digest")
    return laid.select("part", "guard", "doc_id", "text").mapInArrow(run, schema)


def beside_next(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has its last floor(n_chars / 2) characters replaced by the
    first as many (or all) of the next document; a single document is its own next.
    """
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )

    def use(rows):
        texts = [t for _, t in rows]
        edited = []
        for text, after in zip(texts, texts[1:], strict=False):
            half = len(text) // 2
            edited.append((text[: len(text) - half] + after[:half]).encode())
        own = fingerprints([t.encode() for t in texts])
        new = fingerprints(edited)
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([i for i, _ in rows[:-1]], pa.int64()),
                "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
                "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
                "fingerprint": own[:-1],
                "edited_fingerprint": new,
                "near_edited": [likeness(a, b) for a, b in zip(own, new, strict=False)],
                "near_next": [likeness(a, b) for a, b in zip(own, own[1:], strict=False)],
            }
        )

    return in_order(docs, use, schema)
