"""Removal of repeated byte strings with suffix arrays by the difference-cover algorithm.

Every suffix of 200 bytes or more is dealt out by the least hash among the
32-byte strings at its start (its anchor), so suffixes with 200 equal bytes meet
in one bucket. Neighbouring suffixes of one anchor travel together as a segment;
equal segments are one class, counted before the shuffle. Segments whose anchor
hash occurs once in the corpus can't repeat and stay behind. A bucket too large for
one task is cut again by finer anchors, one near each end of the 200 bytes, then by
ones further inside, until every part fits. In each bucket, of whatever round, the
suffixes are sorted by the difference-cover algorithm: sampled triples are sorted
and named, the names are sorted by recursion, the remaining suffixes are merged
in, and neighbours in that order are compared over 200 bytes.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.common import as_bytes, drop, mixed, shared, sliced, span_hashes, written

MIN_BYTES = 200
ANCHOR = 32
#: bits of the filter of repeated anchor hashes: 16 for each, within these bounds (2 to 256 MB); a fuller filter costs
#: time, not results
FILTER_BITS = (1 << 24, 1 << 31)
#: text that one suffix array holds; a bucket of more is cut by finer anchors
BUCKET_BYTES = 1 << 20
#: places that a finer anchor is chosen from, and how much further inside those of the next round lie
FINE_PLACES, FINE_STEP = 9, 40
#: longer texts are cut into pieces that overlap, so that a pass holds bounded arrays
PIECE_BYTES = 4 << 20


# ---------------------------------------------------------------------------
# difference cover
# ---------------------------------------------------------------------------


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of s (int64, 1 and more) in the order of their suffixes, by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    pad = np.concatenate([s, np.zeros(3, dtype=np.int64)])
    k = int(s.max()) + 1
    p1, p2 = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([p1, p2])
    triple = (pad[sample] * k + pad[sample + 1]) * k + pad[sample + 2]
    order = np.argsort(triple, kind="stable")
    ordered = triple[order]
    name = np.empty(len(sample), dtype=np.int64)
    name[order] = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    if int(name.max()) < len(sample):
        order = suffix_array(name)
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    by_rank = sample[order]
    by_rank = by_rank[by_rank < n]
    m = n + 4
    p0 = np.arange(0, n, 3)
    p0 = p0[np.argsort(pad[p0] * m + rank[p0 + 1], kind="stable")]
    y1, y2 = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    before = np.searchsorted(pad[y1] * m + rank[y1 + 1], pad[p0] * m + rank[p0 + 1])
    before += np.searchsorted((pad[y2] * k + pad[y2 + 1]) * m + rank[y2 + 2], (pad[p0] * k + pad[p0 + 1]) * m + rank[p0 + 2])
    at = np.arange(len(p0)) + before
    out = np.empty(n, dtype=np.int64)
    rest = np.ones(n, dtype=bool)
    rest[at] = False
    out[at], out[rest] = p0, by_rank
    return out


def repeated_starts(texts: list[bytes], own: np.ndarray, length: int = MIN_BYTES) -> list[np.ndarray]:
    """For each text, which of its first ``own`` positions start ``length`` bytes that start elsewhere as well."""
    buf = np.frombuffer(b"\0".join(texts) + b"\0" * 8, dtype=np.uint8)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    start = np.cumsum(size + 1) - size - 1
    symbols = buf[: int(size.sum()) + len(texts)].astype(np.int64) + 2
    symbols[start + size] = 1  # ends of texts; also that of the last
    mine = np.zeros(len(symbols), dtype=bool)
    mine[_ranges(start, own)] = True
    sa = suffix_array(symbols)
    sa = sa[mine[sa]]
    words = np.ndarray(len(buf) - 7, dtype="<u8", buffer=buf, strides=(1,))
    a, b = sa[:-1], sa[1:]
    left = np.arange(len(a))
    for k in [*range(0, length - 7, 8), length - 8]:
        left = left[words[a[left] + k] == words[b[left] + k]]
    hit = np.zeros(len(symbols), dtype=bool)
    hit[a[left]] = hit[b[left]] = True
    return [hit[s : s + o] for s, o in zip(start, own, strict=True)]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of True as (first, end)."""
    step = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(step[::2].tolist(), step[1::2].tolist(), strict=True))


# ---------------------------------------------------------------------------
# anchors and segments
# ---------------------------------------------------------------------------


class Segments:
    """Segments of several texts: the text, first position and owned positions of each, and its anchor's hash."""

    def __init__(self, texts: list[bytes], length: int = MIN_BYTES):
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.origin = np.cumsum(size) - size
        n = len(self.buf)
        windows = np.maximum(0, size - length + 1)
        self.text = self.start = self.own = np.empty(0, dtype=np.int64)
        self.hash = np.empty(0, dtype=np.uint64)
        if not windows.any():
            return
        at = np.arange(n - ANCHOR + 1)
        gram = span_hashes(self.buf, at, at + ANCHOR)
        low = np.uint64(max(1, int(n).bit_length()))
        least = ((gram >> low) << low) | at.astype(np.uint64)  # the least hash, the leftmost of equal ones
        width, reach = length - ANCHOR + 1, 1
        while reach < width:
            step = min(reach, width - reach)
            least = np.minimum(least[: len(least) - step], least[step:])
            reach += step
        first = _ranges(self.origin, windows)
        text = np.repeat(np.arange(len(texts)), windows)
        anchor = (least[first] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
        new = np.ones(len(first), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        head = np.flatnonzero(new)
        self.text, self.start = text[head], first[head]
        self.own = np.diff(np.append(head, len(first)))
        self.hash = gram[anchor[head]]
        self.length = length

    def classes(self, pick: np.ndarray) -> np.ndarray:
        """The 128-bit BLAKE2b of the bytes of each picked segment, as two numbers."""
        a, b = self.start[pick], self.start[pick] + self.own[pick] + self.length - 1
        return _digests(self.buf, a, b)


def _digests(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    raw = memoryview(buf)
    found = b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(found, dtype="<i8").reshape(-1, 2)


def _first_of_each(classes: np.ndarray) -> np.ndarray:
    """An index of each distinct class."""
    return np.unique(np.ascontiguousarray(classes).view("V16").ravel(), return_index=True)[1]


def passes(texts: list[bytes], length: int):
    """(segments, row of each text, offset of each text): all texts at once, or the pieces of long ones one by one."""
    short = [i for i, t in enumerate(texts) if len(t) <= PIECE_BYTES]
    yield Segments([texts[i] for i in short], length), np.array(short, dtype=np.int64), np.zeros(len(short), dtype=np.int64)
    for i, t in enumerate(texts):
        for a in range(0, len(t) if len(t) > PIECE_BYTES else 0, PIECE_BYTES):
            yield Segments([t[a : a + PIECE_BYTES + length - 1]], length), np.array([i]), np.array([a])


def keyed(docs: DataFrame) -> DataFrame:
    """(k1, k2, data): the row's key, two hashes of its id and text, and the text's bytes. Repeated rows share a key."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(text, F.col("doc_id"), F.lit(1)).alias("k2"), F.encode(text, "UTF-8").alias("data")
    )


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def anchor_counts(rows: DataFrame, length: int) -> DataFrame:
    """(h, n) of all anchors, summed over each pass of a task."""

    def run(batches):
        for batch in sliced(batches, "data"):
            for s, _, _ in passes(as_bytes(batch.column("data")), length):
                h, n = np.unique(s.hash, return_counts=True)
                yield pa.RecordBatch.from_arrays([_long(h), _long(n)], names=["h", "n"])

    return rows.select("data").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def repeated_filter(counts: DataFrame, bits: int | None = None) -> np.ndarray:
    """A bitmap of the hashes that occur twice or more, 16 bits for each by default; others may fall in by chance."""
    if bits is None:
        least, most = FILTER_BITS
        bits = min(most, max(least, 1 << (16 * counts.where("n > 1").count()).bit_length()))
    words = bits >> 18  # a row has 2 ** 18 bits
    cell = F.pmod(F.col("h"), F.lit(bits))
    cells = counts.where("n > 1").select((cell / (1 << 18)).cast("int").alias("part"), (cell % (1 << 18)).cast("int").alias("bit"))

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            part, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for p in np.unique(part).tolist():
                held.setdefault(p, np.zeros(1 << 18, dtype=bool))[bit[part == p]] = True
        for p, flags in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(flags).tobytes()], pa.binary())], names=["part", "set"])

    sets = cells.repartition(max(1, words // 32), "part").mapInArrow(run, "part int, set binary")
    out = np.zeros((words, 1 << 15), dtype=np.uint8)
    for r in sets.toLocalIterator():
        out[r[0]] |= np.frombuffer(bytes(r[1]), dtype=np.uint8)
    return out.ravel()


def segments(rows: DataFrame, bitmap: np.ndarray, length: int) -> DataFrame:
    """One row for each occurrence of a segment that may repeat: class (c1, c2), key (k1, k2), start.

    The first of a class in a pass of a task also has its anchor hash, its owned
    positions and its bytes.
    """
    held = shared(rows.sparkSession, bitmap)
    bits = len(bitmap) * 8

    def run(batches):
        bitmap = held()
        for batch in sliced(batches, "data"):
            for s, row, offset in passes(as_bytes(batch.column("data")), length):
                cell = (s.hash.view(np.int64) % bits).astype(np.int64)
                pick = np.flatnonzero((bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1)
                if len(pick):
                    yield rows_of(batch, s, row, offset, pick)

    def rows_of(batch, s, row, offset, pick):
        classes = s.classes(pick)
        body: list[bytes | None] = [None] * len(pick)
        for j in _first_of_each(classes).tolist():
            a = int(s.start[pick[j]])
            body[j] = s.buf[a : a + int(s.own[pick[j]]) + length - 1].tobytes()
        text = s.text[pick]
        of = pa.array(row[text])
        return pa.RecordBatch.from_arrays(
            [
                _long(classes[:, 0]), _long(classes[:, 1]), batch.column("k1").take(of), batch.column("k2").take(of),
                pa.array(s.start[pick] - s.origin[text] + offset[text], pa.int64()), _long(s.hash[pick]), pa.array(s.own[pick], pa.int32()),
                pa.array(body, pa.binary()),
            ],
            names=["c1", "c2", "k1", "k2", "start", "h", "own", "body"],
        )

    return rows.mapInArrow(run, "c1 long, c2 long, k1 long, k2 long, start long, h long, own int, body binary")


# ---------------------------------------------------------------------------
# buckets
# ---------------------------------------------------------------------------

RUNS = "array<struct<a:int,b:int>>"


def sorted_buckets(classes: DataFrame, length: int) -> DataFrame:
    """(c1, c2, runs): for each class the runs of its owned positions that start repeated strings.

    classes(c1, c2, h, own, body, n). A class that occurs twice is all repeated, as
    equal digests of 128 bits are equal bytes; those that share a bucket with others are sorted together, whole buckets at a time.
    """
    fields = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def settle(rows):
        alone = {r["h"] for r in rows} - {a["h"] for a, b in zip(rows, rows[1:], strict=False) if a["h"] == b["h"]}
        many = [r for r in rows if r["h"] not in alone]
        flags = repeated_starts([r["body"] for r in many], np.array([r["own"] for r in many]), length) if many else []
        out = [(r, [(0, r["own"])]) for r in rows if r["n"] > 1]
        out += [(r, runs_of(f)) for r, f in zip(many, flags, strict=True) if r["n"] == 1 and f.any()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r["c1"] for r, _ in out], pa.int64()), pa.array([r["c2"] for r, _ in out], pa.int64()),
                pa.array([[{"a": a, "b": b} for a, b in runs] for _, runs in out], fields),
            ],
            names=["c1", "c2", "runs"],
        )

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if size >= BUCKET_BYTES and r["h"] != rows[-1]["h"]:
                    yield settle(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r["body"])
        if rows:
            yield settle(rows)

    return classes.repartition("h").sortWithinPartitions("h").mapInArrow(run, f"c1 long, c2 long, runs {RUNS}")


class FineSegments:
    """The owned positions of class bodies, cut where their finer anchors change.

    ``h`` holds each position's hash of its bucket and of the least 32-byte strings
    among a few places near both ends of its ``length`` bytes, further inside with
    each round; equal strings have equal ones. Where the places would meet, it is
    the hash of all ``length`` bytes, and each position is a segment: then only equal
    strings share a bucket, so the rounds end.
    """

    def __init__(self, bodies: list[bytes], bucket: np.ndarray, length: int, round_: int):
        size = np.fromiter(map(len, bodies), dtype=np.int64, count=len(bodies))
        self.buf = np.frombuffer(b"".join(bodies), dtype=np.uint8)
        self.origin = np.cumsum(size) - size
        self.length = length
        windows = size - length + 1
        at = _ranges(self.origin, windows)
        text = np.repeat(np.arange(len(bodies)), windows)
        width, inside = length - ANCHOR + 1, round_ * FINE_STEP
        places = min(FINE_PLACES, width)
        whole = 2 * (inside + places) > width
        if whole:
            key = span_hashes(self.buf, at, at + length)
        else:
            first = np.arange(len(self.buf) - ANCHOR + 1)
            gram = span_hashes(self.buf, first, first + ANCHOR)
            least = np.lib.stride_tricks.sliding_window_view(gram, places).min(axis=1)
            key = mixed(least[at + inside] * np.uint64(0xFF51AFD7ED558CCD) + least[at + width - places - inside])
        key = mixed(key ^ bucket[text].view(np.uint64))
        new = np.ones(len(at), dtype=bool)
        new[1:] = whole | (key[1:] != key[:-1]) | (text[1:] != text[:-1])
        head = np.flatnonzero(new)
        self.text, self.start, self.hash = text[head], at[head], key[head]
        self.own = np.diff(np.append(head, len(at)))


def _fine_passes(batches, length: int, round_: int):
    """(batch, its fine segments) for batches of classes."""
    for batch in sliced(batches, "body", 1 << 18):
        yield batch, FineSegments(as_bytes(batch.column("body")), batch.column("h").to_numpy(), length, round_)


def fine_counts(classes: DataFrame, length: int, round_: int) -> DataFrame:
    """(h, n): how often each finer anchor occurs, copies of a class counted."""

    def run(batches):
        for batch, s in _fine_passes(batches, length, round_):
            h, at = np.unique(s.hash, return_inverse=True)
            n = np.zeros(len(h), dtype=np.int64)
            np.add.at(n, at, batch.column("n").to_numpy()[s.text])
            yield pa.RecordBatch.from_arrays([_long(h), _long(n)], names=["h", "n"])

    return classes.select("h", "body", "n").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def fine_segments(classes: DataFrame, bitmap: np.ndarray, length: int, round_: int) -> DataFrame:
    """Of each class (p1, p2) the segments that may repeat: class (c1, c2), first owned position, copies, h, own, body."""
    held = shared(classes.sparkSession, bitmap)
    bits = len(bitmap) * 8

    def run(batches):
        bitmap = held()
        for batch, s in _fine_passes(batches, length, round_):
            cell = (s.hash.view(np.int64) % bits).astype(np.int64)
            pick = np.flatnonzero((bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1)
            if not len(pick):
                continue
            a, b = s.start[pick], s.start[pick] + s.own[pick] + length - 1
            digest = _digests(s.buf, a, b)
            body: list[bytes | None] = [None] * len(pick)
            for j in _first_of_each(digest).tolist():
                body[j] = s.buf[a[j] : b[j]].tobytes()
            of = pa.array(s.text[pick])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("c1").take(of), batch.column("c2").take(of), pa.array(a - s.origin[s.text[pick]], pa.int32()),
                    batch.column("n").take(of), _long(digest[:, 0]), _long(digest[:, 1]), _long(s.hash[pick]), pa.array(s.own[pick], pa.int32()),
                    pa.array(body, pa.binary()),
                ],
                names=["p1", "p2", "start", "n", "c1", "c2", "h", "own", "body"],
            )

    return classes.mapInArrow(run, "p1 long, p2 long, start int, n long, c1 long, c2 long, h long, own int, body binary")


def _classes_of(found: DataFrame, copies) -> DataFrame:
    """(c1, c2, h, own, body, n) of the classes of segments."""
    return found.groupBy("c1", "c2").agg(
        F.first("h").alias("h"), F.first("own").alias("own"), F.first("body", ignorenulls=True).alias("body"), copies.alias("n")
    )


def bucket_runs(classes: DataFrame, length: int, bucket_bytes: int, round_: int = 0) -> DataFrame:
    """(c1, c2, runs) of classes(c1, c2, h, own, body, n), a written table, as ``sorted_buckets`` gives them.

    Buckets of more than ``bucket_bytes`` are cut by the finer anchors of the round,
    their parts sorted in the same way, and the runs put together again.
    """
    spark = classes.sparkSession
    large = classes.groupBy("h").agg(F.sum(F.octet_length("body")).alias("size"), F.count(F.lit(1)).alias("n"))
    large, _ = written(large.where((F.col("size") > bucket_bytes) & (F.col("n") > 1)).select("h"), "large-buckets")
    if not large.take(1):
        return sorted_buckets(classes, length)
    small = sorted_buckets(classes.join(large, "h", "left_anti"), length)
    rest, rest_path = written(classes.join(large, "h", "left_semi"), f"large-classes-{round_}")
    counts, counts_path = written(fine_counts(rest, length, round_), f"fine-counts-{round_}")
    bitmap = repeated_filter(counts)
    found, _ = written(fine_segments(rest, bitmap, length, round_), f"fine-segments-{round_}")
    for p in (rest_path, counts_path):
        drop(spark, p)
    parts, _ = written(_classes_of(found, F.sum("n")), f"fine-classes-{round_}")
    runs = bucket_runs(parts, length, bucket_bytes, round_ + 1)
    of = found.select("c1", "c2", "p1", "p2", "start").join(runs, ["c1", "c2"]).select("p1", "p2", "start", F.explode("runs").alias("r"))
    span = F.struct((F.col("start") + F.col("r.a")).alias("a"), (F.col("start") + F.col("r.b")).alias("b"))
    whole = of.groupBy(F.col("p1").alias("c1"), F.col("p2").alias("c2")).agg(F.array_sort(F.collect_set(span)).alias("runs"))
    return small.unionByName(whole)


def repeated_spans(rows: DataFrame, length: int = MIN_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """keyed rows -> (k1, k2, spans): byte spans (a, b) that repeated strings cover, not yet joined."""
    counts, counts_path = written(anchor_counts(rows, length), "anchor-counts")
    bitmap = repeated_filter(counts)
    drop(rows.sparkSession, counts_path)
    found, _ = written(segments(rows, bitmap, length), "segments")
    classes, path = written(_classes_of(found, F.count(F.lit(1))), "segment-classes")
    runs, _ = written(bucket_runs(classes, length, bucket_bytes), "segment-runs")
    drop(rows.sparkSession, path)
    spans = found.select("c1", "c2", "k1", "k2", "start").join(runs, ["c1", "c2"]).select("k1", "k2", "start", F.explode("runs").alias("r"))
    span = F.struct((F.col("start") + F.col("r.a")).alias("a"), (F.col("start") + F.col("r.b") - 1 + length).alias("b"))
    return spans.groupBy("k1", "k2").agg(F.collect_set(span).alias("spans"))


def without_repeats(docs: DataFrame, length: int = MIN_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_bytes, removed, kept) of every row.

    ``removed`` are the maximal byte runs (a, b) covered by strings of ``length``
    bytes that start anywhere else too, in this row or another; ``kept`` is the
    rest of the text's UTF-8 bytes. Strings are judged on the input. Null and
    empty texts, and texts shorter than ``length``, lose nothing; repeated rows
    are each other's repeats. Other columns are not read.
    """
    rows = keyed(docs)
    spans = repeated_spans(rows, length, bucket_bytes)
    type_ = docs.schema["doc_id"].dataType.simpleString()
    both = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    both = both.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.col("text"), F.col("doc_id"), F.lit(1))})
    both = both.join(spans, ["k1", "k2"], "left").select("doc_id", F.encode("text", "UTF-8").alias("data"), "spans")
    fields = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches):
        for batch in sliced(batches, "data"):
            removed, kept = [], []
            for data, spans in zip(as_bytes(batch.column("data")), batch.column("spans").to_pylist(), strict=True):
                joined: list[list[int]] = []
                for s in sorted((s["a"], s["b"]) for s in spans or ()):
                    if joined and s[0] <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], s[1])
                    else:
                        joined.append(list(s))
                removed.append([{"a": a, "b": b} for a, b in joined])
                edges = [0, *(x for j in joined for x in j), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            size = pa.compute.binary_length(batch.column("data")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), size, pa.array(removed, fields), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "removed", "kept"],
            )

    return both.mapInArrow(run, f"doc_id {type_}, n_bytes long, removed array<struct<a:bigint,b:bigint>>, kept binary")
