"""Shared helpers: reading tables, cutting lineage, packing Arrow text for numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.session import scratch_path

#: text bytes that one numpy pass works on; a single longer text is a pass of its own
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, read back (cuts the lineage), and its path.

    The folder goes when the session ends, or earlier by ``drop``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    fs, p = _hadoop(spark, path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def shared(spark: SparkSession, value):
    """A broadcast of a value whose classes travel with it; call the result in a task."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(held.value)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(column):
    """A-Z to a-z; every other character stays."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sliced(batches, text_column: str = "text", max_bytes: int = CHUNK_BYTES):
    """Arrow record batches cut so that each holds about ``max_bytes`` of text."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pa.compute.binary_length(batch.column(text_column).cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes.astype(np.int64) + 16) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


# ---------------------------------------------------------------------------
# words and hashes of packed texts
# ---------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: `[^\x20\x09-\x0D]+`
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

BASE = np.uint64(0x9E3779B97F4A7C15)


BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0..n modulo 2 ** 64, kept for the next call up to CHUNK_BYTES."""
    held = _POWERS.get(int(base))
    if held is None or len(held) <= n:
        held = np.full(max(n, CHUNK_BYTES) + 1, base, dtype=np.uint64)
        held[0] = 1
        np.cumprod(held, out=held)
        if n <= 2 * CHUNK_BYTES:
            _POWERS[int(base)] = held
    return held[: n + 1]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``values[start:end]`` for each span; equal spans have equal hashes."""
    n = len(values)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(BASE, n)[:n], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * powers(BASE_INVERSE, n)[starts]
    h ^= (ends - starts).astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)
    return mixed(h)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


class Words:
    """Words of several texts: lower-cased bytes, byte spans of words, words of each text."""

    def __init__(self, texts: list[bytes], member: np.ndarray):
        self.buf = _LOWER[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        text_start = np.cumsum(lengths) - lengths
        inside = np.zeros(len(self.buf) + 2, dtype=np.int8)
        inside[1:-1] = member[self.buf]
        step = np.diff(inside)
        self.start = np.flatnonzero(step == 1)
        self.end = np.flatnonzero(step == -1)
        self.first = np.searchsorted(self.start, text_start)
        self.count = np.diff(np.append(self.first, len(self.start)))

    def hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.start, self.end)

    def texts_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def join(self, a: int, b: int) -> bytes:
        """Words a..b-1, joined by spaces."""
        return b" ".join(self.buf[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b], strict=True))
