"""Versioned parquet datasets published by a pointer written last.

Replaces TRUNCATE + INSERT inside one transaction. A job first claims a version
number by creating ``<pointer root>/_claims/v=<n>`` exclusively: of two jobs that
want one number only one gets it and the other takes the next, so no two ever
write one folder. It then writes a complete new version ``<root>/v=<n>``, and only
after that the pointer row ``(version, published_at, ...)`` in
``<pointer root>/_published``. Readers resolve the greatest published version, so
they never see a half-written or mixed one; a crashed job leaves a claimed number
without a pointer, which nobody reads or writes again.

The pointer row also carries the number and bytes of the version's files, so that
a reader can tell a damaged version before it plans on it.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse.functions import ntz_lit
from gridpulse.plans.serving import RollupUnavailable

_POINTER_SCHEMA = T.StructType(
    [
        T.StructField("version", T.LongType(), False),
        T.StructField("published_at", T.TimestampNTZType(), True),
        T.StructField("watermark", T.LongType(), True),
        T.StructField("files", T.MapType(T.StringType(), T.LongType()), True),
    ]
)


def create_exclusively(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if it is there already.

    Of several callers exactly one gets True where the file system creates
    exclusively: HDFS and stores with conditional writes do, and on a local disk
    the operating system does.
    """
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    if fs.getUri().getScheme() == "file":
        return jvm.java.io.File(fs.makeQualified(target).toUri().getPath()).createNewFile()
    try:
        fs.create(target, False).close()
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def files_of(spark: SparkSession, path: str) -> tuple[int, int]:
    """Number and bytes of the data files below a folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(folder, True)
    number = size = 0
    while found.hasNext():
        status = found.next()
        if not status.getPath().getName().startswith(("_", ".")):
            number, size = number + 1, size + status.getLen()
    return number, size


def claim_sequence(spark: SparkSession, folder: str, least: int) -> int:
    """A number that no other caller gets, at least ``least`` and above all claimed in this folder before.

    The folder keeps the greatest claim alone, so its listing stays short.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    held = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    claims = {int(p.getName()): p for p in held if p.getName().isdigit()}
    number = max(least, max(claims, default=0) + 1)
    while not create_exclusively(spark, f"{folder}/{number:020d}"):
        number += 1
    for p in claims.values():
        fs.delete(p, False)
    return number


class VersionedStore:
    """One dataset. Stores that share a ``pointer_root`` are published together by
    ``publish_together``: one pointer row names the same version of all of them.

    ``count_files``: the files are listed at publication and at each read, for
    readers that have another answer; without it a version of very many files is
    listed by Spark alone. ``rows_per_file``: no file holds more rows."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schema: T.StructType | None = None,
        pointer_root: str | None = None,
        count_files: bool = True,
        rows_per_file: int | None = None,
    ):
        self.spark = spark
        self.count_files = count_files
        self.rows_per_file = rows_per_file
        self.root = root.rstrip("/")
        self.schema = schema
        self.pointer_root = (pointer_root or root).rstrip("/")

    # -- pointers -----------------------------------------------------------
    def _pointers(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(_POINTER_SCHEMA).parquet(f"{self.pointer_root}/_published")
        except AnalysisException:
            return None

    def _published(self, version: int | None = None) -> Row | None:
        """The pointer row of a version, by default the newest."""
        ptr = self._pointers()
        if ptr is None:
            return None
        if version is not None:
            ptr = ptr.where(F.col("version") == version)
        row = ptr.agg(F.max_by(F.struct("version", "watermark", "files"), "version").alias("p")).first()
        return None if row is None else row["p"]

    def latest(self) -> tuple[int, int | None] | None:
        """(version, watermark) of the newest published version, or None."""
        row = self._published()
        return None if row is None else (int(row["version"]), row["watermark"])

    def versions(self) -> list[int]:
        """All published versions, newest first: one number for each publication."""
        ptr = self._pointers()
        return [] if ptr is None else sorted((r[0] for r in ptr.select("version").distinct().collect()), reverse=True)

    def claim_version(self) -> int:
        """A version number that is this caller's alone, above every published one."""
        current = self.latest()
        version = 1 if current is None else current[0] + 1
        while not create_exclusively(self.spark, f"{self.pointer_root}/_claims/v={version}"):
            version += 1
        return version

    def version_path(self, version: int) -> str:
        return f"{self.root}/v={version}"

    # -- write / read -------------------------------------------------------
    def write_version(self, df: DataFrame, version: int, partition_by: str | None = None, range_by: list[str] | None = None) -> None:
        """Write a version without publishing it.

        ``range_by`` deals the rows out by ranges of these columns and sorts them
        so inside each file; a partition column comes first there, because the
        partitioned writer keeps only a sort that begins with it.
        """
        out = df
        if range_by:
            columns = [*([partition_by] if partition_by and partition_by not in range_by else []), *range_by]
            out = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
        writer = out.write.mode("overwrite")
        if self.rows_per_file:
            writer = writer.option("maxRecordsPerFile", self.rows_per_file)
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(self.version_path(version))

    def point(
        self, version: int, published_at: _dt.datetime | None = None, watermark: int | None = None, together: list[VersionedStore] | None = None
    ) -> None:
        """Make a written version of this store, and of those published together with it, the newest."""
        stored = [s for s in together or [self] if s.count_files]
        files = {f"{s.name}/{what}": n for s in stored for what, n in zip(("files", "bytes"), files_of(self.spark, s.version_path(version)), strict=True)}
        counts = F.create_map(*[F.lit(x) for pair in files.items() for x in pair]) if files else F.lit(None)
        values = (F.lit(version), F.lit(None) if published_at is None else ntz_lit(published_at), F.lit(watermark), counts)
        # one row of literals: no Python worker for it
        pointer = self.spark.range(1, numPartitions=1).select(*[v.cast(f.dataType).alias(f.name) for v, f in zip(values, _POINTER_SCHEMA, strict=True)])
        pointer.write.mode("append").parquet(f"{self.pointer_root}/_published")

    @property
    def name(self) -> str:
        """The store among those of one pointer."""
        return self.root.removeprefix(self.pointer_root).strip("/")

    def _check_files(self, version: int, said: dict[str, int] | None) -> None:
        """Raises RollupUnavailable if the version's files aren't those that were published: one listing, no job."""
        if not said or f"{self.name}/files" not in said:
            return  # published without a count
        try:
            number, size = files_of(self.spark, self.version_path(version))
        except Py4JJavaError as error:
            raise RollupUnavailable(f"version {version} under {self.root} can't be listed") from error
        if (number, size) != (said[f"{self.name}/files"], said[f"{self.name}/bytes"]):
            raise RollupUnavailable(f"version {version} under {self.root} has other files than were published")

    def publish(
        self,
        df: DataFrame,
        partition_by: str | None = None,
        range_by: list[str] | None = None,
        published_at: _dt.datetime | None = None,
        watermark: int | None = None,
    ) -> int:
        """Write a full new version, then publish it. Returns the version."""
        version = self.claim_version()
        self.write_version(df, version, partition_by, range_by)
        self.point(version, published_at, watermark)
        return version

    def read(self, version: int | None = None) -> DataFrame:
        """Newest published version (or a given one).

        Raises RollupUnavailable when there is none, when its files aren't those
        that were published, lack a column of the schema or hold it in another type.
        """
        row = self._published(version)
        if version is None:
            if row is None:
                raise RollupUnavailable(f"no published version under {self.root}")
            version = int(row["version"])
        path = self.version_path(version)
        if self.count_files:
            self._check_files(version, None if row is None else row["files"])
        try:
            if self.schema is None:
                return self.spark.read.parquet(path)
            stored = {f.name: f.dataType for f in self.spark.read.parquet(path).schema.fields}
        except AnalysisException as exc:
            raise RollupUnavailable(str(exc)) from exc
        wrong = [f.name for f in self.schema.fields if type(stored.get(f.name)) is not type(f.dataType)]
        if wrong:
            raise RollupUnavailable(f"version {version} under {self.root} does not hold {', '.join(wrong)} as expected")
        return self.spark.read.schema(self.schema).parquet(path)

    def resolver(self):
        """A callable for routing: returns the newest frame or raises."""
        return lambda: self.read()


class BucketedStore(VersionedStore):
    """Versions laid out in buckets of a key: a join or aggregate by the key doesn't shuffle them.

    Each version is an external table in Spark's catalog; a session that doesn't
    know it yet registers it from the files.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str, buckets: int):
        super().__init__(spark, root, schema, count_files=False)
        self.key, self.buckets = key, buckets

    def _table(self, version: int) -> str:
        return f"gridpulse_{hashlib.sha256(self.version_path(version).encode()).hexdigest()[:24]}"

    def write_version(self, df: DataFrame, version: int, partition_by: str | None = None, range_by: list[str] | None = None) -> None:
        """One file a bucket if ``df`` is dealt out by the key already, sorted by the key."""
        writer = df.write.mode("overwrite").format("parquet").option("path", self.version_path(version))
        writer.bucketBy(self.buckets, self.key).sortBy(self.key).saveAsTable(self._table(version))

    def read(self, version: int | None = None) -> DataFrame:
        if version is None:
            current = self.latest()
            if current is None:
                raise RollupUnavailable(f"no published version under {self.root}")
            version = current[0]
        super().read(version)
        name = self._table(version)
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
            self.spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) "
                f"INTO {self.buckets} BUCKETS LOCATION '{self.version_path(version)}'"
            )
        return self.spark.table(name)


def publish_together(
    outputs: list[tuple[VersionedStore, DataFrame | Callable[[int], DataFrame], str | None, list[str] | None]],
    published_at: _dt.datetime | None = None,
    before_pointer: Callable[[int], None] | None = None,
) -> int:
    """Write one new version of several stores, then ONE pointer row for all.

    outputs: (store, frame, partition column, range columns). A frame may be a
    function of the version, called once the outputs before it are written.
    ``before_pointer`` writes what belongs to the version beside the stores. A
    failure before the pointer leaves the previous version of every store published.
    """
    stores = [store for store, *_ in outputs]
    if len({store.pointer_root for store in stores}) != 1:
        raise ValueError("stores published together share one pointer_root")
    version = stores[0].claim_version()
    for store, frame, partition_by, range_by in outputs:
        store.write_version(frame(version) if callable(frame) else frame, version, partition_by, range_by)
    if before_pointer is not None:
        before_pointer(version)
    stores[0].point(version, published_at, together=stores)
    return version
