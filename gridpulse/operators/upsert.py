"""Keyed latest-wins upsert without MERGE.

The reference upserts on ``unique_key``: insert, else overwrite every
column (a newer NULL overwrites an older value) with no timestamp
comparison, so the last write wins. Several writers (the stream consumer, the
scheduled sync) upsert one table. Here the table is

* an append-only change log, one folder per writer and batch
  (``log/writer=<w>/batch_id=<n>``), visible once its commit record
  ``_commits/writer=<w>/batch_id=<n>`` is written; a batch that is committed is
  never written again, so a retry changes nothing that readers see, plus
* an optional compacted base (a published version of the current view, laid
  out by date), which stores the exact set of (writer, batch) folded into it.

Readers take exactly the committed pairs that the base has not folded. Changes
are ordered by the sequence that their commit got, then by offset: within a
partition a later offset wins whatever its message time, as the reference
keeps the order of arrival there.

Latest-wins is ``max(struct(ordering, all columns))`` per key: a
partial aggregate, so a key holding a third of all changes still ships one
row per map task into the shuffle. Without a base it runs over the log;
with one, ``merge_latest`` resolves only the keys of the log tail and lets
the other base rows pass a map-side anti join. The cost of ingesting a
micro-batch follows the batch, not the table.
"""

from __future__ import annotations

import datetime as _dt
import time

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse import schema as S
from gridpulse.functions import ntz_lit
from gridpulse.sources.store import BucketedStore, VersionedStore, claim_sequence, files_of

# Total order of changes: later commit, then offset; the rest makes it total.
ORDER_COLUMNS = ("commit_seq", "writer", "batch_id", "msg_offset", "partition_id", "msg_ts")


def latest_by_key(
    changes: DataFrame,
    key: str = "unique_key",
    order_cols: tuple[str, ...] = ORDER_COLUMNS,
    value_cols: tuple[str, ...] | None = None,
) -> DataFrame:
    """One row per key: the values of the greatest tuple of those ``order_cols`` that there are.

    Order and values travel in one struct whose greatest is kept, so a row's
    columns stay together, a NULL in the newest change wins, and changes that agree
    in every order column are told apart by their values, whatever the partitions.
    """
    if value_cols is None:
        value_cols = tuple(c for c in changes.columns if c != key)
    return (
        changes.groupBy(key)
        .agg(F.max(change_struct(changes, order_cols, value_cols)).alias("_latest"))
        .select(key, *[F.col(f"_latest.{c}").alias(c) for c in value_cols])
    )


def change_struct(changes: DataFrame, order_cols: tuple[str, ...], value_cols: tuple[str, ...]) -> Column:
    """A change as one comparable value: those ``order_cols`` that there are, then the values."""
    order = [c for c in order_cols if c in changes.columns]
    return F.struct(*order, *[c for c in value_cols if c not in order])


# Files of the log and of a base by date hold at most so many rows. Spark packs files into tasks by their compressed
# bytes, at least 4 MB a file, so that a task of 128 MB reads at most 32 of them, however well the rows compress.
ROWS_PER_FILE = 50_000

# A tail's distinct keys are broadcast only below this many bytes (measured).
BROADCAST_KEY_BYTES = 256 << 20


def merge_latest(
    base: DataFrame,
    tail: DataFrame,
    key: str = "unique_key",
    order_cols: tuple[str, ...] = ORDER_COLUMNS,
    broadcast_key_bytes: int = BROADCAST_KEY_BYTES,
) -> DataFrame:
    """Current view of a compacted ``base`` (one row per key) plus newer changes.

    Only keys present in ``tail`` can change. Their distinct set is measured
    first (count and total key bytes, one small job); if it fits under
    ``broadcast_key_bytes`` it is broadcast, base rows of untouched keys pass
    through a map-side anti join (no shuffle of the base), and only the tail
    plus the touched base rows are shuffled into the ``max``. Otherwise the
    whole union is merged by key, which shuffles the base too.
    """
    value_cols = tuple(c for c in base.columns if c != key)
    keys = tail.select(key).distinct()
    n_keys, key_bytes = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(key)), F.lit(0))).first()
    if n_keys == 0:
        return base
    # per-key overhead of a broadcast hash relation, on top of the key bytes
    if key_bytes + 64 * n_keys > broadcast_key_bytes:
        return latest_by_key(base.unionByName(tail), key, order_cols, value_cols).select(*base.columns)
    touched = F.broadcast(keys)
    unchanged = base.join(touched, key, "left_anti")
    changed = latest_by_key(base.join(touched, key, "left_semi").unionByName(tail), key, order_cols, value_cols)
    return unchanged.unionByName(changed.select(*base.columns))


def merge_bucketed(
    base: DataFrame, tail: DataFrame, key: str = "unique_key", order_cols: tuple[str, ...] = ORDER_COLUMNS
) -> DataFrame:
    """``merge_latest`` for a base in buckets of the key: only the tail is shuffled, to the base's buckets.

    Base and tail meet in a full join by key, where the greater change stays.
    """
    value_cols = tuple(c for c in base.columns if c != key)
    newest = tail.groupBy(key).agg(F.max(change_struct(tail, order_cols, value_cols)).alias("_tail"))
    held = base.select(key, change_struct(base, order_cols, value_cols).alias("_base"))
    met = held.join(newest, key, "full_outer").select(key, F.greatest("_base", "_tail").alias("_latest"))
    return met.select(*[key if c == key else F.col(f"_latest.{c}").alias(c) for c in base.columns])


def date_layout(df: DataFrame, col: str = "created_date", key: str = "unique_key") -> DataFrame:
    """Range-partition and sort by (date, key): files cover disjoint date
    ranges (min/max skipping for date filters and newest-first pages), and the
    key tie-break splits a date holding a third of all rows over many files."""
    return df.repartitionByRange(F.col(col), F.col(key)).sortWithinPartitions(col, key)


LOG_SCHEMA = T.StructType(
    [
        T.StructField("msg_offset", T.LongType(), True),
        T.StructField("partition_id", T.IntegerType(), True),
        T.StructField("msg_ts", T.TimestampNTZType(), True),
        *[f for f in S.COMPLAINT_SCHEMA.fields if f.name in S.RECORD_COLUMNS],
        T.StructField("ingested_at", T.TimestampNTZType(), True),
        T.StructField("writer", T.StringType(), True),
        T.StructField("batch_id", T.LongType(), True),
    ]
)
# Rows of the view and the base also carry the sequence of their commit.
VIEW_SCHEMA = T.StructType([*LOG_SCHEMA.fields, T.StructField("commit_seq", T.LongType(), True)])
_VIEW_COLUMNS = tuple(VIEW_SCHEMA.fieldNames())
_PAIR = ("writer", "batch_id")

# Commit records: a marker row (progress fields NULL) plus, for stream
# batches, one progress row per source partition.
_PROGRESS_SCHEMA = T.StructType(
    [
        T.StructField("consumer_name", T.StringType(), True),
        T.StructField("topic_name", T.StringType(), True),
        T.StructField("partition_id", T.IntegerType(), True),
        T.StructField("last_offset", T.LongType(), True),
        T.StructField("last_created_date", T.TimestampNTZType(), True),
        T.StructField("last_message_at", T.TimestampNTZType(), True),
        T.StructField("updated_at", T.TimestampNTZType(), True),
    ]
)
COMMIT_SCHEMA = T.StructType(
    [
        *_PROGRESS_SCHEMA.fields,
        T.StructField("commit_seq", T.LongType(), True),
        T.StructField("writer", T.StringType(), True),
        T.StructField("batch_id", T.LongType(), True),
    ]
)
_FOLDED_SCHEMA = T.StructType([LOG_SCHEMA["writer"], LOG_SCHEMA["batch_id"]])
DEFAULT_WRITER = "default"


class ChangeLogTable:
    """Change log + compacted base under one root folder.

    The base is laid out by date, for date-bounded reads, or with ``key_buckets``
    in that many buckets of the key, for tables whose batches touch so many keys
    that their set can't be broadcast: base and tail then meet without a shuffle of
    the base. A table keeps the layout it was made with.
    """

    def __init__(self, spark: SparkSession, root: str, key_buckets: int | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.key_buckets = key_buckets
        base = f"{self.root}/base"
        self.base = (
            BucketedStore(spark, base, VIEW_SCHEMA, "unique_key", key_buckets)
            if key_buckets
            else VersionedStore(spark, base, VIEW_SCHEMA, count_files=False, rows_per_file=ROWS_PER_FILE)
        )

    def batch_path(self, batch_id: int, writer: str = DEFAULT_WRITER) -> str:
        return f"{self.root}/log/writer={writer}/batch_id={int(batch_id)}"

    def _commit_path(self, batch_id: int, writer: str) -> str:
        return f"{self.root}/_commits/writer={writer}/batch_id={int(batch_id)}"

    def is_committed(self, batch_id: int, writer: str = DEFAULT_WRITER) -> bool:
        """A batch's commit record has been written; asks the file system, runs no job."""
        try:
            return files_of(self.spark, self._commit_path(batch_id, writer))[0] > 0
        except Py4JJavaError as error:
            if "FileNotFound" in error.java_exception.getClass().getName():
                return False
            raise

    def batch_rows(self, batch_id: int, writer: str = DEFAULT_WRITER) -> int:
        """Rows of a written batch."""
        return self.spark.read.schema(LOG_SCHEMA).parquet(self.batch_path(batch_id, writer)).count()

    def commit_batch(self, batch_id: int, progress: DataFrame | None = None, writer: str = DEFAULT_WRITER) -> None:
        """Make one written batch of a writer visible; call it after all its outputs.

        The commit record carries the source progress the batch reached (one
        row per stream partition, plus one marker row), like a consumer that
        commits rows and offsets together, and the commit's sequence: the wall
        clock in nanoseconds, above every sequence claimed before and no other
        writer's. A batch that is committed already keeps its record.
        """
        if self.is_committed(batch_id, writer):
            return
        seq = claim_sequence(self.spark, f"{self.root}/_sequence", time.time_ns())
        marker = self.spark.range(1, numPartitions=1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in _PROGRESS_SCHEMA])
        rows = marker if progress is None else marker.unionByName(progress.select(*_PROGRESS_SCHEMA.fieldNames()))
        rows = rows.withColumn("commit_seq", F.lit(seq).cast("long"))
        rows.coalesce(1).write.mode("overwrite").parquet(self._commit_path(batch_id, writer))

    def commits(self) -> DataFrame | None:
        """All commit records, or None before the first."""
        try:
            return self.spark.read.schema(COMMIT_SCHEMA).parquet(f"{self.root}/_commits")
        except AnalysisException:
            return None

    def append_batch(
        self,
        changes: DataFrame,
        batch_id: int,
        ingested_at: _dt.datetime | None = None,
        commit: bool = True,
        writer: str = DEFAULT_WRITER,
    ) -> bool:
        """Write one batch of normalised changes of a writer; False if it is committed already.

        Ids count per writer. With ``commit`` the batch becomes visible at once;
        a caller with more outputs per batch commits after writing all of them."""
        if self.is_committed(batch_id, writer):
            return False
        stamp = ntz_lit(ingested_at or _dt.datetime.now(_dt.timezone.utc))
        present = set(changes.columns)
        cols = [
            F.col(c) if c in present else F.lit(None).cast(LOG_SCHEMA[c].dataType).alias(c)
            for c in LOG_SCHEMA.fieldNames()
            if c not in ("ingested_at", *_PAIR)
        ]
        out = changes.select(*cols, stamp.alias("ingested_at"))
        out.write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(self.batch_path(batch_id, writer))
        if commit:
            self.commit_batch(batch_id, writer=writer)
        return True

    def _folded(self, version: int) -> DataFrame:
        return self.spark.read.schema(_FOLDED_SCHEMA).parquet(f"{self.root}/base_folded/v={version}")

    def _pairs(self, version: int | None) -> DataFrame:
        """(writer, batch_id, commit_seq) of the committed batches that base ``version`` has not folded."""
        commits = self.commits()
        if commits is None:
            return self.spark.createDataFrame([], VIEW_SCHEMA).select(*_PAIR, "commit_seq")
        pairs = commits.groupBy(*_PAIR).agg(F.max("commit_seq").alias("commit_seq"))
        return pairs if version is None else pairs.join(self._folded(version), list(_PAIR), "left_anti")

    def _rows_of(self, pairs: DataFrame) -> DataFrame:
        """The log rows of exactly these batches."""
        try:
            log = self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.root}/log")
        except AnalysisException:
            return self.spark.createDataFrame([], VIEW_SCHEMA)
        # the pairs go to the log's scans: dealt out by pair, all rows of a batch would meet in one task
        return log.join(F.broadcast(pairs), list(_PAIR)).select(*_VIEW_COLUMNS)

    def rows_of(self, pairs: DataFrame) -> DataFrame:
        """The log rows of exactly these batches (writer, batch_id, commit_seq)."""
        return self._rows_of(pairs)

    def log(self) -> DataFrame:
        """All committed log rows; a batch folder without its commit record is not read."""
        return self._rows_of(self._pairs(None))

    def changes(self) -> DataFrame:
        """Base rows plus the rows of every committed batch that the base has not folded."""
        current = self.base.latest()
        if current is None:
            return self.log()
        return self.base.read(current[0]).select(*_VIEW_COLUMNS).unionByName(self._rows_of(self._pairs(current[0])))

    def _view(self, version: int | None, pairs: DataFrame, broadcast_key_bytes: int) -> DataFrame:
        if version is None:
            return latest_by_key(self._rows_of(pairs), value_cols=tuple(c for c in _VIEW_COLUMNS if c != "unique_key")).select(*_VIEW_COLUMNS)
        base = self.base.read(version).select(*_VIEW_COLUMNS)
        if not pairs.take(1):
            return base
        if self.key_buckets:
            return merge_bucketed(base, self._rows_of(pairs))
        return merge_latest(base, self._rows_of(pairs), broadcast_key_bytes=broadcast_key_bytes)

    def current_view(self, broadcast_key_bytes: int = BROADCAST_KEY_BYTES) -> DataFrame:
        """Latest row per key: the log alone, or the compacted base merged
        with the batches it has not folded (see ``merge_latest``)."""
        current = self.base.latest()
        version = None if current is None else current[0]
        return self._view(version, self._pairs(version), broadcast_key_bytes)

    def _base_within(self, pairs: DataFrame) -> int | None:
        """The newest base version whose batches are all among ``pairs``."""
        for version in self.base.versions():
            if not self._folded(version).join(pairs, list(_PAIR), "left_anti").take(1):
                return version
        return None

    def changes_of(self, pairs: DataFrame) -> DataFrame:
        """Changes that give the view as of exactly these batches: a base within them, and the log rows of the others."""
        version = self._base_within(pairs)
        if version is None:
            return self._rows_of(pairs)
        rest = pairs.join(self._folded(version), list(_PAIR), "left_anti")
        return self.base.read(version).select(*_VIEW_COLUMNS).unionByName(self._rows_of(rest))

    def committed(self) -> DataFrame:
        """(writer, batch_id, commit_seq) of all committed batches."""
        return self._pairs(None)

    def compact(self, broadcast_key_bytes: int = BROADCAST_KEY_BYTES) -> int:
        """Fold the committed batches into a new published base version.

        The set of batches is fixed first and stored beside the version, then
        the version is published: a batch committed meanwhile, by any writer, is
        not in the set and stays in the tail. All rows are laid out anew, by date or key.
        """
        current = self.base.latest()
        version = None if current is None else current[0]
        found = self._pairs(version).collect()  # one small row for each batch since the last compaction
        if not found:
            return version or 0
        pairs = self.spark.createDataFrame(found, _PAIRS_SCHEMA)
        folded = pairs.select(*_PAIR) if version is None else pairs.select(*_PAIR).unionByName(self._folded(version))
        new = self.base.claim_version()
        folded.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/base_folded/v={new}")
        view = self._view(version, pairs, broadcast_key_bytes)
        if not self.key_buckets:
            view = date_layout(view)
        elif version is None:  # a merge with a bucketed base is dealt out by its buckets already
            view = view.repartition(self.key_buckets, "unique_key")
        self.base.write_version(view, new)
        self.base.point(new)
        return new


_PAIRS_SCHEMA = T.StructType([*_FOLDED_SCHEMA.fields, VIEW_SCHEMA["commit_seq"]])


def current_records(view: DataFrame) -> DataFrame:
    """The raw-table projection of the current view (record columns only)."""
    return view.select(*S.RECORD_COLUMNS)
