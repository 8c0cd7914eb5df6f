"""Structured Streaming ingest: message envelopes -> change log + side outputs.

Source: a Kafka topic or landed JSON envelope files (replay). Each
micro-batch is decoded with ``from_json``, normalised with the consumer
rules, and written by ``foreachBatch`` into

* ``<table>/log/writer=<w>/batch_id=<id>``     valid changes (the upsert log),
* ``<table>/rejects/writer=<w>/batch_id=<id>`` rejected messages with reasons,
* ``<table>/_commits/writer=<w>/batch_id=<id>`` the commit record, written last:
  a marker plus the per-partition progress the batch reached (rows and
  offsets become visible together, like a consumer committing both in one
  transaction).

The writer is one checkpoint folder: batch ids count from zero in each, so a
stream restarted with a new checkpoint is a new writer and overwrites nothing.
A batch that failed before its commit is written whole again; one that is
committed is skipped, and the checkpoint records the batch only after
``foreachBatch`` returns, so a replay after a lost executor or driver changes
nothing (at-least-once delivery, idempotent sink). There is no watermark: late records are just
newer changes, and rollups are rebuilt from the current view.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gridpulse import schema as S
from gridpulse.functions import ntz_lit
from gridpulse.operators.ingest import RAW_REJECT_COLUMNS, REJECT_COLUMN, normalize_stream
from gridpulse.operators.upsert import COMMIT_SCHEMA, ChangeLogTable

ENVELOPE_SCHEMA = T.StructType(
    [
        T.StructField("topic", T.StringType(), True),
        T.StructField("partition", T.IntegerType(), True),
        T.StructField("offset", T.LongType(), True),
        T.StructField("timestamp", T.TimestampNTZType(), True),
        T.StructField("value", T.StringType(), True),
    ]
)
_META = ("msg_offset", "partition_id", "msg_ts")


def read_envelope_files(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Landed JSON envelopes as a stream (replay of a captured topic)."""
    reader = spark.readStream.schema(ENVELOPE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.json(path)


def read_kafka(
    spark: SparkSession,
    bootstrap_servers: str,
    topic: str = S.TOPIC,
    starting_offsets: str = "earliest",
    max_offsets_per_trigger: int | None = None,
    options: dict[str, str] | None = None,
    min_partitions: int | None = None,
) -> DataFrame:
    """Kafka topic as envelopes (needs the spark-sql-kafka package on the classpath).

    ``minPartitions`` (default: the cluster's parallelism) makes the source
    split large topic partitions into several tasks, so a partition holding a
    third of the traffic does not become one straggler task per micro-batch.
    """
    if min_partitions is None:
        try:
            min_partitions = spark.sparkContext.defaultParallelism
        except Exception:  # Spark Connect
            min_partitions = None
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap_servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting_offsets)
    )
    if min_partitions:
        reader = reader.option("minPartitions", str(min_partitions))
    if max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", str(max_offsets_per_trigger))
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    return reader.load().select(
        "topic",
        "partition",
        "offset",
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
        F.col("value").cast("string").alias("value"),
    )


_CORRUPT = "_corrupt_record"
_DECODE_SCHEMA = T.StructType(list(S.MESSAGE_SCHEMA.fields) + [T.StructField(_CORRUPT, T.StringType(), True)])


def decode_envelopes(envelopes: DataFrame) -> DataFrame:
    """Envelope -> message columns (all text) + metadata + ``decoded`` flag.

    One JSON parse per message: text that is not a JSON object lands in the
    corrupt-record field instead of failing the batch, and marks the
    message undecodable.
    """
    msg = F.from_json(F.col("value"), _DECODE_SCHEMA, {"columnNameOfCorruptRecord": _CORRUPT})
    return envelopes.select("offset", "partition", "timestamp", "value", msg.alias("_m")).select(
        F.col("offset").alias("msg_offset"),
        F.col("partition").alias("partition_id"),
        F.col("timestamp").alias("msg_ts"),
        (F.col("value").isNotNull() & F.col(f"_m.{_CORRUPT}").isNull()).alias("decoded"),
        *[F.col(f"_m.{c}").alias(c) for c in S.RECORD_COLUMNS],
    )


def partition_progress(
    valid: DataFrame,
    consumer_name: str = S.CONSUMER_NAME,
    topic: str = S.TOPIC,
    updated_at: _dt.datetime | Column | None = None,
) -> DataFrame:
    """Per partition: last offset of a VALID message and that message's
    created_date (not the max); skipped messages do not advance it."""
    stamp = updated_at if isinstance(updated_at, Column) else ntz_lit(updated_at or _dt.datetime.now(_dt.timezone.utc))
    offset = F.col("msg_offset")
    return (
        valid.groupBy("partition_id")
        .agg(
            F.max(offset).alias("last_offset"),
            F.max_by("created_date", offset).alias("last_created_date"),
            F.max_by("msg_ts", offset).alias("last_message_at"),
        )
        .select(
            F.lit(consumer_name).alias("consumer_name"),
            F.lit(topic).alias("topic_name"),
            F.col("partition_id").cast("int").alias("partition_id"),
            "last_offset",
            "last_created_date",
            "last_message_at",
            stamp.alias("updated_at"),
        )
    )


def latest_offsets(batch_offsets: DataFrame) -> DataFrame:
    """Fold per-batch progress rows into one row per (consumer, topic, partition): the last commit's."""
    cols = ["last_offset", "last_created_date", "last_message_at", "updated_at"]
    return (
        batch_offsets.groupBy("consumer_name", "topic_name", "partition_id")
        .agg(*[F.max_by(c, "commit_seq").alias(c) for c in cols])
        .orderBy("consumer_name", "partition_id")
    )


class StreamIngest:
    """foreachBatch sink writing the three outputs of one micro-batch."""

    def __init__(
        self, table: ChangeLogTable, consumer_name: str = S.CONSUMER_NAME, topic: str = S.TOPIC, writer: str | None = None
    ):
        self.table = table
        self.consumer_name = consumer_name
        self.topic = topic
        self.writer = writer or consumer_name

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.table.is_committed(batch_id, self.writer):
            return
        # Parse each message once: the normalised batch (typed values, reject
        # reason, and the raw text the rejects report) is cached, and the
        # three outputs are filters over the cache.
        decoded = decode_envelopes(batch)
        raw = [F.col(c).alias(f"raw_{c}") for c in RAW_REJECT_COLUMNS]
        normalized = normalize_stream(
            decoded.select("*", *raw), keep=_META + tuple(f"raw_{c}" for c in RAW_REJECT_COLUMNS), decoded=F.col("decoded")
        ).persist()
        try:
            reason = F.col(REJECT_COLUMN)
            valid = normalized.where(reason.isNull()).drop(REJECT_COLUMN, *[f"raw_{c}" for c in RAW_REJECT_COLUMNS])
            self.table.append_batch(valid, batch_id, commit=False, writer=self.writer)
            rejects = normalized.where(reason.isNotNull()).select(
                *_META, *[F.col(f"raw_{c}").alias(c) for c in RAW_REJECT_COLUMNS], REJECT_COLUMN
            )
            rejects.write.mode("overwrite").parquet(f"{self.table.root}/rejects/writer={self.writer}/batch_id={batch_id}")
            self.table.commit_batch(batch_id, partition_progress(valid, self.consumer_name, self.topic), writer=self.writer)
        finally:
            normalized.unpersist()

    def rejects(self) -> DataFrame:
        """Rejected messages of the committed batches, of all writers."""
        rejects = self.table.spark.read.parquet(f"{self.table.root}/rejects")
        commits = self.table.commits()
        if commits is None:
            return rejects.limit(0)
        return rejects.join(F.broadcast(commits.select("writer", "batch_id").distinct()), ["writer", "batch_id"], "left_semi")

    def offsets(self) -> DataFrame:
        """Stream progress per partition, from the committed batches' records."""
        commits = self.table.commits()
        if commits is None:
            commits = self.table.spark.createDataFrame([], COMMIT_SCHEMA)
        return latest_offsets(commits.where(F.col("partition_id").isNotNull()))


def checkpoint_writer(spark: SparkSession, checkpoint_location: str, consumer_name: str) -> str:
    """A name for the batches of one checkpoint folder, kept in that folder."""
    path = f"{checkpoint_location.rstrip('/')}/_writer"
    try:
        row = spark.read.schema("value string").text(path).first()
        if row is not None:
            return row[0]
    except AnalysisException:
        pass
    name = f"{consumer_name}-{uuid.uuid4().hex[:12]}"
    spark.createDataFrame([(name,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return name


def start_ingest(
    envelopes: DataFrame,
    sink: StreamIngest,
    checkpoint_location: str,
    available_now: bool = True,
    processing_time: str | None = None,
) -> StreamingQuery:
    """Run the ingest stream; ``available_now`` drains what is there and stops.

    The sink writes as the writer of this checkpoint folder.
    """
    sink.writer = checkpoint_writer(sink.table.spark, checkpoint_location, sink.consumer_name)
    writer = envelopes.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint_location)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
