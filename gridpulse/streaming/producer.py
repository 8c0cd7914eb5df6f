"""Streaming producer: a CSV snapshot (or landed text rows) -> JSON messages.

Rows are validated and encoded exactly like the batch producer
(``encode_messages``: stripped type must contain "Noise", key and both
coordinates non-empty; values stay text; ``source`` tag). Each micro-batch
is published either to Kafka (``value`` column, no message key, as the
reference sends) or, where no broker exists, as JSON files under
``<topic_dir>/batch_id=<n>`` rewritten whole on retry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridpulse import schema as S
from gridpulse.operators.ingest import encode_messages
from gridpulse.sources.connectors import RFC_4180


def as_csv_text(rows: DataFrame) -> DataFrame:
    """CSV has no NULL: a field read from a snapshot is text, '' when empty
    (what a dict-based CSV reader yields), so the message carries "" then."""
    return rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in S.BUSINESS_COLUMNS], "source")


def read_csv_stream(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None, multi_line: bool = False
) -> DataFrame:
    """CSV snapshot files as a stream of text records (RFC 4180, explicit schema, header).

    ``multi_line`` reads quoted line breaks; it makes every file one task.
    """
    reader = spark.readStream.schema(S.MESSAGE_SCHEMA).options(**RFC_4180).option("header", True).option("multiLine", multi_line)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return as_csv_text(reader.csv(path))


class FilePublisher:
    """foreachBatch sink: encoded messages -> JSON files, one folder per batch."""

    def __init__(self, topic_dir: str, source: str = S.PRODUCER_SOURCE):
        self.topic_dir = topic_dir.rstrip("/")
        self.source = source

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        encode_messages(batch, source=self.source).write.mode("overwrite").json(f"{self.topic_dir}/batch_id={batch_id}")

    def published(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("value string, batch_id long").json(self.topic_dir)


def start_file_publisher(
    rows: DataFrame, publisher: FilePublisher, checkpoint_location: str, available_now: bool = True
) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(publisher).option("checkpointLocation", checkpoint_location)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_kafka_publisher(
    rows: DataFrame,
    bootstrap_servers: str,
    checkpoint_location: str,
    topic: str = S.TOPIC,
    source: str = S.PRODUCER_SOURCE,
    options: dict[str, str] | None = None,
) -> StreamingQuery:
    """Publish to Kafka (needs the spark-sql-kafka package on the classpath)."""
    writer = (
        encode_messages(rows, source=source)
        .select(F.col("value"))
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap_servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint_location)
    )
    for k, v in (options or {}).items():
        writer = writer.option(k, v)
    return writer.start()
