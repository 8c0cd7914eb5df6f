"""Readers and writers: CSV, JSON extracts, JDBC, and the source switch.

Every reader takes an explicit schema (CSV inference would turn
``unique_key`` and ``incident_zip`` into integers and lose leading zeros).
JDBC reads are split into parallel range queries when a partition column
is given; the reference reads its table through one connection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse import schema as S
from gridpulse.functions import noise_rule
from gridpulse.operators.filters import coords_present

# ---------------------------------------------------------------------------
# CSV / JSON
# ---------------------------------------------------------------------------


# Zone-less timestamps are written with microseconds (the default keeps millis).
NTZ_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

# RFC 4180: a quote inside a quoted field is doubled; blanks belong to the field.
RFC_4180 = {
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "timestampNTZFormat": NTZ_FORMAT,
}


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, header: bool = True, multi_line: bool = False
) -> DataFrame:
    """RFC-4180 text. ``multi_line`` reads quoted line breaks; it makes every
    file one task, so leave it off where fields hold none."""
    return (
        spark.read.schema(schema)
        .options(**RFC_4180)
        .option("header", header)
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .csv(path)
    )


def read_text_records(spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = False) -> DataFrame:
    """Landed extract / CSV snapshot: all business columns as text."""
    if fmt == "json":
        return spark.read.schema(S.MESSAGE_SCHEMA).json(path)
    return read_csv(spark, path, S.MESSAGE_SCHEMA, multi_line=multi_line)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Multi-part CSV with header (one file per task)."""
    df.write.mode(mode).options(**RFC_4180).option("header", True).csv(path)


def write_single_csv(df: DataFrame, path: str, sort_by: list | None = None, mode: str = "overwrite") -> None:
    """One CSV file, rows in ``sort_by`` order: the sort runs inside the single
    partition, after it was formed, so the file order is guaranteed. Meant
    for small results (reports), as everything passes through one task."""
    one = df.repartition(1)
    if sort_by:
        one = one.sortWithinPartitions(*sort_by)
    one.write.mode(mode).options(**RFC_4180).option("header", True).csv(path)


# ---------------------------------------------------------------------------
# JDBC
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class JdbcConfig:
    url: str
    user: str | None = None
    password: str | None = None
    driver: str | None = None
    extra: dict[str, str] = field(default_factory=dict)

    def options(self) -> dict[str, str]:
        opts = {"url": self.url, **self.extra}
        if self.user is not None:
            opts["user"] = self.user
        if self.password is not None:
            opts["password"] = self.password
        if self.driver:
            opts["driver"] = self.driver
        return opts


@dataclass(frozen=True)
class JdbcPartitioning:
    """Parallel read: ``numPartitions`` range queries over ``column``."""

    column: str
    lower_bound: str
    upper_bound: str
    num_partitions: int


def jdbc_read_options(
    cfg: JdbcConfig, table: str, partitioning: JdbcPartitioning | None = None, fetch_size: int = 10_000
) -> dict[str, str]:
    opts = {**cfg.options(), "dbtable": table, "fetchsize": str(fetch_size)}
    if partitioning is not None:
        opts.update(
            partitionColumn=partitioning.column,
            lowerBound=partitioning.lower_bound,
            upperBound=partitioning.upper_bound,
            numPartitions=str(partitioning.num_partitions),
        )
    return opts


def read_jdbc(
    spark: SparkSession, cfg: JdbcConfig, table: str, partitioning: JdbcPartitioning | None = None
) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_read_options(cfg, table, partitioning)).load()


def jdbc_write_options(cfg: JdbcConfig, table: str, batch_size: int = 500, truncate: bool = True) -> dict[str, str]:
    """``truncate`` keeps the target table (keys, indexes, defaults) on overwrite;
    without it Spark drops and recreates the table."""
    return {**cfg.options(), "dbtable": table, "batchsize": str(batch_size), "truncate": str(truncate).lower()}


def write_jdbc(
    df: DataFrame, cfg: JdbcConfig, table: str, mode: str = "overwrite", batch_size: int = 500, truncate: bool = True
) -> None:
    df.write.format("jdbc").options(**jdbc_write_options(cfg, table, batch_size, truncate)).mode(mode).save()


# ---------------------------------------------------------------------------
# Source switch used by the offline rollup jobs
# ---------------------------------------------------------------------------


def typed_from_text(records: DataFrame) -> DataFrame:
    """CSV text -> typed complaint columns (lenient: junk becomes NULL)."""
    from gridpulse.functions import iso_timestamp, text_to_double

    cols = []
    for c in S.BUSINESS_COLUMNS:
        if c in S.DATE_COLUMNS:
            cols.append(iso_timestamp(F.col(c)).alias(c))
        elif c in S.COORD_COLUMNS:
            cols.append(text_to_double(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return records.select(*cols, F.coalesce(F.col("source"), F.lit(S.TABLE_DEFAULT_SOURCE)).alias("source"))


def read_complaints(
    spark: SparkSession,
    path: str | None = None,
    jdbc: JdbcConfig | None = None,
    table: str = "noise_complaints",
    partitioning: JdbcPartitioning | None = None,
    noise: str | None = "contains_ci",
) -> DataFrame:
    """Offline-job input: a CSV path if given, else the JDBC table; then
    coordinates present + the offline noise rule."""
    if path:
        df = typed_from_text(read_text_records(spark, path))
    elif jdbc is not None:
        df = read_jdbc(spark, jdbc, table, partitioning)
    else:
        raise ValueError("read_complaints needs a path or a JDBC config")
    df = df.where(coords_present())
    return df.where(noise_rule(noise)) if noise else df
