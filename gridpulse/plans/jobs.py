"""Batch jobs: the units a scheduler runs, composed from the operators.

* ``rebuild_rollups``   canonical grid + time rollups from one scan, published by one
                        pointer, recorded in the run ledger (started / success / failed);
* ``scheduled_sync``    interval gate -> lookback extract -> strict
                        normalisation -> one upsert batch, rows counted in the
                        same pass (``observe``), recorded in the ledger;
* ``offline_grid_job`` / ``offline_time_job``  the offline variants, written to
                        any sink (parquet store or JDBC);
* ``type_counts_report`` / ``grid_500m_report``  the ad-hoc CSV reports.

Every job takes ``as_of`` instead of reading the clock where a result
depends on it.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridpulse import schema as S
from gridpulse.functions import iso_timestamp, noise_rule, ntz_lit, place_code
from gridpulse.operators import rollups as R
from gridpulse.operators.ingest import normalize_sync
from gridpulse.operators.ledger import RunLog, should_run
from gridpulse.operators.upsert import ChangeLogTable
from gridpulse.sources.connectors import JdbcConfig, read_csv, write_csv, write_jdbc, write_single_csv
from gridpulse.sources.store import VersionedStore, publish_together

# Job names in the ledgers.
REBUILD_JOB = "postgres_aggregate_rebuild"
SYNC_JOB = "socrata_noise_sync"


def utc_now() -> _dt.datetime:
    """The UTC wall clock, zone-less like all stored times."""
    return _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)


def rollup_stores(spark: SparkSession, root: str) -> tuple[VersionedStore, VersionedStore]:
    """The grid and the time store under ``root``, published by one pointer."""
    return (
        VersionedStore(spark, f"{root.rstrip('/')}/grid", S.GRID_ROLLUP_SCHEMA, pointer_root=root),
        VersionedStore(spark, f"{root.rstrip('/')}/time", S.TIME_ROLLUP_SCHEMA, pointer_root=root),
    )


# How the rollups lie in their stores: partition column, then the columns files are ranged and sorted by.
GRID_LAYOUT = ("zoom_level", ["lat_bucket", "lon_bucket"])
TIME_LAYOUT = ("bucket_type", ["bucket_start", "borough", "complaint_type"])


def rebuild_rollups(
    complaints: DataFrame,
    grid_store: VersionedStore,
    time_store: VersionedStore,
    run_log: RunLog,
    as_of: _dt.datetime,
    clock: Callable[[], _dt.datetime] = utc_now,
) -> int:
    """Rebuild both rollups from the current view and publish them as one.

    One scan and one shuffle of ``complaints`` give the state of both
    (``rollup_state``), which is written first; grid and time rollup are then split
    from what was written. One pointer row names all three, so readers see either
    the new ones or the old ones, and jobs that rebuild at the same time each
    publish a whole version of their own. On failure the ledger records the error
    (cut to 1000 characters) and the error is raised again; the previous version
    stays published. Returns the version.
    """
    return run_log.run_for(REBUILD_JOB, lambda: publish_rollups(R.rollup_state(complaints), grid_store, time_store, as_of), clock=clock)


def rollup_state_store(grid_store: VersionedStore) -> VersionedStore:
    """The store of the mergeable form of both rollups, beside the grid store."""
    root = grid_store.pointer_root
    return VersionedStore(grid_store.spark, f"{root}/state", S.ROLLUP_STATE_SCHEMA, pointer_root=root)


def publish_rollups(
    state: DataFrame,
    grid_store: VersionedStore,
    time_store: VersionedStore,
    as_of: _dt.datetime,
    before_pointer: Callable[[int], None] | None = None,
) -> int:
    """Write the state, split grid and time rollup from what was written, and publish the three as one."""
    states = rollup_state_store(grid_store)

    def split_off(of: Callable[[DataFrame, _dt.datetime], DataFrame]) -> Callable[[int], DataFrame]:
        return lambda version: of(states.spark.read.schema(S.ROLLUP_STATE_SCHEMA).parquet(states.version_path(version)), as_of)

    outputs = [
        (states, state, "kind", None),
        (grid_store, split_off(R.grid_of_state), *GRID_LAYOUT),
        (time_store, split_off(R.time_of_state), *TIME_LAYOUT),
    ]
    return publish_together(outputs, published_at=as_of, before_pointer=before_pointer)


POINTS_LAYOUT = ("_period", "place_code", "created_date", "unique_key")


def publish_points(complaints: DataFrame, store: VersionedStore, as_of: _dt.datetime, period: str = "month") -> int:
    """Publish the complaints laid out for map boxes: by month (or ``year``, ``week``), in it by place code.

    Files hold disjoint ranges of (period, code) and are sorted inside, so the code
    intervals of a box skip files and row groups, and date bounds skip whole
    periods. Rows without a place have no code and lie first in their period.
    """
    laid = complaints.withColumns({"place_code": place_code(), "_period": F.trunc(F.to_date("created_date"), period)})
    version = store.claim_version()
    ranged = laid.repartitionByRange(*POINTS_LAYOUT).sortWithinPartitions(*POINTS_LAYOUT)
    store.write_version(ranged.drop("_period"), version)
    store.point(version, as_of)
    return version


def extract_since(extract: DataFrame, as_of: _dt.datetime, days: int = S.LOOKBACK_DAYS) -> DataFrame:
    """The sync's source predicate on landed text rows: type like 'Noise%',
    coordinates present, created_date >= as_of - days."""
    since = ntz_lit(as_of - _dt.timedelta(days=days))
    return extract.where(
        noise_rule("like_prefix")
        & F.col("latitude").isNotNull()
        & F.col("longitude").isNotNull()
        & (iso_timestamp(F.col("created_date")) >= since)
    )


def scheduled_sync(
    extract: DataFrame,
    table: ChangeLogTable,
    run_log: RunLog,
    as_of: _dt.datetime,
    batch_id: int,
    *,
    writer: str = SYNC_JOB,
    interval_days: int = S.SYNC_INTERVAL_DAYS,
    lookback_days: int = S.LOOKBACK_DAYS,
    clock: Callable[[], _dt.datetime] = utc_now,
) -> int | None:
    """Run the sync if due; returns rows upserted, or None when skipped.

    A value that does not parse fails the whole batch (nothing of it is
    visible: the batch folder is only complete once its write commits) and
    marks the run failed.
    """
    ledger = run_log.ledger().where(F.col("job_name") == SYNC_JOB).select("last_successful_at").first()
    if not should_run(ledger["last_successful_at"] if ledger else None, as_of, interval_days):
        return None

    def body() -> int:
        obs = Observation("sync")
        rows = normalize_sync(extract_since(extract, as_of, lookback_days))
        # Rows of an extract are upserted newest first, so of a repeated key the
        # OLDEST created_date is written last and stays (SURVEY, decided orders).
        # Of equal dates the greatest values stay, whatever the partitions.
        newest_first = -F.timestamp_diff("MICROSECOND", ntz_lit(_dt.datetime(1970, 1, 1)), F.col("created_date"))
        rows = rows.select("*", F.col("created_date").alias("msg_ts"), newest_first.alias("msg_offset"))
        if not table.append_batch(rows.observe(obs, F.count(F.lit(1)).alias("rows")), batch_id, ingested_at=as_of, writer=writer):
            return table.batch_rows(batch_id, writer)
        return int(obs.get["rows"])

    return run_log.run(SYNC_JOB, body, clock=clock)


def jdbc_sink(cfg: JdbcConfig, table: str, batch_size: int = 500) -> Callable[[DataFrame], None]:
    """Overwrite a database table in place (``truncate``), in batches."""
    return lambda df: write_jdbc(df, cfg, table, mode="overwrite", batch_size=batch_size, truncate=True)


def store_sink(store: VersionedStore, partition_by: str | None = None, published_at: _dt.datetime | None = None):
    """Publish a new version of a parquet store."""
    return lambda df: store.publish(df, partition_by=partition_by, published_at=published_at)


def offline_grid_job(complaints: DataFrame, write: Callable[[DataFrame], None]) -> None:
    """Offline grid layers (contains_ci rule, no refreshed_at) to any sink."""
    write(R.grid_rollups(complaints, noise="contains_ci"))


def offline_time_job(complaints: DataFrame, write: Callable[[DataFrame], None]) -> None:
    """Offline time buckets (coordinates required, NULL bucket kept) to any sink."""
    write(R.time_rollups(complaints, noise="contains_ci", require_created=False, require_coords=True))


# Fixed value: default size of a CSV snapshot extract.
SNAPSHOT_ROWS = 10_000


def csv_snapshot(complaints: DataFrame, path: str, rows: int = SNAPSHOT_ROWS) -> None:
    """Newest ``rows`` noise complaints with coordinates ('Noise%' prefix,
    created_date descending) as a CSV snapshot: the input of the streaming
    producer. The row count is the feature (a sized sample of the newest
    data); it is a pruned top-k, not a sort of the table."""
    write_single_csv(newest_noise(complaints, rows), path, sort_by=_newest())


def _newest() -> list:
    return [F.desc_nulls_first("created_date"), F.asc("unique_key")]


def newest_noise(complaints: DataFrame, rows: int = SNAPSHOT_ROWS) -> DataFrame:
    """The rows of a snapshot; rows without a date come first, as in a DESC order."""
    from gridpulse.plans.serving import newest_cutoff

    noisy = complaints.where(noise_rule("like_prefix") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    cutoff = newest_cutoff(noisy, rows)
    if cutoff is not None:
        noisy = noisy.where(cutoff)
    return noisy.orderBy(*_newest()).limit(rows).select(*S.BUSINESS_COLUMNS)


def type_counts_report(complaints: DataFrame, path: str) -> None:
    """Complaint-type counts as ONE CSV file, most frequent first."""
    write_single_csv(R.type_counts(complaints), path, sort_by=[F.desc("count"), F.asc_nulls_first("complaint_type")])


def grid_500m_report(
    complaints: DataFrame, path: str, jdbc: JdbcConfig | None = None, table: str = "grid_summary_500m"
) -> None:
    """The unfiltered 0.0045-degree cell report as multi-part CSV, and
    optionally the same cells overwriting a database table (read back from
    the CSV just written, so the aggregation runs once)."""
    cells = R.grid_500m(complaints)
    write_csv(cells, path)
    if jdbc is not None:
        jdbc_sink(jdbc, table)(read_csv(complaints.sparkSession, path, cells.schema))
