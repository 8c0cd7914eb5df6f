"""Registered queries: one per operator group of the inventory.

Each entry takes ``(spark, sf_dir)``, reads the driver tables under
``sf_dir`` through the adapters (landed once per session) and returns a
DataFrame over the whole input; ``gridpulse.oracle.ORACLE_SQL`` holds the
DuckDB text for the same answer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse import schema as S
from gridpulse.functions import noise_rule
from gridpulse.operators import rollups as R
from gridpulse.operators.filters import ComplaintFilter, coords_present, lookback
from gridpulse.operators import ingest as I
from gridpulse.operators import ledger as L
from gridpulse.operators.upsert import ChangeLogTable, current_records, latest_by_key
from gridpulse.plans import jobs as J
from gridpulse.plans import refresh as U
from gridpulse.plans import serving as V
from gridpulse.session import scratch_path
from gridpulse.sources import connectors as C
from gridpulse.sources import fixtures as X
from gridpulse.sources.store import VersionedStore, publish_together
from gridpulse.streaming import ingest as STR
from gridpulse.streaming import producer as PUB

AS_OF = S.FIXTURE_AS_OF


def _complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.complaints_table(spark, sf_dir)


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.messages_table(spark, sf_dir)


def _extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extract_table(spark, sf_dir)


_stored: dict[tuple[str, str], str] = {}


def _stored_rollups(spark: SparkSession, sf_dir: str) -> tuple[VersionedStore, VersionedStore]:
    """The published rollups of ``sf_dir``, rebuilt once per session, as a nightly job would."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _stored:
        root = scratch_path(spark, "rollups")
        grid, times = J.rollup_stores(spark, root)
        outputs = [(grid, _grid_rollups(spark, sf_dir), *J.GRID_LAYOUT), (times, _time_rollups(spark, sf_dir), *J.TIME_LAYOUT)]
        publish_together(outputs, published_at=AS_OF)
        _stored[key] = root
    return J.rollup_stores(spark, _stored[key])


def _grid_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.grid_rollups(_complaints(spark, sf_dir), refreshed_at=AS_OF)


def _time_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.time_rollups(_complaints(spark, sf_dir), refreshed_at=AS_OF)


# --- points ---------------------------------------------------------------

POINTS_FILTER = ComplaintFilter(
    start_date="2024-01-05T00:00:00",
    end_date="2024-01-20T23:59:59",
    borough="queens",
    complaint_type="Noise - Residential",
    descriptor="Loud Music/Party",
)
BBOX_FILTER = ComplaintFilter(min_lat=40.50, max_lat=40.55, min_lon=-74.23)


def q_points_page(spark, sf_dir):
    return V.points_page(_complaints(spark, sf_dir), ComplaintFilter(), limit=500, offset=100)


def q_points_filtered(spark, sf_dir):
    return V.points_page(_complaints(spark, sf_dir), POINTS_FILTER, limit=5000)


def q_points_bbox(spark, sf_dir):
    return V.points_page(_complaints(spark, sf_dir), BBOX_FILTER, limit=5000)


DEEP_OFFSET, DEEP_LIMIT = 600, 200


def q_points_deep(spark, sf_dir):
    """A deep page, bracketed by counts, and the page behind its last row."""
    complaints = _complaints(spark, sf_dir)
    page = V.points_page(complaints, ComplaintFilter(), limit=DEEP_LIMIT, offset=DEEP_OFFSET, bracket_rows=50)
    last = page.select("created_date", "unique_key").collect()[-1:]  # a client seeks with the last row it was sent
    if not last:
        return page
    return page.unionByName(V.points_after(complaints, last[0]["created_date"], last[0]["unique_key"], limit=DEEP_LIMIT))


def q_points_by_place(spark, sf_dir):
    """The box of ``points_bbox`` from a table laid out by place codes."""
    store = VersionedStore(spark, scratch_path(spark, "points"))
    J.publish_points(_complaints(spark, sf_dir), store, AS_OF)
    return V.points_page(store.read(), BBOX_FILTER, limit=5000)


def q_points_finite(spark, sf_dir):
    """Some points of the page are NaN or infinite; the map can't place them."""
    k = F.col("unique_key").cast("long") % 10
    lat = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).otherwise(F.col("latitude"))
    lon = F.when(k == 2, F.lit(float("-inf"))).otherwise(F.col("longitude"))
    odd = _complaints(spark, sf_dir).where(coords_present()).withColumns({"latitude": lat, "longitude": lon})
    return V.finite_points(V.points_page(odd, limit=S.UI_POINTS_LIMIT))


def q_noise_rules(spark, sf_dir):
    types = _messages(spark, sf_dir).groupBy("complaint_type").agg(F.count(F.lit(1)).alias("n_rows"))
    return types.select(
        "complaint_type",
        "n_rows",
        *[noise_rule(r).alias(r) for r in ("ilike_prefix", "contains_ci", "contains_cs", "like_prefix")],
    )


# --- grid -----------------------------------------------------------------

SERVING_QUERY = V.GridQuery(
    flt=ComplaintFilter(
        min_lat=S.DEFAULT_VIEWPORT[0],
        max_lat=S.DEFAULT_VIEWPORT[1],
        min_lon=S.DEFAULT_VIEWPORT[2],
        max_lon=S.DEFAULT_VIEWPORT[3],
    ),
    zoom_level=11,
    min_count=2,
)
LIVE_QUERY = V.GridQuery(flt=ComplaintFilter(borough="queens"), min_count=2)
SUMMARY_QUERY = V.GridQuery(flt=ComplaintFilter(borough="brooklyn", complaint_type="Noise - Residential"))


def q_grid_rollups(spark, sf_dir):
    return _grid_rollups(spark, sf_dir)


def q_grid_rollups_offline(spark, sf_dir):
    return R.grid_rollups(_complaints(spark, sf_dir), noise="contains_ci")


def q_grid_serving(spark, sf_dir):
    return V.grid_from_rollups(_stored_rollups(spark, sf_dir)[0].read(), SERVING_QUERY)


def q_grid_live(spark, sf_dir):
    return V.grid_live(_complaints(spark, sf_dir), LIVE_QUERY)


def q_grid_500m(spark, sf_dir):
    return R.grid_500m(_complaints(spark, sf_dir))


def q_density_classes(spark, sf_dir):
    cells = V.grid_from_rollups(_stored_rollups(spark, sf_dir)[0].read(), V.GridQuery(zoom_level=12, min_count=1))
    return V.density_classes(cells)


def q_viewport_counts(spark, sf_dir):
    vp = V.viewport(_stored_rollups(spark, sf_dir)[0].resolver(), _complaints(spark, sf_dir), zoom_level=15)
    return V.viewport_counts(vp)


# --- time -----------------------------------------------------------------


def q_time_rollups(spark, sf_dir):
    return _time_rollups(spark, sf_dir)


def q_time_rollups_offline(spark, sf_dir):
    return R.time_rollups(_complaints(spark, sf_dir), noise="contains_ci", require_created=False, require_coords=True)


# --- overview -------------------------------------------------------------

OVERVIEW_FILTER = ComplaintFilter(start_date="2024-01-10")


def q_overview(spark, sf_dir):
    return V.overview(_complaints(spark, sf_dir), OVERVIEW_FILTER).overview


def q_top_types(spark, sf_dir):
    return V.overview(_complaints(spark, sf_dir)).top_complaint_types


def q_counts_by_borough(spark, sf_dir):
    return V.overview(_complaints(spark, sf_dir)).counts_by_borough


def q_type_counts(spark, sf_dir):
    return R.type_counts(_complaints(spark, sf_dir))


def q_freshness(spark, sf_dir):
    return V.freshness(_complaints(spark, sf_dir))


# --- extract --------------------------------------------------------------


def q_lookback_extract(spark, sf_dir):
    c = _complaints(spark, sf_dir)
    return (
        c.where(noise_rule("like_prefix") & coords_present() & lookback(AS_OF, S.LOOKBACK_DAYS))
        .select(*S.BUSINESS_COLUMNS)
        .orderBy(F.desc_nulls_first("created_date"), F.asc("unique_key"))
    )


# --- published rollups (write a version, then serve from it) --------------


def q_grid_summary(spark, sf_dir):
    store = VersionedStore(spark, scratch_path(spark, "grid-rollups"), S.GRID_ROLLUP_SCHEMA)
    store.publish(
        _grid_rollups(spark, sf_dir),
        *J.GRID_LAYOUT,
        published_at=AS_OF,
    )
    return V.grid_summary(store.resolver(), _complaints(spark, sf_dir), SUMMARY_QUERY)


def q_timeseries_day(spark, sf_dir):
    store = VersionedStore(spark, scratch_path(spark, "time-rollups"), S.TIME_ROLLUP_SCHEMA)
    store.publish(_time_rollups(spark, sf_dir), *J.TIME_LAYOUT, published_at=AS_OF)
    return V.timeseries(store.read(), "day", borough="brooklyn", limit=90)


def q_rebuild_serve(spark, sf_dir):
    """The nightly job: both rollups rebuilt and published as one, recorded in the ledger; what the stores then serve."""
    root = scratch_path(spark, "rebuild")
    grid, times = J.rollup_stores(spark, f"{root}/rollups")
    runs = L.RunLog(spark, f"{root}/runs")
    J.rebuild_rollups(_complaints(spark, sf_dir), grid, times, runs, as_of=AS_OF)
    status = runs.ledger(with_rows=False).where(F.col("job_name") == J.REBUILD_JOB).select("last_status")

    def level(store: VersionedStore, name: str, column: str) -> DataFrame:
        return store.read().groupBy(F.lit(name).alias("store"), F.col(column).cast("string").alias("level")).agg(
            F.count(F.lit(1)).alias("cells"), F.sum("complaint_count").alias("complaints")
        )

    levels = level(grid, "grid", "zoom_level").unionByName(level(times, "time", "bucket_type"))
    return levels.withColumn("last_status", status.scalar())


REFRESH_BATCHES = 3


def q_rollup_refresh(spark, sf_dir):
    """The messages arrive in ranges of offsets; the rollups are built after the first and then only
    brought up to date, across a compaction. Both published rollups, whole."""
    root = scratch_path(spark, "refresh")
    table, runs = ChangeLogTable(spark, f"{root}/table"), L.RunLog(spark, f"{root}/runs")
    grid, times = J.rollup_stores(spark, f"{root}/rollups")
    changes = _valid_changes(spark, sf_dir)
    ranges = X.ranges_of(changes, "msg_offset", REFRESH_BATCHES)
    for k, batch in enumerate(ranges):
        table.append_batch(batch, k, ingested_at=AS_OF, writer="replay")
        if k == 1:
            table.compact()
        U.refresh_rollups(table, grid, times, runs, AS_OF)
    cells = grid.read().select(
        F.lit("grid").alias("store"), F.col("zoom_level").cast("string").alias("level"), "borough", "complaint_type", "lat_bucket", "lon_bucket",
        F.lit(None).cast("timestamp_ntz").alias("bucket_start"), "complaint_count", "center_lat", "center_lon", "earliest_created_date", "latest_created_date",
    )
    buckets = times.read().withColumns({"store": F.lit("time"), "level": F.col("bucket_type")})
    missing = [c for c in cells.columns if c not in buckets.columns]
    return cells.unionByName(buckets.select(*[F.lit(None).cast(cells.schema[c].dataType).alias(c) if c in missing else c for c in cells.columns]))


def q_csv_snapshot(spark, sf_dir):
    """The sized snapshot of the newest rows, written as one CSV file and read back."""
    path = scratch_path(spark, "csv-snapshot")
    J.csv_snapshot(_complaints(spark, sf_dir), path)
    fields = [S.COMPLAINT_SCHEMA[c] for c in S.BUSINESS_COLUMNS]
    return C.read_csv(spark, path, T.StructType(fields))


def q_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "csv-rollups")
    C.write_csv(_grid_rollups(spark, sf_dir), path)
    return C.read_csv(spark, path, S.GRID_ROLLUP_SCHEMA)


# --- ingest ---------------------------------------------------------------

MSG_META = ("msg_offset", "partition_id")


def q_normalize_sync(spark, sf_dir):
    return I.normalize_sync(_extract(spark, sf_dir))


def q_message_encode(spark, sf_dir):
    return I.encode_messages(_extract(spark, sf_dir), source=S.PRODUCER_SOURCE, keep=("msg_offset",))


def q_normalize_stream(spark, sf_dir):
    return I.valid_rows(I.normalize_stream(_messages(spark, sf_dir), keep=MSG_META))


def q_stream_rejects(spark, sf_dir):
    return I.raw_rejects(_messages(spark, sf_dir), keep=MSG_META)


def _valid_changes(spark, sf_dir):
    return I.valid_rows(I.normalize_stream(_messages(spark, sf_dir), keep=("msg_offset", "partition_id", "msg_ts")))


def q_upsert_latest(spark, sf_dir):
    changes = _valid_changes(spark, sf_dir).withColumn("batch_id", F.lit(0).cast("long"))
    return latest_by_key(changes, value_cols=S.RECORD_COLUMNS[1:]).select(*S.RECORD_COLUMNS)


KEY_BUCKETS = 8
#: messages for one bucket: a bucket is one task's work
ROWS_PER_BUCKET = 500_000


def key_buckets(rows: int) -> int:
    """Buckets of the key for a table of at most ``rows`` keys."""
    return max(KEY_BUCKETS, -(-rows // ROWS_PER_BUCKET))


def q_upsert_bucketed(spark, sf_dir):
    """The messages in ranges of offsets, compacted after the first two into a base in buckets of the key; the
    last range meets it there. The current view, as ``upsert_latest`` gives it from the changes alone."""
    buckets = key_buckets(_messages(spark, sf_dir).count())
    table = ChangeLogTable(spark, scratch_path(spark, "bucketed"), key_buckets=buckets)
    for k, batch in enumerate(X.ranges_of(_valid_changes(spark, sf_dir), "msg_offset", REFRESH_BATCHES)):
        if k:
            table.compact()
        table.append_batch(batch, k, ingested_at=AS_OF, writer="replay")
    return current_records(table.current_view())


def q_stream_offsets(spark, sf_dir):
    return STR.partition_progress(_valid_changes(spark, sf_dir), updated_at=AS_OF).orderBy("consumer_name", "partition_id")


REPLAY_RANGES = 3


def q_stream_replay(spark, sf_dir):
    """Replay a captured topic through the consumer stream, which stops after
    each range and resumes from its checkpoint; before the last range the log
    is compacted into a base. The answer is the current view (compacted base
    merged with the log tail)."""
    root = scratch_path(spark, "stream-replay")
    table = ChangeLogTable(spark, f"{root}/table")
    ranges = X.offset_ranges(X.to_envelopes(_messages(spark, sf_dir)), REPLAY_RANGES)
    for k, envelopes in enumerate(ranges):
        if k == len(ranges) - 1:
            table.compact()
        X.land_range(envelopes, f"{root}/landing", k)
        stream = STR.read_envelope_files(spark, f"{root}/landing/range-*/*.json")
        STR.start_ingest(stream, STR.StreamIngest(table), f"{root}/checkpoint").awaitTermination()
    return current_records(table.current_view())


def q_sync_upsert(spark, sf_dir):
    """The scheduled sync as a whole: gate, lookback extract, strict parse, one upsert
    batch, row count and ledger; then a compaction and a retried batch, which change
    nothing. The rows that stay, with the run's recorded row count."""
    root = scratch_path(spark, "sync")
    table, runs = ChangeLogTable(spark, f"{root}/table"), L.RunLog(spark, f"{root}/runs")
    extract = _extract(spark, sf_dir)
    J.scheduled_sync(extract, table, runs, AS_OF, batch_id=0, lookback_days=SYNC_LOOKBACK, clock=lambda: AS_OF)
    table.compact()
    J.scheduled_sync(extract, table, runs, AS_OF, batch_id=0, interval_days=0, lookback_days=SYNC_LOOKBACK, clock=lambda: AS_OF)
    counted = runs.ledger().where(F.col("job_name") == J.SYNC_JOB).select("rows_processed")
    return current_records(table.current_view()).select("*", counted.scalar().alias("rows_processed"))


# wide enough that the fixtures' extract repeats keys
SYNC_LOOKBACK = 20


def q_csv_stream_publish(spark, sf_dir):
    """CSV snapshot of the extract -> streaming producer -> published JSON values."""
    root = scratch_path(spark, "csv-publish")
    C.write_csv(_extract(spark, sf_dir).select(*S.BUSINESS_COLUMNS), f"{root}/snapshot")
    publisher = PUB.FilePublisher(f"{root}/topic")
    query = PUB.start_file_publisher(PUB.read_csv_stream(spark, f"{root}/snapshot"), publisher, f"{root}/checkpoint")
    query.awaitTermination()
    return publisher.published(spark).select("value")


# --- ledger ---------------------------------------------------------------


def _runs(spark, sf_dir):
    return X.runs_table(spark, sf_dir)


def q_run_ledger(spark, sf_dir):
    return L.fold_runs(_runs(spark, sf_dir))


def q_aggregate_ledger(spark, sf_dir):
    """The aggregate jobs' listing: the same fold, without row counts."""
    return L.fold_runs(_runs(spark, sf_dir), with_rows=False)


def q_due_jobs(spark, sf_dir):
    return L.gate(L.fold_runs(_runs(spark, sf_dir)), AS_OF, S.SYNC_INTERVAL_DAYS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "points_page": q_points_page,
    "points_filtered": q_points_filtered,
    "points_bbox": q_points_bbox,
    "points_deep": q_points_deep,
    "points_by_place": q_points_by_place,
    "points_finite": q_points_finite,
    "noise_rules": q_noise_rules,
    "grid_rollups": q_grid_rollups,
    "grid_rollups_offline": q_grid_rollups_offline,
    "grid_serving": q_grid_serving,
    "grid_live": q_grid_live,
    "grid_500m": q_grid_500m,
    "time_rollups": q_time_rollups,
    "time_rollups_offline": q_time_rollups_offline,
    "overview": q_overview,
    "top_types": q_top_types,
    "counts_by_borough": q_counts_by_borough,
    "type_counts": q_type_counts,
    "freshness": q_freshness,
    "density_classes": q_density_classes,
    "viewport_counts": q_viewport_counts,
    "lookback_extract": q_lookback_extract,
    "grid_summary": q_grid_summary,
    "timeseries_day": q_timeseries_day,
    "csv_roundtrip": q_csv_roundtrip,
    "normalize_sync": q_normalize_sync,
    "normalize_stream": q_normalize_stream,
    "stream_rejects": q_stream_rejects,
    "message_encode": q_message_encode,
    "upsert_latest": q_upsert_latest,
    "upsert_bucketed": q_upsert_bucketed,
    "stream_replay": q_stream_replay,
    "csv_stream_publish": q_csv_stream_publish,
    "stream_offsets": q_stream_offsets,
    "run_ledger": q_run_ledger,
    "due_jobs": q_due_jobs,
    "sync_upsert": q_sync_upsert,
    "rebuild_serve": q_rebuild_serve,
    "rollup_refresh": q_rollup_refresh,
    "csv_snapshot": q_csv_snapshot,
    "aggregate_ledger": q_aggregate_ledger,
}
