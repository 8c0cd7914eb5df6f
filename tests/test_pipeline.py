"""The README's pipeline end to end, with a file-replayed topic instead of Kafka."""

import datetime as dt

from gridpulse.operators import rollups as R
from gridpulse.operators.filters import ComplaintFilter
from gridpulse.operators.ledger import RunLog
from gridpulse.operators.upsert import ChangeLogTable, current_records
from gridpulse.plans import jobs, refresh, serving as V
from gridpulse.sources import fixtures as X
from gridpulse.sources.store import VersionedStore
from gridpulse.streaming import ingest as stream

SF = "/root/testdata/sf0.001"


def test_ingest_compact_rebuild_serve(spark, scratch):
    root = scratch("pipeline")
    table = ChangeLogTable(spark, f"{root}/table")
    sink = stream.StreamIngest(table)
    for k, envelopes in enumerate(X.offset_ranges(X.to_envelopes(X.messages_table(spark, SF)), 2)):
        X.land_range(envelopes, f"{root}/landing", k)
        files = stream.read_envelope_files(spark, f"{root}/landing/range-*/*.json")
        stream.start_ingest(files, sink, f"{root}/ckpt").awaitTermination()
    table.compact()
    complaints = current_records(table.current_view())
    n_keys = complaints.count()
    assert n_keys == complaints.select("unique_key").distinct().count() > 0

    grid, times = jobs.rollup_stores(spark, f"{root}/rollups")
    jobs.rebuild_rollups(complaints, grid, times, RunLog(spark, f"{root}/runs"), as_of=dt.datetime(2024, 1, 31))

    cells = V.grid_summary(grid.resolver(), complaints, V.GridQuery(ComplaintFilter(borough="queens"), zoom_level=12))
    assert cells.count() == grid.read().where("zoom_level = 12 AND borough = 'QUEENS'").count()
    page = V.points_page(complaints, ComplaintFilter(start_date="2024-01-01"), limit=50).collect()
    assert len(page) == 50 and all(p.created_date is not None for p in page)
    series = V.timeseries(times.read(), "day", limit=10).collect()
    assert len(series) == 10
    offsets = sink.offsets().collect()
    assert {r.partition_id for r in offsets} == {0, 1, 2}


def test_ingest_refresh_compact_place_serve(spark, scratch):
    """The README's example: rollups refreshed after each arrival and across a compaction, points laid out by place."""
    root, as_of = scratch("pipeline-refresh"), dt.datetime(2024, 1, 31)
    table, runs = ChangeLogTable(spark, f"{root}/table"), RunLog(spark, f"{root}/runs")
    grid, times = jobs.rollup_stores(spark, f"{root}/rollups")
    sink = stream.StreamIngest(table)
    for k, envelopes in enumerate(X.offset_ranges(X.to_envelopes(X.messages_table(spark, SF)), 3)):
        X.land_range(envelopes, f"{root}/landing", k)
        files = stream.read_envelope_files(spark, f"{root}/landing/range-*/*.json")
        stream.start_ingest(files, sink, f"{root}/ckpt").awaitTermination()
        assert refresh.refresh_rollups(table, grid, times, runs, as_of) == k + 1
        if k == 1:
            table.compact()
    complaints = current_records(table.current_view())
    whole = R.grid_rollups(complaints, refreshed_at=as_of)
    kept = grid.read().select(whole.columns)
    assert kept.exceptAll(whole).count() == whole.exceptAll(kept).count() == 0

    points = VersionedStore(spark, f"{root}/points")
    jobs.publish_points(complaints, points, as_of=as_of)
    box = ComplaintFilter(min_lat=40.5, max_lat=40.55, min_lon=-74.06, max_lon=-74.0)
    assert V.points_page(points.read(), box).collect() == V.points_page(complaints, box).collect() != []
