"""The physical plans keep the properties the scale design relies on."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from gridpulse.queries import QUERIES, SUMMARY_QUERY, _stored_rollups
from gridpulse.operators import rollups as R
from gridpulse.plans import serving as V
from gridpulse.sources import fixtures as X

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def _tree(text: str) -> str:
    return text.split("\n\n")[0]


def test_grid_rollup_one_scan_partial_agg_one_shuffle(spark):
    p = plan(QUERIES["grid_rollups"](spark, SF))
    tree = _tree(p)
    assert tree.count("Scan parquet") == 1
    assert tree.count("Exchange") == 1
    assert "partial_count(1)" in p and "Generate" in tree


def test_time_rollup_one_scan_one_shuffle(spark):
    tree = _tree(plan(QUERIES["time_rollups"](spark, SF)))
    assert tree.count("Scan parquet") == 1 and tree.count("Exchange") == 1


def test_upsert_pre_aggregates_hot_keys(spark):
    p = plan(QUERIES["upsert_latest"](spark, SF))
    assert "partial_max(struct(" in p
    assert "Window" not in p


def test_published_rollup_read_prunes_partitions(spark):
    store = _stored_rollups(spark, SF)[0]
    p = plan(V.grid_summary(store.resolver(), X.complaints_table(spark, SF), SUMMARY_QUERY, checked=False))
    assert "PartitionFilters: [isnotnull(zoom_level" in p and "(zoom_level#" in p
    assert "EqualTo(borough,BROOKLYN)" in p


def test_filters_reach_the_scan(spark):
    p = plan(QUERIES["points_filtered"](spark, SF))
    assert "EqualTo(borough,QUEENS)" in p and "GreaterThanOrEqual(created_date" in p
    read_schema = [line for line in p.splitlines() if line.startswith("ReadSchema")][0]
    assert "agency_name" not in read_schema and "ingested_at" not in read_schema


def test_points_page_is_bounded_top_k(spark):
    p = plan(QUERIES["points_page"](spark, SF))
    assert "TakeOrderedAndProject" in p and "Arguments: 600" in p


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_cartesian_or_unpartitioned_window(spark, key):
    p = plan(QUERIES[key](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "Window" not in p  # no window at all, so never one over a single partition


@pytest.mark.parametrize("key", ["stream_offsets", "run_ledger", "aggregate_ledger", "due_jobs"])
def test_folds_never_sort_all_events(spark, key):
    p = plan(QUERIES[key](spark, SF))
    assert "SortAggregate" not in p and "HashAggregate" in p


def test_map_queries_read_the_stored_rollups(spark):
    for key in ("grid_serving", "density_classes"):
        p = plan(QUERIES[key](spark, SF))
        assert "Generate" not in p, key
    assert "PartitionFilters: [isnotnull(zoom_level" in plan(QUERIES["grid_serving"](spark, SF))


def test_hot_cell_still_pre_aggregated(spark):
    # one cell holds a third of all rows: the partial aggregate collapses it per task
    c = X.complaints_table(spark, SF)
    hot = c.withColumn("latitude", F.when(F.col("unique_key").cast("long") % 3 == 0, F.lit(40.7)).otherwise(F.col("latitude")))
    out = R.grid_rollups(hot).where("zoom_level = 14").orderBy(F.desc("complaint_count")).first()
    assert out.complaint_count > 0
    assert "partial_count(1)" in plan(R.grid_rollups(hot))
