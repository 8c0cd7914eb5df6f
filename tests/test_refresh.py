"""Refreshed rollups against full rebuilds, and publishers that run at the same time."""

import datetime as dt
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from gridpulse import schema as S
from gridpulse.operators import rollups as R
from gridpulse.operators.ledger import RunLog
from gridpulse.operators.upsert import ChangeLogTable, current_records
from gridpulse.plans import jobs as J
from gridpulse.plans import refresh as U
from gridpulse.plans import serving as V
from gridpulse.plans.serving import RollupUnavailable
from gridpulse.sources import fixtures as X
from gridpulse.sources.store import VersionedStore, claim_sequence, create_exclusively
from helpers import complaint, complaints_df

SF = "/root/testdata/sf0.001"
AS_OF = dt.datetime(2024, 1, 31)


def _setup(spark, root):
    table, log = ChangeLogTable(spark, f"{root}/table"), RunLog(spark, f"{root}/runs")
    return table, *J.rollup_stores(spark, f"{root}/rollups"), log


def _equal(a, b):
    assert a.columns == b.columns
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _check(table, grid, times):
    now = current_records(table.current_view())
    _equal(grid.read().select(S.GRID_ROLLUP_SCHEMA.fieldNames()), R.grid_rollups(now, refreshed_at=AS_OF))
    _equal(times.read().select(S.TIME_ROLLUP_SCHEMA.fieldNames()), R.time_rollups(now, refreshed_at=AS_OF))


def _batch(spark, rng, n, keys):
    """Late rows, moved keys, rows that stop being noise, rows without a place or a date."""
    rows = []
    for i in range(n):
        created = dt.datetime(2024, 1, rng.randint(1, 28), rng.randint(0, 23))
        rows.append(complaint(
            rng.randrange(keys), lat=rng.choice([None, 40.7127837, rng.uniform(40.70, 40.73)]), lon=rng.choice([-73.9, rng.uniform(-73.95, -73.9)]),
            borough=rng.choice([None, "QUEENS", "BRONX"]), ctype=rng.choice(["Noise - Residential", "noise", "Illegal Parking"]),
            created=rng.choice([None, created, created, created]), msg_offset=i,
        ))
    df = complaints_df(spark, rows)
    offsets = {(r["unique_key"], i): i for i, r in enumerate(rows)}
    numbered = spark.createDataFrame([(*[r[c] for c in S.COMPLAINT_SCHEMA.fieldNames()], i) for i, r in enumerate(rows)], df.schema.add("msg_offset", "long"))
    assert len(offsets) == n
    return numbered.drop("ingested_at")


@pytest.mark.parametrize("broadcast_key_bytes", [256 << 20, 0])
def test_random_batches_equal_full_rebuilds(spark, scratch, monkeypatch, broadcast_key_bytes):
    monkeypatch.setattr(U.changed_rows, "__defaults__", ("unique_key", broadcast_key_bytes))
    rng = random.Random(broadcast_key_bytes)
    table, grid, times, log = _setup(spark, scratch("refresh-random"))
    for k in range(4):
        table.append_batch(_batch(spark, rng, rng.choice([3, 60]), 25), k, ingested_at=AS_OF, writer=rng.choice(["a", "b"]))
        if k == 2:
            table.compact()  # the base then holds batches that the rollups don't reflect yet
        assert U.refresh_rollups(table, grid, times, log, AS_OF) == k + 1
        _check(table, grid, times)
    assert U.refresh_rollups(table, grid, times, log, AS_OF) == 4  # nothing new: nothing published
    assert log.ledger(with_rows=False).first().last_status == "success"


def test_only_groups_that_lost_an_end_read_the_view(spark, scratch, monkeypatch):
    table, grid, times, log = _setup(spark, scratch("refresh-ends"))
    day = [dt.datetime(2024, 1, d) for d in range(10)[1:]]
    first = [complaint(1, created=day[0]), complaint(2, created=day[3]), complaint(3, created=day[6])]
    table.append_batch(complaints_df(spark, first).drop("ingested_at"), 0)
    U.refresh_rollups(table, grid, times, log, AS_OF)
    seen = []
    anew = U.with_dates_anew
    monkeypatch.setattr(U, "with_dates_anew", lambda state, rows: seen.append(state.where("lost").count()) or anew(state, rows))
    table.append_batch(complaints_df(spark, [complaint(2, created=day[4])]).drop("ingested_at"), 1)  # the middle moves
    U.refresh_rollups(table, grid, times, log, AS_OF)
    table.append_batch(complaints_df(spark, [complaint(3, created=day[7])]).drop("ingested_at"), 2)  # the end moves on
    U.refresh_rollups(table, grid, times, log, AS_OF)
    assert seen == []
    table.append_batch(complaints_df(spark, [complaint(1, created=day[5])]).drop("ingested_at"), 3)  # the first row leaves
    U.refresh_rollups(table, grid, times, log, AS_OF)
    assert seen == [3]  # one group on each of three levels
    _check(table, grid, times)
    assert grid.read().select("earliest_created_date").distinct().collect()[0][0] == day[4]


def test_refresh_after_a_plain_rebuild_starts_whole(spark, scratch):
    table, grid, times, log = _setup(spark, scratch("refresh-plain"))
    table.append_batch(complaints_df(spark, [complaint(1), complaint(2, lat=40.9)]).drop("ingested_at"), 0)
    J.rebuild_rollups(current_records(table.current_view()), grid, times, log, AS_OF)
    assert U.refresh_rollups(table, grid, times, log, AS_OF) == 2
    _check(table, grid, times)


def test_rebuild_scans_the_complaints_once(spark, scratch):
    complaints = X.complaints_table(spark, SF)
    state = R.rollup_state(complaints)
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1
    table, grid, times, log = _setup(spark, scratch("one-scan"))
    J.rebuild_rollups(complaints, grid, times, log, AS_OF)
    _equal(grid.read().select(S.GRID_ROLLUP_SCHEMA.fieldNames()), R.grid_rollups(complaints, refreshed_at=AS_OF))
    _equal(times.read().select(S.TIME_ROLLUP_SCHEMA.fieldNames()), R.time_rollups(complaints, refreshed_at=AS_OF))


# --- publishers at the same time -------------------------------------------------


def test_a_number_is_claimed_once(spark, scratch):
    root = scratch("claims")
    got = []
    threads = [threading.Thread(target=lambda: got.append(VersionedStore(spark, root).claim_version())) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    assert not create_exclusively(spark, f"{root}/_claims/v=3")


def test_commit_sequences_are_unique_and_ascend(spark, scratch):
    folder = scratch("sequence")
    assert claim_sequence(spark, folder, 10) == 10
    assert [claim_sequence(spark, folder, 5) for _ in range(3)] == [11, 12, 13]
    got = []
    threads = [threading.Thread(target=lambda: got.append(claim_sequence(spark, folder, 100))) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(set(got)) == 6 and min(got) == 100
    assert claim_sequence(spark, folder, 0) == max(got) + 1
    assert len([f for f in os.listdir(folder.removeprefix("file:")) if not f.startswith(".")]) <= 6  # older claims go


def test_interleaved_rebuilds_leave_a_whole_version_each(spark, scratch):
    table, grid, times, log = _setup(spark, scratch("two-rebuilds"))
    few = complaints_df(spark, [complaint(i) for i in range(5)])
    many = complaints_df(spark, [complaint(i, borough="BRONX") for i in range(70)])
    inner = []

    def meanwhile(version):
        """Another job rebuilds and publishes while the first has written but not published."""
        inner.append(J.rebuild_rollups(many, grid, times, log, AS_OF))

    outer = J.publish_rollups(R.rollup_state(few), grid, times, AS_OF, before_pointer=meanwhile)
    assert (outer, inner) == (1, [2])
    for version, n, borough in ((1, 5, "QUEENS"), (2, 70, "BRONX")):
        cells, buckets = grid.read(version), times.read(version)
        assert {(r.borough, r.n) for r in cells.groupBy("zoom_level", "borough").agg(F.sum("complaint_count").alias("n")).collect()} == {(borough, n)}
        assert {(r.borough, r.n) for r in buckets.groupBy("bucket_type", "borough").agg(F.sum("complaint_count").alias("n")).collect()} == {(borough, n)}
    assert grid.latest()[0] == times.latest()[0] == 2  # the later claim stays the newest


def test_interleaved_compactions_lose_no_batch(spark, scratch):
    table = ChangeLogTable(spark, scratch("two-compactions"))
    other = ChangeLogTable(spark, table.root)
    table.append_batch(complaints_df(spark, [complaint(1), complaint(2)]).drop("ingested_at"), 0)
    write = table.base.write_version

    def slow(df, version, *a):
        write(df, version, *a)
        other.append_batch(complaints_df(spark, [complaint(2, borough="BRONX"), complaint(3)]).drop("ingested_at"), 1)
        assert other.compact() == 2  # committed and folded meanwhile, published first

    table.base.write_version = slow
    assert table.compact() == 1
    got = {r.unique_key: r.borough for r in other.current_view().collect()}
    assert got == {"1": "QUEENS", "2": "BRONX", "3": "QUEENS"} and other.base.latest()[0] == 2
    other.append_batch(complaints_df(spark, [complaint(1, borough="BRONX")]).drop("ingested_at"), 2)
    other.compact()
    assert {r.unique_key: r.borough for r in table.current_view().collect()} == {"1": "BRONX", "2": "BRONX", "3": "QUEENS"}


# --- damaged versions ------------------------------------------------------------


def _data_files(path):
    local = path.removeprefix("file:")
    return [os.path.join(d, f) for d, _, names in os.walk(local) for f in names if f.startswith("part-")]


def _damaged(spark, scratch, name, change):
    complaints = X.complaints_table(spark, SF)
    _, grid, times, log = _setup(spark, scratch(name))
    J.rebuild_rollups(complaints, grid, times, log, AS_OF)
    q = V.GridQuery(zoom_level=12)
    stored = V.grid_summary(grid.resolver(), complaints, q)
    assert stored.select("zoom_level").distinct().collect()[0][0] == 12
    for f in _data_files(grid.version_path(1)):
        os.chmod(f, 0o644)
        change(f)
    return complaints, grid, q


def test_a_truncated_file_is_answered_live(spark, scratch):
    def cut(path):
        with open(path, "rb+") as file:
            file.truncate(os.path.getsize(path) // 2)

    complaints, grid, q = _damaged(spark, scratch, "truncated", cut)
    with pytest.raises(RollupUnavailable):
        grid.read()
    _equal(V.grid_summary(grid.resolver(), complaints, q), V.grid_live(complaints, q))


def test_an_error_while_a_version_runs_is_answered_live(spark, scratch):
    def spoil(path):  # of the right size, but no parquet any more
        size = os.path.getsize(path)
        with open(path, "wb") as file:
            file.write(b"x" * size)

    complaints, grid, q = _damaged(spark, scratch, "spoilt", spoil)
    good = spark.createDataFrame([], S.GRID_ROLLUP_SCHEMA)
    unchecked = spark.read.schema(good.schema).parquet(grid.version_path(1))  # analyses, but fails when it runs
    _equal(V.grid_summary(lambda: unchecked, complaints, q), V.grid_live(complaints, q))
    with pytest.raises(ValueError):
        V.grid_summary(grid.resolver(), complaints, V.GridQuery(zoom_level=99))
