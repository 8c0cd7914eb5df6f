import datetime as dt

import pytest

from gridpulse import schema as S
from gridpulse.operators import ledger as L
from gridpulse.plans.serving import RollupUnavailable
from gridpulse.sources.store import VersionedStore

T0 = dt.datetime(2024, 1, 1)


def _events(spark, rows):
    return spark.createDataFrame(
        [(j, s, T0 + dt.timedelta(hours=s), st, e, r) for j, s, st, e, r in rows], S.RUN_EVENT_SCHEMA
    )


def test_success_then_running_then_failed(spark):
    ev = _events(spark, [("j", 1, "running", None, None), ("j", 2, "success", None, 10),
                         ("j", 3, "running", None, None), ("j", 4, "failed", "boom", 0)])
    r = L.fold_runs(ev).first()
    assert r.last_successful_at == T0 + dt.timedelta(hours=2)
    assert (r.last_status, r.last_error, r.rows_processed) == ("failed", "boom", 0)
    assert r.last_started_at == T0 + dt.timedelta(hours=3) and r.last_finished_at == T0 + dt.timedelta(hours=4)


def test_running_clears_error_and_keeps_rows(spark):
    ev = _events(spark, [("j", 1, "running", None, None), ("j", 2, "failed", "boom", 5), ("j", 3, "running", None, None)])
    r = L.fold_runs(ev).first()
    assert (r.last_status, r.last_error, r.rows_processed) == ("running", None, 5)


def test_finish_without_start_is_ignored(spark):
    ev = _events(spark, [("a", 1, "success", None, 3), ("b", 2, "success", None, 3), ("b", 3, "running", None, None)])
    rows = {r.job_name: r for r in L.fold_runs(ev).collect()}
    assert set(rows) == {"b"}
    assert rows["b"].last_successful_at is None and rows["b"].rows_processed == 0


def test_interval_gate(spark):
    as_of = T0 + dt.timedelta(days=10)
    ev = _events(spark, [("old", 1, "running", None, None), ("never", 2, "running", None, None)])
    ev = ev.unionByName(spark.createDataFrame([("old", 3, as_of - dt.timedelta(days=5), "success", None, 1),
                                               ("new", 4, as_of - dt.timedelta(days=1), "running", None, None),
                                               ("new", 5, as_of - dt.timedelta(days=1), "success", None, 1)],
                                              S.RUN_EVENT_SCHEMA))
    due = sorted(r.job_name for r in L.due_jobs(L.fold_runs(ev), as_of, 5).collect())
    assert due == ["never", "old"]  # exactly N days ago is due; never succeeded is due
    assert L.should_run(None, as_of) and not L.should_run(as_of, as_of)


def test_run_log_wraps_a_job(spark, scratch):
    log = L.RunLog(spark, scratch("runs"))
    clock = iter([T0 + dt.timedelta(minutes=i) for i in range(10)])
    assert log.run("rebuild", lambda: 42, clock=lambda: next(clock)) == 42
    with pytest.raises(RuntimeError):
        log.run("rebuild", lambda: (_ for _ in ()).throw(RuntimeError("x" * 2000)), clock=lambda: next(clock))
    r = log.ledger().first()
    assert r.last_status == "failed" and len(r.last_error) == 1000 and r.last_successful_at == T0 + dt.timedelta(minutes=1)


def test_version_without_a_column_is_unavailable(spark, scratch):
    store = VersionedStore(spark, scratch("schema"), S.GRID_ROLLUP_SCHEMA)
    store.publish(spark.createDataFrame([(10, 0.02, "QUEENS")], "zoom_level int, grid_size_degrees double, borough string"))
    with pytest.raises(RollupUnavailable, match="complaint_count"):
        store.read()


def test_half_written_version_is_not_read(spark, scratch):
    store = VersionedStore(spark, scratch("store"))
    with pytest.raises(RollupUnavailable):
        store.read()
    v1 = store.publish(spark.createDataFrame([(1,)], "x int"))
    # a crashed rebuild: version 2 directory written, pointer never appended
    spark.createDataFrame([(2,)], "x int").write.parquet(store.version_path(v1 + 1))
    assert [r.x for r in store.read().collect()] == [1]
    v2 = store.publish(spark.createDataFrame([(3,)], "x int"))  # next attempt overwrites it and publishes
    assert v2 == 2 and [r.x for r in store.read().collect()] == [3]
