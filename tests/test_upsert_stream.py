import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridpulse import queries
from gridpulse import schema as S
from gridpulse.operators import ingest as I
from gridpulse.operators import upsert
from gridpulse.operators.upsert import ChangeLogTable, current_records, latest_by_key
from gridpulse.sources import fixtures as X
from gridpulse.streaming import ingest as STR
from helpers import complaint, complaints_df, message, messages_df

SF = "/root/testdata/sf0.001"


def _drain(spark, root, sink, checkpoint="ckpt"):
    files = STR.read_envelope_files(spark, f"{root}/landing/range-*/*.json")
    STR.start_ingest(files, sink, f"{root}/{checkpoint}").awaitTermination()


def _replay(spark, msgs, root, sink, ranges=3):
    for k, envelopes in enumerate(X.offset_ranges(X.to_envelopes(msgs), ranges)):
        X.land_range(envelopes, f"{root}/landing", k)
        _drain(spark, root, sink)


def _valid(spark, rows):
    norm = I.normalize_stream(messages_df(spark, rows), keep=("msg_offset", "partition_id", "msg_ts"))
    return I.valid_rows(norm)


def test_last_write_wins_and_null_overwrites(spark):
    rows = [message(key="k", lat="40.1"), message(key="k", lat="40.2"), message(key="k", lat="")]
    changes = _valid(spark, rows).withColumn("batch_id", F.lit(0).cast("long"))
    out = latest_by_key(changes).collect()
    assert len(out) == 1 and out[0].latitude is None  # the newest change had no latitude


def test_change_log_batches_replay_and_compaction(spark, scratch):
    table = ChangeLogTable(spark, scratch("upsert"))
    b0 = _valid(spark, [message(key="a", lat="40.1"), message(key="b", lat="40.2")])
    b1 = _valid(spark, [message(key="a", lat="40.3")])
    table.append_batch(b0, 0)
    table.append_batch(b1, 1)
    view = {r.unique_key: r.latitude for r in table.current_view().collect()}
    assert view == {"a": 40.3, "b": 40.2}
    assert not table.append_batch(b1, 1)  # a committed batch is not written again
    assert {r.unique_key: r.latitude for r in table.current_view().collect()} == view
    table.compact()
    table.append_batch(_valid(spark, [message(key="b", lat="40.9")]), 2)
    assert {r.unique_key: r.latitude for r in table.current_view().collect()} == {"a": 40.3, "b": 40.9}
    # changes = compacted base (2 keys) + only the batch that it has not folded
    assert table.changes().count() == 3


def test_streaming_equals_batch_upsert(spark, scratch):
    root = scratch("replay")
    msgs = X.messages_from_events(X.read_events(spark, SF))
    table = ChangeLogTable(spark, f"{root}/table")
    sink = STR.StreamIngest(table)
    _replay(spark, msgs, root, sink)
    streamed = current_records(table.current_view())
    valid = I.valid_rows(I.normalize_stream(msgs, keep=("msg_offset", "partition_id", "msg_ts")))
    batch = latest_by_key(valid.withColumn("batch_id", F.lit(0).cast("long")), value_cols=S.RECORD_COLUMNS[1:])
    batch = batch.select(*S.RECORD_COLUMNS)
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
    assert table.log().select("batch_id").distinct().count() == 3
    # rejects and offsets side outputs
    n_rejects = I.raw_rejects(msgs).count()
    assert sink.rejects().count() == n_rejects
    offs = sink.offsets().collect()
    assert len(offs) == 3 and all(r.consumer_name == S.CONSUMER_NAME for r in offs)
    # a second run over the same checkpoint processes nothing new
    _drain(spark, root, sink)
    assert table.log().select("batch_id").distinct().count() == 3


def test_offsets_skip_malformed(spark):
    rows = [message(key=str(i)) for i in range(6)] + [message(key="6", lat="abc")]
    valid = _valid(spark, rows)
    out = STR.partition_progress(valid, updated_at=dt.datetime(2024, 1, 31)).collect()
    assert [(r.partition_id, r.last_offset) for r in out] == [(0, 5)]


def test_csv_producer_stream(spark, scratch):
    from gridpulse.sources import connectors as C
    from gridpulse.streaming import producer as PUB

    root = scratch("producer")
    rows = [message(key="1", ctype=" Noise - X "), message(key="2", lat=""), message(key="3", ctype="Parking"),
            message(key="4", created="")]
    C.write_csv(messages_df(spark, rows, meta=False).select(*S.BUSINESS_COLUMNS), f"{root}/snap")
    pub = PUB.FilePublisher(f"{root}/topic")
    PUB.start_file_publisher(PUB.read_csv_stream(spark, f"{root}/snap"), pub, f"{root}/ckpt").awaitTermination()
    values = sorted(r.value for r in pub.published(spark).collect())
    assert len(values) == 2
    assert '"complaint_type":"Noise - X"' in values[0] and '"closed_date":""' in values[0]
    assert '"unique_key":"4","created_date":""' in values[1] and values[1].endswith('"source":"csv"}')


def test_merge_latest_broadcast_and_fallback_agree(spark, scratch):
    import contextlib
    import io

    from gridpulse.operators.upsert import merge_latest

    table = ChangeLogTable(spark, scratch("merge"))
    table.append_batch(_valid(spark, [message(key=str(i), lat=f"40.{i}") for i in range(1, 9)]), 0)
    table.compact()
    table.append_batch(_valid(spark, [message(key="3", lat=""), message(key="42", lat="40.42")]), 1)
    fast = {r.unique_key: r.latitude for r in table.current_view().collect()}
    slow = {r.unique_key: r.latitude for r in table.current_view(broadcast_key_bytes=0).collect()}
    assert fast == slow and fast["3"] is None and fast["42"] == 40.42 and len(fast) == 9
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        table.current_view().explain()
    plan = buf.getvalue()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan


def test_uncommitted_batch_is_invisible(spark, scratch):
    table = ChangeLogTable(spark, scratch("commit"))
    table.append_batch(_valid(spark, [message(key="a", lat="40.1")]), 0)
    table.append_batch(_valid(spark, [message(key="a", lat="40.2")]), 1, commit=False)  # crashed before its marker
    assert {r.unique_key: r.latitude for r in table.current_view().collect()} == {"a": 40.1}
    table.commit_batch(1)
    assert {r.unique_key: r.latitude for r in table.current_view().collect()} == {"a": 40.2}


def test_compaction_lays_out_base_by_date(spark, scratch):
    from gridpulse.operators.upsert import ChangeLogTable as T

    table = T(spark, scratch("layout"))
    valid = I.valid_rows(I.normalize_stream(X.messages_table(spark, SF), keep=("msg_offset", "partition_id", "msg_ts")))
    table.append_batch(valid, 0)
    before = {r.unique_key: r for r in table.current_view().collect()}
    # tiny data: keep AQE from coalescing the range partitions into one file,
    # so the layout is observable
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table.compact()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    base = table.base.read()
    assert {r.unique_key: r for r in base.collect()} == before
    spans = (
        base.where("created_date IS NOT NULL")
        .groupBy(F.input_file_name().alias("f"))
        .agg(F.min("created_date").alias("lo"), F.max("created_date").alias("hi"))
        .orderBy("lo")
        .collect()
    )
    assert len(spans) > 1
    assert all(a.hi <= b.lo for a, b in zip(spans, spans[1:]))  # files hold disjoint date ranges


def test_replay_with_tiny_ranges_keeps_arrival_order(spark, scratch):
    root = scratch("tiny-replay")
    msgs = messages_df(spark, [message(key="k", lat=f"40.{i}") for i in range(1, 7)])
    table = ChangeLogTable(spark, f"{root}/table")
    _replay(spark, msgs, root, STR.StreamIngest(table))
    assert [(r.unique_key, r.latitude) for r in table.current_view().collect()] == [("k", 40.6)]
    assert table.log().select("batch_id").distinct().count() == 3


def test_two_writers_lose_nothing(spark, scratch):
    """Stream, sync, compaction, further stream batches; equal ids of two writers; a late commit of a low id."""
    table = ChangeLogTable(spark, scratch("writers"))
    table.append_batch(_valid(spark, [message(key="a")]), 0, writer="stream")
    table.append_batch(_valid(spark, [message(key="b")]), 1000, writer="sync")
    table.append_batch(_valid(spark, [message(key="e")]), 0, writer="sync")
    table.compact()
    table.append_batch(_valid(spark, [message(key="c")]), 1, writer="stream")
    assert sorted(r.unique_key for r in table.current_view().collect()) == ["a", "b", "c", "e"]
    table.compact()
    table.append_batch(_valid(spark, [message(key="c", lat="41.0"), message(key="d")]), 2, writer="stream")
    for bound in (0, 1 << 28):
        view = {r.unique_key: r.latitude for r in table.current_view(bound).collect()}
        assert sorted(view) == ["a", "b", "c", "d", "e"] and view["c"] == 41.0
    assert sorted(r.unique_key for r in table.changes().collect()) == ["a", "b", "c", "c", "d", "e"]


def test_restarted_checkpoint_loses_nothing(spark, scratch):
    root = scratch("restart")
    table = ChangeLogTable(spark, f"{root}/table")
    sink = STR.StreamIngest(table)
    first = messages_df(spark, [message(key=k) for k in "ab"])
    X.land_range(X.to_envelopes(first), f"{root}/landing", 0)
    _drain(spark, root, sink)
    table.compact()
    later = messages_df(spark, [message(key="c")]).withColumn("msg_offset", F.lit(9).cast("long"))
    X.land_range(X.to_envelopes(later), f"{root}/landing", 1)
    _drain(spark, root, sink, checkpoint="new-ckpt")  # ids count from 0 again
    assert sorted(r.unique_key for r in table.current_view().collect()) == ["a", "b", "c"]
    assert table.commits().select("writer").distinct().count() == 2


def test_retry_of_a_committed_batch_keeps_what_readers_see(spark, scratch):
    table = ChangeLogTable(spark, scratch("retry"))
    table.append_batch(_valid(spark, [message(key="a", lat="40.1")]), 0)
    assert not table.append_batch(_valid(spark, [message(key="a", lat="49.9")]), 0)
    table.commit_batch(0)
    assert [(r.unique_key, r.latitude) for r in table.current_view().collect()] == [("a", 40.1)]


def test_later_offset_wins_over_a_later_message_time(spark):
    """Decided order: within a partition the order of arrival, as the reference has it."""
    t = dt.datetime(2024, 1, 5)
    rows = [message(key="k", lat="40.1", msg_ts=t + dt.timedelta(hours=1)), message(key="k", lat="40.2", msg_ts=t)]
    out = latest_by_key(_valid(spark, rows).withColumn("batch_id", F.lit(0).cast("long"))).first()
    assert out.latitude == 40.2


def test_offsets_without_commits_have_the_progress_columns(spark, scratch):
    sink = STR.StreamIngest(ChangeLogTable(spark, scratch("none")))
    assert sink.offsets().columns == [
        "consumer_name", "topic_name", "partition_id", "last_offset", "last_created_date", "last_message_at", "updated_at",
    ]
    assert sink.offsets().count() == 0


# --- a base in buckets of the key ----------------------------------------------


def _keyed(spark, keys, **extra):
    return complaints_df(spark, [complaint(k, **extra) for k in keys]).drop("ingested_at")


def test_bucketed_base_meets_the_tail_without_a_shuffle_of_its_own(spark, scratch):
    table = ChangeLogTable(spark, scratch("bucketed"), key_buckets=6)
    table.append_batch(_keyed(spark, range(200)), 0)
    assert table.compact() == 1
    table.append_batch(_keyed(spark, range(150, 260), borough=None), 1)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = table.current_view()._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    join = plan.index("SortMergeJoin")
    left, right = plan[join:].split("Exchange hashpartitioning(unique_key", 1)  # the base comes first, the tail is dealt to its buckets
    assert "Exchange" not in left and "Bucketed: true" in left and "SelectedBucketsCount: 6 out of 6" in left
    assert right.startswith("#") and ", 6)" in right.splitlines()[0]
    rows = {r.unique_key: r.borough for r in table.current_view().collect()}
    assert rows == {str(k): None if k >= 150 else "QUEENS" for k in range(260)}


def test_bucketed_base_equals_the_date_layout_over_batches(spark, scratch):
    by_key, by_date = ChangeLogTable(spark, scratch("by-key"), key_buckets=3), ChangeLogTable(spark, scratch("by-date"))
    for k in range(4):
        batch = _keyed(spark, range(10 * k, 10 * k + 25), ctype=f"Noise {k}")
        for table in (by_key, by_date):
            table.append_batch(batch, k)
            if k % 2:
                table.compact()
    got, want = (sorted(map(str, current_records(t.current_view()).collect())) for t in (by_key, by_date))
    assert got == want
    files = by_key.base.read().inputFiles()
    assert len(files) <= 3
    # another session knows nothing of the table and registers it from its files
    spark.sql(f"DROP TABLE {by_key.base._table(by_key.base.latest()[0])}")
    assert ChangeLogTable(spark, by_key.root, key_buckets=3).current_view().count() == 55


# --- the work of one task ---------------------------------------------------------


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_rows_of_one_batch_stay_in_the_tasks_that_scan_them(spark, scratch, threshold):
    table = ChangeLogTable(spark, scratch("one-batch"))
    table.append_batch(_keyed(spark, range(400)).repartition(4), 0)
    pairs = spark.createDataFrame(table.committed().collect(), upsert._PAIRS_SCHEMA)  # as compact() passes them
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        counts = [r["count"] for r in table.rows_of(pairs).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sum(counts) == 400 and max(counts) < 400


def test_log_and_base_files_hold_few_rows(spark, scratch, monkeypatch):
    monkeypatch.setattr(upsert, "ROWS_PER_FILE", 25)
    table = ChangeLogTable(spark, scratch("few-rows"))
    table.append_batch(_keyed(spark, range(200)).coalesce(1), 0)
    assert len(spark.read.parquet(table.batch_path(0)).inputFiles()) == 8
    table.compact()
    held = table.base.read().groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in held) == 200 and max(r["count"] for r in held) <= 25
    assert {r.unique_key for r in table.current_view().collect()} == {str(k) for k in range(200)}


def test_buckets_of_the_key_grow_with_the_messages(spark, monkeypatch):
    made = []

    class Noted(ChangeLogTable):
        def __init__(self, spark, root, key_buckets=None):
            made.append(key_buckets)
            super().__init__(spark, root, key_buckets)

    monkeypatch.setattr(queries, "ChangeLogTable", Noted)
    monkeypatch.setattr(queries, "ROWS_PER_BUCKET", 100)
    monkeypatch.setattr(queries, "_messages", lambda *_: messages_df(spark, [message(key=str(k)) for k in range(1000)]))
    assert {r.unique_key for r in queries.q_upsert_bucketed(spark, SF).collect()} == {str(k) for k in range(1000)}
    assert made == [10]
    assert queries.key_buckets(3) == queries.KEY_BUCKETS
