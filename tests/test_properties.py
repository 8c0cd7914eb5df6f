"""Property tests: Spark expressions against Python's own semantics.

Each example is a whole batch of values checked in ONE Spark job, so a few
examples cover hundreds of inputs without hundreds of jobs.
"""

import datetime as dt
import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridpulse.functions import grid_bucket, iso_timestamp, noise_rule

_TIMES = st.datetimes(min_value=dt.datetime(1990, 1, 1), max_value=dt.datetime(2090, 12, 31))
_OFFSETS = st.integers(min_value=-14 * 60, max_value=14 * 60)
_STYLES = st.sampled_from(["Z", "+hh:mm", "+hhmm", "none", "space", "ms"])


def _render(t: dt.datetime, off: int, style: str) -> str:
    base = t.replace(microsecond=0)
    if style == "space":
        return base.isoformat(sep=" ")
    if style == "ms":
        return base.isoformat(timespec="milliseconds")
    if style == "none":
        return base.isoformat()
    if style == "Z":
        return base.isoformat() + "Z"
    sign = "-" if off < 0 else "+"
    h, m = divmod(abs(off), 60)
    return base.isoformat() + (f"{sign}{h:02d}:{m:02d}" if style == "+hh:mm" else f"{sign}{h:02d}{m:02d}")


def _python_utc(text: str) -> dt.datetime:
    v = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    return v.astimezone(dt.timezone.utc).replace(tzinfo=None) if v.tzinfo else v


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(_TIMES, _OFFSETS, _STYLES), min_size=60, max_size=60))
def test_iso_timestamp_matches_python(spark, samples):
    texts = [_render(t, o, s) for t, o, s in samples]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(iso_timestamp(F.col("s"))).collect()]
    assert got == [_python_utc(x) for x in texts]


_ALPHABET = st.sampled_from(["Noise", "noise", "NOISE", " ", "\t", "\n", "-", "Loud", "x", "N", "oise", ""])


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(_ALPHABET, max_size=5).map("".join), min_size=60, max_size=60))
def test_noise_rules_match_python(spark, texts):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, complaint_type string")
    rules = ["ilike_prefix", "contains_ci", "contains_cs", "like_prefix"]
    rows = df.orderBy("i").select(*[noise_rule(r).alias(r) for r in rules]).collect()
    for text, row in zip(texts, rows):
        assert row.ilike_prefix == text.lower().startswith("noise")
        assert row.contains_ci == ("noise" in text.strip(" ").lower())
        assert row.contains_cs == ("Noise" in text.strip())
        assert row.like_prefix == text.startswith("Noise")


@settings(max_examples=4, deadline=None)
@given(
    st.lists(st.floats(min_value=-180, max_value=180, allow_nan=False), min_size=60, max_size=60),
    st.sampled_from([0.02, 0.01, 0.0045]),
)
def test_grid_bucket_is_ieee_floor(spark, xs, g):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = [r[0] for r in df.orderBy("i").select(grid_bucket("x", g)).collect()]
    assert got == [math.floor(x / g) * g for x in xs]


# --- ledger fold vs. the sequential updates it replaces ------------------------

_EVENT = st.tuples(st.sampled_from(["a", "b", "c"]), st.sampled_from(["running", "success", "failed"]),
                   st.one_of(st.none(), st.text(alphabet="xyz", max_size=3)), st.integers(0, 99))


def _simulate_ledger(events):
    """The reference's row updates, applied in order (at = sequence number)."""
    rows = {}
    for seq, (job, status, error, n) in enumerate(events):
        at = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=seq)
        if status == "running":
            r = rows.setdefault(job, dict(last_started_at=None, last_finished_at=None, last_successful_at=None,
                                          last_status=None, last_error=None, rows_processed=0, updated_at=None))
            r.update(last_started_at=at, last_status="running", last_error=None, updated_at=at)
        elif job in rows:  # a finish for a job never started updates no row
            r = rows[job]
            r.update(last_finished_at=at, last_status=status, last_error=error, rows_processed=n, updated_at=at)
            if status == "success":
                r["last_successful_at"] = at
    return rows


@settings(max_examples=6, deadline=None)
@given(st.lists(_EVENT, min_size=1, max_size=40))
def test_ledger_fold_equals_sequential_updates(spark, events):
    from gridpulse import schema as S
    from gridpulse.operators.ledger import fold_runs

    data = [(job, seq, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=seq), status, error if status != "running" else None,
             None if status == "running" else n) for seq, (job, status, error, n) in enumerate(events)]
    got = {r.job_name: r.asDict() for r in fold_runs(spark.createDataFrame(data, S.RUN_EVENT_SCHEMA)).collect()}
    want = _simulate_ledger([(j, s, e if s != "running" else None, n) for j, s, e, n in events])
    assert set(got) == set(want)
    for job, w in want.items():
        assert {k: got[job][k] for k in w} == w


# --- latest-wins over batches and compactions vs. a dict ------------------------

_CHANGE = st.tuples(st.sampled_from(["k1", "k2", "k3", "k4"]), st.one_of(st.none(), st.integers(0, 99)))
_BATCH = st.lists(_CHANGE, min_size=1, max_size=6)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(_BATCH, st.booleans()), min_size=1, max_size=4))
def test_change_log_equals_dict_replay(spark, batches):
    import uuid

    from gridpulse.operators import ingest as I
    from gridpulse.operators.upsert import ChangeLogTable
    from gridpulse.session import scratch_path
    from helpers import message, messages_df

    table = ChangeLogTable(spark, scratch_path(spark, f"prop-upsert-{uuid.uuid4().hex[:6]}"))
    model = {}
    for batch_id, (changes, compact_after) in enumerate(batches):
        msgs = [message(key=k, lat="" if v is None else f"40.{v:02d}") for k, v in changes]
        norm = I.normalize_stream(messages_df(spark, msgs), keep=("msg_offset", "partition_id", "msg_ts"))
        table.append_batch(I.valid_rows(norm), batch_id)
        for k, v in changes:
            model[k] = None if v is None else float(f"40.{v:02d}")
        if compact_after:
            table.compact()
    fast = {r.unique_key: r.latitude for r in table.current_view().collect()}
    full = {r.unique_key: r.latitude for r in table.current_view(broadcast_key_bytes=0).collect()}
    assert fast == model and full == model
