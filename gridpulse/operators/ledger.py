"""Run ledgers as a fold over append-only run events.

The reference keeps one mutable row per job: "mark started" upserts it
(status running, error cleared), "mark finished" updates it (finished time,
status, error; last success only moves on success; sync rows also get
rows_processed). A finish for a job that was never started updates no row.

Here a job only appends events ``(job_name, run_seq, event_at, status,
error, rows_processed)`` and the ledger is one grouped aggregation in which
every measure is a ``max_by`` / ``min`` (partial aggregation, so a job
with a third of all events costs nothing special).
"""

from __future__ import annotations

import datetime as _dt
import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse import schema as S
from gridpulse.functions import ntz_lit

T = TypeVar("T")

RUNNING, SUCCESS, FAILED = "running", "success", "failed"


# Statuses as numbers, so that the fold keeps fixed-width buffers (hash aggregation, no sort of the events).
_CODES = (RUNNING, SUCCESS, FAILED)


def fold_runs(events: DataFrame, with_rows: bool = True) -> DataFrame:
    """One ledger row per job that has ever been started, in job order.

    Only the error text has no fixed width: it is looked up by the sequence of
    each job's last event, for the few jobs of the ledger.
    """
    seq, at, status = F.col("run_seq"), F.col("event_at"), F.col("status")
    code = F.array_position(F.array(*[F.lit(s) for s in _CODES]), status).cast("int")
    started, finished, succeeded = status == RUNNING, status != RUNNING, status == SUCCESS
    fin, ok = F.when(finished, seq), F.when(succeeded, seq)
    agg = events.groupBy("job_name").agg(
        F.min(F.when(started, seq)).alias("first_start"),
        F.max_by(at, F.when(started, seq)).alias("last_started_at"),
        F.max(fin).alias("fin_seq"),
        F.max_by(at, fin).alias("fin_at"),
        F.max_by(F.col("rows_processed"), fin).alias("fin_rows"),
        F.max(ok).alias("ok_seq"),
        F.max_by(at, ok).alias("ok_at"),
        F.max(seq).alias("last_seq"),
        F.max_by(at, seq).alias("last_at"),
        F.max_by(code, seq).alias("last_code"),
    )
    agg = agg.where(F.col("first_start").isNotNull())
    texts = events.where(F.col("error").isNotNull()).select(F.col("job_name").alias("of"), seq.alias("of_seq"), "error")
    last = agg.join(texts, (F.col("job_name") == F.col("of")) & (F.col("last_seq") == F.col("of_seq")), "left")
    after_start = lambda s: F.col(f"{s}_seq") > F.col("first_start")
    cols = [
        "job_name",
        "last_started_at",
        F.when(after_start("fin"), F.col("fin_at")).alias("last_finished_at"),
        F.when(after_start("ok"), F.col("ok_at")).alias("last_successful_at"),
        F.element_at(F.array(*[F.lit(s) for s in _CODES]), F.col("last_code")).alias("last_status"),
        F.col("error").alias("last_error"),
    ]
    if with_rows:
        cols.append(F.coalesce(F.when(after_start("fin"), F.col("fin_rows")), F.lit(0)).cast("int").alias("rows_processed"))
    cols.append(F.col("last_at").alias("updated_at"))
    return last.select(*cols).orderBy("job_name")


def gate_threshold(as_of: _dt.datetime, interval_days: int = S.SYNC_INTERVAL_DAYS) -> _dt.datetime:
    """A job whose last success is not after this is due."""
    return as_of - _dt.timedelta(days=interval_days)


def gate(ledger: DataFrame, as_of: _dt.datetime, interval_days: int = S.SYNC_INTERVAL_DAYS) -> DataFrame:
    """Every job with its gate: due if never succeeded or last success <= as_of - interval."""
    threshold = ntz_lit(gate_threshold(as_of, interval_days))
    last = F.col("last_successful_at")
    return ledger.select("job_name", "last_successful_at", (last.isNull() | (last <= threshold)).alias("due"))


def due_jobs(ledger: DataFrame, as_of: _dt.datetime, interval_days: int = S.SYNC_INTERVAL_DAYS) -> DataFrame:
    """Only the jobs that should run now."""
    return gate(ledger, as_of, interval_days).where(F.col("due")).drop("due")


def should_run(last_successful_at: _dt.datetime | None, as_of: _dt.datetime, interval_days: int = S.SYNC_INTERVAL_DAYS) -> bool:
    """The gate for a single job's last success."""
    return last_successful_at is None or last_successful_at <= gate_threshold(as_of, interval_days)


class RunLog:
    """Append-only run events in a parquet folder; one tiny file per event.

    Events get a sequence from the wall clock in nanoseconds, kept strictly
    increasing within the process; the fold orders by it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self._seq = 0

    def _next_seq(self) -> int:
        self._seq = max(self._seq + 1, time.time_ns())
        return self._seq

    def record(
        self,
        job_name: str,
        status: str,
        at: _dt.datetime,
        error: str | None = None,
        rows_processed: int | None = None,
        run_seq: int | None = None,
    ) -> None:
        if status not in (RUNNING, SUCCESS, FAILED):
            raise ValueError(f"status must be running, success or failed; got {status!r}")
        error = None if error is None else error[: S.ERROR_TEXT_MAX]
        seq = self._next_seq() if run_seq is None else int(run_seq)
        values = (F.lit(job_name), F.lit(seq), ntz_lit(at), F.lit(status), F.lit(error), F.lit(rows_processed))
        row = self.spark.range(1, numPartitions=1).select(*[v.cast(f.dataType).alias(f.name) for v, f in zip(values, S.RUN_EVENT_SCHEMA, strict=True)])
        row.write.mode("append").parquet(self.path)

    def events(self) -> DataFrame:
        try:
            return self.spark.read.schema(S.RUN_EVENT_SCHEMA).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], S.RUN_EVENT_SCHEMA)

    def ledger(self, with_rows: bool = True) -> DataFrame:
        return fold_runs(self.events(), with_rows=with_rows)

    def run(
        self,
        job_name: str,
        body: Callable[[], int | None],
        clock: Callable[[], _dt.datetime] = lambda: _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None),
    ) -> int | None:
        """Mark started, run ``body``; mark success (with its row count) or
        failed (with the error text cut to 1000 characters) and re-raise."""
        self.record(job_name, RUNNING, clock())
        try:
            rows = body()
        except Exception as exc:
            self.record(job_name, FAILED, clock(), error=str(exc), rows_processed=0)
            raise
        self.record(job_name, SUCCESS, clock(), rows_processed=rows)
        return rows

    def run_for(self, job_name: str, body: Callable[[], T], **options) -> T:
        """``run`` for a body whose result isn't a row count; returns that result."""
        results: list[T] = []
        self.run(job_name, lambda: results.append(body()), **options)
        return results[0]
