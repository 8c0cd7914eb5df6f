"""Rollups kept up to date from the change log.

A published version of the rollups keeps their mergeable state and the exact set
of (writer, batch) it reflects. A refresh reads only the batches committed since:
their keys' rows as of that set leave the rollups, their rows as of now enter them.
Counts and exact sums add up with a sign. Minimum and maximum dates can't be taken
back, so the few groups that lost the row of their minimum or maximum, and got no
row beyond it, have their dates built anew from the current view.

The result equals a full rebuild, bit for bit: the sums are exact.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse import schema as S
from gridpulse.functions import sum_parts
from gridpulse.operators import rollups as R
from gridpulse.operators.ledger import RunLog
from gridpulse.operators.upsert import (
    BROADCAST_KEY_BYTES,
    ORDER_COLUMNS,
    VIEW_SCHEMA,
    ChangeLogTable,
    change_struct,
    current_records,
    latest_by_key,
)
from gridpulse.plans.jobs import REBUILD_JOB, publish_rollups, rollup_state_store, utc_now
from gridpulse.session import scratch_path
from gridpulse.sources.store import VersionedStore

_BATCH = ("writer", "batch_id")
_BATCHES_SCHEMA = T.StructType([VIEW_SCHEMA["writer"], VIEW_SCHEMA["batch_id"], VIEW_SCHEMA["commit_seq"]])
_VALUES = tuple(c for c in VIEW_SCHEMA.fieldNames() if c != "unique_key")


def _batches_path(state: VersionedStore, version: int) -> str:
    return f"{state.pointer_root}/state_batches/v={version}"


def _reflected(state: VersionedStore) -> tuple[int, DataFrame] | None:
    """The newest published state and the batches it reflects; None before the first refresh."""
    current = state.latest()
    if current is None:
        return None
    try:
        return current[0], state.spark.read.schema(_BATCHES_SCHEMA).parquet(_batches_path(state, current[0]))
    except AnalysisException:  # published by a full rebuild of some frame
        return None


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def changed_rows(table: ChangeLogTable, before: DataFrame, new: DataFrame, key: str = "unique_key", broadcast_key_bytes: int = BROADCAST_KEY_BYTES) -> DataFrame:
    """Rows of the current view that batches ``new`` change, with ``sign``: -1 as of ``before``, +1 as of both.

    Only keys that occur in the new batches are read: their distinct set is
    measured and broadcast under a bound, so the base passes a map-side semi join;
    above it the join shuffles. One aggregate per key gives both its rows.
    """
    tail = table.rows_of(new)
    keys = tail.select(key).distinct()
    n_keys, key_bytes = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(key)), F.lit(0))).first()
    small = key_bytes + 64 * n_keys <= broadcast_key_bytes
    held = table.changes_of(before).join(F.broadcast(keys) if small else keys, key, "left_semi")
    both = held.withColumn("_held", F.lit(True)).unionByName(tail.withColumn("_held", F.lit(False)))
    change = change_struct(both, ORDER_COLUMNS, _VALUES)
    ends = both.groupBy(key).agg(F.max(F.when(F.col("_held"), change)).alias("old"), F.max(change).alias("new"))
    signed = ends.select(
        key, F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("old").alias("row")), F.struct(F.lit(1).alias("sign"), F.col("new").alias("row")))).alias("c")
    ).where("c.row IS NOT NULL")
    return signed.select(key, *[F.col(f"c.row.{c}").alias(c) for c in _VALUES], F.col("c.sign").alias("sign"))


def state_delta(rows: DataFrame) -> DataFrame:
    """Signed rows -> what they add to each group: count, sums, and the dates that enter and leave."""
    sign, date = F.col("sign"), F.col("created_date")
    dates = [f(F.when(sign == s, date)).alias(f"{n}_{e}") for s, n in ((1, "in"), (-1, "out")) for f, e in ((F.min, "least"), (F.max, "greatest"))]
    copies = R.rollup_copies(rows, "sign").groupBy(*R.STATE_KEYS)
    return copies.agg(F.sum(sign).cast("long").alias("complaint_count"), *sum_parts("lat", sign), *sum_parts("lon", sign), *dates)


_DATES = ("in_least", "in_greatest", "out_least", "out_greatest")


def merged_state(state: DataFrame, delta: DataFrame) -> DataFrame:
    """The state after a delta, with ``lost``: its date range has to be built anew. Groups without rows go."""
    kept = ("earliest_created_date", "latest_created_date")
    left = state.withColumns({c: F.lit(None).cast("timestamp_ntz") for c in _DATES})
    right = delta.withColumns({c: F.lit(None).cast("timestamp_ntz") for c in kept})
    sums = [F.sum(c).alias(c) for c in R.STATE_SUMS]
    both = left.unionByName(right).groupBy(*R.STATE_KEYS).agg(*sums, *[F.min(c).alias(c) for c in (*kept, *_DATES)])
    low, high = F.col(kept[0]), F.col(kept[1])

    def lost(gone: Column, come: Column, end: Column, beyond: Callable[[Column, Column], Column]) -> Column:
        """The row at this end left and none that entered lies there or beyond."""
        return F.coalesce((gone == end) & ~F.coalesce(beyond(come, end), F.lit(False)), F.lit(False))

    is_lost = lost(F.col("out_least"), F.col("in_least"), low, lambda a, b: a <= b) | lost(
        F.col("out_greatest"), F.col("in_greatest"), high, lambda a, b: a >= b
    )
    return both.where("complaint_count > 0").select(
        *R.STATE_KEYS, *R.STATE_SUMS, F.least(low, F.col("in_least")).alias(kept[0]),
        F.greatest(high, F.col("in_greatest")).alias(kept[1]), is_lost.alias("lost"),
    )


def with_dates_anew(state: DataFrame, complaints: DataFrame) -> DataFrame:
    """``merged_state`` whose lost date ranges come from the rows of those groups in ``complaints``."""
    lost = state.where("lost").select(*[F.col(k).alias(f"_{k}") for k in R.STATE_KEYS])

    def same(prefix: str) -> Column:
        first, *rest = [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in R.STATE_KEYS]
        for c in rest:
            first = first & c
        return first

    copies = R.rollup_copies(complaints).join(lost, same("_"), "left_semi")
    anew = copies.groupBy(*[F.col(k).alias(f"n_{k}") for k in R.STATE_KEYS]).agg(F.min("created_date").alias("n_low"), F.max("created_date").alias("n_high"))
    out = state.join(anew, same("n_"), "left")
    dates = [F.when(F.col("lost"), F.col(n)).otherwise(F.col(c)).alias(c) for c, n in (("earliest_created_date", "n_low"), ("latest_created_date", "n_high"))]
    return out.select(*R.STATE_KEYS, *R.STATE_SUMS, *dates)


def refresh_rollups(
    table: ChangeLogTable,
    grid_store: VersionedStore,
    time_store: VersionedStore,
    run_log: RunLog,
    as_of: _dt.datetime,
    clock: Callable[[], _dt.datetime] = utc_now,
) -> int:
    """Publish grid and time rollup of the table's committed batches; returns the version.

    The first refresh builds them whole. A later one reads the batches committed
    since, and publishes nothing when there are none. The batches are fixed first and stored
    beside the version, so a batch committed meanwhile waits for the next refresh,
    and of refreshes that run at the same time each publishes a whole version.
    """

    def body() -> int:
        spark, states = table.spark, rollup_state_store(grid_store)
        known = _reflected(states)
        committed = table.committed()
        since = committed if known is None else committed.join(known[1], list(_BATCH), "left_anti")
        found = since.collect()  # one small row for each batch since the last refresh
        if known is not None and not found:
            return known[0]
        new = spark.createDataFrame(found, _BATCHES_SCHEMA)
        now = new if known is None else new.unionByName(known[1])
        if known is None:
            state = R.rollup_state(current_records(_view_of(table, now)))
        else:
            delta = state_delta(changed_rows(table, known[1], new))
            # the delta is read for the merge and again for the groups that lost an end
            state = _written(merged_state(states.read(known[0]), delta), "rollup-state")
            if state.where("lost").take(1):
                state = with_dates_anew(state, current_records(_view_of(table, now)))
            state = state.drop("lost")

        def keep_batches(version: int) -> None:
            now.coalesce(1).write.mode("overwrite").parquet(_batches_path(states, version))

        return publish_rollups(state, grid_store, time_store, as_of, before_pointer=keep_batches)

    return run_log.run_for(REBUILD_JOB, body, clock=clock)


def _view_of(table: ChangeLogTable, batches: DataFrame) -> DataFrame:
    return latest_by_key(table.changes_of(batches), value_cols=_VALUES)
