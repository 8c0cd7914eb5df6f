"""Sums and centres that no order of the rows changes."""

import math
import operator
import random
from fractions import Fraction
from functools import reduce

import pytest
from pyspark.sql import functions as F

from gridpulse.functions import mean_of, split, sum_parts
from gridpulse.operators import rollups as R
from gridpulse.plans import serving as V
from gridpulse.sources import fixtures as X
from helpers import complaint, complaints_df

SF = "/root/testdata/sf0.001"


def means(spark, groups):
    """{group: mean} by the exact sums."""
    rows = [(g, v) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g int, x double").select("g", "x", *split(F.col("x"), "x"))
    df = df.groupBy("g").agg(*sum_parts("x"), F.count("x").alias("n"))
    return {r.g: r.m for r in df.select("g", mean_of("x", F.col("n")).alias("m")).collect()}


def test_mean_is_the_rounded_exact_mean(spark):
    rng = random.Random(1)
    groups = {
        0: [40.7127837],
        1: [40.7127837] * 3,
        2: [rng.uniform(40.4, 41) for _ in range(997)],
        3: [rng.uniform(-74.3, -73.7) for _ in range(991)],
        4: [rng.uniform(-180, 180) for _ in range(1009)],
        5: [0.0, -0.0, 511.999999999, -511.999999999, 0.1],
        6: [-73.9, None, 73.9, 1e-3],
        7: [math.ldexp(1.5, -16), math.ldexp(-1.25, -14)],
        8: [90.0, -90.0, 1 / 3],
    }
    got = means(spark, groups)
    for g, values in groups.items():
        exact = [Fraction(v) for v in values if v is not None]
        assert got[g] == float(sum(exact) / len(exact)), g


def test_values_that_are_no_coordinates(spark):
    got = means(spark, {0: [math.nan, 40.0], 1: [math.inf, 40.0], 2: [math.inf, -math.inf], 3: [None, None], 4: [1e300, 5.0], 5: [1000.0, 40.5]})
    assert math.isnan(got[0]) and got[1] == math.inf and math.isnan(got[2]) and got[3] is None
    assert got[4] == 5e299 and got[5] == 520.25


def shuffled(complaints, k):
    return complaints.repartition(3 + 2 * k, F.xxhash64("unique_key", F.lit(k))).sortWithinPartitions(F.xxhash64(F.lit(k), "unique_key"))


@pytest.mark.parametrize("cells", [
    R.grid_rollups,
    R.grid_500m,
    lambda c: V.grid_live(c, V.GridQuery()),
    lambda c: R.rollup_state(c),
])
def test_four_orders_give_equal_bits(spark, cells):
    c = X.complaints_from_events(X.read_events(spark, SF))
    key = lambda r: str(r)
    results = [sorted((tuple(x.hex() if isinstance(x, float) else x for x in r) for r in cells(shuffled(c, k)).collect()), key=key) for k in range(4)]
    assert results[0] == results[1] == results[2] == results[3]
    doubles = c.where("latitude IS NOT NULL AND longitude IS NOT NULL").select("latitude").collect()
    plain = {reduce(operator.add, (r[0] for r in random.Random(k).sample(doubles, len(doubles)))) for k in range(20)}
    assert len(plain) > 1  # the fixtures' plain sums do depend on the order


def test_both_rollups_of_one_state_equal_each_alone(spark):
    from gridpulse import schema as S

    c = X.complaints_from_events(X.read_events(spark, SF)).unionByName(
        complaints_df(spark, [complaint(1, lat=None), complaint(2, created=None), complaint(3, lat=None, created=None), complaint(4, borough=None, ctype="NOISE x")])
    )
    state = R.rollup_state(c)
    grid, times = R.grid_of_state(state, S.FIXTURE_AS_OF), R.time_of_state(state, S.FIXTURE_AS_OF)
    for got, want in ((grid, R.grid_rollups(c, refreshed_at=S.FIXTURE_AS_OF)), (times, R.time_rollups(c, refreshed_at=S.FIXTURE_AS_OF))):
        assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and len(state.inputFiles()) > 0


def test_cell_edges_and_counts_of_levels(spark):
    c = X.complaints_from_events(X.read_events(spark, SF))
    placed = c.where("latitude IS NOT NULL AND longitude IS NOT NULL AND complaint_type ILIKE 'Noise%'")
    on_edge = placed.where("abs(latitude * 100 - round(latitude * 100)) < 1e-9").count()
    assert on_edge > 0
    cells = R.grid_rollups(c)
    levels = cells.groupBy("zoom_level").agg(F.sum("complaint_count")).collect()
    assert [r[1] for r in levels] == [placed.count()] * 3
    # a point on an edge is in the cell that IEEE division and floor give, as in Python
    want = {(z, math.floor(r[0] / g) * g) for r in placed.select("latitude").collect() for z, g in ((10, 0.02), (12, 0.01), (14, 0.0045))}
    assert {(r[0], r[1]) for r in cells.select("zoom_level", "lat_bucket").collect()} == want
