"""The whole grid in one pass against its days told at length."""

import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.operators import grids as G
from panelwright.operators import layers as L
from panelwright.operators import scores as S
from panelwright.plans import grids
from panelwright.plans.metrics import dimension_rows
from tests.test_one_deal import exchanges

DIMENSIONS, WINDOWS, QS, KS = {"P": ("a", "b"), "C": ("c", "d")}, [2, 4], [0.3, 0.5, 0.7], [1, 2, 3]
NAMES = [n for names in DIMENSIONS.values() for n in names]
ROW = ["security_id", "config_id", "state_name", "interval_no", "raw_start_date", "confirmation_date", "interval_end_date", "last_observed_date", "duration_raw_days", "duration_confirmed_days", "is_open", "termination_reason"]


@pytest.fixture(scope="module")
def metrics(spark):
    rng, first = random.Random(4), datetime.date(2020, 1, 1)

    def metric():
        kind = rng.choice(["valid"] * 30 + ["unknown", "diagnostic_required", "blocked"])
        return (rng.choice([1.0, 2.0, 2.0, 3.0, float("nan") if rng.random() < 0.05 else 4.0]) if kind == "valid" else None, kind, ["x"])

    rows = [(e, first + datetime.timedelta(i), *[metric() for _ in NAMES]) for e, n in enumerate([90, 1, 40, 3, 60, 25]) for i in range(n)]
    metric = "struct<value: double, validity_status: string, reason_codes: array<string>>"
    rows = spark.createDataFrame(rows, "security_id long, trading_date date, " + ", ".join(f"{n} {metric}" for n in NAMES)).repartition(3).cache()
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy("security_id").orderBy("trading_date")))


@pytest.fixture(scope="module")
def told(metrics):
    """The same grid as long rows, series by series."""
    config = L.config_id(F.col("window"), F.col("q"), F.col("k"))
    each = [dimension_rows(S.dimension_columns(S.past_scores(metrics.drop("_place"), NAMES, w), DIMENSIONS)).withColumn("window", F.lit(w)) for w in WINDOWS]
    return L.grid_confirmed(L.grid_states(each[0].unionByName(each[1]), list(DIMENSIONS), QS, [*grids.DAY, "window"]), KS, grids.SERIES).withColumn("config_id", config).cache()



@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_batches_give_the_grid_told_at_length(spark, metrics, told, size):
    grid = G.Grid(WINDOWS, QS, KS, DIMENSIONS)
    want = told.groupBy("config_id", "state_name").agg(
        F.count("*"), F.count_if(F.col("validity_status") == "valid"), F.count_if("raw_state"), F.count_if(F.col("raw_state").isNull()),
        F.count_if("confirmed"), F.count_if(F.col("streak") == F.col("k")), F.count_distinct(F.when(F.col("confirmed"), F.col("security_id"))),
    )
    runs = L.grid_intervals(told, [*grids.SERIES, "config_id"])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        assert sorted(map(tuple, G.grid_counts(metrics, grid).collect())) == sorted(map(tuple, want.collect()))
        got = sorted(map(repr, map(tuple, G.grid_runs(metrics, grid).select(*ROW).collect())))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted(map(repr, map(tuple, runs.select(*ROW).collect()))) and len(got) > 400
    assert {reason for reason in G.REASONS if any(f"'{reason}'" in r for r in got)} == {*G.REASONS} - {""}


def test_lines_are_dealt_once_and_no_day_after_them(spark):
    plans = grids.queries()
    assert len(exchanges(plans["gr03_nested_grid_intervals"](spark, "/root/testdata/sf0.001"))) == 1
    days = exchanges(plans["gr02_nested_grid_days"](spark, "/root/testdata/sf0.001"))
    assert len(days) == 2 and any(k[:2] == ["string", "string"] for k in days)  # lines, and sums of each task


def test_an_empty_panel_has_no_configurations(metrics):
    grid = G.Grid(WINDOWS, QS, KS, DIMENSIONS)
    assert not G.grid_counts(metrics.where("false"), grid).collect() and not G.grid_runs(metrics.where("false"), grid).collect()
