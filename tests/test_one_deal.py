import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from panelwright.operators import requests as DY
from panelwright.operators import states as ST
from panelwright.plans import records
from panelwright.plans import requests as PR
from panelwright.sources import panels

TESTDATA = "/root/testdata/sf0.001"
REQUESTS = {"pc": ({"P": 5000, "C": 5000}, 2), "strict": ({"P": 3000, "C": 3000}, 2), "t": ({"T": 4000}, 3)}
SCORE = "struct<score_mean: double, score_min: double, validity_status: string, reason_codes: array<string>>"


@pytest.fixture(scope="module")
def wide(spark):
    rng = random.Random(11)

    def score():
        kind = rng.choice(["valid"] * 9 + ["unknown", "blocked"])
        x = rng.choice([0.3, 0.5, 0.7, 0.9, 0.9, 1.0])
        return (x, x - rng.choice([0.0, 0.05, 0.3]), kind, ["valid_no_blocker"]) if kind == "valid" else (None, None, kind, ["b", "a"])

    price = lambda: float(rng.randrange(50, 150))
    first = datetime.date(2020, 1, 1)
    rows = [(e, first + datetime.timedelta(i), price(), price(), price(), score(), score(), score()) for e in range(5) for i in range(80)]
    schema = f"security_id long, trading_date date, adjusted_close double, adjusted_high double, adjusted_low double, P {SCORE}, C {SCORE}, T {SCORE}"
    return spark.createDataFrame(rows, schema).repartition(3).cache()


def rows_of(df, columns):
    return sorted(map(repr, map(tuple, df.select(*columns).collect())))


def exchanges(df):
    """Shuffles of a query's plan: what is dealt, by type."""
    spark, found = df.sparkSession, []
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        nodes = [df.select("*")._jdf.queryExecution().executedPlan()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Exchange":
            found.append([node.output().apply(i).dataType().simpleString() for i in range(node.output().size())])
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_lines_are_dealt_bare(spark):
    (kinds,) = exchanges(panels.daily_prices(spark.read.parquet(f"{TESTDATA}/lineitem.parquet")))
    assert len(kinds) == 7 and not any(k.startswith("struct") for k in kinds)


def test_streaks_side_by_side_equal_those_of_each_series(spark, wide):
    days = DY.joint_columns(wide, REQUESTS)
    got = ST.wide_streaks(days, {name: f"{name}_state" for name in REQUESTS})
    for name in REQUESTS:
        want = ST.streaks(days.withColumnRenamed(f"{name}_state", "raw_state"), ["security_id"])
        want = rows_of(want, ["security_id", "trading_date", F.col("streak").cast("long")])
        assert rows_of(got, ["security_id", "trading_date", F.col(f"{name}_streak").cast("long")]) == want and len(want) == 400


def test_days_of_requests_equal_those_dealt_by_request(spark, wide):
    names = ["request_id", "security_id", "trading_date", "raw_state", F.col("streak").cast("long"), "confirmed", "confirmation_event"]
    want = rows_of(DY.joint_confirm(DY.joint(wide, REQUESTS)), names)
    assert rows_of(DY.request_days(wide, REQUESTS), names) == want and len(want) == 1200


def test_exits_and_paths_of_requests_equal_joins_with_their_days(spark, wide):
    found = DY.request_intervals(wide, REQUESTS)
    long = None
    for d in "PCT":
        one = wide.select("security_id", "trading_date", F.lit(d).alias("dimension"), f"{d}.*")
        long = one if long is None else long.unionByName(one)
    want = DY.exit_category(found, DY.dimension_states(long, DY.request_table(spark, REQUESTS)))
    got = DY.request_exits(wide, REQUESTS)
    assert rows_of(got, want.columns) == rows_of(want, want.columns)
    assert {r[0].split("_")[0] for r in got.select("exit_category").distinct().collect()} == {"right", "quality", "false"}
    anchors = found.select("request_id", "security_id", "interval_no", F.col("confirmation_date").alias("trading_date"))
    want = DY.path_metrics(anchors, wide.select("security_id", "trading_date", *DY.PRICES))
    got = DY.request_paths(wide, REQUESTS)
    assert rows_of(got, want.columns) == rows_of(want, want.columns) and want.count() > 20


@pytest.mark.parametrize("name", ["dy04_joint_confirmation", "dy08_request_metrics", "dy09_path_metrics", "dy10_response_checks", "ex01_exit_category"])
def test_requests_deal_lines_once_and_days_once(spark, name):
    df = PR.queries()[name](spark, TESTDATA)
    by_day = [kinds for kinds in exchanges(df) if "date" in kinds]
    assert len(by_day) <= 2 and not any("array<string>" in kinds for kinds in by_day)
    assert not re.search("SortMergeJoin|HashJoin", df._jdf.queryExecution().executedPlan().toString())


def test_grid_counts_equal_days_dealt_by_configuration(spark):
    want = records.grid_confirmed(spark, TESTDATA).groupBy("config_id").agg(
        F.count("*").alias("n_rows"), F.count_if("raw_state").alias("n_true"), F.count_if("confirmed").alias("n_confirmed"), F.count_if(F.col("confirmed").isNull()).alias("n_unknown")
    )
    got = records.queries()["gr01_grid_daily_full"](spark, TESTDATA)
    assert rows_of(got, want.columns) == rows_of(want, want.columns) and got.count() == 27
    by_configuration = [re.search(r"hashpartitioning\(security_id#\w+, window", x._jdf.queryExecution().executedPlan().toString()) for x in (got, want)]
    assert by_configuration[1] and not by_configuration[0] and sum("date" in kinds for kinds in exchanges(got)) == 2
