import random
import re

from pyspark.sql import functions as F

from panelwright.functions.conventions import PANEL, SLIDING, Rolls
from panelwright.operators.sliding import rolls_udf
from panelwright.plans import metrics

TESTDATA = "/root/testdata/sf0.001"


def test_windows_that_cross_batches_equal_spark_frames(spark):
    rng = random.Random(5)
    value = lambda: rng.choice([None, 0.0, float("nan"), float("inf"), *[rng.random() * 10**k for k in range(8)]])
    rows = [(e, i, value()) for e in range(6) for i in range(rng.choice([1, 3, 40]))]
    rows += [(7, i, 0.1) for i in range(30)]  # one value all along: its spread is to be exactly 0
    frame = spark.createDataFrame(rows, "security_id long, trading_date int, v double").withColumn("_place", F.row_number().over(PANEL.order()).cast("long"))
    rolls, asked = Rolls(), [(kind, n, back) for kind in SLIDING for n, back in ((1, 0), (4, 0), (9, 5))]
    for kind, n, back in asked:
        rolls.ask(kind, "v", n, back)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.security_id, r.trading_date): r._rolled for r in frame.withColumn("_rolled", rolls_udf(rolls.asked)("_place", "v")).collect()}
        want = frame.select("security_id", "trading_date", *[PANEL.rolled(kind, "v", n, back).alias(f"{kind}v_{n}_{back}") for kind, n, back in asked]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(want) == len(rows) and not any(r.regr_syyv_4_0 for r in want if r.security_id == 7)
    for r in want:
        for name, x in r.asDict().items():
            if name not in ("security_id", "trading_date"):
                y = got[r.security_id, r.trading_date][name]
                assert repr(x) == repr(y), (name, r.security_id, r.trading_date, x, y)


def test_score_step_has_no_sliding_frame_and_methods_that_are_compiled(spark):
    """Past 8,000 bytes the JVM interprets a generated method, row after row."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for rows in (metrics.wide_metrics(spark, TESTDATA), metrics.wide_scores(spark, TESTDATA), metrics.wide_dims(spark, TESTDATA)):
            plan = rows._jdf.queryExecution().executedPlan()
            code = spark.sparkContext._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan)
            assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000
            assert not re.search(r"RowFrame, -\d+, currentrow\$|avg\(|regr_", plan.toString().replace("_rolled", ""))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_grid_ranks_days_and_averages_dimensions_without_dealing_long_rows(spark):
    from panelwright.plans import grids

    plan = grids.grid(spark, TESTDATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "avg(score" not in plan and "indicator" not in plan
