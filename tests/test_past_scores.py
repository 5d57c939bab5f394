import random

from pyspark.sql import functions as F

from panelwright.operators import scores
from panelwright.plans import metrics, states

TESTDATA = "/root/testdata/sf0.001"


def test_scores_of_series_that_cross_batches(spark):
    rng = random.Random(4)
    rows = [(e, i, rng.choice([None, float(rng.randrange(4)), rng.random()]), "valid") for e in range(5) for i in range(rng.randrange(1, 60))]
    frame = spark.createDataFrame(rows, "security_id long, trading_date int, v double, s string")
    cell = lambda v: F.struct(v.alias("value"), F.col("s").alias("validity_status"), F.array(F.lit("x")).alias("reason_codes"))
    frame = frame.select("security_id", "trading_date", cell(F.col("v")).alias("a"), cell(-F.col("v")).alias("b"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.security_id, r.trading_date): r for r in scores.past_scores(frame, ["a", "b"], 9).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(rows)
    seen = {}
    for e, i, v, _ in rows:
        for name, x in (("a", v), ("b", None if v is None else -v)):
            r, past = getattr(got[e, i], name), seen.setdefault((e, name), [])
            last = past[-9:]
            if x is None:
                assert (r.reference_count, r.reference_start, r.percentile) == (0, None, None)
                continue
            assert r.reference_count == len(last) and (r.reference_start, r.reference_end) == ((last[0][0], last[-1][0]) if last else (None, None))
            want = (sum(p < x for _, p in last) + sum(p == x for _, p in last) / 2) / 9 if len(last) == 9 else None
            assert r.percentile == want and r.eligible == (want is not None)
            past.append((i, x))


def test_scores_are_dealt_once_and_gather_no_series(spark):
    for rows in (metrics.long_scores(spark, TESTDATA), states.dim_scores(spark, TESTDATA), states.nested(spark, TESTDATA)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") + plan.count("Exchange REPARTITION") <= 1 and "collect_list" not in plan


def test_reasons_are_counted_in_one_pass_without_values(spark):
    from panelwright.operators.statistics import reason_profile
    from panelwright.plans import statistics

    plan = statistics.queries()["as06_reason_profile"](spark, TESTDATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "avg(" not in plan and "regr" not in plan
    rows = spark.createDataFrame([(["a", "b"],), (["a"],), ([],), (None,)], "reason_codes array<string>")
    assert {tuple(r) for r in reason_profile(rows).collect()} == {("a", 2, 0.5, 2 / 3), ("b", 1, 0.25, 1 / 3)}


def test_intervals_side_by_side_equal_those_of_each_series(spark):
    from panelwright.operators import states as ST

    rng = random.Random(7)
    rows = [(e, i, *[rng.choices([True, False, None], [6, 3, 1])[0] for _ in "ab"], rng.choice(["valid", "valid", "blocked"])) for e in range(8) for i in range(rng.randrange(1, 50))]
    frame = spark.createDataFrame(rows, "security_id long, i int, a boolean, b boolean, validity_status string").withColumn("trading_date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("i")))
    series = {"one": ("a", "validity_status", 2), "two": ("b", "validity_status", 3), "three": ("a", "validity_status", 1)}
    wide = ST.wide_intervals(frame, series, "name")
    got = sorted(map(tuple, wide.collect()), key=str)
    want = []
    for name, (state, _, k) in series.items():
        one = frame.withColumn("raw_state", F.col(state)).select("security_id", "trading_date", "raw_state", "validity_status")
        found = ST.intervals(ST.confirm(ST.streaks(one, ["security_id"]), [k], ["security_id"]), ["security_id"]).withColumn("name", F.lit(name))
        want += map(tuple, found.select(*wide.columns).collect())
    assert got == sorted(want, key=str) and len({r[1] for r in got}) == 3
    assert wide._jdf.queryExecution().executedPlan().toString().split("Window")[-1].count("Exchange") == 1


def test_streaks_equal_a_plain_count(spark):
    from panelwright.operators import states as ST

    rng = random.Random(9)
    rows = [(e, i, rng.choices([True, False, None], [6, 3, 1])[0]) for e in range(6) for i in range(rng.randrange(1, 40))]
    got = {(r.security_id, r.trading_date): (r.run, r.streak, r.run_start) for r in ST.streaks(spark.createDataFrame(rows, "security_id long, trading_date int, raw_state boolean"), ["security_id"]).collect()}
    run = length = 0
    for e, i, on in rows:
        if i == 0:
            run = length = 0
        run, length = (run + (length == 0), length + 1) if on else (run, 0)
        assert got[e, i] == ((run, length, i - length + 1) if on else (None, None if on is None else 0, None))
    plan = ST.streaks(spark.createDataFrame(rows, "security_id long, trading_date int, raw_state boolean"), ["security_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1


def test_requests_flags_and_vectors_gather_no_days(spark):
    from panelwright.plans import decisions, records, requests

    for queries, name, most in (
        (requests, "dy03_joint_states", 1), (requests, "dy10_response_checks", 2), (records, "as08_dimension_flags", 1), (records, "as26_common_wide", 1), (decisions, "as32_ablation", 2), (decisions, "as35_denominators", 2),
    ):
        plan = queries.queries()[name](spark, TESTDATA)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") <= most and plan.count("FileScan") == 1 and "collect_list" not in plan, name


def test_extremes_are_kept_by_limits_over_one_table(spark):
    from panelwright.plans import statistics

    out = statistics.queries()["as31_extremes"](spark, TESTDATA)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Window" not in plan and out.count() == 80
