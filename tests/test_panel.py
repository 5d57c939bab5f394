"""Panel operators against hand-written expectations and against SQL on the small tables."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from panelwright import catalog
from panelwright.functions.conventions import asof, chain_and
from panelwright.operators import metrics, quality, scores, states, statistics, zones
from panelwright.sources import panels
from panelwright.streaming.confirm import replay

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
COMPARED = ["confirmed_intervals", "rm01_natr14", "cf03_intervals", "dq14_gap_intervals", "dq17_nearest_factors", "ez05_event_zones_wide", "ez20_asof_orders", "as18_lag_profile", "pr09_overlap", "rc01_multiset_diff", "rs09_gates", "dq19_repair_candidates", "dq19_repair_rollup", "as26_common_wide"]


def cell(v):
    if v is None or v != v:
        return ""
    return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", COMPARED)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = catalog.queries()[name](spark, SF), con.sql(catalog.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted(tuple(cell(r[c]) for c in columns) for r in got.collect())
    names = want.columns
    b = sorted(tuple(cell(r[names.index(c)]) for c in columns) for r in want.fetchall())
    assert a == b and a


def test_every_query_has_a_callable_and_sql_names_exist():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def price_panel(spark, n=90, bad=None):
    rows, close = [], 10.0
    for i in range(n):
        before, close = close, 10 + 0.05 * i + math.sin(i / 3)
        rows.append((1, i, before, max(before, close) + 0.2, min(before, close) - 0.2, close, 100.0 + i, (100.0 + i) * close, close, 0.01 * (1 + i % 7), i == bad))
    frame = spark.createDataFrame(rows, "security_id long, i int, adjusted_open double, adjusted_high double, adjusted_low double, adjusted_close double, volume_shares double, amount_yuan double, daily_vwap double, turnover_float double, suspension_flag boolean")
    return rows, frame.withColumn("trading_date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("i")))


def test_natr_equals_the_recursion(spark):
    rows, frame = price_panel(spark)
    got = [r.value for r in metrics.natr(frame).orderBy("trading_date").collect()]
    tr = [max(h - lo, abs(h - rows[i - 1][5]), abs(lo - rows[i - 1][5])) for i, (_, _, _, h, lo, *_) in enumerate(rows) if i]
    atr = sum(tr[:14]) / 14
    assert got[13] is None and got[14] == pytest.approx(atr / rows[14][5])
    for i in range(15, len(rows)):
        atr = (13 * atr + tr[i - 1]) / 14
        assert got[i] == pytest.approx(atr / rows[i][5])


def test_a_bad_row_blocks_its_windows(spark):
    _, frame = price_panel(spark, bad=40)
    got = metrics.log_range(frame).orderBy("trading_date").collect()
    assert [i for i, r in enumerate(got) if r.value is None] == [*range(19), *range(40, 60)]
    assert got[40].reason_codes == ["suspension_in_window"] and got[40].validity_status == "diagnostic_required" and got[5].reason_codes == ["window_insufficient"]


def test_percentile_is_strictly_past_with_midranks(spark):
    values = [3.0, 1.0, 3.0, None, 2.0, 3.0, 3.0, 0.5]
    rows = [(1, f"2020-01-{i + 1:02d}", v, "valid" if v is not None else "blocked", ["x"]) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "security_id long, trading_date string, value double, validity_status string, reason_codes array<string>")
    got = scores.strict_past_percentile(frame, 3).orderBy("trading_date").collect()
    assert [r.percentile for r in got] == [None, None, None, None, (1 + 0) / 3, (2 + 0.5) / 3, (1 + 1.0) / 3, 0.0]
    assert got[3].validity_status == "blocked" and got[2].reason_codes == ["insufficient_strict_past_history"]


def test_ordered_and_is_not_sql_and(spark):
    frame = spark.createDataFrame([(None, False), (False, None), (True, None), (True, True)], "a boolean, b boolean")
    assert [r[0] for r in frame.select(chain_and(F.col("a"), F.col("b"))).collect()] == [None, False, None, True]


def fsm(days, k, d, g):
    """Event zones of one entity, day by day: (first day, last day, components)."""
    comps, run, out = [], [], []
    for i, s in enumerate([*days, None]):
        if s is True:
            run.append(i)
            continue
        if len(run) >= k:
            comps.append((run[k - 1], run[-1]))
        run = []
    for n, (a, b) in enumerate(comps):
        if b - a + 1 < d:
            continue
        if n:
            pa, pb = comps[n - 1]
            between = days[pb + 1 : a]
            false = sum(x is False for x in between)
            if pb - pa + 1 >= d and None not in between and 1 <= false <= g:
                out[-1] = (out[-1][0], b, out[-1][2] + 1)
                continue
        out.append((a, b, 1))
    return out


@pytest.mark.parametrize("k,d,g", [(1, 1, 1), (2, 2, 2), (3, 1, 2)])
def test_zones_equal_a_state_machine(spark, k, d, g):
    rng, rows, want = random.Random(k), [], {}
    for e in range(60):
        days = [rng.choice([True, True, True, False, None] if rng.random() < 0.9 else [None]) for _ in range(40)]
        want[e] = fsm(days, k, d, g)
        rows += [(e, i, s, "valid" if s is not None else "unknown") for i, s in enumerate(days)]
    frame = spark.createDataFrame(rows, "security_id long, observation_sequence long, raw_state boolean, validity_status string")
    frame = frame.withColumn("trading_date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("observation_sequence").cast("int")))
    keys = ["security_id"]
    daily = zones.replay(frame, k, keys)
    comps = zones.components(zones.atomic_intervals(daily, keys), daily, d, keys)
    got = {e: [] for e in want}
    out = zones.zones(zones.assign_zones(comps, zones.gaps(daily, comps, g, keys), g, keys), keys)
    for r in out.orderBy("security_id", "start_date").collect():
        got[r.security_id].append(((r.start_date - r.start_date.replace(month=1, day=1)).days, (r.end_date - r.end_date.replace(month=1, day=1)).days, r.n_components))
    assert got == want


def test_asof_takes_ties_by_key(spark):
    left = spark.createDataFrame([(1, 5), (1, 2), (2, 9)], "k long, t long")
    right = spark.createDataFrame([(1, 3, 1, "a"), (1, 5, 1, "b"), (1, 5, 2, "c"), (2, 10, 1, "d")], "k long, s long, n long, v string")
    got = {(r.k, r.t): (r.matched_s, r.v) for r in asof(left, right, ["k"], "t", "s", ["v"], ties=["n"]).collect()}
    assert got == {(1, 5): (5, "c"), (1, 2): (None, None), (2, 9): (None, None)}


def test_confirmation_never_comes_earlier_for_larger_k(spark):
    rng = random.Random(2)
    rows = [(e, f"2020-01-{i + 1:02d}", rng.choice([True, True, False, None]), "valid") for e in range(20) for i in range(28)]
    frame = spark.createDataFrame(rows, "security_id long, trading_date string, raw_state boolean, validity_status string")
    got = states.confirm(states.streaks(frame, ["security_id"]), [2, 3], ["security_id"])
    two, three = (got.where(f"k = {k} and confirmed").select("security_id", "trading_date") for k in (2, 3))
    assert three.join(two, ["security_id", "trading_date"], "left_anti").count() == 0 and two.count() > three.count()


def test_shift_keeps_blocks(spark):
    rows = [(e, f"2020-01-{i + 1:02d}", i % 3 == 0) for e in range(5) for i in range(20)]
    frame = spark.createDataFrame(rows, "security_id long, trading_date string, s boolean").withColumn("trading_date", F.to_date("trading_date"))
    placed = statistics.blocks(frame)
    turned = statistics.shifted(placed, "s", 8, 1)
    counts = turned.groupBy("replicate", "security_id").agg(F.count_if("shifted").alias("n"), F.count("*").alias("rows")).collect()
    assert {(r.n, r.rows) for r in counts} == {(7, 20)}
    same = turned.join(placed.select("security_id", "block", "pos", "s"), ["security_id", "block", "pos"]).groupBy("replicate", "security_id").agg(F.bool_and(F.col("s") == F.col("shifted")).alias("same"))
    assert sum(r.same for r in same.collect()) < 40


def test_stream_equals_batch_with_rows_out_of_order(spark, tmp_path):
    rng = random.Random(8)
    rows = [(e, f"2020-01-{i + 1:02d}", rng.choice([True, True, False])) for e in range(6) for i in range(25)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "security_id long, trading_date string, raw_state boolean")
    got = {(r.security_id, r.event, r.trading_date) for r in replay(frame, str(tmp_path / "s"), 2, 3).collect()}
    batch = states.intervals(states.confirm(states.streaks(frame.withColumn("validity_status", F.lit("valid")), ["security_id"]), [2], ["security_id"]), ["security_id", "k"]).collect()
    want = {(r.security_id, "confirmed", r.confirmation_date) for r in batch} | {(r.security_id, "exit", r.last_observed_date) for r in batch if not r.is_open}
    assert got == want and want


def test_codes(spark):
    frame = spark.createDataFrame([("000123.SZ",), ("sh.600000",), ("600001",), ("??",), (None,)], "c string")
    got = [(r.vendor_code, r.status) for r in quality.resolve_codes(frame, "c").collect()]
    assert got == [("000123.SZ", "resolved"), ("600000.SH", "resolved"), ("600001.SH", "inferred"), (None, "unresolved"), (None, "unresolved")]


def test_sources_and_sinks(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a", 2.0), (2, None, 3.0)], "id long, name string, x double")
    panels.write_parquet(frame, str(tmp_path / "p"), ["id"])
    panels.write_report(frame, str(tmp_path / "c"), ["name", "id"])
    frame.write.json(str(tmp_path / "j"))
    assert panels.scan_csv(spark, str(tmp_path / "c"), "name string, id long").count() == 2
    assert panels.scan_jsonl(spark, str(tmp_path / "j"), "id long, x double").agg(F.sum("x")).first()[0] == 5.0
    assert panels.merge_shards(spark, [str(tmp_path / "p"), str(tmp_path / "p")]).count() == 4
    named = panels.normalise(frame, {"code": ("missing", "name"), "status": ("none",)}, {"status": "valid"})
    assert [tuple(r) for r in named.collect()] == [("a", "valid"), (None, "valid")]
    assert panels.scope(frame.withColumn("d", F.lit("2020-01-05").cast("date")), "id", "d", first=1, start="2020-01-01").count() == 1


def test_scores_that_are_not_finite_give_no_state(spark):
    from panelwright.operators import requests

    odd = [float("nan"), float("inf"), float("-inf"), None, 0.9]
    frame = spark.createDataFrame([(i, "P", x, x, x, "valid", ["r"]) for i, x in enumerate(odd)], "security_id long, dimension string, score double, score_mean double, score_min double, validity_status string, reason_codes array<string>")
    for out in (states.indicator_states(frame, [0.2]), states.dimension_states(frame, [0.2])):
        assert {r.security_id: r.active for r in out.collect()} == {0: None, 1: None, 2: None, 3: None, 4: True}
    got = requests.dimension_states(frame, requests.request_table(spark, {"p": ({"P": 2000}, 2)})).collect()
    assert {r.security_id: (r.dimension_state, r.reasons) for r in got} == {0: (None, ["P_score_non_finite"]), 1: (None, ["P_score_non_finite"]), 2: (None, ["P_score_non_finite"]), 3: (None, ["P_score_missing"]), 4: (True, [])}


def test_zero_prices_and_volumes_end_no_job(spark):
    from panelwright.operators import requests

    _, frame = price_panel(spark)
    bad = frame.withColumns({c: F.when(F.col("i") == 5, 0.0).otherwise(F.col(c)) for c in ("adjusted_close", "adjusted_open", "adjusted_low")})
    none = frame.withColumn("volume_shares", F.lit(0.0))
    for f in metrics.METRICS.values():
        assert f(bad).count() == f(none).count() == 90
    assert {c for r in metrics.vwap_spread(none).collect() for c in r.reason_codes} >= {"zero_volume_in_window"}
    assert quality.mechanical_gap(bad, bad.where("i = 7")).count() > 0
    assert requests.path_metrics(bad.select("security_id", "trading_date"), bad).count() == 90
    lines = spark.createDataFrame([(1, "1996-01-01", 1, 1, 1, 10.0, 0.0)], "l_suppkey long, l_shipdate string, l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double, l_quantity double")
    assert panels.daily_prices(lines).first().daily_vwap is None


def test_metrics_over_one_sort_equal_each_alone(spark):
    _, frame = price_panel(spark, bad=70)
    names = list(metrics.METRICS)
    together = {(r.indicator, r.trading_date): (r.value, r.validity_status, r.reason_codes, r.actual_count) for r in metrics.stacked(frame, names).collect()}
    for n in names:
        for r in metrics.METRICS[n](frame).collect():
            assert together[n, r.trading_date] == (r.value, r.validity_status, r.reason_codes, r.actual_count), n


def test_past_ranks_against_brute_force():
    import numpy as np

    rng = random.Random(3)
    for window, n in ((1, 5), (7, 60), (500, 5_200)):
        values = np.array([rng.choice([float("nan"), rng.randrange(9), rng.random()]) for _ in range(n)])
        counted, twice, first, last = scores.past_ranks(values, window)
        seen = []
        for i, v in enumerate(values):
            if v != v:
                assert (counted[i], first[i], last[i]) == (0, -1, -1)
                continue
            past = seen[-window:]
            assert counted[i] == len(past) and (first[i], last[i]) == ((past[0], past[-1]) if past else (-1, -1))
            if len(past) == window:
                assert twice[i] == sum(2 if values[p] < v else values[p] == v for p in past)
            seen.append(i)


def test_pooled_ranks_by_ranges(spark):
    rng = random.Random(8)
    xs = [rng.choice([rng.random() * 1e6, float(rng.randrange(5)), -3.0]) for _ in range(400)] + [None]
    got = {r.x: r.x_rank for r in statistics.value_ranks(spark.createDataFrame([(x,) for x in xs], "x double"), "x").collect()}
    known = [x for x in xs if x is not None]
    assert got == {x: sum(y < x for y in known) + (sum(y == x for y in known) + 1) / 2 for x in known}
    same = statistics.value_ranks(spark.createDataFrame([(1.0,), (1.0,)], "x double"), "x").collect()
    assert [(r.x, r.x_rank) for r in same] == [(1.0, 1.5)]
