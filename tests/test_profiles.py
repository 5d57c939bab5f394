"""Profiles of states, intervals, gaps and windows against plain recomputation."""

import datetime

from panelwright.operators import profiles, reconcile, zones

DAY = datetime.date(2001, 12, 30)


def test_state_days_count_registered_groups_without_days(spark):
    rows = [(2, 1, 0, "valid", True, False), (2, 1, 3, "valid", True, True), (2, 2, 3, "blocked", None, None), (2, 2, 4, "valid", False, False)]
    frame = spark.createDataFrame([(k, e, DAY + datetime.timedelta(days=i), *rest) for k, e, i, *rest in rows], "k int, security_id long, trading_date date, validity_status string, raw_state boolean, confirmed boolean")
    got = {r["k"]: r for r in profiles.state_days(frame, ["k"], spark.createDataFrame([(2,), (9,)], "k int")).collect()}
    assert [got[2][c] for c in ("n_days", "n_valid", "n_blocked", "n_raw_true", "n_raw_false", "n_raw_null", "n_raw_entities", "n_raw_years", "n_confirmed_true", "n_confirmed_years")] == [4, 3, 1, 2, 1, 1, 1, 2, 1, 1]
    assert set(got) == {2, 9} and {v for c, v in got[9].asDict().items() if c != "k"} == {0}


def test_interval_durations_name_contradictions(spark):
    at = lambda n: DAY + datetime.timedelta(days=n)
    rows = [(3, at(0), at(2), 5, 3, False, "state_false"), (3, at(0), at(3), 6, 1, True, "end_of_input_open"), (3, at(4), at(3), 4, 2, False, "state_false")]
    frame = spark.createDataFrame(rows, "k int, raw_start_date date, confirmation_date date, duration_raw_days long, duration_confirmed_days long, is_open boolean, termination_reason string")
    (r,) = profiles.interval_durations(frame).collect()
    assert (r["n_intervals"], r["total_days"], r["n_single"], r["n_open"], r["n_length_mismatch"], r["n_early"], r["q50"], r["q25"], r["delay_rows"]) == (3, 6, 1, 1, 1, 1, 2.0, 1.5, 2)
    ends = {r["termination_reason"]: (r["n"], round(r["share"], 3)) for r in profiles.terminations(frame, ["k"]).collect()}
    assert ends == {"state_false": (2, 0.667), "end_of_input_open": (1, 0.333)}
    assert profiles.interval_durations(frame.where("false")).count() == 0


def test_gaps_by_security_and_overlaps(spark):
    gaps = spark.createDataFrame([(1, DAY, "daily"), (1, DAY, "limit"), (1, DAY, "limit"), (2, DAY, "limit")], "security_id long, trading_date date, gap_type string")
    runs = spark.createDataFrame([(1, "limit", 2), (1, "limit", 5)], "security_id long, gap_type string, n_days long")
    got = {(r["security_id"], r["gap_type"]): (r["n_gaps"], r["n_intervals"], r["longest"]) for r in profiles.gap_securities(gaps, runs).collect()}
    assert got == {(1, "daily"): (1, 0, 0), (1, "limit"): (2, 2, 5), (2, "limit"): (1, 0, 0)}
    seen = {r["security_id"]: (r["gap_types"], r["n_types"], r["has_daily"], r["has_limit"]) for r in profiles.gap_overlaps(gaps, ["daily", "limit"]).collect()}
    assert seen == {1: ("daily+limit", 2, True, True), 2: ("limit", 1, False, True)}


def test_windows_count_usable_rows(spark):
    bad = {5: {"adjusted_open": None}, 7: {"adjusted_close": float("nan")}, 9: {"volume_shares": -1.0}, 11: {"adjusted_low": 3.0}}
    rows = []
    for i in range(85):
        row = {"adjusted_open": 1.5, "adjusted_high": 2.0, "adjusted_low": 1.0, "adjusted_close": 1.5, "volume_shares": 0.0, "amount_yuan": 1.0} | bad.get(i, {})
        rows.append((1, i, *row.values()))
    frame = spark.createDataFrame(rows, "security_id long, trading_date int, adjusted_open double, adjusted_high double, adjusted_low double, adjusted_close double, volume_shares double, amount_yuan double")
    got = {r["trading_date"]: r for r in profiles.window_counts(frame).collect()}
    for i, r in got.items():
        near = lambda n, out: sum(j not in out for j in range(max(0, i - n + 1), i + 1))
        assert (r["price_15"], r["price_80"], r["participation_20"], r["trend_60"]) == (near(15, (5, 7, 11)), near(80, (5, 7, 11)), near(20, (9,)), near(60, (7,)))
        assert r["capacity"] == "insufficient_history"


def test_multisets_and_first_differences(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, None), (2, "y"), (None, "z")], "k long, v string")
    b = spark.createDataFrame([(1, "x"), (1, None), (1, None), (3, "y"), (None, "z")], "k long, v string")
    got = {r["metric"]: r["value"] for r in reconcile.multiset_counts(a, b, ["k", "v"], ["k"]).collect()}
    assert got == {"n_left": 5, "n_right": 5, "n_missing": 2, "n_unexpected": 2, "n_repeats_left": 2, "n_repeats_right": 2}
    none = {r["metric"]: r["value"] for r in reconcile.multiset_counts(a.where("false"), b.where("false"), ["k", "v"], ["k"]).collect()}
    assert set(none.values()) == {0}
    x = spark.createDataFrame([(i, float(i)) for i in range(60)], "k long, v double")
    y = spark.createDataFrame([(i, float(i) + (i % 2) if i % 10 else None) for i in range(30, 90)], "k long, v double")
    rows = sorted((r["kind"], r["place"], r["k"]) for r in reconcile.first_differences(x, y, ["k"], ["v"], 4).collect())
    assert rows == [("left_only", i + 1, i) for i in range(4)] + [("mismatched", i + 1, k) for i, k in enumerate((30, 31, 33, 35))] + [("right_only", i + 1, 60 + i) for i in range(4)]


def test_transitions_are_counted_by_their_ends(spark):
    ledger = spark.createDataFrame([(1, None, "a"), (1, "a", "b"), (2, "a", "b"), (2, "a", "c"), (2, "a", "b")], "security_id long, previous_event string, event string")
    got = {(r["previous_event"], r["event"]): (r["n"], r["n_entities"], r["share"]) for r in zones.transition_counts(ledger, ["security_id"]).collect()}
    assert got == {(None, "a"): (1, 1, 1.0), ("a", "b"): (3, 2, 0.75), ("a", "c"): (1, 1, 0.25)}
