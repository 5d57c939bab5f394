"""Price checks, chains with blockers and live confirmation on small odd tables."""

import datetime

from pyspark.sql import functions as F

from panelwright.operators import layers as L
from panelwright.operators import price_checks as C
from panelwright.streaming import confirm

DAY = datetime.date(2020, 3, 2)
GOOD = {
    "security_id": 1, "trading_date": DAY, "adjustment_factor": 2.0, "factor_as_of": DAY, "revision": "final", "method": "forward_adjusted", "volume": 5.0, "amount": 9.0, "trading_status": "trading", "limit_status": "known",
    "suspension_status": "known", "special_status": "known", "unit_status": "known", "direction_verified": True, "action_flag": False, "action_status": "known", "source_id": "s",
    "raw_open": 2.0, "raw_high": 4.0, "raw_low": 1.0, "raw_close": 3.0, "adj_open": 4.0, "adj_high": 8.0, "adj_low": 2.0, "adj_close": 6.0,
}
SHAPE = ", ".join(f"{k} {'date' if k in ('trading_date', 'factor_as_of') else 'boolean' if isinstance(v, bool) else 'long' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in GOOD.items())
FAULTS = {
    "adjustment_factor": (None, {"factor_missing"}, {"factor_time"}), "revision": (" ", {"revision_missing"}, {"revision_not_allowed"}), "factor_as_of": (DAY + datetime.timedelta(3), set(), {"factor_time_in_future"}),
    "raw_close": (0.0, {"raw_price_missing_or_not_positive", "raw_order_violation"}, {"product_close", "recovered_close"}), "adj_high": (5.0, {"adjusted_order_violation"}, {"order_violation", "product_high", "recovered_high"}),
    "volume": (-1.0, {"volume_negative"}, set()), "amount": (None, {"amount_missing"}, set()), "trading_status": (None, {"trading_status_unknown"}, set()), "method": ("unknown", set(), {"method_unknown"}),
    "action_status": (None, set(), {"action_silently_false"}), "direction_verified": (None, {"factor_direction_unverified"}, set()), "security_id": (9, set(), {"not_a_member"}),
}


def test_each_fault_gives_its_reasons(spark):
    for column, (value, reasons, rules) in FAULTS.items():
        rows = spark.createDataFrame([tuple((GOOD | {column: value})[k] for k in GOOD)], SHAPE)
        assert set(C.row_reasons(rows).first().reasons) == reasons, column
        found = {r.rule for r in C.violations(rows, spark.createDataFrame([(1,)], "security_id long"), C.Contract(("forward_adjusted", "identity_no_adjustment"), ("final",))).collect()}
        assert found == (set() if rules == {"factor_time"} else rules), column
    clean = spark.createDataFrame([tuple(GOOD.values())] * 2, SHAPE)
    assert [r.reasons for r in C.row_reasons(clean).collect()] == [["duplicate_key"]] * 2
    held = {r.metric: r.value for r in C.audit(clean, spark.createDataFrame([(1, DAY, 2.0 + 1e-6)], "security_id long, trading_date date, factor double")).collect()}
    assert (held["n_rows"], held["n_keys"], held["rows_of_repeated_keys"], held["factor_mismatch"], held["factor_without_second_source"]) == (2, 1, 2, 2, 0)


def test_the_first_dimension_that_is_not_true_decides(spark):
    rows = [(1, "P", True, "valid", []), (1, "C", None, "blocked", ["b", "a", "b"]), (1, "T", False, "valid", []), (2, "P", True, "valid", []), (2, "C", False, "valid", []), (2, "T", None, "unknown", ["x"]), (3, "P", True, "valid", []), (3, "T", True, "valid", [])]
    rows += [(4, d, True, "valid", []) for d in "PCT"] + [(5, "P", False, "valid", []), (6, "P", None, "diagnostic_required", ["y"])]
    df = spark.createDataFrame(rows, "day long, dimension string, active boolean, validity_status string, reason_codes array<string>")
    got = {r.day: (r.s1, r.s2, r.s3, r.s3_status, r.s3_reasons, r.blocking, r.layer) for r in L.chain_states(df, ["P", "C", "T"], ["day"]).collect()}
    ok = ["valid_no_blocker"]
    assert got == {
        1: (True, None, None, "blocked", ["b", "a"], "C", "BLOCKED"), 2: (True, False, False, "valid", ok, "C", "P_ONLY"), 3: (True, None, None, "unknown", ["missing_dimension_state"], "C", "UNKNOWN"),
        4: (True, True, True, "valid", ok, None, "PCT"), 5: (False, False, False, "valid", ok, "P", "NONE"), 6: (None, None, None, "diagnostic_required", ["y"], "P", "DIAGNOSTIC_REQUIRED"),
    }


def test_repeated_times_count_and_order_does_not_matter(spark, tmp_path):
    days = [(1, "2020-01-01", True), (1, "2020-01-01", True), (1, "2020-01-03", True), (1, "2020-01-04", None), (1, "2020-01-05", True), (2, "2020-01-02", True), (2, "2020-01-02", False), (2, "2020-01-06", True), (2, "2020-01-07", True)]
    states = spark.createDataFrame(days, "security_id long, day string, raw_state boolean").select("security_id", F.to_date("day").alias("trading_date"), "raw_state")
    got = sorted(map(tuple, confirm.replay(states, str(tmp_path), 2, files=3).collect()))
    assert got == [(1, "confirmed", "2020-01-01", "2020-01-01", 2), (1, "exit", "2020-01-04", "2020-01-01", 3), (2, "confirmed", "2020-01-07", "2020-01-06", 2)]
    assert spark.conf.get(confirm.STORE[0], "") != confirm.STORE[1]
