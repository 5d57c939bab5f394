"""Correlations of groups in which a side does not vary, or that have one row."""

import math

from panelwright.operators import pairs as P
from panelwright.operators import statistics as A
from panelwright.plans import decisions, statistics

ROWS = [(1, i, 0.5, float(i)) for i in range(12)] + [(2, 0, 0.1, 0.2)] + [(3, i, float(i), float(i * i)) for i in range(12)] + [(4, i, None, 1.0) for i in range(3)]
SCHEMA = "security_id long, period int, a double, b double"


def test_groups_without_spread_give_nan(spark):
    found = {r.security_id: r for r in A.correlations(spark.createDataFrame(ROWS, SCHEMA), "a", "b", ["security_id"]).collect()}
    assert sorted(found) == [1, 2, 3]  # as25: a group without common rows has none
    assert all(math.isnan(x) for k in (1, 2) for x in (found[k].pearson, found[k].spearman)) and found[1].n == 12
    assert abs(found[3].spearman - 1) < 1e-12 and 0.9 < found[3].pearson < 1
    (row,) = A.correlations(spark.createDataFrame([], SCHEMA), "a", "b", []).collect()
    assert row.n == 0 and row.pearson is None


def test_stability_and_disposition_pass_over_them(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, SCHEMA)
    monkeypatch.setattr(decisions, "pair_wide", lambda s, d: df)
    assert {r.scope: r.n for r in decisions._stability(spark, "").collect()} == {"year": 0, "security": 1}
    assert {(r.scope, r.passed) for r in decisions._disposition(spark, "").collect()} == {("security", True), ("year", False)}


def test_pairs_without_spread_are_undefined(spark):
    wide = spark.createDataFrame([(e, i, 0.5, float(i), float(i % 7)) for e in range(2) for i in range(20)], "security_id long, trading_date int, x double, y double, z double")
    rows = P.pair_rows(wide, ["x", "y", "z"])
    facts = P.pair_correlations(rows, []).join(P.threshold_overlap(rows, 0.2), "pair", "left").join(P.by_security(rows, 5), "pair", "left")
    pairs = P.classify(facts, {"x": "1", "y": "1", "z": "2"}, 0.6, 0.3, 0.2)
    found = {r.pair: r for r in pairs.collect()}
    assert {k: found[k]["class"] for k in ("x|y", "x|z")} == {"x|y": "undefined", "x|z": "undefined"} and math.isnan(found["x|y"].spearman)
    assert found["x|y"].n_securities is None and found["y|z"].n_securities == 2
    classes = {r.indicator: r.class_root for r in P.redundancy_classes(pairs, ["x", "y", "z"]).collect()}
    assert classes["x"] == "x"


def test_rounding_keeps_nan(spark):
    (row,) = statistics.rounded(A.correlations(spark.createDataFrame(ROWS[:12], SCHEMA), "a", "b", [])).collect()
    assert math.isnan(row.spearman)
