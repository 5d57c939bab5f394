"""Steps, lags and states over years against plain recomputation on small panels with nulls."""

import datetime
import random
from collections import Counter
from statistics import median

from pyspark.sql import functions as F

from panelwright.operators import pairs, stability

DAY = datetime.date(2001, 12, 1)


def panel(spark, seed=5, entities=6, days=70):
    draw = random.Random(seed)
    rows = [(e, DAY + datetime.timedelta(days=i), *[draw.choices([True, False, None], [4, 5, 1])[0] for _ in range(3)]) for e in range(entities) for i in range(days)]
    return rows, spark.createDataFrame(rows, "security_id long, trading_date date, P boolean, C boolean, T boolean").repartition(3)


def test_steps_without_a_year_equal_recomputation(spark):
    rows, frame = panel(spark)
    cells = stability.step_cells(pairs.steps(frame, ["P", "C", "T"]))
    got = {(r["step"], r["year"]): r for r in stability.steps_without_year(cells).collect()}
    assert set(got) == {(s, y) for s in ("P_to_C", "PC_to_T") for y in (2001, 2002)}
    for (name, year), r in got.items():
        n = Counter()
        for _, day, p, c, t in rows:
            known, anchor, target = ((p, c), p, c) if name == "P_to_C" else ((p, c, t), p and c, t)
            if None not in known and day.year != year:
                n[anchor, target] += 1
        assert [r["n11"], r["n10"], r["n01"], r["n00"]] == [n[True, True], n[True, False], n[False, True], n[False, False]]
        assert abs(r["delta"] - (n[True, True] / (n[True, True] + n[True, False]) - (n[True, True] + n[False, True]) / sum(n.values()))) < 1e-12


def test_lag_effects_equal_recomputation(spark):
    rows, frame = panel(spark, 8)
    cells = stability.lag_cells(frame, "P", ["C"], [1, 3])
    got = {r["k"]: r for r in stability.lag_effects(cells).collect()}
    each = {(r["k"]): r for r in stability.lag_securities(cells).collect()}
    of = {}
    for e, day, p, c, _ in sorted(rows, key=lambda r: r[:2]):
        of.setdefault(e, []).append((p, c))
    for k in (1, 3):
        n, effects = Counter(), []
        for days in of.values():
            own = Counter()
            for i in range(1, len(days)):
                if days[i - 1][0] is False and days[i][0] is not None:
                    kind = "onset" if days[i][0] else "control"
                    own[kind, "n"] += 1
                    if i + k >= len(days):
                        own[kind, "censored"] += 1
                    elif days[i + k][1] is None:
                        own[kind, "invalid"] += 1
                    else:
                        own[kind, "true" if days[i + k][1] else "false"] += 1
            n += own
            rate = {s: own[s, "true"] / (own[s, "true"] + own[s, "false"]) for s in ("onset", "control")}
            effects.append(rate["onset"] - rate["control"])
        for s in ("onset", "control"):
            assert [got[k][f"{s}_{x}"] for x in ("n", "censored", "invalid", "true", "false")] == [n[s, x] for x in ("n", "censored", "invalid", "true", "false")]
        assert abs(each[k]["median"] - median(effects)) < 1e-12 and each[k]["n_positive"] == sum(x > 0 for x in effects)


def test_empty_and_constant_states_have_defined_rows(spark):
    rows = spark.createDataFrame([("a", 2001, 10, 0), ("a", 2002, 0, 0), ("b", 2001, 10, 10), ("b", 2002, 10, 1)], "state string, year int, n_known long, n_true long")
    got = {r["state"]: r for r in stability.state_years(rows).collect()}
    assert got["a"]["status"] == "never_true" and got["a"]["hhi"] is None and got["a"]["peak_year"] is None
    assert got["b"]["status"] == "one_year_rules" and got["b"]["peak_year"] == 2001
    assert stability.state_years(rows.where("false")).count() == 0
    rest = {(r["state"], r["year"]): r for r in stability.states_without_year(rows).collect()}
    assert rest["b", 2001]["hhi_without"] == 1.0 and rest["b", 2001]["coverage_without"] == 0.1 and rest["a", 2001]["hhi_without"] is None


def test_transitions_of_two_levels(spark):
    days = [(1, i, a, b) for i, (a, b) in enumerate([(False, False), (False, True), (True, True), (None, True), (True, False)])]
    out = stability.transition_crosstab(spark.createDataFrame(days, "security_id long, trading_date int, low boolean, high boolean"), [("low", "high")])
    assert {(r["lower_class"], r["higher_class"]): r["n"] for r in out.where(F.col("lower") == "low").collect()} == {
        ("other", "other"): 1, ("stay_out", "onset"): 1, ("onset", "continuing"): 1, ("invalid", "continuing"): 1, ("other", "exit"): 1,
    }
