"""Exits of request chains, cell scans, matches, exact quantiles, digests, pairs, fronts and resampling against brute force."""

import collections
import itertools
import math
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from panelwright.operators import digests as G
from panelwright.operators import exits as X
from panelwright.operators import pairs as P
from panelwright.operators import selection as Q
from panelwright.operators import statistics as A
from panelwright.operators import zones as Z

DAY0 = 730_000


def test_parents_of_scattered_days(spark):
    """Children with no, one and two parents; day sets with holes; another entity's days don't count."""
    children = [(1, 1, d) for d in (2, 5, 9)] + [(1, 2, d) for d in (20, 22)] + [(1, 3, 40), (1, 3, 41)] + [(2, 1, d) for d in (2, 5, 9)] + [(1, 1, 9)]
    parents = [(1, 7, d) for d in (1, 2, 5, 8, 9)] + [(1, 8, d) for d in range(19, 30)] + [(1, 9, d) for d in (20, 21, 22)] + [(1, 10, 40)] + [(2, 7, d) for d in (2, 5)]
    c, p = spark.createDataFrame(children, "e long, child long, day long"), spark.createDataFrame(parents, "e long, parent long, day long")
    got = {(r.e, r.child): (r.n_days, r.n_parents, r.parent, r.mapping) for r in X.map_parent(c, p, ["e"], "child", "parent", "day").collect()}
    assert got == {(1, 1): (3, 1, 7, "unique"), (1, 2): (2, 2, None, "ambiguous"), (1, 3): (2, 0, None, "none"), (2, 1): (3, 0, None, "none")}
    assert X.map_parent(c.where("e > 5"), p, ["e"], "child", "parent", "day").count() == 0


@pytest.fixture(scope="module")
def chain(spark):
    """Confirmed days of four levels, each within the next, over three entities."""
    rng, rows = random.Random(3), []
    for entity in range(3):
        inside = [set(range(200))]
        for keep in (0.85, 0.85, 0.85, 0.85):
            cuts = {d for d in inside[-1] if rng.random() > keep}
            inside.append(inside[-1] - cuts)
        for level, days in enumerate(reversed(inside[1:]), 1):
            no, last = 0, None
            for d in sorted(days):
                no += last != d - 1
                rows.append((f"r{level}", level, entity, d, d, no))
                last = d
    return rows, spark.createDataFrame(rows, "request_id string, level int, security_id long, trading_date long, observation_sequence long, interval_no long")


def test_structure_of_a_chain(spark, chain):
    rows, days = chain
    by = collections.defaultdict(set)
    for _, level, e, _, d, no in rows:
        by[level, e, no].add(d)
    found = {(r.level, r.security_id, r.child_no): r.parent_no for r in X.chain_parents(days).collect()}
    assert found == {(lv, e, no): next(n for (l2, e2, n), held in by.items() if (l2, e2) == (lv + 1, e) and ds <= held) for (lv, e, no), ds in by.items() if lv < 4}
    wide = X.day_levels(days, 4)
    parents = {(r.security_id, r.parent_no): r for r in X.parent_structure(wide, 4).collect()}
    children = {(r.security_id, r.child_no): r for r in X.child_structure(wide, 4).collect()}
    for (lv, e, no), held in by.items():
        if lv == 4:
            r, third = parents[e, no], set().union(*[d for (l2, e2, _), d in by.items() if (l2, e2) == (3, e)])
            assert (r.parent_days, r.shell_days, r.days_3) == (len(held), len(held - third), len(held & third))
            assert r.n_children == sum((l2, e2) == (3, e) and d <= held for (l2, e2, _), d in by.items())
        if lv == 3:
            r, parent = children[e, no], by[4, e, found[3, e, no]]
            third, lead, trail = set().union(*[d for (l2, e2, _), d in by.items() if (l2, e2) == (3, e)]), 0, 0
            while min(held) - lead - 1 in parent - third:
                lead += 1
            while max(held) + trail + 1 in parent - third:
                trail += 1
            assert (r.child_days, r.leading_shell_days, r.trailing_shell_days, r.adjacent_shell_days) == (len(held), lead, trail, lead + trail)
    identities = wide.withColumnRenamed("no_4", "parent_no")
    tables = X.parent_structure(wide, 4), X.child_structure(wide, 4), identities
    assert X.structure_anomalies(X.structure_rules(*tables, 4)).count() == 0
    checks = X.structure_checks(X.structure_rules(*tables, 4)).collect()
    assert len(checks) == 9 and all(r.status == "ok" and r.n_rows > 0 for r in checks)


def test_planted_faults_are_named_with_both_sides(spark, chain):
    wide = X.day_levels(chain[1], 4)
    parents, children, days = X.parent_structure(wide, 4), X.child_structure(wide, 4), wide.withColumnRenamed("no_4", "parent_no")

    def found(*tables):
        return {(r.rule, r.row_key): (r.left_value, r.right_value) for r in X.structure_anomalies(X.structure_rules(*tables, 4)).collect()}

    first = parents.orderBy("security_id", "parent_no").first()
    at = (F.col("security_id") == first.security_id) & (F.col("parent_no") == first.parent_no)
    key = f"{first.security_id}|{first.parent_no}"
    assert found(parents.withColumn("shell_days", F.col("shell_days") + at.cast("long")), children, days) == {("shell_days_conserved", key): (first.shell_days + 1.0, float(first.shell_days))}
    assert ("days_1_within_days_2", key) in found(parents.withColumn("days_1", F.when(at, F.col("days_2") + 1).otherwise(F.col("days_1"))), children, days)
    gone = found(parents, children, days.where(~(at & (F.col("observation_sequence") == days.where(at).agg(F.min("observation_sequence")).first()[0]))))
    assert gone == {("identity_days_conserved", key): (first.parent_days - 1.0, float(first.parent_days))}
    assert {k[0] for k in found(parents, children, days.withColumn("identity", F.when(at, F.lit(None)).otherwise(F.col("identity"))))} == {"identity_known"}
    assert {k[0] for k in found(parents.where(~at), children, days)} == {"children_as_counted", "identity_days_conserved"} or first.n_children == 0


def test_gate_classes(spark):
    rows = [("valid", 0.9, 0.9), ("valid", 0.6, 0.9), ("valid", 0.9, 0.5), ("valid", 0.1, 0.1), ("unknown", 0.9, 0.9), ("valid", None, 0.9), ("valid", float("nan"), 0.9), (None, 0.9, 0.9)]
    df = spark.createDataFrame(rows, "s string, m double, l double")
    got = [r[0] for r in df.select(X.gate_class(F.col("s") == "valid", F.col("m"), F.col("l"), F.lit(0.3))).collect()]
    assert got == ["NO_GATE_FAIL", "MAIN_ONLY_FAIL", "WEAK_ONLY_FAIL", "MAIN_AND_WEAK_FAIL"] + ["NOT_EVALUABLE"] * 4


@pytest.mark.parametrize("rule", ["linear", "nearest", "rounded"])
def test_exact_quantiles(spark, rule):
    """Groups of very unlike sizes and values, with an accuracy that makes the larger ones go through brackets."""
    rng = random.Random(1)
    groups = {"one": [3.5], "two": [1.0, 2.0], "ties": [1.0] * 300 + [2.0] * 301, "tail": [rng.paretovariate(0.3) for _ in range(900)], "even": [rng.random() for _ in range(1000)], None: [5.0, -1.0, 4.0], "few": [2.0] * 999 + [7.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("ties", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    wanted = {"q05": 0.05, "q50": 0.5, "q95": 0.95, "q0": 0.0, "q1": 1.0}
    got = {r.g: r for r in Q.quantiles(df, ["g"], "v", wanted, rule, accuracy=60).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        vs, n = sorted(vs), len(vs)
        assert got[g].n == n
        for name, p in wanted.items():
            at = (n - 1) * p
            if rule == "linear":
                lo = math.floor(at)
                want = vs[lo] + (vs[min(lo + 1, n - 1)] - vs[lo]) * (at - lo)
            else:
                want = vs[max(math.ceil(p * n), 1) - 1] if rule == "nearest" else vs[round(at)]
            assert got[g][name] == pytest.approx(want, rel=1e-12), (g, name)
    assert Q.quantiles(df.where("g = 'nobody'"), ["g"], "v", wanted, rule).count() == 0
    assert Q.quantiles(df, [], "v", {"m": 0.5}, rule).first().n == sum(map(len, groups.values()))


def test_cells_equal_the_single_runs(spark):
    """The scan of all cells against the operators that take one (k, d, g) at a time."""
    rng, rows = random.Random(7), []
    for e in range(6):
        for d in range(120):
            state = rng.choice([True, True, True, False, None])
            status = "blocked" if rng.random() < 0.03 else "valid"
            rows.append((e, d, d, status, state, rng.random() < 0.7))
    dense = spark.createDataFrame(rows, "security_id long, n int, observation_sequence long, validity_status string, raw_state boolean, other boolean").withColumn("trading_date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("n"))).drop("n")
    routes = [("a1", "raw_state", 1), ("a2", "raw_state", 2), ("b2", "other", 2)]
    scan = Z.zone_scan(dense, routes, [1, 3], [1, 2])
    columns = ["start_date", "end_date", "n_components", "n_confirmed", "n_bridges", "qualification_date", "decision_date", "status"]
    got = collections.defaultdict(set)
    for r in scan.collect():
        got[r.route, r.d, r.g].add((r.security_id, r.zone, *[r[c] for c in columns]))
    keys = ["security_id"]
    for (name, state, k), d, g in itertools.product(routes, (1, 3), (1, 2)):
        daily = Z.replay(dense.withColumn("raw_state", F.col(state)), k, keys)
        comps = Z.components(Z.atomic_intervals(daily, keys), daily, d, keys)
        want = Z.zones(Z.assign_zones(comps, Z.gaps(daily, comps, g, keys), g, keys), keys)
        assert got[name, d, g] == {(r.security_id, r.zone, *[r[c] for c in columns]) for r in want.collect()}, (name, d, g)
    plan = scan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") <= 4


def test_rounds_of_first_choice_equal_one_pass(spark):
    rng = random.Random(5)
    pairs = sorted({(e, rng.randrange(40), rng.randrange(40)) for e in range(4) for _ in range(120)})
    pairs += [(9, k, k + j) for k in range(12) for j in (0, 1)]  # a chain, taken a pair a round
    rows = [(e, a, b, a * 3, b * 2) for e, a, b in pairs]
    got = {(r.e, r.a, r.b) for r in Z.mutual_matches(spark.createDataFrame(rows, "e long, a long, b long, sa long, sb long"), "e", ["sa", "sb", "a", "b"], "a", "b").collect()}
    want, left, right = set(), set(), set()
    for e, a, b, sa, sb in sorted(rows, key=lambda r: (r[0], r[3], r[4], r[1], r[2])):
        if (e, a) not in left and (e, b) not in right:
            want.add((e, a, b))
            left.add((e, a))
            right.add((e, b))
    assert got == want
    assert Z.mutual_matches(spark.createDataFrame([], "e long, a long, b long, sa long, sb long"), "e", ["sa", "sb"], "a", "b").count() == 0


def test_content_ids(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(900), rng.choice(["a", "b", None, "", "-", "é|"]), rng.random() < 0.5) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k long, s string, f boolean")
    name = lambda d, leaf=20, cols=("k", "s", "f"): G.content_id(d, list(cols), leaf).first()
    whole = name(df)
    assert whole.n_rows == 3000 and whole.n_distinct == len(set(rows)) and whole.depth == G.tree_depth(len(set(rows)), 20) > 1
    assert name(df.repartition(7).orderBy(F.rand(3))).content_id == whole.content_id
    assert name(df.unionByName(df.limit(1))).content_id != whole.content_id  # a row once more
    assert name(df.withColumn("s", F.coalesce("s", F.lit("-")))).content_id != whole.content_id  # null is no dash
    assert name(df, cols=("s", "k", "f")).content_id != whole.content_id
    assert name(df.where("k < 0")).n_rows == 0
    a = spark.createDataFrame([("ab", "c")], "x string, y string")
    b = spark.createDataFrame([("a", "bc")], "x string, y string")
    assert name(a, cols=("x", "y")).content_id != name(b, cols=("x", "y")).content_id
    release = lambda config, d: {r.release_id for r in G.release_id(config, {"in": (d, ["k", "s", "f"]), "also": (a, ["x"])}).collect()}
    assert release({"w": 1, "v": [2]}, df) == release({"v": [2], "w": 1}, df.repartition(3)) and len(release({}, df)) == 1
    assert release({"w": 1}, df) != release({"w": 2}, df) and release({"w": 1}, df) != release({"w": 1}, df.where("k > 0"))


def test_fronts_equal_all_pairs(spark):
    rng = random.Random(2)
    rows = [(u, k, round(rng.random(), 2), round(rng.random(), 2), float(rng.randrange(3))) for u in (1, 2, None) for k in range(150)]
    rows += [(1, 900, None, 0.5, 1.0), (1, 901, 0.99, 0.99, 2.0), (1, 902, 0.99, 0.99, 2.0)]
    names, eps = ["a", "b", "c"], 0.015
    got = {(r.u, r.k) for r in A.pareto(spark.createDataFrame(rows, "u long, k long, a double, b double, c double"), "u", "k", names, eps, block=16).collect()}

    def beaten(x):
        return any(y[0] == x[0] and None not in y[2:] and None not in x[2:] and all(q >= p - eps for p, q in zip(x[2:], y[2:])) and any(q > p + eps for p, q in zip(x[2:], y[2:])) for y in rows)

    assert got == {(r[0], r[1]) for r in rows if not beaten(r)}


def test_ranks_of_crowded_values(spark):
    values = [1e-300, 1e300, float("inf"), 0.0] + [k / 1e6 for k in range(500)] + [0.25] * 200 + [None]
    df = spark.createDataFrame([("g" if k % 2 else None, v) for k, v in enumerate(values)], "g string, v double")
    got = {(r.g, r.v): r.v_rank for r in A.value_ranks(df, "v", ["g"]).collect()}
    for g in ("g", None):
        held = sorted(v for k, v in enumerate(values) if v is not None and ("g" if k % 2 else None) == g)
        for v in set(held):
            at = [k + 1 for k, x in enumerate(held) if x == v]
            assert got[g, v] == sum(at) / len(at)


def test_redundancy_classes_and_nearest(spark):
    layers = {"a": "P", "b": "P", "c": "C", "d": "C", "e": "T"}
    rho = {("a", "b"): 0.9, ("a", "c"): -0.85, ("b", "c"): 0.2, ("c", "d"): 0.5, ("d", "e"): 0.1, ("a", "d"): None, ("a", "e"): 0.3, ("b", "d"): 0.35, ("b", "e"): 0.0, ("c", "e"): 0.9}
    rows = [(f"{x}|{y}", v, 0.1 if (x, y) == ("c", "e") else 0.6) for (x, y), v in rho.items()]
    found = P.classify(spark.createDataFrame(rows, "pair string, spearman double, jaccard double"), layers, 0.8, 0.3, 0.5)
    kinds = {r.pair: (r["class"], r.collision) for r in found.collect()}
    assert kinds["a|b"] == ("redundant", False) and kinds["a|c"] == ("redundant", True) and kinds["a|d"] == ("undefined", False)
    assert kinds["c|e"] == ("related", True) and kinds["b|c"] == ("distinct", False) and kinds["c|d"] == ("related", False)
    classes = {r.indicator: (r.class_root, r.class_size) for r in P.redundancy_classes(found, list(layers)).collect()}
    assert classes == {"a": ("a", 3), "b": ("a", 3), "c": ("a", 3), "d": ("d", 1), "e": ("e", 1)}
    near = {r.indicator: (r.own_other, r.far_other) for r in P.nearest(found).collect()}
    assert near["a"] == ("b", "c") and near["d"] == ("c", "b") and near["e"] == (None, "c")


def test_resampled_clusters(spark):
    rows = [(e, k, float(e % 5), float(3 + e % 7)) for e in range(40) for k in (1, 2)]
    counts = spark.createDataFrame(rows, "e long, k long, a double, b double")
    reps = A.cluster_bootstrap(counts, "e", ["a", "b"], ["k"], 200, 3)
    again = A.cluster_bootstrap(counts.repartition(9), "e", ["a", "b"], ["k"], 200, 3)
    assert sorted(map(tuple, reps.collect())) == sorted(map(tuple, again.collect()))
    held = reps.where("k = 1 and replicate >= 0").collect()
    assert len(held) == 200
    unit = A.cluster_bootstrap(counts.withColumn("one", F.lit(1)), "e", ["one"], ["k"], 50, 3).where("replicate >= 0").collect()
    assert {r.one for r in unit} == {40}  # as many draws as clusters, in every replicate
    got = {(r.k, r.estimate): r for r in A.bootstrap_intervals(reps, ["k"], {"ratio": F.col("a") / F.col("b"), "never": F.lit(None)}).collect()}
    ratio, ordered = got[1, "ratio"], sorted(r.a / r.b for r in held)
    assert ratio.observed == pytest.approx(sum(r[2] for r in rows if r[1] == 1) / sum(r[3] for r in rows if r[1] == 1))
    assert ordered[4] <= ratio.low <= ordered[5] and ordered[194] <= ratio.high <= ordered[195] and ratio.low < ratio.observed < ratio.high
    assert got[1, "never"].n_defined == 0 and got[1, "never"].low is None


def test_score_queries_run_from_another_folder(tmp_path):
    """Executors get no copy of the package: functions travel by value."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from panelwright import catalog
print("rows", catalog.queries()["sc01_strict_past_percentile"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 5334" in done.stdout, done.stderr[-2000:]
