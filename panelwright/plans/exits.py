"""Queries over chains of requests and how their intervals end, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators import exits as X
from panelwright.operators import requests as DY
from panelwright.plans import requests as _requests  # noqa: F401  its SQL steps are built upon
from panelwright.plans.metrics import DIMENSIONS, dimension_rows, wide_dims
from panelwright.plans.sql import STEPS, query, step
from panelwright.plans.states import streak_steps, text_dates
from panelwright.plans.statistics import rounded
from panelwright.sources.scratch import written

#: From strict to loose: the same dimensions and confirmation length, thresholds that widen.
CHAIN = {f"pc_{q // 100}": ({"P": q, "C": q}, 2) for q in (2000, 3000, 4000, 5000)}
LEVEL = {name: k for k, name in enumerate(CHAIN, 1)}
TOP = len(CHAIN)
REASONS = ["state_unknown", "state_diagnostic_required", "state_blocked"]
HORIZONS = (5, 20)


class Chain:
    """States, daily rows and intervals of all requests, each written once for the queries that read them more than once."""

    def __init__(self, spark, d: str) -> None:
        self.requests = DY.request_table(spark, CHAIN)
        scores = written(wide_dims(spark, d, {x: DIMENSIONS[x] for x in "PC"}), "chain-scores")
        self.states = DY.dimension_states(dimension_rows(scores), self.requests)
        self.daily = written(DY.joint_confirm(DY.joint(scores, CHAIN)), "chain-days")

    def intervals(self) -> DataFrame:
        return DY.joint_intervals(self.daily)

    def days(self) -> DataFrame:
        return X.interval_days(self.daily, LEVEL)

    def wide(self) -> DataFrame:
        return written(X.day_levels(self.days(), TOP), "chain-wide")

    def margins(self) -> DataFrame:
        return written(X.endpoint_margins(self.intervals(), self.states, self.requests), "chain-margins")

    def classes(self) -> DataFrame:
        return X.exit_classes(X.endpoint_margins(self.intervals(), self.states, self.requests))


def _tables(spark, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    wide = Chain(spark, d).wide()
    return X.parent_structure(wide, TOP), X.child_structure(wide, TOP), wide.withColumnRenamed(f"no_{TOP}", "parent_no")


def _faulty(spark, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same tables with faults: shell days of every fifth entity, trailing days of every seventh, days of every eleventh twice."""
    parents, children, identities = _tables(spark, d)
    parents = parents.withColumn("shell_days", F.col("shell_days") + (F.col("security_id") % 5 == 0).cast("long"))
    children = children.withColumn("trailing_shell_days", F.col("trailing_shell_days") + (F.col("security_id") % 7 == 0).cast("long"))
    return parents, children, identities.unionByName(identities.where("security_id % 11 = 0"))


def _parents_of_weeks(spark, d: str) -> DataFrame:
    """Scattered day sets: a child is what a user did on one weekday of a month, a parent a month or a whole quarter of days (they overlap)."""
    from panelwright.plans.states import spine

    days = spine(spark, d).where("raw_state").select("security_id", F.col("trading_date"), F.month("trading_date").alias("m"), F.dayofweek("trading_date").alias("w"))
    child = days.select("security_id", "trading_date", (F.col("m") * 10 + F.col("w")).alias("child_no"))
    month = days.select("security_id", "trading_date", F.col("m").alias("parent_no"))
    late = days.where("day(trading_date) > 14").select("security_id", "trading_date", (F.lit(100) + F.col("m")).alias("parent_no"))
    return X.map_parent(child, month.unionByName(late), ["security_id"], "child_no", "parent_no", "trading_date")


def queries() -> dict:
    def reentry(s, d):
        c = Chain(s, d)
        return rounded(X.reentry_rates(DY.reentries(c.intervals(), c.daily, HORIZONS)))

    def structure(s, d):
        parents, children, _ = _tables(s, d)
        return rounded(X.structure_summary(parents, children, TOP))

    return {
        "ex02_endpoints": lambda s, d: text_dates(Chain(s, d).margins().drop("dimension_state")),
        "ex05_chain_parents": lambda s, d: X.chain_parents(Chain(s, d).days()),
        "ex05_scattered_parents": lambda s, d: text_dates(_parents_of_weeks(s, d)),
        "ex06_parent_structure": lambda s, d: _tables(s, d)[0],
        "ex06_child_structure": lambda s, d: _tables(s, d)[1],
        "ex06_day_identities": lambda s, d: _tables(s, d)[2].groupBy("identity").agg(F.count("*").alias("n_days"), F.count_distinct("security_id").alias("n_entities")),
        "ex07_margin_profile": lambda s, d: rounded(X.margin_profile(Chain(s, d).margins(), ["request_id"])),
        "ex07_classes_by_year": lambda s, d: Chain(s, d).classes().join(Chain(s, d).intervals().select("request_id", "security_id", "interval_no", F.year("last_observed_date").alias("year")), ["request_id", "security_id", "interval_no"]).groupBy("request_id", "primary_class", F.col("year").cast("long").alias("year")).agg(F.count("*").alias("n"), F.count_distinct("security_id").alias("n_entities")),
        "ex08_terminations": lambda s, d: rounded(X.termination_summary(Chain(s, d).classes())),
        "ex08_quality_reasons": lambda s, d: rounded(X.quality_reasons(Chain(s, d).classes(), REASONS)),
        "ex08_false_margins": lambda s, d: rounded(_false_margins(s, d)),
        "ex08_reentry_rates": reentry,
        "ex08_structure": structure,
        "ex08_concentration": lambda s, d: rounded(X.concentration(Chain(s, d).classes(), "security_id", ["request_id", "primary_class"])),
        "ex09_checks": lambda s, d: X.structure_checks(X.structure_rules(*_tables(s, d), TOP)),
        "ex09_planted_faults": lambda s, d: X.structure_anomalies(X.structure_rules(*_faulty(s, d), TOP)),
    }


def _false_margins(spark, d: str) -> DataFrame:
    c = Chain(spark, d)
    margins = c.margins()
    classes = X.exit_classes(margins).where("primary_class = 'raw_false'").select("request_id", "security_id", "interval_no", "false_class")
    return X.margin_profile(margins.join(classes, ["request_id", "security_id", "interval_no"]), ["request_id", "false_class"])


_rows = ", ".join(f"('{r}', '{x}', {q}, {k}, {len(t)}, {LEVEL[r]})" for r, (t, k) in CHAIN.items() for x, q in sorted(t.items()))
step("cq_reqs", f"select * from (values {_rows}) v(request_id, dimension, q_bp, k, n_dimensions, level)")
for _name in ("dim", "joint"):
    step(f"cq_{_name}", STEPS[f"dy_{_name}"].replace("reqs", "cq_reqs").replace("dy_dim", "cq_dim"))
streak_steps("cq", "cq_joint")
step("cq_ints", STEPS["dy_ints"].replace("dy_int", "cq_int").replace("reqs", "cq_reqs"))
step(
    "cq_days",
    """select q.level, r.request_id, r.sid as security_id, r.trading_date, seq as observation_sequence, sum((streak = kk)::int) over w as interval_no, streak >= kk as confirmed
from (select *, row_number() over (partition by security_id order by trading_date) - 1 as seq from cq_run) r join (select distinct request_id, level from cq_reqs) q using (request_id)
window w as (partition by r.security_id order by trading_date)""",
)
step("cq_held", "select * from cq_days where confirmed")
_numbers = ", ".join(f"max(case when level = {k} then interval_no end)::bigint as no_{k}" for k in range(1, TOP + 1))
_labels = list(X.IDENTITIES)
step("cq_wide", f"select * from (select security_id, observation_sequence, {_labels}[min(level)] as identity, {_numbers} from cq_held group by 1, 2) where no_{TOP} is not null")
_insides = ", ".join(f"count(no_{k}) as days_{k}" for k in range(1, TOP))
step(
    "cq_parent",
    f"""select security_id, no_{TOP} as parent_no, count(*) as parent_days, {_insides}, count(*) filter (no_{TOP - 1} is null) as shell_days,
  count(distinct no_{TOP - 1}) as n_children, count(distinct no_{TOP - 1}) > 1 as fragmented, count(no_{TOP - 1}) = count(*) as equals_parent from cq_wide group by 1, 2""",
)
_beside = lambda a, b: f"(select count(*) from cq_wide w where w.security_id = c.security_id and w.no_{TOP} = c.parent_no and w.no_{TOP - 1} is null and {a} and not exists (select 1 from cq_wide x where x.security_id = c.security_id and x.no_{TOP} = c.parent_no and x.no_{TOP - 1} is not null and {b}))"
step(
    "cq_child",
    f"""select *, leading_shell_days + trailing_shell_days as adjacent_shell_days, count(*) over (partition by security_id, parent_no) - 1 as n_siblings from (
  select security_id, parent_no, child_no, child_days, {", ".join(f"days_{k}, intervals_{k}" for k in range(1, TOP - 1))},
    {_beside("w.observation_sequence < c.lo", "x.observation_sequence > w.observation_sequence and x.observation_sequence < c.lo")} as leading_shell_days,
    {_beside("w.observation_sequence > c.hi", "x.observation_sequence < w.observation_sequence and x.observation_sequence > c.hi")} as trailing_shell_days
  from (select security_id, no_{TOP} as parent_no, no_{TOP - 1} as child_no, count(*) as child_days, min(observation_sequence) as lo, max(observation_sequence) as hi,
      {", ".join(f"count(no_{k}) as days_{k}, count(distinct no_{k}) as intervals_{k}" for k in range(1, TOP - 1))}
    from cq_wide where no_{TOP - 1} is not null group by 1, 2, 3) c)""",
)
_known = "coalesce(m.validity_status = 'valid' and score_mean is not null and score_min is not null, false)"
_main, _weak = "score_mean < 1 - q_bp / 10000 - 1e-12", "score_min < 1 - q_bp / 10000 - 0.1 - 1e-12"
step(
    "cq_margin",
    f"""select i.request_id, i.sid as security_id, interval_no, is_open, termination_reason, endpoint, i.at as trading_date, r.dimension, dimension_state,
  score_mean - (1 - r.q_bp / 10000) as mean_margin, score_min - (1 - r.q_bp / 10000 - 0.1) as min_margin,
  case when score_mean is not null and score_min is not null then least(score_mean - (1 - r.q_bp / 10000), score_min - (1 - r.q_bp / 10000 - 0.1)) end as active_margin,
  case when not {_known} then 'NOT_EVALUABLE' when {_main.replace('q_bp', 'r.q_bp')} and {_weak.replace('q_bp', 'r.q_bp')} then 'MAIN_AND_WEAK_FAIL' when {_main.replace('q_bp', 'r.q_bp')} then 'MAIN_ONLY_FAIL' when {_weak.replace('q_bp', 'r.q_bp')} then 'WEAK_ONLY_FAIL' else 'NO_GATE_FAIL' end as gate
from (select *, 'last_confirmed' as endpoint, case when is_open then last_observed_date else interval_end_date end as at from cq_ints
  union all select *, 'termination', case when not is_open then last_observed_date end from cq_ints) i
join cq_reqs r using (request_id) left join cq_dim m on m.request_id = i.request_id and m.dimension = r.dimension and m.security_id = i.sid and m.trading_date = i.at""",
)
step(
    "cq_class",
    """select *, case when primary_class = 'raw_false' then failed end as false_class from (
  select request_id, security_id, interval_no, any_value(termination_reason) as termination_reason, coalesce(string_agg(case when not dimension_state then dimension end, '+' order by dimension), '') as failed,
    case when any_value(is_open) then 'right_censored' when any_value(termination_reason) = 'state_false' then 'raw_false' else 'quality' end as primary_class
  from cq_margin where endpoint = 'termination' group by 1, 2, 3)""",
)


def _rounded_index(value: str, p: float) -> str:
    """The value whose place is (n - 1) p, rounded half to even, as SQL over a list of a group's values."""
    return f"list_sort(list({value}) filter ({value} is not null))[cast(round_even((count({value}) - 1) * {p}, 0) as bigint) + 1]"


def _margin_sql(source: str, by: str) -> str:
    gates = ", ".join(f"count(*) filter (gate = '{g}') as {g.lower()}" for g in ("MAIN_ONLY_FAIL", "WEAK_ONLY_FAIL", "MAIN_AND_WEAK_FAIL", "NO_GATE_FAIL", "NOT_EVALUABLE"))
    spread = ", ".join(f"round({_rounded_index('value', p)}, 6) as p{round(p * 100):02d}" for p in (0.05, 0.5, 0.95))
    return f"""select {by}, endpoint, dimension, margin, count(*) as n, count(value) as n_finite, count(*) - count(value) as n_null, round(avg(value), 6) as mean, round(min(value), 6) as least, {spread}, round(max(value), 6) as greatest,
  coalesce(min(value) = max(value), false) as constant, coalesce(max(abs(value)) <= 1e-12, false) as all_zero, {gates}
from ({" union all ".join(f"select *, '{m}' as margin, {m} as value from ({source})" for m in X.MARGINS)}) group by {by}, endpoint, dimension, margin"""


def _rules_sql(parents: str, children: str, identities: str, detail: bool) -> str:
    """The rules of the structure as rows (rule, key, left, right, broken), summed or listed."""
    p, c = "concat_ws('|', security_id, parent_no)", "concat_ws('|', security_id, parent_no, child_no)"
    names = [*[f"days_{k}" for k in range(1, TOP)], "parent_days"]
    rows = [f"select 'shell_days_conserved' as rule, {p} as row_key, shell_days as l, parent_days - days_{TOP - 1} as r, shell_days <> parent_days - days_{TOP - 1} as bad from ({parents})"]
    rows += [f"select '{a}_within_{b}', {p}, {a}, {b}, {a} > {b} from ({parents})" for a, b in zip(names, names[1:])]
    both = "leading_shell_days + trailing_shell_days"
    rows.append(f"select 'adjacent_days_conserved', {c}, adjacent_shell_days, {both}, adjacent_shell_days <> {both} from ({children})")
    rows.append(f"select 'children_as_counted', {p}, coalesce(n, 0), coalesce(n_children, 0), coalesce(n, 0) <> coalesce(n_children, 0) from (select security_id, parent_no, count(*) as n from ({children}) group by 1, 2) full join (select security_id, parent_no, n_children from ({parents})) using (security_id, parent_no)")
    rows.append(f"select 'day_identity_unique', concat_ws('|', security_id, observation_sequence, no_{TOP}), count(*), 1, count(*) <> 1 from ({identities}) group by security_id, observation_sequence, no_{TOP}")
    rows.append(f"select 'identity_days_conserved', {p}, coalesce(n, 0), coalesce(parent_days, 0), coalesce(n, 0) <> coalesce(parent_days, 0) from (select security_id, no_{TOP} as parent_no, count(*) as n from ({identities}) group by 1, 2) full join (select security_id, parent_no, parent_days from ({parents})) using (security_id, parent_no)")
    rows.append(f"select 'identity_known', concat_ws('|', security_id, observation_sequence, no_{TOP}), 0, 1, coalesce(not list_contains({_labels}, identity), true) from ({identities})")
    every = " union all ".join(rows)
    if detail:
        return f"select rule, row_key, l::double as left_value, r::double as right_value from ({every}) where bad"
    return f"select rule, count(*) as n_rows, count(*) filter (bad) as n_broken, coalesce(sum(l), 0)::bigint as left_sum, coalesce(sum(r), 0)::bigint as right_sum, case when count(*) filter (bad) = 0 then 'ok' else 'anomaly' end as status from ({every}) group by 1"


def oracle_sql() -> dict[str, str]:
    share = "round(n / sum(n) over (partition by request_id), 6) as share, round(n / sum(n) over (partition by request_id, primary_class), 6) as share_of_class"
    reasons = " union all ".join(f"select '{r}' as reason" for r in REASONS)
    beside = ", ".join(f"sum(days_{k})::bigint as days_{k}" for k in range(1, TOP))
    lags = """select i.request_id, i.sid, interval_no, min(case when r.raw_state then r.n end) - max(e.n) as t, min(case when r.raw_state is null then r.n end) - max(e.n) as q, count(r.n) as l
  from (select * from cq_ints where termination_reason = 'state_false') i
  join (select *, row_number() over (partition by security_id order by trading_date) as n from cq_joint) e on e.security_id = i.security_id and e.trading_date = i.last_observed_date
  left join (select security_id, raw_state, row_number() over (partition by security_id order by trading_date) as n from cq_joint) r on r.security_id = i.security_id and r.n > e.n group by 1, 2, 3"""
    outcome = "case when coalesce(t <= threshold, false) and coalesce(t < q, t is not null) then 're_entered' when coalesce(q <= threshold, false) then 'interrupted' when l < threshold then 'insufficient' else 'none' end"
    faulty_parents = "select * replace (shell_days + (security_id % 5 = 0)::int as shell_days) from cq_parent"
    faulty_children = "select * replace (trailing_shell_days + (security_id % 7 = 0)::int as trailing_shell_days) from cq_child"
    return {
        "ex02_endpoints": query("select request_id, security_id, interval_no, is_open, termination_reason, endpoint, cast(trading_date as varchar) as trading_date, dimension, round(mean_margin, 9) as mean_margin, round(min_margin, 9) as min_margin, round(active_margin, 9) as active_margin, gate from cq_margin"),
        "ex05_chain_parents": query(f"""select level, security_id, child_no, n_days, n_parents, case when n_parents = 1 then parent_no end as parent_no, case n_parents when 1 then 'unique' when 0 then 'none' else 'ambiguous' end as mapping from (
  select c.level, c.security_id, c.child_no, c.n as n_days, count(p.parent_no) as n_parents, min(p.parent_no) as parent_no
  from (select level, security_id, interval_no::bigint as child_no, count(*) as n, list(observation_sequence) as days from cq_held where level < {TOP} group by 1, 2, 3) c
  left join (select level - 1 as level, security_id, interval_no::bigint as parent_no, list(observation_sequence) as days from cq_held group by 1, 2, 3) p on p.level = c.level and p.security_id = c.security_id and list_has_all(p.days, c.days) group by 1, 2, 3, 4)"""),
        "ex05_scattered_parents": query("""select security_id, child_no, n_days, n_parents, case when n_parents = 1 then parent_no end as parent_no, case n_parents when 1 then 'unique' when 0 then 'none' else 'ambiguous' end as mapping from (
  select c.security_id, c.child_no, len(c.days) as n_days, count(p.parent_no) as n_parents, min(p.parent_no) as parent_no
  from (select security_id, month(trading_date) * 10 + dayofweek(trading_date) + 1 as child_no, list(trading_date) as days from uspine where raw_state group by 1, 2) c
  left join (select security_id, month(trading_date) as parent_no, list(trading_date) as days from uspine where raw_state group by 1, 2
    union all select security_id, 100 + month(trading_date), list(trading_date) from uspine where raw_state and day(trading_date) > 14 group by 1, 2) p on p.security_id = c.security_id and list_has_all(p.days, c.days) group by 1, 2, 3)"""),
        "ex06_parent_structure": query("select * from cq_parent"),
        "ex06_child_structure": query("select * from cq_child"),
        "ex06_day_identities": query("select identity, count(*) as n_days, count(distinct security_id) as n_entities from cq_wide group by 1"),
        "ex07_margin_profile": query(_margin_sql("select * from cq_margin", "request_id")),
        "ex07_classes_by_year": query("select c.request_id, primary_class, year(last_observed_date) as year, count(*) as n, count(distinct c.security_id) as n_entities from cq_class c join cq_ints i on i.request_id = c.request_id and i.sid = c.security_id and i.interval_no = c.interval_no group by 1, 2, 3"),
        "ex08_terminations": query(f"select *, {share} from (select request_id, primary_class, coalesce(false_class, '-') as false_class, count(*) as n from cq_class group by 1, 2, 3)"),
        "ex08_quality_reasons": query(f"select request_id, reason, n, round(n / nullif(nq, 0), 6) as share_of_quality, round(n / na, 6) as share_of_all from (select request_id, reason, count(*) as na, count(*) filter (primary_class = 'quality') as nq, count(*) filter (primary_class = 'quality' and termination_reason = reason) as n from cq_class cross join ({reasons}) group by 1, 2)"),
        "ex08_false_margins": query(_margin_sql("select m.*, c.false_class from cq_margin m join cq_class c using (request_id, security_id, interval_no) where c.primary_class = 'raw_false'", "request_id, false_class")),
        "ex08_reentry_rates": query(f"""select *, n_re_entered + n_none as n_observable, round((n_re_entered + n_none) / n_exits, 6) as coverage, round(n_re_entered / nullif(n_re_entered + n_none, 0), 6) as reentry_rate, n_exits = n_re_entered + n_none + n_interrupted + n_insufficient as conserved
from (select request_id, threshold, count(*) as n_exits, {", ".join(f"count(*) filter (outcome = '{o}') as n_{o}" for o in ("re_entered", "none", "interrupted", "insufficient"))}, round(avg(t), 6) as mean_lag
  from (select *, {outcome} as outcome from ({lags}) cross join (select unnest({list(HORIZONS)}) as threshold)) group by 1, 2)"""),
        "ex08_structure": query(f"""select * from (select count(*) as n_parents, sum(parent_days)::bigint as parent_days, {beside}, sum(shell_days)::bigint as shell_days, count(*) filter (n_children = 0) as n_childless, count(*) filter (fragmented) as n_fragmented,
  count(*) filter (equals_parent) as n_equal, max(n_children) as most_children, round(max(shell_days / parent_days), 6) as largest_shell_share from cq_parent)
cross join (select count(*) as n_children, sum(leading_shell_days)::bigint as leading_shell_days, sum(trailing_shell_days)::bigint as trailing_shell_days, count(*) filter (n_siblings > 0) as n_with_siblings, max(adjacent_shell_days) as most_adjacent_days from cq_child)"""),
        "ex08_concentration": query(f"select request_id, primary_class, sum(n)::bigint as n_intervals, count(*) as n_entities, max(n) as most, arg_min(security_id, (-n, security_id)) as top_entity, {_rounded_index('n', 0.5)}::double as p50, {_rounded_index('n', 0.95)}::double as p95, round(max(n) / sum(n), 6) as top_share from (select request_id, primary_class, security_id, count(*) as n from cq_class group by 1, 2, 3) group by 1, 2"),
        "ex09_checks": query(_rules_sql("select * from cq_parent", "select * from cq_child", "select * from cq_wide", False)),
        "ex09_planted_faults": query(_rules_sql(faulty_parents, faulty_children, "select * from cq_wide union all select * from cq_wide where security_id % 11 = 0", True)),
    }
