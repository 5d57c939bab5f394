"""Queries over the stability of steps, lags and states, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators import pairs as P
from panelwright.operators import stability as Y
from panelwright.operators import states as ST
from panelwright.plans.metrics import DIMENSIONS, wide_dims
from panelwright.plans.sql import query, step
from panelwright.plans.states import DIMS, QS, nested
from panelwright.plans.statistics import _ASSOC, rounded

LAGS = [1, 3, 5, 10, 20]
STATES = [f"s{i + 1}" for i in range(len(DIMS))]
LEVELS = {f"q{round(q * 10000)}": q for q in QS}
NEXT = list(zip(list(LEVELS), list(LEVELS)[1:]))


def _cells(spark, d: str) -> DataFrame:
    return Y.step_cells(P.steps(nested(spark, d), DIMS))


def _state_years(spark, d: str) -> DataFrame:
    """(state, year, n_known, n_true) of the nested states."""
    wide = nested(spark, d).groupBy(F.year("trading_date").alias("year")).agg(*[c for s in STATES for c in (F.count(s).alias(f"{s}_known"), F.count_if(s).alias(f"{s}_true"))])
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.col(f"{s}_known").alias("n_known"), F.col(f"{s}_true").alias("n_true")) for s in STATES])).alias("r")
    return wide.select("year", rows).select("r.state", "year", "r.n_known", "r.n_true")


def _lags(spark, d: str) -> DataFrame:
    return Y.lag_cells(nested(spark, d), DIMS[0], DIMS[1:], LAGS)


def _crosstab(spark, d: str) -> DataFrame:
    scores = wide_dims(spark, d, {DIMS[0]: DIMENSIONS[DIMS[0]]})
    levels = scores.select("security_id", "trading_date", *[ST.weak_state(F.lit(q), of=f"{DIMS[0]}.").alias(n) for n, q in LEVELS.items()])
    return Y.transition_crosstab(levels, NEXT)


def queries() -> dict:
    return {
        "as11_step_profile": lambda s, d: rounded(Y.step_profile(_cells(s, d))),
        "as13_step_years": lambda s, d: rounded(Y.step_years(_cells(s, d))),
        "as13_step_securities": lambda s, d: rounded(Y.step_securities(_cells(s, d))),
        "as18_lag_effects": lambda s, d: rounded(Y.lag_effects(_lags(s, d))),
        "as19_lag_baselines": lambda s, d: rounded(Y.lag_baselines(_lags(s, d))),
        "as22_lag_years": lambda s, d: rounded(Y.lag_effects(_lags(s, d), ["year"])),
        "as22_lag_securities": lambda s, d: rounded(Y.lag_securities(_lags(s, d))),
        "as22_transition_crosstab": _crosstab,
        "yr05_state_concentration": lambda s, d: rounded(Y.state_years(_state_years(s, d))),
        "yr06_states_without_year": lambda s, d: rounded(Y.states_without_year(_state_years(s, d))),
        "yr06_steps_without_year": lambda s, d: rounded(Y.steps_without_year(_cells(s, d))),
    }


def _side(x: str, about: str = "0") -> str:
    return f"case when abs({x} - {about}) <= 1e-12 then 0 else sign({x} - {about}) end"


def _turn(now: str, before: str) -> str:
    return f"case when {now} is null then 'invalid' when {before} is null then 'other' when {now} and not {before} then 'onset' when {now} then 'continuing' when {before} then 'exit' else 'stay_out' end"


_SUMS = ", ".join(f"sum({c})::bigint as {c}" for c in Y.CELLS)
_PLAIN = "n11 / nullif(n11 + n10, 0) as b_given_a, n11 / nullif(n11 + n10, 0) / nullif((n11 + n01) / nullif(n11 + n10 + n01 + n00, 0), 0) as lift, n11 / nullif(n11 + n10, 0) - (n11 + n01) / nullif(n11 + n10 + n01 + n00, 0) as delta, n11 + n10 + n01 + n00 as days"
_W = "window w as (partition by security_id order by trading_date)"

step("sb_rows", " union all ".join(f"select '{''.join(DIMS[:k])}_to_{DIMS[k]}' as step, year(trading_date) as year, security_id, {' and '.join(DIMS[:k])} as a, {DIMS[k]} as t from st_nested where {' and '.join(f'{c} is not null' for c in DIMS[: k + 1])}" for k in range(1, len(DIMS))))
step("sb_cells", "select step, year, security_id, count(*) filter (a and t) as n11, count(*) filter (a and not t) as n10, count(*) filter (not a and t) as n01, count(*) filter (not a and not t) as n00 from sb_rows group by all")
step("sb_pool", f"select *, {_PLAIN} from (select step, {_SUMS} from sb_cells group by 1)")
step("sb_year", f"select *, days / sum(days) over (partition by step) as day_share, n11 / nullif(sum(n11) over (partition by step), 0) as joint_share from (select *, {_PLAIN} from (select step, year, {_SUMS} from sb_cells group by 1, 2))")
step("sb_sec", f"select *, {_PLAIN} from (select step, security_id, {_SUMS} from sb_cells group by 1, 2)")
step("sb_secl", "select step, unnest([{'measure': 'b_given_a', 'value': b_given_a, 'neutral': null::double}, {'measure': 'lift', 'value': lift, 'neutral': 1.0::double}, {'measure': 'delta', 'value': delta, 'neutral': 0.0::double}], recursive := true) from sb_sec")
step("sb_pooll", "select step, unnest([{'measure': 'b_given_a', 'pooled': b_given_a}, {'measure': 'lift', 'pooled': lift}, {'measure': 'delta', 'pooled': delta}], recursive := true) from sb_pool")
step("sb_state", " union all ".join(f"select '{s}' as state, year(trading_date) as year, count({s}) as n_known, count(*) filter ({s}) as n_true from st_nested group by 2" for s in STATES))
step("sb_kind", f"select security_id, trading_date, {', '.join(DIMS[1:])}, {_turn(DIMS[0], f'lag({DIMS[0]}) over w')} as kind, " + ", ".join(f"lead(trading_date, {k}) over w is not null as ahead{k}, " + ", ".join(f"lead({t}, {k}) over w as {t}{k}" for t in DIMS[1:]) for k in LAGS) + f" from st_nested {_W}")
step("sb_lag", " union all ".join(f"select '{DIMS[0]}_to_{t}' as path, {k} as k, year(trading_date) as year, security_id, kind, {t} as now, ahead{k} as ahead, {t}{k} as later from sb_kind" for t in DIMS[1:] for k in LAGS))


def _effects(by: str = "") -> str:
    """Raw effects by path, k and ``by``."""
    counts = ", ".join(
        f"count(*) filter (kind = '{kind}') as {s}_n, count(*) filter (kind = '{kind}' and ahead) as {s}_ahead, count(later) filter (kind = '{kind}') as {s}_valid, count(*) filter (kind = '{kind}' and later) as {s}_true, "
        f"count(*) filter (kind = '{kind}' and not ahead) as {s}_censored, count(*) filter (kind = '{kind}' and ahead and later is null) as {s}_invalid, count(*) filter (kind = '{kind}' and not later) as {s}_false"
        for s, kind in (("onset", "onset"), ("control", "stay_out"))
    )
    return f"""select *, p_onset - p_control as difference, p_onset / nullif(p_control, 0) as relative_lift, case when onset_valid < 1 or control_valid < 1 then 'insufficient' when p_control = 0 then 'baseline_zero' else 'defined' end as status
  from (select *, onset_true / nullif(onset_valid, 0) as p_onset, control_true / nullif(control_valid, 0) as p_control from (select path, k{by}, {counts} from sb_lag group by path, k{by}))"""


_ROUND = "replace (" + ", ".join(f"round({c}, 6) as {c}" for c in ("p_onset", "p_control", "difference", "relative_lift")) + ")"
step("sb_eff", _effects())


def oracle_sql() -> dict[str, str]:
    classes = " union all ".join(f"select '{a}' as lower, '{b}' as higher, {a} as lower_class, {b} as higher_class from turns" for a, b in NEXT)
    active = ", ".join(f"case when validity_status = 'valid' then score_mean + 1e-12 >= 1 - {q}::double and score_min + 1e-12 >= 1 - {q}::double - 0.1 end as {n}" for n, q in LEVELS.items())
    up, lift = _side("delta"), _side("lift", "1")
    return {
        "as11_step_profile": query(f"""select p.step, n11, n10, n01, n00, {_ASSOC}, n_years, n_years_up, n_years_down, n_years_undefined, round(top_year_share, 6) as top_year_share, round(median_year_delta, 6) as median_year_delta,
  case when {up} is null or {lift} is null then 'undefined' when {up} = 0 and {lift} = 0 then 'neutral' when {up} > 0 and {lift} > 0 then 'positive' when {up} < 0 and {lift} < 0 then 'negative' else 'mixed' end as direction,
  {up} = {_side('median_year_delta')} as median_agrees,
  concat_ws(',', case when lift >= 2 and abs(delta) < 0.02 then 'high_lift_low_delta' end, case when b_given_a >= 0.5 and abs(lift - 1) < 0.05 then 'high_retention_lift_near_one' end,
    case when (n11 + n01) / days < 0.02 and lift >= 2 then 'rare_target' end, case when n_years_up > 0 and n_years_down > 0 then 'years_disagree' end, case when top_year_share > 0.5 then 'one_year_rules' end) as warnings
from (select step, n11, n10, n01, n00, days, b_given_a, lift, delta from sb_pool) p
join (select step, count(*) as n_years, count(*) filter ({up} > 0) as n_years_up, count(*) filter ({up} < 0) as n_years_down, count(*) filter (delta is null) as n_years_undefined, max(day_share) as top_year_share, median(delta) as median_year_delta from sb_year group by 1) y using (step)"""),
        "as13_step_years": query(f"select step, year, n11, n10, n01, n00, {_ASSOC}, round(day_share, 6) as day_share, round(joint_share, 6) as joint_share from sb_year"),
        "as13_step_securities": query(f"""select s.*, round(pooled, 6) as pooled, {_side('pooled', 'neutral')} = {_side('m', 'neutral')} as same_side from (select * exclude (neutral, m) from (
  select step, measure, any_value(neutral) as neutral, count(*) as n_securities, count(value) as n_defined, round(avg(({_side('value', 'neutral')} > 0)::int), 6) as above_share, round(avg(({_side('value', 'neutral')} < 0)::int), 6) as below_share,
    round(quantile_cont(value, 0.25), 6) as q25, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.75), 6) as q75, quantile_cont(value, 0.5) as m from sb_secl group by 1, 2)) s
join (select step, measure, any_value(neutral) as neutral, quantile_cont(value, 0.5) as m from sb_secl group by 1, 2) using (step, measure) join sb_pooll using (step, measure)"""),
        "as18_lag_effects": query(f"select * {_ROUND} from sb_eff"),
        "as22_lag_years": query(f"select * {_ROUND} from ({_effects(', year')})"),
        "as22_lag_securities": query(f"""select s.*, round(difference, 6) as pooled, {_side('m')} = {_side('difference')} as same_side from (
  select path, k, count(*) filter (onset_n > 0) as n_securities, count(*) filter ({_side('difference')} = 1) as n_positive, count(*) filter ({_side('difference')} = -1) as n_negative, count(*) filter ({_side('difference')} = 0) as n_zero, round(median(difference), 6) as median
  from ({_effects(', security_id')}) group by 1, 2) s join (select path, k, median(difference) as m from ({_effects(', security_id')}) group by 1, 2) using (path, k) join (select path, k, difference from sb_eff) using (path, k)"""),
        "as22_transition_crosstab": query(f"""select lower, higher, lower_class, higher_class, count(*) as n from (with acts as (select security_id, trading_date, {active} from dim_scores where dimension = '{DIMS[0]}'),
turns as (select {', '.join(f"{_turn(n, f'lag({n}) over w')} as {n}" for n in LEVELS)} from acts {_W}) {classes}) group by all"""),
        "as19_lag_baselines": query(f"""select path, k, onset_valid, round(p_onset, 6) as p_onset, round(p_control, 6) as p_control, round(difference, 6) as difference, round(p_all, 6) as p_all, matched_onsets, round(p_matched, 6) as p_matched, round(p_status, 6) as p_status,
  round(p_strata, 6) as p_strata, strata_onsets, unmatched_strata, round(strata_coverage, 6) as strata_coverage, round(p_onset - p_all, 6) as over_all, round(p_matched - p_status, 6) as over_status, round(p_onset - p_strata, 6) as over_strata,
  round(matched_onsets / nullif(onset_valid, 0), 6) as status_coverage, coalesce({_side('difference')} <> {_side('(p_matched - p_status)')}, false) or coalesce({_side('difference')} <> {_side('(p_onset - p_strata)')}, false) as sign_conflict
from (select path, k, onset_valid, p_onset, p_control, difference from sb_eff) join (select path, k, count(*) filter (later) / nullif(count(later), 0) as p_all from sb_lag group by 1, 2) using (path, k)
left join (select path, k, sum(o)::bigint as matched_onsets, sum(t) / nullif(sum(o), 0) as p_matched, case when count(*) filter (o > 0 and c is null) = 0 then sum(o * c) / nullif(sum(o) filter (c is not null), 0) end as p_status
  from (select path, k, now, count(later) filter (kind = 'onset') as o, count(*) filter (kind = 'onset' and later) as t, count(*) filter (kind = 'stay_out' and later) / nullif(count(later) filter (kind = 'stay_out'), 0) as c from sb_lag where now is not null group by 1, 2, 3) group by 1, 2) using (path, k)
left join (select path, k, sum(o * c) / nullif(sum(o) filter (c is not null), 0) as p_strata, coalesce(sum(o) filter (c is not null), 0)::bigint as strata_onsets, count(*) filter (c is null) as unmatched_strata, coalesce(sum(o) filter (c is not null), 0) / nullif(sum(o), 0) as strata_coverage
  from (select path, k, year, security_id, count(later) filter (kind = 'onset') as o, count(*) filter (kind = 'stay_out' and later) / nullif(count(later) filter (kind = 'stay_out'), 0) as c from sb_lag group by 1, 2, 3, 4) where o > 0 group by 1, 2) using (path, k)"""),
        "yr05_state_concentration": query("""select state, count(*) as n_years, count(*) filter (n_true > 0) as n_years_true, sum(n_true)::bigint as n_true, round(sum(share * share), 6) as hhi, round(1 / sum(share * share), 6) as effective_years,
  round(sum(share) filter (place <= 1), 6) as top1, round(sum(share) filter (place <= 2), 6) as top2, min(year) filter (place = 1 and n_true > 0) as peak_year, round(min(cover), 6) as least_coverage, round(quantile_cont(cover, 0.25), 6) as coverage_q25,
  round(median(cover), 6) as coverage_median, round(quantile_cont(cover, 0.75), 6) as coverage_q75, round(max(cover), 6) as greatest_coverage, round(quantile_cont(cover, 0.75) - quantile_cont(cover, 0.25), 6) as coverage_iqr,
  case when sum(n_true) = 0 then 'never_true' when sum(share) filter (place <= 1) > 0.5 then 'one_year_rules' else 'spread' end as status
from (select *, n_true / nullif(sum(n_true) over (partition by state), 0) as share, n_true / nullif(n_known, 0) as cover, row_number() over (partition by state order by n_true desc, year) as place from sb_state) group by 1"""),
        "yr06_states_without_year": query("""select state, year, (a - n_true)::bigint as n_true_without, round((a - n_true) / nullif(b - n_known, 0), 6) as coverage_without, round(-n_true / nullif(a, 0), 6) as true_change,
  round(((a - n_true) / nullif(b - n_known, 0) - a / nullif(b, 0)) / nullif(a / nullif(b, 0), 0), 6) as coverage_change, round((s - n_true * n_true) / nullif((a - n_true) * (a - n_true), 0), 6) as hhi_without, round(n_known / nullif(b, 0), 6) as removed_day_share, round(n_true / nullif(a, 0), 6) as removed_true_share
from (select *, sum(n_true) over w as a, sum(n_known) over w as b, sum(n_true * n_true) over w as s from sb_state window w as (partition by state))"""),
        "yr06_steps_without_year": query(f"""select step, year, n11, n10, n01, n00, round(b_given_a, 6) as retention, round(lift, 6) as lift, round(delta, 6) as delta, round((days - pdays) / pdays, 6) as days_change, round((delta - pdelta) / nullif(abs(pdelta), 0), 6) as delta_change,
  round((pdays - days) / pdays, 6) as removed_day_share, round((p11 - n11) / nullif(p11, 0), 6) as removed_joint_share, {up} is distinct from {_side('pdelta')} as delta_flips, {lift} is distinct from {_side('plift', '1')} as lift_flips
from (select *, {_PLAIN} from (select y.step, year, {', '.join(f'(p.{c} - y.{c}) as {c}' for c in Y.CELLS)}, p.days as pdays, p.delta as pdelta, p.lift as plift, p.n11 as p11 from sb_year y join sb_pool p using (step)))"""),
    }
