"""Queries over dynamic requests and exits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators import requests as DY
from panelwright.plans.metrics import DIMENSIONS, wide_dims
from panelwright.plans.sql import query, step
from panelwright.plans.states import dim_scores, streak_steps, text_dates
from panelwright.plans.statistics import rounded

REQUESTS = {"pc": ({"P": 5000, "C": 5000}, 2), "pc_strict": ({"P": 3000, "C": 3000}, 2), "t": ({"T": 4000}, 3)}


def states(spark, d: str) -> DataFrame:
    return DY.dimension_states(dim_scores(spark, d), DY.request_table(spark, REQUESTS))


def scores(spark, d: str, more: tuple[str, ...] = ()) -> DataFrame:
    """The dimensions that requests name, side by side, and columns ``more`` of the prices."""
    return wide_dims(spark, d, {x: names for x, names in DIMENSIONS.items() if any(x in thresholds for thresholds, _ in REQUESTS.values())}, more)


def joint(spark, d: str) -> DataFrame:
    return DY.joint(scores(spark, d), REQUESTS)


def found(spark, d: str) -> DataFrame:
    return DY.request_intervals(scores(spark, d), REQUESTS)


def daily(spark, d: str) -> DataFrame:
    return DY.request_days(scores(spark, d), REQUESTS)


_rows = ", ".join(f"('{r}', '{x}', {q}, {k}, {len(t)})" for r, (t, k) in REQUESTS.items() for x, q in sorted(t.items()))
step("reqs", f"select * from (values {_rows}) v(request_id, dimension, q_bp, k, n_dimensions)")
step(
    "dy_dim",
    """select *, case when validity_status = 'valid' then score_mean + 1e-12 >= 1 - q_bp / 10000 and score_min + 1e-12 >= 1 - q_bp / 10000 - 0.1 end as dimension_state,
  case when validity_status = 'valid' then []::varchar[] else list_sort(list_distinct(list_transform(string_split(reason_codes, ','), lambda r: dimension || '_' || r))) end as reasons
from dim_scores join reqs using (dimension)""",
)
step(
    "dy_joint",
    """select request_id, k as kk, request_id || '|' || security_id as security_id, security_id as sid, trading_date, case when count(dimension_state) = max(n_dimensions) then bool_and(dimension_state) end as raw_state,
  ['valid', 'unknown', 'diagnostic_required', 'blocked'][1 + max(case validity_status when 'valid' then 0 when 'unknown' then 1 when 'diagnostic_required' then 2 else 3 end)] as validity_status,
  flatten(list(reasons order by dimension)) as reason_codes from dy_dim group by request_id, k, dim_scores_sid, trading_date""".replace("dim_scores_sid", "security_id"),
)
streak_steps("dy", "dy_joint")
step("dy_day", "select *, case when streak is not null then streak >= kk end as confirmed, coalesce(streak = kk, false) as confirmation_event from dy_run")
step("dy_ints", "select i.*, split_part(i.security_id, '|', 1) as request_id, split_part(i.security_id, '|', 2)::bigint as sid from dy_int i join (select distinct request_id, k from reqs) q on q.request_id = split_part(i.security_id, '|', 1) and q.k = i.k")
_D = "cast(trading_date as varchar) as trading_date"
_I = "interval_no, cast(raw_start_date as varchar) as raw_start_date, cast(confirmation_date as varchar) as confirmation_date, cast(interval_end_date as varchar) as interval_end_date, cast(last_observed_date as varchar) as last_observed_date, duration_raw_days, duration_confirmed_days, is_open, termination_reason"


def queries() -> dict:
    return {
        "dy02_dimension_states": lambda s, d: text_dates(states(s, d).select("request_id", "dimension", "security_id", "trading_date", "dimension_state", F.array_join("reasons", ",").alias("reasons"))),
        "dy03_joint_states": lambda s, d: text_dates(joint(s, d).withColumn("reason_codes", F.array_join("reason_codes", ","))),
        "dy04_joint_confirmation": lambda s, d: text_dates(daily(s, d).select("request_id", "security_id", "trading_date", "streak", "confirmed", "confirmation_event")),
        "dy05_joint_intervals": lambda s, d: text_dates(found(s, d)),
        "dy08_request_metrics": lambda s, d: daily(s, d).groupBy("request_id").agg(F.count_if("raw_state").alias("n_true"), F.count_if("confirmed").alias("n_confirmed"), F.count_if("confirmation_event").alias("n_events"), F.count_if(F.col("raw_state").isNull()).alias("n_unknown")),
        "dy09_path_metrics": lambda s, d: rounded(DY.request_paths(scores(s, d, DY.PRICES), REQUESTS)),
        "dy10_response_checks": lambda s, d: DY.response_checks(DY.joint_columns(scores(s, d), REQUESTS), "pc_strict", "pc"),
        "dy11_interval_structure": lambda s, d: rounded(DY.interval_structure(found(s, d), ["request_id"])),
        "dy13_hash_sample": lambda s, d: text_dates(DY.hash_sample(found(s, d), ["request_id"], ["security_id", "interval_no"], 5).select("request_id", "security_id", "interval_no", "sample_no", "sample_hash")),
        "ex01_exit_category": lambda s, d: DY.request_exits(scores(s, d), REQUESTS).groupBy("request_id", "exit_category").agg(F.count("*").alias("n")),
        "ex02_endpoint_margins": lambda s, d: text_dates(DY.endpoint_margins(found(s, d), states(s, d))),
        "ex03_reentries": lambda s, d: text_dates(DY.request_reentries(scores(s, d), REQUESTS, (5, 20))),
    }


def oracle_sql() -> dict[str, str]:
    hs = (5, 10, 20)
    ahead = lambda h: f"(w rows between 1 following and {h} following)"
    path = ", ".join(f"case when count(*) over {ahead(h)} = {h} then round({e}, 6) end as {n}_{h}" for h in hs for n, e in (("return", f"lead(adjusted_close, {h}) over w / adjusted_close - 1"), ("mfe", f"max(adjusted_high) over {ahead(h)} / adjusted_close - 1"), ("mae", f"min(adjusted_low) over {ahead(h)} / adjusted_close - 1")))
    names = ", ".join(f"{n}_{h}" for h in hs for n in ("return", "mfe", "mae"))
    return {
        "dy02_dimension_states": query(f"select request_id, dimension, security_id, {_D}, dimension_state, array_to_string(reasons, ',') as reasons from dy_dim"),
        "dy03_joint_states": query(f"select request_id, kk as k, sid as security_id, {_D}, raw_state, validity_status, array_to_string(reason_codes, ',') as reason_codes from dy_joint"),
        "dy04_joint_confirmation": query(f"select request_id, sid as security_id, {_D}, streak, confirmed, confirmation_event from dy_day"),
        "dy05_joint_intervals": query(f"select request_id, sid as security_id, {_I} from dy_ints"),
        "dy08_request_metrics": query("select request_id, count(*) filter (raw_state) as n_true, count(*) filter (confirmed) as n_confirmed, count(*) filter (confirmation_event) as n_events, count(*) filter (raw_state is null) as n_unknown from dy_day group by 1"),
        "dy09_path_metrics": query(f"select request_id, i.sid as security_id, interval_no, cast(p.trading_date as varchar) as trading_date, {names} from dy_ints i join (select security_id, trading_date, {path} from pday window w as (partition by security_id order by trading_date)) p on p.security_id = i.sid and p.trading_date = i.confirmation_date"),
        "dy10_response_checks": query("select count(*) filter (a and not b) as n_violations, count(*) filter (b and not a) as n_added from (select sid, trading_date, coalesce(bool_or(raw_state) filter (request_id = 'pc_strict'), false) as a, coalesce(bool_or(raw_state) filter (request_id = 'pc'), false) as b from dy_joint group by 1, 2)"),
        "dy11_interval_structure": query("select request_id, count(*) as n_entities, round(avg(n), 6) as mean_n, round(quantile_cont(n, 0.5), 6) as median_n, max(n) as max_n, sum(days)::bigint as confirmed_days from (select request_id, sid, count(*)::double as n, sum(duration_confirmed_days) as days from dy_ints group by 1, 2) group by 1"),
        "dy13_hash_sample": query("select request_id, sid as security_id, interval_no, sample_no, sample_hash from (select *, row_number() over (partition by request_id order by sample_hash) as sample_no from (select *, sha256(concat_ws('|', request_id, sid, interval_no)) as sample_hash from dy_ints)) where sample_no <= 5"),
        "ex01_exit_category": query("select i.request_id, case when is_open then 'right_censored' when termination_reason <> 'state_false' then 'quality' else 'false_' || f.failed end as exit_category, count(*) as n from dy_ints i left join (select request_id, security_id, trading_date, string_agg(case when not dimension_state then dimension end, '+' order by dimension) as failed from dy_dim group by 1, 2, 3) f on f.request_id = i.request_id and f.security_id = i.sid and f.trading_date = i.last_observed_date group by 1, 2"),
        "ex02_endpoint_margins": query(f"select i.request_id, i.sid as security_id, interval_no, cast(m.trading_date as varchar) as trading_date, dimension, round(score_mean - (1 - q_bp / 10000), 9) as main_margin, round(score_min - (1 - q_bp / 10000 - 0.1), 9) as weak_margin from dy_ints i join dy_dim m on m.request_id = i.request_id and m.security_id = i.sid and m.trading_date = i.interval_end_date"),
        "ex03_reentries": query("""select request_id, sid as security_id, interval_no, threshold, t as reentry_lag, q as quality_lag,
  case when coalesce(t <= threshold, false) and coalesce(t < q, t is not null) then 're_entered' when coalesce(q <= threshold, false) then 'interrupted' when l < threshold then 'insufficient' else 'none' end as outcome
from (select i.request_id, i.sid, interval_no, min(case when r.raw_state then r.n end) - max(e.n) as t, min(case when r.raw_state is null then r.n end) - max(e.n) as q, count(r.n) as l
  from (select * from dy_ints where termination_reason = 'state_false') i
  join (select *, row_number() over (partition by security_id order by trading_date) as n from dy_joint) e on e.security_id = i.security_id and e.trading_date = i.last_observed_date
  left join (select security_id, raw_state, row_number() over (partition by security_id order by trading_date) as n from dy_joint) r on r.security_id = i.security_id and r.n > e.n
  group by 1, 2, 3) cross join (select unnest([5, 20]) as threshold)"""),
    }
