"""Queries over profiles of states, intervals, gaps and windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators import profiles as R
from panelwright.operators import quality as Q
from panelwright.operators import reconcile as RC
from panelwright.operators import states as ST
from panelwright.operators import zones as Z
from panelwright.plans import quality as PQ
from panelwright.plans.metrics import prices
from panelwright.plans.sql import query, step
from panelwright.plans.states import KS, spine_confirmed, text_dates
from panelwright.plans.statistics import rounded
from panelwright.plans.zones import KEYS, parts
from panelwright.sources.panels import scan

#: Confirmations that are registered; the last one has no days.
REGISTERED = [*KS, 40]
TYPES = ["daily", "factor", "limit"]


def _state_days(spark, d: str) -> DataFrame:
    registry = spark.createDataFrame([(k,) for k in REGISTERED], "k int")
    return rounded(R.state_days(spine_confirmed(spark, d), ["k"], registry))


def _intervals(spark, d: str) -> DataFrame:
    return ST.intervals(spine_confirmed(spark, d), ["security_id", "k"])


def _gap_securities(spark, d: str) -> DataFrame:
    gaps = PQ.gaps(spark, d)
    return text_dates(R.gap_securities(gaps, Q.gap_intervals(gaps, PQ.expected(spark, d))))


def _versions(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Events, and a version that lacks some and repeats some."""
    e = scan(spark, f"{d}/events.parquet")
    return e, e.where("user_id % 3 <> 0").unionByName(e.where("event_id % 50 = 0"))


def _days(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Price days, and a version that lacks some, changes some and has some of its own."""
    p = prices(spark, d).select("security_id", "trading_date", "volume_shares", "amount_yuan")
    own = p.where("security_id % 9 = 5").withColumn("trading_date", F.add_months("trading_date", 240))
    return p, p.where("security_id % 9 <> 4").withColumn("volume_shares", F.col("volume_shares") + F.when(F.col("security_id") % 5 == 0, 1.0).otherwise(0.0)).unionByName(own)


def queries() -> dict:
    return {
        "rc01_multiset_counts": lambda s, d: RC.multiset_counts(*_versions(s, d), ["user_id", "event_type"], ["user_id"]),
        "rc02_first_differences": lambda s, d: text_dates(RC.first_differences(*_days(s, d), ["security_id", "trading_date"], ["volume_shares", "amount_yuan"])),
        "ez09_transition_counts": lambda s, d: rounded(Z.transition_counts(Z.transitions(parts(s, d)[2], parts(s, d)[1], KEYS), KEYS)),
        "pr01_state_days": _state_days,
        "pr07_interval_durations": lambda s, d: rounded(R.interval_durations(_intervals(s, d))),
        "pr07_terminations": lambda s, d: rounded(R.terminations(_intervals(s, d), ["k"])),
        "dq15_gap_types": lambda s, d: R.gap_counts(PQ.gaps(s, d), ["gap_type"]),
        "dq15_gap_dates": lambda s, d: text_dates(R.gap_counts(PQ.gaps(s, d), ["trading_date", "gap_type"])),
        "dq15_gap_securities": _gap_securities,
        "dq15_gap_overlaps": lambda s, d: text_dates(R.gap_overlaps(PQ.gaps(s, d), TYPES).where("n_types > 1")),
        "dq36_window_counts": lambda s, d: text_dates(R.window_counts(prices(s, d))),
    }


def _states_sql(c: str, name: str) -> str:
    return f"count(*) filter ({c}) as n_{name}_true, count(*) filter (not {c}) as n_{name}_false, count(*) filter (k is not null and {c} is null) as n_{name}_null, count(distinct case when {c} then security_id end) as n_{name}_entities, count(distinct case when {c} then year(trading_date) end) as n_{name}_years"


step("px_flags", "select security_id, trading_date, (adjusted_open > 0 and adjusted_high > 0 and adjusted_low > 0 and adjusted_close > 0 and adjusted_high >= adjusted_low)::int as price, (volume_shares >= 0 and amount_yuan >= 0)::int as participation, (adjusted_close > 0)::int as trend from pday")


def oracle_sql() -> dict[str, str]:
    statuses = ", ".join(f"count(*) filter (validity_status = '{s}') as n_{s}" for s in ("valid", "unknown", "diagnostic_required", "blocked"))
    qs = ", ".join(f"round(quantile_cont(duration_confirmed_days, {q}), 6) as {n}" for n, q in R.DURATIONS.items())
    windows = ", ".join(f"sum({n}) over (partition by security_id order by trading_date rows {size - 1} preceding) as {n}_{size}" for n, sizes in R.CAPACITY.items() for size in sizes)
    date = "cast(trading_date as varchar) as trading_date"
    sides = "select user_id, event_type, count(*) filter (side = 'a') as a, count(*) filter (side = 'b') as b from (select user_id, event_type, 'a' as side from events union all select user_id, event_type, 'b' from events where user_id % 3 <> 0 union all select user_id, event_type, 'b' from events where event_id % 50 = 0) group by 1, 2"
    other = "select security_id, trading_date, volume_shares + case when security_id % 5 = 0 then 1.0 else 0.0 end as volume_shares, amount_yuan from pday where security_id % 9 <> 4 union all select security_id, cast(trading_date + interval 240 month as date), volume_shares, amount_yuan from pday where security_id % 9 = 5"
    ledger = "select security_id, event, lag(event) over (partition by security_id order by event_date, event) as previous_event from (select security_id, start_date as event_date, case when qualified then 'component_qualified' else 'component_unqualified' end as event from za_asg union all select security_id, decision_date, status from za_zone where decision_date is not null)"
    return {
        "rc01_multiset_counts": query(f"select unnest(['n_left', 'n_right', 'n_missing', 'n_unexpected', 'n_repeats_left', 'n_repeats_right']) as metric, unnest([l, r, m, u, rl, rr]) as value from (select sum(a)::bigint as l, sum(b)::bigint as r, sum(greatest(b - a, 0))::bigint as m, sum(greatest(a - b, 0))::bigint as u from ({sides})) cross join (select sum(greatest(a - 1, 0))::bigint as rl, sum(greatest(b - 1, 0))::bigint as rr from (select user_id, sum(a) as a, sum(b) as b from ({sides}) group by 1))"),
        "rc02_first_differences": query(f"select security_id, {date}, kind, place from (select *, row_number() over (partition by kind order by security_id, trading_date) as place from (select security_id, trading_date, case when y.amount_yuan is null then 'left_only' when x.amount_yuan is null then 'right_only' when x.volume_shares <> y.volume_shares or x.amount_yuan <> y.amount_yuan then 'mismatched' end as kind from pday x full join ({other}) y using (security_id, trading_date)) where kind is not null) where place <= 20"),
        "ez09_transition_counts": query(f"select *, round(n / sum(n) over (partition by previous_event), 6) as share from (select previous_event, event, count(*) as n, count(distinct security_id) as n_entities from ({ledger}) group by 1, 2)"),
        "pr01_state_days": query(f"select r.k, count(c.k) as n_days, {statuses}, {_states_sql('raw_state', 'raw')}, {_states_sql('confirmed', 'confirmed')} from (select unnest({REGISTERED}) as k) r left join us_conf c on c.k = r.k group by r.k".replace("k is not null and", "c.k is not null and")),
        "pr07_interval_durations": query(f"""select k, count(*) as n_intervals, sum(duration_confirmed_days)::bigint as total_days, round(avg(duration_confirmed_days), 6) as mean, round(stddev_samp(duration_confirmed_days), 6) as std, min(duration_confirmed_days)::double as least, max(duration_confirmed_days)::double as greatest,
  count(*) filter (duration_confirmed_days = 1) as n_single, round(count(*) filter (duration_confirmed_days = 1) / count(*), 6) as fragment_rate, count(*) filter (is_open) as n_open, round(count(*) filter (is_open) / count(*), 6) as open_ratio,
  round(avg(datediff('day', raw_start_date, confirmation_date)), 6) as mean_delay, k - 1 as delay_rows, count(*) filter (duration_raw_days - duration_confirmed_days <> k - 1) as n_length_mismatch, count(*) filter (confirmation_date < raw_start_date) as n_early, {qs} from us_int group by k"""),
        "pr07_terminations": query("select k, termination_reason, count(*) as n, round(count(*) / sum(count(*)) over (partition by k), 6) as share from us_int group by 1, 2"),
        "dq15_gap_types": query("select gap_type, count(*) as n_gaps from gapt group by 1"),
        "dq15_gap_dates": query(f"select {date}, gap_type, count(*) as n_gaps from gapt group by 1, 2"),
        "dq15_gap_securities": query("select security_id, gap_type, sum(n_days)::bigint as n_gaps, min(begin) as first_date, max(\"end\") as last_date, count(*) as n_intervals, max(n_days) as longest from gapiv group by 1, 2"),
        "dq15_gap_overlaps": query(f"select security_id, {date}, string_agg(gap_type, '+' order by gap_type) as gap_types, count(*) as n_types, " + ", ".join(f"bool_or(gap_type = '{t}') as has_{t}" for t in TYPES) + " from gapt group by all having count(*) > 1"),
        "dq36_window_counts": query(f"select * replace (cast(trading_date as varchar) as trading_date), case when {' and '.join(f'{n}_{s} >= {s}' for n, s in R.FULL.items())} then 'full' else 'insufficient_history' end as capacity from (select security_id, trading_date, {windows} from px_flags)"),
    }
