"""Queries over event zones, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.conventions import asof
from panelwright.operators import zones as Z
from panelwright.plans.sql import STEPS, query, step
from panelwright.plans.states import spine, text_dates
from panelwright.sources.panels import scan

KEYS = ["security_id"]
K, D, G = 1, 2, 1


def parts(spark, d: str, k: int = K, days: int = D, g: int = G):
    """Daily replay, components with gap facts and zone numbers, and zones."""
    daily = Z.replay(spine(spark, d), k, KEYS)
    comps = Z.components(Z.atomic_intervals(daily, KEYS), daily, days, KEYS)
    assigned = Z.assign_zones(comps, Z.gaps(daily, comps, g, KEYS), g, KEYS)
    return daily, assigned, Z.zones(assigned, KEYS)


def zone_steps(n: str, k: int, d: int, g: int) -> None:
    step(
        f"{n}_day",
        f"""
select *, run is not null and streak >= {k} as confirmed from (
  select *, case when run is not null then row_number() over (partition by security_id, run order by trading_date) end as streak from (
    select *, case when o then sum(case when o and not coalesce(lo, false) then 1 else 0 end) over (partition by security_id order by trading_date) end as run from (
      select *, o, lag(o) over (partition by security_id order by trading_date) as lo from (
        select *, validity_status <> 'valid' or raw_state is null as hard_break, coalesce(raw_state and validity_status = 'valid', false) as o from uspine))))""",
    )
    step(
        f"{n}_comp",
        f"""
select *, qualification_date is not null as qualified from (
  select security_id, run, min(observation_sequence) as first_seq, max(observation_sequence) as last_seq, min(trading_date) as start_date, max(trading_date) as end_date, count(*) as n_confirmed,
    case when arg_max(struct_pack(a := n1), trading_date).a is null then 'sample_end' when arg_max(struct_pack(a := n2), trading_date).a then 'quality' else 'natural' end as end_reason,
    min(case when rn = {d} then trading_date end) as qualification_date
  from (select *, row_number() over (partition by security_id, run order by trading_date) as rn from (
      select *, lead(trading_date) over z as n1, lead(hard_break) over z as n2 from {n}_day window z as (partition by security_id order by trading_date)) where confirmed)
  group by 1, 2)""",
    )
    step(
        f"{n}_gap",
        f"""
select security_id, aft as run, count(*) filter (fl) as n_false, count(*) filter (hard_break) as n_breaks, count(*) filter (raw_state and not hard_break) as n_unconfirmed_true,
  min(case when fl and n = {g + 1} then trading_date end) as exceeded_date, min(case when hard_break then trading_date end) as break_date
from (select *, sum(fl::int) over (partition by security_id, aft order by trading_date) as n from (
    select *, not hard_break and not raw_state as fl from (
      select *, last_value(case when confirmed then run end ignore nulls) over (partition by security_id order by trading_date rows between unbounded preceding and current row) as aft from {n}_day)
    where not confirmed and aft is not null))
group by 1, 2""",
    )
    step(
        f"{n}_asg",
        f"""
select *, case when qualified then sum(case when qualified and not joined then 1 else 0 end) over w end as zone, qualified and joined as bridged,
  lead(qualified) over w as next_qualified, lead(end_reason) over w as next_end_reason, lead(start_date) over w as next_start
from (select *, coalesce(lag(qualified) over w and lag(n_breaks) over w = 0 and lag(n_false) over w between 1 and {g}, false) as joined
  from (select c.*, coalesce(n_false, 0) as n_false, coalesce(n_breaks, 0) as n_breaks, coalesce(n_unconfirmed_true, 0) as n_unconfirmed_true, exceeded_date, break_date from {n}_comp c left join {n}_gap using (security_id, run))
  window w as (partition by security_id order by first_seq)) window w as (partition by security_id order by first_seq)""",
    )
    step(
        f"{n}_zone",
        f"""
select security_id, zone, start_date, end_date, n_components, n_confirmed, n_bridges, qualification_date, least(l.exceeded_date, l.break_date) as decision_date,
  case when l.break_date is not null and (l.exceeded_date is null or l.break_date < l.exceeded_date) then 'FINALIZED_WITH_QUALITY_BREAK' when l.exceeded_date is not null then 'FINALIZED'
    when not l.next_qualified and l.next_end_reason = 'quality' then 'FINALIZED_WITH_QUALITY_BREAK' when not l.next_qualified and l.next_end_reason = 'natural' then 'FINALIZED'
    when l.next_qualified then 'FINALIZED' else 'RIGHT_CENSORED' end as status
from (select security_id, zone, min(start_date) as start_date, max(end_date) as end_date, count(*) as n_components, sum(n_confirmed)::bigint as n_confirmed, count(*) filter (bridged) as n_bridges, min(qualification_date) as qualification_date,
    arg_max(struct_pack(exceeded_date, break_date, next_qualified, next_end_reason), first_seq) as l
  from {n}_asg where qualified group by 1, 2)""",
    )
    step(
        f"{n}_mem",
        f"select d.security_id, zone, trading_date, case when not confirmed then 'bridge' when trading_date < qualification_date then 'prequalification' else 'core' end as role from {n}_day d join {n}_zone z on d.security_id = z.security_id and trading_date between start_date and end_date",
    )


zone_steps("za", K, D, G)
zone_steps("zb", K, 1, 2)
step(
    "zm_pair",
    """select a.security_id, a.zone as zone_a, a.start_date as sa, a.end_date as ea, b.zone as zone_b, b.start_date as sb, b.end_date as eb,
  row_number() over (partition by a.security_id order by a.start_date, b.start_date, a.zone, b.zone) as n
from za_zone a join zb_zone b on a.security_id = b.security_id and a.start_date <= b.end_date and b.start_date <= a.end_date""",
)
step(
    "zm_match",
    """select p.* from zm_pair p join (
  with recursive f as (
    select security_id, 0::bigint as n, []::bigint[] as us, []::bigint[] as ub, false as took from zm_pair group by security_id
    union all
    select f.security_id, p.n, case when ok then list_append(us, zone_a) else us end, case when ok then list_append(ub, zone_b) else ub end, ok
    from f join (select * from zm_pair) p on p.security_id = f.security_id and p.n = f.n + 1, lateral (select not list_contains(us, zone_a) and not list_contains(ub, zone_b) as ok))
  select * from f) f on f.security_id = p.security_id and f.n = p.n and f.took""",
)
# the scan: the same steps as above with the route, d and g as keys
_by = "security_id, route"
step("zc_grid", f"select * from (values {', '.join(f'({d}, {g})' for d in (1, 2, 3) for g in (1, 2, 3))}) v(d, g)")
step("zc_route", f"select * from (values {', '.join(f'{(n, t, k)}' for t in (100, 200, 300, 400) for k in (1, 2) for n in [f't{t}_k{k}'])}) v(route, lim, k)")
step(
    "zc_day",
    f"""
select *, run is not null and streak >= k as confirmed from (
  select *, case when run is not null then row_number() over (partition by {_by}, run order by trading_date) end as streak from (
    select *, case when o then sum(case when o and not coalesce(lo, false) then 1 else 0 end) over (partition by {_by} order by trading_date) end as run from (
      select *, not hard_break and state as o, lag(not hard_break and state) over (partition by {_by} order by trading_date) as lo from (
        select security_id, trading_date, observation_sequence, route, k, validity_status <> 'valid' or total is null as hard_break, coalesce(total > lim, false) as state from uspine cross join zc_route))))""",
)
step(
    "zc_comp",
    f"""
select {_by}, run, min(observation_sequence) as first_seq, min(trading_date) as start_date, max(trading_date) as end_date, count(*) as n_confirmed,
  case when arg_max(struct_pack(a := n1), trading_date).a is null then 'sample_end' when arg_max(struct_pack(a := n2), trading_date).a then 'quality' else 'natural' end as end_reason,
  list(trading_date order by trading_date) as days
from (select *, lead(trading_date) over z as n1, lead(hard_break) over z as n2 from zc_day window z as (partition by {_by} order by trading_date)) where confirmed group by {_by}, run""",
)
step(
    "zc_gap",
    f"""
select {_by}, aft as run, count(*) filter (not hard_break and not state) as n_false, count(*) filter (hard_break) as n_breaks, list(trading_date order by trading_date) filter (not hard_break and not state) as falses, min(case when hard_break then trading_date end) as break_date
from (select *, last_value(case when confirmed then run end ignore nulls) over (partition by {_by} order by trading_date rows between unbounded preceding and current row) as aft from zc_day)
where not confirmed and aft is not null group by {_by}, aft""",
)
step(
    "zc_asg",
    f"""
select *, case when qualified then sum(case when qualified and not joined then 1 else 0 end) over w end as zone, qualified and joined as bridged, lead(qualified) over w as next_qualified, lead(end_reason) over w as next_end_reason
from (select *, coalesce(lag(qualified) over w and lag(n_breaks) over w = 0 and lag(n_false) over w between 1 and g, false) as joined
  from (select c.*, d, g, days[d] as qualification_date, len(days) >= d as qualified, coalesce(n_false, 0) as n_false, coalesce(n_breaks, 0) as n_breaks, falses[g + 1] as exceeded_date, break_date
    from zc_comp c left join zc_gap using ({_by}, run) cross join zc_grid)
  window w as (partition by {_by}, d, g order by first_seq)) window w as (partition by {_by}, d, g order by first_seq)""",
)
step("zc_zone", STEPS["za_zone"].replace("za_asg", "zc_asg").replace("select security_id, zone", f"select {_by}, d, g, zone").replace("group by 1, 2", f"group by {_by}, d, g, zone"))
_Z = "security_id, zone, cast(start_date as varchar) as start_date, cast(end_date as varchar) as end_date, n_components, n_confirmed, n_bridges, cast(qualification_date as varchar) as qualification_date, cast(decision_date as varchar) as decision_date, status"
_DAY = "cast(trading_date as varchar) as trading_date"


#: Routes of the scan: a threshold of the day's sum and a confirmation length.
LIMITS, ROUTE_KS, DS, GS = (100, 200, 300, 400), (1, 2), [1, 2, 3], [1, 2, 3]
ROUTES = [(f"t{t}_k{k}", f"above_{t}", k) for t in LIMITS for k in ROUTE_KS]


def _scan(spark, d: str) -> DataFrame:
    """Zones of 72 cells: eight routes, three least lengths, three bridged gaps."""
    dense = spine(spark, d).withColumns({f"above_{t}": F.when(F.col("validity_status") == "valid", F.col("total") > t) for t in LIMITS})
    return Z.zone_scan(dense, ROUTES, DS, GS)


def _cells(spark, d: str) -> DataFrame:
    """The cells in numbers, by status."""
    return _scan(spark, d).groupBy("route", F.col("d").cast("long").alias("d"), F.col("g").cast("long").alias("g"), "status").agg(
        F.count("*").alias("n_zones"), F.sum("n_components").alias("n_components"), F.sum("n_confirmed").alias("n_confirmed"), F.sum("n_bridges").alias("n_bridges"), F.count_distinct("security_id").alias("n_entities"),
    )


def _comparison(spark, d: str) -> DataFrame:
    day, _, zone1 = parts(spark, d)
    zone2 = parts(spark, d, K, 1, 2)[2]
    return Z.window_comparison(zone1, zone2, Z.membership(zone1, day, KEYS), Z.membership(zone2, day, KEYS), "security_id")


def _core(spark, d: str) -> DataFrame:
    day1, _, zone1 = parts(spark, d)
    day2, _, zone2 = parts(spark, d, K, 1, 2)
    return Z.strict_core(Z.membership(zone2, day2, KEYS), Z.membership(zone1, day1, KEYS), KEYS)


def _members(spark, d: str) -> DataFrame:
    daily, _, found = parts(spark, d)
    return Z.membership(found, daily, KEYS)


def _orders_asof(spark, d: str) -> DataFrame:
    """Each order with the customer's order before it, or of the same day with a smaller key."""
    o = scan(spark, f"{d}/orders.parquet").select(F.col("o_custkey").alias("cust"), F.to_date("o_orderdate").alias("day"), "o_orderkey", "o_totalprice")
    o = o.withColumn("place", F.struct("day", "o_orderkey"))
    found = asof(o.drop("o_totalprice"), o.select("cust", F.col("place").alias("seen"), "o_totalprice"), ["cust"], "place", "seen", ["o_totalprice"], strict=True)
    return text_dates(found.select("cust", "day", "o_orderkey", F.col("matched_seen.day").alias("matched_seen"), F.col("matched_seen.o_orderkey").alias("other_key"), "o_totalprice"))


def queries() -> dict:
    return {
        "ez01_replay": lambda s, d: text_dates(parts(s, d)[0].select("security_id", "trading_date", "hard_break", "streak", "confirmed")),
        "ez02_atomic_intervals": lambda s, d: text_dates(Z.atomic_intervals(parts(s, d)[0], KEYS).select("security_id", "start_date", "end_date", "n_confirmed", "end_reason")),
        "ez03_components": lambda s, d: text_dates(parts(s, d)[1].select("security_id", "start_date", "qualified", "qualification_date")),
        "ez04_gaps": lambda s, d: text_dates(parts(s, d)[1].select("security_id", "start_date", "n_false", "n_breaks", "n_unconfirmed_true", "exceeded_date", "break_date")),
        "ez05_event_zones": lambda s, d: text_dates(parts(s, d)[2]),
        "ez05_event_zones_wide": lambda s, d: text_dates(parts(s, d, K, 1, 2)[2]),
        "ez06_membership": lambda s, d: text_dates(_members(s, d)),
        "ez07_bridges": lambda s, d: text_dates(Z.bridges(parts(s, d)[1], G, KEYS)),
        "ez09_transitions": lambda s, d: text_dates(Z.transitions(parts(s, d)[2], parts(s, d)[1], KEYS)),
        "ez11_cell_scan": _cells,
        "ez11_cell_zones": lambda s, d: text_dates(_scan(s, d)),
        "ez13_strict_core": _core,
        "ez14_greedy_matches": lambda s, d: text_dates(Z.greedy_matches(parts(s, d)[2], parts(s, d, K, 1, 2)[2], "security_id")),
        "ez14_window_comparison": lambda s, d: text_dates(_comparison(s, d)),
        "ez18_event_ids": lambda s, d: Z.event_ids(parts(s, d)[2], KEYS).select("security_id", "zone", "event_id"),
        "ez20_asof_daily": lambda s, d: text_dates(Z.asof_daily(parts(s, d)[0], _members(s, d), KEYS)),
        "ez20_asof_orders": _orders_asof,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "ez01_replay": query(f"select security_id, {_DAY}, hard_break, case when hard_break then null when run is null then 0 else streak end as streak, confirmed from za_day"),
        "ez02_atomic_intervals": query("select security_id, cast(start_date as varchar) as start_date, cast(end_date as varchar) as end_date, n_confirmed, end_reason from za_comp"),
        "ez03_components": query("select security_id, cast(start_date as varchar) as start_date, qualified, cast(qualification_date as varchar) as qualification_date from za_comp"),
        "ez04_gaps": query("select security_id, cast(start_date as varchar) as start_date, n_false, n_breaks, n_unconfirmed_true, cast(exceeded_date as varchar) as exceeded_date, cast(break_date as varchar) as break_date from za_asg"),
        "ez05_event_zones": query(f"select {_Z} from za_zone"),
        "ez05_event_zones_wide": query(f"select {_Z} from zb_zone"),
        "ez06_membership": query(f"select security_id, zone, {_DAY}, role from za_mem"),
        "ez07_bridges": query(f"select security_id, cast(end_date as varchar) as end_date, cast(next_start as varchar) as next_start, n_false, n_breaks, case when nb then 'bridged' when not qualified then 'left_unqualified' when not next_qualified then 'right_unqualified' when n_breaks > 0 then 'hard_break' when n_false > {G} then 'too_long' else 'no_false_row' end as reason from (select *, lead(bridged) over (partition by security_id order by first_seq) as nb from za_asg) where next_start is not null"),
        "ez09_transitions": query("select security_id, cast(event_date as varchar) as event_date, event, row_number() over w as ordinal, lag(event) over w as previous_event from (select security_id, start_date as event_date, case when qualified then 'component_qualified' else 'component_unqualified' end as event from za_asg union all select security_id, decision_date, status from za_zone where decision_date is not null) window w as (partition by security_id order by event_date, event)"),
        "ez11_cell_scan": query("select route, d, g, status, count(*) as n_zones, sum(n_components)::bigint as n_components, sum(n_confirmed)::bigint as n_confirmed, sum(n_bridges)::bigint as n_bridges, count(distinct security_id) as n_entities from zc_zone group by 1, 2, 3, 4"),
        "ez11_cell_zones": query(f"select route, d, g, {_Z} from zc_zone"),
        "ez14_greedy_matches": query("select security_id, zone_a, cast(sa as varchar) as sa, cast(ea as varchar) as ea, zone_b, cast(sb as varchar) as sb, cast(eb as varchar) as eb from zm_match"),
        "ez14_window_comparison": query("""select security_id, days_a, days_b, shared_days, round(shared_days / n, 9) as day_jaccard, coalesce(zones_a, 0) as zones_a, coalesce(zones_b, 0) as zones_b, coalesce(overlapping_a, 0) as overlapping_a, coalesce(overlapping_b, 0) as overlapping_b, coalesce(n_pairs, 0) as n_pairs, coalesce(n_matched, 0) as n_matched
from (select security_id, count(a) as days_a, count(b) as days_b, count(*) filter (a and b) as shared_days, count(*) as n from (select distinct security_id, trading_date, true as a from za_mem) full join (select distinct security_id, trading_date, true as b from zb_mem) using (security_id, trading_date) group by 1)
left join (select security_id, count(*) as zones_a from za_zone group by 1) using (security_id) left join (select security_id, count(*) as zones_b from zb_zone group by 1) using (security_id)
left join (select security_id, count(distinct zone_a) as overlapping_a, count(distinct zone_b) as overlapping_b, count(*) as n_pairs from zm_pair group by 1) using (security_id) left join (select security_id, count(*) as n_matched from zm_match group by 1) using (security_id)"""),
        "ez13_strict_core": query("select count(*) filter (a) as n_primary, count(*) filter (b) as n_strict, count(*) filter (a and b) as n_shared, count(*) filter (b and a is null) as n_violations from (select distinct security_id, trading_date, true as a from zb_mem) full join (select distinct security_id, trading_date, true as b from za_mem) using (security_id, trading_date)"),
        "ez18_event_ids": query("select security_id, zone, sha256(security_id || '|' || start_date) as event_id from za_zone"),
        "ez20_asof_daily": query(f"select d.security_id, cast(d.trading_date as varchar) as trading_date, cast(m.trading_date as varchar) as matched_trading_date, zone, role, coalesce(m.trading_date = d.trading_date, false) as in_zone from za_day d asof left join za_mem m on d.security_id = m.security_id and d.trading_date >= m.trading_date"),
        "ez20_asof_orders": query("""
select o_custkey as cust, cast(o_orderdate::date as varchar) as day, o_orderkey, cast(lag(o_orderdate::date) over w as varchar) as matched_seen, lag(o_orderkey) over w as other_key, round(lag(o_totalprice) over w, 9) as o_totalprice
from orders window w as (partition by o_custkey order by o_orderdate::date, o_orderkey)"""),
    }
