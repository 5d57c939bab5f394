"""Queries over reference data, coverage and quality, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators import quality as Q
from panelwright.plans.metrics import prices
from panelwright.plans.sql import query, step
from panelwright.plans.states import spine, text_dates
from panelwright.sources.panels import scan, user_days

#: First day of the calendar of the given tables, and the day on which a fifth of the suppliers are delisted.
START, DELISTED = "1995-01-01", "1998-06-30"


def universe(spark, d: str) -> DataFrame:
    s = scan(spark, f"{d}/supplier.parquet")
    return s.select(F.col("s_suppkey").alias("security_id"), F.date_add(F.lit(START).cast("date"), (F.col("s_suppkey") % 30).cast("int")).alias("list_date"), F.when(F.col("s_suppkey") % 5 == 0, F.lit(DELISTED).cast("date")).alias("delist_date"))


def calendar(spark, d: str) -> DataFrame:
    days = scan(spark, f"{d}/lineitem.parquet").select(F.to_date("l_shipdate").alias("trading_date")).distinct()
    return days.select("trading_date", (F.dayofweek("trading_date") != 1).alias("is_open"))


def expected(spark, d: str) -> DataFrame:
    return Q.expected_keys(universe(spark, d), calendar(spark, d))


def suspended(spark, d: str) -> DataFrame:
    return expected(spark, d).where((F.col("security_id") + F.dayofyear("trading_date")) % 13 == 0)


def factors(spark, d: str) -> DataFrame:
    rows = expected(spark, d).where((F.col("security_id") * 3 + F.dayofyear("trading_date")) % 11 != 0)
    return rows.withColumn("adj_factor", 1 + (F.col("security_id") % 7) / 100 + F.floor(F.month("trading_date") / 4) / 10)


def limits(spark, d: str) -> DataFrame:
    rows = prices(spark, d).where((F.col("security_id") + F.dayofmonth("trading_date")) % 9 != 0)
    return rows.select("security_id", "trading_date", (F.col("adjusted_close") * 1.1).alias("up_limit"), (F.col("adjusted_close") * 0.9).alias("down_limit"))


def status(spark, d: str) -> DataFrame:
    return Q.source_status(expected(spark, d), prices(spark, d), suspended(spark, d), limits(spark, d))


def evidence(spark, d: str) -> DataFrame:
    return Q.factor_evidence(expected(spark, d), suspended(spark, d), factors(spark, d))


def gaps(spark, d: str) -> DataFrame:
    return Q.coverage_gaps(status(spark, d), evidence(spark, d))


def pauses(spark, d: str) -> DataFrame:
    return universe(spark, d).where("security_id % 4 = 1").select("security_id", F.lit("1996-03-01").cast("date").alias("begin"), F.lit("1996-03-20").cast("date").alias("end"))


step("univ", f"select s_suppkey as security_id, date '{START}' + (s_suppkey % 30)::int as list_date, case when s_suppkey % 5 = 0 then date '{DELISTED}' end as delist_date from supplier")
step("cal", "select distinct l_shipdate::date as trading_date, dayofweek(l_shipdate::date) <> 0 as is_open from lineitem")
step("expct", f"select security_id, trading_date from univ join cal on is_open and trading_date >= list_date and coalesce(trading_date <= delist_date, true)")
step("susp", "select * from expct where (security_id + dayofyear(trading_date)) % 13 = 0")
step("fact", "select *, 1 + (security_id % 7) / 100.0 + floor(month(trading_date) / 4) / 10.0 as adj_factor from expct where (security_id * 3 + dayofyear(trading_date)) % 11 <> 0")
step("lims", "select security_id, trading_date, adjusted_close * 1.1 as up_limit, adjusted_close * 0.9 as down_limit from pday where (security_id + day(trading_date)) % 9 <> 0")
step(
    "srcst",
    """select security_id, trading_date, case when s.trading_date is not null then 'suspended' when p.trading_date is not null then 'trading' else 'unknown' end as trading_status,
  case when p.trading_date is not null then 'present' when s.trading_date is not null then 'not_expected' else 'missing' end as daily_status,
  case when l.trading_date is not null then 'resolved' when s.trading_date is not null then 'not_expected' else 'missing' end as limit_status
from expct e left join pday p using (security_id, trading_date) left join susp s using (security_id, trading_date) left join lims l using (security_id, trading_date)""",
)
step("evid", "select security_id, trading_date, adj_factor, case when adj_factor is not null then 'resolved' when s.trading_date is not null then 'carry_forward' else 'missing' end as factor_status from expct left join fact using (security_id, trading_date) left join susp s using (security_id, trading_date)")
step("gapt", "select security_id, trading_date, 'daily' as gap_type from srcst where daily_status = 'missing' union all select security_id, trading_date, 'limit' from srcst where limit_status = 'missing' union all select security_id, trading_date, 'factor' from evid where factor_status = 'missing'")
step("gapiv", "select security_id, gap_type, cast(min(trading_date) as varchar) as begin, cast(max(trading_date) as varchar) as end, count(*) as n_days from (select *, a - row_number() over (partition by security_id, gap_type order by trading_date) as g from gapt join (select *, row_number() over (partition by security_id order by trading_date) as a from expct) x using (security_id, trading_date)) group by security_id, gap_type, g")

_D = "cast(trading_date as varchar) as trading_date"


def _long(pairs: dict[str, str], source: str) -> str:
    cols = ", ".join(f"{e} as {n}" for n, e in pairs.items())
    return f"select metric, value::double as value from (unpivot (select {', '.join(f'cast({n} as double) as {n}' for n in pairs)} from (select {cols} from {source})) on {', '.join(pairs)} into name metric value value)"


def _codes(spark, d: str) -> DataFrame:
    s = scan(spark, f"{d}/supplier.parquet").withColumn("raw", F.expr("case s_suppkey % 4 when 0 then format_string('%06d.SZ', s_suppkey) when 1 then format_string('sh.%06d', 600000 + s_suppkey) when 2 then format_string('%06d', 600000 + s_suppkey) else 'n/a' end"))
    return Q.resolve_codes(s.select("s_suppkey", "raw"), "raw")


def _members(spark, d: str) -> DataFrame:
    return Q.audit_members(_codes(spark, d), "raw", r"^\d{6}\.S[ZH]$", "status", ["resolved", "inferred"])


def _spine_index(spark, d: str) -> DataFrame:
    return spine(spark, d).select("security_id", "trading_date", "observation_sequence", F.when(F.col("security_id") % 10 == 3, "listing_pause").otherwise("present").alias("expected_status"))


def _observed(spark, d: str) -> DataFrame:
    days = user_days(scan(spark, f"{d}/events.parquet"))
    return days.unionByName(days.where("security_id % 17 = 5 and dayofmonth(trading_date) = 2")).select("security_id", "trading_date", "total")


def _merge(spark, d: str) -> DataFrame:
    p = prices(spark, d).select("security_id", "trading_date", "adjusted_close", "volume_shares")
    a = p.withColumn("adjusted_close", F.when(F.col("security_id") % 3 != 0, F.col("adjusted_close"))).withColumns({"priority": F.lit(1), "source": F.lit("first")})
    b = p.withColumn("volume_shares", F.col("volume_shares") + F.when(F.col("security_id") % 4 == 0, 1.0).otherwise(0.0)).withColumns({"priority": F.lit(2), "source": F.lit("second")})
    return text_dates(Q.merge_evidence(a.unionByName(b), ["security_id", "trading_date"], ["adjusted_close", "volume_shares"], "priority", "source"))


def queries() -> dict:
    return {
        "dq01_resolve_codes": _codes,
        "dq02_member_audit": _members,
        "dq04_expected_keys": lambda s, d: text_dates(expected(s, d)),
        "dq05_completeness": lambda s, d: text_dates(Q.completeness(Q.expand_routes(expected(s, d), ["a", "b"]), Q.expand_routes(prices(s, d).select(*Q.KEYS), ["a", "c"]), [*Q.KEYS, "route"])),
        "dq06_source_status": lambda s, d: text_dates(status(s, d)),
        "dq07_factor_evidence": lambda s, d: text_dates(evidence(s, d)),
        "dq08_coverage_gaps": lambda s, d: text_dates(gaps(s, d)),
        "dq09_quality_summary": lambda s, d: Q.quality_summary(prices(s, d)),
        "dq10_acceptance": lambda s, d: Q.acceptance(Q.quality_summary(prices(s, d)), ["n_null_ohlc", "n_suspended", "n_repeated_keys"]),
        "dq11_pause_override": lambda s, d: text_dates(Q.apply_pause(status(s, d), pauses(s, d))),
        "dq12_factor_policy": lambda s, d: text_dates(Q.apply_factor_policy(evidence(s, d)).select(*Q.KEYS, "effective_factor", "policy")),
        "dq13_gap_delta": lambda s, d: Q.gap_delta(gaps(s, d), gaps(s, d).where("gap_type <> 'factor'")),
        "dq14_gap_intervals": lambda s, d: text_dates(Q.gap_intervals(gaps(s, d), expected(s, d))),
        "dq15_gap_profiles": lambda s, d: Q.gap_profiles(gaps(s, d)),
        "dq16_missing_daily_cause": lambda s, d: text_dates(Q.diagnose_missing_daily(gaps(s, d), suspended(s, d), calendar(s, d), universe(s, d))),
        "dq17_nearest_factors": lambda s, d: text_dates(Q.nearest_factors(gaps(s, d), factors(s, d))),
        "dq20_adjusted_prices": lambda s, d: text_dates(Q.adjusted(prices(s, d), factors(s, d))),
        "dq21_quality_reasons": lambda s, d: text_dates(Q.quality_reasons(prices(s, d)).withColumn("reasons", F.array_join("reasons", ","))),
        "dq22_mechanical_gap": lambda s, d: text_dates(Q.mechanical_gap(prices(s, d), suspended(s, d))),
        "dq26_standardise": lambda s, d: text_dates(Q.standardise(_lots(s, d))),
        "dq28_field_status": lambda s, d: text_dates(Q.field_status(Q.standardise(_lots(s, d)).join(prices(s, d).select(*Q.KEYS, "adjusted_low", "adjusted_high"), Q.KEYS))),
        "dq33_field_profile": lambda s, d: Q.field_profile(scan(s, f"{d}/supplier.parquet").select("s_suppkey", "s_nationkey", "s_name"), ["s_suppkey"]),
        "dq34_coverage_by_security": lambda s, d: Q.coverage(prices(s, d), "security_id"),
        "dq34_coverage_by_date": lambda s, d: text_dates(Q.coverage(prices(s, d), "trading_date")),
        "dq35_policy_usage": lambda s, d: Q.policy_usage(Q.apply_factor_policy(evidence(s, d)), ["source", "neutral_factor", "interval_factor"]),
        "dq36_window_capacity": lambda s, d: Q.window_capacity(prices(s, d)),
        "dq39_price_checks": lambda s, d: Q.check_prices(prices(s, d), universe(s, d).where("security_id % 6 <> 2")),
        "dq42_densify": lambda s, d: text_dates(Q.densify(_spine_index(s, d), _observed(s, d))[0]),
        "dq42_densify_errors": lambda s, d: text_dates(Q.densify(_spine_index(s, d), _observed(s, d))[1]),
        "dq43_merge_evidence": _merge,
        "dq44_value_intervals": lambda s, d: text_dates(Q.value_intervals(factors(s, d), "adj_factor")),
    }


def _lots(spark, d: str) -> DataFrame:
    return prices(spark, d).select("security_id", "trading_date", (F.col("volume_shares") / 100).alias("volume_lots"), (F.col("amount_yuan") / 1000).alias("amount_thousand"), (F.when(F.col("security_id") % 8 != 0, F.col("security_id") / 10.0)).alias("float_share_10k"))


step("lots", "select security_id, trading_date, volume_shares as vs, amount_yuan as am, case when security_id % 8 <> 0 then security_id / 10.0 * 10000 end as fs from pday")
step("stdz", "select security_id, trading_date, (vs / 100) * 100 as volume_shares, (am / 1000) * 1000 as amount_yuan, fs as float_shares, case when vs > 0 then (am / 1000) * 1000 / ((vs / 100) * 100) end as vwap, case when fs > 0 then (vs / 100) * 100 / fs end as turnover, vs = 0 as zero_volume from lots")
_CODES = """
select *, case when symbol is not null then concat_ws('.', symbol, exchange) end as vendor_code, case when symbol is null then 'unresolved' when nm <> '' then 'resolved' else 'inferred' end as status
from (select *, case when nm <> '' then nm when symbol[1] in ('6', '9') then 'SH' when symbol is not null then 'SZ' end as exchange
  from (select *, nullif(regexp_extract(upper(trim(raw)), '(\\d{6})', 1), '') as symbol, regexp_extract(upper(trim(raw)), '(?:^|\\.)(SZ|SH)(?:\\.|$)', 1) as nm
    from (select s_suppkey, case s_suppkey % 4 when 0 then printf('%06d.SZ', s_suppkey) when 1 then printf('sh.%06d', 600000 + s_suppkey) when 2 then printf('%06d', 600000 + s_suppkey) else 'n/a' end as raw from supplier)))"""
step("codes", _CODES)
_SUMMARY = {
    "n_rows": "count(*)", "n_entities": "count(distinct security_id)", "n_repeated_keys": "count(*) - count(distinct (security_id, trading_date))",
    "n_null_ohlc": "count(*) filter (adjusted_open is null or adjusted_high is null or adjusted_low is null or adjusted_close is null)",
    "n_non_positive_ohlc": "count(*) filter (least(adjusted_open, adjusted_high, adjusted_low, adjusted_close) <= 0)", "n_high_below_low": "count(*) filter (adjusted_high < adjusted_low)",
    "n_zero_volume": "count(*) filter (volume_shares <= 0)", "n_suspended": "count(*) filter (suspension_flag)",
}
_INSIDE = "adjusted_open between adjusted_low and adjusted_high"
_IDX = "(select security_id, trading_date, observation_sequence, case when security_id % 10 = 3 then 'listing_pause' else 'present' end as expected_status from uspine)"
step("obsd", "select security_id, trading_date, count(*) as n, max(total) as total from (select security_id, trading_date, total from uday union all select security_id, trading_date, total from uday where security_id % 17 = 5 and day(trading_date) = 2) group by 1, 2")


def oracle_sql() -> dict[str, str]:
    caps = {f"n_full_{n}": f"count(*) filter (w{n} = {n})" for n in (15, 20, 21, 60, 80)}
    capsrc = "(select " + ", ".join(f"sum(case when suspension_flag then 0 else 1 end) over (partition by security_id order by trading_date rows between {n - 1} preceding and current row) as w{n}" for n in (15, 20, 21, 60, 80)) + " from pday)"
    rules = {"non_positive": "count(*) filter (adjusted_low <= 0)", "order_": "count(*) filter (adjusted_high < adjusted_low)", "negative_volume": "count(*) filter (volume_shares < 0)", "open_outside": f"count(*) filter (not ({_INSIDE}))", "suspended_with_volume": "count(*) filter (suspension_flag and volume_shares > 0)", "not_in_universe": "count(*) filter (security_id % 6 = 2)"}
    reasons = ["case when adjusted_high < adjusted_low then 'high_below_low' end", f"case when not ({_INSIDE}) then 'open_outside_range' end", "case when adjusted_high = adjusted_low then 'flat_day' end", "case when suspension_flag then 'suspended' end", "case when volume_shares < 20 then 'small_volume' end", "case when not (daily_vwap between adjusted_low - 0.005 and adjusted_high + 0.005) then 'vwap_outside_range' end"]
    return {
        "dq01_resolve_codes": query("select s_suppkey, raw, symbol, exchange, vendor_code, status from codes"),
        "dq02_member_audit": query(_long({"n_rows": "count(*)", "n_keys": "count(distinct raw)", "n_repeated": "count(raw) - count(distinct raw)", "n_malformed": "count(*) filter (not regexp_matches(raw, '^\\d{6}\\.S[ZH]$'))", "n_bad_status": "count(*) filter (status not in ('resolved', 'inferred'))"}, "codes")),
        "dq04_expected_keys": query(f"select security_id, {_D} from expct"),
        "dq05_completeness": query(f"""select security_id, {_D}, route, problem from (
  select security_id, trading_date, r as route, 'missing' as problem from expct cross join (select unnest(['a', 'b']) as r) x where r = 'b' or not exists (select 1 from pday p where p.security_id = expct.security_id and p.trading_date = expct.trading_date)
  union all select security_id, trading_date, r, 'unexpected' from pday cross join (select unnest(['a', 'c']) as r) x where r = 'c' or not exists (select 1 from expct e where e.security_id = pday.security_id and e.trading_date = pday.trading_date))"""),
        "dq06_source_status": query(f"select security_id, {_D}, trading_status, daily_status, limit_status from srcst"),
        "dq07_factor_evidence": query(f"select security_id, {_D}, round(adj_factor, 9) as adj_factor, factor_status from evid"),
        "dq08_coverage_gaps": query(f"select security_id, {_D}, gap_type from gapt"),
        "dq09_quality_summary": query(_long(_SUMMARY, "pday")),
        "dq10_acceptance": query("select case when n > 0 then 'blocked' else 'accepted' end as status, case when n > 0 then 'n_suspended' else '' end as blockers from (select count(*) filter (suspension_flag) as n from pday)"),
        "dq11_pause_override": query(f"select security_id, {_D}, case when h then 'listing_pause' else trading_status end as trading_status, case when h then 'not_expected' else daily_status end as daily_status, h as overridden from (select *, security_id % 4 = 1 and trading_date between date '1996-03-01' and date '1996-03-20' as h from srcst)"),
        "dq12_factor_policy": query(f"select security_id, {_D}, round(coalesce(adj_factor, 1.0), 9) as effective_factor, case when adj_factor is null then 'neutral_factor' else 'source' end as policy from evid"),
        "dq13_gap_delta": query("select gap_type, count(*) as n_before, count(*) filter (gap_type <> 'factor') as n_after, count(*) filter (gap_type = 'factor') as n_closed from gapt group by 1"),
        "dq14_gap_intervals": query("select * from gapiv"),
        "dq15_gap_profiles": query("select gap_types, count(*) as n_keys, count(distinct security_id) as n_entities from (select security_id, trading_date, string_agg(gap_type, '+' order by gap_type) as gap_types from gapt group by 1, 2) group by 1"),
        "dq16_missing_daily_cause": query(f"select security_id, {_D}, case when s.trading_date is not null then 'suspended' when datediff('day', list_date, trading_date) < 5 then 'new_listing' else 'vendor_gap' end as cause from gapt left join susp s using (security_id, trading_date) left join univ using (security_id) where gap_type = 'daily'"),
        "dq17_nearest_factors": query(f"""select g.security_id, cast(g.trading_date as varchar) as trading_date, cast(p.trading_date as varchar) as previous_date, cast(n.trading_date as varchar) as next_date, datediff('day', p.trading_date, g.trading_date) as days_since, datediff('day', g.trading_date, n.trading_date) as days_until
from (select * from gapt where gap_type = 'factor') g asof left join fact p on g.security_id = p.security_id and g.trading_date >= p.trading_date asof left join fact n on g.security_id = n.security_id and g.trading_date <= n.trading_date"""),
        "dq20_adjusted_prices": query(f"select security_id, {_D}, " + ", ".join(f"round(adjusted_{x} * coalesce(adj_factor, 1.0), 9) as {x}" for x in ("open", "high", "low", "close")) + ", case when adj_factor is null then 'factor_missing' else 'none' end as factor_reason from pday left join fact using (security_id, trading_date)"),
        "dq21_quality_reasons": query(f"select security_id, {_D}, array_to_string(list_filter([{', '.join(reasons)}], lambda x: x is not null), ',') as reasons, suspension_flag or adjusted_high < adjusted_low as blocking from pday"),
        "dq22_mechanical_gap": query(f"select security_id, {_D}, round(gap, 9) as gap, s.trading_date is not null as event_present from (select *, adjusted_open / lag(adjusted_close) over (partition by security_id order by trading_date) - 1 as gap from pday) left join susp s using (security_id, trading_date) where abs(gap) >= 0.03"),
        "dq26_standardise": query(f"select security_id, {_D}, round(volume_shares, 9) as volume_shares, round(amount_yuan, 9) as amount_yuan, round(float_shares, 9) as float_shares, round(vwap, 9) as vwap, round(turnover, 9) as turnover, zero_volume from stdz"),
        "dq28_field_status": query(f"select security_id, {_D}, case when vwap is null then 'unknown' when vwap between adjusted_low - 0.005 and adjusted_high + 0.005 then 'pass' else 'fail' end as vwap_status, case when turnover is null then 'unknown' when turnover <= 1 then 'pass' else 'fail' end as turnover_status from stdz join (select security_id, trading_date, adjusted_low, adjusted_high from pday) using (security_id, trading_date)"),
        "dq33_field_profile": query(" union all ".join(f"select '{c}' as \"column\", count(*) filter ({c} is null) as n_null, count(distinct {c}) as n_distinct, cast(min({c}) as varchar) as least, cast(max({c}) as varchar) as greatest, count(*) as n_rows, case when '{c}' = 's_suppkey' and count(*) filter ({c} is null) > 0 then 'required_null' when count(distinct {c}) <= 1 then 'constant' else 'ok' end as status from supplier" for c in ("s_suppkey", "s_nationkey", "s_name"))),
        "dq34_coverage_by_security": query("select security_id, count(*) as n_rows, count(distinct trading_date) as n_other, round(avg((not suspension_flag)::int), 9) as open_share from pday group by 1"),
        "dq34_coverage_by_date": query(f"select {_D}, count(*) as n_rows, count(distinct security_id) as n_other, round(avg((not suspension_flag)::int), 9) as open_share from pday group by trading_date"),
        "dq35_policy_usage": query("select 'source' as policy, count(adj_factor) as n_rows from evid union all select 'neutral_factor', count(*) - count(adj_factor) from evid union all select 'interval_factor', 0"),
        "dq36_window_capacity": query(_long(caps, capsrc)),
        "dq39_price_checks": query(f"select case metric when 'order_' then 'order' else metric end as metric, value from ({_long(rules, 'pday')})"),
        "dq42_densify": query(f"select security_id, {_D}, observation_sequence, expected_status, case when expected_status = 'present' and n = 1 then total end as total from {_IDX} left join obsd using (security_id, trading_date)"),
        "dq42_densify_errors": query(f"select security_id, {_D}, problem from (select *, case when expected_status = 'present' and coalesce(n, 0) = 0 then 'missing_row' when expected_status = 'present' and n > 1 then 'repeated_row' when expected_status <> 'present' and n > 0 then 'row_in_empty_slot' end as problem from {_IDX} left join obsd using (security_id, trading_date)) where problem is not null"),
        "dq43_merge_evidence": query(f"select security_id, {_D}, round(adjusted_close, 9) as adjusted_close, case when security_id % 3 <> 0 then 'first' else 'second' end as adjusted_close_source, false as adjusted_close_conflict, round(volume_shares, 9) as volume_shares, 'first' as volume_shares_source, security_id % 4 = 0 as volume_shares_conflict from pday"),
        "dq44_value_intervals": query("select security_id, round(any_value(adj_factor), 9) as adj_factor, cast(min(trading_date) as varchar) as begin, cast(max(trading_date) as varchar) as end, count(*) as n_days from (select *, sum(c) over (partition by security_id order by trading_date) as g from (select *, case when lag(adj_factor) over (partition by security_id order by trading_date) is distinct from adj_factor then 1 else 0 end as c from fact)) group by security_id, g"),
    }
