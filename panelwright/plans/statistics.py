"""Queries over profiles, association, stability and comparison, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.conventions import ratio
from panelwright.operators import reconcile as R
from panelwright.operators import states as ST
from panelwright.operators import statistics as A
from panelwright.operators.metrics import side_by_side
from panelwright.plans.metrics import DIMENSIONS, INDICATORS, long_metrics, long_scores, prices, wide_metrics, wide_scores
from panelwright.plans.sql import query, step
from panelwright.plans.states import nested, spine, spine_confirmed
from panelwright.sources.panels import scan
from panelwright.sources.scratch import written

KS_LAG = [1, 3, 5]


def rounded(df: DataFrame) -> DataFrame:
    """As text_dates, with doubles to six places."""
    return df.select(*[(F.round(c, 6) if t == "double" else F.col(c).cast("string") if t == "date" else F.col(c).cast("long") if t == "int" else F.col(c)).alias(c) for c, t in df.dtypes])


def two_states(spark, d: str) -> DataFrame:
    """The users' spine with a second state: at least three events."""
    return spine(spark, d).withColumns({"busy": F.when(F.col("validity_status") == "valid", F.col("n_events") >= 3), "half": F.floor((F.dayofmonth("trading_date") - 1) / 10)})


step("two", "select *, case when validity_status = 'valid' then n_events >= 3 end as busy, floor((day(trading_date) - 1) / 10)::bigint as half from uspine")


def metric_rows(spark, d: str) -> DataFrame:
    """All eight metrics."""
    return long_metrics(spark, d).withColumnRenamed("indicator", "metric")


def metric_reasons(spark, d: str) -> DataFrame:
    """Reasons of all eight metrics, a row for each day and metric; no value is computed."""
    wide = side_by_side(prices(spark, d), INDICATORS, fields=("reason_codes",))
    return wide.select(F.explode(F.array(*[F.col(f"{n}.reason_codes") for n in INDICATORS])).alias("reason_codes"))


step("mrows", " union all ".join(f"select *, '{n}' as metric from (select * replace (round(value + 1e-13, 10) as value) from rm_{n})" for names in DIMENSIONS.values() for n in names))


def nine_sql(v: str) -> str:
    return f"round(avg({v}), 6) as mean, round(stddev_samp({v}), 6) as std, round(min({v}), 6) as least, round(max({v}), 6) as greatest, " + ", ".join(f"round(quantile_cont({v}, {q}), 6) as {n}" for n, q in A.NINE.items())


def _spread_sql(v: str) -> str:
    qs = ", ".join(f"round(quantile_cont({v}, {q}), 6) as q{round(q * 100):02d}" for q in A.QUANTILES)
    return f"round(avg({v}), 6) as mean, round(stddev_samp({v}), 6) as std, round(min({v}), 6) as least, round(max({v}), 6) as greatest, {qs}"


_ASSOC = """
round(n11 / nullif(n11 + n10 + n01, 0), 6) as jaccard, round(n11 / nullif(n11 + n10, 0), 6) as b_given_a, round(n11 / nullif(n11 + n01, 0), 6) as a_given_b,
round((n11 + n01) / nullif(n11 + n10 + n01 + n00, 0), 6) as base_rate, round(n11 / nullif(n11 + n10, 0) / nullif((n11 + n01) / nullif(n11 + n10 + n01 + n00, 0), 0), 6) as lift,
round(n11 / nullif(n11 + n10, 0) - (n11 + n01) / nullif(n11 + n10 + n01 + n00, 0), 6) as delta, round(n11 / nullif(n11 + n10, 0) - n01 / nullif(n01 + n00, 0), 6) as delta_vs_not_a,
round(n11 - (n11 + n10) * (n11 + n01) / nullif(n11 + n10 + n01 + n00, 0), 6) as excess_joint"""
_COUNTS = "count(*) filter (raw_state and busy) as n11, count(*) filter (raw_state and not busy) as n10, count(*) filter (not raw_state and busy) as n01, count(*) filter (not raw_state and not busy) as n00 from two where raw_state is not null and busy is not null"
step("half_counts", f"select half, {_COUNTS} group by half")


def _half_counts(spark, d: str) -> DataFrame:
    return A.overlap(two_states(spark, d), "raw_state", "busy", ["half"])


def _response(spark, d: str) -> DataFrame:
    states = ST.indicator_states(long_scores(spark, d), [0.1, 0.2, 0.3, 0.4])
    curve = states.groupBy("indicator", "q").agg(F.count_if("active").cast("double").alias("n"))
    return rounded(A.response_profile(curve, "indicator", "q", "n"))


def _pareto(spark, d: str) -> DataFrame:
    s = scan(spark, f"{d}/supplier.parquet").join(prices(spark, d).groupBy("security_id").agg(F.countDistinct("trading_date").cast("double").alias("n_days")), F.col("s_suppkey") == F.col("security_id"))
    return A.pareto(s.select("s_nationkey", "s_suppkey", "s_acctbal", "n_days"), "s_nationkey", "s_suppkey", ["s_acctbal", "n_days"])


def _gates(spark, d: str) -> DataFrame:
    one = spine(spark, d).groupBy("security_id").agg(F.count_if("raw_state").cast("double").alias("n_true"), F.count_if(F.col("raw_state").isNull()).cast("double").alias("n_null"))
    long = one.unpivot(["security_id"], ["n_true", "n_null"], "metric", "value")
    registry = spark.createDataFrame([("n_true", ">=", 5.0), ("n_null", "<=", 4.0)], "metric string, operator string, threshold double")
    return A.gates(long, registry)


def _blocks(spark, d: str) -> DataFrame:
    return A.blocks(prices(spark, d).select("security_id", "trading_date", "suspension_flag"), 3)


LAG_COUNTS = ["n_onset", "n_onset_true", "n_control", "n_control_true"]


def _bootstrap(spark, d: str) -> DataFrame:
    """Fixed-lag probabilities with intervals over resampled securities."""
    counts = A.lag_profile(A.lag_targets(spine(spark, d), "raw_state", KS_LAG), ["security_id"]).select("security_id", "k", *LAG_COUNTS)
    reps = A.cluster_bootstrap(counts, "security_id", LAG_COUNTS, ["k"], 500, 5)
    on, off = ratio(F.col("n_onset_true"), F.col("n_onset")), ratio(F.col("n_control_true"), F.col("n_control"))
    return rounded(A.bootstrap_intervals(reps, ["k"], {"p_onset": on, "p_control": off, "difference": on - off, "lift": ratio(on, off)}))


def _loyo(spark, d: str) -> DataFrame:
    return rounded(A.leave_one_out(_half_counts(spark, d).withColumn("all", F.lit("all")), "all", "half"))


def _diff(spark, d: str) -> DataFrame:
    a = prices(spark, d).select("security_id", "trading_date", "volume_shares", "suspension_flag")
    b = a.where("security_id % 9 <> 4").withColumn("volume_shares", F.col("volume_shares") + F.when(F.col("security_id") % 5 == 0, 1.0).otherwise(0.0))
    return R.keyed_diff(a, b, ["security_id", "trading_date"], ["volume_shares", "suspension_flag"])


def _multiset(spark, d: str) -> DataFrame:
    e = scan(spark, f"{d}/events.parquet")
    return R.multiset_diff(e, e.where("user_id % 3 <> 0").unionByName(e.where("event_id % 50 = 0")), ["user_id", "event_type"])


def _extremes(spark, d: str, n: int = 5) -> DataFrame:
    wide = wide_metrics(spark, d, fields=("value",))
    wide = written(wide.select("security_id", "trading_date", *[F.col(f"{m}.value").alias(m) for m in INDICATORS]), "extremes")
    ends = []  # every task keeps the n first rows of an order; nothing is sorted whole or dealt
    for m in INDICATORS:
        rows = wide.where(F.col(m).isNotNull()).select(F.lit(m).alias("metric"), "security_id", "trading_date", F.col(m).alias("value"))
        ends += [rows.orderBy(order, "security_id", "trading_date").limit(n) for order in (F.asc("value"), F.desc("value"))]
    return rounded(reduce(DataFrame.union, ends).distinct())


def _corr(spark, d: str, by: list[str]) -> DataFrame:
    wide = wide_scores(spark, d, indicators=["log_range20", "ma_spread"]).select("security_id", "trading_date", F.col("log_range20.score").alias("a"), F.col("ma_spread.score").alias("b"))
    return rounded(A.correlations(wide, "a", "b", by))


step("cwide", "select security_id, trading_date, max(score) filter (indicator = 'log_range20') as a, max(score) filter (indicator = 'ma_spread') as b from scores_long group by 1, 2")


def _corr_sql(by: str) -> str:
    part = f"partition by {by}" if by else ""
    cols, group = (f"{by}, ", f" group by {by}") if by else ("", "")
    ranks = ", ".join(f"rank() over ({part} order by {c}) + (count(*) over (partition by {cols}{c}) - 1) / 2.0 as r{c}" for c in "ab")
    return f"select {cols}count(*) as n, round(corr(a, b), 6) as pearson, round(corr(ra, rb), 6) as spearman from (select *, {ranks} from cwide where a is not null and b is not null){group}"


def queries() -> dict:
    return {
        "pr01_state_profile": lambda s, d: A.state_profile(two_states(s, d), ["half"]),
        "pr02_segment_count": lambda s, d: A.segment_count(spine(s, d), ["security_id"]),
        "pr03_interval_profile": lambda s, d: rounded(A.interval_profile(ST.intervals(spine_confirmed(s, d), ["security_id", "k"]), ["k"])),
        "pr06_segment_durations": lambda s, d: rounded(A.segment_durations(ST.streaks(spine(s, d), ["security_id"]), [])),
        "pr09_overlap": lambda s, d: rounded(A.overlap(two_states(s, d), "raw_state", "busy", [])),
        "pr10_onset_overlap": lambda s, d: A.onset_overlap(two_states(s, d), "raw_state", "busy"),
        "pr12_parent_child": lambda s, d: rounded(A.overlap(nested(s, d), "s1", "s2", ["security_id"])),
        "as01_raw_distribution": lambda s, d: rounded(A.distribution(metric_rows(s, d), "metric", "value", "validity_status", F.col("value") >= 0)),
        "as01_tail_ratio": lambda s, d: rounded(A.distribution(metric_rows(s, d), "metric", "value").select("metric", "tail_share")),
        "as03_histogram": lambda s, d: rounded(A.histogram(long_scores(s, d), "indicator", 10)),
        "as04_correlation_pooled": lambda s, d: _corr(s, d, []),
        "as25_correlation_by_security": lambda s, d: _corr(s, d, ["security_id"]),
        "as06_reason_profile": lambda s, d: rounded(A.reason_profile(metric_reasons(s, d))),
        "as10_association": lambda s, d: rounded(_half_counts(s, d)),
        "as13_by_security": lambda s, d: rounded(A.overlap(two_states(s, d), "raw_state", "busy", ["security_id"])),
        "as17_lag_targets": lambda s, d: rounded(A.lag_targets(spine(s, d), "raw_state", KS_LAG)),
        "as18_lag_profile": lambda s, d: rounded(A.lag_profile(A.lag_targets(spine(s, d), "raw_state", KS_LAG))),
        "as22_lag_by_security": lambda s, d: rounded(A.lag_profile(A.lag_targets(spine(s, d), "raw_state", KS_LAG), ["security_id"])),
        "as23_cluster_bootstrap": _bootstrap,
        "as31_extremes": _extremes,
        "yr05_concentration": lambda s, d: rounded(A.concentration(two_states(s, d).groupBy("security_id", "half").agg(F.count_if("raw_state").alias("n")).where("n > 0"), "security_id", "half", "n")),
        "yr06_leave_one_out": _loyo,
        "rs04_response_profile": _response,
        "rs07_pareto": _pareto,
        "rs09_gates": _gates,
        "nm01_blocks": lambda s, d: rounded(_blocks(s, d).drop("suspension_flag")),
        "rc01_multiset_diff": _multiset,
        "rc02_keyed_diff": _diff,
        "rc03_fingerprint": lambda s, d: R.fingerprint(scan(s, f"{d}/customer.parquet").select("c_custkey", "c_name", "c_nationkey"), "c_nationkey"),
        "rc05_anomaly_scan": lambda s, d: R.anomaly_scan(prices(s, d), {"rows_with_zero_volume": (F.count_if(F.col("volume_shares") <= 0), 0), "suspended": (F.count_if("suspension_flag"), 0)}),
        "rc07_max_share": lambda s, d: rounded(R.max_share(scan(s, f"{d}/lineitem.parquet"), "l_suppkey")),
    }


def oracle_sql() -> dict[str, str]:
    tail_sql = "select metric, round(avg((value < lo or value > hi)::int), 6) as tail_share from mrows join (select metric, quantile_cont(value, 0.01) as lo, quantile_cont(value, 0.99) as hi from mrows group by 1) using (metric) where value is not null group by 1"
    lag_t = " union all ".join(f"select security_id, trading_date, case when b is false and raw_state then 'onset' when b is false and not raw_state then 'control' end as anchor, {k} as k, lead(raw_state, {k}) over w as target, count(*) over (w rows between current row and {k} following) = {k + 1} as complete, count(*) filter (raw_state) over (w rows between current row and {k} following) = {k + 1} as survived from (select *, lag(raw_state) over (partition by security_id order by trading_date) as b from uspine) window w as (partition by security_id order by trading_date)" for k in KS_LAG)
    step("lagt", f"select * from ({lag_t}) where anchor is not null")
    lag_p = "count(*) filter (anchor = 'onset' and target is not null) as n_onset, count(*) filter (anchor = 'onset' and target) as n_onset_true, count(*) filter (anchor = 'control' and target is not null) as n_control, count(*) filter (anchor = 'control' and target) as n_control_true, count(*) filter (anchor = 'onset' and not complete) as n_right_censored, count(*) filter (anchor = 'onset' and survived) as n_survived"
    lag_d = "*, round(n_onset_true / nullif(n_onset, 0), 6) as p_onset, round(n_control_true / nullif(n_control, 0), 6) as p_control, round(n_onset_true / nullif(n_onset, 0) - n_control_true / nullif(n_control, 0), 6) as difference, round(n_onset_true / nullif(n_onset, 0) / nullif(n_control_true / nullif(n_control, 0), 0), 6) as lift"
    prof = "count(*) as n_days, count(*) filter (validity_status = 'valid') as n_valid, count(*) filter (validity_status = 'unknown') as n_unknown, count(*) filter (validity_status = 'blocked') as n_blocked, count(*) filter (raw_state) as n_true, count(*) filter (not raw_state) as n_false, count(*) filter (raw_state is null) as n_null, count(distinct case when raw_state then security_id end) as n_entities_true"
    curve = "select indicator, q, count(*) filter (validity_status = 'valid' and score + 1e-12 >= 1 - q)::double as n from scores_long cross join (select unnest([0.1, 0.2, 0.3, 0.4])::double as q) g group by 1, 2"
    return {
        "pr01_state_profile": query(f"select half, {prof} from two group by half"),
        "pr02_segment_count": query("select security_id, count(*) filter (raw_state and not coalesce(b, false)) as n_segments from (select *, lag(raw_state) over (partition by security_id order by trading_date) as b from uspine) group by 1"),
        "pr03_interval_profile": query("select k, count(*) as n_intervals, sum(duration_confirmed_days)::bigint as confirmed_days, round(avg(duration_raw_days), 6) as mean_raw_days, count(distinct security_id) as n_entities, round(avg(datediff('day', raw_start_date, confirmation_date)), 6) as mean_delay, count(*) filter (is_open) as n_open, count(*) filter (duration_confirmed_days > duration_raw_days) as n_inconsistent from us_int group by k"),
        "pr06_segment_durations": query(f"select count(*) as n_starts, count(*) filter (not b) as n_strict, count(*) filter (f) as n_censored, count(*) filter (days = 1) as n_single_days, {_spread_sql('days')} from (select security_id, run, count(*)::double as days, bool_and(b) filter (streak = 1) as b, bool_and(f) filter (streak = 1) as f from (select *, lag(raw_state) over w as b, row_number() over w = 1 as f from us_run window w as (partition by security_id order by trading_date)) where run is not null group by 1, 2)"),
        "pr09_overlap": query(f"select *, {_ASSOC} from (select {_COUNTS})"),
        "pr10_onset_overlap": query("select count(*) filter (a) as n_a, count(*) filter (b) as n_b, count(*) filter (a and b) as n_both from (select coalesce(raw_state, false) and not coalesce(lag(raw_state) over w, false) as a, coalesce(busy, false) and not coalesce(lag(busy) over w, false) as b from two window w as (partition by security_id order by trading_date))"),
        "pr12_parent_child": query(f"select *, {_ASSOC} from (select security_id, count(*) filter (s1 and s2) as n11, count(*) filter (s1 and not s2) as n10, count(*) filter (not s1 and s2) as n01, count(*) filter (not s1 and not s2) as n00 from st_nested where s1 is not null and s2 is not null group by 1)"),
        "as01_raw_distribution": query(f"select r.*, tail_share from (select metric, count(*) as n_rows, count(value) as n_values, {', '.join(f"count(*) filter (validity_status = '{x}') as n_{x}" for x in ('valid', 'unknown', 'diagnostic_required', 'blocked'))}, count(*) filter (value < 0) as n_outside_domain, {nine_sql('value')} from mrows group by 1) r join ({tail_sql}) using (metric)"),
        "as01_tail_ratio": query(tail_sql),
        "as03_histogram": query("select indicator, bucket, n, round(n / sum(n) over (partition by indicator), 6) as share, round(n / sum(n) over (partition by indicator) - 0.1, 6) as difference from (select indicator, least(floor(score * 10 + 1e-9), 9)::bigint as bucket, count(*) as n from scores_long where score is not null group by 1, 2)"),
        "as04_correlation_pooled": query(_corr_sql("")),
        "as25_correlation_by_security": query(_corr_sql("security_id")),
        "as06_reason_profile": query("select reason, count(*) as n, round(count(*) / (select count(*) from mrows), 6) as prevalence, round(count(*) / sum(count(*)) over (), 6) as share from (select unnest(string_split(reason_codes, ',')) as reason from mrows) group by 1"),
        "as10_association": query(f"select *, {_ASSOC} from half_counts"),
        "as13_by_security": query(f"select *, {_ASSOC} from (select security_id, {_COUNTS} group by 1)"),
        "as17_lag_targets": query("select security_id, cast(trading_date as varchar) as trading_date, anchor, k, target, complete, survived from lagt"),
        "as18_lag_profile": query(f"select {lag_d} from (select k, {lag_p} from lagt group by 1)"),
        "as23_cluster_bootstrap": query(f"""select * from (
with c as (select security_id, k, {lag_p} from lagt group by 1, 2),
n as (select security_id, row_number() over (order by security_id) - 1 as i from (select distinct security_id from c)),
w as (select replicate, pick as i, count(*) as w from (
  select replicate, ('0x' || substr(md5('5|' || replicate || '|' || draw), 1, 8))::bigint % (select count(*) from n) as pick
  from (select unnest(range(500)) as replicate) cross join (select i as draw from n)) group by 1, 2),
r as (select k, -1 as replicate, {", ".join(f"sum({c}) as {c}" for c in LAG_COUNTS)} from c group by 1
  union all select k, replicate, {", ".join(f"sum({c} * w)" for c in LAG_COUNTS)} from c join n using (security_id) join w using (i) group by 1, 2),
e as (select *, n_onset_true / nullif(n_onset, 0) as a, n_control_true / nullif(n_control, 0) as b from r),
l as (select k, replicate, unnest([{{'e': 'p_onset', 'v': a}}, {{'e': 'p_control', 'v': b}}, {{'e': 'difference', 'v': a - b}}, {{'e': 'lift', 'v': a / nullif(b, 0)}}], recursive := true) from e)
select k, e as estimate, round(max(v) filter (replicate < 0), 6) as observed, round(quantile_cont(v, 0.025) filter (replicate >= 0), 6) as low, round(quantile_cont(v, 0.975) filter (replicate >= 0), 6) as high,
  count(v) filter (replicate >= 0) as n_defined, count(*) filter (replicate >= 0) as n_replicates from l group by 1, 2)"""),
        "as22_lag_by_security": query(f"select {lag_d} from (select security_id, k, {lag_p} from lagt group by 1, 2)"),
        "as31_extremes": query("select metric, security_id, cast(trading_date as varchar) as trading_date, round(value, 6) as value from (select *, row_number() over (partition by metric order by value, security_id, trading_date) as l, row_number() over (partition by metric order by value desc, security_id, trading_date) as h from mrows where value is not null) where l <= 5 or h <= 5"),
        "yr05_concentration": query("select security_id, round(sum(share * share), 6) as hhi, round(sum(share) filter (p <= 1), 6) as top1, round(sum(share) filter (p <= 2), 6) as top2, arg_min(half, p) as peak, round(1 / sum(share * share), 6) as effective from (select *, n / sum(n) over (partition by security_id) as share, row_number() over (partition by security_id order by n desc, half) as p from (select security_id, half, count(*) filter (raw_state) as n from two group by 1, 2 having n > 0)) group by 1"),
        "yr06_leave_one_out": query("select 'all' as \"all\", half, round(a / nullif(a + b, 0), 6) as retention, round((a - n11) / nullif(a - n11 + b - n10, 0), 6) as retention_without, round((a - n11) / nullif(a - n11 + b - n10, 0) - a / nullif(a + b, 0), 6) as change from (select *, sum(n11) over () as a, sum(n10) over () as b from half_counts)"),
        "rs04_response_profile": query(f"select indicator, q, n, step, round(step / (q - lag(q) over w), 6) as slope, coalesce(sign(step) * sign(lag(step) over w) < 0, false) as reversal, lag(q) over w is null or lead(q) over w is null as boundary from (select *, n - lag(n) over (partition by indicator order by q) as step from ({curve})) window w as (partition by indicator order by q)"),
        "rs07_pareto": query("select * from (select s_nationkey, s_suppkey, s_acctbal, n_days from supplier join (select security_id, count(distinct trading_date)::double as n_days from pday group by 1) on s_suppkey = security_id) a where not exists (select 1 from supplier s join (select security_id, count(distinct trading_date)::double as nd from pday group by 1) on s.s_suppkey = security_id where s.s_nationkey = a.s_nationkey and s.s_acctbal >= a.s_acctbal - 1e-9 and nd >= a.n_days - 1e-9 and (s.s_acctbal > a.s_acctbal + 1e-9 or nd > a.n_days + 1e-9))"),
        "rs09_gates": query("select metric, security_id, value, operator, threshold, case operator when '>=' then value >= threshold else value <= threshold end as passed from (select security_id, 'n_true' as metric, (count(*) filter (raw_state))::double as value, '>=' as operator, 5.0::double as threshold from uspine group by 1 union all select security_id, 'n_null', (count(*) filter (raw_state is null))::double, '<=', 4.0::double from uspine group by 1)"),
        "nm01_blocks": query("select security_id, cast(trading_date as varchar) as trading_date, block, row_number() over (partition by security_id, block order by trading_date) - 1 as pos, count(*) over (partition by security_id, block) as len from (select *, sum(b) over (partition by security_id order by trading_date)::bigint as block from (select *, case when lag(trading_date) over w is null or year(trading_date) <> year(lag(trading_date) over w) or datediff('day', lag(trading_date) over w, trading_date) > 3 then 1 else 0 end as b from pday window w as (partition by security_id order by trading_date)))"),
        "rc01_multiset_diff": query("select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.event_type, b.event_type) as event_type, coalesce(n_left, 0) as n_left, coalesce(n_right, 0) as n_right from (select user_id, event_type, count(*) as n_left from events group by 1, 2) a full join (select user_id, event_type, count(*) as n_right from (select user_id, event_type from events where user_id % 3 <> 0 union all select user_id, event_type from events where event_id % 50 = 0) group by 1, 2) b on a.user_id = b.user_id and a.event_type = b.event_type where coalesce(n_left, 0) <> coalesce(n_right, 0)"),
        "rc02_keyed_diff": query("select unnest(['left_only', 'right_only', 'mismatched', 'mismatched_volume_shares', 'mismatched_suspension_flag']) as metric, unnest([a, 0, m, m, 0]) as value from (select count(*) filter (security_id % 9 = 4) as a, count(*) filter (security_id % 9 <> 4 and security_id % 5 = 0) as m from pday)"),
        "rc03_fingerprint": query("select c_nationkey, count(*) as n_rows, sum(h)::bigint as digest, bit_xor(h) as xor from (select c_nationkey, ('0x' || substr(md5(concat_ws('|', c_custkey::varchar, c_name, c_nationkey::varchar)), 1, 8))::bigint as h from customer) group by 1"),
        "rc05_anomaly_scan": query("select 'rows_with_zero_volume' as rule, (count(*) filter (volume_shares <= 0))::double as observed, 0.0::double as expected, case when count(*) filter (volume_shares <= 0) = 0 then 'ok' else 'anomaly' end as status from pday union all select 'suspended', count(*) filter (suspension_flag), 0.0, case when count(*) filter (suspension_flag) = 0 then 'ok' else 'anomaly' end from pday"),
        "rc07_max_share": query("select l_suppkey, n, round(n / (select count(*) from lineitem), 6) as share from (select l_suppkey, count(*) as n from lineitem group by 1) order by n desc, l_suppkey limit 1"),
    }
