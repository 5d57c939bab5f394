"""Further studies over states, scores and zones, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.conventions import ratio
from panelwright.operators import quality as Q
from panelwright.operators import states as ST
from panelwright.operators import statistics as A
from panelwright.operators import zones as Z
from panelwright.operators.selection import quantiles
from panelwright.plans import quality as PQ
from panelwright.plans.metrics import DIMENSIONS, long_scores, prices, wide_scores
from panelwright.plans.sql import query, step
from panelwright.plans.states import nested, spine, spine_confirmed, text_dates
from panelwright.plans.statistics import _ASSOC, _COUNTS, _spread_sql, nine_sql, rounded, two_states
from panelwright.plans.zones import parts
from panelwright.sources.scratch import written


def score_states(spark, d: str) -> DataFrame:
    """Two indicators of one dimension as states at q = 0.2."""
    wide = wide_scores(spark, d, indicators=list(DIMENSIONS["C"]))
    return wide.select("security_id", "trading_date", *[ST.active_state(F.lit(0.2), f"{i}.").alias(n) for i, n in (("ma_spread", "a"), ("vwap_spread", "b"))])


step("cst", "select security_id, trading_date, bool_or(act) filter (indicator = 'ma_spread') as a, bool_or(act) filter (indicator = 'vwap_spread') as b from (select *, case when validity_status = 'valid' then score + 1e-12 >= 1 - 0.2::double end as act from scores_long where dimension = 'C') group by 1, 2")


def _tail_overlap(spark, d: str) -> DataFrame:
    """Overlap of the top fifths of two scores by the discrete quantile: the n-th value in order, n = ceil(0.8 count)."""
    wide = wide_scores(spark, d, indicators=list(DIMENSIONS["C"])).select("security_id", "trading_date", F.col("ma_spread.score").alias("a"), F.col("vwap_spread.score").alias("b")).where("a is not null and b is not null")
    wide = written(wide, "tail-scores")
    long = wide.unpivot([], ["a", "b"], "side", "value")
    ends = quantiles(long, ["side"], "value", {"q": 0.8}, "nearest").groupBy().agg(*[F.max(F.when(F.col("side") == c, F.col("q"))).alias(f"{c}_end") for c in ("a", "b")])
    top = {c: F.col(c) >= F.col(f"{c}_end") for c in ("a", "b")}
    rows = wide.crossJoin(F.broadcast(ends))  # one row
    return rows.agg(F.count_if(top["a"]).alias("n_a"), F.count_if(top["b"]).alias("n_b"), F.count_if(top["a"] & top["b"]).alias("n_both"))


def _variance(spark, d: str) -> DataFrame:
    """Share of the variance of a score that lies between the securities."""
    rows = long_scores(spark, d).where("score is not null")
    each = rows.groupBy("indicator", "security_id").agg(F.count("*").alias("n"), F.avg("score").alias("m"), (F.var_pop("score") * F.count("*")).alias("within"))
    out = each.groupBy("indicator").agg(F.sum("within").alias("within"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum(F.col("n") * F.col("m")) * F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("between"))
    return rounded(out.withColumn("between_share", ratio(F.col("between"), F.col("between") + F.col("within"))))


def _year_state(spark, d: str) -> DataFrame:
    out = nested(spark, d).groupBy(F.year("trading_date").alias("year")).agg(F.count("*").alias("n_days"), F.count_if("s1").alias("n_s1"), F.count_if("s2").alias("n_s2"))
    whole = Window.partitionBy()
    return rounded(out.withColumns({"share_s1": ratio(F.col("n_s1"), F.sum("n_s1").over(whole)), "share_s2": ratio(F.col("n_s2"), F.sum("n_s2").over(whole))}))


def _clipped(spark, d: str) -> DataFrame:
    """Runs of the first state that restart with each year."""
    rows = nested(spark, d).withColumns({"raw_state": F.col("s1"), "year": F.year("trading_date")})
    runs = ST.streaks(rows, ["security_id", "year"]).where("run is not null").groupBy("year", "security_id", "run").agg(F.count("*").cast("double").alias("days"))
    return rounded(runs.groupBy("year").agg(F.count("*").alias("n_segments"), F.avg("days").alias("mean_days"), F.max("days").alias("max_days")))


def _funnel(spark, d: str) -> DataFrame:
    """Days that survive each state of the chain among days where all are known, and each step's share of the log attrition."""
    known = nested(spark, d).where("s1 is not null and s2 is not null and s3 is not null and s4 is not null")
    row = known.agg(F.count("*").alias("n0"), *[F.count_if(f"s{k}").alias(f"n{k}") for k in (1, 2, 3, 4)])
    cells = [F.struct(F.lit(k).alias("step"), F.col(f"n{k - 1}").alias("n_before"), F.col(f"n{k}").alias("n_after")) for k in (1, 2, 3, 4)]
    out = row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return rounded(out.withColumn("rate", ratio(F.col("n_after"), F.col("n_before"))))


def _identity(spark, d: str) -> DataFrame:
    """Days and intervals that k = 3 shares with k = 2."""
    days = spine_confirmed(spark, d, [2, 3]).groupBy("security_id", "trading_date").agg(F.bool_or(F.when(F.col("k") == 2, F.col("confirmed"))).alias("a"), F.bool_or(F.when(F.col("k") == 3, F.col("confirmed"))).alias("b"))
    return days.agg(F.count_if("a").alias("n_base"), F.count_if("b").alias("n_other"), F.count_if(F.col("a") & F.col("b")).alias("n_shared"), F.countDistinct(F.when(F.col("a") & F.col("b"), F.col("security_id"))).alias("n_entities"))


def _retention(spark, d: str) -> DataFrame:
    row = nested(spark, d).agg(*[F.count_if(f"s{k}").alias(f"n{k}") for k in (1, 2, 3, 4)])
    cells = [F.struct(F.lit(f"s{k}").alias("child"), F.col(f"n{k - 1}").alias("n_parent"), F.col(f"n{k}").alias("n_child")) for k in (2, 3, 4)]
    out = row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return rounded(out.withColumns({"retention": ratio(F.col("n_child"), F.col("n_parent")), "zero_denominator": F.col("n_parent") == 0}))


def _baseline(spark, d: str) -> DataFrame:
    counts = spine_confirmed(spark, d).groupBy("k").agg(F.count_if("confirmed").alias("n"))
    base = counts.where("k = 2").select(F.col("n").alias("n_base"))
    out = counts.crossJoin(F.broadcast(base))  # one row
    return rounded(out.select("k", "n", (F.col("n") - F.col("n_base")).alias("delta"), ratio(F.col("n"), F.col("n_base")).alias("ratio")))


def _zone_profile(spark, d: str) -> DataFrame:
    _, _, found = parts(spark, d, 1, 1, 2)
    found = found.withColumn("days", (F.datediff("end_date", "start_date") + 1).cast("double"))
    order = Window.partitionBy("status").orderBy("days")
    found = found.withColumns({"_i": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy("status"))})
    q95 = F.max(F.when(F.col("_i") == F.ceil(F.lit(0.95) * F.col("_n")), F.col("days")))
    return rounded(found.groupBy("status").agg(F.count("*").alias("n_zones"), F.avg("days").alias("mean_days"), q95.alias("q95_days"), F.max("n_components").alias("max_components"), F.sum("n_bridges").alias("n_bridges")))


def _reentries(spark, d: str) -> DataFrame:
    """Components after a gap that was not bridged, by the reason."""
    return Z.bridges(parts(spark, d, 1, 1, 2)[1], 2, ["security_id"]).where("reason <> 'bridged'").groupBy("reason").agg(F.count("*").alias("n_attempts"), F.sum("n_false").alias("n_false"))


def _observation(spark, d: str) -> DataFrame:
    """Daily observation: prices, status, factor by policy, limit flags (null where unknown), exclusions."""
    keys = Q.KEYS
    factor = Q.apply_factor_policy(PQ.evidence(spark, d)).select(*keys, "effective_factor", "policy")
    out = PQ.status(spark, d).join(prices(spark, d).select(*keys, "adjusted_close"), keys, "left").join(factor, keys, "left").join(PQ.limits(spark, d), keys, "left")
    return text_dates(
        out.select(
            *keys, "trading_status", "policy", (F.col("adjusted_close") * F.col("effective_factor")).alias("close"),
            F.when(F.col("up_limit").isNotNull(), F.col("adjusted_close") >= F.col("up_limit")).alias("at_up_limit"), F.when(F.col("down_limit").isNotNull(), F.col("adjusted_close") <= F.col("down_limit")).alias("at_down_limit"),
            F.when(F.col("trading_status") == "suspended", "suspended").when(F.col("adjusted_close").isNull(), "no_price").otherwise("none").alias("exclusion"),
        )
    )


def _interval_stats(spark, d: str) -> DataFrame:
    found = ST.intervals(spine_confirmed(spark, d, [1, 2]), ["security_id", "k"]).withColumn("days", F.col("duration_raw_days").cast("double"))
    return rounded(found.groupBy("k").agg(F.count("*").alias("n_intervals"), *A.spread("days")))


def _checks(spark, d: str) -> DataFrame:
    """Contract checks of the spine: name, number of violations, status."""
    rows = spine(spark, d)
    w = Window.partitionBy("security_id").orderBy("trading_date")
    rows = rows.withColumn("_step", F.col("observation_sequence") - F.lag("observation_sequence").over(w))
    out = Q.as_metrics(rows.agg((F.count("*") - F.countDistinct("security_id", "trading_date")).alias("repeated_keys"), F.count_if(F.col("_step") != 1).alias("broken_sequence"), F.count_if((F.col("validity_status") == "valid") & F.col("raw_state").isNull()).alias("valid_without_state")))
    return out.withColumn("status", F.when(F.col("value") == 0, "pass").otherwise("fail"))


step("ints12", "select * from (select 1 as k, security_id, run, count(*)::double as days from us_run where run is not null group by 2, 3 union all select 2, security_id, run, count(*)::double from us_run where run is not null group by 2, 3 having count(*) >= 2)")
step("known4", "select * from st_nested where s1 is not null and s2 is not null and s3 is not null and s4 is not null")
step("zbr", "select *, lead(bridged) over (partition by security_id order by first_seq) as nb from zb_asg")


def queries() -> dict:
    return {
        "as02_score_distribution": lambda s, d: rounded(A.distribution(long_scores(s, d), "indicator", "score", "validity_status", F.col("score").between(0, 1))),
        "as05_threshold_structure": lambda s, d: rounded(A.overlap(score_states(s, d), "a", "b", [])),
        "as12_denominators": lambda s, d: rounded(A.overlap(nested(s, d).where("T is not null and V is not null"), "P", "C", [])),
        "as16_onset_classes": lambda s, d: _onsets(s, d),
        "as24_tail_overlap": _tail_overlap,
        "as27_variance_decomposition": _variance,
        "pr04_retention": _retention,
        "pr05_relative_to_baseline": _baseline,
        "pr07_interval_stats": _interval_stats,
        "yr01_year_state": _year_state,
        "yr03_clipped_segments": _clipped,
        "yr04_year_interlayer": lambda s, d: rounded(A.overlap(nested(s, d).withColumn("year", F.year("trading_date")), "P", "C", ["year"])),
        "rs02_funnel": _funnel,
        "rs03_identity": _identity,
        "nm06_retention_by_block": lambda s, d: rounded(A.overlap(A.blocks(two_states(s, d)), "raw_state", "busy", ["block"])),
        "ez08_reentries": _reentries,
        "ez12_zone_profile": _zone_profile,
        "dq23_observation": _observation,
        "dy07_contract_checks": _checks,
        "dq34_price_counts_by_month": lambda s, d: prices(s, d).groupBy(F.date_format("trading_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("n_rows"), F.countDistinct("security_id").alias("n_entities"), F.count_if("suspension_flag").alias("n_suspended")),
    }


def _onsets(spark, d: str) -> DataFrame:
    w = Window.partitionBy("security_id").orderBy("trading_date")
    before = F.lag("raw_state").over(w)
    first = F.row_number().over(w) == 1
    kind = F.when(F.col("raw_state").isNull(), "invalid").when(first, "first_day").when(before.isNull(), "after_invalid").when(~before & F.col("raw_state"), "onset").when(~before, "stay_out").when(F.col("raw_state"), "stay_in").otherwise("exit")
    return spine(spark, d).withColumn("kind", kind).groupBy("kind").agg(F.count("*").alias("n_days"))


def oracle_sql() -> dict[str, str]:
    dims = "count(*) filter (P and C) as n11, count(*) filter (P and not C) as n10, count(*) filter (not P and C) as n01, count(*) filter (not P and not C) as n00"
    return {
        "as02_score_distribution": query(f"select r.*, tail_share from (select indicator, count(*) as n_rows, count(score) as n_values, {', '.join(f"count(*) filter (validity_status = '{x}') as n_{x}" for x in ('valid', 'unknown', 'diagnostic_required', 'blocked'))}, count(*) filter (score < 0 or score > 1) as n_outside_domain, {nine_sql('score')} from scores_long group by 1) r join (select indicator, round(avg((score < lo or score > hi)::int), 6) as tail_share from scores_long join (select indicator, quantile_cont(score, 0.01) as lo, quantile_cont(score, 0.99) as hi from scores_long group by 1) using (indicator) where score is not null group by 1) using (indicator)"),
        "as05_threshold_structure": query(f"select *, {_ASSOC} from (select count(*) filter (a and b) as n11, count(*) filter (a and not b) as n10, count(*) filter (not a and b) as n01, count(*) filter (not a and not b) as n00 from cst where a is not null and b is not null)"),
        "as12_denominators": query(f"select *, {_ASSOC} from (select {dims} from st_nested where P is not null and C is not null and T is not null and V is not null)"),
        "as16_onset_classes": query("select kind, count(*) as n_days from (select case when raw_state is null then 'invalid' when row_number() over w = 1 then 'first_day' when lag(raw_state) over w is null then 'after_invalid' when not lag(raw_state) over w and raw_state then 'onset' when not lag(raw_state) over w then 'stay_out' when raw_state then 'stay_in' else 'exit' end as kind from uspine window w as (partition by security_id order by trading_date)) group by 1"),
        "as24_tail_overlap": query("with w as (select security_id, trading_date, max(score) filter (indicator = 'ma_spread') as a, max(score) filter (indicator = 'vwap_spread') as b from scores_long where dimension = 'C' and score is not null group by 1, 2), v as (select * from w where a is not null and b is not null), e as (select (select a from (select a, row_number() over (order by a) as i from v) where i = (select ceil(0.8 * count(*)) from v)) as ea, (select b from (select b, row_number() over (order by b) as i from v) where i = (select ceil(0.8 * count(*)) from v)) as eb) select count(*) filter (a >= ea) as n_a, count(*) filter (b >= eb) as n_b, count(*) filter (a >= ea and b >= eb) as n_both from v, e").replace("\nwith w as", ",\nw as"),
        "as27_variance_decomposition": query("select indicator, round(w, 6) as within, round(b, 6) as between, round(b / (b + w), 6) as between_share from (select indicator, sum(wi) as w, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) as b from (select indicator, security_id, count(*) as n, avg(score) as m, var_pop(score) * count(*) as wi from scores_long where score is not null group by 1, 2) group by 1)").replace("as between,", 'as "between",'),
        "pr04_retention": query("select child, n_parent, n_child, round(n_child / nullif(n_parent, 0), 6) as retention, n_parent = 0 as zero_denominator from (select unnest(['s2', 's3', 's4']) as child, unnest([a, b, c]) as n_parent, unnest([b, c, e]) as n_child from (select count(*) filter (s1) as a, count(*) filter (s2) as b, count(*) filter (s3) as c, count(*) filter (s4) as e from st_nested))"),
        "pr05_relative_to_baseline": query("select k, n, n - b as delta, round(n / nullif(b, 0), 6) as ratio from (select *, max(case when k = 2 then n end) over () as b from (select k, count(*) filter (confirmed) as n from us_conf group by 1))"),
        "pr07_interval_stats": query(f"select k, count(*) as n_intervals, {_spread_sql('days')} from ints12 group by 1"),
        "yr01_year_state": query("select year, n_days, n_s1, n_s2, round(n_s1 / nullif(sum(n_s1) over (), 0), 6) as share_s1, round(n_s2 / nullif(sum(n_s2) over (), 0), 6) as share_s2 from (select year(trading_date) as year, count(*) as n_days, count(*) filter (s1) as n_s1, count(*) filter (s2) as n_s2 from st_nested group by 1)"),
        "yr03_clipped_segments": query("select y as year, count(*) as n_segments, round(avg(days), 6) as mean_days, max(days) as max_days from (select y, security_id, g, count(*)::double as days from (select *, sum(case when o and not coalesce(lo, false) then 1 else 0 end) over (partition by security_id, y order by trading_date) as g from (select *, lag(o) over (partition by security_id, y order by trading_date) as lo from (select security_id, trading_date, year(trading_date) as y, coalesce(s1, false) as o from st_nested))) where o group by 1, 2, 3) group by 1"),
        "yr04_year_interlayer": query(f"select *, {_ASSOC} from (select year(trading_date) as year, {dims} from st_nested where P is not null and C is not null group by 1)"),
        "rs02_funnel": query("select step, n_before, n_after, round(n_after / nullif(n_before, 0), 6) as rate from (select unnest([1, 2, 3, 4]) as step, unnest([z, a, b, c]) as n_before, unnest([a, b, c, e]) as n_after from (select count(*) as z, count(*) filter (s1) as a, count(*) filter (s2) as b, count(*) filter (s3) as c, count(*) filter (s4) as e from known4))"),
        "rs03_identity": query("select count(*) filter (a) as n_base, count(*) filter (b) as n_other, count(*) filter (a and b) as n_shared, count(distinct case when a and b then security_id end) as n_entities from (select security_id, trading_date, bool_or(confirmed) filter (k = 2) as a, bool_or(confirmed) filter (k = 3) as b from us_conf group by 1, 2)"),
        "nm06_retention_by_block": query(f"select *, {_ASSOC} from (select 1 as block, {_COUNTS})"),
        "ez08_reentries": query("select reason, count(*) as n_attempts, sum(n_false)::bigint as n_false from (select n_false, case when nb then 'bridged' when not qualified then 'left_unqualified' when not next_qualified then 'right_unqualified' when n_breaks > 0 then 'hard_break' when n_false > 2 then 'too_long' else 'no_false_row' end as reason from zbr where next_start is not null) where reason <> 'bridged' group by 1"),
        "ez12_zone_profile": query("select status, count(*) as n_zones, round(avg(days), 6) as mean_days, max(days) filter (i = ceil(0.95 * n)) as q95_days, max(n_components) as max_components, sum(n_bridges)::bigint as n_bridges from (select *, row_number() over (partition by status order by days) as i, count(*) over (partition by status) as n from (select *, (datediff('day', start_date, end_date) + 1)::double as days from zb_zone)) group by 1"),
        "dq23_observation": query("select s.security_id, cast(s.trading_date as varchar) as trading_date, trading_status, case when adj_factor is null then 'neutral_factor' else 'source' end as policy, round(adjusted_close * coalesce(adj_factor, 1.0), 9) as close, case when up_limit is not null then adjusted_close >= up_limit end as at_up_limit, case when down_limit is not null then adjusted_close <= down_limit end as at_down_limit, case when trading_status = 'suspended' then 'suspended' when adjusted_close is null then 'no_price' else 'none' end as exclusion from srcst s left join pday using (security_id, trading_date) left join evid using (security_id, trading_date) left join lims using (security_id, trading_date)"),
        "dy07_contract_checks": query("select unnest(['repeated_keys', 'broken_sequence', 'valid_without_state']) as metric, unnest([a, b, c])::double as value, case when unnest([a, b, c]) = 0 then 'pass' else 'fail' end as status from (select count(*) - count(distinct (security_id, trading_date)) as a, count(*) filter (st <> 1) as b, count(*) filter (validity_status = 'valid' and raw_state is null) as c from (select *, observation_sequence - lag(observation_sequence) over (partition by security_id order by trading_date) as st from uspine))"),
        "dq34_price_counts_by_month": query("select strftime(trading_date, '%Y-%m') as month, count(*) as n_rows, count(distinct security_id) as n_entities, count(*) filter (suspension_flag) as n_suspended from pday group by 1"),
    }
