"""Queries over parameter vectors and decisions, stability, ablation and endpoints, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.conventions import chain_and, ratio
from panelwright.operators import decisions as D
from panelwright.operators import records as R
from panelwright.operators import states as ST
from panelwright.operators import statistics as A
from panelwright.plans.metrics import DIMENSIONS, wide_dims, wide_scores
from panelwright.plans.records import low_intervals
from panelwright.plans.sql import query, step
from panelwright.plans.states import DIMS, low_range, nested, nested_of, streak_steps, text_dates
from panelwright.plans.statistics import rounded, two_states
from panelwright.sources.scratch import written

QS, BASE, FLOOR, FALLBACK, YEAR_SHARE = [0.1, 0.2, 0.3, 0.4], 0.2, 5, 0.001, 0.9
STATES = ["s1", "s2", "s3", "s4"]
PAIR = ("log_range20", "ma_spread")


def days(spark, d: str) -> DataFrame:
    return D.vector_days(wide_dims(spark, d), D.q_registry(spark, DIMS, QS, BASE), DIMS)


def yearly(spark, d: str) -> DataFrame:
    """Written, as profile, envelopes and shares read it again (some rows a vector and year)."""
    return written(D.yearly_counts(days(spark, d), DIMS), "yearly-counts")


def profile(y: DataFrame) -> DataFrame:
    """Coverage of the state that the changed layer takes part in first."""
    return D.coverage(D.affected(y, DIMS), ["vector_id", "changed_layer", "changed_q", "role", "state"])


def bounds(y: DataFrame) -> DataFrame:
    return D.envelopes(y.where("role = 'baseline'").select("state", "period", "n_known", "n_true"), FALLBACK)


def found(y: DataFrame) -> DataFrame:
    return D.evidence(profile(y), bounds(y))


def _decisions(spark, d: str) -> DataFrame:
    y = yearly(spark, d)
    share = D.affected(y, DIMS).groupBy("vector_id").agg(ratio(F.max("n_true"), F.sum("n_true")).alias("top_year_share"))
    out = D.decisions(found(y), FLOOR, YEAR_SHARE, share)
    return rounded(out.select("vector_id", "changed_layer", "n_true", "top_year_share", "change", "envelope", "supported", "decision"))


def handed(spark, d: str) -> DataFrame:
    return D.handoff(D.requests(found(yearly(spark, d)), FLOOR), FLOOR)


def _vector_intervals(spark, d: str) -> DataFrame:
    """Confirmed intervals of every vector's second state; the vectors stand side by side."""
    each, first = D.vectors(DIMS, QS, BASE), DIMS[:2]
    weak = {f"{c}_{q}": ST.weak_state(F.lit(q), of=f"{c}.") for c in first for q in QS}
    rows = wide_dims(spark, d, {c: DIMENSIONS[c] for c in first}).select("security_id", "trading_date", *[s.alias(n.replace(".", "_")) for n, s in weak.items()])
    state = lambda v: chain_and(*[F.col(f"{c}_{v[c]}".replace(".", "_")) for c in first])
    rows = rows.withColumns({f"{name}_state": state(v) for name, v in each.items()})
    rows = rows.withColumns({f"{name}_status": F.when(F.col(f"{name}_state").isNull(), "unknown").otherwise("valid") for name in each})
    return text_dates(ST.wide_intervals(rows, {name: (f"{name}_state", f"{name}_status", 2) for name in each}, "vector_id"))


def _reconcile(spark, d: str) -> DataFrame:
    """States of the baseline vector, recomputed from scores, against the nested states as released."""
    keys = ["security_id", "trading_date"]
    fields = ("score_mean", "score_min", "validity_status")
    scores = written(wide_dims(spark, d).select(*keys, *[F.struct(*[f"{c}.{x}" for x in fields]).alias(c) for c in DIMS]), "reconciled-scores")
    own = D.vector_days(scores, D.q_registry(spark, DIMS, QS, BASE), DIMS).where("role = 'baseline'").select(*keys, *[F.col(s).alias(f"own_{s}") for s in STATES])
    both = own.join(nested_of(scores), keys, "full")
    row = both.agg(*[F.count_if(~F.col(f"own_{s}").eqNullSafe(F.col(s))).alias(s) for s in STATES], F.count("*").alias("n_rows"))
    return row.unpivot(["n_rows"], STATES, "state", "n_differ")


def pair_wide(spark, d: str) -> DataFrame:
    a, b = PAIR
    rows = wide_scores(spark, d, indicators=list(PAIR))
    return rows.select("security_id", "trading_date", F.col(f"{a}.score").alias("a"), F.col(f"{b}.score").alias("b"), F.year("trading_date").alias("period"))


def _stability(spark, d: str) -> DataFrame:
    """Spread of the pair's rank correlation over years and over securities with at least ten common days."""
    wide = pair_wide(spark, d)
    parts = []
    for by in ("period", "security_id"):
        one = A.correlations(wide, "a", "b", [by]).where("n >= 10 and not isnan(spearman)")
        cols = [F.percentile("spearman", q).alias(f"q{round(q * 100):02d}") for q in (0.1, 0.25, 0.5, 0.75, 0.9)]
        parts.append(one.agg(F.lit("year" if by == "period" else "security").alias("scope"), F.count("*").alias("n"), F.min("spearman").alias("least"), F.max("spearman").alias("greatest"), *cols, F.count_if(F.col("spearman") < 0).alias("n_negative")))
    return rounded(parts[0].unionByName(parts[1]))


_GATES = {"least": 0.5, "q10": 0.4, "q50": 0.7}


def _disposition(spark, d: str) -> DataFrame:
    """Redundancy criteria over the stability rows; redundant where every criterion of a scope holds."""
    long = _stability(spark, d).unpivot(["scope"], list(_GATES), "criterion", "actual")
    limit = F.create_map(*[F.lit(x) for pair in _GATES.items() for x in pair])[F.col("criterion")]
    out = long.withColumn("threshold", limit).withColumn("passed", F.coalesce(F.col("actual") >= F.col("threshold"), F.lit(False)))
    return out.withColumn("redundant", F.bool_and("passed").over(Window.partitionBy("scope")))


_VARIANTS = {"baseline": "(a + b) / 2 + 1e-12 >= 0.7 and least(a, b) + 1e-12 >= 0.6", "a_only": "a + 1e-12 >= 0.7", "b_only": "b + 1e-12 >= 0.7"}


def variants(spark, d: str) -> DataFrame:
    """Active states of the pair and of each component; null where not both are valid."""
    return pair_wide(spark, d).withColumns({n: F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.expr(c)) for n, c in _VARIANTS.items()})


def _ablation(spark, d: str) -> DataFrame:
    rows = variants(spark, d).where("baseline is not null").unpivot(["baseline"], ["a_only", "b_only"], "variant", "active")
    out = rows.groupBy("variant").agg(F.count("*").alias("n"), F.count_if(F.col("baseline") & F.col("active")).alias("n_both"), F.count_if("baseline").alias("n_baseline"), F.count_if("active").alias("n_variant"))
    n = F.col("n_both")
    return rounded(out.withColumns({"jaccard": ratio(n, F.col("n_baseline") + F.col("n_variant") - n), "precision": ratio(n, F.col("n_variant")), "recall": ratio(n, F.col("n_baseline")), "n_symmetric": F.col("n_baseline") + F.col("n_variant") - 2 * n}))


def _variant_profile(spark, d: str) -> DataFrame:
    """Transitions and segments of each variant; a day without a state breaks a segment."""
    rows = variants(spark, d).unpivot(["security_id", "trading_date", "period"], list(_VARIANTS), "variant", "active")
    before = F.lag("active").over(Window.partitionBy("variant", "security_id").orderBy("trading_date"))
    rows = rows.withColumn("before", before)
    out = rows.groupBy("variant").agg(
        F.count("active").alias("n_known"), F.count_if("active").alias("n_true"), F.count_if(F.col("active") & ~F.col("before")).alias("n_on"), F.count_if(~F.col("active") & F.col("before")).alias("n_off"),
        F.count_if(F.col("active") & ~F.coalesce("before", F.lit(False))).alias("n_segments"), F.countDistinct(F.when(F.col("active"), F.col("period"))).alias("n_years"),
    )
    top = rows.where("active").groupBy("variant", "period").count().groupBy("variant").agg(F.max("count").alias("top_year"))
    return rounded(out.join(top, "variant", "left").withColumn("top_year_share", ratio(F.col("top_year"), F.col("n_true"))))


def _score_comparison(spark, d: str) -> DataFrame:
    """Absolute difference of the pair's scores by year, over days on which both are valid."""
    rows = pair_wide(spark, d).where("a is not null and b is not null").withColumn("x", F.abs(F.col("a") - F.col("b")))
    return rounded(rows.groupBy(F.col("period").cast("long").alias("period")).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), *[F.percentile("x", q).alias(f"q{round(q * 100):02d}") for q in (0.5, 0.9)], F.count_if(F.col("x") > 0.5).alias("n_far")))


def _denominators(spark, d: str) -> DataFrame:
    """2x2 counts of the first two layers on three denominators, and the days that explain their differences."""
    n = nested(spark, d)
    sets = {"pair": "P is not null and C is not null", "three": "P is not null and C is not null and T is not null", "all": "P is not null and C is not null and T is not null and V is not null"}
    cells = {"n11": "P and C", "n10": "P and not C", "n01": "not P and C", "n00": "not P and not C"}
    n = n.withColumns({f"_in_{name}": F.expr(c) for name, c in sets.items()})
    own = {f"{name}_{k}": F.count_if(F.col(f"_in_{name}") & F.coalesce(F.expr(x), F.lit(False))) for name in sets for k, x in {"n": "true", **cells}.items()}
    explained = {"lost_to_t": F.count_if(F.col("_in_pair") & F.col("T").isNull()), "lost_to_v": F.count_if(F.col("_in_three") & F.col("V").isNull())}
    row = n.agg(*[c.alias(name) for name, c in (own | explained).items()])  # all sets from one pass
    rows = [F.struct(F.lit(name).alias("denominator"), *[F.col(f"{name}_{k}").alias(k) for k in ("n", *cells)]) for name in sets]
    return row.select(F.explode(F.array(*rows)).alias("r"), *explained).select("r.*", *explained)


_INVARIANTS = {
    "states_fill_days": "n_true + n_false + n_null <> n_days", "statuses_fill_days": "n_valid + n_unknown + n_blocked <> n_days", "true_within_valid": "n_true + n_false > n_valid",
    "segments_within_true": "n_segments > n_true", "entities_within_true": "n_entities_true > n_true",
}


def _invariants(spark, d: str) -> DataFrame:
    """Rules over the state profile of each security, reconciled with its segment count; rows that break one."""
    two = two_states(spark, d)
    prof = A.state_profile(two, ["security_id"]).join(A.segment_count(two, ["security_id"]), "security_id", "left").fillna(0, ["n_segments"])
    row = prof.agg(F.count("*").alias("n_profiles"), *[F.count_if(F.expr(c)).alias(n) for n, c in _INVARIANTS.items()])
    return row.unpivot(["n_profiles"], list(_INVARIANTS), "rule", "n_broken")


ANCHORS = ["raw_start_date", "confirmation_date", "interval_end_date", "last_observed_date"]


def _endpoints(spark, d: str) -> DataFrame:
    """Scores on the four dates of each confirmed interval: their number and quantiles by anchor."""
    long = low_intervals(spark, d).unpivot(["security_id", "interval_no"], ANCHORS, "anchor", "trading_date").where("trading_date is not null")
    rows = long.join(low_range(spark, d).select("security_id", "trading_date", "score"), ["security_id", "trading_date"], "left")
    return rounded(rows.groupBy("anchor").agg(F.count("*").alias("n"), F.count("score").alias("n_scores"), F.avg("score").alias("mean"), *[F.percentile("score", q).alias(f"q{round(q * 100):02d}") for q in (0.05, 0.5, 0.95)]))


_VALUES = ", ".join("('{}', '{}', {}::double, '{}', {})".format("_".join(f"{c}{round((q if c == layer else BASE) * 100):02d}" for c in DIMS), layer, q, role, ", ".join(f"{q if c == layer else BASE}::double" for c in DIMS)) for layer, q, role in [("BASELINE", BASE, "baseline")] + [(c, q, "nonbaseline") for c in DIMS for q in QS if q != BASE])
step("dc_reg", f"select * from (values {_VALUES}) v(vector_id, changed_layer, changed_q, role, {', '.join('q' + c for c in DIMS)})")
_piv = ", ".join(f"max(score_mean) filter (dimension = '{c}' and validity_status = 'valid') as m{c}, max(score_min) filter (dimension = '{c}' and validity_status = 'valid') as l{c}" for c in DIMS)
_act = ", ".join(f"m{c} + 1e-12 >= 1 - q{c} and l{c} + 1e-12 >= 1 - q{c} - 0.1 as {c}" for c in DIMS)
_chain = f"select *, P as s1, case when not P then false when P is null then null else C end as s2 from (select *, {_act} from (select security_id, trading_date, {_piv} from dim_scores group by 1, 2) cross join dc_reg)"
for _a, _b, _c in (("s2", "s3", "T"), ("s3", "s4", "V")):
    _chain = f"select *, case when not {_a} then false when {_a} is null then null else {_c} end as {_b} from ({_chain})"
step("dc_day", f"select *, case changed_layer when 'C' then s2 when 'T' then s3 when 'V' then s4 else s1 end as aff, case changed_layer when 'C' then 's2' when 'T' then 's3' when 'V' then 's4' else 's1' end as state from ({_chain})")
step("dc_prof", "select vector_id, changed_layer, changed_q, role, state, count(aff) as n_known, count(*) filter (aff) as n_true, count(*) filter (aff) / nullif(count(aff), 0) as coverage from dc_day group by 1, 2, 3, 4, 5")
_yearly = " union all ".join(f"select '{s}' as state, year(trading_date) as period, count({s}) as k, count(*) filter ({s}) as t from dc_day where role = 'baseline' group by 2" for s in STATES)
step("dc_env", f"""
select state, max(pooled) as pooled, coalesce(max(abs(without - pooled)), 0) as loyo, coalesce(quantile_cont(abs(y - med), 0.5), 0) * 1.4826 as mad, greatest(coalesce(max(abs(without - pooled)), 0), coalesce(quantile_cont(abs(y - med), 0.5), 0) * 1.4826, {FALLBACK}) as envelope
from (select *, quantile_cont(y, 0.5) over (partition by state) as med from (select *, t / nullif(k, 0) as y, sum(t) over w / nullif(sum(k) over w, 0) as pooled, (sum(t) over w - t) / nullif(sum(k) over w - k, 0) as without from ({_yearly}) window w as (partition by state))) group by 1""")
step("dc_evid", """
select *, coalesce(sign(lag(change) over w) = sign(change), true) and coalesce(sign(lead(change) over w) = sign(change), true) as supported, case when degrades then 'baseline_dominates' when improves then 'tradeoff_not_dominated' else 'equivalent' end as dominance
from (select *, change > envelope as improves, change < -envelope as degrades from (select p.*, pooled, envelope, coverage - pooled as change from dc_prof p join dc_env using (state) where role <> 'baseline')) window w as (partition by changed_layer order by changed_q)""")
step("dc_req", f"""
select *, case when centre then 'center' when coalesce(lag(centre) over w, false) or coalesce(lead(centre) over w, false) then 'immediate_neighbor' end as request_role
from (select *, row_number() over (partition by changed_layer order by n_true desc, vector_id) = 1 and n_true >= {FLOOR} as centre from dc_evid) window w as (partition by changed_layer order by changed_q)""")
step("dc_hand", f"select *, case when failed_gates <> '' then 'do_not_freeze' when request_role = 'center' then 'freeze_candidate' else 'review_candidate' end as handoff from (select *, concat_ws(';', case when n_true < {FLOOR} then 'existence' end, case when not supported then 'neighborhood' end, case when dominance = 'baseline_dominates' then 'dominance' end) as failed_gates from dc_req where request_role is not null)")
streak_steps("dcv", "(select vector_id || '|' || security_id as security_id, trading_date, s2 as raw_state, case when s2 is null then 'unknown' else 'valid' end as validity_status from dc_day)")
step("dc_pair", "select *, year(trading_date) as period from cwide")
step("dc_var", "select *, " + ", ".join(f"case when a is not null and b is not null then {c} end as {n}" for n, c in _VARIANTS.items()) + " from dc_pair")


def _stab_sql(by: str, scope: str) -> str:
    ranks = ", ".join(f"rank() over (partition by {by} order by {c}) + (count(*) over (partition by {by}, {c}) - 1) / 2.0 as r{c}" for c in "ab")
    qs = ", ".join(f"round(quantile_cont(s, {q}), 6) as q{round(q * 100):02d}" for q in (0.1, 0.25, 0.5, 0.75, 0.9))
    return f"select '{scope}' as scope, count(*) as n, round(min(s), 6) as least, round(max(s), 6) as greatest, {qs}, count(*) filter (s < 0) as n_negative from (select {by}, count(*) as n, corr(ra, rb) as s from (select *, {ranks} from dc_pair where a is not null and b is not null) group by 1) where n >= 10 and not isnan(s)"


step("dc_stab", _stab_sql("period", "year") + " union all " + _stab_sql("security_id", "security"))

_VEC = ["vector_id", "changed_layer", "changed_q"]


def queries() -> dict:
    return {
        "cf05_vector_intervals": _vector_intervals,
        "as15_states_recomputed": _reconcile,
        "as28_stability": _stability,
        "as29_disposition": _disposition,
        "as32_ablation": _ablation,
        "as33_variant_profile": _variant_profile,
        "as34_score_comparison": _score_comparison,
        "as35_denominators": _denominators,
        "pr14_invariants": _invariants,
        "dy12_endpoint_scores": _endpoints,
        "rs01_vector_profile": lambda s, d: rounded(profile(yearly(s, d))),
        "rs05_layer_impact": lambda s, d: rounded(D.layer_impact(profile(yearly(s, d)))),
        "rs06_envelopes": lambda s, d: rounded(bounds(yearly(s, d))),
        "rs08_requests": lambda s, d: D.requests(found(yearly(s, d)), FLOOR).select(*_VEC, "n_true", "request_role"),
        "rs10_recommendation": lambda s, d: rounded(D.recommend(found(yearly(s, d)), FLOOR, BASE)),
        "rs11_handoff": lambda s, d: handed(s, d).select(*_VEC, "request_role", "failed_gates", "handoff"),
        "rs12_shortlist": lambda s, d: rounded(D.shortlist(handed(s, d)).select(*_VEC, "handoff", "place", "disposition")),
        "rs13_dominance": lambda s, d: rounded(found(yearly(s, d)).select(*_VEC, "change", "envelope", "improves", "degrades", "supported", "dominance")),
        "rs14_decisions": _decisions,
    }


def oracle_sql() -> dict[str, str]:
    var = " union all ".join(f"select security_id, trading_date, period, '{n}' as variant, {n} as active from dc_var" for n in _VARIANTS)
    sets = {"pair": "true", "three": "T is not null", "all": "T is not null and V is not null"}
    inv = "select s.security_id, count(*) as n_days, count(*) filter (validity_status = 'valid') as n_valid, count(*) filter (validity_status = 'unknown') as n_unknown, count(*) filter (validity_status = 'blocked') as n_blocked, count(*) filter (raw_state) as n_true, count(*) filter (not raw_state) as n_false, count(*) filter (raw_state is null) as n_null, count(distinct case when raw_state then s.security_id end) as n_entities_true, count(*) filter (raw_state and not coalesce(b, false)) as n_segments from (select *, lag(raw_state) over (partition by security_id order by trading_date) as b from two) s group by 1"
    ends = " union all ".join(f"select security_id, '{a}' as anchor, {a} as trading_date from lr_int where k = 3 and {a} is not null" for a in ANCHORS)
    v = "vector_id, changed_layer, changed_q"
    return {
        "cf05_vector_intervals": query("select split_part(security_id, '|', 2)::bigint as security_id, split_part(security_id, '|', 1) as vector_id, interval_no, cast(raw_start_date as varchar) as raw_start_date, cast(confirmation_date as varchar) as confirmation_date, cast(interval_end_date as varchar) as interval_end_date, cast(last_observed_date as varchar) as last_observed_date, duration_raw_days, duration_confirmed_days, is_open, termination_reason from dcv_int where k = 2"),
        "as15_states_recomputed": query("select count(*) as n_rows, unnest(['s1', 's2', 's3', 's4']) as state, 0::bigint as n_differ from st_nested"),
        "as28_stability": query("select * from dc_stab"),
        "as29_disposition": query("select *, bool_and(passed) over (partition by scope) as redundant from (select *, coalesce(actual >= threshold, false) as passed from (" + " union all ".join(f"select scope, '{c}' as criterion, {c} as actual, {t}::double as threshold from dc_stab" for c, t in _GATES.items()) + "))"),
        "as32_ablation": query("select *, round(n_both / nullif(n_baseline + n_variant - n_both, 0), 6) as jaccard, round(n_both / nullif(n_variant, 0), 6) as precision, round(n_both / nullif(n_baseline, 0), 6) as recall, n_baseline + n_variant - 2 * n_both as n_symmetric from (" + " union all ".join(f"select '{n}' as variant, count(*) as n, count(*) filter (baseline and {n}) as n_both, count(*) filter (baseline) as n_baseline, count(*) filter ({n}) as n_variant from dc_var where baseline is not null" for n in ("a_only", "b_only")) + ")"),
        "as33_variant_profile": query(f"with v as ({var}) select p.*, top_year, round(top_year / nullif(n_true, 0), 6) as top_year_share from (select variant, count(active) as n_known, count(*) filter (active) as n_true, count(*) filter (active and not b) as n_on, count(*) filter (not active and b) as n_off, count(*) filter (active and not coalesce(b, false)) as n_segments, count(distinct case when active then period end) as n_years from (select *, lag(active) over (partition by variant, security_id order by trading_date) as b from v) group by 1) p left join (select variant, max(n) as top_year from (select variant, period, count(*) as n from v where active group by 1, 2) group by 1) t on p.variant = t.variant").replace("\nwith v as", ", v as", 1),
        "as34_score_comparison": query("select period, count(*) as n, round(avg(x), 6) as mean, round(quantile_cont(x, 0.5), 6) as q50, round(quantile_cont(x, 0.9), 6) as q90, count(*) filter (x > 0.5) as n_far from (select *, abs(a - b) as x from dc_pair where a is not null and b is not null) group by 1"),
        "as35_denominators": query("select * from (" + " union all ".join(f"select '{n}' as denominator, count(*) as n, count(*) filter (P and C) as n11, count(*) filter (P and not C) as n10, count(*) filter (not P and C) as n01, count(*) filter (not P and not C) as n00 from st_nested where P is not null and C is not null and {c}" for n, c in sets.items()) + ") cross join (select count(*) filter (T is null) as lost_to_t, count(*) filter (T is not null and V is null) as lost_to_v from st_nested where P is not null and C is not null)"),
        "pr14_invariants": query(" union all ".join(f"select count(*) as n_profiles, '{n}' as rule, count(*) filter ({c}) as n_broken from ({inv})" for n, c in _INVARIANTS.items())),
        "dy12_endpoint_scores": query(f"select anchor, count(*) as n, count(score) as n_scores, round(avg(score), 6) as mean, round(quantile_cont(score, 0.05), 6) as q05, round(quantile_cont(score, 0.5), 6) as q50, round(quantile_cont(score, 0.95), 6) as q95 from ({ends}) e left join (select security_id, trading_date, score from sc_log_range20) s on e.security_id = s.security_id and e.trading_date = s.trading_date group by 1"),
        "rs01_vector_profile": query("select * replace (round(coverage, 6) as coverage) from dc_prof"),
        "rs05_layer_impact": query("select changed_layer, round(span, 6) as span, n_vectors, place, case when place = 1 and span > 0.05 then 'dominant' when span <= 0.01 then 'low' else 'moderate' end as impact from (select *, rank() over (order by span desc) as place from (select changed_layer, max(coverage) - min(coverage) as span, count(*) as n_vectors from dc_prof where role <> 'baseline' group by 1))"),
        "rs06_envelopes": query("select state, round(pooled, 6) as pooled, round(loyo, 6) as loyo, round(mad, 6) as mad, round(envelope, 6) as envelope from dc_env"),
        "rs08_requests": query(f"select {v}, n_true, request_role from dc_req where request_role is not null"),
        "rs10_recommendation": query(f"select changed_layer, case when n_passing > 0 then 'recommended' else 'no_pass' end as status, recommended, warnings, distance, coalesce(n_passing, 0) as n_passing from (select distinct changed_layer from dc_evid) left join (select changed_layer, count(*) as n_passing, arg_min(vector_id, o) as recommended, arg_min(w, o) as warnings, arg_min(dist, o) as distance from (select *, row(w, dist, vector_id) as o from (select *, (not supported)::bigint + (dominance = 'baseline_dominates')::bigint as w, round(abs(changed_q - {BASE}), 6) as dist from dc_evid where n_true >= {FLOOR})) group by 1) using (changed_layer)"),
        "rs11_handoff": query(f"select {v}, request_role, failed_gates, handoff from dc_hand"),
        "rs12_shortlist": query(f"select {v}, handoff, place, case when handoff = 'do_not_freeze' then 'rejected' when place = 1 then 'canonical' else 'evidence' end as disposition from (select *, row_number() over (partition by changed_layer order by case handoff when 'freeze_candidate' then 0 when 'review_candidate' then 1 else 2 end, n_true desc, vector_id) as place from dc_hand)"),
        "rs13_dominance": query(f"select {v}, round(change, 6) as change, round(envelope, 6) as envelope, improves, degrades, supported, dominance from dc_evid"),
        "rs14_decisions": query(f"select e.vector_id, changed_layer, n_true, round(sh, 6) as top_year_share, round(change, 6) as change, round(envelope, 6) as envelope, supported, case when n_true < {FLOOR} then 'insufficient' when sh > {YEAR_SHARE} then 'year_concentrated' when not supported then 'isolated_peak' when degrades then 'baseline_dominates' when not improves then 'prefer_baseline' else 'accept' end as decision from dc_evid e left join (select vector_id, max(n) / nullif(sum(n), 0) as sh from (select vector_id, year(trading_date) as y, count(*) filter (aff) as n from dc_day group by 1, 2) group by 1) s on e.vector_id = s.vector_id"),
    }
