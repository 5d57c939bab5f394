"""Queries over the chain with its blockers and over the whole grid of windows, thresholds and confirmation lengths, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators import grids as G
from panelwright.operators import layers as L
from panelwright.operators import scores as S
from panelwright.operators import states as ST
from panelwright.plans.metrics import DIMENSIONS, INDICATORS, dimension_rows, score_step, wide_metrics
from panelwright.plans.sql import STEPS, query, step
from panelwright.plans.states import DIMS, KS, QS, QVEC, dim_scores, streak_steps, text_dates
from panelwright.sources.scratch import written

WINDOWS = [60, 120, 250]
DAY = ["security_id", "trading_date"]
SERIES = ["security_id", "window", "q", "state_name"]


def _chain(spark, d: str, q) -> DataFrame:
    return L.chain_states(dim_scores(spark, d).withColumn("active", ST.weak_state(q)), DIMS, DAY)


def _vector(spark, d: str) -> DataFrame:
    """Each dimension by its own q: states with their status and reasons."""
    q = F.create_map(*[F.lit(x) for pair in QVEC.items() for x in pair])[F.col("dimension")]
    out = _chain(spark, d, q)
    for k in range(1, len(DIMS) + 1):
        out = out.withColumn(f"s{k}_reasons", F.array_join(f"s{k}_reasons", ","))
    return text_dates(out.drop("layer_reasons", "layer", "layer_status", "blocking"))


def _layers(spark, d: str) -> DataFrame:
    return text_dates(_chain(spark, d, F.lit(0.3)).select(*DAY, "blocking", "layer", "layer_status", F.array_join("layer_reasons", ",").alias("layer_reasons")))


def grid(spark, d: str) -> DataFrame:
    """Confirmed days of the 27 configurations and all states of the chain, a row for each: what the queries count where the days lie, told at length."""
    metrics = written(wide_metrics(spark, d, fields=("value", "validity_status", "reason_codes")), "grid-metrics")
    out = None
    for w in WINDOWS:
        one = dimension_rows(S.dimension_columns(S.past_scores(metrics, INDICATORS, w), DIMENSIONS)).withColumn("window", F.lit(w))
        out = one if out is None else out.unionByName(one)
    return L.grid_confirmed(L.grid_states(out, DIMS, QS, [*DAY, "window"]), KS, SERIES)


GRID = G.Grid(WINDOWS, QS, KS, DIMENSIONS)


def metrics(spark, d: str) -> DataFrame:
    """All metrics of a day side by side, with its place; the whole grid is made of them where they lie."""
    return wide_metrics(spark, d, more=("_place",))


def _days(spark, d: str) -> DataFrame:
    """The grid in numbers, with each configuration's hash and whether it is the baseline."""
    registry = ST.parameter_grid(spark, WINDOWS, QS, KS)
    baseline = (F.col("window") == 120) & (F.col("q") == 0.2) & (F.col("k") == 3)
    return G.grid_counts(metrics(spark, d), GRID).join(F.broadcast(registry.select("config_id", "config_hash", baseline.alias("is_baseline"))), "config_id")


def _intervals(spark, d: str) -> DataFrame:
    return text_dates(G.grid_runs(metrics(spark, d), GRID))


def queries() -> dict:
    return {"st04_layer_reasons": _layers, "st05_vector_reasons": _vector, "gr02_nested_grid_days": _days, "gr03_nested_grid_intervals": _intervals}


for _w in WINDOWS:
    if _w != 120:
        for _names in DIMENSIONS.values():
            for _name in _names:
                score_step(f"sc{_w}_{_name}", _name, _w)
        step(f"scores_long_{_w}", STEPS["scores_long"].replace("from sc_", f"from sc{_w}_"))
        step(f"dim_scores_{_w}", STEPS["dim_scores"].replace("from scores_long", f"from scores_long_{_w}"))


def _chain_steps(name: str, source: str, keys: str) -> None:
    """Step ``name``: states, statuses and reasons of the chain over ``source`` (keys, dimension, active, validity_status, reason_codes)."""
    cols = ", ".join(f"bool_or(dimension = '{c}') as h_{c}, bool_or(active) filter (dimension = '{c}') as a_{c}, max(validity_status) filter (dimension = '{c}') as v_{c}, max(reason_codes) filter (dimension = '{c}') as r_{c}" for c in DIMS)
    stop = "case " + " ".join(f"when not coalesce(a_{c}, false) then {k}" for k, c in enumerate(DIMS, 1)) + f" else {len(DIMS) + 1} end"
    pick = lambda expr: "case stop " + " ".join(f"when {k} then {expr.replace('?', c)}" for k, c in enumerate(DIMS, 1)) + " end"
    status, reasons = pick("(case when not coalesce(h_?, false) or v_? = 'valid' then 'unknown' else v_? end)"), pick("(case when not coalesce(h_?, false) then 'missing_dimension_state' else r_? end)")
    states = ", ".join(f"case when stop > {k} then true when not unknown then false end as s{k}, case when stop <= {k} and unknown then status else 'valid' end as s{k}_status, case when stop <= {k} and unknown then reasons else 'valid_no_blocker' end as s{k}_reasons" for k in range(1, len(DIMS) + 1))
    names = ["NONE", *["".join(DIMS[:k]) + "_ONLY" for k in range(1, len(DIMS))], "".join(DIMS)]
    step(
        name,
        f"""select {keys}, {states}, {pick("'?'")} as blocking, case when unknown then upper(status) else {names}[stop] end as layer, stop, unknown
from (select *, coalesce({pick('a_? is null')}, false) as unknown, {status} as status, {reasons} as reasons from (select *, {stop} as stop from (select {keys}, {cols} from {source} group by {keys})))""",
    )


_active = lambda q: f"case when validity_status = 'valid' then score_mean + 1e-12 >= 1 - {q} and score_min + 1e-12 >= 1 - {q} - 0.1 end as active"
_vec = "case dimension " + " ".join(f"when '{k}' then {v}::double" for k, v in QVEC.items()) + " end"
_chain_steps("ch_layer", f"(select *, {_active('0.3::double')} from dim_scores)", "security_id, trading_date")
_chain_steps("ch_vector", f"(select *, {_active(_vec)} from dim_scores)", "security_id, trading_date")
_every = " union all ".join(f"select *, {w} as w from dim_scores{'' if w == 120 else f'_{w}'}" for w in WINDOWS)
_chain_steps("ch_grid", f"(select *, {_active('q')} from ({_every}) cross join qs)", "security_id, trading_date, w, q")
_cfg = "'W' || w || '_q' || round(q * 10000)::int"
step("gn_state", " union all ".join(f"select {_cfg} || '|s{k}|' || security_id as security_id, trading_date, s{k} as raw_state, s{k}_status as validity_status from ch_grid" for k in range(1, len(DIMS) + 1)))
streak_steps("gn", "gn_state")


def oracle_sql() -> dict[str, str]:
    day = "security_id, cast(trading_date as varchar) as trading_date"
    config = "split_part(security_id, '|', 1) || '_K' || k as config_id, split_part(security_id, '|', 2) as state_name"
    hashes = " union all ".join(f"select 'W{w}_q{round(q * 10_000)}_K{k}' as config_id, sha256('{{\"K\": {k}, \"W\": {w}, \"q_bp\": {round(q * 10_000)}}}') as config_hash, {str((w, q, k) == (120, 0.2, 3)).lower()} as is_baseline" for w in WINDOWS for q in QS for k in KS)
    return {
        "st04_layer_reasons": query(f"select {day}, blocking, layer, s{len(DIMS)}_status as layer_status, s{len(DIMS)}_reasons as layer_reasons from ch_layer"),
        "st05_vector_reasons": query(f"select {day}, {', '.join(f's{k}, s{k}_status, s{k}_reasons' for k in range(1, len(DIMS) + 1))} from ch_vector"),
        "gr02_nested_grid_days": query(f"""select * from (select {config}, count(*) as n_days, count(*) filter (validity_status = 'valid') as n_valid, count(*) filter (raw_state) as n_true, count(*) filter (raw_state is null) as n_null,
  count(*) filter (confirmed) as n_confirmed, count(*) filter (streak = k) as n_intervals, count(distinct case when confirmed then security_id end) as n_entities from gn_conf group by 1, 2) join ({hashes}) using (config_id)"""),
        "gr03_nested_grid_intervals": query(f"select {config}, split_part(security_id, '|', 3)::bigint as security_id, interval_no, cast(raw_start_date as varchar) as raw_start_date, cast(confirmation_date as varchar) as confirmation_date, cast(interval_end_date as varchar) as interval_end_date, cast(last_observed_date as varchar) as last_observed_date, duration_raw_days, duration_confirmed_days, is_open, termination_reason from gn_int"),
    }
