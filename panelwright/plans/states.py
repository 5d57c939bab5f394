"""Queries over states, confirmation and intervals, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators import metrics as M
from panelwright.operators import scores as S
from panelwright.operators import states as ST
from panelwright.plans.metrics import DIMENSIONS, WINDOW, dimension_rows, prices, steady, wide_dims
from panelwright.plans.sql import query, step
from panelwright.sources.panels import scan, user_spine

QS, KS = [0.1, 0.2, 0.3], [2, 3, 5]
DIMS = list(DIMENSIONS)
QVEC = {"P": 0.3, "C": 0.3, "T": 0.2, "V": 0.1}


def spine(spark, d: str) -> DataFrame:
    return user_spine(scan(spark, f"{d}/events.parquet"))


def text_dates(df: DataFrame) -> DataFrame:
    """Dates as text and counts as long, as results are compared."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(name)
        cols.append((c.cast("string") if kind in ("date", "timestamp") else c.cast("long") if kind in ("int", "smallint") else F.round(c, 9) if kind == "double" else c).alias(name))
    return df.select(*cols)


def low_range(spark, d: str) -> DataFrame:
    return S.strict_past_percentile(steady(M.log_range(prices(spark, d))), WINDOW)


def dim_scores(spark, d: str) -> DataFrame:
    return dimension_rows(wide_dims(spark, d))


def nested(spark, d: str, qs: dict[str, float] = dict.fromkeys(DIMS, 0.2)) -> DataFrame:
    """The chain's states, each dimension by its q."""
    return nested_of(wide_dims(spark, d), qs)


def nested_of(wide: DataFrame, qs: dict[str, float] = dict.fromkeys(DIMS, 0.2)) -> DataFrame:
    weak = [ST.weak_state(F.lit(q), of=f"{x}.").alias(x) for x, q in qs.items()]
    return ST.nested_states(wide.select("security_id", "trading_date", *weak), DIMS)


def spine_confirmed(spark, d: str, ks: list[int] = KS) -> DataFrame:
    return ST.confirm(ST.streaks(spine(spark, d), ["security_id"]), ks, ["security_id"])


def range_intervals(spark, d: str) -> DataFrame:
    """Confirmed intervals of a low price range: range, percentile, threshold, confirmation, intervals."""
    states = ST.indicator_states(low_range(spark, d), [0.2]).withColumnRenamed("active", "raw_state")
    keys = ["security_id"]
    return text_dates(ST.intervals(ST.confirm(ST.streaks(states, keys), [3], keys), keys))


def vector_states(spark, d: str) -> DataFrame:
    return nested(spark, d, QVEC)


step("qs", "select unnest([0.1, 0.2, 0.3])::double as q")
step("ks", "select unnest([2, 3, 5]) as k")
step("st_ind", "select s.*, q, case when validity_status = 'valid' then score + 1e-12 >= 1 - q end as active from sc_log_range20 s cross join qs")
step("st_dim", "select s.*, q, case when validity_status = 'valid' then score_mean + 1e-12 >= 1 - q and score_min + 1e-12 >= 1 - q - 0.1 end as active from dim_scores s cross join qs")
_chain = """
select *, case when not s3 then false when s3 is null then null else V end as s4 from (
select *, case when not s2 then false when s2 is null then null else T end as s3 from (
select *, case when not s1 then false when s1 is null then null else C end as s2 from (
select *, P as s1 from ({}))))"""
_wide = "select security_id, trading_date, " + ", ".join(f"bool_or(active) filter (dimension = '{x}') as {x}" for x in DIMS) + " from {} group by 1, 2"
step("st_nested", _chain.format(_wide.format("(select * from st_dim where q = 0.2)")))
_vec = " ".join(f"when '{k}' then {v}::double" for k, v in QVEC.items())
step("st_vector", _chain.format(_wide.format(f"(select *, case when validity_status = 'valid' then score_mean + 1e-12 >= 1 - qq and score_min + 1e-12 >= 1 - qq - 0.1 end as active from (select *, case dimension {_vec} end as qq from dim_scores))")))


def streak_steps(name: str, source: str) -> None:
    """Steps <name>_run (streaks), <name>_conf (a row for each k) and <name>_int (intervals) over a state table."""
    step(
        f"{name}_run",
        f"""
select *, case when run is not null then row_number() over (partition by security_id, run order by trading_date) when raw_state is not null then 0 end as streak,
  case when run is not null then min(trading_date) over (partition by security_id, run) end as run_start
from (select *, case when o then sum(case when o and not coalesce(lo, false) then 1 else 0 end) over (partition by security_id order by trading_date) end as run
  from (select *, coalesce(raw_state, false) as o, lag(coalesce(raw_state, false)) over (partition by security_id order by trading_date) as lo from {source}))""",
    )
    step(
        f"{name}_conf",
        f"""select *, case when streak is not null then streak >= k end as confirmed,
  case when run is not null then max(case when streak = k then trading_date end) over (partition by security_id, k, run) end as confirmation_date from {name}_run cross join ks""",
    )
    step(
        f"{name}_int",
        f"""
select security_id, k, row_number() over (partition by security_id, k order by raw_start_date) as interval_no, raw_start_date, confirmation_date,
  case when nx is not null then last_date end as interval_end_date, coalesce(nx, last_date) as last_observed_date, duration_raw_days, duration_confirmed_days, nx is null as is_open,
  case when nx is null then 'end_of_input_open' when nst <> 'valid' then 'state_' || nst when not ns then 'state_false' else 'state_unknown' end as termination_reason
from (select security_id, k, run, min(trading_date) as raw_start_date, min(case when confirmed then trading_date end) as confirmation_date, max(trading_date) as last_date,
    arg_max(struct_pack(a := n1), trading_date).a as nx, arg_max(struct_pack(a := n2), trading_date).a as ns, arg_max(struct_pack(a := n3), trading_date).a as nst, count(*) as duration_raw_days, count(*) filter (confirmed) as duration_confirmed_days
  from (select *, lead(trading_date) over z as n1, lead(raw_state) over z as n2, lead(validity_status) over z as n3 from {name}_conf window z as (partition by security_id, k order by trading_date))
  where run is not null group by 1, 2, 3)
where confirmation_date is not null""",
    )


streak_steps("us", "uspine")
streak_steps("lr", "(select *, active as raw_state from st_ind where q = 0.2)")

_D = "cast(trading_date as varchar) as trading_date"
_INT = "security_id, interval_no, cast(raw_start_date as varchar) as raw_start_date, cast(confirmation_date as varchar) as confirmation_date, cast(interval_end_date as varchar) as interval_end_date, cast(last_observed_date as varchar) as last_observed_date, duration_raw_days, duration_confirmed_days, is_open, termination_reason"


def _grid_daily(spark, d: str) -> DataFrame:
    """Daily rows of every configuration of a grid over the users' spine, with a hash for each configuration."""
    grid = ST.parameter_grid(spark, [0], [0.2, 0.3], KS).select("config_id", "k", "q")
    days = ST.streaks(spine(spark, d), ["security_id"])
    out = days.crossJoin(F.broadcast(grid))
    out = out.withColumn("confirmed", F.when(F.col("streak").isNotNull(), F.col("streak") >= F.col("k")))
    return out.groupBy("config_id").agg(F.count("*").alias("n_rows"), F.count_if("confirmed").alias("n_confirmed"), F.count_if(F.col("confirmed").isNull()).alias("n_unknown"))


def _coverage(spark, d: str) -> DataFrame:
    """Users and k without any confirmed interval, against the grid of all users and k."""
    days = spine(spark, d)
    found = ST.intervals(spine_confirmed(spark, d), ["security_id", "k"]).select(F.concat_ws("|", "security_id", "k").alias("key"))
    grid = days.select("security_id").distinct().withColumn("k", F.explode(F.array(*map(F.lit, KS)))).select(F.concat_ws("|", "security_id", "k").alias("key"))
    return ST.grid_coverage(found, grid, "key")


def queries() -> dict:
    return {
        "confirmed_intervals": range_intervals,
        "st01_indicator_states": lambda s, d: text_dates(ST.indicator_states(low_range(s, d), QS).select("security_id", "trading_date", "q", "active")),
        "st02_dimension_states": lambda s, d: text_dates(ST.dimension_states(dim_scores(s, d), QS).select("security_id", "trading_date", "dimension", "q", "active")),
        "st03_nested_states": lambda s, d: text_dates(nested(s, d)),
        "st04_exclusive_layer": lambda s, d: ST.exclusive_layer(nested(s, d), DIMS).groupBy("security_id", "layer").agg(F.count("*").alias("n_days")),
        "st05_vector_states": lambda s, d: text_dates(vector_states(s, d)),
        "st06_nesting_check": lambda s, d: nested(s, d).withColumn("bad", ST.nesting_violations(4)).groupBy("bad").agg(F.count("*").alias("n_rows")),
        "cf01_streaks": lambda s, d: text_dates(ST.streaks(spine(s, d), ["security_id"]).select("security_id", "trading_date", "streak", "run_start")),
        "cf02_confirmation": lambda s, d: text_dates(spine_confirmed(s, d).select("security_id", "trading_date", "k", "confirmed", "confirmation_date")),
        "cf03_intervals": lambda s, d: text_dates(ST.intervals(spine_confirmed(s, d), ["security_id", "k"])),
        "cf04_termination": lambda s, d: ST.intervals(spine_confirmed(s, d), ["security_id", "k"]).groupBy("k", "termination_reason").agg(F.count("*").alias("n_intervals")).select(F.col("k").cast("long").alias("k"), "termination_reason", "n_intervals"),
        "cf06_long_states": lambda s, d: ST.long_states(nested(s, d), ["s1", "s2", "s3", "s4"], ["security_id", "trading_date"]).groupBy("state_name").agg(F.count_if("raw_state").alias("n_true"), F.count_if(~F.col("raw_state")).alias("n_false"), F.count_if(F.col("raw_state").isNull()).alias("n_null")),
        "gr02_grid_daily": _grid_daily,
        "gr04_grid_coverage": _coverage,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "confirmed_intervals": query(f"select {_INT} from lr_int where k = 3"),
        "st01_indicator_states": query(f"select security_id, {_D}, q, active from st_ind"),
        "st02_dimension_states": query(f"select security_id, {_D}, dimension, q, active from st_dim"),
        "st03_nested_states": query(f"select security_id, {_D}, P, C, T, V, s1, s2, s3, s4 from st_nested"),
        "st04_exclusive_layer": query("select security_id, case when s4 then 'PCTV' when s3 then 'PCT' when s2 then 'PC' when s1 then 'P_ONLY' when not s1 then 'NONE' else 'UNKNOWN' end as layer, count(*) as n_days from st_nested group by 1, 2"),
        "st05_vector_states": query(f"select security_id, {_D}, P, C, T, V, s1, s2, s3, s4 from st_vector"),
        "st06_nesting_check": query("select coalesce(s2 and not coalesce(s1, false), false) or coalesce(s3 and not coalesce(s2, false), false) or coalesce(s4 and not coalesce(s3, false), false) as bad, count(*) as n_rows from st_nested group by 1"),
        "cf01_streaks": query(f"select security_id, {_D}, streak, cast(run_start as varchar) as run_start from us_run"),
        "cf02_confirmation": query(f"select security_id, {_D}, k, confirmed, cast(confirmation_date as varchar) as confirmation_date from us_conf"),
        "cf03_intervals": query(f"select k, {_INT} from us_int"),
        "cf04_termination": query("select k, termination_reason, count(*) as n_intervals from us_int group by 1, 2"),
        "cf06_long_states": query("select state_name, count(*) filter (raw_state) as n_true, count(*) filter (not raw_state) as n_false, count(*) filter (raw_state is null) as n_null from (" + " union all ".join(f"select '{x}' as state_name, {x} as raw_state from st_nested" for x in ("s1", "s2", "s3", "s4")) + ") group by 1"),
        "gr02_grid_daily": query("select 'W0_q' || (q * 10000)::int || '_K' || k as config_id, count(*) as n_rows, count(*) filter (confirmed) as n_confirmed, count(*) filter (confirmed is null) as n_unknown from us_conf cross join (select unnest([0.2, 0.3]) as q) g group by 1"),
        "gr04_grid_coverage": query("select security_id || '|' || k as key, 'missing' as problem from (select distinct security_id, k from uspine cross join ks) a where not exists (select 1 from us_int b where a.security_id = b.security_id and a.k = b.k)"),
    }
