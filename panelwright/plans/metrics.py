"""Queries over raw metrics and scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators import metrics as M
from panelwright.operators import scores as S
from panelwright.plans.sql import query, step
from panelwright.sources.panels import daily_prices, scan

#: Added before rounding: exact halves of the last place round alike in both engines.
NUDGE = 1e-10
_W = "partition by security_id order by trading_date"
_AV = {n: f"ln(avg(adjusted_close) over (w rows between {n - 1} preceding and current row))" for n in M.MA_WINDOWS}


def prices(spark, d: str) -> DataFrame:
    return daily_prices(scan(spark, f"{d}/lineitem.parquet"))


def tidy(df: DataFrame) -> DataFrame:
    """Metric rows as they are compared: values to six places, dates and lists as text."""
    return df.select(
        "security_id", F.col("trading_date").cast("string").alias("trading_date"), F.round(F.col("value") + NUDGE, 6).alias("value"), "validity_status",
        F.array_join("reason_codes", ",").alias("reason_codes"), F.col("window_start").cast("string").alias("window_start"),
        F.col("required_count").cast("long").alias("required_count"), F.col("actual_count").cast("long").alias("actual_count"),
    )


def _guarded_sql(inner: str, value: str, n: int, frame: str | None = None, **more: str) -> str:
    """SQL of a metric: ``inner`` gives the rows, ``value`` is an expression over them and window ``w``."""
    frame = frame or f"rows between {n - 1} preceding and current row"
    flags = {"suspension_in_window": "suspension_flag"} | more
    cols = ", ".join(f"bool_or({c}) over (w {frame}) as f_{name}" for name, c in flags.items())
    listed = ", ".join([f"case when n_found < {n} then 'window_insufficient' end"] + [f"case when f_{name} then '{name}' end" for name in flags])
    return f"""
select security_id, trading_date,
  case when reasons = '' then v end as value,
  case when reasons = '' then 'valid' when reasons like '%daily_vwap_range_fail%' then 'blocked'
       when reasons like '%suspension_in_window%' or reasons like '%zero_volume%' or reasons like '%zero_amount%' then 'diagnostic_required' else 'unknown' end as validity_status,
  case when reasons = '' then 'valid_no_blocker' else reasons end as reason_codes, window_start, {n} as required_count, n_found as actual_count
from (select *, array_to_string(list_filter([{listed}], lambda x: x is not null), ',') as reasons
  from (select *, {value} as v, count(*) over (w {frame}) as n_found, min(trading_date) over (w {frame}) as window_start, {cols}
    from ({inner}) window w as ({_W})))"""


_SPREAD = "sqrt(list_var_pop([{}]))"
_TR = "greatest(adjusted_high - adjusted_low, abs(adjusted_high - before), abs(adjusted_low - before))"
_CLOUD = f"""
select *, (m5 + m10 + m20 + m30 + m60) / 5 as cloud, least(m5, m10, m20, m30, m60) as bottom, greatest(m5, m10, m20, m30, m60) as top
from (select *, {', '.join(f'{e} as m{n}' for n, e in _AV.items())},
    (ln(adjusted_open) + ln(adjusted_close)) / 2 as centre, least(ln(adjusted_open), ln(adjusted_close)) as low, greatest(ln(adjusted_open), ln(adjusted_close)) as high,
    row_number() over w >= 60 as whole from pday window w as ({_W}))"""
_SLACK = "8 * 2.220446049250313e-16"
_Q = {
    "natr14": _guarded_sql(
        f"""
select *, case when i >= 14 then pow(13/14.0, i - 14) * sum(case when i between 1 and 14 then tr end) over w2 / 14
    + coalesce(sum(case when i > 14 then tr / 14 * pow(14/13.0, i) end) over w2, 0) * pow(13/14.0, i) end as atr
from (select *, {_TR} as tr from (select *, lag(adjusted_close) over (w) as before, row_number() over (w) - 1 as i from pday window w as ({_W})))
window w2 as ({_W} rows between unbounded preceding and current row)""",
        "atr / adjusted_close", 15, "rows between unbounded preceding and current row",
    ),
    "log_range20": _guarded_sql("select * from pday", "ln(max(adjusted_high) over (w rows between 19 preceding and current row) / min(adjusted_low) over (w rows between 19 preceding and current row))", 20),
    "ma_spread": _guarded_sql("select * from pday", _SPREAD.format(", ".join(_AV.values())), 60),
    "vwap_spread": _guarded_sql(
        "select * from pday",
        _SPREAD.format(", ".join(f"ln(sum(daily_vwap * volume_shares) over (w rows between {n - 1} preceding and current row) / sum(volume_shares) over (w rows between {n - 1} preceding and current row))" for n in M.MA_WINDOWS)),
        60, daily_vwap_range_fail="not (daily_vwap >= adjusted_low - 0.005 and daily_vwap <= adjusted_high + 0.005)", zero_volume_in_window="volume_shares <= 0",
    ),
    "efficiency_ratio20": _guarded_sql(
        f"select *, abs(y - lag(y) over (w)) as stp, abs(y - lag(y, 20) over (w)) as move from (select *, ln(adjusted_close) as y from pday) window w as ({_W})",
        "case when sum(stp) over (w rows between 19 preceding and current row) = 0 then 0 else move / sum(stp) over (w rows between 19 preceding and current row) end", 21,
    ),
    "abs_trend_t20": _guarded_sql(
        f"""select *, case when syy = 0 then 0 when syy - sxy * sxy / sxx > 0 then abs(sxy / sxx) / sqrt((syy - sxy / sxx * sxy) / 18 / sxx) end as t from (
  select *, regr_sxx(y, x) over (w rows between 19 preceding and current row) as sxx, regr_sxy(y, x) over (w rows between 19 preceding and current row) as sxy,
    regr_syy(y, x) over (w rows between 19 preceding and current row) as syy
  from (select *, ln(adjusted_close) as y, cast(row_number() over ({_W}) as double) as x from pday) window w as ({_W}))""",
        "t", 20,
    ),
    "turnover_shrink": _guarded_sql("select * from pday", "avg(turnover_float) over (w rows between 19 preceding and current row) / nullif(avg(turnover_float) over (w rows between 79 preceding and 20 preceding), 0)", 80, zero_volume_in_window="volume_shares <= 0"),
    "log_amount20": _guarded_sql("select * from pday", "ln(avg(amount_yuan) over (w rows between 19 preceding and current row))", 20, zero_amount_in_window="amount_yuan <= 0"),
    "body_to_cloud": _guarded_sql(_CLOUD, "abs(centre - cloud)", 60),
    "outside_cloud_rate": _guarded_sql(f"select *, case when whole then (centre < bottom - {_SLACK} * abs(bottom) or centre > top + {_SLACK} * abs(top))::int::double end as o from ({_CLOUD})", "avg(o) over (w rows between 19 preceding and current row)", 79),
    "body_cloud_gap": _guarded_sql(f"select *, case when whole then greatest(low - top, bottom - high, 0) end as gap from ({_CLOUD})", "avg(gap) over (w rows between 19 preceding and current row)", 79),
}
for _name, _sql in _Q.items():
    step(f"rm_{_name}", _sql)

WINDOW = 120
#: Dimensions of the derived panel, each of two metrics, and the name of each score.
DIMENSIONS = {"P": ("natr14", "log_range20"), "C": ("ma_spread", "vwap_spread"), "T": ("efficiency_ratio20", "abs_trend_t20"), "V": ("turnover_shrink", "log_amount20")}


def score_step(name: str, metric: str, window: int) -> None:
    step(
        name,
        f"""
select security_id, trading_date, value, ok and n = {window} as eligible,
  case when ok and n = {window} then (len(list_filter(past, lambda x: x < value)) + 0.5 * len(list_filter(past, lambda x: x = value))) / {window} end as percentile,
  case when ok and n = {window} then 1 - (len(list_filter(past, lambda x: x < value)) + 0.5 * len(list_filter(past, lambda x: x = value))) / {window} end as score,
  case when ok and n = {window} then 'valid' when ok then 'unknown' when validity_status = 'valid' then 'unknown' else validity_status end as validity_status,
  case when ok and n = {window} then 'valid_no_blocker' when ok then 'insufficient_strict_past_history' else 'raw_metric_not_valid,' || reason_codes end as reason_codes,
  case when ok then n else 0 end as reference_count, case when ok then f end as reference_start, case when ok then t end as reference_end
from (select *, coalesce(list(value) over p, []) as past, count(*) over p as n, min(trading_date) over p as f, max(trading_date) over p as t
  from (select * replace (round(value + 1e-13, 10) as value), value is not null and validity_status = 'valid' as ok from rm_{metric})
  window p as (partition by security_id, ok order by trading_date rows between {window} preceding and 1 preceding))""",
    )


def steady(df: DataFrame) -> DataFrame:
    """Values to ten places, so that engines that add a window's rows in another order find the same ties."""
    return df.withColumn("value", F.round(F.col("value") + 1e-13, 10))


INDICATORS = [n for names in DIMENSIONS.values() for n in names]


def long_metrics(spark, d: str) -> DataFrame:
    """All eight metrics, a row for each day and indicator."""
    return steady(M.stacked(prices(spark, d), INDICATORS))


def wide_metrics(spark, d: str, indicators: list[str] = INDICATORS, fields: tuple[str, ...] = ("value", "validity_status"), more: tuple[str, ...] = ()) -> DataFrame:
    """``steady`` metrics (all eight) side by side, a row for each day."""
    rows = M.side_by_side(prices(spark, d), indicators, fields=fields, more=more)
    cells = [F.struct(*[(F.round(F.col(f"{n}.value") + 1e-13, 10) if x == "value" else F.col(f"{n}.{x}")).alias(x) for x in fields]).alias(n) for n in indicators]
    return rows.select("security_id", "trading_date", *more, *cells)


def wide_scores(spark, d: str, window: int = WINDOW, indicators: list[str] = INDICATORS, more: tuple[str, ...] = ()) -> DataFrame:
    """Scores of the metrics (all eight) side by side, a row for each day; columns ``more`` of the prices stay."""
    return S.past_scores(wide_metrics(spark, d, indicators, ("value", "validity_status", "reason_codes"), ("_place", *more)), indicators, window, more=more)


def long_scores(spark, d: str, window: int = WINDOW, indicators: list[str] = INDICATORS) -> DataFrame:
    """Scores of the metrics with their dimension, a row for each day and indicator."""
    each = [F.struct(F.lit(n).alias("indicator"), F.lit(dimension).alias("dimension"), F.col(n).alias("of")) for dimension, names in DIMENSIONS.items() for n in names if n in indicators]
    rows = wide_scores(spark, d, window, indicators).select("security_id", "trading_date", F.explode(F.array(*each)).alias("one"))
    return rows.select("security_id", "trading_date", "one.indicator", "one.of.*", "one.dimension")


def wide_dims(spark, d: str, dimensions: dict[str, tuple[str, ...]] = DIMENSIONS, more: tuple[str, ...] = ()) -> DataFrame:
    """Scores of the dimensions side by side, a row for each day; only their own metrics are computed, and columns ``more`` of the prices stay."""
    return S.dimension_columns(wide_scores(spark, d, indicators=[n for names in dimensions.values() for n in names], more=more), dimensions, more=more)


def dimension_rows(wide: DataFrame) -> DataFrame:
    """Scores of dimensions that stand side by side, a row for each day and dimension."""
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("dimension"), F.col(x).alias("of")) for x in DIMENSIONS if x in wide.columns])).alias("one")
    return wide.select("security_id", "trading_date", each).select("security_id", "trading_date", "one.dimension", "one.of.*")


for _dimension, _names in DIMENSIONS.items():
    for _name in _names:
        score_step(f"sc_{_name}", _name, WINDOW)
score_step("sc20_log_range20", "log_range20", 20)
step("scores_long", " union all ".join(f"select *, '{dim}' as dimension, '{n}' as indicator from sc_{n}" for dim, names in DIMENSIONS.items() for n in names))
step(
    "dim_scores",
    """
select security_id, trading_date, dimension, n = 2 as eligible, case when n = 2 then mean end as score_mean, case when n = 2 then least_score end as score_min,
  case when n = 2 then 'valid' else ['unknown', 'diagnostic_required', 'blocked'][greatest(rnk, 1)] end as validity_status,
  case when n = 2 then 'valid_no_blocker' else array_to_string(list_sort(list_distinct(flatten(lists))), ',') end as reason_codes
from (select security_id, trading_date, dimension, avg(score) as mean, min(score) as least_score, count(*) filter (validity_status = 'valid') as n,
    max(case validity_status when 'valid' then 0 when 'unknown' then 1 when 'diagnostic_required' then 2 else 3 end) as rnk,
    list(string_split(reason_codes, ',')) filter (validity_status <> 'valid') as lists
  from scores_long group by all)""",
)

_COLS = f"security_id, cast(trading_date as varchar) as trading_date, round(value + {NUDGE}, 6) as value, validity_status, reason_codes, cast(window_start as varchar) as window_start, required_count, actual_count"


def _score_out(df: DataFrame) -> DataFrame:
    text: Column = F.array_join("reason_codes", ",")
    return df.select(
        "security_id", F.col("trading_date").cast("string").alias("trading_date"), "eligible", F.round("percentile", 9).alias("percentile"), F.round("score", 9).alias("score"),
        "validity_status", text.alias("reason_codes"), F.col("reference_count").cast("long").alias("reference_count"),
        F.col("reference_start").cast("string").alias("reference_start"), F.col("reference_end").cast("string").alias("reference_end"),
    )


_SCORE_COLS = f"security_id, cast(trading_date as varchar) as trading_date, eligible, round(percentile, 9) as percentile, round(score, 9) as score, validity_status, reason_codes, reference_count, cast(reference_start as varchar) as reference_start, cast(reference_end as varchar) as reference_end"
_FEATURES = [f"ma{n}" for n in M.MA_WINDOWS] + [f"{c}_ma{n}" for c in ("volume", "amount", "turnover") for n in (20, 60)] + ["atr14", "range20", "previous_close"]
_RM_IDS = dict(zip(M.METRICS, ("rm01", "rm02", "rm03", "rm04", "rm05", "rm06", "rm07", "rm08", "rm09", "rm10", "rm11")))


def _features_sql() -> str:
    rows = lambda n: f"(w rows between {n - 1} preceding and current row)"
    cols = [f"avg(adjusted_close) over {rows(n)} as ma{n}" for n in M.MA_WINDOWS]
    cols += [f"avg({c}) over {rows(n)} as {name}_ma{n}" for c, name in (("volume_shares", "volume"), ("amount_yuan", "amount"), ("turnover_float", "turnover")) for n in (20, 60)]
    cols += [f"avg({_TR}) over {rows(14)} as atr14", f"max(adjusted_high) over {rows(20)} - min(adjusted_low) over {rows(20)} as range20", "before as previous_close"]
    inner = f"select security_id, trading_date, row_number() over w - 1 as sequence, {', '.join(cols)} from (select *, lag(adjusted_close) over ({_W}) as before from pday) window w as ({_W})"
    return f"select security_id, cast(trading_date as varchar) as trading_date, sequence, {', '.join(f'round({c} + {NUDGE}, 6) as {c}' for c in _FEATURES)} from ({inner})"


def _features(spark, d):
    out = M.market_features(prices(spark, d))
    return out.select("security_id", F.col("trading_date").cast("string").alias("trading_date"), F.col("sequence").cast("long").alias("sequence"), *[F.round(F.col(c) + NUDGE, 6).alias(c) for c in _FEATURES])


def _dims(spark, d):
    out = dimension_rows(wide_dims(spark, d))
    return out.select("security_id", F.col("trading_date").cast("string").alias("trading_date"), "dimension", "eligible", F.round("score_mean", 9).alias("score_mean"), F.round("score_min", 9).alias("score_min"), "validity_status", F.array_join("reason_codes", ",").alias("reason_codes"))


def _common(spark, d):
    out = S.common_sample(long_scores(spark, d).withColumn("window", F.lit(WINDOW)), 8, 1)
    return out.select("security_id", F.col("trading_date").cast("string").alias("trading_date"), F.col("n_eligible").cast("long").alias("n_eligible"), "common", F.array_join("windows", ",").alias("windows"))


def _release(spark, d):
    scores = dimension_rows(wide_dims(spark, d, {x: DIMENSIONS[x] for x in "PC"}))
    panel = prices(spark, d)
    first = panel.groupBy("security_id").agg(F.min("trading_date").alias("a"), F.max("trading_date").alias("b"))
    spine = first.select("security_id", F.explode(F.sequence("a", "b")).alias("trading_date"))
    out = S.score_release(spine, scores, ["P", "C"])
    return out.groupBy("security_id", "dimension", "release_status", "placeholder").agg(F.count("*").alias("n_days"), F.round(F.sum("score_mean"), 6).alias("sum_mean"))


def queries() -> dict:
    out = {f"{_RM_IDS[name]}_{name}": (lambda s, d, f=f: tidy(f(prices(s, d)))) for name, f in M.METRICS.items()}
    out |= {
        "rm15_market_features": _features,
        "sc01_strict_past_percentile": lambda s, d: _score_out(S.strict_past_percentile(steady(M.log_range(prices(s, d))), WINDOW)),
        "sc02_short_window": lambda s, d: _score_out(S.strict_past_percentile(steady(M.log_range(prices(s, d))), 20)),
        "sc03_indicator_map": lambda s, d: S.map_indicator(long_scores(s, d).withColumnRenamed("indicator", "indicator_id"), {"natr14": "P1", "log_range20": "P2", "ma_spread": "C1"}).groupBy("indicator_id").agg(F.count_if("eligible").alias("n_eligible")),
        "sc04_dimension_scores": _dims,
        "sc05_common_sample": _common,
        "sc06_score_release": _release,
        "sc08_score_profile": lambda s, d: S.score_profile(long_scores(s, d), "indicator"),
    }
    return out


def oracle_sql() -> dict[str, str]:
    out = {f"{_RM_IDS[name]}_{name}": query(f"select {_COLS} from rm_{name}") for name in M.METRICS}
    out |= {
        "rm15_market_features": query(_features_sql()),
        "sc01_strict_past_percentile": query(f"select {_SCORE_COLS} from sc_log_range20"),
        "sc02_short_window": query(f"select {_SCORE_COLS} from sc20_log_range20"),
        "sc03_indicator_map": query("select case indicator when 'natr14' then 'P1' when 'log_range20' then 'P2' when 'ma_spread' then 'C1' else indicator end as indicator_id, count(*) filter (eligible) as n_eligible from scores_long group by 1"),
        "sc04_dimension_scores": query("select security_id, cast(trading_date as varchar) as trading_date, dimension, eligible, round(score_mean, 9) as score_mean, round(score_min, 9) as score_min, validity_status, reason_codes from dim_scores"),
        "sc05_common_sample": query(f"select security_id, cast(trading_date as varchar) as trading_date, count(*) filter (eligible) as n_eligible, count(*) filter (eligible) = 8 as common, case when bool_or(eligible) then '{WINDOW}' else '' end as windows from scores_long group by 1, 2"),
        "sc06_score_release": query("""
select security_id, dimension, coalesce(validity_status, 'blocked') as release_status, validity_status is null as placeholder, count(*) as n_days, round(sum(score_mean), 6) as sum_mean
from (select security_id, unnest(generate_series(min(trading_date), max(trading_date), interval 1 day))::date as trading_date from pday group by 1) sp
cross join (select unnest(['P', 'C']) as dimension) dd left join dim_scores using (security_id, trading_date, dimension) group by 1, 2, 3, 4"""),
        "sc08_score_profile": query("""
select indicator, count(*) as n_rows, count(*) filter (validity_status = 'valid') as n_valid, round(avg(score), 6) as mean_score, round(quantile_cont(score, 0.25), 6) as q25,
  round(quantile_cont(score, 0.5), 6) as q50, round(quantile_cont(score, 0.75), 6) as q75, count(*) filter (score < 0 or score > 1) as n_out_of_bounds from scores_long group by 1"""),
    }
    return out
