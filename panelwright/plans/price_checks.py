"""Queries over full price checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators import price_checks as C
from panelwright.plans.metrics import prices
from panelwright.plans.quality import factors
from panelwright.plans.sql import query, step
from panelwright.plans.states import text_dates
from panelwright.sources.panels import scan

CONTRACT = C.Contract(("forward_adjusted", "identity_no_adjustment"), ("final",))
#: Derived columns of a candidate row, as expressions that both engines read: faults follow from keys and dates.
_COLUMNS = {
    "volume": "case when day(trading_date) = 13 and security_id % 4 = 1 then null else volume_shares end",
    "amount": "case when security_id % 19 = 3 then -amount_yuan else amount_yuan end",
    "revision": "case when day(trading_date) = 1 then null when security_id % 11 = 2 then 'unknown' when security_id % 11 = 5 then 'draft' else 'final' end",
    "method": "case when adj_factor is null then 'identity_no_adjustment' when security_id % 23 = 4 then 'unknown' when security_id % 23 = 9 then 'spliced' else 'forward_adjusted' end",
    "trading_status": "case when day(trading_date) = 28 then 'unknown' when day(trading_date) = 29 then null else 'trading' end",
    "limit_status": "case when month(trading_date) = 2 then 'unknown' else 'known' end", "suspension_status": "case when security_id % 31 = 8 then null else 'known' end",
    "special_status": "case when security_id % 37 = 1 then 'unknown' else 'known' end", "unit_status": "'known'", "direction_verified": "adj_factor is not null",
    "action_flag": "day(trading_date) = 5", "action_status": "case when security_id % 10 = 0 then 'unknown' else 'known' end", "source_id": "case when day(trading_date) = 30 then ' ' else 'derived' end",
}
_SHIFT = "case when security_id % 17 = 5 and month(trading_date) = 3 then 1.02d else 1.0d end"


def rows(spark, d: str) -> DataFrame:
    """Candidate rows of adjusted prices: the suppliers' panel with its factors, statuses and faults that keys and dates give."""
    out = prices(spark, d).join(factors(spark, d).select("security_id", "trading_date", F.col("adj_factor").cast("double").alias("adj_factor")), C.KEYS, "left")
    out = out.withColumns({n: F.expr(e) for n, e in _COLUMNS.items()})
    asof = F.when(F.col("adj_factor").isNull(), F.lit(None)).when(F.col("security_id") % 13 == 6, F.date_add("trading_date", 1)).otherwise(F.col("trading_date"))
    raw = {f"raw_{f}": F.when((F.col("security_id") % 41 == 3) & (F.dayofmonth("trading_date") == 2), F.lit(0.0)).otherwise(F.col(f"adjusted_{f}")) for f in C.FIELDS}
    out = out.withColumns({"adjustment_factor": F.when(F.col("adj_factor").isNull(), F.lit(None)).otherwise(F.col("adj_factor")), "factor_as_of": asof, **raw})
    out = out.withColumns({f"adj_{f}": F.col(f"raw_{f}") * F.coalesce("adj_factor", F.lit(1.0)) * F.expr(_SHIFT) for f in C.FIELDS})
    out = out.select(*C.KEYS, *_COLUMNS, "adjustment_factor", "factor_as_of", *[f"{s}_{f}" for s in ("raw", "adj") for f in C.FIELDS])
    return out.unionByName(out.where("(security_id * 31 + dayofyear(trading_date)) % 211 = 0"))


def _members(spark, d: str) -> DataFrame:
    return scan(spark, f"{d}/supplier.parquet").where("s_nationkey <> 7").select(F.col("s_suppkey").alias("security_id"))


def _violations(spark, d: str) -> DataFrame:
    found = C.violations(rows(spark, d), _members(spark, d), CONTRACT)
    return text_dates(found.withColumns({c: F.round(c, 6) for c in ("left_value", "right_value")}))


def _audit(spark, d: str) -> DataFrame:
    second = factors(spark, d).select(*C.KEYS, (F.col("adj_factor") + F.when(F.col("security_id") % 7 == 1, 1e-6).otherwise(1e-10)).alias("factor"))
    return C.audit(rows(spark, d), second)


def queries() -> dict:
    return {
        "dq21_row_reasons": lambda s, d: text_dates(C.row_reasons(rows(s, d)).select(*C.KEYS, F.array_join("reasons", ",").alias("reasons"), "blocked")),
        "dq21_reason_counts": lambda s, d: C.reason_counts(C.row_reasons(rows(s, d))), "dq37_contract_violations": _violations,
        "dq38_violation_counts": lambda s, d: C.violations(rows(s, d), _members(s, d), CONTRACT).groupBy("rule").agg(F.count("*").alias("n_rows"), F.count_distinct("security_id").alias("n_entities")),
        "dq31_full_audit": _audit,
    }


_raw = ", ".join(f"case when security_id % 41 = 3 and day(trading_date) = 2 then 0.0 else adjusted_{f} end as raw_{f}" for f in C.FIELDS)
_adj = ", ".join(f"raw_{f} * coalesce(adj_factor, 1.0) * shift as adj_{f}" for f in C.FIELDS)
step(
    "pc_one",
    f"""select *, {_adj} from (select p.* exclude (suspension_flag), {", ".join(f"{e} as {n}" for n, e in _COLUMNS.items())}, adj_factor::double as adjustment_factor, adj_factor::double as adj_factor,
  case when adj_factor is null then null when security_id % 13 = 6 then trading_date + 1 else trading_date end as factor_as_of, {_SHIFT.replace("d then", "").replace("1.02d", "1.02::double").replace("1.0d", "1.0::double")} as shift, {_raw}
  from pday p left join (select security_id, trading_date, adj_factor::double as adj_factor from fact) f using (security_id, trading_date))""",
)
step("pc_rows", "select * from pc_one union all select * from pc_one where (security_id * 31 + dayofyear(trading_date)) % 211 = 0")
_badp = lambda s: "(" + " or ".join(f"coalesce(not {s}_{f} > 0, true)" for f in C.FIELDS) + ")"
_bado = lambda s: f"(coalesce({s}_high < greatest({s}_open, {s}_close, {s}_low), false) or coalesce({s}_low > least({s}_open, {s}_close, {s}_high), false))"
_REASONS = {
    "factor_missing": "adjustment_factor is null", "factor_as_of_missing": "factor_as_of is null", "revision_missing": "revision is null or trim(revision) = ''", "factor_direction_unverified": "coalesce(not direction_verified, true)",
    "raw_price_missing_or_not_positive": _badp("raw"), "adjusted_price_missing_or_not_positive": _badp("adj"), "raw_order_violation": _bado("raw"), "adjusted_order_violation": _bado("adj"),
    "volume_missing": "volume is null", "amount_missing": "amount is null", "volume_negative": "volume < 0", "amount_negative": "amount < 0", "duplicate_key": "count(*) over (partition by security_id, trading_date) > 1",
    **{n: f"coalesce({c}, 'unknown') = 'unknown'" for n, c in {"trading_status_unknown": "trading_status", "price_limit_status_unknown": "limit_status", "suspension_status_unknown": "suspension_status", "special_status_unknown": "special_status", "unit_unknown": "unit_status"}.items()},
}
step("pc_reason", "select *, list_filter([" + ", ".join(f"case when {c} then '{n}' end" for n, c in _REASONS.items()) + "], lambda x: x is not null) as reasons from pc_rows")
_near = lambda a, b: f"abs({a} - {b}) <= greatest(1e-9, 1e-9 * greatest(abs({a}), abs({b})))"
_f, _id = "adjustment_factor", "method = 'identity_no_adjustment'"
_RULES = [
    ("key_repeated", "n > 1", "n::double", "1.0"), ("not_a_member", "not member", "null", "null"), ("order_violation", _bado("adj"), "adj_high", "adj_low"), ("factor_not_positive", f"{_f} <= 0", _f, "0.0"),
    ("factor_time_missing", "factor_as_of is null", "null", "null"), ("factor_time_in_future", "factor_as_of > trading_date", "datediff('day', trading_date, factor_as_of)::double", "0.0"),
    ("method_unknown", "coalesce(method, 'unknown') = 'unknown'", "null", "null"), ("method_not_allowed", "method not in ('forward_adjusted', 'identity_no_adjustment', 'unknown')", "null", "null"),
    ("revision_unknown", "coalesce(revision, 'unknown') = 'unknown'", "null", "null"), ("revision_not_allowed", "revision not in ('final', 'unknown')", "null", "null"),
    ("action_silently_false", "not action_flag and coalesce(action_status, 'unknown') = 'unknown'", "null", "null"), ("identity_factor", f"{_id} and not ({_near(_f, '1.0')})", _f, "1.0"),
    *[r for x in C.FIELDS for r in (
        (f"identity_{x}", f"{_id} and not ({_near(f'adj_{x}', f'raw_{x}')})", f"adj_{x}", f"raw_{x}"), (f"product_{x}", f"not ({_near(f'adj_{x}', f'(raw_{x} * {_f})')})", f"adj_{x}", f"raw_{x} * {_f}"),
        (f"recovered_{x}", f"not ({_near(f'(adj_{x} / nullif({_f}, 0))', f'raw_{x}')})", f"adj_{x} / nullif({_f}, 0)", f"raw_{x}"),
    )],
]
step("pc_joined", "select *, count(*) over (partition by security_id, trading_date) as n, security_id in (select s_suppkey from supplier where s_nationkey <> 7) as member from pc_rows")
step("pc_broken", " union all ".join(f"select '{n}' as rule, security_id, trading_date, {l}::double as left_value, {r}::double as right_value from pc_joined where {c}" for n, c, l, r in _RULES))


def oracle_sql() -> dict[str, str]:
    day = "security_id, cast(trading_date as varchar) as trading_date"
    other = "(select security_id, trading_date, adj_factor::double + case when security_id % 7 = 1 then 1e-6 else 1e-10 end as other, true as there from fact)"
    counts = {
        "n_rows": "count(*)", "n_keys": "count(distinct (security_id, trading_date))", "rows_of_repeated_keys": "count(*) filter (n > 1)", "null_keys": "count(*) filter (security_id is null or trading_date is null)",
        "raw_price_missing_or_not_positive": f"count(*) filter ({_badp('raw')})", "raw_order_violation": f"count(*) filter ({_bado('raw')})", "adjusted_order_violation": f"count(*) filter ({_bado('adj')})",
        "factor_mismatch": "count(*) filter (abs(adjustment_factor - other) > 1e-8)", "factor_without_second_source": "count(*) filter (there is null)", "without_provenance": "count(*) filter (source_id is null or trim(source_id) = '')",
    }
    return {
        "dq21_row_reasons": query(f"select {day}, array_to_string(reasons, ',') as reasons, len(reasons) > 0 as blocked from pc_reason"),
        "dq21_reason_counts": query("select reason, count(*) as n_rows, count(distinct security_id) as n_entities from (select security_id, unnest(case when len(reasons) > 0 then reasons else ['none'] end) as reason from pc_reason) group by 1"),
        "dq37_contract_violations": query(f"select rule, {day}, round(left_value, 6) as left_value, round(right_value, 6) as right_value from pc_broken"),
        "dq38_violation_counts": query("select rule, count(*) as n_rows, count(distinct security_id) as n_entities from pc_broken group by 1"),
        "dq31_full_audit": query("with_audit".replace("with_audit", "select metric, value from (unpivot (select " + ", ".join(f"{e} as {n}" for n, e in counts.items()) + f" from pc_joined left join {other} using (security_id, trading_date)) on {', '.join(counts)} into name metric value value)")),
    }
