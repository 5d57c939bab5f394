"""Queries over null models, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.conventions import ratio
from panelwright.operators import nulls as N
from panelwright.operators import states as ST
from panelwright.operators import statistics as A
from panelwright.plans.metrics import DIMENSIONS, wide_dims
from panelwright.plans.sql import query, step
from panelwright.plans.states import DIMS, dim_scores, text_dates
from panelwright.plans.statistics import rounded
from panelwright.sources.scratch import written

#: Weakest q of the layers, longest pause inside a block, confirmation, replicates, seed.
Q, GAP, K, B, SEED = 0.3, 31, 2, 2000, 20
#: Conditional tests: parent state and shifted child. Global tests: fixed layer and shifted layers.
NESTED = {"C_GIVEN_P": ("s1", "C"), "T_GIVEN_PC": ("s2", "T"), "V_GIVEN_PCT": ("s3", "V")}
GLOBAL = {"GLOBAL_PC": ("P", ["C"]), "GLOBAL_PCT": ("P", ["C", "T"])}
LOWER = ["fragment_rate"]
FAMILIES = dict.fromkeys(NESTED, "nested") | dict.fromkeys(GLOBAL, "global")
STATES = ["s1", "s2", "s3", "s4"]


def layers(spark, d: str) -> DataFrame:
    """Nested states of suppliers at q = 0.3."""
    weak = ST.dimension_states(dim_scores(spark, d), [Q])
    return ST.nested_states(ST.dimension_wide(weak, DIMS, ["security_id", "trading_date"]), DIMS)


def arrays(spark, d: str) -> DataFrame:
    """Blocks, written (a row for each entity and year or so) as every test reads them again."""
    return written(N.block_arrays(layers(spark, d), [*DIMS, *STATES[:3]], GAP), "blocks")


def nested_replicates(a: DataFrame) -> DataFrame:
    """Counts of every conditional test and replicate; replicate 0 is the observed one."""
    return reduce(DataFrame.unionByName, [N.nested_counts(a, t, p, c, B, SEED) for t, (p, c) in NESTED.items()])


def global_replicates(a: DataFrame) -> DataFrame:
    days = reduce(DataFrame.unionByName, [N.joint_days(a, t, p, c, B, SEED) for t, (p, c) in GLOBAL.items()])
    return N.confirmed_metrics(days, K, a.agg(F.sum("len").alias("n_eligible")), B, list(GLOBAL))


def long_replicates(spark, d: str) -> DataFrame:
    """(test, statistic, replicate, value) of all tests."""
    a = arrays(spark, d)
    inner = nested_replicates(a).select("test", "replicate", F.lit("nested_retention").alias("statistic"), ratio(F.col("child_true"), F.col("child_true") + F.col("child_false")).alias("value"))
    outer = global_replicates(a).unpivot(["test", "replicate"], ["confirmed_coverage", "duration_mean", "duration_median", "fragment_rate"], "statistic", "value")
    return inner.unionByName(outer)


def primary(spark, d: str) -> DataFrame:
    """The statistic that a family is judged by: retention, or coverage."""
    return long_replicates(spark, d).where("statistic in ('nested_retention', 'confirmed_coverage')")


def _offsets(spark, d: str) -> DataFrame:
    a = arrays(spark, d).select(*N.BLOCK, "len")
    parts = []
    for test, (_, shifted) in GLOBAL.items():
        rows = N.replicates(a, test, shifted, B, SEED)
        parts += [rows.select("test", F.lit(c).alias("layer"), "len", F.col(f"off_{c}").alias("offset")) for c in shifted]
    return reduce(DataFrame.unionByName, parts).groupBy("test", "layer").agg(
        F.count("*").alias("n"), F.sum("offset").alias("total"), F.count_if((F.col("len") > 1) & (F.col("offset") < 1)).alias("n_zero"), F.count_if((F.col("len") > 1) & (F.col("offset") >= F.col("len"))).alias("n_outside"), F.count_if(F.col("len") == 1).alias("n_unshiftable"),
    )


def _shifted(spark, d: str) -> DataFrame:
    """The second layer turned round; only its own metrics are computed."""
    own = wide_dims(spark, d, {"C": DIMENSIONS["C"]}).select("security_id", "trading_date", ST.weak_state(F.lit(Q), of="C.").alias("C"))
    out = N.turned_days(own, "C", GAP, 3, SEED)
    return text_dates(out.select("security_id", "trading_date", "block", "pos", F.col("replicate").cast("long").alias("replicate"), "shifted"))


def _ordered(spark, d: str) -> DataFrame:
    """Ordered AND of layers that are turned round each by its own offset: states of ten replicates."""
    rows = N.replicates(arrays(spark, d), "ordered", DIMS, 10, SEED)
    rows = rows.select("replicate", F.explode(F.arrays_zip(*[N.turned(F.col(c), F.col("len"), F.col(f"off_{c}")).alias(c) for c in DIMS])).alias("x")).select("replicate", "x.*")
    counts = [a for s in STATES for a in (F.count_if(s).alias(f"{s}_true"), F.count_if(~F.col(s)).alias(f"{s}_false"))]
    return rounded(ST.nested_states(rows, DIMS).groupBy("replicate").agg(F.count("*").alias("n"), *counts))


def _reconcile(spark, d: str) -> DataFrame:
    """Observed counts through blocks and replicate 0 against counts of the daily table."""
    own = layers(spark, d)
    a = arrays(spark, d)
    seen = reduce(DataFrame.unionByName, [N.nested_counts(a, t, p, c, 0, SEED) for t, (p, c) in NESTED.items()])
    direct = reduce(DataFrame.unionByName, [own.where(p).agg(F.lit(t).alias("test"), F.count("*").alias("d_parent"), F.count_if(c).alias("d_true"), F.count_if(~F.col(c)).alias("d_false")) for t, (p, c) in NESTED.items()])
    out = direct.join(seen, "test", "left").fillna(0)
    differ = sum((F.col(x) != F.col(y)).cast("long") for x, y in (("n_parent", "d_parent"), ("child_true", "d_true"), ("child_false", "d_false")))
    return out.select("test", "n_parent", "child_true", "child_false", differ.alias("n_differ"))


step("nm_wide", "select *, case when not s3 then false when s3 is null then null else V end as s4 from (select *, case when not s2 then false when s2 is null then null else T end as s3 from (select *, case when not P then false when P is null then null else C end as s2, P as s1 from (select security_id, trading_date, " + ", ".join(f"bool_or(active) filter (dimension = '{x}') as {x}" for x in DIMS) + " from st_dim where q = 0.3 group by 1, 2)))")
step(
    "nm_day",
    f"""
select *, row_number() over (partition by security_id, block order by trading_date) - 1 as pos, count(*) over (partition by security_id, block) as len
from (select *, sum(b) over (partition by security_id order by trading_date)::bigint as block, row_number() over (partition by security_id order by trading_date) as seq
  from (select *, case when lag(trading_date) over w is null or year(trading_date) <> year(lag(trading_date) over w) or datediff('day', lag(trading_date) over w, trading_date) > {GAP} then 1 else 0 end as b
    from nm_wide window w as (partition by security_id order by trading_date)))""",
)
step("nm_arr", "select security_id, block, count(*) as len, " + ", ".join(f"list({c} order by pos) as l{c}" for c in DIMS) + " from nm_day group by 1, 2")
step("nm_blk", "select distinct security_id, block, len from nm_day")


def _offset(test: str, layer: str, n: str = "replicate") -> str:
    key = "concat_ws('|', " + ", ".join(x for x in (f"'{SEED}'", f"'{test}'" if test else "", f"{n}::varchar", f"'{layer}'" if layer else "", "security_id::varchar", "block::varchar") if x) + ")"
    return f"case when {n} > 0 and len > 1 then 1 + ('0x' || substr(md5({key}), 1, 8))::bigint % (len - 1) else 0 end"


def _nested_sql() -> str:
    parts = []
    for t, (p, c) in NESTED.items():
        rows = f"select replicate, a.*, ((pos - ({_offset(t, c)})) % len + len) % len as src from (select security_id, block, pos, len from nm_day where {p}) a cross join (select unnest(range(0, {B + 1})) as replicate)"
        parts.append(f"select '{t}' as test, replicate, count(*) as n_parent, count(*) filter (c) as child_true, count(*) filter (not c) as child_false from ({rows}) r join (select security_id, block, pos as src, {c} as c from nm_day) s using (security_id, block, src) group by 2")
    return " union all ".join(parts)


def _global_sql() -> str:
    parts = []
    for t, (p, shifted) in GLOBAL.items():
        srcs = ", ".join(f"((pos - ({_offset(t, c)})) % len + len) % len as src_{c}" for c in shifted)
        joins = " ".join(f"join (select security_id, block, pos as src_{c}, {c} from nm_day where {c}) j{c} using (security_id, block, src_{c})" for c in shifted)
        parts.append(f"select '{t}' as test, replicate, security_id, seq from (select replicate, a.*, {srcs} from (select security_id, block, pos, len, seq from nm_day where {p}) a cross join (select unnest(range(0, {B + 1})) as replicate)) {joins}")
    return " union all ".join(parts)


step("nm_nested", _nested_sql())
step("nm_joint", _global_sql())
step("nm_runs", f"select test, replicate, count(*) as length, case when count(*) >= {K} then count(*) - {K} + 1 end as confirmed from (select *, seq - row_number() over (partition by test, replicate, security_id order by seq) as run from nm_joint) group by test, replicate, security_id, run")
step(
    "nm_global",
    f"""
select test, replicate, n_eligible, coalesce(n_true, 0)::bigint as n_true, coalesce(confirmed_days, 0)::bigint as confirmed_days, coalesce(n_intervals, 0) as n_intervals, duration_mean, duration_median, coalesce(n_fragments, 0) as n_fragments,
  coalesce(confirmed_days, 0) / n_eligible as confirmed_coverage, n_fragments / nullif(n_intervals, 0) as fragment_rate
from (select t as test, replicate from (select unnest({list(GLOBAL)}) as t) cross join (select unnest(range(0, {B + 1})) as replicate)) g cross join (select count(*) as n_eligible from nm_day)
left join (select test, replicate, sum(length) as n_true, sum(confirmed) as confirmed_days, count(confirmed) as n_intervals, avg(confirmed) as duration_mean, quantile_cont(confirmed, 0.5) as duration_median, count(*) filter (confirmed = 1) as n_fragments from nm_runs group by 1, 2) using (test, replicate)""",
)
step("nm_long", "select test, replicate, 'nested_retention' as statistic, (child_true / nullif(child_true + child_false, 0))::double as value from nm_nested union all " + " union all ".join(f"select test, replicate, '{c}', ({c})::double from nm_global" for c in ("confirmed_coverage", "duration_mean", "duration_median", "fragment_rate")))
step("nm_rep", "select l.*, observed from nm_long l join (select test, statistic, value as observed from nm_long where replicate = 0) using (test, statistic) where replicate > 0 and value is not null and observed is not null")
step("nm_mean", "select *, avg(value) over (partition by test, statistic) as m, stddev_samp(value) over (partition by test, statistic) as sd from nm_rep")


def queries() -> dict:
    return {
        "nm02_offsets": _offsets,
        "nm03_shifted_layer": _shifted,
        "nm04_ordered_and": _ordered,
        "nm05_confirmed_metrics": lambda s, d: rounded(global_replicates(arrays(s, d))),
        "nm07_permutation": lambda s, d: rounded(nested_replicates(arrays(s, d))),
        "nm08_null_summary": lambda s, d: rounded(N.null_summary(long_replicates(s, d), LOWER)),
        "nm09_family_adjusted": lambda s, d: rounded(N.family_adjust(primary(s, d), FAMILIES).drop("n")),
        "nm10_observed_reconciled": _reconcile,
    }


def oracle_sql() -> dict[str, str]:
    offs = " union all ".join(f"select '{t}' as test, '{c}' as layer, len, {_offset(t, c)} as off from nm_blk cross join (select unnest(range(1, {B + 1})) as replicate)" for t, (_, shifted) in GLOBAL.items() for c in shifted)
    low = f"statistic in ({', '.join(repr(x) for x in LOWER)})"
    turned = ", ".join(f"l{c}[((pos - ({_offset('ordered', c)})) % len + len) % len + 1] as {c}" for c in DIMS)
    chain = f"select replicate, P as s1, case when not P then false when P is null then null else C end as s2, T, V from (select replicate, {turned} from (select *, unnest(range(0, len)) as pos from nm_arr) cross join (select unnest(range(1, 11)) as replicate))"
    for a, b, c in (("s2", "s3", "T"), ("s3", "s4", "V")):
        chain = f"select *, case when not {a} then false when {a} is null then null else {c} end as {b} from ({chain})"
    family = "case when test in ('" + "', '".join(NESTED) + "') then 'nested' else 'global' end"
    own = f"select {family} as family, test, statistic, replicate, m, sd, observed, (value - m) / nullif(sd, 0) as z_rep, (observed - m) / nullif(sd, 0) as z from nm_mean where statistic in ('nested_retention', 'confirmed_coverage')"
    return {
        "nm02_offsets": query(f"select test, layer, count(*) as n, sum(off)::bigint as total, count(*) filter (len > 1 and off < 1) as n_zero, count(*) filter (len > 1 and off >= len) as n_outside, count(*) filter (len = 1) as n_unshiftable from ({offs}) group by 1, 2"),
        "nm03_shifted_layer": query(f"select a.security_id, cast(trading_date as varchar) as trading_date, a.block, a.pos, replicate, shifted from (select *, ((pos - ({_offset('', '', 'replicate').replace('replicate > 0 and ', '')})) % len + len) % len as src from nm_day cross join (select unnest([0, 1, 2])::bigint as replicate)) a join (select security_id, block, pos as src, C as shifted from nm_day) using (security_id, block, src)"),
        "nm04_ordered_and": query("select replicate, count(*) as n, " + ", ".join(f"count(*) filter ({s}) as {s}_true, count(*) filter (not {s}) as {s}_false" for s in STATES) + f" from ({chain}) group by 1"),
        "nm05_confirmed_metrics": query("select test, replicate, n_eligible, n_true, confirmed_days, n_intervals, round(duration_mean, 6) as duration_mean, round(duration_median, 6) as duration_median, n_fragments, round(confirmed_coverage, 6) as confirmed_coverage, round(fragment_rate, 6) as fragment_rate from nm_global"),
        "nm07_permutation": query("select * from nm_nested"),
        "nm08_null_summary": query(f"""
select test, statistic, n, round(observed, 6) as observed, round(null_mean, 6) as null_mean, round(null_sd, 6) as null_sd, round(null_median, 6) as null_median, round(null_low, 6) as null_low, round(null_high, 6) as null_high, n_extreme, n_two_sided,
  case when {low} then 'lower' else 'upper' end as tail, round(observed / nullif(null_mean, 0), 6) as ratio, round(observed - null_mean, 6) as difference, round((observed - null_mean) / nullif(null_sd, 0), 6) as z, round((n_extreme + 1) / (n + 1), 6) as empirical_p, round((n_two_sided + 1) / (n + 1), 6) as p_two_sided
from (select test, statistic, count(*) as n, max(observed) as observed, max(m) as null_mean, max(sd) as null_sd, quantile_cont(value, 0.5) as null_median, quantile_cont(value, 0.025) as null_low, quantile_cont(value, 0.975) as null_high,
    count(*) filter (case when {low} then value <= observed else value >= observed end) as n_extreme, count(*) filter (abs(value - m) + 1e-12 >= abs(observed - m)) as n_two_sided from nm_mean group by 1, 2)"""),
        "nm09_family_adjusted": query(f"select s.family, test, statistic, round(m, 6) as null_mean, round(sd, 6) as null_sd, round(observed, 6) as observed, round(z, 6) as z, count(*) filter (top + 1e-12 >= z) as n_family_extreme, round(case when z is not null then (count(*) filter (top + 1e-12 >= z) + 1) / (count(top) + 1) end, 6) as family_adjusted_p from (select distinct family, test, statistic, m, sd, observed, z from ({own})) s join (select family, replicate, max(z_rep) as top from ({own}) group by 1, 2) t on s.family = t.family group by s.family, test, statistic, m, sd, observed, z"),
        "nm10_observed_reconciled": query(" union all ".join(f"select '{t}' as test, count(*) as n_parent, count(*) filter ({c}) as child_true, count(*) filter (not {c}) as child_false, 0::bigint as n_differ from nm_day where {p}" for t, (p, c) in NESTED.items())),
    }
