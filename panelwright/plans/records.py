"""Queries over checks, records and geometry, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.conventions import asof, ratio
from panelwright.operators import metrics as M
from panelwright.operators import quality as Q
from panelwright.operators import records as R
from panelwright.operators import scores as S
from panelwright.operators import states as ST
from panelwright.operators import statistics as A
from panelwright.operators import zones as Z
from panelwright.operators.selection import quantiles
from panelwright.plans import quality as PQ
from panelwright.plans.metrics import DIMENSIONS, prices, score_step, steady, wide_dims, wide_metrics
from panelwright.plans.sql import query, step
from panelwright.plans.states import DIMS, dim_scores, low_range, spine, spine_confirmed, streak_steps, text_dates
from panelwright.plans.statistics import KS_LAG, rounded, two_states
from panelwright.plans.zones import KEYS as ZK
from panelwright.plans.zones import parts, zone_steps
from panelwright.sources.panels import scan, user_days

GRID = ([120, 250, 500], [0.1, 0.2, 0.3], [2, 3, 5])
_D = "cast(trading_date as varchar) as trading_date"
WORDS = {"end_of_input_open": "sample_end", "state_false": "natural", "state_unknown": "quality", "state_blocked": "quality"}


def long_counts(pairs: dict[str, str], source: str) -> str:
    return " union all ".join(f"select '{n}' as metric, (count(*) filter ({c}))::double as value from {source}" for n, c in pairs.items())


def user_intervals(spark, d: str) -> DataFrame:
    return ST.intervals(spine_confirmed(spark, d), ["security_id", "k"])


def grid_states(spark, d: str) -> DataFrame:
    """Low-range states of every window and q of the grid; a row for each day, window and q."""
    metric, out = steady(M.log_range(prices(spark, d))), None
    for w in GRID[0]:
        one = S.strict_past_percentile(metric, w).withColumn("window", F.lit(w))
        out = one if out is None else out.unionByName(one)
    return ST.indicator_states(out, GRID[1]).withColumnRenamed("active", "raw_state")


def grid_confirmed(spark, d: str) -> DataFrame:
    keys = ["security_id", "window", "q"]
    out = ST.confirm(ST.streaks(grid_states(spark, d), keys), GRID[2], keys)
    return out.withColumn("config_id", F.format_string("W%d_q%d_K%d", "window", F.round(F.col("q") * 10_000).cast("int"), "k"))


def grid_counts(spark, d: str) -> DataFrame:
    """Days of each configuration in numbers: scores of all windows and states of all q stand side by side, so no day is dealt by configuration."""
    names, (windows, qs, ks) = {w: f"w{w}" for w in GRID[0]}, GRID
    rows = wide_metrics(spark, d, ["log_range20"], ("value", "validity_status", "reason_codes"), ("_place",))
    rows = rows.select(*R.KEYS, "_place", *[F.col("log_range20").alias(n) for n in names.values()])
    rows = S.past_scores(rows, [*names.values()], {n: w for w, n in names.items()})
    states = {f"{n}_q{round(q * 10_000)}": ST.active_state(F.lit(q), of=f"{n}.") for n in names.values() for q in qs}
    days = ST.wide_streaks(rows.select(*R.KEYS, *[c.alias(x) for x, c in states.items()]), {x: x for x in states})
    sums = {f"{x}_{name}": F.count_if(c) for x in states for name, c in (("true", F.col(x)), ("null", F.col(x).isNull()), *[(f"K{k}", F.col(f"{x}_streak") >= k) for k in ks])}
    row = days.groupBy().agg(F.count("*").alias("n_rows"), *[c.alias(n) for n, c in sums.items()])
    cells = [
        F.struct(F.lit(f"W{w}_q{round(q * 10_000)}_K{k}").alias("config_id"), "n_rows", F.col(f"{x}_true").alias("n_true"), F.col(f"{x}_K{k}").alias("n_confirmed"), F.col(f"{x}_null").alias("n_unknown"))
        for w, n in names.items() for q in qs for x in [f"{n}_q{round(q * 10_000)}"] for k in ks
    ]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("n_rows > 0")


for _w in (250, 500):
    score_step(f"sc{_w}_log_range20", "log_range20", _w)
step("gr_scores", "select 120 as win, * from sc_log_range20 union all select 250, * from sc250_log_range20 union all select 500, * from sc500_log_range20")
step("gr_states", "select 'W' || win || '_q' || round(q * 10000)::int || '|' || security_id as security_id, trading_date, validity_status, case when validity_status = 'valid' then score + 1e-12 >= 1 - q end as raw_state from gr_scores cross join qs")
streak_steps("gr", "gr_states")
step("mem_keys", "select s_suppkey, s_nationkey, 'index' as index_id, 'static' as membership_type from supplier")
step("lr_year", "select year(trading_date) as period, count(*) filter (active) as n_true, count(active) as n_known, count(distinct case when active then security_id end) as n_entities from st_ind where q = 0.2 group by 1")
step("flags", "select security_id, trading_date, " + ", ".join(f"coalesce(bool_or(dimension = '{x}' and validity_status = 'valid'), false) as valid_{x}, coalesce(bool_or(active) filter (dimension = '{x}'), false) as active_{x}, bool_or(active) filter (dimension = '{x}') as raw_{x}" for x in DIMS) + " from st_dim where q = 0.2 group by 1, 2")


def low_states(spark, d: str) -> DataFrame:
    return ST.indicator_states(low_range(spark, d), [0.2])


def low_intervals(spark, d: str) -> DataFrame:
    keys = ["security_id"]
    return ST.intervals(ST.confirm(ST.streaks(low_states(spark, d).withColumnRenamed("active", "raw_state"), keys), [3], keys), keys)


def flags(spark, d: str) -> DataFrame:
    return R.dimension_flags(wide_dims(spark, d), DIMS, 0.2)


def _members(spark, d: str) -> DataFrame:
    s = scan(spark, f"{d}/supplier.parquet").select("s_suppkey", "s_nationkey")
    return R.align_members(s, {"index_id": "index", "membership_type": "static"}, ["s_suppkey", "s_nationkey", "index_id", "membership_type"])


def _turnover(spark, d: str) -> DataFrame:
    p = prices(spark, d)
    return p.withColumns({"float_shares": 1000.0 + F.col("security_id"), "free_shares": F.when(F.col("security_id") % 6 != 0, 800.0 + F.col("security_id")).otherwise(0.0)})


def _candidate(spark, d: str) -> DataFrame:
    """Observations with the basics of their key and the policy; the report is by supplier."""
    basic = prices(spark, d).where("security_id % 8 <> 3").select(*R.KEYS, F.col("turnover_float").alias("basic"))
    out = prices(spark, d).join(basic, R.KEYS, "left").withColumn("policy", F.when(F.col("basic").isNull(), "unavailable").otherwise("as_published"))
    return rounded(out.groupBy("security_id", "policy").agg(F.count("*").alias("n_rows"), F.avg(F.col("basic").isNotNull().cast("double")).alias("coverage"), F.sum("basic").alias("total")))


NEEDS = {"range": ["adjusted_high", "adjusted_low"], "turnover": ["turnover_float", "suspension_flag"], "flow": ["net_inflow", "adjusted_close"]}
ROLES = {"security_id": "key", "trading_date": "time", "suspension_flag": "status"}


def _price_rows(spark, d: str) -> DataFrame:
    out = PQ.status(spark, d).join(PQ.evidence(spark, d).select(*R.KEYS, "factor_status"), R.KEYS)
    return out.join(prices(spark, d), R.KEYS, "left")


_KINDS = {"price": (20, "adjusted_low > 0"), "volume": (60, "volume_shares >= 2"), "turnover": (80, "turnover_float <= 0.15"), "amount": (20, "amount_yuan > 2000")}


def _readiness(spark, d: str) -> DataFrame:
    return text_dates(R.readiness(prices(spark, d), {n: (k, F.expr(c)) for n, (k, c) in _KINDS.items()}))


def _readiness_sql() -> str:
    def one(name: str, n: int, c: str) -> str:
        w = f"(partition by security_id order by trading_date rows between {n - 1} preceding and current row)"
        return f"case when count(*) over {w} < {n} then 'unknown' when bool_or(coalesce(not ({c}), false)) over {w} then 'blocked' when bool_or(suspension_flag) over {w} then 'diagnostic_required' when bool_or(({c}) is null) over {w} then 'unknown' else 'valid' end as {name}"

    return f"select security_id, {_D}, {', '.join(one(n, k, c) for n, (k, c) in _KINDS.items())} from pday"


_OBS = {
    "null_ohlc": "adjusted_open is null or adjusted_high is null or adjusted_low is null or adjusted_close is null", "non_positive": "adjusted_low <= 0", "high_below_low": "adjusted_high < adjusted_low",
    "missing_factor": "adj_factor is null", "suspended_with_volume": "suspension_flag and volume_shares > 0",
}
_AUDIT = {"close_outside_range": "adjusted_close not between adjusted_low and adjusted_high", "vwap_outside_range": "daily_vwap not between adjusted_low - 0.005 and adjusted_high + 0.005", "factor_mismatch": "abs(adjusted_close * coalesce(adj_factor, 1.0) - adjusted_close) > 1e-8"}
_ASOF = {"factor_not_positive": "adj_factor <= 0", "factor_after_day": "factor_date > trading_date", "factor_older_than_30_days": "datediff({0}, trading_date, factor_date) > 30", "no_factor_before": "factor_date is null"}
_CONT = {"identity": "abs(adjusted_close - close / coalesce(adj_factor, 1.0)) > greatest(1e-9, 1e-9 * abs(adjusted_close))", "order_kept": "(adjusted_high >= adjusted_low) <> (high >= low)"}


def _with_factor(spark, d: str) -> DataFrame:
    return prices(spark, d).join(PQ.factors(spark, d).select(*R.KEYS, "adj_factor"), R.KEYS, "left")


def _exprs(rules: dict[str, str]) -> dict:
    return {n: F.expr(c) for n, c in rules.items()}


def _observations(spark, d: str) -> DataFrame:
    repeated = prices(spark, d).groupBy(*R.KEYS).count().where("count > 1").agg(F.count("*").cast("double").alias("value")).select(F.lit("duplicates").alias("metric"), "value")
    return R.counted(_with_factor(spark, d), _exprs(_OBS)).unionByName(repeated)


def _asof(spark, d: str) -> DataFrame:
    f = PQ.factors(spark, d).select("security_id", F.col("trading_date").alias("factor_day"), "adj_factor")
    out = asof(prices(spark, d).select(*R.KEYS), f, ["security_id"], "trading_date", "factor_day", ["adj_factor"]).withColumn("factor_date", F.col("matched_factor_day"))
    return R.counted(out, _exprs({n: c.replace("datediff({0}, trading_date, factor_date)", "datediff(trading_date, factor_date)") for n, c in _ASOF.items()}))


def _continuous(spark, d: str) -> DataFrame:
    adj = Q.adjusted(prices(spark, d), PQ.factors(spark, d))
    return R.counted(adj.join(_with_factor(spark, d), R.KEYS), _exprs(_CONT))


def _market(spark, d: str) -> DataFrame:
    """Each price row's class of constraint, whether its gap has a cause, and its readiness, counted."""
    rows = _price_rows(spark, d)
    kind = F.when(F.col("trading_status") == "suspended", "suspended").when(F.col("limit_status") == "missing", "unconstrained").otherwise("limited")
    gap = F.when(F.col("daily_status") == "present", "none").when(F.col("trading_status") == "suspended", "attributed").otherwise("unattributed")
    vwap = F.when(F.col("daily_vwap").isNull(), "unknown").when(F.expr("daily_vwap between adjusted_low - 0.005 and adjusted_high + 0.005"), "pass").otherwise("fail")
    return rows.groupBy(kind.alias("constraint_class"), gap.alias("gap_class"), vwap.alias("vwap_status")).agg(F.count("*").alias("n_rows"))


def _composed(spark, d: str) -> DataFrame:
    """Observations put together again from four groups of fields, with the groups that they came from."""
    p = prices(spark, d)
    groups = {"price": ["adjusted_open", "adjusted_close"], "range": ["adjusted_high", "adjusted_low"], "flow": ["volume_shares", "amount_yuan"], "status": ["suspension_flag"]}
    out = p.select(*R.KEYS)
    for i, (name, fields) in enumerate(groups.items()):
        part = p.where(f"(security_id + {i}) % 7 <> 0").select(*R.KEYS, *fields, F.lit(name).alias(f"_{name}"))
        out = out.join(part, R.KEYS, "left")
    return text_dates(out.withColumn("lineage", F.concat_ws("+", *[f"_{n}" for n in groups])).select(*R.KEYS, "adjusted_close", "adjusted_high", "volume_shares", "suspension_flag", "lineage"))


def _normal_members(spark, d: str) -> DataFrame:
    """Tickers of the nations' suppliers, their exchange by alias or suffix, counted."""
    rows = PQ._codes(spark, d).withColumn("ticker", F.coalesce("symbol", F.lpad(F.col("s_suppkey").cast("string"), 6, "0")))
    rows = rows.withColumn("market", F.when(F.col("exchange") == "SH", "Shanghai").when(F.col("exchange") == "SZ", "Shenzhen").otherwise("unknown"))
    return rows.groupBy("market", "status").agg(F.count("*").alias("n_members"), F.countDistinct("ticker").alias("n_tickers"), F.min("ticker").alias("first_ticker"))


def _index_battery(spark, d: str) -> DataFrame:
    """Violations between the users' spine (the index) and their days (the main table)."""
    index = spine(spark, d).select(*R.KEYS, "observation_sequence", F.col("total").isNotNull().alias("present"))
    main = user_days(scan(spark, f"{d}/events.parquet")).where("security_id % 11 <> 7").select(*R.KEYS, F.lit(True).alias("there"))
    w = Window.partitionBy("security_id").orderBy("trading_date")
    both = index.withColumns({"step": F.col("observation_sequence") - F.lag("observation_sequence").over(w), "known": F.lit(True)}).join(main, R.KEYS, "full")
    return R.counted(both, {"sequence_broken": F.col("step") != 1, "present_without_row": F.col("present") & F.col("there").isNull(), "row_without_presence": ~F.col("present") & F.col("there"), "row_outside_index": F.col("known").isNull()})


def _status_coverage(spark, d: str) -> DataFrame:
    s = PQ.status(spark, d)
    out = None
    for c, unknown in (("trading_status", "unknown"), ("daily_status", "missing"), ("limit_status", "missing")):
        one = s.agg(F.lit(c).alias("field"), F.count("*").alias("n_rows"), F.count_if(F.col(c) != unknown).alias("n_known"))
        out = one if out is None else out.unionByName(one)
    share = ratio(F.col("n_known"), F.col("n_rows"))
    return rounded(out.withColumns({"known_share": share, "acceptance": F.when(share >= 0.95, "accepted").when(share >= 0.5, "review").otherwise("rejected")}))


def _raw_candidate(spark, d: str) -> DataFrame:
    """Order lines as raw prices: fields by map, supplier by a mapping table, the date parsed, constants added."""
    raw = scan(spark, f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("code"), F.date_format("l_shipdate", "yyyyMMdd").alias("day"), F.col("l_extendedprice").alias("amt"))
    mapping = scan(spark, f"{d}/supplier.parquet").where("s_suppkey % 10 <> 9").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"))
    out = raw.join(mapping, "code", "left").select(F.coalesce("name", F.lit("unmapped")).alias("security_id"), F.to_date("day", "yyyyMMdd").alias("trading_date"), "amt", F.lit("raw").alias("price_basis"))
    return rounded(out.groupBy("security_id", "price_basis").agg(F.min("trading_date").alias("first_day"), F.count("*").alias("n_rows"), F.sum("amt").alias("amount")))


def _years(spark, d: str) -> DataFrame:
    return rounded(R.calendar_rows(low_states(spark, d), "active", F.year("trading_date").cast("long")))


def _interval_years(spark, d: str) -> DataFrame:
    grid = prices(spark, d).select(F.year("trading_date").cast("long").alias("period")).distinct()
    return rounded(R.interval_periods(low_intervals(spark, d), grid, F.year("confirmation_date").cast("long")))


def _challenger(spark, d: str) -> DataFrame:
    states = ST.indicator_states(low_range(spark, d), [0.1, 0.2]).groupBy(*R.KEYS).agg(*[F.bool_or(F.when(F.col("q") == q, F.col("active"))).alias(n) for q, n in ((0.1, "a"), (0.2, "b"))])
    return rounded(A.overlap(states.withColumn("period", F.year("trading_date").cast("long")), "a", "b", ["period"]))


def _hits(spark, d: str) -> DataFrame:
    states = ST.indicator_states(low_range(spark, d), [0.1, 0.2, 0.3]).withColumnRenamed("active", "raw_state")
    w = Window.partitionBy("security_id", "q").orderBy("trading_date")
    before = F.lag("raw_state").over(w)
    rows = states.withColumns({"onset": F.col("raw_state") & ~F.coalesce(before, F.lit(False)), "strict": F.col("raw_state") & (before == F.lit(False)), "censored": F.col("raw_state") & before.isNull()})
    out = rows.groupBy("q").agg(F.count("raw_state").alias("n_known"), F.count_if("raw_state").alias("n_true"), F.count_if("onset").alias("n_segments"), F.count_if("strict").alias("n_strict"), F.count_if("censored").alias("n_censored"))
    return rounded(out.withColumns({"hit_rate": ratio(F.col("n_true"), F.col("n_known")), "mean_days": ratio(F.col("n_true"), F.col("n_segments"))}))


def _two_ways(spark, d: str) -> DataFrame:
    """Confirmation over streaks against the zones' replay, by entity: days that differ."""
    a = ST.confirm(ST.streaks(spine(spark, d), ["security_id"]), [2], ["security_id"]).select(*R.KEYS, F.coalesce("confirmed", F.lit(False)).alias("a"))
    b = Z.replay(spine(spark, d), 2, ["security_id"]).select(*R.KEYS, F.col("confirmed").alias("b"))
    return a.join(b, R.KEYS, "full").groupBy("security_id").agg(F.count_if("a").alias("n_a"), F.count_if("b").alias("n_b"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_differ"))


def _sensitivity(spark, d: str) -> DataFrame:
    t = A.lag_targets(spine(spark, d), "raw_state", KS_LAG)
    rates = spine(spark, d).groupBy("security_id").agg(F.count_if("raw_state").alias("n_true"), F.count("raw_state").alias("n_known")).withColumn("rate", ratio(F.col("n_true"), F.col("n_known")))
    return rounded(R.baseline_sensitivity(t, rates, "security_id"))


def _zone_metrics(spark, d: str) -> DataFrame:
    """Zones by status: number, mean length, nearest-order 95th percentile of confirmed days, greatest share of an entity."""
    z = parts(spark, d)[2]
    q95 = quantiles(z, ["status"], "n_confirmed", {"q95_confirmed": 0.95}, "nearest").select("status", F.col("q95_confirmed").cast("long").alias("q95_confirmed"))
    per = z.groupBy("status", "security_id").agg(F.count("*").alias("own")).groupBy("status").agg(F.max("own").alias("top"), F.count("*").alias("n_entities"))
    out = z.groupBy("status").agg(F.count("*").alias("n_zones"), F.avg(F.datediff("end_date", "start_date").cast("double")).alias("mean_span")).join(q95, "status")
    return rounded(out.join(per, "status").withColumn("top_share", ratio(F.col("top"), F.col("n_zones"))))


def _component_profile(spark, d: str) -> DataFrame:
    comps = parts(spark, d)[1]
    return rounded(comps.groupBy("qualified", "end_reason").agg(F.count("*").alias("n_components"), F.avg(F.col("n_confirmed").cast("double")).alias("mean_confirmed"), F.percentile("n_confirmed", 0.5).alias("median_confirmed"), F.max("n_confirmed").alias("most_confirmed"), F.avg(F.datediff("qualification_date", "start_date").cast("double")).alias("mean_delay"), F.count_if("bridged").alias("n_bridged")))


def _response(spark, d: str) -> DataFrame:
    """Zones and components as the gap bound grows; the number of zones may only fall."""
    out = None
    for g in (0, 1, 2):
        one = parts(spark, d, g=g)[2].agg(F.lit(g).cast("long").alias("g"), F.count("*").alias("n_zones"), F.sum("n_components").alias("n_components"), F.sum("n_bridges").alias("n_bridges"))
        out = one if out is None else out.unionByName(one)
    w = Window.orderBy("g")  # three rows
    return out.withColumn("monotone", F.coalesce(F.col("n_zones") <= F.lag("n_zones").over(w), F.lit(True)))


def _canonical(spark, d: str) -> DataFrame:
    """Events under their own id with the map of their components and their days."""
    daily, assigned, zones = parts(spark, d)
    ids = Z.event_ids(zones, ZK)
    days = Z.membership(zones, daily, ZK).groupBy("security_id", "zone").agg(F.count("*").alias("n_days"), F.count_if(F.col("role") == "core").alias("n_core"))
    comps = assigned.where("qualified").groupBy("security_id", "zone").agg(F.array_join(F.transform(F.array_sort(F.collect_list("run")), lambda r: r.cast("string")), ",").alias("components"))
    return ids.join(days, ["security_id", "zone"]).join(comps, ["security_id", "zone"]).select("event_id", "security_id", "zone", "n_days", "n_core", "components")


def _risk(spark, d: str) -> DataFrame:
    daily, _, zones = parts(spark, d)
    return text_dates(R.risk_flags(daily, Z.membership(zones, daily, ZK), ZK))


def _audit_daily(spark, d: str) -> DataFrame:
    """Rules of the daily table: members belong to zones, core days are confirmed or bridges, none lies outside its zone."""
    daily, _, zones = parts(spark, d)
    m = Z.membership(zones, daily, ZK).join(zones.select("security_id", "zone", "start_date", "end_date"), ["security_id", "zone"], "left").join(daily.select(*R.KEYS, "confirmed", "hard_break"), R.KEYS, "left")
    rules = {"unknown_zone": "start_date is null", "outside_zone": "trading_date not between start_date and end_date", "core_not_confirmed": "role = 'core' and not confirmed", "break_inside": "hard_break", "bridge_confirmed": "role = 'bridge' and confirmed"}
    return R.counted(m, _exprs(rules))


def _full_record(spark, d: str) -> DataFrame:
    """Every ended interval with its last day, the day after, why, and how long it had been confirmed."""
    i = user_intervals(spark, d).where("not is_open")
    after = spine(spark, d).select("security_id", F.col("trading_date").alias("last_observed_date"), F.col("validity_status").alias("status_after"), F.col("raw_state").alias("state_after"), F.col("total").alias("total_after"))
    return text_dates(i.join(after, ["security_id", "last_observed_date"]).select("security_id", "k", "interval_no", "interval_end_date", "last_observed_date", "termination_reason", "status_after", "state_after", "total_after", "duration_confirmed_days"))


def _child_map(spark, d: str) -> DataFrame:
    i = user_intervals(spark, d)
    return rounded(R.parent_of(i.where("k = 3").drop("k"), i.where("k = 2").drop("k")))


def _exit_profile(spark, d: str) -> DataFrame:
    i = user_intervals(spark, d)
    per = i.groupBy("k", "security_id").agg(F.count("*").alias("own")).groupBy("k").agg(F.max("own").alias("top"))
    out = i.groupBy("k").agg(F.count("*").alias("n_intervals"), F.count_if("is_open").alias("n_open"), F.count_if(F.col("termination_reason") == "state_false").alias("n_natural"), F.avg(F.col("duration_confirmed_days").cast("double")).alias("mean_days"), F.percentile("duration_confirmed_days", 0.5).alias("median_days"))
    return rounded(out.join(per, "k").withColumn("top_share", ratio(F.col("top"), F.col("n_intervals"))).withColumn("k", F.col("k").cast("long")))


def _cross_q(spark, d: str) -> DataFrame:
    """Days of a loose state by what the strict one is there, and whether they lie beside a strict day."""
    s = ST.indicator_states(low_range(spark, d), [0.1, 0.3]).groupBy(*R.KEYS).agg(*[F.coalesce(F.bool_or(F.when(F.col("q") == q, F.col("active"))), F.lit(False)).alias(n) for q, n in ((0.1, "strict"), (0.3, "loose"))])
    w = Window.partitionBy("security_id").orderBy("trading_date")
    lead, lag = F.coalesce(F.lead("strict").over(w), F.lit(False)), F.coalesce(F.lag("strict").over(w), F.lit(False))
    kind = F.when(F.col("strict"), "core").when(lead & lag, "between").when(lead, "leading").when(lag, "trailing").otherwise("shell")
    return s.withColumn("day_class", kind).where("loose or strict").groupBy("day_class").agg(F.count("*").alias("n_days"), F.countDistinct("security_id").alias("n_entities"), F.count_if(F.col("strict") & ~F.col("loose")).alias("n_violations"))


def _digest(spark, d: str) -> DataFrame:
    o = scan(spark, f"{d}/customer.parquet").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return R.ordered_digest(o.withColumn("part", F.floor(F.col("c_custkey") / 500)), "part", ["c_custkey"])


def _contract(spark, d: str) -> DataFrame:
    """Structural rules over the given tables with their expected value."""
    l, o, c = (scan(spark, f"{d}/{t}.parquet") for t in ("lineitem", "orders", "customer"))
    one = lambda df, name: df.select(F.lit(name).alias("rule"), F.col("n").cast("long").alias("observed"))
    rows = one(l.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("n")), "lines_without_order")
    rows = rows.unionByName(one(o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.count("*").alias("n")), "orders_without_customer"))
    rows = rows.unionByName(one(o.groupBy("o_orderkey").count().where("count > 1").agg(F.count("*").alias("n")), "repeated_orders"))
    return rows.unionByName(one(l.where("l_quantity <= 0").agg(F.count("*").alias("n")), "non_positive_quantity")).withColumns({"expected": F.lit(0).cast("long"), "passed": F.col("observed") == 0})


def _recompute(spark, d: str) -> DataFrame:
    """Percentiles of all rows computed a second time, by a window of the 120 values before a row, against the released ones."""
    a = low_range(spark, d)
    past = F.collect_list("value").over(Window.partitionBy("security_id").orderBy("trading_date").rowsBetween(-120, -1))
    twice = F.aggregate("past", F.lit(0), lambda acc, x: acc + F.when(x < F.col("value"), 2).when(x == F.col("value"), 1).otherwise(0))
    again = steady(M.log_range(prices(spark, d))).where("value is not null").withColumn("past", past).where("size(past) = 120").select(*R.KEYS, (twice / 240).alias("again"))
    both = a.select(*R.KEYS, "percentile").join(again, R.KEYS, "left")
    return both.groupBy("security_id").agg(F.count("*").alias("n_rows"), F.count("percentile").alias("n_released"), F.count_if(~F.round("percentile", 9).eqNullSafe(F.round("again", 9))).alias("n_differ"))


def _release_checks(spark, d: str) -> DataFrame:
    s = dim_scores(spark, d)
    rules = {"min_above_mean": "score_min > score_mean + 1e-12", "out_of_bounds": "score_mean < 0 or score_mean > 1", "eligible_without_score": "eligible and score_mean is null", "score_without_eligible": "not eligible and score_mean is not null", "valid_not_eligible": "validity_status = 'valid' and not eligible"}
    return R.counted(s, _exprs(rules))


def _nested_q(spark, d: str) -> DataFrame:
    return R.nested_keys(ST.dimension_states(dim_scores(spark, d), [0.1, 0.2, 0.3]).select(*R.KEYS, "dimension", "q", "active"), [*R.KEYS, "dimension"])


def _status_long(spark, d: str) -> DataFrame:
    s = two_states(spark, d)
    return rounded(R.availability(s.select("security_id", "validity_status", F.array("validity_status").alias("reason_codes")), "security_id"))


#: Where the rows of a gap can be fetched again, and the SQL of the same candidates.
ENDPOINTS = {"daily": "daily_prices", "limit": "price_limits"}
step(
    "repairs",
    """select *, case gap_type when 'daily' then 'daily_prices' when 'limit' then 'price_limits' else 'manual' end as endpoint,
  case when n_days > 20 then 1 when n_days > 5 then 2 else 3 end as priority from gapiv""",
)
INDICATORS = [n for names in DIMENSIONS.values() for n in names]
step("valid_metrics", " union all ".join(f"select security_id, trading_date, '{n}' as indicator, round(value + 1e-13, 10) as value from rm_{n} where validity_status = 'valid' and value is not null" for n in INDICATORS))


def _repairs(spark, d: str) -> DataFrame:
    return R.repair_candidates(PQ.Q.gap_intervals(PQ.gaps(spark, d), PQ.expected(spark, d)), ENDPOINTS)


def _common_wide(spark, d: str) -> DataFrame:
    wide = R.common_wide(wide_metrics(spark, d), INDICATORS)
    return text_dates(wide.select("security_id", "trading_date", *[F.round(n, 6).alias(n) for n in INDICATORS]))


def queries() -> dict:
    return {
        "dq19_repair_candidates": lambda s, d: text_dates(_repairs(s, d)),
        "dq19_repair_rollup": lambda s, d: R.repair_rollup(_repairs(s, d), ["security_id", "endpoint"]),
        "as26_common_wide": _common_wide,
        "src05_raw_candidate": _raw_candidate,
        "dq03_member_alignment": _members,
        "dq18_missing_limit_cause": lambda s, d: text_dates(R.diagnose_limits(PQ.gaps(s, d), PQ.suspended(s, d), prices(s, d))),
        "dq25_insert_blockers": _observations,
        "dq27_turnover_fields": lambda s, d: text_dates(R.turnover_fields(_turnover(s, d))),
        "dq29_turnover_candidate": _candidate,
        "dq30_field_matrix": lambda s, d: R.field_matrix(prices(s, d), NEEDS),
        "dq31_dataset_audit": lambda s, d: R.counted(_with_factor(s, d), _exprs(_AUDIT)),
        "dq32_schema_catalog": lambda s, d: R.schema_catalog(prices(s, d).select("security_id", "trading_date", "adjusted_close", "suspension_flag"), ROLES),
        "dq37_factor_asof_checks": _asof,
        "dq38_continuous_prices": _continuous,
        "dq40_market_quality": _market,
        "dq41_composed_observation": _composed,
        "dq45_member_normalisation": _normal_members,
        "dq46_index_battery": _index_battery,
        "dq47_status_coverage": _status_coverage,
        "rm12_price_reasons": lambda s, d: text_dates(R.price_reasons(_price_rows(s, d)).withColumn("reasons", F.array_join("reasons", ","))),
        "rm13_readiness": _readiness,
        "gr01_grid_daily_full": grid_counts,
        "gr03_grid_intervals": lambda s, d: text_dates(ST.intervals(grid_confirmed(s, d), ["security_id", "config_id"])),
        "cf07_normal_intervals": lambda s, d: text_dates(R.normalise_intervals(user_intervals(s, d), WORDS).select("security_id", "k", "interval_no", "end_reason", "violations")),
        "pr08_year_rows": _years,
        "pr11_comparison": lambda s, d: rounded(R.compare_to(user_intervals(s, d).groupBy(F.col("k").cast("long").alias("k")).agg(F.count("*").alias("n_intervals")), "k", 3, "n_intervals")),
        "pr13_parent_geometry": _child_map,
        "pr15_hit_duration": _hits,
        "pr16_existence": lambda s, d: rounded(R.conservation(spine_confirmed(s, d), user_intervals(s, d), ["k"])),
        "pr17_two_ways": _two_ways,
        "as08_dimension_flags": lambda s, d: text_dates(flags(s, d)),
        "as11_layer_steps": lambda s, d: rounded(R.layer_steps(flags(s, d), DIMS)),
        "as14_q_nesting": _nested_q,
        "as19_baseline_sensitivity": _sensitivity,
        "as20_survival": lambda s, d: rounded(R.survival(A.lag_targets(spine(s, d), "raw_state", KS_LAG))),
        "as21_anchor_status": lambda s, d: rounded(R.anchor_status(A.lag_targets(spine(s, d), "raw_state", KS_LAG))),
        "as30_availability": _status_long,
        "yr02_interval_years": _interval_years,
        "yr07_challenger_by_year": _challenger,
        "ez10_lineage": lambda s, d: text_dates(R.lineage(parts(s, d)[1], parts(s, d)[2], ZK)),
        "ez15_zone_metrics": _zone_metrics,
        "ez16_component_profile": _component_profile,
        "ez17_gap_response": _response,
        "ez19_canonical_events": _canonical,
        "ez21_risk_flags": _risk,
        "ez22_daily_audit": _audit_daily,
        "ex04_full_record": _full_record,
        "ex06_cross_q": _cross_q,
        "ex07_exit_profile": _exit_profile,
        "rc04_ordered_digest": _digest,
        "rc06_contract_checks": _contract,
        "rc08_recompute": _recompute,
        "rc09_release_checks": _release_checks,
    }


def oracle_sql() -> dict[str, str]:
    for name, g in (("zc", 0), ("zd", 2)):
        zone_steps(name, 1, 2, g)
    factor = "(select p.*, adj_factor from pday p left join fact using (security_id, trading_date))"
    asof_rows = "(select p.security_id, p.trading_date, f.trading_date as factor_date, adj_factor from pday p asof left join fact f on p.security_id = f.security_id and p.trading_date >= f.trading_date)"
    pmiss = "srcst join (select security_id, trading_date, factor_status from evid) using (security_id, trading_date) left join pday p using (security_id, trading_date)"
    reasons = {
        "listing_pause": ("trading_status = 'listing_pause'", 2), "suspended": ("trading_status = 'suspended'", 2), "trading_status_unknown": ("trading_status = 'unknown'", 1), "daily_missing": ("daily_status = 'missing'", 1),
        "factor_missing": ("factor_status = 'missing'", 1), "non_positive_price": ("least(adjusted_open, adjusted_high, adjusted_low, adjusted_close) <= 0", 3), "high_below_low": ("adjusted_high < adjusted_low", 3),
    }
    listed = ", ".join(f"case when {c} then '{n}' end" for n, (c, _) in reasons.items())
    worst = ", ".join(f"case when {c} then {k} else 0 end" for c, k in reasons.values())
    groups = {"price": 0, "range": 1, "flow": 2, "status": 3}
    named = ", ".join(f"case when (security_id + {i}) % 7 <> 0 then '{n}' end" for n, i in groups.items())
    assoc = """round(n11 / nullif(n11 + n10 + n01, 0), 6) as jaccard, round(n11 / nullif(n11 + n10, 0), 6) as b_given_a, round(n11 / nullif(n11 + n01, 0), 6) as a_given_b, round((n11 + n01) / nullif(n11 + n10 + n01 + n00, 0), 6) as base_rate,
round(n11 / nullif(n11 + n10, 0) / nullif((n11 + n01) / nullif(n11 + n10 + n01 + n00, 0), 0), 6) as lift, round(n11 / nullif(n11 + n10, 0) - (n11 + n01) / nullif(n11 + n10 + n01 + n00, 0), 6) as delta,
round(n11 / nullif(n11 + n10, 0) - n01 / nullif(n01 + n00, 0), 6) as delta_vs_not_a, round(n11 - (n11 + n10) * (n11 + n01) / nullif(n11 + n10 + n01 + n00, 0), 6) as excess_joint"""
    steps = []
    for i in range(1, len(DIMS)):
        known = " and ".join(f"raw_{x} is not null" for x in DIMS[: i + 1])
        whole = " and ".join(f"raw_{x} is not null" for x in DIMS)
        anchor = " and ".join(f"active_{x}" for x in DIMS[:i])
        steps.append(f"select '{''.join(DIMS[:i])}->{DIMS[i]}' as step, count(*) filter ({known}) as n_step, count(*) filter ({whole}) as n_all, count(*) filter ({known} and {anchor}) as n_anchor, count(*) filter ({known} and {anchor} and active_{DIMS[i]}) as n_target, count(*) filter ({known} and active_{DIMS[i]}) as n_base from flags")
    avail = ", ".join(f"count(*) filter (validity_status = '{x}') as n_{x}" for x in ("valid", "unknown", "diagnostic_required", "blocked"))
    return {
        "dq19_repair_candidates": query("select * from repairs"),
        "dq19_repair_rollup": query("select security_id, endpoint, count(*) as n_intervals, sum(n_days)::bigint as n_days, min(priority) as first_priority, count(*) filter (priority = 1) as n_urgent from repairs group by 1, 2"),
        "as26_common_wide": query("select security_id, cast(trading_date as varchar) as trading_date, " + ", ".join(f"round({n}, 6) as {n}" for n in INDICATORS) + " from (select security_id, trading_date, " + ", ".join(f"max(value) filter (indicator = '{n}') as {n}" for n in INDICATORS) + f" from valid_metrics group by 1, 2 having count(distinct indicator) = {len(INDICATORS)})"),
        "src05_raw_candidate": query("select coalesce(s_name, 'unmapped') as security_id, 'raw' as price_basis, cast(min(l_shipdate::date) as varchar) as first_day, count(*) as n_rows, round(sum(l_extendedprice), 6) as amount from lineitem left join (select * from supplier where s_suppkey % 10 <> 9) on l_suppkey = s_suppkey group by 1"),
        "dq03_member_alignment": query("select *, s_suppkey || '|' || s_nationkey || '|index|static' as alignment_key, count(*) over (partition by s_suppkey, s_nationkey) = 1 as unique_key from mem_keys"),
        "dq18_missing_limit_cause": query(f"select security_id, {_D}, case when s.trading_date is not null then 'suspended' when p.trading_date is null then 'daily_missing_too' else 'limit_source_missing' end as cause from (select * from gapt where gap_type = 'limit') g left join (select distinct security_id, trading_date from susp) s using (security_id, trading_date) left join pday p using (security_id, trading_date)"),
        "dq25_insert_blockers": query(long_counts(_OBS, factor) + " union all select 'duplicates', 0.0::double"),
        "dq27_turnover_fields": query(f"select security_id, {_D}, round(volume_shares / (1000.0 + security_id), 9) as turnover_float, round(case when security_id % 6 <> 0 then volume_shares / (800.0 + security_id) end, 9) as turnover_free, round(volume_shares / (1000.0 + security_id) * 100, 9) as turnover_float_pct, round(case when security_id % 6 <> 0 then volume_shares / (800.0 + security_id) * 100 end, 9) as turnover_free_pct from pday"),
        "dq29_turnover_candidate": query("select security_id, case when security_id % 8 <> 3 then 'as_published' else 'unavailable' end as policy, count(*) as n_rows, round(avg((security_id % 8 <> 3)::int), 6) as coverage, round(sum(turnover_float) filter (security_id % 8 <> 3), 6) as total from pday group by 1, 2"),
        "dq30_field_matrix": query("select count(*) as n_rows, 'range' as indicator, count(*) filter (adjusted_high is not null and adjusted_low is not null) as n_available, 'ready' as readiness from pday union all select count(*), 'turnover', count(*) filter (turnover_float is not null), 'ready' from pday union all select count(*), 'flow', 0, 'unavailable' from pday"),
        "dq31_dataset_audit": query(long_counts(_AUDIT, factor)),
        "dq32_schema_catalog": query("select unnest(['security_id', 'trading_date', 'adjusted_close', 'suspension_flag']) as \"column\", n as n_values, unnest(['bigint', 'date', 'double', 'boolean']) as type, unnest(['key', 'time', 'measure', 'status']) as role, unnest([0, 1, 2, 3])::bigint as place from (select count(*) as n from pday)"),
        "dq37_factor_asof_checks": query(long_counts({n: c.replace("datediff({0}, trading_date, factor_date)", "datediff('day', factor_date, trading_date)") for n, c in _ASOF.items()}, asof_rows)),
        "dq38_continuous_prices": query(long_counts(_CONT, "(select *, adjusted_close * coalesce(adj_factor, 1.0) as close, adjusted_high * coalesce(adj_factor, 1.0) as high, adjusted_low * coalesce(adj_factor, 1.0) as low from " + factor + ")")),
        "dq40_market_quality": query(f"select case when trading_status = 'suspended' then 'suspended' when limit_status = 'missing' then 'unconstrained' else 'limited' end as constraint_class, case when daily_status = 'present' then 'none' when trading_status = 'suspended' then 'attributed' else 'unattributed' end as gap_class, case when daily_vwap is null then 'unknown' when daily_vwap between adjusted_low - 0.005 and adjusted_high + 0.005 then 'pass' else 'fail' end as vwap_status, count(*) as n_rows from {pmiss} group by 1, 2, 3"),
        "dq41_composed_observation": query(f"select security_id, {_D}, case when security_id % 7 <> 0 then round(adjusted_close, 9) end as adjusted_close, case when (security_id + 1) % 7 <> 0 then round(adjusted_high, 9) end as adjusted_high, case when (security_id + 2) % 7 <> 0 then round(volume_shares, 9) end as volume_shares, case when (security_id + 3) % 7 <> 0 then suspension_flag end as suspension_flag, concat_ws('+', {named}) as lineage from pday"),
        "dq45_member_normalisation": query("select case s_suppkey % 4 when 0 then 'Shenzhen' when 3 then 'unknown' else 'Shanghai' end as market, case s_suppkey % 4 when 2 then 'inferred' when 3 then 'unresolved' else 'resolved' end as status, count(*) as n_members, count(distinct case when s_suppkey % 4 in (1, 2) then lpad((600000 + s_suppkey)::varchar, 6, '0') else lpad(s_suppkey::varchar, 6, '0') end) as n_tickers, min(case when s_suppkey % 4 in (1, 2) then lpad((600000 + s_suppkey)::varchar, 6, '0') else lpad(s_suppkey::varchar, 6, '0') end) as first_ticker from supplier group by 1, 2"),
        "dq46_index_battery": query("select 'sequence_broken' as metric, 0.0::double as value union all select 'present_without_row', (count(*) filter (total is not null and security_id % 11 = 7))::double from uspine union all select 'row_without_presence', 0.0::double union all select 'row_outside_index', 0.0::double"),
        "dq47_status_coverage": query(" union all ".join(f"select '{c}' as field, count(*) as n_rows, count(*) filter ({c} <> '{u}') as n_known, round(count(*) filter ({c} <> '{u}') / count(*), 6) as known_share, case when count(*) filter ({c} <> '{u}') / count(*) >= 0.95 then 'accepted' when count(*) filter ({c} <> '{u}') / count(*) >= 0.5 then 'review' else 'rejected' end as acceptance from srcst" for c, u in (("trading_status", "unknown"), ("daily_status", "missing"), ("limit_status", "missing")))),
        "rm12_price_reasons": query(f"select security_id, {_D}, array_to_string(list_filter([{listed}], lambda x: x is not null), ',') as reasons, ['valid', 'unknown', 'diagnostic_required', 'blocked'][1 + greatest({worst})] as validity_status from {pmiss}"),
        "rm13_readiness": query(_readiness_sql()),
        "gr01_grid_daily_full": query("select split_part(security_id, '|', 1) || '_K' || k as config_id, count(*) as n_rows, count(*) filter (raw_state) as n_true, count(*) filter (confirmed) as n_confirmed, count(*) filter (confirmed is null) as n_unknown from gr_conf group by 1"),
        "gr03_grid_intervals": query("select split_part(security_id, '|', 2)::bigint as security_id, split_part(security_id, '|', 1) || '_K' || k as config_id, interval_no, cast(raw_start_date as varchar) as raw_start_date, cast(confirmation_date as varchar) as confirmation_date, cast(interval_end_date as varchar) as interval_end_date, cast(last_observed_date as varchar) as last_observed_date, duration_raw_days, duration_confirmed_days, is_open, termination_reason from gr_int"),
        "cf07_normal_intervals": query("select security_id, k, interval_no, case termination_reason when 'end_of_input_open' then 'sample_end' when 'state_false' then 'natural' when 'state_unknown' then 'quality' when 'state_blocked' then 'quality' else 'other' end as end_reason, '' as violations from us_int"),
        "pr08_year_rows": query("select *, round(n_true / sum(n_true) over (), 6) as share, n_true = max(n_true) over () as peak from lr_year"),
        "pr11_comparison": query("select k, n as n_intervals, n - b as difference, round(n / b, 6) as ratio, case when k = 3 then 'baseline' when abs(n / b - 1) <= 0.01 then 'same' when n / b > 1 then 'more' else 'less' end as class from (select k, count(*) as n from us_int group by 1) cross join (select count(*) as b from us_int where k = 3)"),
        "pr13_parent_geometry": query("select security_id, interval_no, cast(c.raw_start_date as varchar) as raw_start_date, cast(max(p.raw_start_date) as varchar) as p_start, count(p.k) as n_parents, datediff('day', max(p.raw_start_date), c.raw_start_date) as start_delay, round(c.duration_raw_days / arg_max(p.duration_raw_days, p.raw_start_date), 6) as duration_share from (select * from us_int where k = 3) c left join (select security_id, k, raw_start_date, last_observed_date, duration_raw_days from us_int where k = 2) p using (security_id) where p.raw_start_date <= c.raw_start_date and p.last_observed_date >= c.last_observed_date group by security_id, interval_no, c.raw_start_date, c.duration_raw_days"),
        "pr15_hit_duration": query("select q, count(active) as n_known, count(*) filter (active) as n_true, count(*) filter (active and not coalesce(b, false)) as n_segments, count(*) filter (active and not b) as n_strict, count(*) filter (active and b is null) as n_censored, round(count(*) filter (active) / count(active), 6) as hit_rate, round(count(*) filter (active) / count(*) filter (active and not coalesce(b, false)), 6) as mean_days from (select *, lag(active) over (partition by security_id, q order by trading_date) as b from st_ind) group by 1"),
        "pr16_existence": query("select a.k, n_daily, n_entities, coalesce(n_interval_days, 0) as n_interval_days, coalesce(n_intervals, 0) as n_intervals, n_daily - coalesce(n_interval_days, 0) as difference from (select k, count(*) filter (confirmed) as n_daily, count(distinct case when confirmed then security_id end) as n_entities from us_conf group by 1) a left join (select k, sum(duration_confirmed_days)::bigint as n_interval_days, count(*) as n_intervals from us_int group by 1) b using (k)"),
        "pr17_two_ways": query("select security_id, count(*) filter (confirmed) as n_a, count(*) filter (confirmed) as n_b, 0 as n_differ from us_conf where k = 2 group by 1"),
        "as08_dimension_flags": query("select * replace (cast(trading_date as varchar) as trading_date) from flags"),
        "as11_layer_steps": query("select *, round(n_target / nullif(n_anchor, 0), 6) as retention, round(n_base / nullif(n_step, 0), 6) as base_rate, case when n_anchor = 0 or n_step = 0 then 'undefined' when abs(n_target / n_anchor - n_base / n_step) <= 0.01 then 'flat' when n_target / n_anchor > n_base / n_step then 'up' else 'down' end as direction, concat_ws(',', case when n_anchor < 30 then 'small_anchor' end, case when n_target < 10 then 'small_target' end) as warnings from (" + " union all ".join(steps) + ")"),
        "as14_q_nesting": query("select q, count(*) filter (active) as n_active, count(*) filter (active and not nx) as n_violations from (select *, lead(active) over (partition by security_id, trading_date, dimension order by q) as nx from st_dim) where nx is not null or active is not null group by 1"),
        "as19_baseline_sensitivity": query("select *, round(x - unconditional_, 6) as over_unconditional, round(x - y, 6) as over_standardised, sign(x - unconditional_) * sign(x - y) < 0 as sign_conflict from (select k, round(avg(target::int), 6) as onset_rate, round(avg(rate), 6) as standardised, count(rate) as n_covered, round(u, 6) as unconditional, avg(target::int) as x, avg(rate) as y, u as unconditional_ from (select * from lagt where anchor = 'onset' and target is not null) left join (select security_id, count(*) filter (raw_state) / nullif(count(raw_state), 0) as rate from uspine group by 1) using (security_id) cross join (select count(*) filter (raw_state) / count(raw_state) as u from uspine) group by k, u)").replace("select *, round(x - unconditional_, 6)", "select k, onset_rate, standardised, n_covered, unconditional, round(x - unconditional_, 6)"),
        "as20_survival": query("select k, count(*) filter (anchor = 'onset' and complete) as n_complete, count(*) filter (anchor = 'onset' and complete and survived) as n_survived, count(*) filter (anchor = 'onset' and complete and target) as n_active, count(*) filter (anchor = 'onset' and complete and target and not survived) as n_reentered, round(count(*) filter (anchor = 'onset' and complete and survived) / nullif(count(*) filter (anchor = 'onset' and complete), 0), 6) as survival_rate from lagt group by 1"),
        "as21_anchor_status": query("select k, anchor, case when not complete then 'right_censored' when target is null then 'unknown' when target then 'true' else 'false' end as target_status, count(*) as n_anchors from lagt group by 1, 2, 3"),
        "as30_availability": query(f"select security_id, count(*) as n_rows, {avail}, round(count(*) filter (validity_status = 'valid') / count(*), 6) as valid_share, arg_max(validity_status, row(c, validity_status)) as top_reason from (select *, count(*) over (partition by security_id, validity_status) as c from two) group by 1"),
        "yr02_interval_years": query("select period, coalesce(n, 0) as n_intervals, coalesce(cd, 0) as confirmed_days, round(md, 6) as median_days, coalesce(cy, 0) as n_cross_year from (select distinct year(trading_date) as period from pday) left join (select year(confirmation_date) as period, count(*) as n, sum(duration_confirmed_days)::bigint as cd, quantile_cont(duration_confirmed_days, 0.5) as md, count(*) filter (year(raw_start_date) <> year(last_observed_date)) as cy from lr_int where k = 3 group by 1) using (period)"),
        "yr07_challenger_by_year": query(f"select *, {assoc} from (select year(trading_date) as period, count(*) filter (a and b) as n11, count(*) filter (a and not b) as n10, count(*) filter (not a and b) as n01, count(*) filter (not a and not b) as n00 from (select security_id, trading_date, bool_or(active) filter (q = 0.1) as a, bool_or(active) filter (q = 0.2) as b from st_ind group by 1, 2) where a is not null and b is not null group by 1)"),
        "ez10_lineage": query("select a.security_id, run, a.zone, row_number() over (partition by a.security_id, a.zone order by first_seq) as component_no, cast(a.start_date as varchar) as start_date, cast(a.end_date as varchar) as end_date, end_reason, status = 'RIGHT_CENSORED' as censored from za_asg a join za_zone z on a.security_id = z.security_id and a.zone = z.zone where qualified"),
        "ez15_zone_metrics": query("select status, n_zones, round(mean_span, 6) as mean_span, q95_confirmed, top, n_entities, round(top / n_zones, 6) as top_share from (select status, count(*) as n_zones, avg(datediff('day', start_date, end_date)) as mean_span, max(case when r = ceil(n * 0.95) then n_confirmed end) as q95_confirmed from (select *, count(*) over (partition by status) as n, row_number() over (partition by status order by n_confirmed, security_id, zone) as r from za_zone) group by 1) join (select status, max(own) as top, count(*) as n_entities from (select status, security_id, count(*) as own from za_zone group by 1, 2) group by 1) using (status)"),
        "ez16_component_profile": query("select qualified, end_reason, count(*) as n_components, round(avg(n_confirmed), 6) as mean_confirmed, round(quantile_cont(n_confirmed, 0.5), 6) as median_confirmed, max(n_confirmed) as most_confirmed, round(avg(datediff('day', start_date, qualification_date)), 6) as mean_delay, count(*) filter (bridged) as n_bridged from za_asg group by 1, 2"),
        "ez17_gap_response": query("select g, n_zones, n_components, n_bridges, coalesce(n_zones <= lag(n_zones) over (order by g), true) as monotone from (" + " union all ".join(f"select {g} as g, count(*) as n_zones, sum(n_components)::bigint as n_components, sum(n_bridges)::bigint as n_bridges from {z}_zone" for z, g in (("zc", 0), ("za", 1), ("zd", 2))) + ")"),
        "ez19_canonical_events": query("select sha256(z.security_id || '|' || z.start_date) as event_id, z.security_id, z.zone, n_days, n_core, components from za_zone z join (select security_id, zone, count(*) as n_days, count(*) filter (role = 'core') as n_core from za_mem group by 1, 2) m using (security_id, zone) join (select security_id, zone, string_agg(run::varchar, ',' order by run) as components from za_asg where qualified group by 1, 2) c using (security_id, zone)"),
        "ez21_risk_flags": query(f"select security_id, {_D}, in_zone, not hard_break and not coalesce(lag(raw_state) over w, false) as state_risk, not hard_break and not coalesce(lag(in_zone) over w, false) as event_risk from (select d.*, m.zone is not null as in_zone from za_day d left join za_mem m using (security_id, trading_date)) window w as (partition by security_id order by trading_date)"),
        "ez22_daily_audit": query("select 'unknown_zone' as metric, 0.0::double as value union all select 'outside_zone', 0.0 union all select 'core_not_confirmed', 0.0 union all select 'break_inside', (count(*) filter (hard_break))::double from za_mem join za_day using (security_id, trading_date) union all select 'bridge_confirmed', 0.0"),
        "ex04_full_record": query("select i.security_id, k, interval_no, cast(interval_end_date as varchar) as interval_end_date, cast(last_observed_date as varchar) as last_observed_date, termination_reason, validity_status as status_after, raw_state as state_after, total as total_after, duration_confirmed_days from us_int i join uspine s on s.security_id = i.security_id and s.trading_date = i.last_observed_date where not is_open"),
        "ex06_cross_q": query("select case when strict then 'core' when ld and lg then 'between' when ld then 'leading' when lg then 'trailing' else 'shell' end as day_class, count(*) as n_days, count(distinct security_id) as n_entities, count(*) filter (strict and not loose) as n_violations from (select *, coalesce(lead(strict) over w, false) as ld, coalesce(lag(strict) over w, false) as lg from (select security_id, trading_date, coalesce(bool_or(active) filter (q = 0.1), false) as strict, coalesce(bool_or(active) filter (q = 0.3), false) as loose from st_ind group by 1, 2) window w as (partition by security_id order by trading_date)) where loose or strict group by 1"),
        "ex07_exit_profile": query("select k, count(*) as n_intervals, count(*) filter (is_open) as n_open, count(*) filter (termination_reason = 'state_false') as n_natural, round(avg(duration_confirmed_days), 6) as mean_days, round(quantile_cont(duration_confirmed_days, 0.5), 6) as median_days, max(own) as top, round(max(own) / count(*), 6) as top_share from (select *, count(*) over (partition by k, security_id) as own from us_int) group by 1"),
        "rc04_ordered_digest": query("select c_custkey // 500 as part, count(*) as n_rows, sha256(string_agg(sha256(concat_ws('|', c_custkey::varchar, coalesce(c_name, '~'), coalesce(c_nationkey::varchar, '~'), coalesce(c_mktsegment, '~'), (c_custkey // 500)::varchar)), '' order by c_custkey)) as digest from customer group by 1"),
        "rc06_contract_checks": query("select *, 0 as expected, observed = 0 as passed from (select 'lines_without_order' as rule, count(*) as observed from lineitem where l_orderkey not in (select o_orderkey from orders) union all select 'orders_without_customer', count(*) from orders where o_custkey not in (select c_custkey from customer) union all select 'repeated_orders', count(*) from (select o_orderkey from orders group by 1 having count(*) > 1) union all select 'non_positive_quantity', count(*) from lineitem where l_quantity <= 0)"),
        "rc08_recompute": query("select security_id, count(*) as n_rows, count(percentile) as n_released, 0 as n_differ from sc_log_range20 group by 1"),
        "rc09_release_checks": query(long_counts({"min_above_mean": "score_min > score_mean + 1e-12", "out_of_bounds": "score_mean < 0 or score_mean > 1", "eligible_without_score": "eligible and score_mean is null", "score_without_eligible": "not eligible and score_mean is not null", "valid_not_eligible": "validity_status = 'valid' and not eligible"}, "dim_scores")),
    }
