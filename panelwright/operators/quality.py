"""Reference data, coverage and quality of a panel's sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.conventions import PANEL, Panel, ratio, reason_list

KEYS = ["security_id", "trading_date"]


def resolve_codes(df: DataFrame, column: str) -> DataFrame:
    """Exchange and symbol from codes such as 000123.SZ, sz.000123 or 000123; ``status`` tells what was found."""
    code = F.upper(F.trim(F.coalesce(F.col(column), F.lit(""))))
    symbol = F.regexp_extract(code, r"(\d{6})", 1)
    named = F.regexp_extract(code, r"(?:^|\.)(SZ|SH)(?:\.|$)", 1)
    guess = F.when(F.substring(symbol, 1, 1).isin("6", "9"), "SH").when(symbol != "", "SZ")
    exchange = F.when(named != "", named).otherwise(guess)
    status = F.when(symbol == "", "unresolved").when(named != "", "resolved").otherwise("inferred")
    return df.select(
        "*", F.when(symbol != "", symbol).alias("symbol"), exchange.alias("exchange"),
        F.when(symbol != "", F.concat_ws(".", symbol, exchange)).alias("vendor_code"), status.alias("status"),
    )


def audit_members(members: DataFrame, key: str, pattern: str, status: str, allowed: list[str]) -> DataFrame:
    """Counts of rows, distinct and repeated keys, malformed keys and unknown statuses, as (metric, value)."""
    row = members.agg(
        F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"), (F.count(key) - F.countDistinct(key)).alias("n_repeated"),
        F.count_if(~F.col(key).rlike(pattern)).alias("n_malformed"), F.count_if(~F.col(status).isin(allowed)).alias("n_bad_status"),
    )
    return as_metrics(row)


def as_metrics(row: DataFrame) -> DataFrame:
    """The columns of one row as (metric, value) rows."""
    return row.select([F.col(c).cast("double").alias(c) for c in row.columns]).unpivot([], row.columns, "metric", "value")


def expected_keys(universe: DataFrame, calendar: DataFrame) -> DataFrame:
    """Entities on the calendar's open days, each within its life [list_date, delist_date]."""
    days = calendar.where("is_open")
    alive = (F.col("trading_date") >= F.col("list_date")) & F.coalesce(F.col("trading_date") <= F.col("delist_date"), F.lit(True))
    # a calendar has a row for each day, however large the panel
    return universe.crossJoin(F.broadcast(days.select("trading_date"))).where(alive).select(*KEYS)


def expand_routes(keys: DataFrame, routes: list[str]) -> DataFrame:
    return keys.withColumn("route", F.explode(F.array(*map(F.lit, routes))))


def completeness(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has."""
    lacking = expected.select(keys).join(observed.select(keys), keys, "left_anti").withColumn("problem", F.lit("missing"))
    return lacking.unionByName(observed.select(keys).join(expected.select(keys), keys, "left_anti").withColumn("problem", F.lit("unexpected")))


def source_status(expected: DataFrame, daily: DataFrame, suspended: DataFrame, limits: DataFrame) -> DataFrame:
    """Trading, daily and limit status of each expected key."""
    out = expected.join(daily.select(*KEYS, F.lit(True).alias("_day")), KEYS, "left")
    out = out.join(suspended.select(*KEYS, F.lit(True).alias("_off")).distinct(), KEYS, "left").join(limits.select(*KEYS, "up_limit", "down_limit"), KEYS, "left")
    day, off = F.col("_day").isNotNull(), F.col("_off").isNotNull()
    return out.select(
        *KEYS, F.when(off, "suspended").when(day, "trading").otherwise("unknown").alias("trading_status"),
        F.when(day, "present").when(off, "not_expected").otherwise("missing").alias("daily_status"),
        F.when(F.col("up_limit").isNotNull() & F.col("down_limit").isNotNull(), "resolved").when(off, "not_expected").otherwise("missing").alias("limit_status"),
    )


def factor_evidence(expected: DataFrame, suspended: DataFrame, factors: DataFrame) -> DataFrame:
    """Resolved, carried forward over a suspension, or missing."""
    out = expected.join(factors.select(*KEYS, "adj_factor"), KEYS, "left").join(suspended.select(*KEYS, F.lit(True).alias("_off")).distinct(), KEYS, "left")
    status = F.when(F.col("adj_factor").isNotNull(), "resolved").when(F.col("_off").isNotNull(), "carry_forward").otherwise("missing")
    return out.select(*KEYS, "adj_factor", status.alias("factor_status"))


def coverage_gaps(status: DataFrame, factors: DataFrame) -> DataFrame:
    """A row for each key and kind of gap."""
    kinds = [
        status.where("daily_status = 'missing'").select(*KEYS, F.lit("daily").alias("gap_type")),
        status.where("limit_status = 'missing'").select(*KEYS, F.lit("limit").alias("gap_type")),
        factors.where("factor_status = 'missing'").select(*KEYS, F.lit("factor").alias("gap_type")),
    ]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


def quality_summary(prices: DataFrame) -> DataFrame:
    """Scalar counts of a price table as (metric, value), in one pass."""
    ohlc = [f"adjusted_{x}" for x in ("open", "high", "low", "close")]
    null, low = F.lit(False), F.lit(False)
    for c in ohlc:
        null, low = null | F.col(c).isNull(), low | (F.col(c) <= 0)
    return as_metrics(
        prices.agg(
            F.count("*").alias("n_rows"), F.countDistinct("security_id").alias("n_entities"), (F.count("*") - F.countDistinct(*KEYS)).alias("n_repeated_keys"),
            F.count_if(null).alias("n_null_ohlc"), F.count_if(low).alias("n_non_positive_ohlc"), F.count_if(F.col("adjusted_high") < F.col("adjusted_low")).alias("n_high_below_low"),
            F.count_if(F.col("volume_shares") <= 0).alias("n_zero_volume"), F.count_if("suspension_flag").alias("n_suspended"),
        )
    )


def acceptance(summary: DataFrame, blockers: list[str]) -> DataFrame:
    """Accepted unless some blocking metric is above zero; names those that are."""
    bad = F.array_sort(F.collect_list(F.when(F.col("metric").isin(blockers) & (F.col("value") > 0), F.col("metric"))))
    return summary.agg(bad.alias("bad")).select(F.when(F.size("bad") == 0, "accepted").otherwise("blocked").alias("status"), F.array_join("bad", ",").alias("blockers"))


def apply_pause(status: DataFrame, pauses: DataFrame) -> DataFrame:
    """Replace statuses of days inside a pause interval of their entity."""
    month = lambda x: F.year(x) * 12 + F.month(x)
    # pauses are dealt to the months that they touch, so a day meets those of its month alone
    p = pauses.select("security_id", "begin", "end", F.explode(F.sequence(month("begin"), month("end"))).alias("_month"))
    days = status.select(*KEYS, month("trading_date").alias("_month"))
    hit = days.join(p, ["security_id", "_month"]).where("trading_date between begin and end").select(*KEYS).distinct().withColumn("_hit", F.lit(True))
    out = status.join(hit, KEYS, "left")
    paused = F.col("_hit").isNotNull()
    return out.select(*KEYS, F.when(paused, "listing_pause").otherwise(F.col("trading_status")).alias("trading_status"), F.when(paused, "not_expected").otherwise(F.col("daily_status")).alias("daily_status"), paused.alias("overridden"))


def apply_factor_policy(evidence: DataFrame) -> DataFrame:
    """A neutral factor for missing rows, marked as the policy's."""
    return evidence.withColumns({"effective_factor": F.coalesce("adj_factor", F.lit(1.0)), "policy": F.when(F.col("adj_factor").isNull(), "neutral_factor").otherwise("source")})


def gap_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Numbers of gaps of each type before and after a policy."""
    a = before.groupBy("gap_type").agg(F.count("*").alias("n_before"))
    b = after.groupBy("gap_type").agg(F.count("*").alias("n_after"))
    out = a.join(b, "gap_type", "full").select("gap_type", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))
    return out.withColumn("n_closed", F.col("n_before") - F.col("n_after"))


def gap_intervals(gaps: DataFrame, expected: DataFrame) -> DataFrame:
    """Gaps that are consecutive on the entity's expected days, as intervals."""
    placed = expected.withColumn("_at", F.row_number().over(PANEL.order()))
    w = Window.partitionBy("security_id", "gap_type").orderBy("trading_date")
    out = gaps.join(placed, KEYS).withColumn("_run", F.col("_at") - F.row_number().over(w))
    return out.groupBy("security_id", "gap_type", "_run").agg(F.min("trading_date").alias("begin"), F.max("trading_date").alias("end"), F.count("*").alias("n_days")).drop("_run")


def gap_profiles(gaps: DataFrame) -> DataFrame:
    """Keys by the set of gap types that meet there."""
    keys = gaps.groupBy(*KEYS).agg(F.array_join(F.array_sort(F.collect_set("gap_type")), "+").alias("gap_types"))
    return keys.groupBy("gap_types").agg(F.count("*").alias("n_keys"), F.countDistinct("security_id").alias("n_entities"))


def diagnose_missing_daily(gaps: DataFrame, suspended: DataFrame, calendar: DataFrame, universe: DataFrame) -> DataFrame:
    """Root cause of each missing daily row by the first rule that holds."""
    out = gaps.where("gap_type = 'daily'").join(suspended.select(*KEYS, F.lit(True).alias("_off")).distinct(), KEYS, "left")
    out = out.join(calendar.select("trading_date", "is_open"), "trading_date", "left").join(universe.select("security_id", "list_date"), "security_id", "left")
    cause = F.when(F.col("_off").isNotNull(), "suspended").when(~F.coalesce("is_open", F.lit(False)), "calendar_closed").when(F.datediff("trading_date", "list_date") < 5, "new_listing").otherwise("vendor_gap")
    return out.select(*KEYS, cause.alias("cause"))


def nearest_factors(gaps: DataFrame, factors: DataFrame) -> DataFrame:
    """Dates of the nearest factor before and after each missing one, and the days to them."""
    rows = gaps.where("gap_type = 'factor'").select(*KEYS, F.lit(None).cast("date").alias("_have"))
    both = rows.unionByName(factors.select(*KEYS, F.col("trading_date").alias("_have")))
    running = (Window.unboundedPreceding, 0)
    back = Window.partitionBy(PANEL.entity).orderBy(F.desc(PANEL.time))  # from the end, so the frame only grows
    both = both.withColumns(
        {
            "previous_date": F.last("_have", ignorenulls=True).over(PANEL.order().rowsBetween(*running)),
            "next_date": F.last("_have", ignorenulls=True).over(back.rowsBetween(*running)),
        }
    )
    both = both.where("_have is null")
    return both.select(*KEYS, "previous_date", "next_date", F.datediff("trading_date", "previous_date").alias("days_since"), F.datediff("next_date", "trading_date").alias("days_until"))


def adjusted(prices: DataFrame, factors: DataFrame) -> DataFrame:
    """Raw prices times their factor; a missing factor is 1 with a reason."""
    out = prices.join(factors.select(*KEYS, "adj_factor"), KEYS, "left")
    f = F.coalesce("adj_factor", F.lit(1.0))
    return out.select(*KEYS, *[(F.col(f"adjusted_{x}") * f).alias(x) for x in ("open", "high", "low", "close")], F.when(F.col("adj_factor").isNull(), "factor_missing").otherwise("none").alias("factor_reason"))


def quality_reasons(df: DataFrame, panel: Panel = PANEL) -> DataFrame:
    """Reasons of each row and whether one of them blocks it."""
    repeated = F.count("*").over(Window.partitionBy(panel.entity, panel.time)) > 1
    reasons = reason_list(
        repeated_key=repeated, non_positive_price=F.least("adjusted_open", "adjusted_high", "adjusted_low", "adjusted_close") <= 0,
        high_below_low=F.col("adjusted_high") < F.col("adjusted_low"), open_outside_range=~F.col("adjusted_open").between(F.col("adjusted_low"), F.col("adjusted_high")),
        flat_day=F.col("adjusted_high") == F.col("adjusted_low"), suspended=F.col("suspension_flag"), small_volume=F.col("volume_shares") < 20,
        vwap_outside_range=~F.col("daily_vwap").between(F.col("adjusted_low") - 0.005, F.col("adjusted_high") + 0.005),
    )
    blocking = F.array(*map(F.lit, ("repeated_key", "non_positive_price", "high_below_low", "suspended")))
    return df.select(panel.entity, panel.time, reasons.alias("reasons")).withColumn("blocking", F.arrays_overlap("reasons", blocking))


def mechanical_gap(df: DataFrame, events: DataFrame, least: float = 0.03, panel: Panel = PANEL) -> DataFrame:
    """Gap of the open to the close before, on the raw scale, for days where it is at least ``least``; is there an event?"""
    before = F.lag("adjusted_close").over(panel.order())
    df = df.withColumn("gap", ratio(F.col("adjusted_open"), before) - 1).where(F.abs("gap") >= least)
    out = df.join(events.select(*KEYS, F.lit(True).alias("_event")).distinct(), KEYS, "left")
    return out.select(*KEYS, "gap", F.col("_event").isNotNull().alias("event_present"))


def standardise(df: DataFrame) -> DataFrame:
    """Lots to shares, thousands to units, tens of thousands of shares to shares, and what follows from them."""
    shares, amount, held = F.col("volume_lots") * 100, F.col("amount_thousand") * 1000, F.col("float_share_10k") * 10_000
    return df.select(
        *KEYS, shares.alias("volume_shares"), amount.alias("amount_yuan"), held.alias("float_shares"),
        F.when(shares > 0, amount / shares).alias("vwap"), F.when(held > 0, shares / held).alias("turnover"), (shares == 0).alias("zero_volume"),
    )


def field_status(df: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Statuses of the standardised fields."""
    inside = F.col("vwap").between(F.col("adjusted_low") - tolerance, F.col("adjusted_high") + tolerance)
    return df.select(
        *KEYS, F.when(F.col("vwap").isNull(), "unknown").when(inside, "pass").otherwise("fail").alias("vwap_status"),
        F.when(F.col("turnover").isNull(), "unknown").when(F.col("turnover") <= 1, "pass").otherwise("fail").alias("turnover_status"),
    )


def field_profile(df: DataFrame, required: list[str]) -> DataFrame:
    """Nulls, distinct values, least and greatest value of every column, in one pass."""
    cells = []
    for c in df.columns:
        cells.append(F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("n_null"), F.countDistinct(c).alias("n_distinct"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("greatest")))
    out = df.agg(F.array(*cells).alias("cells"), F.count("*").alias("n_rows")).select(F.explode("cells").alias("c"), "n_rows").select("c.*", "n_rows")
    bad = F.col("column").isin(required) & (F.col("n_null") > 0)
    return out.withColumn("status", F.when(bad, "required_null").when(F.col("n_distinct") <= 1, "constant").otherwise("ok"))


def coverage(df: DataFrame, key: str) -> DataFrame:
    other = "trading_date" if key == "security_id" else "security_id"
    return df.groupBy(key).agg(F.count("*").alias("n_rows"), F.countDistinct(other).alias("n_other"), F.round(F.avg((~F.col("suspension_flag")).cast("double")), 9).alias("open_share"))


def policy_usage(df: DataFrame, registry: list[str]) -> DataFrame:
    """Rows of every policy of the registry, zero where it was not used."""
    names = df.sparkSession.createDataFrame([(r,) for r in registry], "policy string")
    return names.join(df.groupBy("policy").agg(F.count("*").alias("n")), "policy", "left").select("policy", F.coalesce("n", F.lit(0)).alias("n_rows"))


def window_capacity(df: DataFrame, ns: tuple[int, ...] = (15, 20, 21, 60, 80), panel: Panel = PANEL) -> DataFrame:
    """Rows whose last n days are all open, for each n."""
    ok = (~F.col("suspension_flag")).cast("int")
    df = df.withColumns({f"w{n}": F.sum(ok).over(panel.last(n)) for n in ns})
    return as_metrics(df.agg(*[F.count_if(F.col(f"w{n}") == n).alias(f"n_full_{n}") for n in ns]))


def check_prices(df: DataFrame, universe: DataFrame) -> DataFrame:
    """Violations of the price contract, counted by rule."""
    rules = {
        "non_positive": F.col("adjusted_low") <= 0, "order": (F.col("adjusted_high") < F.col("adjusted_low")), "negative_volume": F.col("volume_shares") < 0,
        "open_outside": ~F.col("adjusted_open").between(F.col("adjusted_low"), F.col("adjusted_high")), "suspended_with_volume": F.col("suspension_flag") & (F.col("volume_shares") > 0),
    }
    found = as_metrics(df.agg(*[F.count_if(c).alias(n) for n, c in rules.items()]))
    alien = df.join(universe.select("security_id"), "security_id", "left_anti").agg(F.count("*").cast("double").alias("value"))
    return found.unionByName(alien.select(F.lit("not_in_universe").alias("metric"), "value"))


def check_continuous(df: DataFrame, absolute: float, relative: float) -> DataFrame:
    """Rows where raw times factor is not the adjusted close within the tolerances."""
    far = F.abs(F.col("close") - F.col("raw") * F.col("factor")) > F.greatest(F.lit(absolute), relative * F.abs("close"))
    return df.where(far)


def densify(expected: DataFrame, observed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Expected index with its rows (nulls where there is none) and the contract's violations.

    A present slot needs exactly one row; other slots none; rows outside of the index are errors too.
    """
    counted = observed.groupBy(*KEYS).agg(F.count("*").alias("n"), F.max("total").alias("total"))
    dense = expected.join(counted, KEYS, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    present = F.col("expected_status") == "present"
    out = dense.select(*KEYS, "observation_sequence", "expected_status", F.when(present & (F.col("n") == 1), F.col("total")).alias("total"))
    problem = F.when(present & (F.col("n") == 0), "missing_row").when(present & (F.col("n") > 1), "repeated_row").when(~present & (F.col("n") > 0), "row_in_empty_slot")
    errors = dense.select(*KEYS, problem.alias("problem")).where("problem is not null")
    alien = counted.join(expected.select(KEYS), KEYS, "left_anti").select(*KEYS, F.lit("outside_index").alias("problem"))
    return out, errors.unionByName(alien)


def merge_evidence(rows: DataFrame, keys: list[str], fields: list[str], priority: str, source: str) -> DataFrame:
    """For each field the value of the first source, by priority, that has one; its source, and whether sources disagree."""
    cols: list[Column] = []
    for f in fields:
        have = F.col(f).isNotNull()
        best = F.min(F.when(have, F.struct(priority, F.col(f).alias("v"), F.col(source).alias("s"))))
        cols += [best["v"].alias(f), best["s"].alias(f"{f}_source"), (F.countDistinct(f) > 1).alias(f"{f}_conflict")]
    return rows.groupBy(*keys).agg(*cols)


def value_intervals(df: DataFrame, value: str, panel: Panel = PANEL) -> DataFrame:
    """A series as intervals of equal value."""
    w = panel.order()
    changed = ~F.lag(value).over(w).eqNullSafe(F.col(value)) | (F.row_number().over(w) == 1)
    df = df.withColumn("_run", F.sum(changed.cast("int")).over(panel.prefix()))
    return df.groupBy(panel.entity, "_run").agg(F.first(value).alias(value), F.min(panel.time).alias("begin"), F.max(panel.time).alias("end"), F.count("*").alias("n_days")).drop("_run")
