"""Checks, records and geometry over panels, intervals and zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.conventions import PANEL, Panel, ratio, reason_list, worst_status
from panelwright.operators.states import weak_state

KEYS = ["security_id", "trading_date"]


def counted(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(metric, value): how many rows break each rule; a rule that is null for a row is not broken."""
    row = df.agg(*[F.count_if(c).cast("double").alias(n) for n, c in rules.items()])
    return row.unpivot([], row.columns, "metric", "value")


def align_members(members: DataFrame, contract: dict[str, str], key: list[str]) -> DataFrame:
    """Members with the contract's constants and whether their key is unique (null parts of a key count as empty)."""
    out = members.withColumns({n: F.lit(v) for n, v in contract.items()})
    whole = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])
    return out.withColumns({"alignment_key": whole, "unique_key": F.count("*").over(Window.partitionBy(whole)) == 1})


def diagnose_limits(gaps: DataFrame, suspended: DataFrame, daily: DataFrame) -> DataFrame:
    """Why a price limit is missing: suspended, no daily row either, or a daily row without limits."""
    rows = gaps.where("gap_type = 'limit'").select(*KEYS)
    rows = rows.join(suspended.select(*KEYS, F.lit(True).alias("_off")).distinct(), KEYS, "left").join(daily.select(*KEYS, F.lit(True).alias("_day")), KEYS, "left")
    cause = F.when(F.col("_off"), "suspended").when(F.col("_day").isNull(), "daily_missing_too").otherwise("limit_source_missing")
    return rows.select(*KEYS, cause.alias("cause"))


def repair_candidates(intervals: DataFrame, endpoints: dict[str, str]) -> DataFrame:
    """Gap intervals with the endpoint that can repair them and a priority by length (1: over 20 days, 2: over 5, else 3)."""
    names = F.create_map(*[F.lit(x) for pair in endpoints.items() for x in pair])
    priority = F.when(F.col("n_days") > 20, 1).when(F.col("n_days") > 5, 2).otherwise(3)
    return intervals.withColumns({"endpoint": F.coalesce(names[F.col("gap_type")], F.lit("manual")), "priority": priority})


def repair_rollup(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Candidates of each group: how many, over how many days, the most urgent priority and its number."""
    rows = candidates.groupBy(*by).agg(F.count("*").alias("n_intervals"), F.sum("n_days").alias("n_days"), F.min("priority").alias("first_priority"), F.count_if(F.col("priority") == 1).alias("n_urgent"))
    return rows.select(*by, "n_intervals", "n_days", "first_priority", "n_urgent")


def common_wide(rows: DataFrame, indicators: list[str]) -> DataFrame:
    """Days on which every indicator, a struct of value and validity_status beside the others, has a valid value; a column for each."""
    wide = rows.select(*KEYS, *[F.when(F.col(f"{n}.validity_status") == "valid", F.col(f"{n}.value")).alias(n) for n in indicators])
    return wide.dropna(subset=indicators)


def turnover_fields(df: DataFrame) -> DataFrame:
    """Turnover on float and on free shares, both in per cent; null where the shares are not positive."""
    share = lambda c: F.when(F.col(c) > 0, ratio(F.col("volume_shares"), F.col(c)))
    return df.select(*KEYS, share("float_shares").alias("turnover_float"), share("free_shares").alias("turnover_free"), (share("float_shares") * 100).alias("turnover_float_pct"), (share("free_shares") * 100).alias("turnover_free_pct"))


def field_matrix(df: DataFrame, needs: dict[str, list[str]]) -> DataFrame:
    """For each indicator: how many of the rows have all fields that it needs, and whether it is ready (a lacking column: none)."""
    cells = {}
    for name, fields in needs.items():
        there = F.lit(all(f in df.columns for f in fields))
        for f in fields:
            if f in df.columns:
                there = there & F.col(f).isNotNull()
        cells[name] = F.count_if(there)
    row = df.agg(F.count("*").alias("n_rows"), *[c.alias(n) for n, c in cells.items()])
    out = row.unpivot(["n_rows"], list(cells), "indicator", "n_available")
    return out.withColumn("readiness", F.when(F.col("n_available") == F.col("n_rows"), "ready").when(F.col("n_available") > 0, "partial").otherwise("unavailable"))


def schema_catalog(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Columns of a table in order with their type, role and the number of their values."""
    row = df.agg(*[F.count(c).alias(c) for c in df.columns])
    out = row.unpivot([], row.columns, "column", "n_values")
    lookup = lambda d, other: F.coalesce(F.create_map(*[F.lit(x) for p in d.items() for x in p])[F.col("column")], F.lit(other))
    place = {c: str(i) for i, c in enumerate(df.columns)}
    return out.select("column", "n_values", lookup(dict(df.dtypes), "").alias("type"), lookup(roles, "measure").alias("role"), lookup(place, "-1").cast("long").alias("place"))


def price_reasons(df: DataFrame) -> DataFrame:
    """Reasons of a price row from its statuses, and the worst status that they stand for."""
    price = F.least("adjusted_open", "adjusted_high", "adjusted_low", "adjusted_close")
    reasons = {
        "listing_pause": (F.col("trading_status") == "listing_pause", 2), "suspended": (F.col("trading_status") == "suspended", 2),
        "trading_status_unknown": (F.col("trading_status") == "unknown", 1), "daily_missing": (F.col("daily_status") == "missing", 1),
        "factor_missing": (F.col("factor_status") == "missing", 1), "non_positive_price": (price <= 0, 3), "high_below_low": (F.col("adjusted_high") < F.col("adjusted_low"), 3),
    }
    rank = F.greatest(F.lit(0), *[F.when(F.coalesce(c, F.lit(False)), n).otherwise(0) for c, n in reasons.values()])
    return df.select(*KEYS, reason_list(**{n: c for n, (c, _) in reasons.items()}).alias("reasons"), worst_status(rank).alias("validity_status"))


def readiness(df: DataFrame, kinds: dict[str, tuple[int, Column]], panel: Panel = PANEL) -> DataFrame:
    """For each kind (window length, condition that a row must meet): status of the window that ends at each row.

    A window that is too short or has rows without an answer is unknown; one with a suspension asks for a diagnosis; one with
    a row that fails is blocked.
    """
    cols = {}
    for name, (n, good) in kinds.items():
        w = panel.last(n)
        short, off = F.count(F.lit(1)).over(w) < n, F.max(F.coalesce("suspension_flag", F.lit(False))).over(w)
        failed, open_ = F.max(F.coalesce(~good, F.lit(False))).over(w), F.max(good.isNull()).over(w)
        cols[name] = F.when(short, "unknown").when(failed, "blocked").when(off, "diagnostic_required").when(open_, "unknown").otherwise("valid")
    return df.select(panel.entity, panel.time, *[c.alias(n) for n, c in cols.items()])


def normalise_intervals(found: DataFrame, names: dict[str, str]) -> DataFrame:
    """Intervals with the reason's common name and the rules of geometry that they break."""
    reason = F.coalesce(F.create_map(*[F.lit(x) for p in names.items() for x in p])[F.col("termination_reason")], F.lit("other"))
    broken = reason_list(
        open_with_end=F.col("is_open") & F.col("interval_end_date").isNotNull(), closed_without_end=~F.col("is_open") & F.col("interval_end_date").isNull(),
        confirmed_before_start=F.col("confirmation_date") < F.col("raw_start_date"), end_before_confirmation=F.col("interval_end_date") < F.col("confirmation_date"),
        longer_than_raw=F.col("duration_confirmed_days") > F.col("duration_raw_days"),
    )
    return found.withColumns({"end_reason": reason, "violations": F.array_join(broken, ",")})


def parent_of(child: DataFrame, parent: DataFrame, key: str = "security_id") -> DataFrame:
    """Each child interval with the parent interval of its entity that contains it and starts last.

    Parents are dealt to the months that they touch; a child meets those of its own first month.
    """
    month = lambda c: F.year(c) * 12 + F.month(c)
    p = parent.select(key, F.col("raw_start_date").alias("p_start"), F.col("last_observed_date").alias("p_end"), F.col("duration_raw_days").alias("p_days"), F.explode(F.sequence(month("raw_start_date"), month("last_observed_date"))).alias("_m"))
    c = child.select(key, "interval_no", "raw_start_date", "last_observed_date", "duration_raw_days", month("raw_start_date").alias("_m"))
    hit = c.join(p, [key, "_m"]).where("p_start <= raw_start_date and p_end >= last_observed_date")
    best = hit.groupBy(key, "interval_no").agg(F.max(F.struct("p_start", "p_end", "p_days")).alias("p"), F.count("*").alias("n_parents"))
    out = c.drop("_m").join(best, [key, "interval_no"], "left")
    return out.select(key, "interval_no", "raw_start_date", "p.p_start", F.coalesce("n_parents", F.lit(0)).alias("n_parents"), F.datediff("raw_start_date", "p.p_start").alias("start_delay"), ratio(F.col("duration_raw_days"), F.col("p.p_days")).alias("duration_share"))


def conservation(daily: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """Confirmed days of the daily table against those of its intervals; equal where nothing is lost."""
    a = daily.groupBy(*by).agg(F.count_if("confirmed").alias("n_daily"), F.countDistinct(F.when(F.col("confirmed"), F.col("security_id"))).alias("n_entities"))
    b = found.groupBy(*by).agg(F.sum("duration_confirmed_days").alias("n_interval_days"), F.count("*").alias("n_intervals"))
    out = a.join(b, by, "left").fillna(0, ["n_interval_days", "n_intervals"])
    return out.withColumn("difference", F.col("n_daily") - F.col("n_interval_days"))


def compare_to(profile: DataFrame, key: str, baseline, measure: str) -> DataFrame:
    """Rows of a profile against its baseline row: difference, ratio and class (same within 1%)."""
    base = profile.where(F.col(key) == baseline).agg(F.first(measure).alias("_base"))  # one row
    out = profile.crossJoin(F.broadcast(base))
    share = ratio(F.col(measure), F.col("_base"))
    kind = F.when(F.col(key) == baseline, "baseline").when(share.isNull(), "undefined").when(F.abs(share - 1) <= 0.01, "same").when(share > 1, "more").otherwise("less")
    return out.select(key, measure, (F.col(measure) - F.col("_base")).alias("difference"), share.alias("ratio"), kind.alias("class"))


def calendar_rows(daily: DataFrame, state: str, period: Column) -> DataFrame:
    """True days of each period with their share of all, the number of entities, and whether it is the peak."""
    rows = daily.groupBy(period.alias("period")).agg(F.count_if(state).alias("n_true"), F.count(state).alias("n_known"), F.countDistinct(F.when(F.col(state), F.col("security_id"))).alias("n_entities"))
    total = rows.agg(F.sum("n_true").alias("_all"), F.max("n_true").alias("_top"))  # one row
    out = rows.crossJoin(F.broadcast(total))
    return out.select("period", "n_true", "n_known", "n_entities", ratio(F.col("n_true"), F.col("_all")).alias("share"), (F.col("n_true") == F.col("_top")).alias("peak"))


def interval_periods(found: DataFrame, grid: DataFrame, period: Column) -> DataFrame:
    """Intervals by the period of their confirmation on a full grid of periods, with those that cross into another."""
    rows = found.withColumn("period", period)
    rows = rows.groupBy("period").agg(F.count("*").alias("n_intervals"), F.sum("duration_confirmed_days").alias("confirmed_days"), F.percentile("duration_confirmed_days", 0.5).alias("median_days"), F.count_if(F.year("raw_start_date") != F.year("last_observed_date")).alias("n_cross_year"))
    return grid.join(rows, "period", "left").fillna(0, ["n_intervals", "confirmed_days", "n_cross_year"])


def survival(targets: DataFrame) -> DataFrame:
    """For each lag: onsets with a whole horizon, runs that survive to it, active there, and active again after a false day."""
    on = (F.col("anchor") == "onset") & F.col("complete")
    active, survived = on & F.coalesce("target", F.lit(False)), on & F.col("survived")
    out = targets.groupBy("k").agg(F.count_if(on).alias("n_complete"), F.count_if(survived).alias("n_survived"), F.count_if(active).alias("n_active"), F.count_if(active & ~F.col("survived")).alias("n_reentered"))
    return out.withColumn("survival_rate", ratio(F.col("n_survived"), F.col("n_complete")))


def anchor_status(targets: DataFrame) -> DataFrame:
    """Anchors by lag, kind and what is known of their target."""
    status = F.when(~F.col("complete"), "right_censored").when(F.col("target").isNull(), "unknown").when(F.col("target"), "true").otherwise("false")
    return targets.groupBy("k", "anchor", status.alias("target_status")).agg(F.count("*").alias("n_anchors"))


def baseline_sensitivity(targets: DataFrame, state_rate: DataFrame, by: str) -> DataFrame:
    """Onset rate at each lag against the unconditional rate and a rate standardised to the onsets' strata."""
    on = targets.where((F.col("anchor") == "onset") & F.col("target").isNotNull())
    joined = on.join(state_rate.select(by, "rate"), by, "left")
    whole = state_rate.agg(ratio(F.sum("n_true"), F.sum("n_known")).alias("unconditional"))  # one row
    out = joined.groupBy("k").agg(F.avg(F.col("target").cast("double")).alias("onset_rate"), F.avg("rate").alias("standardised"), F.count("rate").alias("n_covered"))
    out = out.crossJoin(F.broadcast(whole))
    a, b = F.col("onset_rate") - F.col("unconditional"), F.col("onset_rate") - F.col("standardised")
    return out.withColumns({"over_unconditional": a, "over_standardised": b, "sign_conflict": F.sign(a) * F.sign(b) < 0})


def nested_keys(states: DataFrame, keys: list[str]) -> DataFrame:
    """Keys active at one q but not at the next larger one, by q: none where states are nested."""
    order = Window.partitionBy(*keys).orderBy("q")
    out = states.withColumn("_next", F.lead("active").over(order)).where("_next is not null or active is not null")
    return out.groupBy("q").agg(F.count_if("active").alias("n_active"), F.count_if(F.col("active") & (F.col("_next") == F.lit(False))).alias("n_violations"))


def dimension_flags(wide: DataFrame, dimensions: list[str], q: float) -> DataFrame:
    """One row a day with valid, active and raw (null kept) for each dimension, from the structs of their scores."""
    wide = wide.withColumns({f"_raw_{d}": weak_state(F.lit(q), of=f"{d}.") for d in dimensions})
    cols = []
    for d in dimensions:
        valid, raw = F.coalesce(F.col(f"{d}.validity_status") == "valid", F.lit(False)), F.col(f"_raw_{d}")
        cols += [valid.alias(f"valid_{d}"), F.coalesce(raw, F.lit(False)).alias(f"active_{d}"), raw.alias(f"raw_{d}")]
    return wide.select(*KEYS, *cols)


def layer_steps(wide: DataFrame, dimensions: list[str]) -> DataFrame:
    """For each step of the chain: days on which it and all before it are known (anchor) and all dimensions are, true anchors and targets."""
    known, rows = F.lit(True), []
    whole = F.lit(True)
    for d in dimensions:
        whole = whole & F.col(f"raw_{d}").isNotNull()
    held = F.lit(True)
    cols = []
    for i, d in enumerate(dimensions):
        known = known & F.col(f"raw_{d}").isNotNull()
        if i:
            anchor = held
            cols.append(F.struct(F.lit(f"{''.join(dimensions[:i])}->{d}").alias("step"), F.count_if(known).alias("n_step"), F.count_if(whole).alias("n_all"), F.count_if(known & anchor).alias("n_anchor"), F.count_if(known & anchor & F.col(f"active_{d}")).alias("n_target"), F.count_if(known & F.col(f"active_{d}")).alias("n_base")))
        held = held & F.col(f"active_{d}")
    out = wide.agg(F.array(*cols).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    a, b = ratio(F.col("n_target"), F.col("n_anchor")), ratio(F.col("n_base"), F.col("n_step"))
    direction = F.when(a.isNull() | b.isNull(), "undefined").when(F.abs(a - b) <= 0.01, "flat").when(a > b, "up").otherwise("down")
    warnings = F.array_join(reason_list(small_anchor=F.col("n_anchor") < 30, small_target=F.col("n_target") < 10), ",")
    return out.withColumns({"retention": a, "base_rate": b, "direction": direction, "warnings": warnings})


def availability(rows: DataFrame, by: str) -> DataFrame:
    """Rows of each group by status, with the share that is valid and the most frequent first reason."""
    reasons = rows.groupBy(by, F.element_at("reason_codes", 1).alias("reason")).agg(F.count("*").alias("n"))
    top = reasons.groupBy(by).agg(F.max(F.struct("n", "reason"))["reason"].alias("top_reason"))
    out = rows.groupBy(by).agg(F.count("*").alias("n_rows"), *[F.count_if(F.col("validity_status") == s).alias(f"n_{s}") for s in ("valid", "unknown", "diagnostic_required", "blocked")])
    return out.join(top, by).withColumn("valid_share", ratio(F.col("n_valid"), F.col("n_rows")))


def lineage(assigned: DataFrame, zones: DataFrame, keys: list[str]) -> DataFrame:
    """Each component with its zone, its ordinal there, and whether the zone is censored."""
    order = Window.partitionBy(*keys, "zone").orderBy("first_seq")
    mine = assigned.where("qualified").withColumn("component_no", F.row_number().over(order))
    return mine.join(zones.select(*keys, "zone", "status"), [*keys, "zone"]).select(*keys, "run", "zone", "component_no", "start_date", "end_date", "end_reason", (F.col("status") == "RIGHT_CENSORED").alias("censored"))


def risk_flags(daily: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Days at risk of a state (known, not in one the day before) and of a qualified event (no zone on the day before)."""
    w = Window.partitionBy(*keys).orderBy("trading_date")
    rows = daily.join(members.select(*keys, "trading_date", F.lit(True).alias("_in")).distinct(), [*keys, "trading_date"], "left").withColumn("in_zone", F.coalesce("_in", F.lit(False)))
    state = ~F.col("hard_break") & ~F.coalesce(F.lag("raw_state").over(w), F.lit(False))
    event = ~F.col("hard_break") & ~F.coalesce(F.lag("in_zone").over(w), F.lit(False))
    return rows.select(*keys, "trading_date", "in_zone", state.alias("state_risk"), event.alias("event_risk"))


def ordered_digest(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """For each part: SHA-256 over the row digests in key order. Parts are bounded by the choice of ``by``."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in df.columns])
    rows = df.select(by, F.struct(*order, F.sha2(text, 256).alias("digest")).alias("r"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["digest"]), "")
    return rows.groupBy(by).agg(F.count("*").alias("n_rows"), F.sha2(joined, 256).alias("digest"))
