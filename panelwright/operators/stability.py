"""Steps, lags and states over years and securities: one table of counts for each, from which all profiles are sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.conventions import EPSILON, ratio, reason_list
from panelwright.operators.selection import quantiles
from panelwright.operators.statistics import with_association
from panelwright.sources.scratch import written

CELLS = ("n11", "n10", "n01", "n00")
#: The value of each measure of a step that says that anchor and target are unrelated (retention has none).
NEUTRAL = {"b_given_a": None, "lift": 1.0, "delta": 0.0}
#: Association warnings: a high lift, a small difference, a high retention, a lift next to one, a rare target.
HIGH_LIFT, LOW_DELTA, HIGH_RETENTION, NEAR_ONE, RARE = 2.0, 0.02, 0.5, 0.05, 0.02
#: A year with a larger share than this rules a profile.
MAJORITY = 0.5


def direction(value: Column, neutral: Column | float = 0.0) -> Column:
    """-1, 0 or 1 about ``neutral``; null where either is null."""
    return F.when(F.abs(value - neutral) <= EPSILON, 0).otherwise(F.signum(value - neutral)).cast("int")


def step_cells(rows: DataFrame) -> DataFrame:
    """(step, year, security_id) with the 2x2 counts of anchor and target, over the days that the step's dimensions are all known."""
    both = {f"n{int(a)}{int(t)}": (F.col("anchor") == F.lit(a)) & (F.col("target") == F.lit(t)) for a in (True, False) for t in (True, False)}
    out = rows.where("step_valid").groupBy("step", F.year("trading_date").alias("year"), "security_id")
    return written(out.agg(*[F.count_if(c).alias(n) for n, c in both.items()]), "step-cells")


def rolled(cells: DataFrame, by: list[str]) -> DataFrame:
    """The cells summed to ``by``, with their measures of association."""
    return with_association(cells.groupBy(*by).agg(*[F.sum(c).alias(c) for c in CELLS]))


def step_years(cells: DataFrame) -> DataFrame:
    """Association of each step and year, and the year's shares of the step's days and of its joint days."""
    days, whole = reduce(Column.__add__, map(F.col, CELLS)), Window.partitionBy("step")  # a row for each year
    shares = {"day_share": ratio(days, F.sum(days).over(whole)), "joint_share": ratio(F.col("n11"), F.sum("n11").over(whole))}
    return rolled(cells, ["step", "year"]).withColumns(shares)


def step_securities(cells: DataFrame) -> DataFrame:
    """For each step and measure: securities, those where it is defined, exact quartiles, shares on either side of the neutral value,
    and whether the median and the pooled value lie on the same side."""
    each = written(rolled(cells, ["step", "security_id"]).select("step", *NEUTRAL), "step-securities")
    long = each.unpivot(["step"], list(NEUTRAL), "measure", "value")
    neutral = F.create_map(*[F.lit(x) for pair in NEUTRAL.items() for x in pair])[F.col("measure")]
    side = direction(F.col("value"), neutral)
    sums = long.groupBy("step", "measure").agg(
        F.count("*").alias("n_securities"), F.count("value").alias("n_defined"), F.avg((side > 0).cast("double")).alias("above_share"), F.avg((side < 0).cast("double")).alias("below_share")
    )
    pooled = rolled(cells, ["step"]).unpivot(["step"], list(NEUTRAL), "measure", "pooled")
    out = sums.join(quantiles(long, ["step", "measure"], "value", {"q25": 0.25, "median": 0.5, "q75": 0.75}).drop("n"), ["step", "measure"], "left").join(pooled, ["step", "measure"])
    return out.withColumn("same_side", direction(F.col("pooled"), neutral) == direction(F.col("median"), neutral))


def step_profile(cells: DataFrame) -> DataFrame:
    """Pooled association of each step, its years by direction, the class of its direction, and warnings."""
    years = step_years(cells).groupBy("step").agg(
        F.count("*").alias("n_years"), F.count_if(direction(F.col("delta")) > 0).alias("n_years_up"), F.count_if(direction(F.col("delta")) < 0).alias("n_years_down"),
        F.count_if(F.col("delta").isNull()).alias("n_years_undefined"), F.max("day_share").alias("top_year_share"), F.median("delta").alias("median_year_delta"),  # a row for each year
    )
    out = rolled(cells, ["step"]).join(years, "step")
    up, lift = direction(F.col("delta")), direction(F.col("lift"), 1.0)
    kind = F.when(up.isNull() | lift.isNull(), "undefined").when((up == 0) & (lift == 0), "neutral").when((up > 0) & (lift > 0), "positive").when((up < 0) & (lift < 0), "negative").otherwise("mixed")
    warnings = reason_list(
        high_lift_low_delta=(F.col("lift") >= HIGH_LIFT) & (F.abs("delta") < LOW_DELTA),
        high_retention_lift_near_one=(F.col("b_given_a") >= HIGH_RETENTION) & (F.abs(F.col("lift") - 1) < NEAR_ONE),
        rare_target=(F.col("base_rate") < RARE) & (F.col("lift") >= HIGH_LIFT),
        years_disagree=(F.col("n_years_up") > 0) & (F.col("n_years_down") > 0),
        one_year_rules=F.col("top_year_share") > MAJORITY,
    )
    return out.withColumns({"direction": kind, "median_agrees": up == direction(F.col("median_year_delta")), "warnings": F.array_join(warnings, ",")})


def steps_without_year(cells: DataFrame) -> DataFrame:
    """Each step recomputed without each of its years: measures, relative changes, and whether a direction turns."""
    whole = Window.partitionBy("step")  # a row for each year
    years = cells.groupBy("step", "year").agg(*[F.sum(c).alias(f"own_{c}") for c in CELLS])
    years = years.withColumns({f"all_{c}": F.sum(f"own_{c}").over(whole) for c in CELLS})
    pooled = with_association(years.select("step", "year", *[F.col(f"all_{c}").alias(c) for c in CELLS])).select("step", "year", F.struct(*CELLS, "lift", "delta").alias("p"))
    rest = with_association(years.select("step", "year", *[(F.col(f"all_{c}") - F.col(f"own_{c}")).alias(c) for c in CELLS])).join(pooled, ["step", "year"])
    total = lambda at: reduce(Column.__add__, [F.col(f"{at}{c}") for c in CELLS])
    out = rest.withColumns(
        {
            "days_change": ratio(total("") - total("p."), total("p.")), "delta_change": ratio(F.col("delta") - F.col("p.delta"), F.abs("p.delta")),
            "removed_day_share": ratio(total("p.") - total(""), total("p.")), "removed_joint_share": ratio(F.col("p.n11") - F.col("n11"), F.col("p.n11")),
            "delta_flips": ~direction(F.col("delta")).eqNullSafe(direction(F.col("p.delta"))), "lift_flips": ~direction(F.col("lift"), 1.0).eqNullSafe(direction(F.col("p.lift"), 1.0)),
        }
    )
    return out.select("step", "year", *CELLS, F.col("b_given_a").alias("retention"), "lift", "delta", "days_change", "delta_change", "removed_day_share", "removed_joint_share", "delta_flips", "lift_flips")


def state_years(rows: DataFrame) -> DataFrame:
    """Over (state, year, n_known, n_true): concentration of the true days over the years and spread of their yearly coverage.

    Null shares for a state that is never true; the peak is its earliest greatest year.
    """
    own = Window.partitionBy("state")  # a row for each year
    rows = rows.withColumns({"_share": ratio(F.col("n_true"), F.sum("n_true").over(own)), "_coverage": ratio(F.col("n_true"), F.col("n_known"))})
    rows = rows.withColumn("_place", F.row_number().over(own.orderBy(F.desc("n_true"), "year")))
    hhi = F.sum(F.col("_share") * F.col("_share"))
    out = rows.groupBy("state").agg(
        F.count("*").alias("n_years"), F.count_if(F.col("n_true") > 0).alias("n_years_true"), F.sum("n_true").alias("n_true"), hhi.alias("hhi"), ratio(F.lit(1.0), hhi).alias("effective_years"),
        F.sum(F.when(F.col("_place") <= 1, F.col("_share"))).alias("top1"), F.sum(F.when(F.col("_place") <= 2, F.col("_share"))).alias("top2"), F.min(F.when((F.col("_place") == 1) & (F.col("n_true") > 0), F.col("year"))).alias("peak_year"),
        F.min("_coverage").alias("least_coverage"), F.percentile("_coverage", 0.25).alias("coverage_q25"), F.percentile("_coverage", 0.5).alias("coverage_median"), F.percentile("_coverage", 0.75).alias("coverage_q75"), F.max("_coverage").alias("greatest_coverage"),
    )
    status = F.when(F.col("n_true") == 0, "never_true").when(F.col("top1") > MAJORITY, "one_year_rules").otherwise("spread")
    return out.withColumns({"coverage_iqr": F.col("coverage_q75") - F.col("coverage_q25"), "status": status})


def states_without_year(rows: DataFrame) -> DataFrame:
    """Each state without each of its years: true days, coverage, and the concentration of what remains."""
    own = Window.partitionBy("state")
    true, known, squares = (F.sum(c).over(own) for c in (F.col("n_true"), F.col("n_known"), F.col("n_true") * F.col("n_true")))
    rest, known_rest = true - F.col("n_true"), known - F.col("n_known")
    out = {
        "n_true_without": rest, "coverage_without": ratio(rest, known_rest), "true_change": ratio(rest - true, true), "coverage_change": ratio(ratio(rest, known_rest) - ratio(true, known), ratio(true, known)),
        "hhi_without": ratio(squares - F.col("n_true") * F.col("n_true"), rest * rest), "removed_day_share": ratio(F.col("n_known"), known), "removed_true_share": ratio(F.col("n_true"), true),
    }
    return rows.select("state", "year", *[c.alias(n) for n, c in out.items()])


def transition(now: Column, before: Column) -> Column:
    """What a day does to a state: null days are invalid, days after a null or absent one are other."""
    kind = F.when(now & ~before, "onset").when(~now & ~before, "stay_out").when(now & before, "continuing").when(~now & before, "exit")
    return F.when(now.isNull(), "invalid").otherwise(F.coalesce(kind, F.lit("other")))


def lag_cells(wide: DataFrame, anchor: str, targets: list[str], ks: list[int]) -> DataFrame:
    """(path, k, year, security_id, kind, now): days, those with a row k later, with a known target there, and with a true one.

    ``kind`` is the anchor's transition, ``now`` the target's own state on the anchor's day. One sort of the panel and one
    aggregation; profiles, baselines and summaries are sums of these rows.
    """
    w = Window.partitionBy("security_id").orderBy("trading_date")
    cells = [
        F.struct(F.lit(f"{anchor}_to_{t}").alias("path"), F.lit(k).alias("k"), F.col(t).alias("now"), F.lead("trading_date", k).over(w).isNotNull().alias("ahead"), F.lead(t, k).over(w).alias("later"))
        for t in targets for k in ks
    ]
    rows = wide.select("security_id", F.year("trading_date").alias("year"), transition(F.col(anchor), F.lag(anchor).over(w)).alias("kind"), F.array(*cells).alias("cells"))
    rows = rows.select("security_id", "year", "kind", F.explode("cells").alias("c")).select("security_id", "year", "kind", "c.*")
    out = rows.groupBy("path", "k", "year", "security_id", "kind", "now").agg(F.count("*").alias("n"), F.count_if("ahead").alias("n_ahead"), F.count("later").alias("n_valid"), F.count_if("later").alias("n_true"))
    return written(out, "lag-cells")


def _of(kind: str, count: str, where: Column | None = None) -> Column:
    cond = F.col("kind") == kind
    return F.coalesce(F.sum(F.when(cond if where is None else cond & where, F.col(count))), F.lit(0))


def lag_effects(cells: DataFrame, by: list[str] = [], least: int = 1) -> DataFrame:
    """Onsets against stay-outs at each path and lag: all counts, both probabilities, difference, relative lift, status."""
    counts = {f"{side}_{name}": _of(kind, c) for side, kind in (("onset", "onset"), ("control", "stay_out")) for name, c in (("n", "n"), ("ahead", "n_ahead"), ("valid", "n_valid"), ("true", "n_true"))}
    out = cells.groupBy("path", "k", *by).agg(*[c.alias(n) for n, c in counts.items()])
    out = out.withColumns({f"{s}_{name}": F.col(f"{s}_{a}") - F.col(f"{s}_{b}") for s in ("onset", "control") for name, a, b in (("censored", "n", "ahead"), ("invalid", "ahead", "valid"), ("false", "valid", "true"))})
    a, b = ratio(F.col("onset_true"), F.col("onset_valid")), ratio(F.col("control_true"), F.col("control_valid"))
    few = (F.col("onset_valid") < least) | (F.col("control_valid") < least)
    status = F.when(few, "insufficient").when(b == 0, "baseline_zero").otherwise("defined")
    return out.withColumns({"p_onset": a, "p_control": b, "difference": a - b, "relative_lift": ratio(a, b), "status": status})


def lag_baselines(cells: DataFrame) -> DataFrame:
    """The effect of an onset against three further baselines: all days, stay-outs with the target's states in the onsets'
    proportions, and stay-outs of the same security and year; with what each covers and whether a sign turns."""
    pooled = lag_effects(cells)
    every = cells.groupBy("path", "k").agg(ratio(F.sum("n_true"), F.sum("n_valid")).alias("p_all"))
    known = F.col("now").isNotNull()
    mix = cells.where(known).groupBy("path", "k", "now").agg(_of("onset", "n_valid").alias("o"), _of("onset", "n_true").alias("t"), ratio(_of("stay_out", "n_true"), _of("stay_out", "n_valid")).alias("c"))
    weight = lambda keep: F.sum(F.when(keep, F.col("o")))
    mix = mix.groupBy("path", "k").agg(F.sum("o").alias("matched_onsets"), ratio(F.sum("t"), F.sum("o")).alias("p_matched"), F.when(F.count_if((F.col("o") > 0) & F.col("c").isNull()) == 0, ratio(F.sum(F.col("o") * F.col("c")), weight(F.col("c").isNotNull()))).alias("p_status"))
    strata = cells.groupBy("path", "k", "year", "security_id").agg(_of("onset", "n_valid").alias("o"), ratio(_of("stay_out", "n_true"), _of("stay_out", "n_valid")).alias("c")).where("o > 0")
    met = F.col("c").isNotNull()
    strata = strata.groupBy("path", "k").agg(
        ratio(F.sum(F.col("o") * F.col("c")), weight(met)).alias("p_strata"), F.coalesce(weight(met), F.lit(0)).alias("strata_onsets"), F.count_if(~met).alias("unmatched_strata"), ratio(F.coalesce(weight(met), F.lit(0)), F.sum("o")).alias("strata_coverage")
    )
    out = pooled.select("path", "k", "onset_valid", "p_onset", "p_control", "difference").join(every, ["path", "k"]).join(mix, ["path", "k"], "left").join(strata, ["path", "k"], "left")
    out = out.withColumns({"over_all": F.col("p_onset") - F.col("p_all"), "over_status": F.col("p_matched") - F.col("p_status"), "over_strata": F.col("p_onset") - F.col("p_strata"), "status_coverage": ratio(F.col("matched_onsets"), F.col("onset_valid"))})
    turns = [F.coalesce(direction(F.col("difference")) != direction(F.col(c)), F.lit(False)) for c in ("over_status", "over_strata")]
    return out.withColumn("sign_conflict", turns[0] | turns[1])


def lag_securities(cells: DataFrame) -> DataFrame:
    """Securities with an onset, the exact median of their differences, their signs, and whether it agrees with the pooled one."""
    each = written(lag_effects(cells, ["security_id"]).select("path", "k", "onset_n", "difference"), "lag-securities")
    side = direction(F.col("difference"))
    sums = each.groupBy("path", "k").agg(F.count_if(F.col("onset_n") > 0).alias("n_securities"), *[F.count_if(side == v).alias(n) for v, n in ((1, "n_positive"), (-1, "n_negative"), (0, "n_zero"))])
    out = sums.join(quantiles(each, ["path", "k"], "difference", {"median": 0.5}).drop("n"), ["path", "k"], "left").join(lag_effects(cells).select("path", "k", F.col("difference").alias("pooled")), ["path", "k"])
    return out.withColumn("same_side", direction(F.col("median")) == direction(F.col("pooled")))


def transition_crosstab(levels: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(lower, higher, lower_class, higher_class, n): how the days' transitions at one level stand to those at the next.

    ``levels`` has a three-valued column for each level, so both sides come from one sort and no row meets another.
    """
    w = Window.partitionBy("security_id").orderBy("trading_date")
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    kinds = levels.select(*[transition(F.col(c), F.lag(c).over(w)).alias(c) for c in names])
    cells = [F.struct(F.lit(a).alias("lower"), F.lit(b).alias("higher"), F.col(a).alias("lower_class"), F.col(b).alias("higher_class")) for a, b in pairs]
    return kinds.select(F.explode(F.array(*cells)).alias("c")).groupBy("c.lower", "c.higher", "c.lower_class", "c.higher_class").agg(F.count("*").alias("n"))
