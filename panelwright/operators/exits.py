"""How confirmed intervals of a chain of requests, from strict to loose, lie in each other and end.

A chain's requests differ in their thresholds alone, so that a stricter one's confirmed days are days of
the looser one. ``level`` counts from 1, the strictest.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.conventions import EPSILON, finite, ratio
from panelwright.operators.selection import quantiles
from panelwright.operators.states import WEAK_DELTA

TIME = "trading_date"
IDENTITIES = ("CORE", "INNER", "ANCHOR", "SHELL")


def interval_days(daily: DataFrame, levels: dict[str, int]) -> DataFrame:
    """Confirmed days of every request with the number of their interval and the day's place in the entity's sequence."""
    w = Window.partitionBy("request_id", "security_id").orderBy(TIME)
    seen = F.sum(F.col("confirmation_event").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    level = F.create_map(*[F.lit(x) for pair in levels.items() for x in pair])[F.col("request_id")]
    days = daily.withColumns({"interval_no": seen.cast("long"), "observation_sequence": (F.row_number().over(w) - 1).cast("long"), "level": level})
    return days.where("confirmed").select("request_id", "level", "security_id", TIME, "observation_sequence", "interval_no")


def map_parent(children: DataFrame, parents: DataFrame, keys: list[str], child: str, parent: str, day: str) -> DataFrame:
    """The parent that holds every day of a child, by relational division: shared days are counted for each pair
    that shares one, and a pair stands where they are as many as the child has.

    Day sets need not be contiguous and parents may overlap. A row for each child: ``n_days``, ``n_parents``
    and the parent where there is exactly one. Only pairs with a day in common are ever formed.
    """
    sizes = children.groupBy(*keys, child).agg(F.count_distinct(day).alias("n_days"))
    shared = children.select(*keys, child, day).distinct().join(parents.select(*keys, parent, day).distinct(), [*keys, day]).groupBy(*keys, child, parent).agg(F.count("*").alias("_shared"))
    whole = shared.join(sizes, [*keys, child]).where(F.col("_shared") == F.col("n_days")).groupBy(*keys, child).agg(F.count("*").alias("n_parents"), F.min(parent).alias(parent))
    out = sizes.join(whole, [*keys, child], "left").withColumn("n_parents", F.coalesce("n_parents", F.lit(0).cast("long")))
    return out.withColumn(parent, F.when(F.col("n_parents") == 1, F.col(parent))).withColumn(
        "mapping", F.when(F.col("n_parents") == 1, "unique").when(F.col("n_parents") == 0, "none").otherwise("ambiguous")
    )


def chain_parents(days: DataFrame) -> DataFrame:
    """``map_parent`` for every level and the next looser one, in one join."""
    child = days.select("level", "security_id", "observation_sequence", F.col("interval_no").alias("child_no"))
    parent = days.select((F.col("level") - 1).alias("level"), "security_id", "observation_sequence", F.col("interval_no").alias("parent_no"))
    loosest = days.agg(F.max("level").alias("_top"))
    child = child.crossJoin(F.broadcast(loosest)).where("level < _top").drop("_top")  # one row
    return map_parent(child, parent, ["level", "security_id"], "child_no", "parent_no", "observation_sequence")


def day_levels(days: DataFrame, levels: int) -> DataFrame:
    """One row for each day of the loosest request: the number of the interval of every level that holds it, and its identity,
    the strictest level there is."""
    numbers = [F.max(F.when(F.col("level") == k, F.col("interval_no"))).alias(f"no_{k}") for k in range(1, levels + 1)]
    wide = days.groupBy("security_id", "observation_sequence").agg(F.min("level").alias("_least"), *numbers)
    label = F.element_at(F.array(*map(F.lit, IDENTITIES[:1] + IDENTITIES[len(IDENTITIES) - levels + 1 :])), F.col("_least"))
    return wide.where(f"no_{levels} is not null").withColumn("identity", label).drop("_least")


def parent_structure(wide: DataFrame, levels: int) -> DataFrame:
    """A row for each interval of the loosest request: days of every level in it, shell days (of the loosest alone), children."""
    top, anchor = f"no_{levels}", f"no_{levels - 1}"
    return wide.groupBy("security_id", F.col(top).alias("parent_no")).agg(
        F.count("*").alias("parent_days"), *[F.count(f"no_{k}").alias(f"days_{k}") for k in range(1, levels)],
        F.count_if(F.col("identity") == IDENTITIES[-1]).alias("shell_days"), F.count_distinct(anchor).alias("n_children"),
    ).withColumns({"fragmented": F.col("n_children") > 1, "equals_parent": F.col(f"days_{levels - 1}") == F.col("parent_days")})


def child_structure(wide: DataFrame, levels: int) -> DataFrame:
    """A row for each interval of the request before the loosest: its days, the shell days right before and after it,
    its own children and its siblings.

    Shell days of a parent are numbered as islands; the island's length is what the child's first and last
    day see beside them.
    """
    top, anchor = f"no_{levels}", f"no_{levels - 1}"
    order = Window.partitionBy("security_id", top).orderBy("observation_sequence")
    shell = F.col(anchor).isNull()
    rows = wide.withColumn("_shell", shell).withColumn("_new", (~F.coalesce(F.lag("_shell").over(order), F.lit(False)) | (F.lag("observation_sequence").over(order) != F.col("observation_sequence") - 1)).cast("int"))
    rows = rows.withColumn("_island", F.when(F.col("_shell"), F.sum(F.when(F.col("_shell"), F.col("_new"))).over(order)))
    rows = rows.withColumn("_length", F.when(F.col("_shell"), F.count("*").over(Window.partitionBy("security_id", top, "_island"))))
    beside = {}
    for name, move, off in (("leading_shell_days", F.lag, -1), ("trailing_shell_days", F.lead, 1)):
        near = move("observation_sequence").over(order) == F.col("observation_sequence") + off
        beside[name] = F.when(near, move("_length").over(order))
    rows = rows.withColumns(beside).where(~F.col("_shell"))
    out = rows.groupBy("security_id", F.col(top).alias("parent_no"), F.col(anchor).alias("child_no")).agg(
        F.count("*").alias("child_days"), *[F.count(f"no_{k}").alias(f"days_{k}") for k in range(1, levels - 1)], *[F.count_distinct(f"no_{k}").alias(f"intervals_{k}") for k in range(1, levels - 1)],
        *[F.coalesce(F.max(name), F.lit(0)).cast("long").alias(name) for name in beside],
    )
    adjacent = F.col("leading_shell_days") + F.col("trailing_shell_days")
    siblings = F.count("*").over(Window.partitionBy("security_id", "parent_no")) - 1
    return out.withColumns({"adjacent_shell_days": adjacent, "n_siblings": siblings})


# ---- broken rows of a result ----


def broken(df: DataFrame, rule: str, keys: list[str], left: Column, right: Column, bad: Column) -> DataFrame:
    """(rule, row_key, left_value, right_value) of rows whose two sides don't agree as the rule asks."""
    key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("~")) for k in keys])
    return df.where(bad).select(F.lit(rule).alias("rule"), key.alias("row_key"), left.cast("double").alias("left_value"), right.cast("double").alias("right_value"))


def structure_rules(parents: DataFrame, children: DataFrame, identities: DataFrame, levels: int, key: str = "parent_no") -> list[tuple[str, DataFrame, list[str], Column, Column, Column]]:
    """The rules that tie a result's tables: (name, table, keys, left, right, broken)."""
    of_parent, of_child = ["security_id", key], ["security_id", key, "child_no"]
    c = F.col
    out = [("shell_days_conserved", parents, of_parent, c("shell_days"), c("parent_days") - c(f"days_{levels - 1}"), c("shell_days") != c("parent_days") - c(f"days_{levels - 1}"))]
    names = [*[f"days_{k}" for k in range(1, levels)], "parent_days"]
    out += [(f"{a}_within_{b}", parents, of_parent, c(a), c(b), c(a) > c(b)) for a, b in zip(names, names[1:])]
    both = c("leading_shell_days") + c("trailing_shell_days")
    out.append(("adjacent_days_conserved", children, of_child, c("adjacent_shell_days"), both, c("adjacent_shell_days") != both))
    counted = children.groupBy(*of_parent).agg(F.count("*").alias("_rows")).join(parents.select(*of_parent, "n_children"), of_parent, "full")
    found = counted.withColumns({"_rows": F.coalesce("_rows", F.lit(0)), "n_children": F.coalesce("n_children", F.lit(0))})
    out.append(("children_as_counted", found, of_parent, c("_rows"), c("n_children"), c("_rows") != c("n_children")))
    repeated = identities.groupBy("security_id", "observation_sequence", key).agg(F.count("*").alias("_rows"))
    out.append(("day_identity_unique", repeated, ["security_id", "observation_sequence", key], c("_rows"), F.lit(1), c("_rows") != 1))
    days = identities.groupBy(*of_parent).agg(F.count("*").alias("_days")).join(parents.select(*of_parent, "parent_days"), of_parent, "full")
    days = days.withColumns({"_days": F.coalesce("_days", F.lit(0)), "parent_days": F.coalesce("parent_days", F.lit(0))})
    out.append(("identity_days_conserved", days, of_parent, c("_days"), c("parent_days"), c("_days") != c("parent_days")))
    known = c("identity").isin(*IDENTITIES)
    out.append(("identity_known", identities, ["security_id", "observation_sequence", key], F.lit(0), F.lit(1), ~F.coalesce(known, F.lit(False))))
    return out


def structure_anomalies(rules: list) -> DataFrame:
    """Every broken row with its two sides."""
    return functools.reduce(DataFrame.unionByName, [broken(df, name, keys, left, right, bad) for name, df, keys, left, right, bad in rules])


def structure_checks(rules: list) -> DataFrame:
    """A row for each rule: rows that it looked at, rows that break it, and the sums of both sides."""
    out = [
        df.agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_broken"), F.coalesce(F.sum(left), F.lit(0)).cast("long").alias("left_sum"), F.coalesce(F.sum(right), F.lit(0)).cast("long").alias("right_sum")).withColumn("rule", F.lit(name))
        for name, df, _, left, right, bad in rules
    ]
    return functools.reduce(DataFrame.unionByName, out).withColumn("status", F.when(F.col("n_broken") == 0, "ok").otherwise("anomaly"))


# ---- margins at the ends ----


def gate_class(ready: Column, mean: Column, least: Column, q: Column) -> Column:
    """Which of a dimension's two gates fails: the mean score's, that of the least component, both, none, or not to be told."""
    known = F.coalesce(ready & finite(mean) & finite(least), F.lit(False))
    main, weak = mean < (1 - q) - EPSILON, least < (1 - q - WEAK_DELTA) - EPSILON
    return F.when(~known, "NOT_EVALUABLE").when(main & weak, "MAIN_AND_WEAK_FAIL").when(main, "MAIN_ONLY_FAIL").when(weak, "WEAK_ONLY_FAIL").otherwise("NO_GATE_FAIL")


def endpoint_margins(found: DataFrame, states: DataFrame, requests: DataFrame) -> DataFrame:
    """For each interval, both of its ends (last confirmed day; the day that ended it) and each dimension: distances of the scores
    to their thresholds and the class of the gate.

    An interval that is still open has no day that ended it; that end is not evaluable and has null margins.
    """
    ends = F.array(
        F.struct(F.lit("last_confirmed").alias("endpoint"), F.when(F.col("is_open"), F.col("last_observed_date")).otherwise(F.col("interval_end_date")).alias(TIME)),
        F.struct(F.lit("termination").alias("endpoint"), F.when(~F.col("is_open"), F.col("last_observed_date")).alias(TIME)),
    )
    rows = found.select("request_id", "security_id", "interval_no", "is_open", "termination_reason", F.explode(ends).alias("e")).select("*", "e.*").drop("e")
    rows = rows.join(F.broadcast(requests.select("request_id", "dimension", "q_bp")), "request_id")  # a few rows a request
    held = states.select("request_id", "dimension", "security_id", TIME, "score_mean", "score_min", "validity_status", "dimension_state")
    out = rows.join(held, ["request_id", "dimension", "security_id", TIME], "left")
    q = F.col("q_bp") / 10_000
    main = F.when(finite(F.col("score_mean")), F.col("score_mean") - (1 - q))
    weak = F.when(finite(F.col("score_min")), F.col("score_min") - (1 - q - WEAK_DELTA))
    both = F.when(main.isNotNull() & weak.isNotNull(), F.least(main, weak))
    gate = gate_class(F.col("validity_status") == "valid", F.col("score_mean"), F.col("score_min"), q)
    return out.select(
        "request_id", "security_id", "interval_no", "is_open", "termination_reason", "endpoint", TIME, "dimension", "dimension_state",
        main.alias("mean_margin"), weak.alias("min_margin"), both.alias("active_margin"), gate.alias("gate"),
    )


def exit_classes(margins: DataFrame) -> DataFrame:
    """A row for each interval: primary class and, where the state turned false, which dimensions did."""
    at_end = margins.where("endpoint = 'termination'")
    failed = F.array_join(F.array_sort(F.collect_list(F.when(F.col("dimension_state") == F.lit(False), F.col("dimension")))), "+")
    out = at_end.groupBy("request_id", "security_id", "interval_no").agg(F.first("is_open").alias("is_open"), F.first("termination_reason").alias("termination_reason"), failed.alias("_failed"))
    primary = F.when(F.col("is_open"), "right_censored").when(F.col("termination_reason") == "state_false", "raw_false").otherwise("quality")
    return out.withColumn("primary_class", primary).withColumn("false_class", F.when(primary == "raw_false", F.col("_failed"))).drop("_failed")


MARGINS = ("mean_margin", "min_margin", "active_margin")


def margin_profile(margins: DataFrame, by: list[str]) -> DataFrame:
    """For each group, end, dimension and margin: counts, mean, least, greatest, quantiles by the rounded index, whether all are zero or equal, and gates."""
    keys = [*by, "endpoint", "dimension", "margin"]
    gates = {g: g.lower() for g in ("MAIN_ONLY_FAIL", "WEAK_ONLY_FAIL", "MAIN_AND_WEAK_FAIL", "NO_GATE_FAIL", "NOT_EVALUABLE")}
    cells = F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).alias("value")) for m in MARGINS])
    long = margins.select(*by, "endpoint", "dimension", "gate", F.explode(cells).alias("c")).select(*by, "endpoint", "dimension", "gate", "c.*")
    sums = long.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count("value").alias("n_finite"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("greatest"),
        F.max(F.abs("value")).alias("_far"), *[F.count_if(F.col("gate") == g).alias(name) for g, name in gates.items()],
    )
    spread = quantiles(long, keys, "value", {"p05": 0.05, "p50": 0.5, "p95": 0.95}, "rounded").drop("n")
    out = sums.join(spread, keys, "left")
    return out.select(
        *keys, "n", "n_finite", (F.col("n") - F.col("n_finite")).alias("n_null"), "mean", "least", "p05", "p50", "p95", "greatest",
        F.coalesce(F.col("least") == F.col("greatest"), F.lit(False)).alias("constant"), F.coalesce(F.col("_far") <= EPSILON, F.lit(False)).alias("all_zero"), *gates.values(),
    )


def termination_summary(classes: DataFrame) -> DataFrame:
    """A row for each request and class: intervals, their share, and among false exits the share of each false class."""
    out = classes.groupBy("request_id", "primary_class", F.coalesce("false_class", F.lit("-")).alias("false_class")).agg(F.count("*").alias("n"))
    of_request, of_class = Window.partitionBy("request_id"), Window.partitionBy("request_id", "primary_class")
    return out.withColumns({"share": F.col("n") / F.sum("n").over(of_request), "share_of_class": F.col("n") / F.sum("n").over(of_class)})


def quality_reasons(classes: DataFrame, reasons: list[str]) -> DataFrame:
    """Exits by quality, by their original reason, with a row for every reason of the list, and shares of quality exits and of all."""
    each = classes.groupBy("request_id").agg(
        F.count("*").alias("_all"), F.count_if(F.col("primary_class") == "quality").alias("_quality"),
        *[F.count_if((F.col("primary_class") == "quality") & (F.col("termination_reason") == r)).alias(r) for r in reasons],
    )
    rows = F.array(*[F.struct(F.lit(r).alias("reason"), F.col(r).alias("n")) for r in reasons])
    out = each.select("request_id", "_all", "_quality", F.explode(rows).alias("r")).select("request_id", "r.*", "_all", "_quality")
    return out.select("request_id", "reason", "n", ratio(F.col("n"), F.col("_quality")).alias("share_of_quality"), ratio(F.col("n"), F.col("_all")).alias("share_of_all"))


def reentry_rates(outcomes: DataFrame) -> DataFrame:
    """For each request and horizon: outcomes, what could be observed, its coverage, and the rate of re-entry."""
    n = {o: F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in ("re_entered", "none", "interrupted", "insufficient")}
    out = outcomes.groupBy("request_id", "threshold").agg(F.count("*").alias("n_exits"), *n.values(), F.avg("reentry_lag").alias("mean_lag"))
    seen = F.col("n_re_entered") + F.col("n_none")
    return out.withColumns({
        "n_observable": seen, "coverage": ratio(seen, F.col("n_exits")), "reentry_rate": ratio(F.col("n_re_entered"), seen),
        "conserved": F.col("n_exits") == seen + F.col("n_interrupted") + F.col("n_insufficient"),
    })


def concentration(classes: DataFrame, entity: str, by: list[str]) -> DataFrame:
    """How a group's intervals spread over entities: how many have one, quantiles of their numbers, the largest, and its share."""
    each = classes.groupBy(*by, entity).agg(F.count("*").alias("n"))
    totals = each.groupBy(*by).agg(F.sum("n").alias("n_intervals"), F.count("*").alias("n_entities"), F.max("n").alias("most"), F.min_by(entity, F.struct(-F.col("n"), entity)).alias("top_entity"))
    spread = quantiles(each, by, "n", {"p50": 0.5, "p95": 0.95}, "rounded").drop("n")
    return totals.join(spread, by).withColumn("top_share", ratio(F.col("most"), F.col("n_intervals")))


def structure_summary(parents: DataFrame, children: DataFrame, levels: int) -> DataFrame:
    """The chain in numbers: parents, days of each level, shell, fragmented and equal parents, children, what lies beside them."""
    p = parents.agg(
        F.count("*").alias("n_parents"), F.sum("parent_days").alias("parent_days"), *[F.sum(f"days_{k}").alias(f"days_{k}") for k in range(1, levels)], F.sum("shell_days").alias("shell_days"),
        F.count_if(F.col("n_children") == 0).alias("n_childless"), F.count_if("fragmented").alias("n_fragmented"), F.count_if("equals_parent").alias("n_equal"), F.max("n_children").alias("most_children"),
        F.max(ratio(F.col("shell_days"), F.col("parent_days"))).alias("largest_shell_share"),
    )
    c = children.agg(
        F.count("*").alias("n_children"), F.sum("leading_shell_days").alias("leading_shell_days"), F.sum("trailing_shell_days").alias("trailing_shell_days"),
        F.count_if(F.col("n_siblings") > 0).alias("n_with_siblings"), F.max("adjacent_shell_days").alias("most_adjacent_days"),
    )
    return p.crossJoin(c)  # one row each
