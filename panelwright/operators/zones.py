"""Event zones: qualified components joined over short gaps, with as-of daily states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.conventions import asof, ratio
from panelwright.operators.states import streaks
from panelwright.sources.scratch import written

TIME = "trading_date"


def replay(dense: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """Confirmation on the dense panel; a row that is absent, not valid or without a state is a hard break."""
    days = dense.withColumn("hard_break", (F.col("validity_status") != "valid") | F.col("raw_state").isNull())
    days = streaks(days, keys, ready=~F.col("hard_break"))
    return days.withColumn("confirmed", F.coalesce(F.col("streak") >= k, F.lit(False)))


def atomic_intervals(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Confirmed runs with their confirmed days and how they end: natural, quality or sample_end."""
    w = Window.partitionBy(*keys).orderBy(TIME)
    daily = daily.withColumns({"_next": F.lead(TIME).over(w), "_broken": F.lead("hard_break").over(w)})
    runs = daily.where("confirmed").groupBy(*keys, "run").agg(
        F.min("observation_sequence").alias("first_seq"), F.max("observation_sequence").alias("last_seq"),
        F.min(TIME).alias("start_date"), F.max(TIME).alias("end_date"), F.count("*").alias("n_confirmed"),
        F.max(F.struct(TIME, "_next", "_broken")).alias("_last"),
    )
    reason = F.when(F.col("_last._next").isNull(), "sample_end").when(F.col("_last._broken"), "quality").otherwise("natural")
    return runs.withColumn("end_reason", reason).drop("_last")


def components(intervals: DataFrame, daily: DataFrame, d: int, keys: list[str]) -> DataFrame:
    """Atomic intervals with ``qualified`` (at least d confirmed days) and the date of the d-th such day."""
    nth = daily.where("confirmed").withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "run").orderBy(TIME)))
    at = nth.where(F.col("_n") == d).select(*keys, "run", F.col(TIME).alias("qualification_date"))
    return intervals.join(at, [*keys, "run"], "left").withColumn("qualified", F.col("qualification_date").isNotNull())


def gaps(daily: DataFrame, comps: DataFrame, g: int, keys: list[str]) -> DataFrame:
    """What lies after each component up to the next: false rows, breaks, and the date of the (g+1)-th false row.

    The rows after a component carry its run number by a last non-null value, so no range join is needed.
    """
    w = Window.partitionBy(*keys).orderBy(TIME).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = daily.withColumn("after", F.last(F.when(F.col("confirmed"), F.col("run")), ignorenulls=True).over(w)).where(~F.col("confirmed") & F.col("after").isNotNull())
    false = ~F.col("hard_break") & (F.col("raw_state") == F.lit(False))
    rows = rows.withColumns({"_false": false, "_n": F.sum(false.cast("int")).over(Window.partitionBy(*keys, "after").orderBy(TIME))})
    return rows.groupBy(*keys, F.col("after").alias("run")).agg(
        F.count_if("_false").alias("n_false"), F.count_if("hard_break").alias("n_breaks"), F.count_if(F.col("raw_state") & ~F.col("hard_break")).alias("n_unconfirmed_true"),
        F.min(F.when(F.col("_false") & (F.col("_n") == g + 1), F.col(TIME))).alias("exceeded_date"), F.min(F.when(F.col("hard_break"), F.col(TIME))).alias("break_date"),
    )


def assign_zones(comps: DataFrame, found: DataFrame, g: int, keys: list[str]) -> DataFrame:
    """Every component with the facts of the gap before it and, if qualified, its zone number.

    A qualified component begins a zone unless the component before it is qualified too and the gap
    between them has no break, at least one and at most g false rows.
    """
    w = Window.partitionBy(*keys).orderBy("first_seq")
    out = comps.join(found, [*keys, "run"], "left").fillna(0, ["n_false", "n_breaks", "n_unconfirmed_true"])
    before = {f"_{c}": F.lag(c).over(w) for c in ("qualified", "n_false", "n_breaks")}
    out = out.withColumns(before)
    joined = F.coalesce(F.col("_qualified") & (F.col("_n_breaks") == 0) & F.col("_n_false").between(1, g), F.lit(False))
    out = out.withColumns({"bridged": F.col("qualified") & joined, "next_qualified": F.lead("qualified").over(w), "next_end_reason": F.lead("end_reason").over(w)})
    begins = (F.col("qualified") & ~joined).cast("int")
    return out.withColumn("zone", F.when(F.col("qualified"), F.sum(begins).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))).drop("_qualified", "_n_false", "_n_breaks")


def zones(assigned: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each zone: span, components, bridged gaps and status.

    The status comes from what follows the last component: a false row beyond the bound ends the zone,
    a break before that ends it with a quality break, and neither leaves it right-censored. Where an
    unqualified component follows, its own ending decides.
    """
    last = F.struct("first_seq", "exceeded_date", "break_date", "next_qualified", "next_end_reason", "end_reason")
    out = assigned.where("qualified").groupBy(*keys, "zone").agg(
        F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"), F.count("*").alias("n_components"), F.sum("n_confirmed").alias("n_confirmed"),
        F.count_if("bridged").alias("n_bridges"), F.min("qualification_date").alias("qualification_date"), F.max(last).alias("_last"),
    )
    over, broken = F.col("_last.exceeded_date"), F.col("_last.break_date")
    follower = F.col("_last.next_qualified") == F.lit(False)
    status = (
        F.when(broken.isNotNull() & (over.isNull() | (broken < over)), "FINALIZED_WITH_QUALITY_BREAK").when(over.isNotNull(), "FINALIZED")
        .when(follower & (F.col("_last.next_end_reason") == "quality"), "FINALIZED_WITH_QUALITY_BREAK").when(follower & (F.col("_last.next_end_reason") == "natural"), "FINALIZED")
        .when(F.col("_last.next_qualified"), "FINALIZED").otherwise("RIGHT_CENSORED")
    )
    return out.withColumn("status", status).withColumn("decision_date", F.least(over, broken)).drop("_last")


def event_ids(found: DataFrame, keys: list[str]) -> DataFrame:
    """Identity of a zone: SHA-256 of its keys and the first day of its first component."""
    return found.withColumn("event_id", F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("start_date").cast("string")), 256))


def membership(found: DataFrame, daily: DataFrame, keys: list[str]) -> DataFrame:
    """Days of each zone from its start to its end, with the role of the day."""
    span = found.select(*keys, "zone", "start_date", "end_date", "qualification_date", F.explode(F.sequence(F.year("start_date") * 12 + F.month("start_date"), F.year("end_date") * 12 + F.month("end_date"))).alias("_m"))
    days = daily.withColumn("_m", F.year(TIME) * 12 + F.month(TIME))
    out = days.join(span, [*keys, "_m"]).where(f"{TIME} between start_date and end_date")
    role = F.when(~F.col("confirmed"), "bridge").when(F.col(TIME) < F.col("qualification_date"), "prequalification").otherwise("core")
    return out.select(*keys, "zone", TIME, role.alias("role"))


def bridges(assigned: DataFrame, g: int, keys: list[str]) -> DataFrame:
    """Gaps between consecutive components with the decision on them."""
    w = Window.partitionBy(*keys).orderBy("first_seq")
    out = assigned.withColumns({"next_bridged": F.lead("bridged").over(w), "next_start": F.lead("start_date").over(w)}).where("next_start is not null")
    reason = (
        F.when(F.col("next_bridged"), "bridged").when(~F.col("qualified"), "left_unqualified").when(~F.col("next_qualified"), "right_unqualified")
        .when(F.col("n_breaks") > 0, "hard_break").when(F.col("n_false") > g, "too_long").otherwise("no_false_row")
    )
    return out.select(*keys, "end_date", "next_start", "n_false", "n_breaks", reason.alias("reason"))


def transitions(found: DataFrame, assigned: DataFrame, keys: list[str]) -> DataFrame:
    """Events of each entity in order: components qualified or not, zones decided."""
    rows = [
        assigned.select(*keys, F.col("start_date").alias("event_date"), F.when(F.col("qualified"), "component_qualified").otherwise("component_unqualified").alias("event")),
        found.where("decision_date is not null").select(*keys, F.col("decision_date").alias("event_date"), F.col("status").alias("event")),
    ]
    out = rows[0].unionByName(rows[1])
    w = Window.partitionBy(*keys).orderBy("event_date", "event")
    return out.withColumns({"ordinal": F.row_number().over(w), "previous_event": F.lag("event").over(w)})


def transition_counts(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """The ledger by what came before and what follows: transitions, entities, and the share of all that leave the same event."""
    out = ledger.groupBy("previous_event", "event").agg(F.count("*").alias("n"), F.countDistinct(*keys).alias("n_entities"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("previous_event")))  # a row for each pair of events


def strict_core(primary: DataFrame, strict: DataFrame, keys: list[str]) -> DataFrame:
    """Days shared by two membership tables, and days of the strict one that the primary lacks."""
    a, b = primary.select(*keys, TIME).distinct(), strict.select(*keys, TIME).distinct()
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), [*keys, TIME], "full")
    return both.agg(
        F.count_if("_a").alias("n_primary"), F.count_if("_b").alias("n_strict"), F.count_if(F.col("_a") & F.col("_b")).alias("n_shared"),
        F.count_if(F.col("_b") & F.col("_a").isNull()).alias("n_violations"),
    )


def zone_scan(dense: DataFrame, routes: list[tuple[str, str, int]], ds: list[int], gs: list[int], key: str = "security_id") -> DataFrame:
    """Zones of every cell (route, d, g), from one exchange and one sort of the panel.

    A route is a name, a state column of ``dense`` and a confirmation length. Rows are dealt by entity once; each route
    is a column of the same rows there. A confirmed run and what lies after it up to the next share one
    number, so a component and the gap behind it are one group. The d-th confirmed day is the one with
    streak k + d - 1, and the false rows of a gap are numbered by a running sum less its value at the gap's begin; d and g
    only choose among what the group holds, for components alone, and need no look at the days again.
    """
    cells = F.array(*[F.struct(F.lit(n).alias("route"), F.lit(k).alias("k"), F.col(c).alias("raw_state")) for n, c, k in routes])
    rows = dense.repartition(key).select(key, TIME, "observation_sequence", "validity_status", F.explode(cells).alias("c")).select(key, TIME, "observation_sequence", "validity_status", "c.*")
    w = Window.partitionBy(key, "route").orderBy(TIME)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    broken = F.coalesce(F.col("validity_status") != "valid", F.lit(True)) | F.col("raw_state").isNull()
    rows = rows.withColumn("_break", broken).withColumn("_on", ~F.col("_break") & F.col("raw_state"))
    rows = rows.withColumns({"_next": F.lead(TIME).over(w), "_broken": F.lead("_break").over(w), "_off": F.max(F.when(~F.col("_on"), F.col("observation_sequence"))).over(upto), "_first": F.min("observation_sequence").over(upto)})
    streak = F.when(F.col("_on"), F.col("observation_sequence") - F.coalesce("_off", F.col("_first") - 1))
    rows = rows.withColumn("streak", streak).withColumn("confirmed", F.coalesce(F.col("streak") >= F.col("k"), F.lit(False)))
    false = ~F.col("_break") & ~F.col("raw_state")
    rows = rows.withColumns({"_run": F.sum((F.col("streak") == F.col("k")).cast("int")).over(upto), "_falses": F.sum(false.cast("int")).over(upto), "_false": false})
    rows = rows.withColumn("_nth", F.col("_falses") - F.last(F.when(F.col("confirmed"), F.col("_falses")), ignorenulls=True).over(upto)).where("_run > 0")
    on = F.col("confirmed")
    comps = rows.groupBy(key, "route", "_run").agg(
        F.min(F.when(on, F.col("observation_sequence"))).alias("first_seq"), F.min(F.when(on, F.col(TIME))).alias("start_date"), F.max(F.when(on, F.col(TIME))).alias("end_date"), F.count_if(on).alias("n_confirmed"),
        F.max(F.when(on, F.struct(TIME, "_next", "_broken"))).alias("_last"), F.count_if(F.col("_false")).alias("n_false"), F.count_if(~on & F.col("_break")).alias("n_breaks"), F.min(F.when(~on & F.col("_break"), F.col(TIME))).alias("break_date"),
        *[F.min(F.when(on & (F.col("streak") == F.col("k") + d - 1), F.col(TIME))).alias(f"_q{d}") for d in ds],
        *[F.min(F.when(F.col("_false") & (F.col("_nth") == g + 1), F.col(TIME))).alias(f"_e{g}") for g in gs],
    )
    reason = F.when(F.col("_last._next").isNull(), "sample_end").when(F.col("_last._broken"), "quality").otherwise("natural")
    grid = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(g).alias("g"), F.col(f"_q{d}").alias("qualification_date"), F.col(f"_e{g}").alias("exceeded_date")) for d in ds for g in gs])
    comps = comps.withColumns({"end_reason": reason, "_cell": F.explode(grid)})
    comps = comps.select(key, "route", "_cell.*", "first_seq", "start_date", "end_date", "n_confirmed", "n_false", "n_breaks", "break_date", "end_reason").withColumn("qualified", F.col("qualification_date").isNotNull())
    keys = [key, "route", "d", "g"]
    order = Window.partitionBy(*keys).orderBy("first_seq")
    joined = F.coalesce(F.lag("qualified").over(order) & (F.lag("n_breaks").over(order) == 0) & F.lag("n_false").over(order).between(F.lit(1), F.col("g")), F.lit(False))
    comps = comps.withColumns({"bridged": F.col("qualified") & joined, "next_qualified": F.lead("qualified").over(order), "next_end_reason": F.lead("end_reason").over(order)})
    begins = (F.col("qualified") & ~F.col("bridged")).cast("int")
    return zones(comps.withColumn("zone", F.when(F.col("qualified"), F.sum(begins).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))), keys)


def overlapping_pairs(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Zones of ``a`` and ``b`` of one entity that share a day. They meet by month, so no entity's zones are all set against each other."""

    def spread(df: DataFrame, side: str) -> DataFrame:
        months = F.sequence(F.year("start_date") * 12 + F.month("start_date"), F.year("end_date") * 12 + F.month("end_date"))
        return df.select(key, F.col("zone").alias(f"zone_{side}"), F.col("start_date").alias(f"s{side}"), F.col("end_date").alias(f"e{side}"), F.explode(months).alias("_m"))

    return spread(a, "a").join(spread(b, "b"), [key, "_m"]).where("sa <= eb and sb <= ea").drop("_m").distinct()


def mutual_matches(pairs: DataFrame, key: str, order: list[str], left: str, right: str) -> DataFrame:
    """One-to-one choice of pairs, greedy in the order given, by rounds of mutual first choice.

    In a round every pair goes that is the first of both its ends; then pairs whose end is taken fall away.
    The first pair left is always such a pair, so the rounds end, and what they choose is what one pass in
    order would. ``order`` must tell pairs of a key apart. A round costs two windows over the pairs that are left.
    """
    left_over, chosen = written(pairs, "pairs"), None
    while left_over.head(1):
        place = [F.col(c) for c in order]
        ranked = left_over.withColumns({"_l": F.row_number().over(Window.partitionBy(key, left).orderBy(*place)), "_r": F.row_number().over(Window.partitionBy(key, right).orderBy(*place))})
        taken = written(ranked.where("_l = 1 and _r = 1").drop("_l", "_r"), "taken")
        chosen = taken if chosen is None else chosen.unionByName(taken)
        left_over = left_over.join(taken.select(key, left), [key, left], "left_anti").join(taken.select(key, right), [key, right], "left_anti")
        left_over = written(left_over, "pairs")
    return chosen if chosen is not None else pairs


def greedy_matches(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One-to-one matches of overlapping zones, in order of start dates, for each entity."""
    pairs = overlapping_pairs(a, b, key)
    return mutual_matches(pairs, key, ["sa", "sb", "zone_a", "zone_b"], "zone_a", "zone_b").select(key, "zone_a", "sa", "ea", "zone_b", "sb", "eb")


def window_comparison(a: DataFrame, b: DataFrame, days_a: DataFrame, days_b: DataFrame, key: str) -> DataFrame:
    """Two sets of zones set against each other, by entity: shared days and their Jaccard index, zones that overlap any, and matches."""
    day = days_a.select(key, TIME).distinct().withColumn("_a", F.lit(True)).join(days_b.select(key, TIME).distinct().withColumn("_b", F.lit(True)), [key, TIME], "full")
    days = day.groupBy(key).agg(F.count("_a").alias("days_a"), F.count("_b").alias("days_b"), F.count_if(F.col("_a") & F.col("_b")).alias("shared_days"), F.count("*").alias("_union"))
    days = days.withColumn("day_jaccard", ratio(F.col("shared_days"), F.col("_union"))).drop("_union")
    pairs = written(overlapping_pairs(a, b, key), "overlaps")
    over = pairs.groupBy(key).agg(F.count_distinct("zone_a").alias("overlapping_a"), F.count_distinct("zone_b").alias("overlapping_b"), F.count("*").alias("n_pairs"))
    found = mutual_matches(pairs, key, ["sa", "sb", "zone_a", "zone_b"], "zone_a", "zone_b").groupBy(key).agg(F.count("*").alias("n_matched"))
    out = days
    for part in (a.groupBy(key).agg(F.count("*").alias("zones_a")), b.groupBy(key).agg(F.count("*").alias("zones_b")), over, found):
        out = out.join(part, key, "left")
    return out.fillna(0, ["zones_a", "zones_b", "overlapping_a", "overlapping_b", "n_pairs", "n_matched"])


def asof_daily(daily: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Each day with the zone last known to hold it: the latest membership at or before the day, ties to the later zone."""
    known = members.select(*keys, TIME, "zone", "role")
    out = asof(daily.select(*keys, TIME), known, keys, TIME, TIME, ["zone", "role"], ties=["zone"])
    return out.withColumn("in_zone", F.coalesce(F.col(f"matched_{TIME}") == F.col(TIME), F.lit(False)))
