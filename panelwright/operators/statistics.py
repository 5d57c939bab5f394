"""Profiles, association, stability and response statistics of states and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.conventions import STATUSES, ratio
from panelwright.operators.selection import quantiles
from panelwright.sources.scratch import written

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def spread(values: str) -> list[Column]:
    """Mean, sample deviation and exact linear quantiles of a column."""
    quantiles = [F.percentile(values, q).alias(f"q{round(q * 100):02d}") for q in QUANTILES]
    return [F.avg(values).alias("mean"), F.stddev_samp(values).alias("std"), F.min(values).alias("least"), F.max(values).alias("greatest"), *quantiles]


def state_profile(daily: DataFrame, by: list[str], states: DataFrame | None = None) -> DataFrame:
    """Days by validity and by state; with a registry of states also rows for those that never occur."""
    out = daily.groupBy(*by).agg(
        F.count("*").alias("n_days"), F.count_if(F.col("validity_status") == "valid").alias("n_valid"), F.count_if(F.col("validity_status") == "unknown").alias("n_unknown"),
        F.count_if(F.col("validity_status") == "blocked").alias("n_blocked"), F.count_if("raw_state").alias("n_true"), F.count_if(~F.col("raw_state")).alias("n_false"),
        F.count_if(F.col("raw_state").isNull()).alias("n_null"), F.countDistinct(F.when(F.col("raw_state"), F.col("security_id"))).alias("n_entities_true"),
    )
    return out if states is None else states.join(out, by, "left").fillna(0)


def segment_count(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Onsets of a true state after anything else."""
    before = F.coalesce(F.lag("raw_state").over(Window.partitionBy(*keys).orderBy("trading_date")), F.lit(False))
    return daily.withColumn("_on", F.col("raw_state") & ~before).groupBy(*keys).agg(F.count_if("_on").alias("n_segments"))


def segment_durations(runs: DataFrame, by: list[str]) -> DataFrame:
    """Lengths of true runs with starts that follow a false day (strict) or the panel's first day (censored)."""
    w = Window.partitionBy("security_id").orderBy("trading_date")
    rows = runs.withColumns({"_before": F.lag("raw_state").over(w), "_first": F.row_number().over(w) == 1})
    found = rows.where("run is not null").groupBy(*by, "security_id", "run").agg(
        F.count("*").alias("days"), F.min_by("_before", "trading_date").alias("before"), F.min_by("_first", "trading_date").alias("first")
    )
    found = found.withColumn("days", F.col("days").cast("double"))
    strict = [F.count("*").alias("n_starts"), F.count_if(F.col("before") == F.lit(False)).alias("n_strict"), F.count_if("first").alias("n_censored"), F.count_if(F.col("days") == 1).alias("n_single_days")]
    return (found.groupBy(*by) if by else found.groupBy()).agg(*strict, *spread("days"))


def interval_profile(intervals: DataFrame, by: list[str]) -> DataFrame:
    return intervals.groupBy(*by).agg(
        F.count("*").alias("n_intervals"), F.sum("duration_confirmed_days").alias("confirmed_days"), F.avg("duration_raw_days").alias("mean_raw_days"),
        F.countDistinct("security_id").alias("n_entities"), F.avg(F.datediff("confirmation_date", "raw_start_date").cast("double")).alias("mean_delay"),
        F.count_if("is_open").alias("n_open"), F.count_if(F.col("duration_confirmed_days") > F.col("duration_raw_days")).alias("n_inconsistent"),
    )


def overlap(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """2x2 of two states on days where both are known, with Jaccard, containment, retention and lift."""
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    out = (known.groupBy(*by) if by else known.groupBy()).agg(
        F.count_if(F.col(a) & F.col(b)).alias("n11"), F.count_if(F.col(a) & ~F.col(b)).alias("n10"), F.count_if(~F.col(a) & F.col(b)).alias("n01"), F.count_if(~F.col(a) & ~F.col(b)).alias("n00")
    )
    return with_association(out)


def with_association(counts: DataFrame) -> DataFrame:
    """Measures of association from n11, n10, n01 and n00; null for empty denominators."""
    n11, n10, n01, n00 = (F.col(c) for c in ("n11", "n10", "n01", "n00"))
    n = n11 + n10 + n01 + n00
    retention, base = ratio(n11, n11 + n10), ratio(n11 + n01, n)
    return counts.withColumns(
        {
            "jaccard": ratio(n11, n11 + n10 + n01), "b_given_a": retention, "a_given_b": ratio(n11, n11 + n01), "base_rate": base, "lift": ratio(retention, base),
            "delta": retention - base, "delta_vs_not_a": retention - ratio(n01, n01 + n00), "excess_joint": n11 - ratio((n11 + n10) * (n11 + n01), n),
        }
    )


def onset_overlap(df: DataFrame, a: str, b: str) -> DataFrame:
    """Onsets of two states that fall on one day."""
    w = Window.partitionBy("security_id").orderBy("trading_date")
    begins = lambda c: F.coalesce(F.col(c), F.lit(False)) & ~F.coalesce(F.lag(c).over(w), F.lit(False))
    rows = df.select(begins(a).alias("_a"), begins(b).alias("_b"))
    return rows.agg(F.count_if("_a").alias("n_a"), F.count_if("_b").alias("n_b"), F.count_if(F.col("_a") & F.col("_b")).alias("n_both"))


#: Nine quantiles of a distribution.
NINE = {f"q{round(q * 100):02d}": q for q in (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)}


def distribution(rows: DataFrame, by: str, value: str, status: str | None = None, domain: Column | None = None) -> DataFrame:
    """Rows, rows by status, moments, nine exact quantiles, violations of the domain, and the share of values outside [q01, q99]."""
    rows = written(rows.select(by, F.col(value).alias("value"), (F.col(status) if status else F.lit(None).cast("string")).alias("_status"), (F.coalesce(~domain, F.lit(False)) if domain is not None else F.lit(False)).alias("_outside")), "distribution")
    counts = {s: F.count_if(F.col("_status") == s).alias(f"n_{s}") for s in STATUSES} if status else {}
    sums = rows.groupBy(by).agg(
        F.count("*").alias("n_rows"), F.count("value").alias("n_values"), *counts.values(), F.count_if("_outside").alias("n_outside_domain"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("greatest"),
    )
    nine = quantiles(rows, [by], "value", NINE).drop("n")
    tail = rows.where("value is not null").join(F.broadcast(nine.select(by, "q01", "q99")), by)  # a row for each group
    tail = tail.groupBy(by).agg(F.avg(((F.col("value") < F.col("q01")) | (F.col("value") > F.col("q99"))).cast("double")).alias("tail_share"))
    return sums.join(nine, by, "left").join(tail, by, "left")


def histogram(scores: DataFrame, by: str, buckets: int) -> DataFrame:
    """Share of scores in equal, half-open buckets of [0, 1] (1 falls to the last) against the nominal share."""
    bucket = F.least(F.floor(F.col("score") * buckets + 1e-9), F.lit(buckets - 1))
    out = scores.where("score is not null").groupBy(by, bucket.alias("bucket")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(by))
    return out.withColumns({"share": share, "difference": share - 1 / buckets})


def value_ranks(df: DataFrame, column: str, by: list[str] = [], name: str | None = None) -> DataFrame:
    """(by, column, rank): the average rank, from 1, of every value within ``by``; nulls have none.

    Equal values are counted, the counts are dealt to ranges as Spark samples them, and a rank is what its own range
    counts up to it after the ranges before. So no window holds a group, however its values crowd.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    counts = written(counts.repartitionByRange(*by, column).withColumn("_part", F.spark_partition_id()), "value-counts")
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = counts.groupBy(*by, "_part").agg(F.sum("_n").alias("_s")).select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate([*by, "_part"])], F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate([*by, "_part"])])
    own = Window.partitionBy(*by, "_part").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("_before") + F.coalesce(F.sum("_n").over(own), F.lit(0))
    return counts.join(sums, same).select(*by, column, (upto + (F.col("_n") + 1) / 2).alias(name or f"{column}_rank"))


def correlation(a: str, b: str) -> Column:
    """Pearson correlation of two columns over the rows that have both: NaN where a side doesn't vary (``corr`` fails there by a division by zero), null over no rows."""
    there = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = (F.when(there, F.col(c).cast("double")) for c in (a, b))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread == 0, F.lit(float("nan"))).otherwise(F.covar_pop(x, y) / spread)


def correlations(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Pearson and Spearman (average ranks within the group) correlation of two columns; NaN where one of them is constant in its group."""
    known = written(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, a, b), "known")
    ranked = known
    for c in (a, b):
        ranked = ranked.join(value_ranks(known, c, by), [*by, c])
    out = ranked.groupBy(*by) if by else ranked.groupBy()
    return out.agg(F.count("*").alias("n"), correlation(a, b).alias("pearson"), correlation(f"{a}_rank", f"{b}_rank").alias("spearman"))


def reason_profile(df: DataFrame) -> DataFrame:
    """Prevalence of each reason among rows and its share of all occurrences."""
    row = F.array(F.struct(F.lit(False).alias("given"), F.lit(None).cast("string").alias("reason")))
    marks = F.coalesce(F.concat(F.transform("reason_codes", lambda r: F.struct(F.lit(True).alias("given"), r.alias("reason"))), row), row)
    out = df.select(F.explode(marks).alias("x")).groupBy("x.given", "x.reason").agg(F.count("*").alias("n"))  # rows are counted beside their reasons, in one pass
    every = Window.partitionBy()  # a row for each reason
    out = out.withColumns({"n_all": F.sum(F.when(~F.col("given"), F.col("n"))).over(every), "n_given": F.sum(F.when(F.col("given"), F.col("n"))).over(every)})
    return out.where("given").select("reason", "n", (F.col("n") / F.col("n_all")).alias("prevalence"), (F.col("n") / F.col("n_given")).alias("share"))


def lag_targets(df: DataFrame, state: str, ks: list[int]) -> DataFrame:
    """Anchors (onset, or stay-out control) with the state k rows later and whether the run survives to there."""
    w = Window.partitionBy("security_id").orderBy("trading_date")
    before = F.lag(state).over(w)
    kind = F.when((before == F.lit(False)) & F.col(state), "onset").when((before == F.lit(False)) & ~F.col(state), "control")
    out = df.withColumn("anchor", kind)
    cells = []
    for k in ks:
        ahead = w.rowsBetween(0, k)
        cells.append(F.struct(F.lit(k).alias("k"), F.lead(state, k).over(w).alias("target"), (F.count(F.lit(1)).over(ahead) == k + 1).alias("complete"), (F.count_if(F.col(state)).over(ahead) == k + 1).alias("survived")))
    return out.withColumn("cells", F.array(*cells)).where("anchor is not null").select("security_id", "trading_date", "anchor", F.explode("cells").alias("c")).select("security_id", "trading_date", "anchor", "c.*")


def lag_profile(targets: DataFrame, by: list[str] = []) -> DataFrame:
    """Probability of the state at each lag after an onset and after a control, their difference and lift."""
    on, off = F.col("anchor") == "onset", F.col("anchor") == "control"
    known = F.col("target").isNotNull()
    out = targets.groupBy(*by, "k").agg(
        F.count_if(on & known).alias("n_onset"), F.count_if(on & F.col("target")).alias("n_onset_true"), F.count_if(off & known).alias("n_control"), F.count_if(off & F.col("target")).alias("n_control_true"),
        F.count_if(on & ~F.col("complete")).alias("n_right_censored"), F.count_if(on & F.col("survived")).alias("n_survived"),
    )
    a, b = ratio(F.col("n_onset_true"), F.col("n_onset")), ratio(F.col("n_control_true"), F.col("n_control"))
    return out.withColumns({"p_onset": a, "p_control": b, "difference": a - b, "lift": ratio(a, b)})


def concentration(rows: DataFrame, by: str, period: str, count: str) -> DataFrame:
    """Herfindahl index, effective periods, greatest shares and peak period."""
    w = Window.partitionBy(by)
    rows = rows.withColumn("share", F.col(count) / F.sum(count).over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc(count), period)))
    out = rows.groupBy(by).agg(
        F.sum(F.col("share") * F.col("share")).alias("hhi"), F.sum(F.when(F.col("place") <= 1, F.col("share"))).alias("top1"), F.sum(F.when(F.col("place") <= 2, F.col("share"))).alias("top2"),
        F.min_by(period, "place").alias("peak"),
    )
    return out.withColumn("effective", 1 / F.col("hhi"))


def leave_one_out(rows: DataFrame, by: str, period: str) -> DataFrame:
    """Retention without each period in turn, from the totals less its own counts."""
    w = Window.partitionBy(by)
    rest = {c: F.sum(c).over(w) - F.col(c) for c in ("n11", "n10")}
    whole = ratio(F.sum("n11").over(w), F.sum("n11").over(w) + F.sum("n10").over(w))
    without = ratio(rest["n11"], rest["n11"] + rest["n10"])
    return rows.select(by, period, whole.alias("retention"), without.alias("retention_without"), (without - whole).alias("change"))


def response_profile(curve: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Steps of a curve over an ordered parameter: differences, slopes, and whether it turns there."""
    w = Window.partitionBy(by).orderBy(x)
    step = F.col(y) - F.lag(y).over(w)
    out = curve.withColumns({"step": step, "slope": ratio(step, F.col(x) - F.lag(x).over(w))})
    out = out.withColumn("reversal", F.coalesce(F.sign("step") * F.sign(F.lag("step").over(w)) < 0, F.lit(False)))
    edge = F.lag(x).over(w).isNull() | F.lead(x).over(w).isNull()
    return out.withColumn("boundary", edge)


def _dominates(left: str, right: str, objectives: list[str], epsilon: float) -> Column:
    """Whether ``right`` is nowhere worse than ``left`` and somewhere better, each by more than ``epsilon``."""
    no_worse = reduce(lambda x, y: x & y, [F.col(f"{right}.{o}") >= F.col(f"{left}.{o}") - epsilon for o in objectives])
    better = reduce(lambda x, y: x | y, [F.col(f"{right}.{o}") > F.col(f"{left}.{o}") + epsilon for o in objectives])
    return no_worse & better


def _front(rows: DataFrame, groups: list[str], objectives: list[str]) -> DataFrame:
    """Rows that no other row of their group plainly dominates."""
    a, b = rows.alias("a"), rows.select(*groups, *objectives).alias("b")  # the same rows once more
    same = reduce(lambda x, y: x & y, [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in groups])
    return a.join(b, same & _dominates("a", "b", objectives, 0.0), "left_anti")


def pareto(df: DataFrame, unit: str, key: str, objectives: list[str], epsilon: float = 1e-9, block: int = 256) -> DataFrame:
    """Rows of each unit that no other row of it dominates (all objectives are to be large; nulls dominate nothing and are not dominated).

    Fronts of blocks of about ``block`` rows come first and are merged to the unit's front; then all rows are held
    against that front alone. What a plainly dominated row beats by more than epsilon, the row that dominates it beats
    too, so the front is all that is needed. Rows meet their block and the front, never all rows of a unit.
    """
    points = df.select(unit, *objectives).distinct()
    sizes = points.groupBy(F.col(unit).alias("_unit")).agg(F.ceil(F.count("*") / block).alias("_blocks"))
    dealt = points.join(sizes, F.col(unit).eqNullSafe(F.col("_unit"))).select(unit, *objectives, F.pmod(F.xxhash64(*objectives), F.col("_blocks")).alias("_block"))
    local = _front(dealt, [unit, "_block"], objectives).drop("_block")
    front = _front(local, [unit], objectives)
    a, b = df.alias("a"), front.alias("b")
    return a.join(b, F.col(f"a.{unit}").eqNullSafe(F.col(f"b.{unit}")) & _dominates("a", "b", objectives, epsilon), "left_anti")


def gates(metrics: DataFrame, registry: DataFrame) -> DataFrame:
    """(unit, metric, value) against (metric, operator, threshold): passed or not, a missing value failing."""
    out = metrics.join(F.broadcast(registry), "metric")  # a row for each gate
    v, t = F.col("value"), F.col("threshold")
    held = F.when(F.col("operator") == ">=", v >= t).when(F.col("operator") == "<=", v <= t).when(F.col("operator") == "==", v == t)
    return out.withColumn("passed", F.coalesce(held, F.lit(False)))


def block_begins(time: str, gap_days: int) -> Column:
    """Whether a day is the first of its entity, of a year, or after a gap of more than ``gap_days``."""
    before = F.lag(time).over(Window.partitionBy("security_id").orderBy(time))
    return before.isNull() | (F.year(time) != F.year(before)) | (F.datediff(time, before) > gap_days)


def blocks(df: DataFrame, gap_days: int = 7) -> DataFrame:
    """Continuous blocks of an entity: split at a year's end and at gaps of more than ``gap_days``."""
    w = Window.partitionBy("security_id").orderBy("trading_date")
    df = df.withColumn("block", F.sum(block_begins("trading_date", gap_days).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    b = Window.partitionBy("security_id", "block")
    return df.withColumns({"pos": F.row_number().over(b.orderBy("trading_date")) - 1, "len": F.count("*").over(b)})


def block_offset(seed: int, length: str, *keys: Column | str) -> Column:
    """Offset in [1, length - 1] of a block, from the MD5 of (seed, keys, entity, block); 0 in a block of one row."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys], F.col("security_id").cast("string"), F.col("block").cast("string"))
    drawn = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return F.when(F.col(length) > 1, 1 + F.pmod(drawn, F.col(length) - 1)).otherwise(F.lit(0)).cast("int")


def shifted(placed: DataFrame, state: str, replicates: int, seed: int) -> DataFrame:
    """Rows of every replicate with the state of its block turned round by an offset in [1, len - 1].

    Offsets are hashes of (seed, replicate, entity, block), so they don't depend on partitioning; a block of one row stays.
    """
    rows = placed.select("security_id", "block", "pos", "len", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    rows = rows.withColumn("from", F.pmod(F.col("pos") - block_offset(seed, "len", "replicate"), F.col("len")))
    source = placed.select("security_id", "block", F.col("pos").alias("from"), F.col(state).alias("shifted"))
    return rows.join(source, ["security_id", "block", "from"])


def cluster_bootstrap(counts: DataFrame, cluster: str, sums: list[str], by: list[str], replicates: int, seed: int) -> DataFrame:
    """Sums over resampled clusters: (by, replicate, sums). Replicate -1 holds the sums of the clusters as they are.

    ``counts`` has a row for each cluster and ``by``. A replicate draws as many clusters as there are, with replacement, by the
    MD5 of (seed, replicate, draw); equal draws are counted first, so a replicate meets each cluster at most once and
    no draw depends on partitions.
    """
    spark = counts.sparkSession
    names = counts.select(cluster).distinct()
    names = names.withColumn("_i", F.row_number().over(Window.orderBy(cluster)) - 1)  # a row for each cluster
    n = names.count()
    drawn = spark.range(replicates * n).select(F.floor(F.col("id") / n).alias("replicate"), (F.col("id") % n).alias("_draw")) if n else spark.range(0).select(F.col("id").alias("replicate"), F.col("id").alias("_draw"))
    text = F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("_draw").cast("string"))
    pick = F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(max(n, 1)))
    times = drawn.groupBy("replicate", pick.alias("_i")).agg(F.count("*").alias("_w"))
    held = counts.join(names, cluster)
    resampled = held.join(times, "_i").groupBy(*by, "replicate").agg(*[F.sum(F.col(c) * F.col("_w")).alias(c) for c in sums])
    observed = counts.groupBy(*by).agg(F.lit(-1).cast("long").alias("replicate"), *[F.sum(c).alias(c) for c in sums])
    return observed.unionByName(resampled.select(*observed.columns))


def bootstrap_intervals(replicates: DataFrame, by: list[str], estimates: dict[str, Column], level: float = 0.95) -> DataFrame:
    """For each estimate: the observed value, percentile interval and how many replicates define it (those that don't are passed over)."""
    cells = F.array(*[F.struct(F.lit(n).alias("estimate"), e.cast("double").alias("value")) for n, e in estimates.items()])
    long = replicates.select(*by, "replicate", F.explode(cells).alias("c")).select(*by, "replicate", "c.*")
    drawn = F.when((F.col("replicate") >= 0) & ~F.isnan("value"), F.col("value"))
    return long.groupBy(*by, "estimate").agg(
        F.max(F.when(F.col("replicate") < 0, F.col("value"))).alias("observed"), F.percentile(drawn, (1 - level) / 2).alias("low"), F.percentile(drawn, (1 + level) / 2).alias("high"),
        F.count(drawn).alias("n_defined"), F.count_if(F.col("replicate") >= 0).alias("n_replicates"),
    )
