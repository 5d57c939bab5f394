"""Profiles of states, intervals, gaps and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.conventions import PANEL, STATUSES, Panel, finite, ratio
from panelwright.operators.selection import quantiles
from panelwright.sources.scratch import written

DURATIONS = {f"q{round(q * 100):02d}": q for q in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)}
#: Windows that each kind of flag is counted over, and those that must be full for full capacity.
CAPACITY = {"price": (15, 20, 21, 60, 80), "participation": (20, 60, 80), "trend": (20, 21, 60)}
FULL = {"price": 80, "participation": 80, "trend": 60}


def state_days(daily: DataFrame, by: list[str], registry: DataFrame) -> DataFrame:
    """Days by status, days by raw and by confirmed state, entities and years where they are true; zeros for registered groups without days."""
    counts = {"n_days": F.count("*")} | {f"n_{s}": F.count_if(F.col("validity_status") == s) for s in STATUSES}
    for name, c in (("raw", F.col("raw_state")), ("confirmed", F.col("confirmed"))):
        counts |= {f"n_{name}_true": F.count_if(c), f"n_{name}_false": F.count_if(~c), f"n_{name}_null": F.count_if(c.isNull())}
        counts |= {f"n_{name}_entities": F.countDistinct(F.when(c, F.col("security_id"))), f"n_{name}_years": F.countDistinct(F.when(c, F.year("trading_date")))}
    found = daily.groupBy(*by).agg(*[c.alias(n) for n, c in counts.items()])
    return registry.join(found, by, "left").fillna(0, list(counts))


def interval_durations(intervals: DataFrame, k: str = "k") -> DataFrame:
    """Confirmed lengths of each ``k`` with exact quantiles, single days, open ones, delay, and intervals that contradict themselves."""
    own = written(intervals.withColumn("_days", F.col("duration_confirmed_days").cast("double")), "interval-durations")
    late = F.datediff("confirmation_date", "raw_start_date")
    single, opened = F.count_if(F.col("_days") == 1), F.count_if("is_open")
    sums = own.groupBy(k).agg(
        F.count("*").alias("n_intervals"), F.sum("duration_confirmed_days").alias("total_days"), F.avg("_days").alias("mean"), F.stddev_samp("_days").alias("std"), F.min("_days").alias("least"), F.max("_days").alias("greatest"),
        single.alias("n_single"), ratio(single, F.count("*")).alias("fragment_rate"), opened.alias("n_open"), ratio(opened, F.count("*")).alias("open_ratio"), F.avg(late.cast("double")).alias("mean_delay"), (F.col(k) - 1).cast("long").alias("delay_rows"),
        F.count_if(F.col("duration_raw_days") - F.col("duration_confirmed_days") != F.col(k) - 1).alias("n_length_mismatch"), F.count_if(late < 0).alias("n_early"),
    )
    return sums.join(quantiles(own, [k], "_days", DURATIONS).drop("n"), k)


def terminations(intervals: DataFrame, by: list[str]) -> DataFrame:
    """Intervals by reason of their end, and the reason's share of the group's."""
    out = intervals.groupBy(*by, "termination_reason").agg(F.count("*").alias("n"))
    total = out.groupBy(*by).agg(F.sum("n").alias("_all"))
    return out.join(total, by).withColumn("share", ratio(F.col("n"), F.col("_all"))).drop("_all")


def gap_counts(gaps: DataFrame, by: list[str]) -> DataFrame:
    return gaps.groupBy(*by).agg(F.count("*").alias("n_gaps"))


def gap_securities(gaps: DataFrame, intervals: DataFrame) -> DataFrame:
    """For each entity and type: gaps, first and last day, consecutive intervals and the longest of them."""
    keys = ["security_id", "gap_type"]
    days = gaps.groupBy(*keys).agg(F.count("*").alias("n_gaps"), F.min("trading_date").alias("first_date"), F.max("trading_date").alias("last_date"))
    runs = intervals.groupBy(*keys).agg(F.count("*").alias("n_intervals"), F.max("n_days").alias("longest"))
    return days.join(runs, keys, "left").fillna(0, ["n_intervals", "longest"])


def gap_overlaps(gaps: DataFrame, types: list[str]) -> DataFrame:
    """For each key the gap types that meet there, as a sorted list, a count and flags."""
    own = gaps.groupBy("security_id", "trading_date").agg(F.array_sort(F.collect_set("gap_type")).alias("_types"))  # a few types
    flags = [F.array_contains("_types", t).alias(f"has_{t}") for t in types]
    return own.select("security_id", "trading_date", F.array_join("_types", "+").alias("gap_types"), F.size("_types").alias("n_types"), *flags)


def window_counts(df: DataFrame, panel: Panel = PANEL) -> DataFrame:
    """Usable rows among the last n, by kind of flag and n, and whether the longest windows are full; all over one sort of the panel."""
    prices = [F.col(f"adjusted_{c}") for c in ("open", "high", "low", "close")]
    good = reduce(lambda a, b: a & b, map(finite, prices)) & (F.least(*prices) > 0) & (F.col("adjusted_high") >= F.col("adjusted_low"))
    flags = {"price": good, "participation": finite(F.col("volume_shares")) & finite(F.col("amount_yuan")) & (F.least("volume_shares", "amount_yuan") >= 0), "trend": finite(F.col("adjusted_close")) & (F.col("adjusted_close") > 0)}
    df = df.withColumns({f"_{n}": F.coalesce(c, F.lit(False)).cast("int") for n, c in flags.items()})
    out = df.select(panel.entity, panel.time, *[F.sum(f"_{n}").over(panel.last(size)).alias(f"{n}_{size}") for n, sizes in CAPACITY.items() for size in sizes])
    full = F.lit(True)
    for n, size in FULL.items():
        full = full & (F.col(f"{n}_{size}") >= size)
    return out.withColumn("capacity", F.when(full, "full").otherwise("insufficient_history"))
