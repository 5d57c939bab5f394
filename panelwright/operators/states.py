"""Threshold states, confirmation over consecutive observations, and intervals."""

from __future__ import annotations

import hashlib
import itertools
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.functions.conventions import chain_and, finite, meets

WEAK_DELTA = 0.10


def indicator_states(scores: DataFrame, qs: list[float]) -> DataFrame:
    """A row for each score and q: active where score >= 1 - q; null where the score is not valid or not finite."""
    out = scores.withColumn("q", F.explode(F.array(*map(F.lit, qs))))
    return out.withColumn("active", active_state(F.col("q")))


def active_state(q: Column, of: str = "") -> Column:
    """``of``: the name, with a point, of the struct that holds the score; none for columns."""
    score = F.col(f"{of}score")
    return F.when((F.col(f"{of}validity_status") == "valid") & finite(score), meets(score, 1 - q))


def dimension_states(scores: DataFrame, qs: list[float], delta: float = WEAK_DELTA) -> DataFrame:
    """Weak state of a dimension: mean >= 1 - q and least component >= 1 - q - delta; null where one is not valid or not finite."""
    out = scores.withColumn("q", F.explode(F.array(*map(F.lit, qs))))
    return out.withColumn("active", weak_state(F.col("q"), delta))


def weak_state(q: Column, delta: float = WEAK_DELTA, of: str = "") -> Column:
    """``of``: the name, with a point, of the struct that holds the score; none for columns."""
    mean, least = F.col(f"{of}score_mean"), F.col(f"{of}score_min")
    ready = (F.col(f"{of}validity_status") == "valid") & finite(mean) & finite(least)
    return F.when(ready, meets(mean, 1 - q) & meets(least, 1 - q - delta))


def dimension_wide(states: DataFrame, dimensions: list[str], keys: list[str]) -> DataFrame:
    """One row a key with a three-valued column for each dimension."""
    return states.groupBy(*keys).agg(*[F.bool_or(F.when(F.col("dimension") == d, F.col("active"))).alias(d) for d in dimensions])


def nested_states(wide: DataFrame, dimensions: list[str]) -> DataFrame:
    """Chain of states s1, s2, ...: each adds a dimension by an ordered AND."""
    for k, d in enumerate(dimensions, 1):
        wide = wide.withColumn(f"s{k}", F.col(d) if k == 1 else chain_and(F.col(f"s{k - 1}"), F.col(d)))
    return wide


def exclusive_layer(nested: DataFrame, dimensions: list[str]) -> DataFrame:
    """Longest true prefix of the chain as a label, NONE for a false first state, else UNKNOWN."""
    label = F.when(F.col("s1").isNull(), "UNKNOWN").when(~F.col("s1"), "NONE")
    for k in range(1, len(dimensions) + 1):  # the longest stands outermost
        name = "".join(dimensions[:k]) + ("_ONLY" if k == 1 else "")
        label = F.when(F.col(f"s{k}"), name).otherwise(label)
    return nested.withColumn("layer", label)


def nesting_violations(n: int) -> Column:
    """Whether some state is true though the one before it is not."""
    bad = F.lit(False)
    for k in range(2, n + 1):
        bad = bad | (F.col(f"s{k}").eqNullSafe(True) & ~F.col(f"s{k - 1}").eqNullSafe(True))
    return bad


def streaks(df: DataFrame, keys: list[str], state: str = "raw_state", time: str = "trading_date", ready: Column | None = None) -> DataFrame:
    """Run length of ready, true rows (0 where false, null where not ready), with the run's number and first date; all over one sort."""
    ready = F.col(state).isNotNull() if ready is None else ready & F.col(state).isNotNull()
    kept, w = df.columns, Window.partitionBy(*keys).orderBy(time)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumns({"_ready": ready, "_on": F.coalesce(ready & F.col(state), F.lit(False))})
    df = df.withColumns({"_begins": F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False)), "_at": F.row_number().over(w)})
    begins = lambda c: F.when(F.col("_begins"), F.col(c))
    df = df.withColumns({"_run": F.count(begins("_at")).over(upto), "_first": F.max(begins("_at")).over(upto), "_start": F.max(begins(time)).over(upto)})
    on = F.col("_on")
    return df.select(
        *kept, F.when(on, F.col("_run")).alias("run"), F.when(on, F.col("_at") - F.col("_first") + 1).when(F.col("_ready"), F.lit(0)).alias("streak"),
        F.when(on, F.col("_start")).alias("run_start"),
    )


def confirm(df: DataFrame, ks: list[int], keys: list[str], time: str = "trading_date") -> DataFrame:
    """A row for each k: confirmed from the k-th row of a run on, and the date of that row."""
    out = df.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    run = Window.partitionBy(*keys, "k", "run")
    at = F.max(F.when(F.col("streak") == F.col("k"), F.col(time))).over(run)
    confirmed = F.when(F.col("streak").isNotNull(), F.col("streak") >= F.col("k"))
    return out.withColumns({"confirmed": confirmed, "confirmation_date": F.when(F.col("run").isNotNull(), at)})


def intervals(df: DataFrame, keys: list[str], state: str = "raw_state", time: str = "trading_date") -> DataFrame:
    """Confirmed runs: raw start, confirmation, end (null while open), durations, and why they ended.

    What follows a run's last row is seen by ``lead`` on that row, so no second pass is needed.
    """
    order = Window.partitionBy(*keys).orderBy(time)
    df = df.withColumns({"_next": F.lead(time).over(order), "_next_state": F.lead(state).over(order), "_next_status": F.lead("validity_status").over(order)})
    last = F.struct(time, "_next", "_next_state", "_next_status")
    runs = df.where(F.col("run").isNotNull()).groupBy(*keys, "run").agg(
        F.min(time).alias("raw_start_date"), F.min(F.when(F.col("confirmed"), F.col(time))).alias("confirmation_date"),
        F.max(last).alias("_last"), F.count("*").alias("duration_raw_days"), F.count_if("confirmed").alias("duration_confirmed_days"),
    ).where(F.col("confirmation_date").isNotNull())
    following = F.col("_last._next")
    reason = (
        F.when(following.isNull(), "end_of_input_open").when(F.col("_last._next_status") != "valid", F.concat(F.lit("state_"), F.col("_last._next_status")))
        .when(F.col("_last._next_state") == F.lit(False), "state_false").otherwise("state_unknown")
    )
    return runs.select(
        *keys, F.row_number().over(Window.partitionBy(*keys).orderBy("raw_start_date")).alias("interval_no"),
        "raw_start_date", "confirmation_date", F.when(following.isNotNull(), F.col(f"_last.{time}")).alias("interval_end_date"),
        F.coalesce(following, F.col(f"_last.{time}")).alias("last_observed_date"), "duration_raw_days", "duration_confirmed_days",
        following.isNull().alias("is_open"), reason.alias("termination_reason"),
    )


def wide_streaks(df: DataFrame, series: dict[str, str], entity: str = "security_id", time: str = "trading_date", more: tuple[str, ...] = ()) -> DataFrame:
    """``streaks`` of several series that stand side by side: <name>_streak of each, from one sort of the entities' days that carries the states and ``more`` alone."""
    w = Window.partitionBy(entity).orderBy(time)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.select(entity, time, *more, *dict.fromkeys(series.values())).withColumn("_place", F.row_number().over(w))
    before = {f"_off{i}": F.max(F.when(~F.coalesce(F.col(state), F.lit(False)), F.col("_place"))).over(upto) for i, state in enumerate(series.values())}
    out = {f"{name}_streak": F.when(F.col(state).isNotNull(), F.col("_place") - F.coalesce(F.col(f"_off{i}"), F.lit(0))) for i, (name, state) in enumerate(series.items())}
    return df.withColumns(before).withColumns(out).drop(*before)


def wide_intervals(df: DataFrame, series: dict[str, tuple[str, str, int]], label: str, entity: str = "security_id", time: str = "trading_date", notes: dict[str, str] | None = None) -> DataFrame:
    """``intervals`` of several series that stand side by side: ``series`` gives each one's columns of state and status, and its k.

    ``notes`` names a column of each series whose value on the day after an interval stands in ``note``.
    All run over one sort of the entities' days; a day is opened to its series only where a confirmed run ends, so no series is dealt or sorted again.
    """
    w = Window.partitionBy(entity).orderBy(time)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells, edges, runs, met, found = {}, {}, {}, {}, []
    for i, (name, (state, status, k)) in enumerate(series.items()):
        on, begins, first = F.col(f"_on{i}"), F.col(f"_begins{i}"), F.col(f"_first{i}")
        why = F.when(F.col(status) != "valid", F.concat(F.lit("state_"), F.col(status))).when(F.col(state) == F.lit(False), "state_false").otherwise("state_unknown")
        cells |= {f"_on{i}": F.coalesce(F.col(state), F.lit(False)), f"_why{i}": why}
        edges |= {f"_begins{i}": on & ~F.coalesce(F.lag(on).over(w), F.lit(False)), f"_ends{i}": on & ~F.coalesce(F.lead(on).over(w), F.lit(False)), f"_then{i}": F.lead(f"_why{i}").over(w)}
        if notes:
            cells[f"_note{i}"], edges[f"_told{i}"] = F.col(notes[name]), F.lead(f"_note{i}").over(w)
        runs |= {f"_first{i}": F.max(F.when(begins, F.col("_place"))).over(upto), f"_start{i}": F.max(F.when(begins, F.col(time))).over(upto)}
        length = F.col("_place") - first + 1
        met |= {f"_met{i}": F.max(F.when(on & (length == k), F.col(time))).over(upto)}
        end = F.struct(
            F.lit(name).alias(label), F.col(f"_start{i}").alias("raw_start_date"), F.col(f"_met{i}").alias("confirmation_date"), length.cast("long").alias("duration_raw_days"),
            (length - k + 1).cast("long").alias("duration_confirmed_days"), F.coalesce(F.col(f"_then{i}"), F.lit("end_of_input_open")).alias("termination_reason"),
            *([F.col(f"_told{i}").alias("note")] if notes else []),
        )
        found.append(F.when(F.col(f"_ends{i}") & (length >= k), end))
    df = df.select(entity, time, *[c.alias(n) for n, c in cells.items()])
    df = df.withColumns({"_place": F.row_number().over(w), "_next": F.lead(time).over(w), **edges}).withColumns(runs).withColumns(met)
    rows = df.select(entity, time, "_next", F.explode(F.array_compact(F.array(*found))).alias("r"))
    following = F.col("_next")
    return rows.select(
        entity, f"r.{label}", F.row_number().over(Window.partitionBy(entity, f"r.{label}").orderBy("r.raw_start_date")).alias("interval_no"),
        "r.raw_start_date", "r.confirmation_date", F.when(following.isNotNull(), F.col(time)).alias("interval_end_date"), F.coalesce(following, F.col(time)).alias("last_observed_date"),
        "r.duration_raw_days", "r.duration_confirmed_days", following.isNull().alias("is_open"), "r.termination_reason", *(["r.note"] if notes else []),
    )


def parameter_grid(spark: SparkSession, windows: list[int], qs: list[float], ks: list[int]) -> DataFrame:
    """All combinations of the parameters with an id and a content hash."""
    rows = []
    for w, q, k in itertools.product(windows, qs, ks):
        name = f"W{w}_q{round(q * 10_000)}_K{k}"
        rows.append((name, w, q, k, hashlib.sha256(json.dumps({"K": k, "W": w, "q_bp": round(q * 10_000)}, sort_keys=True).encode()).hexdigest()))
    return spark.createDataFrame(rows, "config_id string, window int, q double, k int, config_hash string")


def long_states(df: DataFrame, states: list[str], keys: list[str]) -> DataFrame:
    """Wide states to one row each."""
    return df.unpivot(keys, states, "state_name", "raw_state")


def grid_coverage(found: DataFrame, grid: DataFrame, key: str) -> DataFrame:
    """Keys of the grid that have no rows, and keys with rows that the grid lacks."""
    lacking = grid.select(key).join(found.select(key).distinct(), key, "left_anti").withColumn("problem", F.lit("missing"))
    alien = found.select(key).distinct().join(grid.select(key), key, "left_anti").withColumn("problem", F.lit("unexpected"))
    return lacking.unionByName(alien)
