"""Chains of dimensions with the status and reasons of what blocks them, and whole grids of parameters over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.states import confirm, intervals, streaks, weak_state

NO_BLOCKER = "valid_no_blocker"


def chain_states(rows: DataFrame, dimensions: list[str], keys: list[str]) -> DataFrame:
    """(keys, dimension, active, validity_status, reason_codes) -> one row for each key with the states s1, s2, ... of the chain, the status and
    reasons of each, the first dimension that is not true, and the exclusive layer with its status and reasons.

    The first dimension that is not true decides every state from its own on: a false one makes them false and valid, one without
    a state makes them null with its status and reasons. A dimension without a row is ``unknown`` for ``missing_dimension_state``. The layer is the
    prefix of true dimensions before a false one, else the status in capitals.
    """
    row = F.struct("active", "validity_status", "reason_codes")
    wide = rows.groupBy(*keys).agg(*[F.max_by(row, F.when(F.col("dimension") == d, F.lit(1))).alias(f"_{d}") for d in dimensions])
    held = {d: F.coalesce(F.col(f"_{d}.active"), F.lit(False)) for d in dimensions}
    stop = F.lit(len(dimensions) + 1)
    for k in range(len(dimensions), 0, -1):
        stop = F.when(~held[dimensions[k - 1]], F.lit(k)).otherwise(stop)
    wide = wide.withColumn("_stop", stop)

    def at_stop(of) -> Column:
        out = F.lit(None)
        for k, d in enumerate(dimensions, 1):
            out = F.when(F.col("_stop") == k, of(d)).otherwise(out)
        return out

    bad = lambda d: F.when(F.col(f"_{d}").isNull() | (F.col(f"_{d}.validity_status") == "valid"), "unknown").otherwise(F.col(f"_{d}.validity_status"))
    why = lambda d: F.when(F.col(f"_{d}").isNull(), F.array(F.lit("missing_dimension_state"))).otherwise(F.array_distinct(F.col(f"_{d}.reason_codes")))
    wide = wide.withColumns({"_unknown": F.coalesce(at_stop(lambda d: F.col(f"_{d}.active").isNull()), F.lit(False)), "_status": at_stop(bad), "_reasons": at_stop(why), "blocking": at_stop(lambda d: F.lit(d))})
    out = {}
    for k in range(1, len(dimensions) + 1):
        blocked = (F.col("_stop") <= k) & F.col("_unknown")
        out[f"s{k}"] = F.when(F.col("_stop") > k, True).when(~F.col("_unknown"), False)
        out[f"s{k}_status"] = F.when(blocked, F.col("_status")).otherwise("valid")
        out[f"s{k}_reasons"] = F.when(blocked, F.col("_reasons")).otherwise(F.array(F.lit(NO_BLOCKER)))
    names = ["NONE", *["".join(dimensions[:k]) + "_ONLY" for k in range(1, len(dimensions))], "".join(dimensions)]
    layer = F.when(F.col("_unknown"), F.upper("_status")).otherwise(F.element_at(F.array(*map(F.lit, names)), F.col("_stop")))
    last = f"s{len(dimensions)}"
    return wide.withColumns(out).select(*keys, *out, "blocking", layer.alias("layer"), F.col(f"{last}_status").alias("layer_status"), F.col(f"{last}_reasons").alias("layer_reasons"))


def grid_states(scores: DataFrame, dimensions: list[str], qs: list[float], keys: list[str]) -> DataFrame:
    """Long states of every q: (keys, q, state_name, raw_state, validity_status); ``keys`` name a day of an entity, a window if there are several."""
    rows = scores.withColumn("q", F.explode(F.array(*map(F.lit, qs)))).withColumn("active", weak_state(F.col("q")))
    wide = chain_states(rows, dimensions, [*keys, "q"])
    cells = F.array(*[F.struct(F.lit(f"s{k}").alias("state_name"), F.col(f"s{k}").alias("raw_state"), F.col(f"s{k}_status").alias("validity_status")) for k in range(1, len(dimensions) + 1)])
    return wide.select(*keys, "q", F.explode(cells).alias("c")).select(*keys, "q", "c.*")


def grid_confirmed(states: DataFrame, ks: list[int], keys: list[str]) -> DataFrame:
    """Streaks of every series of ``keys`` once, confirmed by every k."""
    return confirm(streaks(states, keys), ks, keys)


def grid_intervals(confirmed: DataFrame, keys: list[str]) -> DataFrame:
    return intervals(confirmed, [*keys, "k"])


def config_id(window: Column, q: Column, k: Column) -> Column:
    """The name that ``parameter_grid`` gives a combination."""
    return F.concat(F.lit("W"), window.cast("string"), F.lit("_q"), F.round(q * 10_000).cast("long").cast("string"), F.lit("_K"), k.cast("string"))
