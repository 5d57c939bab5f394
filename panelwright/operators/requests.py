"""Dynamic requests: chosen dimensions, a threshold for each, and a confirmation length, for many requests in one job."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.functions.conventions import finite, ratio, severity, worst_status
from panelwright.operators.states import WEAK_DELTA, intervals, streaks, weak_state, wide_intervals, wide_streaks

TIME = "trading_date"
#: What the paths of a day's prices are made of.
PRICES = ("adjusted_close", "adjusted_high", "adjusted_low")


def canonical_request(thresholds: dict[str, int], k: int) -> tuple[str, str]:
    """Canonical text of a request (dimensions in order, thresholds in basis points) and its hash."""
    text = json.dumps({"dimensions": sorted(thresholds.items()), "k": k}, separators=(",", ":"))
    return text, hashlib.sha256(text.encode()).hexdigest()


def request_table(spark: SparkSession, requests: dict[str, tuple[dict[str, int], int]]) -> DataFrame:
    """A row for each dimension of each request."""
    rows = [(name, d, q, k, len(t), canonical_request(t, k)[1]) for name, (t, k) in requests.items() for d, q in sorted(t.items())]
    return spark.createDataFrame(rows, "request_id string, dimension string, q_bp int, k int, n_dimensions int, request_hash string")


def dimension_states(scores: DataFrame, requests: DataFrame) -> DataFrame:
    """State of each dimension that a request names; reasons carry the dimension they come from.

    A valid score that is missing or not finite gives no state and a reason of its own.
    """
    out = scores.join(F.broadcast(requests), "dimension")  # a few rows a request
    return out.withColumns({"dimension_state": weak_state(F.col("q_bp") / 10_000), "reasons": _reasons(F.col("dimension"))})


def _reasons(dimension: Column, of: str = "") -> Column:
    """Why a dimension has no state, each reason under its name; ``of``: the name, with a point, of the struct that holds the score."""
    mean, least = F.col(f"{of}score_mean"), F.col(f"{of}score_min")
    codes = (
        F.when(F.col(f"{of}validity_status") != "valid", F.col(f"{of}reason_codes")).when(mean.isNull() | least.isNull(), F.array(F.lit("score_missing")))
        .when(~(finite(mean) & finite(least)), F.array(F.lit("score_non_finite"))).otherwise(F.array().cast("array<string>"))
    )
    return F.array_sort(F.array_distinct(F.transform(codes, lambda r: F.concat(dimension, F.lit("_"), r))))


def joint_columns(wide: DataFrame, requests: dict[str, tuple[dict[str, int], int]], more: tuple[str, ...] = ()) -> DataFrame:
    """``joint`` with the requests side by side: columns <request>_state, _status, _reasons and _failed (its false dimensions) of each day.

    Columns ``more`` stay. ``wide`` has a row for each day with a struct of each dimension's scores, so a day's dimensions meet without a shuffle.
    """
    cells, named = {}, {}
    for d in sorted({d for thresholds, _ in requests.values() for d in thresholds}):
        cells |= {f"_{d}_reasons": _reasons(F.lit(d), f"{d}."), f"_{d}_rank": severity(F.col(f"{d}.validity_status"))}
    for name, (thresholds, _) in requests.items():
        named |= {(d, q): f"_{d}_{q}" for d, q in thresholds.items()}
    rows = wide.withColumns(cells | {c: weak_state(F.lit(q) / 10_000, of=f"{d}.") for (d, q), c in named.items()})
    out = {}
    for name, (thresholds, _) in requests.items():
        order = sorted(thresholds.items())
        states, ranks = [F.col(named[x]) for x in order], [F.col(f"_{d}_rank") for d in sorted(thresholds)]
        known = reduce(Column.__and__, [x.isNotNull() for x in states])
        out |= {
            f"{name}_state": F.when(known, reduce(Column.__and__, states)), f"{name}_status": worst_status(F.greatest(*ranks) if len(ranks) > 1 else ranks[0]),
            f"{name}_reasons": F.concat(*[F.col(f"_{d}_reasons") for d in sorted(thresholds)]),
            f"{name}_failed": F.concat_ws("+", *[F.when(~F.col(named[d, q]), F.lit(d)) for d, q in order]),
        }
    return rows.select("security_id", TIME, *more, *[c.alias(name) for name, c in out.items()])


def joint(wide: DataFrame, requests: dict[str, tuple[dict[str, int], int]]) -> DataFrame:
    """All dimensions of a request together: true only if all are, null if some are unknown, worst status, ordered reasons."""
    days = [
        F.struct(F.lit(name).alias("request_id"), F.lit(k).alias("k"), F.col(f"{name}_state").alias("raw_state"), F.col(f"{name}_status").alias("validity_status"), F.col(f"{name}_reasons").alias("reason_codes"))
        for name, (_, k) in requests.items()
    ]
    rows = joint_columns(wide, requests).select("security_id", TIME, F.explode(F.array(*days)).alias("r"))
    return rows.select("r.request_id", "r.k", "security_id", TIME, "r.raw_state", "r.validity_status", "r.reason_codes")


def joint_confirm(states: DataFrame) -> DataFrame:
    """Streaks and confirmation by each request's own k."""
    out = streaks(states, ["request_id", "security_id"])
    confirmed = F.when(F.col("streak").isNotNull(), F.col("streak") >= F.col("k"))
    event = F.coalesce(F.col("streak") == F.col("k"), F.lit(False))
    return out.withColumns({"confirmed": confirmed, "confirmation_event": event})


def joint_intervals(daily: DataFrame) -> DataFrame:
    return intervals(daily, ["request_id", "security_id"])


def request_intervals(wide: DataFrame, requests: dict[str, tuple[dict[str, int], int]]) -> DataFrame:
    """``joint_intervals`` from the days' scores: the requests stay side by side until a confirmed run ends."""
    found = wide_intervals(joint_columns(wide, requests), {name: (f"{name}_state", f"{name}_status", k) for name, (_, k) in requests.items()}, "request_id")
    return found.select("request_id", *[c for c in found.columns if c != "request_id"])


def request_days(wide: DataFrame, requests: dict[str, tuple[dict[str, int], int]]) -> DataFrame:
    """States, streaks and confirmation of ``joint_confirm``, without reasons: the requests are told apart after one pass over the days' scores."""
    rows = wide_streaks(joint_columns(wide, requests), {name: f"{name}_state" for name in requests})
    days = [F.struct(F.lit(name).alias("request_id"), F.lit(k).alias("k"), F.col(f"{name}_state").alias("raw_state"), F.col(f"{name}_streak").alias("streak")) for name, (_, k) in requests.items()]
    rows = rows.select("security_id", TIME, F.explode(F.array(*days)).alias("r")).select("r.request_id", "security_id", TIME, "r.raw_state", "r.k", "r.streak")
    return rows.withColumns({"confirmed": F.col("streak") >= F.col("k"), "confirmation_event": F.coalesce(F.col("streak") == F.col("k"), F.lit(False))})


def path_columns(horizons: tuple[int, ...]) -> dict[str, Column]:
    """Return after h rows, and best and worst excursion on the way, by forward windows."""
    w = Window.partitionBy("security_id").orderBy(TIME)
    close, cols = F.col("adjusted_close"), {}
    for h in horizons:
        ahead = w.rowsBetween(1, h)
        whole = F.count(F.lit(1)).over(ahead) == h
        cols[f"return_{h}"] = F.when(whole, ratio(F.lead("adjusted_close", h).over(w), close) - 1)
        cols[f"mfe_{h}"] = F.when(whole, ratio(F.max("adjusted_high").over(ahead), close) - 1)
        cols[f"mae_{h}"] = F.when(whole, ratio(F.min("adjusted_low").over(ahead), close) - 1)
    return cols


def path_metrics(anchors: DataFrame, prices: DataFrame, horizons: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """``path_columns`` from each anchor day."""
    cols = path_columns(horizons)
    return anchors.join(prices.withColumns(cols).select("security_id", TIME, *cols), ["security_id", TIME])


def request_paths(wide: DataFrame, requests: dict[str, tuple[dict[str, int], int]], horizons: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """``path_metrics`` from the day that confirms each interval of ``request_intervals``.

    ``wide`` has the prices beside a day's scores, so paths and confirmations stand over one sort and no day meets another table;
    as a run is confirmed once, the confirmations up to a day number its intervals.
    """
    cols, states = path_columns(horizons), {name: f"{name}_state" for name in requests}
    rows = wide_streaks(joint_columns(wide, requests, PRICES), states, more=PRICES)
    upto = Window.partitionBy("security_id").orderBy(TIME).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = {name: F.coalesce(F.col(f"{name}_state") & (F.col(f"{name}_streak") == k), F.lit(False)) for name, (_, k) in requests.items()}
    rows = rows.withColumns(cols | {f"{name}_no": F.count(F.when(c, 1)).over(upto).cast("int") for name, c in met.items()})
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(name).alias("request_id"), F.col(f"{name}_no").alias("interval_no"))) for name, c in met.items()]))
    return rows.select("security_id", TIME, F.explode(found).alias("r"), *cols).select("r.request_id", "security_id", "r.interval_no", TIME, *cols)


def response_checks(days: DataFrame, inner: str, outer: str) -> DataFrame:
    """Days (as ``joint_columns`` gives them) on which a stricter request holds though a looser one doesn't, and by how many days they differ."""
    a, b = (F.coalesce(F.col(f"{name}_state"), F.lit(False)) for name in (inner, outer))
    return days.agg(F.count_if(a & ~b).alias("n_violations"), F.count_if(b & ~a).alias("n_added"))


def interval_structure(found: DataFrame, keys: list[str]) -> DataFrame:
    """Distribution of intervals over entities: mean, median and greatest number, and confirmed days."""
    each = found.groupBy(*keys, "security_id").agg(F.count("*").cast("double").alias("n"), F.sum("duration_confirmed_days").alias("days"))
    return each.groupBy(*keys).agg(F.count("*").alias("n_entities"), F.avg("n").alias("mean_n"), F.percentile("n", 0.5).alias("median_n"), F.max("n").alias("max_n"), F.sum("days").alias("confirmed_days"))


def hash_sample(found: DataFrame, keys: list[str], identity: list[str], n: int) -> DataFrame:
    """The n rows of each key whose identity has the smallest SHA-256."""
    digest = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in [*keys, *identity]]), 256)
    ranked = found.withColumn("sample_hash", digest).withColumn("sample_no", F.row_number().over(Window.partitionBy(*keys).orderBy("sample_hash")))
    return ranked.where(F.col("sample_no") <= n)


def exit_category(found: DataFrame, states: DataFrame) -> DataFrame:
    """Why each interval ended: still open, quality, or which dimensions turned false on the day after."""
    failing = states.groupBy("request_id", "security_id", TIME).agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("dimension_state") == F.lit(False), F.col("dimension")))), "+").alias("failed"))
    out = found.withColumn(TIME, F.col("last_observed_date")).join(failing, ["request_id", "security_id", TIME], "left")
    category = F.when(F.col("is_open"), "right_censored").when(F.col("termination_reason") != "state_false", "quality").otherwise(F.concat(F.lit("false_"), F.col("failed")))
    return out.select(*found.columns, category.alias("exit_category"))


def request_exits(wide: DataFrame, requests: dict[str, tuple[dict[str, int], int]]) -> DataFrame:
    """``exit_category`` of ``request_intervals``: a day's false dimensions stand beside its states, so no interval meets a second table of days."""
    series = {name: (f"{name}_state", f"{name}_status", k) for name, (_, k) in requests.items()}
    out = wide_intervals(joint_columns(wide, requests), series, "request_id", notes={name: f"{name}_failed" for name in requests})
    category = F.when(F.col("is_open"), "right_censored").when(F.col("termination_reason") != "state_false", "quality").otherwise(F.concat(F.lit("false_"), F.col("note")))
    return out.select("request_id", *[c for c in out.columns if c not in ("request_id", "note")], category.alias("exit_category"))


def endpoint_margins(found: DataFrame, states: DataFrame) -> DataFrame:
    """Distance of each dimension's mean and least score to its thresholds on the last day of an interval."""
    q = F.col("q_bp") / 10_000
    margins = states.select("request_id", "security_id", TIME, "dimension", (F.col("score_mean") - (1 - q)).alias("main_margin"), (F.col("score_min") - (1 - q - WEAK_DELTA)).alias("weak_margin"))
    ends = found.where(~F.col("is_open")).select("request_id", "security_id", "interval_no", F.col("interval_end_date").alias(TIME))
    return ends.join(margins, ["request_id", "security_id", TIME])


def reentries(found: DataFrame, daily: DataFrame, thresholds: tuple[int, ...]) -> DataFrame:
    """After each exit: rows until the state is true again and until a quality break, judged at several horizons."""
    w = Window.partitionBy("request_id", "security_id").orderBy(F.desc(TIME))
    rows = daily.withColumn("_n", -F.row_number().over(w))
    ahead = w.rowsBetween(Window.unboundedPreceding, -1)  # from the end, so the frame only grows
    rows = rows.withColumns(
        {
            "_true": F.min(F.when(F.col("raw_state"), F.col("_n"))).over(ahead) - F.col("_n"), "_quality": F.min(F.when(F.col("raw_state").isNull(), F.col("_n"))).over(ahead) - F.col("_n"),
            "_left": F.count(F.lit(1)).over(ahead),
        }
    )
    ends = found.where("termination_reason = 'state_false'").select("request_id", "security_id", "interval_no", F.col("last_observed_date").alias(TIME))
    out = ends.join(rows.select("request_id", "security_id", TIME, "_true", "_quality", "_left"), ["request_id", "security_id", TIME])
    return _judged(out, thresholds)


def _judged(out: DataFrame, thresholds: tuple[int, ...]) -> DataFrame:
    """What became of each exit within each horizon, from the rows until the state is true (``_true``) or unknown (``_quality``) and those left."""
    out = out.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    t = F.col("threshold")
    soon, broken = F.coalesce(F.col("_true") <= t, F.lit(False)), F.coalesce(F.col("_quality") <= t, F.lit(False))
    first = F.coalesce(F.col("_true") < F.col("_quality"), F.col("_true").isNotNull())
    outcome = F.when(soon & first, "re_entered").when(broken, "interrupted").when(F.col("_left") < t, "insufficient").otherwise("none")
    return out.select("request_id", "security_id", "interval_no", "threshold", F.col("_true").alias("reentry_lag"), F.col("_quality").alias("quality_lag"), outcome.alias("outcome"))


def request_reentries(wide: DataFrame, requests: dict[str, tuple[dict[str, int], int]], thresholds: tuple[int, ...]) -> DataFrame:
    """``reentries`` of ``request_intervals`` from the days' scores: requests stay side by side, and no exit meets a second table of days.

    A day after a confirmed run on which the state is false is an exit; confirmations up to it number the interval. What follows is seen
    from the end of the same days, so frames only grow.
    """
    w = Window.partitionBy("security_id").orderBy(TIME)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy("security_id").orderBy(F.desc(TIME)).rowsBetween(Window.unboundedPreceding, -1)
    rows = wide_streaks(joint_columns(wide, requests), {name: f"{name}_state" for name in requests})
    seen, after, found = {}, {"_left": F.count(F.lit(1)).over(ahead)}, []
    for i, (name, (_, k)) in enumerate(requests.items()):
        state, streak = F.col(f"{name}_state"), F.col(f"{name}_streak")
        seen |= {f"_exit{i}": F.coalesce((state == F.lit(False)) & (F.lag(streak).over(w) >= k), F.lit(False)), f"_no{i}": F.count(F.when(streak == k, 1)).over(upto).cast("int")}
        after |= {f"_true{i}": F.min(F.when(state, F.col("_place"))).over(ahead), f"_null{i}": F.min(F.when(state.isNull(), F.col("_place"))).over(ahead)}
        lag = lambda c: (F.col(c) - F.col("_place")).cast("int")
        found.append(F.when(F.col(f"_exit{i}"), F.struct(F.lit(name).alias("request_id"), F.col(f"_no{i}").alias("interval_no"), lag(f"_true{i}").alias("_true"), lag(f"_null{i}").alias("_quality"))))
    rows = rows.withColumns(seen).withColumns(after)
    out = rows.select("security_id", "_left", F.explode(F.array_compact(F.array(*found))).alias("r")).select("security_id", "_left", "r.*")
    return _judged(out, thresholds)
