"""Strictly-past percentile scores and what is made of them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from panelwright.functions.conventions import PANEL, Panel, finite, severity, worst_status
from panelwright.operators.sliding import places_follow


def past_ranks(values: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """For each value but NaN: how many of the ``window`` values before it there are, twice those below it plus those
    equal to it, and the places of the first and last of them. NaN values are passed over (0, 0, -1, -1)."""
    out = tuple(np.full(len(values), x, np.int32) for x in (0, 0, -1, -1))
    at = np.flatnonzero(~np.isnan(values))
    held, order = values[at], np.arange(len(at))
    out[0][at] = np.minimum(order, window)
    out[2][at[1:]], out[3][at[1:]] = at[np.maximum(order[1:] - window, 0)], at[:-1]
    for begin in range(window, len(at), 4096):  # rows with a whole window, some at a time
        here = held[begin - window : begin + 4096]
        past, now = np.lib.stride_tricks.sliding_window_view(here, window)[: len(here) - window], here[window:, None]
        out[1][at[begin : begin + 4096]] = 2 * (past < now).sum(axis=1) + (past == now).sum(axis=1)
    return out


class _Past:
    """Ranks of one column, batch after batch of rows that come series by series; holds the last values of the open series alone."""

    def __init__(self, window: int) -> None:
        self.window, self.values, self.times = window, np.empty(0), None

    def take(self, series: np.ndarray, values: np.ndarray, times: pa.Array) -> list[pa.Array]:
        """``series`` numbers the series of the rows from 0, the one that the batch before left open."""
        at, kept = np.flatnonzero(~np.isnan(values)), len(self.values)
        held = np.concatenate([self.values, values[at]])
        when = times.take(pa.array(at)) if self.times is None else pa.concat_arrays([self.times, times.take(pa.array(at))])
        of = np.concatenate([np.zeros(kept, np.int64), series[at]])
        place = np.arange(len(held))
        n = np.minimum(place - np.searchsorted(of, of), self.window)
        counted, twice, first, last = np.zeros(len(values), np.int32), np.zeros(len(values), np.int32), np.full(len(values), -1), np.full(len(values), -1)
        counted[at] = n[kept:]
        some = place[kept:][n[kept:] > 0]
        first[at[some - kept]], last[at[some - kept]] = some - n[some], some - 1
        whole = place[kept:][n[kept:] == self.window]
        if len(whole):
            past = np.lib.stride_tricks.sliding_window_view(held, self.window)
            for begin in range(0, len(whole), 1024):  # some at a time
                some = whole[begin : begin + 1024]
                before, now = past[some - self.window], held[some, None]
                twice[at[some - kept]] = 2 * np.count_nonzero(before < now, axis=1) + np.count_nonzero(before == now, axis=1)
        tail = max(np.searchsorted(of, series[-1]), len(held) - self.window)
        self.values, self.times = held[tail:].copy(), when.slice(tail)
        return [pa.array(counted), pa.array(twice), *[when.take(pa.array(x, mask=x < 0)) for x in (first, last)]]


def _ranks_udf(windows: list[int], time: T.DataType):
    """(place of a row in its series from 1, time, values...) -> for each column how many past values there are, twice the midrank of
    the row's own among them, and the times of the first and last of them.

    Rows are to come series by series in order of their place, as a window that numbers them leaves them; anything else is refused.
    """
    fields = [T.StructField(f"{name}{k}", kind) for k in range(len(windows)) for name, kind in (("n", T.IntegerType()), ("twice", T.IntegerType()), ("begin", time), ("end", time))]

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        past, before = [_Past(window) for window in windows], 0
        for places, times, *values in batches:
            i = places.to_numpy(zero_copy_only=False)
            if not len(i):
                yield pa.StructArray.from_arrays([pa.array([], times.type if k % 4 > 1 else pa.int32()) for k in range(len(fields))], [f.name for f in fields])
                continue
            places_follow(i, before)
            before, series = i[-1], np.cumsum(i == 1)
            cells = [x for p, v in zip(past, values) for x in p.take(series, v.to_numpy(zero_copy_only=False).astype(np.float64), times)]
            yield pa.StructArray.from_arrays(cells, [f.name for f in fields])

    return arrow_udf(run, T.StructType(fields)).asNondeterministic()


def past_scores(df: DataFrame, names: list[str], window: int | dict[str, int], panel: Panel = PANEL, keys: tuple[str, ...] = (), order: tuple[str | Column, ...] = (), more: tuple[str, ...] = ()) -> DataFrame:
    """Each column of ``names``, a struct of value, validity_status and reason_codes, becomes a struct of its strict-past score; columns ``more`` stay.

    ``window`` is that of all columns, or of each by its name.

    All columns are ranked over one sort of the panel, by numpy over batches of rows that follow each other: a task holds a batch and
    the last ``window`` values of one series, whatever the length or number of series, and no row carries the values of its window.
    """
    w, length = Window.partitionBy(panel.entity, *keys).orderBy(panel.time, *order), window if isinstance(window, dict) else dict.fromkeys(names, window)
    ok = {c: (F.col(f"{c}.validity_status") == "valid") & finite(F.col(f"{c}.value")) for c in names}
    held = [F.when(ok[c], F.col(f"{c}.value").cast("double")) for c in names]
    # a frame that comes with the places of its rows, in order, is not sorted again
    ranked = (df if "_place" in df.columns else df.withColumn("_place", F.row_number().over(w))).withColumn("_past", _ranks_udf([length[c] for c in names], df.schema[panel.time].dataType)("_place", panel.time, *held))
    # told once a row, in columns of their own, however many cells are made of them
    ranked = ranked.withColumns({x: e for k, c in enumerate(names) for x, e in ((f"_ok{k}", ok[c]), (f"_n{k}", F.col(f"_past.n{k}")))})
    ranked = ranked.withColumns({f"_whole{k}": F.col(f"_ok{k}") & (F.col(f"_n{k}") == length[c]) for k, c in enumerate(names)})
    out, raw = [], F.lit("raw_metric_not_valid")
    for k, c in enumerate(names):
        of, n, valid, whole = F.col(f"{c}.validity_status"), F.col(f"_n{k}"), F.col(f"_ok{k}"), F.col(f"_whole{k}")
        status = F.when(whole, "valid").when(valid, "unknown").when(of == "valid", "unknown").otherwise(of)
        codes = (
            F.when(whole, F.array(F.lit("valid_no_blocker"))).when(valid, F.array(F.lit("insufficient_strict_past_history")))
            .otherwise(F.concat(F.array(raw), F.array_distinct(F.filter(f"{c}.reason_codes", lambda r: ~r.eqNullSafe(raw)))))
        )
        percentile = F.when(whole, F.col(f"_past.twice{k}") / 2 / length[c])
        cells = {
            "value": F.col(f"{c}.value"), "eligible": whole, "percentile": percentile, "score": 1 - percentile, "validity_status": status, "reason_codes": codes,
            "reference_count": F.when(valid, n).otherwise(F.lit(0)), "reference_start": F.col(f"_past.begin{k}"), "reference_end": F.col(f"_past.end{k}"),
        }
        out.append(F.struct(*[x.alias(name) for name, x in cells.items()]).alias(c))
    return ranked.select(panel.entity, panel.time, *keys, *more, *out)


def strict_past_percentile(df: DataFrame, window: int, panel: Panel = PANEL, keys: tuple[str, ...] = ()) -> DataFrame:
    """Midrank of ``value`` among the ``window`` valid values before it, and 1 minus that as ``score``.

    Rows without a valid value take no part in a later window and get their own status and reasons back; a value
    that is not finite is not valid. Rows of one time follow each other by value and status.
    """
    rows = df.select(panel.entity, panel.time, *keys, F.struct("value", "validity_status", "reason_codes").alias("of"))
    return past_scores(rows, ["of"], window, panel, keys, ("of.value", "of.validity_status")).select(panel.entity, panel.time, *keys, "of.*")


def map_indicator(df: DataFrame, names: dict[str, str], column: str = "indicator_id") -> DataFrame:
    """Rename indicators by a fixed map; names that it lacks stay."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return df.withColumn(column, F.coalesce(F.create_map(*pairs)[F.col(column)], F.col(column)))


def dimension_scores(long: DataFrame, components: int = 2, panel: Panel = PANEL) -> DataFrame:
    """(entity, time, dimension, score, validity_status, reason_codes) -> mean and min of a dimension's components.

    Both stand only if all components are valid; else the worst status and all reasons, each once.
    """
    out = long.groupBy(panel.entity, panel.time, "dimension").agg(
        F.avg("score").alias("mean"), F.min("score").alias("least"), F.count_if(F.col("validity_status") == "valid").alias("n"),
        F.max(severity(F.col("validity_status"))).alias("rank"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("validity_status") != "valid", F.col("reason_codes")))))).alias("reasons"),
    )
    whole = F.col("n") == components
    rank = F.when(whole, F.lit(0)).otherwise(F.greatest(F.col("rank"), F.lit(1)))
    return out.select(
        panel.entity, panel.time, "dimension", whole.alias("eligible"), F.when(whole, F.col("mean")).alias("score_mean"), F.when(whole, F.col("least")).alias("score_min"),
        worst_status(rank).alias("validity_status"), F.when(whole, F.array(F.lit("valid_no_blocker"))).otherwise(F.col("reasons")).alias("reason_codes"),
    )


def dimension_columns(wide: DataFrame, dimensions: dict[str, tuple[str, ...]], panel: Panel = PANEL, more: tuple[str, ...] = ()) -> DataFrame:
    """``dimension_scores`` of a panel whose scores stand side by side, as ``past_scores`` gives them: a struct for each dimension, from one row each; columns ``more`` stay."""
    out = []
    wide = wide.withColumns({f"_whole_{d}": reduce(Column.__and__, [F.col(f"{n}.eligible") for n in names]) for d, names in dimensions.items()})
    for d, names in dimensions.items():
        whole = F.col(f"_whole_{d}")
        rank = F.greatest(F.lit(1), *[severity(F.col(f"{n}.validity_status")) for n in names])
        codes = [F.when(F.col(f"{n}.validity_status") != "valid", F.col(f"{n}.reason_codes")).otherwise(F.array().cast("array<string>")) for n in names]
        scores = [F.col(f"{n}.score") for n in names]
        cells = {
            "eligible": whole, "score_mean": F.when(whole, reduce(Column.__add__, scores) / len(names)), "score_min": F.when(whole, F.least(*scores)),
            "validity_status": F.when(whole, "valid").otherwise(worst_status(rank)),
            "reason_codes": F.when(whole, F.array(F.lit("valid_no_blocker"))).otherwise(F.array_sort(F.array_distinct(F.concat(*codes)))),
        }
        out.append(F.struct(*[x.alias(name) for name, x in cells.items()]).alias(d))
    return wide.select(panel.entity, panel.time, *more, *out)


def common_sample(long: DataFrame, indicators: int, windows: int, panel: Panel = PANEL) -> DataFrame:
    """Days on which every indicator is eligible for every window."""
    out = long.groupBy(panel.entity, panel.time).agg(F.count_if("eligible").alias("n_eligible"), F.array_sort(F.collect_set(F.when(F.col("eligible"), F.col("window")))).alias("windows"))
    return out.select(panel.entity, panel.time, "n_eligible", (F.col("n_eligible") == indicators * windows).alias("common"), "windows")


def score_release(spine: DataFrame, scores: DataFrame, dimensions: list[str], panel: Panel = PANEL) -> DataFrame:
    """Every spine day for every dimension: the score, or a blocked placeholder where the day has none."""
    each = spine.withColumn("dimension", F.explode(F.array(*map(F.lit, dimensions))))
    out = each.join(scores.select(panel.entity, panel.time, "dimension", "score_mean", "score_min", F.col("validity_status").alias("_status")), [panel.entity, panel.time, "dimension"], "left")
    there = F.col("_status").isNotNull()
    return out.select(
        panel.entity, panel.time, "dimension", "score_mean", "score_min",
        F.when(there, F.col("_status")).otherwise("blocked").alias("release_status"), (~there).alias("placeholder"),
    )


def score_profile(scores: DataFrame, by: Column | str) -> DataFrame:
    """Counts by status and quantiles of the scores."""
    return scores.groupBy(by).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("validity_status") == "valid").alias("n_valid"),
        F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.percentile("score", 0.25), 6).alias("q25"),
        F.round(F.percentile("score", 0.5), 6).alias("q50"), F.round(F.percentile("score", 0.75), 6).alias("q75"),
        F.count_if((F.col("score") < 0) | (F.col("score") > 1)).alias("n_out_of_bounds"),
    )
