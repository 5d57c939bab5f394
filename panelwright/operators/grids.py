"""Whole grids of windows, thresholds and confirmation lengths over a panel's metrics, in one pass over its days in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.conventions import EPSILON, PANEL, STATUSES, Panel, severity
from panelwright.operators.scores import _Past
from panelwright.operators.sliding import places_follow
from panelwright.operators.states import WEAK_DELTA

REASONS = ["state_false", "", *[f"state_{s}" for s in STATUSES[1:]], "end_of_input_open"]
COUNTS = ("n_days", "n_valid", "n_true", "n_null", "n_confirmed", "n_intervals", "n_entities")


def run_lengths(on: np.ndarray, place: np.ndarray, carried: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length of the true run up to each row and column, first row of each row's series in the batch); ``carried``: lengths at the row before the batch."""
    rows = np.arange(len(place))
    first = np.maximum.accumulate(np.where(place == 1, rows, 0))
    last = np.maximum.accumulate(np.where(on, (first - 1)[:, None], rows[:, None]), axis=0)  # the last row that breaks a run
    length = rows[:, None] - last
    return (length if place[0] == 1 else length + np.where(last < 0, carried, 0)), first


class Grid:
    """Series of every window, q and state of the chain (``dimensions``, each of some metrics) stand side by side as columns of codes: 0 false, 1 true, else
    no state, 1 + the severity of its status.

    A task holds a batch of days, the last values of the open entity for each window, and of its open runs how long they are,
    when they began and were confirmed, and how many were confirmed before.
    """

    def __init__(self, windows: list[int], qs: list[float], ks: list[int], dimensions: dict[str, tuple[str, ...]]) -> None:
        self.windows, self.qs, self.ks, self.dimensions = windows, qs, ks, dimensions
        self.names = [n for names in dimensions.values() for n in names]
        self.series = [(w, q, f"s{k}") for w in windows for q in qs for k in range(1, len(dimensions) + 1)]

    def configs(self, k: int) -> list[str]:
        """Names of the configurations of all series, as ``parameter_grid`` gives them."""
        return [f"W{w}_q{round(q * 10_000)}_K{k}" for w, q, _ in self.series]

    def _begin(self) -> None:
        n, k = len(self.series), len(self.ks)
        self.past = {(w, c): _Past(w) for w in self.windows for c in self.names}
        self.place, self.entity, self.day = 0, None, 0
        self.length, self.began = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.confirmed, self.before, self.seen = np.zeros((k, n), np.int64), np.zeros((k, n), np.int64), np.zeros((k, n), bool)

    def codes(self, series: np.ndarray, values: list[np.ndarray], ranks: list[np.ndarray], times: pa.Array) -> np.ndarray:
        out, at = np.empty((len(series), len(self.series)), np.uint8), 0
        held = {c: np.where((r == 0) & np.isfinite(v), v, np.nan) for c, v, r in zip(self.names, values, ranks)}
        least_bad = {c: np.maximum(r, 1) for c, r in zip(self.names, ranks)}
        for w in self.windows:
            dims = []
            for names in self.dimensions.values():
                scores, bad = [], np.zeros(len(series), np.uint8)
                for c in names:
                    counted, twice = (x.to_numpy(zero_copy_only=False) for x in self.past[w, c].take(series, held[c], times)[:2])
                    scores.append(1 - twice / 2 / w)
                    bad = np.maximum(bad, np.where(~np.isnan(held[c]) & (counted == w), 0, least_bad[c]))
                dims.append((sum(scores[1:], scores[0]) / len(scores), np.minimum.reduce(scores), bad))
            for q in self.qs:
                code = np.ones(len(series), np.uint8)
                for mean, least, bad in dims:  # the first dimension that is not true decides all states from its own on
                    active = (mean + EPSILON >= 1 - q) & (least + EPSILON >= 1 - q - WEAK_DELTA)
                    code = np.where(code == 1, np.where(bad > 0, 1 + bad, active), code).astype(np.uint8)
                    out[:, at] = code
                    at += 1
        return out

    def _read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places, numbers of the rows' series from 0, the open one, days, codes) of (entity, time, place, values..., severities...)."""
        place = batch.column(2).to_numpy(zero_copy_only=False)
        places_follow(place, self.place)
        series, n = np.cumsum(place == 1), len(self.names)
        values = [batch.column(3 + i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(n)]
        ranks = [batch.column(3 + n + i).to_numpy(zero_copy_only=False).astype(np.uint8) for i in range(n)]
        return place, series, batch.column(1).cast(pa.int32()).to_numpy(zero_copy_only=False).astype(np.int64), self.codes(series, values, ranks, batch.column(1))

    def counts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each configuration and state with its days in numbers; an entity is whole in a task."""
        self._begin()
        sums = np.zeros((len(self.ks), len(COUNTS), len(self.series)), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            place, series, _, codes = self._read(batch)
            length, _ = run_lengths(codes == 1, place, self.length)
            for i, k in enumerate(self.ks):
                met = length == k
                known = np.unique(np.stack([series[(at := np.nonzero(met))[0]], at[1]]), axis=1)  # once for an entity and a series
                fresh = known[:, ~((known[0] == 0) & self.seen[i][known[1]])]
                each = (np.full(len(self.series), len(place)), (codes <= 1).sum(0), (codes == 1).sum(0), (codes > 1).sum(0), (length >= k).sum(0), met.sum(0), np.bincount(fresh[1], minlength=len(self.series)))
                sums[i] += np.array(each)
                last = known[1][known[0] == series[-1]]
                self.seen[i] &= series[-1] == 0
                self.seen[i][last] = True
            self.place, self.length = place[-1], length[-1]
        if sums[0, 0].any():
            for i, k in enumerate(self.ks):
                names = [pa.array(self.configs(k)), pa.array([s for *_, s in self.series])]
                yield pa.RecordBatch.from_arrays([*names, *[pa.array(x) for x in sums[i]]], ["config_id", "state_name", *COUNTS])

    def intervals(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Confirmed runs of all configurations and states: a run is told by the row after its last one."""
        self._begin()
        for batch in batches:
            if not batch.num_rows:
                continue
            place, _, days, codes = self._read(batch)
            on = codes == 1
            length, first = run_lengths(on, place, self.length)
            before, entities = np.concatenate([self.length[None], length[:-1]]), batch.column(0)
            entities = pa.concat_arrays([entities.slice(0, 1) if self.entity is None else self.entity, entities])
            days_before = np.concatenate([[self.day], days])
            over, began = ~on | (place == 1)[:, None], place[first] == 1
            of = np.concatenate([[-1], np.where(began, first, -1)[:-1]])  # where the series of the row before began; -1: before the batch
            open_length, confirmed = length[-1], []
            for i, k in enumerate(self.ks):
                ended = over & (before >= k)
                total = np.cumsum(ended, axis=0)
                j, c = np.nonzero(ended)
                n = before[j, c]
                number = total[j, c] + np.where(of[j] < 0, self.before[i][c], -total[of[j], c])
                since, met = self._day(days, j - n, self.began[c]), self._day(days, j - n + k - 1, self.confirmed[i][c])
                yield self._rows(k, c, entities.take(pa.array(j)), number, since, met, days_before[j], days[j], n, np.where(place[j] == 1, len(REASONS) - 1, codes[j, c]))
                self.before[i] = total[-1] - total[first[-1]] if began[-1] else self.before[i] + total[-1]
                confirmed.append(self._day(days, np.minimum(len(days) - open_length + k - 1, len(days) - 1), self.confirmed[i]))
            self.began, self.confirmed = self._day(days, np.minimum(len(days) - open_length, len(days) - 1), self.began), np.array(confirmed)
            self.place, self.length, self.entity, self.day = place[-1], open_length, batch.column(0).slice(len(days) - 1), days[-1]
        for i, k in enumerate(self.ks):  # what is open at the end of the input
            c = np.flatnonzero(self.length >= k)
            if len(c):
                day = np.full(len(c), self.day)
                yield self._rows(k, c, self.entity.take(pa.array(np.zeros(len(c), np.int64))), self.before[i][c] + 1, self.began[c], self.confirmed[i][c], day, day, self.length[c], np.full(len(c), len(REASONS) - 1))

    @staticmethod
    def _day(days: np.ndarray, at: np.ndarray, carried: np.ndarray) -> np.ndarray:
        """The day of a row; what is carried for rows before the batch."""
        return np.where(at >= 0, days[np.maximum(at, 0)], carried)

    def _rows(self, k: int, c: np.ndarray, entities: pa.Array, number: np.ndarray, since: np.ndarray, met: np.ndarray, last: np.ndarray, following: np.ndarray, n: np.ndarray, why: np.ndarray) -> pa.RecordBatch:
        date = lambda x, mask=None: pa.array(x.astype(np.int32), mask=mask).cast(pa.date32())
        is_open, at = why == len(REASONS) - 1, pa.array(c)
        cells = {
            "entity": entities, "config_id": pa.array(self.configs(k)).take(at), "state_name": pa.array([s for *_, s in self.series]).take(at), "interval_no": pa.array(number.astype(np.int64)),
            "raw_start_date": date(since), "confirmation_date": date(met), "interval_end_date": date(last, is_open), "last_observed_date": date(np.where(is_open, last, following)),
            "duration_raw_days": pa.array(n.astype(np.int64)), "duration_confirmed_days": pa.array((n - k + 1).astype(np.int64)), "is_open": pa.array(is_open), "termination_reason": pa.array(REASONS).take(pa.array(why.astype(np.int64))),
        }
        return pa.RecordBatch.from_arrays(list(cells.values()), list(cells))


def _days(metrics: DataFrame, grid: Grid, panel: Panel) -> DataFrame:
    """What ``Grid`` reads of metrics that stand side by side: rows with their ``_place``, in order, as one sort of the panel leaves them."""
    values = [F.col(f"{c}.value").cast("double").alias(f"value_{c}") for c in grid.names]
    ranks = [severity(F.col(f"{c}.validity_status")).cast("int").alias(f"rank_{c}") for c in grid.names]
    return metrics.select(panel.entity, panel.time, "_place", *values, *ranks)


def grid_counts(metrics: DataFrame, grid: Grid, panel: Panel = PANEL) -> DataFrame:
    """(config_id, state_name, counts) of the whole grid; a task sends a row for each."""
    schema = "config_id string, state_name string, " + ", ".join(f"{c} long" for c in COUNTS)
    return _days(metrics, grid, panel).mapInArrow(grid.counts, schema).groupBy("config_id", "state_name").agg(*[F.sum(c).alias(c) for c in COUNTS])


def grid_runs(metrics: DataFrame, grid: Grid, panel: Panel = PANEL) -> DataFrame:
    """Intervals of the whole grid, with their config_id and state_name."""
    kind = metrics.schema[panel.entity].dataType.simpleString()
    dates = ", ".join(f"{c} date" for c in ("raw_start_date", "confirmation_date", "interval_end_date", "last_observed_date"))
    schema = f"entity {kind}, config_id string, state_name string, interval_no long, {dates}, duration_raw_days long, duration_confirmed_days long, is_open boolean, termination_reason string"
    return _days(metrics, grid, panel).mapInArrow(grid.intervals, schema).withColumnRenamed("entity", panel.entity)
