"""Sliding windows over batches of rows that come series by series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf


def places_follow(places: np.ndarray, before: int) -> None:
    """Refuse rows that don't come series by series in order of their place (from 1); ``before``: the last place of the batch before."""
    if ((places != np.concatenate([[before], places[:-1]]) + 1) & (places != 1)).any():
        raise ValueError("rows of a series are not in order")


def _regression(held: np.ndarray, there: np.ndarray, place: np.ndarray, n: int, back: int) -> dict[str, np.ndarray]:
    """Sums of squares and products of a column against the place, by the updates that a Spark aggregate makes row by row."""
    rows, reach = len(place), len(held) - len(place)
    count, my, mx, yy, xx, xy = (np.zeros(rows) for _ in range(6))
    for s in range(back + n - 1, back - 1, -1):
        y, take, x = held[reach - s : reach - s + rows], there[reach - s : reach - s + rows] & (place > s), (place - s).astype(np.float64)
        more = count + take
        some = np.maximum(more, 1)
        dy, dx = np.where(take, y - my, 0.0), np.where(take, x - mx, 0.0)
        by, bx = dy / some, dx / some
        my += by
        yy += dy * (dy - by)
        xx += dx * (dx - bx)
        mx += bx
        xy += np.where(take, dy * (x - mx), 0.0)
        count = more
    return {"regr_sxx": xx, "regr_sxy": xy, "regr_syy": yy, "count": count}


def sliding(kind: str, held: np.ndarray, there: np.ndarray, place: np.ndarray, n: int, back: int) -> tuple[np.ndarray, np.ndarray]:
    """(result, how many values it has) of n rows that end ``back`` rows before each; rows are added in their order, as a window frame does.

    ``held`` (0 where not ``there``) has the rows before those of ``place``, as many as the longest window needs.
    """
    if kind.startswith("regr"):
        out = _regression(held, there, place, n, back)
        return out[kind], out["count"]
    rows, reach = len(place), len(held) - len(place)
    out, count = np.full(rows, {"max": -np.inf, "min": np.nan}.get(kind, 0.0)), np.zeros(rows)
    for s in range(back + n - 1, back - 1, -1):
        x, take = held[reach - s : reach - s + rows], there[reach - s : reach - s + rows] & (place > s)
        count += take
        if kind in ("max", "min"):
            out = np.where(take, np.maximum(out, x) if kind == "max" else np.fmin(out, x), out)
        else:
            out += np.where(take, x, 0.0)
    return (out / np.maximum(count, 1) if kind == "avg" else out), count


def rolls_udf(asked: dict[str, dict[str, tuple[str, int, int]]]):
    """(place of a row in its series from 1, columns of ``asked``...) -> a struct of what is asked; null where a window has no value.

    A task holds a batch and as many rows before it as the longest window has. Rows are to come in order, or are refused.
    """
    reach = max(n + back for kinds in asked.values() for _, n, back in kinds.values()) - 1
    names = [name for kinds in asked.values() for name in kinds]

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        before, kept = 0, [(np.zeros(reach), np.zeros(reach, bool)) for _ in asked]
        for places, *values in batches:
            place, cells = places.to_numpy(zero_copy_only=False), []
            if len(place):
                places_follow(place, before)
                before = place[-1]
            for k, (kinds, v) in enumerate(zip(asked.values(), values)):
                there = np.concatenate([kept[k][1], v.is_valid().to_numpy(zero_copy_only=False)])
                held = np.concatenate([kept[k][0], v.fill_null(0.0).to_numpy(zero_copy_only=False)])
                kept[k] = held[len(held) - reach :].copy(), there[len(there) - reach :].copy()
                for kind, n, back in kinds.values():
                    with np.errstate(all="ignore"):  # infinite values go through as they do in Spark
                        result, count = sliding(kind, held, there, place, n, back)
                    cells.append(pa.array(result, mask=count == 0, from_pandas=False))
            yield pa.StructArray.from_arrays(cells, names)

    return arrow_udf(run, T.StructType([T.StructField(name, T.DoubleType()) for name in names])).asNondeterministic()
