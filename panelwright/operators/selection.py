"""Exact order statistics of large groups without holding a group in one buffer.

A mergeable sketch of bounded memory brackets each wanted rank; only values inside a bracket are counted,
as distinct values with their frequency, and the values below it are one number. Groups of at most
ACCURACY rows are their own bracket.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative error of the sketch is 1 / ACCURACY by its guarantee; brackets are three times as wide on either side.
ACCURACY = 10_000


def ranks(rule: str, p: float, n: Column) -> tuple[Column, Column, Column]:
    """(lower rank, upper rank, weight of the upper) of the quantile ``p`` of n sorted values, ranks from 1.

    ``linear`` interpolates at 1 + (n - 1) p; ``nearest`` is ceil(p n); ``rounded`` is 1 + (n - 1) p rounded
    half to even.
    """
    if rule == "linear":
        at = (n - 1) * F.lit(p)
        low = F.floor(at)
        return low + 1, F.least(low + 2, n), at - low
    one = F.greatest(F.ceil(F.lit(p) * n), F.lit(1)) if rule == "nearest" else F.rint((n - 1) * F.lit(p)) + 1
    one = F.least(one.cast("long"), n)
    return one, one, F.lit(0.0)


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], rule: str = "linear", accuracy: int = ACCURACY) -> DataFrame:
    """A row for each group of ``keys`` with ``n`` and the exact quantiles ``wanted`` (name -> p); nulls and NaN are passed over.

    Two aggregations over the rows: sketches, then counts within brackets, whose rows are about six in
    ``accuracy`` of a group's. Groups without a value have no row. ``keys`` may hold nulls.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).cast("double").alias("_x"))
    step = 3 / accuracy
    edges = sorted({min(max(p + s, 0.0), 1.0) for p in wanted.values() for s in (-step, step)})
    ends = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.percentile_approx("_x", edges, accuracy).alias("_edges"))
    cells = []
    for name, p in wanted.items():
        lo, hi, weight = ranks(rule, p, F.col("n"))
        edge = lambda q, end: F.when(F.col("n") <= accuracy, F.col(end)).otherwise(F.get("_edges", F.lit(edges.index(min(max(q, 0.0), 1.0)))))
        cells.append(F.struct(F.lit(name).alias("name"), lo.cast("long").alias("a"), hi.cast("long").alias("b"), weight.cast("double").alias("w"), edge(p - step, "_lo").alias("from"), edge(p + step, "_hi").alias("to")))
    brackets = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "n", F.array(*cells).alias("_cells"))
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.lit(True))
    placed = rows.join(brackets, same) if keys else rows.crossJoin(F.broadcast(brackets))  # without keys: one row
    placed = placed.select(*keys, "n", "_x", F.explode("_cells").alias("c")).where(F.col("_x") <= F.col("c.to"))
    inside = F.when(F.col("_x") >= F.col("c.from"), F.col("_x"))  # null: all that lies below the bracket
    counts = placed.groupBy(*keys, "n", F.col("c.name").alias("name"), F.col("c.a").alias("a"), F.col("c.b").alias("b"), F.col("c.w").alias("w"), inside.alias("_x")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "name").orderBy(F.col("_x").asc_nulls_first()))
    counts = counts.withColumn("_upto", upto).where(F.col("_x").isNotNull())
    found = counts.groupBy(*keys, "n", "name", "w").agg(
        F.min(F.when(F.col("_upto") >= F.col("a"), F.col("_x"))).alias("low"), F.min(F.when(F.col("_upto") >= F.col("b"), F.col("_x"))).alias("high")
    )
    found = found.withColumn("q", F.when(F.col("w") == 0, F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * F.col("w")))
    return found.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in wanted])
