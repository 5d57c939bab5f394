"""Comparison of tables, fingerprints and rule scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.conventions import ratio


def multiset_diff(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that one side has more often than the other, with both counts."""
    x = a.groupBy(*columns).agg(F.count("*").alias("n_left"))
    y = b.groupBy(*columns).agg(F.count("*").alias("n_right"))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in columns]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    out = x.alias("x").join(y.alias("y"), cond, "full")
    out = out.select(*[F.coalesce(F.col(f"x.{c}"), F.col(f"y.{c}")).alias(c) for c in columns], F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))
    return out.where("n_left <> n_right")


def multiset_counts(a: DataFrame, b: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """(metric, value): rows of both sides, rows that one side lacks with their repeats, and rows that repeat a key on its side.

    Both sides are counted before they meet, so a row that repeats without end is one row of the shuffle's result.
    """
    sides = a.select(*columns, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*columns, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    each = sides.groupBy(*columns).agg(F.sum("_a").alias("a"), F.sum("_b").alias("b"))
    keys = each.groupBy(*key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    over = lambda x, y: F.greatest(F.col(x) - F.col(y), F.lit(0))
    rows = each.agg(total("a").alias("n_left"), total("b").alias("n_right"), total(over("b", "a")).alias("n_missing"), total(over("a", "b")).alias("n_unexpected"))
    repeats = keys.agg(*[total(F.greatest(F.col(c) - 1, F.lit(0))).alias(f"n_repeats_{n}") for c, n in (("a", "left"), ("b", "right"))])
    return rows.unpivot([], rows.columns, "metric", "value").unionByName(repeats.unpivot([], repeats.columns, "metric", "value"))


def first_differences(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], n: int = 20) -> DataFrame:
    """(kind, place, keys): the first ``n`` keys, in order, of each kind of difference. Every task keeps its own first ones before they meet."""
    both = a.select(*keys, F.struct(*values).alias("x"), F.lit(True).alias("_x")).join(b.select(*keys, F.struct(*values).alias("y"), F.lit(True).alias("_y")), keys, "full")
    kind = F.when(F.col("_y").isNull(), "left_only").when(F.col("_x").isNull(), "right_only").when(~F.col("x").eqNullSafe(F.col("y")), "mismatched")
    found = both.select(*keys, kind.alias("kind")).where("kind is not null")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(*keys))).where(F.col("place") <= n)


def keyed_diff(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys of one side alone, keys with unequal values, and unequal values by column, as (metric, value)."""
    x = a.select(*keys, F.struct(*values).alias("x"), F.lit(True).alias("_x"))
    y = b.select(*keys, F.struct(*values).alias("y"), F.lit(True).alias("_y"))
    both = x.join(y, keys, "full")
    shared = F.col("_x") & F.col("_y")
    unequal = {v: shared & ~F.col(f"x.{v}").eqNullSafe(F.col(f"y.{v}")) for v in values}
    some = F.lit(False)
    for c in unequal.values():
        some = some | c
    row = both.agg(F.count_if(F.col("_y").isNull()).alias("left_only"), F.count_if(F.col("_x").isNull()).alias("right_only"), F.count_if(some).alias("mismatched"), *[F.count_if(c).alias(f"mismatched_{v}") for v, c in unequal.items()])
    return row.unpivot([], row.columns, "metric", "value")


def fingerprint(df: DataFrame, by: str) -> DataFrame:
    """Row count and order-insensitive digest of each part: sum of the first digits of row digests."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in sorted(df.columns)])
    rows = df.select(by, F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long").alias("h"))
    return rows.groupBy(by).agg(F.count("*").alias("n_rows"), F.sum("h").alias("digest"), F.bit_xor("h").alias("xor"))


def anomaly_scan(df: DataFrame, rules: dict[str, tuple[Column, float]]) -> DataFrame:
    """Rules as (expression, expected) -> rule, observed, expected, status."""
    row = df.agg(*[e.cast("double").alias(n) for n, (e, _) in rules.items()])
    out = row.unpivot([], row.columns, "rule", "observed")
    expected = F.create_map(*[F.lit(x) for n, (_, v) in rules.items() for x in (n, float(v))])
    out = out.withColumn("expected", expected[F.col("rule")])
    return out.withColumn("status", F.when(F.col("observed") == F.col("expected"), "ok").otherwise("anomaly"))


def max_share(df: DataFrame, key: str) -> DataFrame:
    """The key with most rows and its share (ties to the smallest key)."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    counts = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).select(key, "n", ratio(F.col("n"), F.col("_all")).alias("share"))  # one row
    return counts.orderBy(F.desc("n"), key).limit(1)
