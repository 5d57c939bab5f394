"""Null models: layers turned round inside continuous blocks, and what their replicates say about an observed value.

A block is one array for each layer; as blocks end with the year, none holds more than 366 days. Replicates are made
from these arrays where they lie, so only sums by replicate, or the few days that are true in one, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.conventions import ratio
from panelwright.operators.statistics import block_begins, block_offset, blocks

BLOCK = ["security_id", "block"]


def block_arrays(wide: DataFrame, layers: list[str], gap_days: int) -> DataFrame:
    """A row for each block: its length, the number of its first day within the entity, and a state array for each layer."""
    w = Window.partitionBy("security_id").orderBy("trading_date")
    placed = blocks(wide.withColumn("seq", F.row_number().over(w)), gap_days)
    row = F.struct("pos", "seq", *layers)
    out = placed.groupBy(*BLOCK).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return out.select(*BLOCK, F.size("rows").alias("len"), F.get("rows.seq", F.lit(0)).alias("first_seq"), *[F.col(f"rows.{c}").alias(c) for c in layers])


def replicates(arrays: DataFrame, test: str, shifted: list[str], n: int, seed: int) -> DataFrame:
    """A row for each block and replicate (from 1) with the offset of each shifted layer."""
    out = arrays.withColumns({"test": F.lit(test), "replicate": F.explode(F.sequence(F.lit(1), F.lit(n)))})
    return out.withColumns({f"off_{c}": block_offset(seed, "len", F.lit(test), "replicate", F.lit(c)) for c in shifted})


def turned(values: Column, length: Column, offset: Column) -> Column:
    """The array with every value ``offset`` places later, its end coming round to the front."""
    return F.concat(F.slice(values, length - offset + 1, offset), F.slice(values, F.lit(1), length - offset))


def turned_days(days: DataFrame, layer: str, gap_days: int, n: int, seed: int) -> DataFrame:
    """(security_id, trading_date, block, pos, replicate, shifted) of replicates from 0: each day with the layer's state of its block turned round.

    A block's days and states are two arrays that replicates turn where they lie, so a day is dealt once and meets no other table.
    """
    w = Window.partitionBy("security_id").orderBy("trading_date")
    held = days.select("security_id", "trading_date", layer, block_begins("trading_date", gap_days).alias("_begins"))
    held = held.withColumn("block", F.sum(F.col("_begins").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = held.groupBy(*BLOCK).agg(F.array_sort(F.collect_list(F.struct("trading_date", layer))).alias("rows"))
    rows = rows.select(*BLOCK, F.size("rows").alias("len"), F.col("rows.trading_date").alias("_days"), F.col(f"rows.{layer}").alias("_states"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("replicate"))
    rows = rows.withColumn("_states", turned(F.col("_states"), F.col("len"), block_offset(seed, "len", "replicate")))
    rows = rows.select(*BLOCK, "replicate", F.posexplode(F.arrays_zip(F.col("_days").alias("trading_date"), F.col("_states").alias("shifted"))).alias("pos", "x"))
    return rows.select("security_id", "x.trading_date", "block", "pos", "replicate", "x.shifted")


def true_places(values: Column) -> Column:
    return F.filter(F.transform(values, lambda x, i: F.when(x, i)), lambda p: p.isNotNull())


def _true_behind(layer: str):
    """Whether the turned layer is true at a place."""
    return lambda place: F.coalesce(F.get(layer, F.pmod(place - F.col(f"off_{layer}"), F.col("len")).cast("int")), F.lit(False))


def nested_counts(arrays: DataFrame, test: str, parent: str, child: str, n: int, seed: int) -> DataFrame:
    """(test, replicate, n_parent, child_true, child_false) of the child turned round under the parent's true days.

    Replicate 0 is the observed one. A block's counts are made once for each of its offsets; a replicate only looks its own up.
    """
    length = F.col("len")
    under = lambda off, want: F.size(F.filter("_places", lambda p: F.get(child, F.pmod(p - off, length)) == F.lit(want)))
    each = F.transform(F.sequence(F.lit(0), length - 1), lambda off: F.struct(under(off, True).alias("t"), under(off, False).alias("f")))
    by_offset = arrays.withColumn("_places", true_places(F.col(parent))).where(F.size("_places") > 0).select(*BLOCK, "len", F.size("_places").alias("n_parent"), each.alias("counts"))
    rows = by_offset.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n))))
    offset = F.when(F.col("replicate") > 0, block_offset(seed, "len", F.lit(test), "replicate", F.lit(child))).otherwise(F.lit(0))
    rows = rows.withColumn("c", F.get("counts", offset.cast("int")))
    return rows.groupBy(F.lit(test).alias("test"), "replicate").agg(F.sum("n_parent").alias("n_parent"), F.sum("c.t").alias("child_true"), F.sum("c.f").alias("child_false"))


def joint_days(arrays: DataFrame, test: str, fixed: str, shifted: list[str], n: int, seed: int) -> DataFrame:
    """(test, replicate, security_id, seq): days on which the fixed layer and all turned layers are true; replicate 0 turns none."""
    rows = arrays.withColumn("_places", true_places(F.col(fixed))).where(F.size("_places") > 0)
    rows = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n))))
    held = F.col("_places")
    for c in shifted:
        rows = rows.withColumn(f"off_{c}", F.when(F.col("replicate") > 0, block_offset(seed, "len", F.lit(test), "replicate", F.lit(c))).otherwise(F.lit(0)))
        held = F.filter(held, _true_behind(c))
    rows = rows.select("replicate", "security_id", "first_seq", F.explode(held).alias("pos"))
    return rows.select(F.lit(test).alias("test"), "replicate", "security_id", (F.col("first_seq") + F.col("pos")).alias("seq"))


def confirmed_metrics(days: DataFrame, k: int, eligible: DataFrame, n: int, tests: list[str]) -> DataFrame:
    """Confirmed days, intervals, durations and one-day fragments of every replicate, from its true days alone.

    Runs are consecutive days of an entity; ``eligible`` (one row, ``n_eligible``) is the denominator of the coverage.
    Replicates without a true day have zeros and null durations.
    """
    w = Window.partitionBy("test", "replicate", "security_id").orderBy("seq")
    runs = days.withColumn("run", F.col("seq") - F.row_number().over(w)).groupBy("test", "replicate", "security_id", "run").agg(F.count("*").alias("length"))
    runs = runs.withColumn("confirmed", F.when(F.col("length") >= k, F.col("length") - k + 1))
    found = runs.groupBy("test", "replicate").agg(
        F.sum("length").alias("n_true"), F.sum("confirmed").alias("confirmed_days"), F.count("confirmed").alias("n_intervals"), F.avg(F.col("confirmed").cast("double")).alias("duration_mean"),
        F.percentile("confirmed", 0.5).alias("duration_median"), F.count_if(F.col("confirmed") == 1).alias("n_fragments"),
    )
    grid = eligible.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("test", F.explode(F.array(*map(F.lit, tests))))
    out = grid.join(found, ["test", "replicate"], "left").fillna(0, ["n_true", "confirmed_days", "n_intervals", "n_fragments"])
    return out.select(
        "test", "replicate", "n_eligible", "n_true", "confirmed_days", "n_intervals", "duration_mean", "duration_median", "n_fragments",
        ratio(F.col("confirmed_days"), F.col("n_eligible")).alias("confirmed_coverage"), ratio(F.col("n_fragments"), F.col("n_intervals")).alias("fragment_rate"),
    )


def with_observed(long: DataFrame) -> DataFrame:
    """(test, statistic, replicate, value) -> replicates from 1 on with the value of replicate 0 as ``observed`` and the null's mean and deviation.

    Rows with a null value take no part. A window holds the replicates of one test and statistic.
    """
    w = Window.partitionBy("test", "statistic")
    null = F.when(F.col("replicate") > 0, F.col("value"))
    rows = long.withColumns({"observed": F.max(F.when(F.col("replicate") == 0, F.col("value"))).over(w), "null_mean": F.avg(null).over(w), "null_sd": F.stddev_samp(null).over(w)})
    return rows.where("replicate > 0 and value is not null and observed is not null")


def null_summary(long: DataFrame, lower: list[str] = ()) -> DataFrame:
    """Empirical p-values (extreme + 1) / (replicates + 1) against the observed value, and the null's centre, spread and interval.

    The tail is the upper one but for statistics in ``lower``; a null value of a replicate takes no part.
    """
    v, o = F.col("value"), F.col("observed")
    rows = with_observed(long)
    low = F.col("statistic").isin(list(lower)) if lower else F.lit(False)
    out = rows.groupBy("test", "statistic").agg(
        F.count("*").alias("n"), F.max("observed").alias("observed"), F.max("null_mean").alias("null_mean"), F.max("null_sd").alias("null_sd"),
        *[F.percentile("value", q).alias(c) for q, c in ((0.5, "null_median"), (0.025, "null_low"), (0.975, "null_high"))],
        F.count_if(F.when(low, v <= o).otherwise(v >= o)).alias("n_extreme"), F.count_if(F.abs(v - F.col("null_mean")) + 1e-12 >= F.abs(o - F.col("null_mean"))).alias("n_two_sided"),
    )
    return out.withColumns({
        "tail": F.when(low, "lower").otherwise("upper"), "ratio": ratio(F.col("observed"), F.col("null_mean")), "difference": F.col("observed") - F.col("null_mean"),
        "z": ratio(F.col("observed") - F.col("null_mean"), F.col("null_sd")), "empirical_p": (F.col("n_extreme") + 1) / (F.col("n") + 1), "p_two_sided": (F.col("n_two_sided") + 1) / (F.col("n") + 1),
    })


def family_adjust(long: DataFrame, families: dict[str, str]) -> DataFrame:
    """p-values adjusted for the largest studentised value that any candidate of a family has in the same replicate.

    ``families`` maps a test to its family. Candidates whose null doesn't vary have no z and no adjusted p.
    """
    names = F.create_map(*[F.lit(x) for pair in families.items() for x in pair])
    rows = with_observed(long).withColumn("family", names[F.col("test")])
    rows = rows.withColumns({"z": ratio(F.col("observed") - F.col("null_mean"), F.col("null_sd")), "z_rep": ratio(F.col("value") - F.col("null_mean"), F.col("null_sd"))})
    tops = rows.groupBy("family", "replicate").agg(F.max("z_rep").alias("top"), F.collect_list(F.struct("test", "statistic", "null_mean", "null_sd", "observed", "z")).alias("own"))
    each = tops.select("family", "top", F.explode("own").alias("x")).select("family", "top", "x.*")  # the candidates of a family meet in each replicate
    out = each.groupBy("family", "test", "statistic").agg(
        *[F.max(c).alias(c) for c in ("null_mean", "null_sd", "observed", "z")], F.count("top").alias("n"), F.count_if(F.col("top") + 1e-12 >= F.col("z")).alias("n_family_extreme"),
    )
    return out.withColumn("family_adjusted_p", F.when(F.col("z").isNotNull(), (F.col("n_family_extreme") + 1) / (F.col("n") + 1)))
