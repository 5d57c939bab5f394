"""Full checks of adjusted price rows: reasons of each row, and violations of a contract with both sides."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.conventions import reason_list

FIELDS = ("open", "high", "low", "close")
KEYS = ["security_id", "trading_date"]


def _bad_prices(scale: str) -> Column:
    """Whether one of a scale's four prices is missing or not above zero."""
    return functools.reduce(lambda a, b: a | b, [F.coalesce(~(F.col(f"{scale}_{f}") > 0), F.lit(True)) for f in FIELDS])


def _bad_order(scale: str) -> Column:
    """Whether the high lies below another price, or the low above one (prices that are missing are passed over)."""
    high, low, ends = F.col(f"{scale}_high"), F.col(f"{scale}_low"), [F.col(f"{scale}_open"), F.col(f"{scale}_close")]
    return F.coalesce(high < F.greatest(*ends, low), F.lit(False)) | F.coalesce(low > F.least(*ends, high), F.lit(False))


def row_reasons(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Every reason against a row of raw and adjusted prices, in a fixed order, and whether there is one.

    Columns: raw_ and adj_ prices, adjustment_factor, factor_as_of, revision, volume, amount, trading_status, limit_status, suspension_status,
    special_status, unit_status; a null status counts as unknown. Rows that share ``keys`` all bear ``duplicate_key``.
    """
    unknown = {n: F.coalesce(F.col(c), F.lit("unknown")) == "unknown" for n, c in {
        "trading_status_unknown": "trading_status", "price_limit_status_unknown": "limit_status", "suspension_status_unknown": "suspension_status", "special_status_unknown": "special_status", "unit_unknown": "unit_status",
    }.items()}
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    reasons = reason_list(
        factor_missing=F.col("adjustment_factor").isNull(), factor_as_of_missing=blank("factor_as_of"), revision_missing=blank("revision"), factor_direction_unverified=F.coalesce(~F.col("direction_verified"), F.lit(True)),
        raw_price_missing_or_not_positive=_bad_prices("raw"), adjusted_price_missing_or_not_positive=_bad_prices("adj"), raw_order_violation=_bad_order("raw"), adjusted_order_violation=_bad_order("adj"),
        volume_missing=F.col("volume").isNull(), amount_missing=F.col("amount").isNull(), volume_negative=F.col("volume") < 0, amount_negative=F.col("amount") < 0,
        duplicate_key=F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1, **unknown,
    )
    return rows.withColumn("reasons", reasons).withColumn("blocked", F.size("reasons") > 0)


def reason_counts(checked: DataFrame) -> DataFrame:
    """Rows for each reason, and the row of those without any."""
    named = F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("none")))
    return checked.select("security_id", F.explode(named).alias("reason")).groupBy("reason").agg(F.count("*").alias("n_rows"), F.count_distinct("security_id").alias("n_entities"))


@dataclass(frozen=True)
class Contract:
    """What rows of adjusted prices have to keep."""

    methods: tuple[str, ...]
    revisions: tuple[str, ...]
    identity: str = "identity_no_adjustment"
    absolute: float = 1e-9
    relative: float = 1e-9


def violations(rows: DataFrame, members: DataFrame, contract: Contract) -> DataFrame:
    """(rule, security_id, trading_date, left_value, right_value): a row for each rule that a row of prices breaks.

    Values are the two sides of a comparison where there are two. All rules are looked at in one pass: a row's broken rules are
    an array that is then exploded. Members are joined once, repeated keys counted by one window.
    """
    none = F.lit(None).cast("double")
    near = lambda a, b: F.abs(a - b) <= F.greatest(F.lit(contract.absolute), contract.relative * F.greatest(F.abs(a), F.abs(b)))
    factor = F.col("adjustment_factor")
    rules: list[tuple[str, Column, Column, Column]] = [
        ("key_repeated", F.col("_n") > 1, F.col("_n").cast("double"), F.lit(1.0)), ("not_a_member", F.col("_member").isNull(), none, none),
        ("order_violation", _bad_order("adj"), F.col("adj_high"), F.col("adj_low")), ("factor_not_positive", factor <= 0, factor, F.lit(0.0)),
        ("factor_time_missing", F.col("factor_as_of").isNull(), none, none), ("factor_time_in_future", F.col("factor_as_of") > F.col("trading_date"), F.datediff("factor_as_of", "trading_date").cast("double"), F.lit(0.0)),
        ("method_unknown", F.coalesce(F.col("method"), F.lit("unknown")) == "unknown", none, none), ("method_not_allowed", ~F.col("method").isin(*contract.methods, "unknown"), none, none),
        ("revision_unknown", F.coalesce(F.col("revision"), F.lit("unknown")) == "unknown", none, none), ("revision_not_allowed", ~F.col("revision").isin(*contract.revisions, "unknown"), none, none),
        ("action_silently_false", ~F.col("action_flag") & (F.coalesce(F.col("action_status"), F.lit("unknown")) == "unknown"), none, none),
        ("identity_factor", (F.col("method") == contract.identity) & ~near(factor, F.lit(1.0)), factor, F.lit(1.0)),
    ]
    for f in FIELDS:
        raw, adjusted = F.col(f"raw_{f}"), F.col(f"adj_{f}")
        rules.append((f"identity_{f}", (F.col("method") == contract.identity) & ~near(adjusted, raw), adjusted, raw))
        rules.append((f"product_{f}", ~near(adjusted, raw * factor), adjusted, raw * factor))
        back = adjusted / F.when(factor != 0, factor)
        rules.append((f"recovered_{f}", ~near(back, raw), back, raw))
    known = members.select("security_id", F.lit(True).alias("_member")).distinct()
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*KEYS))).join(known, "security_id", "left")
    found = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(name).alias("rule"), left.alias("left_value"), right.alias("right_value"))) for name, bad, left, right in rules]))
    return rows.select(*KEYS, F.explode(found).alias("v")).select("v.rule", *KEYS, "v.left_value", "v.right_value")


def audit(rows: DataFrame, second: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Counts over a dataset (metric, value): rows, keys, repeated keys, null keys, prices, orders, factors that a second source (keys, factor) has
    otherwise by more than ``tolerance`` or lacks, and rows without provenance."""
    other = second.select(*KEYS, F.col("factor").alias("_other"), F.lit(True).alias("_there")).dropDuplicates(KEYS)
    joined = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*KEYS))).join(other, KEYS, "left")
    blank = F.coalesce(F.trim(F.col("source_id")) == "", F.lit(True))
    row = joined.agg(
        F.count("*").alias("n_rows"), F.count_distinct(*KEYS).alias("n_keys"), F.count_if(F.col("_n") > 1).alias("rows_of_repeated_keys"), F.count_if(F.col("security_id").isNull() | F.col("trading_date").isNull()).alias("null_keys"),
        F.count_if(_bad_prices("raw")).alias("raw_price_missing_or_not_positive"), F.count_if(_bad_order("raw")).alias("raw_order_violation"), F.count_if(_bad_order("adj")).alias("adjusted_order_violation"),
        F.count_if(F.abs(F.col("adjustment_factor") - F.col("_other")) > tolerance).alias("factor_mismatch"), F.count_if(F.col("_there").isNull()).alias("factor_without_second_source"), F.count_if(blank).alias("without_provenance"),
    )
    return row.unpivot([], row.columns, "metric", "value")
