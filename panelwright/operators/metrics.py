"""Rolling raw metrics of a price panel, over windows of rows.

Every metric returns the panel's keys with value, validity_status, reason_codes, window_start,
window_end, required_count and actual_count. A value stands only where no reason does.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.conventions import PANEL, Panel, Rolls, ratio, reason_list
from panelwright.operators.sliding import rolls_udf

MA_WINDOWS = (5, 10, 20, 30, 60)
#: Reasons that block a metric, and those that ask for a diagnosis; any other makes it unknown.
BLOCKING = ("daily_vwap_range_fail", "provider_turnover_crosscheck_fail")
PAUSING = ("suspension_in_window", "zero_volume_in_window", "zero_amount_in_window")


def guarded(df: DataFrame, value: Column, n: int, fields: tuple[str, ...], panel: Panel = PANEL, whole_prefix: bool = False, **more: Column) -> DataFrame:
    """Attach the common guard: window length, suspension, missing fields, and further conditions of a metric.

    A reason holds while the last row that gives it lies in the window, so a running maximum of places tells it and no frame slides.
    """
    missing = F.lit(False)
    for f in fields:
        missing = missing | F.col(f).isNull()
    df, place = _placed(df, panel), F.col("_place")

    def within(flag: Column) -> Column:
        last = F.max(F.when(flag, place)).over(panel.prefix())
        return last.isNotNull() if whole_prefix else F.coalesce(place - last < n, F.lit(False))

    found, start = place, F.min(panel.time).over(panel.prefix())
    if not whole_prefix:
        found, start = F.least(place, F.lit(n).cast("long")), F.coalesce(F.lag(panel.time, n - 1).over(panel.order()), start)
    flags = {
        "window_insufficient": found < n, "suspension_in_window": within(F.coalesce(F.col("suspension_flag"), F.lit(False))), "missing_required_field": within(missing),
        **{name: within(F.coalesce(c, F.lit(True))) for name, c in more.items()},
    }
    of = panel.keep or "_of"
    facts = {f"{of}__{name}": c for name, c in flags.items()}
    if panel.rolls is not None:
        if "value" in (panel.fields or ("value",)):
            panel.rolls.values[f"{of}__value"] = value
        value = F.lit(None).cast("double")
    for field, name, c in (("value", "value", value), ("window_start", "start", start), ("actual_count", "found", found), ("required_count", "n", F.lit(n))):
        if field in (panel.fields or (field,)):
            facts[f"{of}__{name}"] = c
    df = df.withColumns(facts)
    return df if panel.keep else df.select(panel.entity, panel.time, *_told(of, tuple(flags), panel))


def _placed(df: DataFrame, panel: Panel) -> DataFrame:
    """With the place of each row in its series, from 1."""
    return df if "_place" in df.columns else df.withColumn("_place", F.row_number().over(panel.order()).cast("long"))


def _told(of: str, flags: tuple[str, ...], panel: Panel) -> list[Column]:
    """Cells of a metric from its flat columns (``of``__ and a name), which is all that later windows of a panel have to carry."""
    held = {name: F.col(f"{of}__{name}") for name in (*flags, "value", "start", "found", "n")}
    any_of = lambda names: reduce(Column.__or__, [held[name] for name in names if name in flags], F.lit(False))
    bad = any_of(flags)
    status = F.when(~bad, "valid").when(any_of(BLOCKING), "blocked").when(any_of(PAUSING), "diagnostic_required").otherwise("unknown")
    out = {
        "value": F.when(~bad, held["value"]), "validity_status": status,
        "reason_codes": F.when(~bad, F.array(F.lit("valid_no_blocker"))).otherwise(reason_list(**{name: held[name] for name in flags})),
        "window_start": held["start"], "window_end": F.col(panel.time), "required_count": held["n"], "actual_count": held["found"],
    }
    return [c.alias(name) for name, c in out.items() if name in (panel.fields or out)]


def natr(df: DataFrame, n: int = 14, panel: Panel = PANEL) -> DataFrame:
    """Wilder's average true range over the whole prefix, relative to the close.

    With r = (n-1)/n the recursion is a geometric sum: ATR_i = r^(i-n) ATR_n + sum of TR_j r^(i-j) / n.
    Exponents start again every 2,000 rows from the last value of the block before, so none overflows.
    One bad row makes all later ones of its entity invalid.
    """
    w, r = panel.order(), (n - 1) / n
    before = F.lag("adjusted_close").over(w)
    tr = F.greatest(F.col("adjusted_high") - F.col("adjusted_low"), F.abs(F.col("adjusted_high") - before), F.abs(F.col("adjusted_low") - before))
    df = df.withColumns({"_tr": tr, "_i": F.row_number().over(w) - 1})
    # weight of the first n ranges is 1/n at row n; of later ones 1/n at their own row
    at = F.greatest(F.col("_i"), F.lit(n))
    block = 2000
    df = df.withColumns({"_b": F.floor(at / block), "_p": at % block})
    inside = panel.prefix("_b")
    part = F.sum(F.when(F.col("_i") > 0, F.col("_tr")) / n * F.pow(F.lit(1 / r), F.col("_p"))).over(inside) * F.pow(F.lit(r), F.col("_p"))
    df = df.withColumn("_part", part)
    # contribution of the block before: its last partial sum, decayed; earlier ones are below 1e-60
    df = df.withColumn("_end", F.lag("_part").over(w))
    df = df.withColumn("_end", F.when(F.col("_b") > 0, F.first("_end").over(inside)))
    atr = F.col("_part") + F.coalesce(F.col("_end"), F.lit(0.0)) * F.pow(F.lit(r), F.col("_p") + 1)
    return guarded(df, ratio(atr, F.col("adjusted_close")), n + 1, ("adjusted_high", "adjusted_low", "adjusted_close"), panel, whole_prefix=True, high_low_anomaly=F.col("adjusted_high") < F.col("adjusted_low"))


def log_range(df: DataFrame, n: int = 20, panel: Panel = PANEL) -> DataFrame:
    return guarded(df, F.log(ratio(panel.rolled("max", "adjusted_high", n), panel.rolled("min", "adjusted_low", n))), n, ("adjusted_high", "adjusted_low"), panel)


def _spread(df: DataFrame, values: list[Column], panel: Panel) -> tuple[DataFrame, Column]:
    """Population standard deviation of the logs of a few columns.

    Arrays keep the row's code short: as one long expression it passes the size up to which the JVM compiles a method.
    """
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    df, (logs,) = panel.named(df, {"_logs": F.transform(F.array(*values), lambda x: F.log(x))})
    df, (mean,) = panel.named(df, {"_mean": total(logs) / len(values)})
    return df, F.sqrt(total(F.transform(logs, lambda x: (x - mean) * (x - mean))) / len(values))


def log_averages(panel: Panel = PANEL) -> list[Column]:
    return [F.log(panel.rolled("avg", "adjusted_close", n)) for n in MA_WINDOWS]


def ma_spread(df: DataFrame, panel: Panel = PANEL) -> DataFrame:
    df, spread = _spread(df, [panel.rolled("avg", "adjusted_close", n) for n in MA_WINDOWS], panel)
    return guarded(df, spread, max(MA_WINDOWS), ("adjusted_close",), panel)


def vwap_spread(df: DataFrame, panel: Panel = PANEL) -> DataFrame:
    df = df.withColumn("_paid", F.col("daily_vwap") * F.col("volume_shares"))
    df, spread = _spread(df, [ratio(panel.rolled("sum", "_paid", n), panel.rolled("sum", "volume_shares", n)) for n in MA_WINDOWS], panel)
    inside = (F.col("daily_vwap") >= F.col("adjusted_low") - 0.005) & (F.col("daily_vwap") <= F.col("adjusted_high") + 0.005)
    return guarded(
        df, spread, max(MA_WINDOWS), ("daily_vwap", "volume_shares"), panel,
        daily_vwap_range_fail=~inside, zero_volume_in_window=F.col("volume_shares") <= 0,
    )


def efficiency_ratio(df: DataFrame, n: int = 20, panel: Panel = PANEL) -> DataFrame:
    """Absolute move over n days against the path's length; a flat path gives 0."""
    w = panel.order()
    log = F.log("adjusted_close")
    df = df.withColumns({"_step": F.abs(log - F.lag(log).over(w)), "_move": F.abs(log - F.lag(log, n).over(w))})
    path = panel.rolled("sum", "_step", n)
    return guarded(df, F.when(path == 0, F.lit(0.0)).otherwise(ratio(F.col("_move"), path)), n + 1, ("adjusted_close",), panel)


def abs_trend_t(df: DataFrame, n: int = 20, panel: Panel = PANEL) -> DataFrame:
    """|t| of the least-squares slope of the log close on its place in the window; 0 where the path is flat."""
    df = _placed(df, panel).withColumn("_y", F.log("adjusted_close"))
    df, (sxx, sxy, syy) = panel.named(df, {f"_s{x}": panel.rolled(f"regr_s{x}", "_y", n) for x in ("xx", "xy", "yy")})
    slope = ratio(sxy, sxx)
    left = syy - slope * sxy
    t = ratio(F.abs(slope), F.sqrt(ratio(left / (n - 2), sxx)))
    return guarded(df, F.when(syy == 0, F.lit(0.0)).when(left > 0, t), n, ("adjusted_close",), panel)


def turnover_shrink(df: DataFrame, short: int = 20, long: int = 60, panel: Panel = PANEL) -> DataFrame:
    """Mean turnover of the last days against that of the days before them."""
    new, old = panel.rolled("avg", "turnover_float", short), panel.rolled("avg", "turnover_float", long, short)
    return guarded(df, ratio(new, old), short + long, ("turnover_float",), panel, zero_volume_in_window=F.col("volume_shares") <= 0)


def log_amount(df: DataFrame, n: int = 20, panel: Panel = PANEL) -> DataFrame:
    return guarded(df, F.log(panel.rolled("avg", "amount_yuan", n)), n, ("amount_yuan",), panel, zero_amount_in_window=F.col("amount_yuan") <= 0)


def _cloud(df: DataFrame, panel: Panel) -> DataFrame:
    df = df.withColumns({f"_m{n}": x for n, x in zip(MA_WINDOWS, log_averages(panel))})
    averages = [F.col(f"_m{n}") for n in MA_WINDOWS]
    a, b = F.log("adjusted_open"), F.log("adjusted_close")
    return df.withColumns(
        {
            "_centre": (a + b) / 2, "_low": F.least(a, b), "_high": F.greatest(a, b),
            "_cloud": sum(averages[1:], averages[0]) / len(averages), "_bottom": F.least(*averages), "_top": F.greatest(*averages),
            "_whole": F.row_number().over(panel.order()) >= max(MA_WINDOWS),
        }
    )


def body_to_cloud(df: DataFrame, panel: Panel = PANEL) -> DataFrame:
    """Distance of the body's centre (log scale) to the mean of the log averages."""
    df = _cloud(df, panel)
    return guarded(df, F.abs(F.col("_centre") - F.col("_cloud")), max(MA_WINDOWS), ("adjusted_open", "adjusted_close"), panel)


def outside_cloud_rate(df: DataFrame, n: int = 20, panel: Panel = PANEL) -> DataFrame:
    """Share of the last n days whose body centre lies outside the cloud, with a slack of eight units in the last place."""
    df, slack = _cloud(df, panel), 8 * 2.0**-52
    bottom, top = F.col("_bottom") - slack * F.abs("_bottom"), F.col("_top") + slack * F.abs("_top")
    df = df.withColumn("_out", F.when(F.col("_whole"), ((F.col("_centre") < bottom) | (F.col("_centre") > top)).cast("double")))
    return guarded(df, F.avg("_out").over(panel.last(n)), max(MA_WINDOWS) + n - 1, ("adjusted_open", "adjusted_close"), panel)


def body_cloud_gap(df: DataFrame, n: int = 20, panel: Panel = PANEL) -> DataFrame:
    """Mean gap between the body and the cloud over n days (0 where they overlap)."""
    df = _cloud(df, panel)
    gap = F.greatest(F.col("_low") - F.col("_top"), F.col("_bottom") - F.col("_high"), F.lit(0.0))
    df = df.withColumn("_gap", F.when(F.col("_whole"), gap))
    return guarded(df, F.avg("_gap").over(panel.last(n)), max(MA_WINDOWS) + n - 1, ("adjusted_open", "adjusted_close"), panel)


def market_features(df: DataFrame, panel: Panel = PANEL) -> DataFrame:
    """Moving averages, simple ATR, range, sequence and previous close for each row."""
    w = panel.order()
    before = F.lag("adjusted_close").over(w)
    tr = F.greatest(F.col("adjusted_high") - F.col("adjusted_low"), F.abs(F.col("adjusted_high") - before), F.abs(F.col("adjusted_low") - before))
    df = df.withColumns({"_tr": tr, "sequence": F.row_number().over(w) - 1, "previous_close": before})
    names = {f"ma{n}": F.avg("adjusted_close").over(panel.last(n)) for n in MA_WINDOWS}
    for c, name in (("volume_shares", "volume"), ("amount_yuan", "amount"), ("turnover_float", "turnover")):
        names |= {f"{name}_ma{n}": F.avg(c).over(panel.last(n)) for n in (20, 60)}
    names |= {"atr14": F.avg("_tr").over(panel.last(14)), "range20": F.max("adjusted_high").over(panel.last(20)) - F.min("adjusted_low").over(panel.last(20))}
    return df.withColumns(names).select(panel.entity, panel.time, "sequence", "previous_close", *names)


METRICS = {
    "natr14": natr, "log_range20": log_range, "ma_spread": ma_spread, "vwap_spread": vwap_spread, "efficiency_ratio20": efficiency_ratio,
    "abs_trend_t20": abs_trend_t, "turnover_shrink": turnover_shrink, "log_amount20": log_amount, "body_to_cloud": body_to_cloud,
    "outside_cloud_rate": outside_cloud_rate, "body_cloud_gap": body_cloud_gap,
}


#: Metrics with windows over what other windows give.
NESTED = ("body_to_cloud", "outside_cloud_rate", "body_cloud_gap")


def side_by_side(df: DataFrame, names: list[str], panel: Panel = PANEL, fields: tuple[str, ...] = (), more: tuple[str, ...] = ()) -> DataFrame:
    """Several metrics of a day in one row, a struct of ``fields`` (none: all) each, and the columns ``more``: all windows stand over one sort of the panel.

    Sliding windows (but those of ``NESTED``) are summed by numpy over batches of rows that follow each other, after all other windows.
    ``_place`` of ``more`` is a row's place in its series.
    """
    told, own = {}, replace(panel, fields=fields, rolls=Rolls())
    for name in names:
        df = METRICS[name](df, panel=replace(own, keep=name, rolls=None if name in NESTED else own.rolls))
        told[name] = tuple(c.removeprefix(f"{name}__") for c, kind in df.dtypes if c.startswith(f"{name}__") and kind == "boolean")
    asked, values = own.rolls.asked, own.rolls.values
    if asked and values:
        df = df.withColumn("_rolled", rolls_udf(asked)("_place", *[F.col(c).cast("double") for c in asked]))
    for columns in ([*own.rolls.layers, values] if values else []):
        df = df.withColumns(columns)
    return df.select(panel.entity, panel.time, *more, *[F.struct(*_told(name, flags, own)).alias(name) for name, flags in told.items()])


def stacked(df: DataFrame, names: list[str], panel: Panel = PANEL) -> DataFrame:
    """Rows of several metrics with their ``indicator``: the panel is stacked once."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("indicator"), F.col(n).alias("of")) for n in names])).alias("one")
    return side_by_side(df, names, panel).select(panel.entity, panel.time, each).select(panel.entity, panel.time, "one.indicator", "one.of.*")
