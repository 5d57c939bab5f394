"""Value conventions that all panel operators share."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

# Statuses in order of severity, and the slack of threshold comparisons.
STATUSES = ("valid", "unknown", "diagnostic_required", "blocked")
EPSILON = 1e-12


@dataclass(frozen=True)
class Panel:
    """Names of a panel's entity and time columns.

    With ``keep``, a metric adds its results as one struct of that name and leaves the panel's rows and columns,
    so that many metrics can follow each other over one sort of the panel; ``fields`` are those of the struct (none: all).
    Windows that only other fields need are not computed. With ``rolls``, aggregates of ``rolled`` and values made of them are put off
    until all metrics have asked for theirs.
    """

    entity: str = "security_id"
    time: str = "trading_date"
    keep: str | None = None
    fields: tuple[str, ...] = ()
    rolls: Rolls | None = None

    def order(self, *more: str) -> WindowSpec:
        return Window.partitionBy(self.entity, *more).orderBy(self.time)

    def last(self, n: int, *more: str) -> WindowSpec:
        """The current row and the n - 1 before it."""
        return self.order(*more).rowsBetween(1 - n, 0)

    def prefix(self, *more: str) -> WindowSpec:
        return self.order(*more).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def rolled(self, kind: str, column: str, n: int, back: int = 0) -> Column:
        """``kind`` (of ``SLIDING``) of a column over n rows that end ``back`` rows before the current one."""
        if self.rolls is None:
            return SLIDING[kind](column).over(self.order().rowsBetween(1 - n - back, -back))
        return self.rolls.ask(kind, column, n, back)

    def named(self, df: DataFrame, columns: dict[str, Column]) -> tuple[DataFrame, list[Column]]:
        """What is made of ``rolled``, in columns of its own, so that it is computed once however often it is used."""
        if self.rolls is None:
            return df.withColumns(columns), [F.col(c) for c in columns]
        self.rolls.layers.append({f"{self.keep}__{name}": c for name, c in columns.items()})
        return df, [F.col(f"{self.keep}__{name}") for name in columns]


@dataclass
class Rolls:
    """What metrics of a panel ask of its sliding windows (column: kind, n, back by name), and what waits for it: ``layers`` of
    columns that each stand on those before, and values by name."""

    asked: dict[str, dict[str, tuple[str, int, int]]] = field(default_factory=dict)
    layers: list[dict[str, Column]] = field(default_factory=list)
    values: dict[str, Column] = field(default_factory=dict)

    def ask(self, kind: str, column: str, n: int, back: int) -> Column:
        name = f"{kind}{column}_{n}_{back}"
        self.asked.setdefault(column, {})[name] = (kind, n, back)
        return F.col(f"_rolled.{name}")


#: Aggregates of sliding windows; regr_ ones take the column against the row's place in its series.
SLIDING = {
    "avg": F.avg, "sum": F.sum, "max": F.max, "min": F.min,
    **{f"regr_s{x}": (lambda c, x=x: F.expr(f"regr_s{x}({c}, cast(_place as double))")) for x in ("xx", "xy", "yy")},
}
PANEL = Panel()


def severity(status: Column) -> Column:
    """Rank of a status (unknown names and null: the highest)."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STATUSES)), status), F.lit(0)) - 1, F.lit(len(STATUSES) - 1))


def worst_status(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, STATUSES)), rank.cast("int") + 1)


def reason_list(**conditions: Column) -> Column:
    """Names of the conditions that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in conditions.items()]))


def meets(value: Column, threshold: Column | float) -> Column:
    """value >= threshold with the conventional slack; null when either is null."""
    return value + EPSILON >= threshold


def finite(value: Column) -> Column:
    """Whether a value is there and neither NaN nor infinite (Spark sorts NaN above all numbers)."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def chain_and(left: Column, right: Column) -> Column:
    """Ordered AND: false wins on the left, then null, then the right side decides."""
    return F.when(left == F.lit(False), F.lit(False)).when(left.isNull(), F.lit(None).cast("boolean")).otherwise(right)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null for a zero or null denominator."""
    return F.when(b != 0, a.cast("double") / b)


def islands(df: DataFrame, flag: str, keys: list[str], order: str, name: str = "run") -> DataFrame:
    """Number the maximal runs of rows with a true ``flag``: ``name`` is null outside of them."""
    w = Window.partitionBy(*keys).orderBy(order)
    on = F.coalesce(F.col(flag), F.lit(False))
    begins = on & ~F.coalesce(F.lag(on).over(w), F.lit(False))
    running = F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(name, F.when(on, running))


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], ties: list[str] = (), strict: bool = False) -> DataFrame:
    """For each left row the last right row of its keys at or before its time (``strict``: before it); ties go to the largest ``ties``.

    Both sides are put in one sequence for each key, right rows before left rows of the same time (``strict``: after them).
    """
    shape, mine, theirs = [*keys, *[c for c in left.columns if c not in keys]], int(not strict), int(strict)
    row = F.struct(F.col(right_time).alias("_matched"), *values)
    l = left.select(*shape, F.col(left_time).alias("_t"), F.lit(mine).alias("_side"), *[F.lit(None).cast(right.schema[t].dataType).alias(f"_{t}") for t in ties])
    r = right.select(*keys, F.col(right_time).alias("_t"), F.lit(theirs).alias("_side"), *[F.col(t).alias(f"_{t}") for t in ties], row.alias("_row"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_side", *[f"_{t}" for t in ties]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_row", F.last("_row", ignorenulls=True).over(w)).where(F.col("_side") == mine)
    return both.select(*shape, F.col("_row._matched").alias(f"matched_{right_time}"), *[F.col(f"_row.{v}").alias(v) for v in values])


def midrank(value: str, keys: list[str]) -> Column:
    """Average rank of ties within ``keys`` (1-based)."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2
