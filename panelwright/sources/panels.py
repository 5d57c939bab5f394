"""Sources and sinks, and the panels that queries build from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions.conventions import PANEL, ratio


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Parquet; columns and filters reach the files."""
    return spark.read.parquet(path)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header, read with a declared schema."""
    return spark.read.option("header", True).schema(schema).csv(path)


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Folders of JSON lines, read with a declared schema; partition folders become columns."""
    return spark.read.schema(schema).json(path)


def normalise(df: DataFrame, aliases: dict[str, tuple[str, ...]], defaults: dict[str, str] | None = None) -> DataFrame:
    """One column a logical field: the first of its aliases that is there and not null, else its default."""
    out = []
    for name, choices in aliases.items():
        found: list[Column] = [F.col(c) for c in choices if c in df.columns]
        if defaults and name in defaults:
            found.append(F.lit(defaults[name]))
        out.append((F.coalesce(*found) if found else F.lit(None).cast("string")).alias(name))
    return df.select(*out)


def scope(df: DataFrame, entity: str, time: str, ids: list | None = None, start: str | None = None, end: str | None = None, first: int | None = None) -> DataFrame:
    """Restrict a scan by a list of entities, a range of dates, and the first entities in order."""
    if ids is not None:
        df = df.where(F.col(entity).isin(ids))
    if start is not None:
        df = df.where(F.col(time) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(time) <= F.lit(end).cast("date"))
    if first is not None:
        df = df.join(F.broadcast(df.select(entity).distinct().orderBy(entity).limit(first)), entity, "left_semi")
    return df


def write_parquet(df: DataFrame, path: str, order: list[str], partition: list[str] = ()) -> None:
    df.sortWithinPartitions(*order).write.option("compression", "zstd").partitionBy(*partition).parquet(path)


def write_report(df: DataFrame, path: str, columns: list[str]) -> None:
    """A CSV report with fixed columns; reports are small, and stand in one file."""
    df.select(*columns).coalesce(1).write.option("header", True).csv(path)


def merge_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One table from shards; a column that a shard lacks is null there."""
    out = spark.read.parquet(paths[0])
    for path in paths[1:]:
        out = out.unionByName(spark.read.parquet(path), allowMissingColumns=True)
    return out


def daily_prices(lineitem: DataFrame) -> DataFrame:
    """Panel of suppliers by ship date: open, high, low and close of the unit price, volume, amount, turnover.

    A day is suspended where its distance to 1995-01-01 divides by 97.
    """
    rows = lineitem.select(F.col("l_suppkey").alias("security_id"), F.to_date("l_shipdate").alias("trading_date"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    # dealt once, bare: days of a supplier and the windows over them meet where its rows lie, and what is made of a row is made there
    price, place = ratio(F.col("l_extendedprice"), F.col("l_quantity")), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rows = rows.repartition("security_id").withColumns({"price": price, "place": place})
    days = rows.groupBy("security_id", "trading_date").agg(
        F.min_by("price", "place").alias("adjusted_open"),
        F.max("price").alias("adjusted_high"),
        F.min("price").alias("adjusted_low"),
        F.max_by("price", "place").alias("adjusted_close"),
        F.sum("l_quantity").alias("volume_shares"),
        F.sum("l_extendedprice").alias("amount_yuan"),
    )
    return days.select(
        "*", ratio(F.col("amount_yuan"), F.col("volume_shares")).alias("daily_vwap"),
        (F.col("volume_shares") / (1000 + F.col("security_id"))).alias("turnover_float"),
        (F.datediff("trading_date", F.lit("1995-01-01").cast("date")) % 97 == 0).alias("suspension_flag"),
    )


def user_days(events: DataFrame) -> DataFrame:
    """Panel of users by day: number and sum of their events, rounded to cents."""
    return events.groupBy(F.col("user_id").alias("security_id"), F.to_date("ts").alias("trading_date")).agg(
        F.count("*").alias("n_events"), F.round(F.sum("value"), 2).alias("total")
    )


def user_spine(events: DataFrame) -> DataFrame:
    """Every user on every day of the table, with an observation number from 0 and a three-valued state.

    The state is null where the user has no events, else whether the day's sum is above 300 (a day of
    a user with an id divisible by 7 on the 13th is not eligible and null too).
    """
    days = user_days(events)
    users, dates = days.select("security_id").distinct(), days.select("trading_date").distinct()
    dense = users.crossJoin(F.broadcast(dates)).join(days, ["security_id", "trading_date"], "left")
    barred = (F.col("security_id") % 7 == 0) & (F.dayofmonth("trading_date") == 13)
    status = F.when(barred, "blocked").when(F.col("total").isNull(), "unknown").otherwise("valid")
    return dense.select(
        "*", (F.row_number().over(PANEL.order()) - 1).cast("long").alias("observation_sequence"), status.alias("validity_status"),
        F.when(status == "valid", F.col("total") > 300).alias("raw_state"),
    )
