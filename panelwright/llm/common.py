"""Shared helpers of the corpus operators: materialised tables, text rules, small hash utilities."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and Python forms of the word rule: every maximal run without ASCII white space.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage: what ``spark.checkpoint.dir`` names.

    Only a local session, as in tests, may go without: it gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; executors need a folder that all of them share")
    root = tempfile.mkdtemp(prefix="panelwright-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, name: str, folders: list[str] = ()) -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint folder and read it back, which cuts its lineage.

    With ``folders``, rows stand in a folder for each value of these columns.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*folders).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Array of the words of a text (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n (null key: of the empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % n
