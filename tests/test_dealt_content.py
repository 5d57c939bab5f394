"""Content ids of tables that are dealt once, bare."""

import re

import pytest
from pyspark.sql import functions as F

from panelwright.operators import digests as G
from tests.test_one_deal import exchanges


def table(spark, n):
    """Some rows twice or more, nulls among them."""
    rows = spark.range(n).select(F.col("id").alias("a"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("x"), F.col("id") % 97)).alias("b"))
    return rows.unionByName(rows.where("a % 11 = 0")).unionByName(rows.where("a % 22 = 0")).repartition(5)


@pytest.mark.parametrize("n,leaf,dealt", [(0, 4, False), (3, 4, False), (900, 4, False), (900, 1, True), (5000, 4, True), (4096, 16, True), (4097, 16, True), (20000, 16, True), (70000, 16, True)])
def test_one_deal_gives_the_id_of_the_whole_table(spark, monkeypatch, n, leaf, dealt):
    df, again = table(spark, n), []
    (want,) = G.content_id(df, ["a", "b"], leaf).collect()
    whole = G.content_id
    monkeypatch.setattr(G, "content_id", lambda *a: again.append(1) or whole(*a))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 700)
    try:
        (got,) = G.dealt_content_id(df, ["a", "b"], leaf).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want and got.n_distinct == n
    assert not (dealt and again)


def test_a_table_taken_for_another_size_is_counted_whole(spark, monkeypatch):
    df = table(spark, 5000)
    (want,) = G.content_id(df, ["a", "b"], 4).collect()
    monkeypatch.setattr(G.Leaves, "_depths", lambda self, held: (4, 4))
    assert G.dealt_content_id(df, ["a", "b"], 4).collect() == [want]


def test_rows_are_dealt_without_their_digests_and_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(G, "written", lambda df, name: seen.append(exchanges(df)) or df)
    G.dealt_content_id(table(spark, 5000), ["a", "b"], 4)
    (kinds,) = seen
    assert kinds[0] == ["bigint", "string"] and not re.search("binary", str(kinds))
