"""A layer turned round inside its blocks, from arrays against a join of its days."""

import datetime
import random
import re

from panelwright.operators import nulls as N
from panelwright.operators import statistics as A
from panelwright.plans import nulls
from tests.test_one_deal import TESTDATA, exchanges, rows_of

COLUMNS = ["security_id", "trading_date", "block", "pos", "replicate", "shifted"]


def test_arrays_give_the_days_of_a_join(spark):
    rng, rows = random.Random(2), []
    for e in range(6):
        day = datetime.date(2020, 11, 1)
        for _ in range([1, 2, 40, 120, 33, 7][e]):
            rows.append((e, day, rng.choice([True, False, None])))
            day += datetime.timedelta(rng.choice([1, 1, 1, 3, 12]))
    days = spark.createDataFrame(rows, "security_id long, trading_date date, C boolean").repartition(3)
    placed = A.blocks(days, 7)
    want = A.shifted(placed, "C", 3, 20).join(placed.select(*N.BLOCK, "pos", "trading_date"), [*N.BLOCK, "pos"])
    got = N.turned_days(days, "C", 7, 3, 20)
    assert rows_of(got, COLUMNS) == rows_of(want, COLUMNS) and got.count() == 3 * len(rows)


def test_lines_and_days_are_dealt_once_and_meet_no_table(spark):
    df = nulls.queries()["nm03_shifted_layer"](spark, TESTDATA)
    assert len(exchanges(df)) == 2 and not re.search("SortMergeJoin|HashJoin", df._jdf.queryExecution().executedPlan().toString())
