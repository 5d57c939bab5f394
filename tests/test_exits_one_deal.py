"""Re-entries of requests that stand side by side."""

import re

from panelwright.operators import requests as DY
from panelwright.plans import requests as PR
from tests.test_one_deal import REQUESTS, TESTDATA, exchanges, rows_of, wide  # noqa: F401


def test_reentries_equal_a_join_with_the_days(spark, wide):  # noqa: F811
    want = DY.reentries(DY.request_intervals(wide, REQUESTS), DY.joint_confirm(DY.joint(wide, REQUESTS)), (2, 5, 20))
    got = DY.request_reentries(wide, REQUESTS, (2, 5, 20))
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert rows_of(got, want.columns) == rows_of(want, want.columns)
    assert {r[0] for r in got.select("outcome").distinct().collect()} == {"re_entered", "interrupted", "insufficient", "none"}


def test_reentries_deal_lines_once_days_once_and_join_nothing(spark):
    df = PR.queries()["ex03_reentries"](spark, TESTDATA)
    assert len(exchanges(df)) == 2
    assert not re.search("SortMergeJoin|HashJoin", df._jdf.queryExecution().executedPlan().toString())
