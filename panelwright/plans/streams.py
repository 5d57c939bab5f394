"""The streaming query, with the SQL of the batch result that it equals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from panelwright.plans.sql import query
from panelwright.plans.states import spine
from panelwright.sources.scratch import shared_folder
from panelwright.streaming.confirm import replay


def _confirm(spark, d: str) -> DataFrame:
    return replay(spine(spark, d), f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}", 2)


def queries() -> dict:
    return {"sm01_stream_confirmation": _confirm}


def oracle_sql() -> dict[str, str]:
    return {
        "sm01_stream_confirmation": query(
            """select security_id, 'confirmed' as event, cast(confirmation_date as varchar) as trading_date, cast(raw_start_date as varchar) as start_date, 2 as streak from us_int where k = 2
union all select security_id, 'exit', cast(last_observed_date as varchar), cast(raw_start_date as varchar), duration_raw_days::int from us_int where k = 2 and not is_open"""
        )
    }
