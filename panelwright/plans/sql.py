"""Named SQL steps for the oracle: a query names the steps that it builds on, and gets them as a WITH list."""

from __future__ import annotations

import re

STEPS: dict[str, str] = {}


def step(name: str, body: str) -> None:
    STEPS[name] = body.strip()


def query(body: str) -> str:
    """``body`` preceded by all steps that it names, directly or through others."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in STEPS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(STEPS[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    return ("with " + ",\n".join(f"{n} as ({STEPS[n]})" for n in needed) + "\n" if needed else "") + body.strip()


step(
    "pday",
    """
select security_id, trading_date,
  arg_min(price, place) as adjusted_open, max(price) as adjusted_high, min(price) as adjusted_low, arg_max(price, place) as adjusted_close,
  sum(l_quantity) as volume_shares, sum(l_extendedprice) as amount_yuan, sum(l_extendedprice) / sum(l_quantity) as daily_vwap,
  sum(l_quantity) / (1000 + security_id) as turnover_float,
  datediff('day', date '1995-01-01', trading_date) % 97 = 0 as suspension_flag
from (select l_suppkey as security_id, cast(l_shipdate as date) as trading_date, l_extendedprice / l_quantity as price,
        row(l_orderkey, l_linenumber, l_partkey, l_extendedprice) as place, l_quantity, l_extendedprice from lineitem)
group by security_id, trading_date""",
)
step(
    "uday",
    """
select user_id as security_id, cast(ts as date) as trading_date, count(*) as n_events, round(sum(value), 2) as total
from events group by 1, 2""",
)
step(
    "uspine",
    """
select security_id, trading_date, n_events, total, row_number() over (partition by security_id order by trading_date) - 1 as observation_sequence,
  validity_status, case when validity_status = 'valid' then total > 300 end as raw_state
from (select u.security_id, d.trading_date, n_events, total,
        case when u.security_id % 7 = 0 and day(d.trading_date) = 13 then 'blocked' when total is null then 'unknown' else 'valid' end as validity_status
      from (select distinct security_id from uday) u cross join (select distinct trading_date from uday) d
      left join uday x on x.security_id = u.security_id and x.trading_date = d.trading_date)""",
)
