"""URL filters by a temporal list join, in DataFrame operations alone.

Dated list entries (a domain is put on a list or taken off it) become validity intervals; every
capture is evaluated against the entries of its host and the host's parent domains that were active
when it was fetched. Intervals are dealt to months, so that a host with many captures or entries meets
only those of the month; the join is an equality on (domain, month) with a range check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

FAR = "2100-01-01"
# The derived lists of the query: a year of captures, and three dated entries for a share of the domains.
FIRST_DAY, DAYS = "2024-01-01", 366


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user, port or trailing dot (null where there is none)."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.when(found != "", F.rtrim(found, F.lit(".")))


def domains_of(host: Column, labels: int = 2) -> Column:
    """The host and its parent domains of at least ``labels`` labels, longest first."""
    parts = F.split(host, r"\.")
    last = F.greatest(F.size(parts) - labels, F.lit(0))
    return F.when(host.isNull(), F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "."))
    )


def intervals(entries: DataFrame) -> DataFrame:
    """(list, domain, day, action add/remove) -> (list, domain, begin, until): days on the list, until excluded.

    Of entries for one day the last by action counts (remove after add). Entries with a null in any
    column say nothing and are passed over.
    """
    known = entries.dropna(subset=["list", "domain", "day", "action"])
    known = known.groupBy("list", "domain", "day").agg(F.max("action").alias("action"))
    until = F.lead("day").over(Window.partitionBy("list", "domain").orderBy("day"))
    known = known.select("list", "domain", F.col("day").alias("begin"), F.coalesce(until, F.lit(FAR).cast("date")).alias("until"), "action")
    return known.where("action = 'add' and begin < until").drop("action")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (page_id, url, fetched), entries -> page_id, url, fetched, host, domain, list, allowed.

    The longest domain with an active entry decides; at equal length ``allow`` overrules ``block``.
    Captures without an active entry, host or date are allowed and have a null domain and list.
    Repeated captures are each returned. URLs are read whole, however long; an empty table of captures gives no rows,
    one of entries allows all. Other columns play no part, whatever their names.
    """
    captures = captures.withColumn("host", host_of(F.col("url")))
    month = lambda day: F.year(day) * 12 + F.month(day)
    spans = intervals(entries)
    first, last = captures.agg(F.min("fetched"), F.max("fetched")).first()
    begin, until = F.greatest("begin", F.lit(first)), F.least(F.date_sub("until", 1), F.lit(last))
    spans = spans.where(begin <= until)
    spans = spans.withColumn("month", F.explode(F.sequence(month(begin), month(until))))
    sides = captures.where("fetched is not null").select("page_id", "url", "fetched", F.explode(domains_of(F.col("host"))).alias("domain"))
    sides = sides.withColumn("month", month(F.col("fetched")))
    active = sides.join(spans, ["domain", "month"]).where("begin <= fetched and fetched < until")
    rank = F.struct(F.length("domain").alias("n"), (F.col("list") == "allow").alias("allow"), "domain", "list")
    best = active.groupBy("page_id", "url", "fetched").agg(F.max(rank).alias("best"))
    out = captures.alias("c").join(best.alias("b"), F.expr("c.page_id <=> b.page_id and c.url = b.url and c.fetched = b.fetched"), "left")
    return out.select(
        "c.page_id", "c.url", "c.fetched", "c.host", F.col("best.domain").alias("domain"), F.col("best.list").alias("list"),
        F.coalesce(F.col("best.list") != "block", F.lit(True)).alias("allowed"),
    )


def derived_captures(pages: DataFrame) -> DataFrame:
    """Pages with a day of fetch that their id gives."""
    return pages.select("page_id", "url", F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(DAYS)).cast("int")).alias("fetched"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for two thirds of the hosts and parent domains (of three labels) in the pages."""
    domains = pages.select(F.explode(domains_of(host_of(F.col("url")), 3)).alias("domain")).distinct()
    domains = domains.withColumn("h", F.conv(F.substring(F.md5("domain"), 1, 4), 16, 10).cast("int")).where("h % 3 <> 2")
    at = lambda extra: F.date_add(F.lit(FIRST_DAY).cast("date"), F.col("h") % 200 + extra)
    off = 60 + F.col("h") % 37
    events = F.array(
        *[F.struct(at(extra).alias("day"), F.lit(action).alias("action")) for extra, action in ((F.lit(0), "add"), (off, "remove"), (off + 50, "add"))]
    )
    named = F.when(F.col("h") % 2 == 0, "block").otherwise("allow")
    return domains.select(named.alias("list"), "domain", F.explode(events).alias("e")).select("list", "domain", "e.day", "e.action")


def op4(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return evaluate(derived_captures(pages), derived_entries(pages)).select("page_id", "host", "fetched", "domain", "list", "allowed")


def op4_sql() -> str:
    return f"""
with c as (
  select page_id, date '{FIRST_DAY}' + ((page_id * 7919) % {DAYS})::int as fetched,
    nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '.'), '') as host
  from pages),
s as (
  select page_id, fetched, host, array_to_string(p[i:], '.') as dom, len(p) - i + 1 as labels
  from (select *, string_split(host, '.') as p from c) x, lateral (select unnest(range(1, greatest(len(p) - 1, 1) + 1)) as i) y),
d as (
  select dom, ('0x' || substr(md5(dom), 1, 4))::int as h
  from (select distinct dom from s where labels >= 3 or dom = host) u),
e as (select * from d where h % 3 <> 2),
v as (
  select case when h % 2 = 0 then 'block' else 'allow' end as lst, dom, date '{FIRST_DAY}' + (h % 200) as b, date '{FIRST_DAY}' + (h % 200 + 60 + h % 37) as u from e
  union all
  select case when h % 2 = 0 then 'block' else 'allow' end, dom, date '{FIRST_DAY}' + (h % 200 + 110 + h % 37), date '{FAR}' from e),
m as (
  select s.page_id, s.fetched, arg_max(struct_pack(dom := s.dom, lst := lst), (length(s.dom), lst = 'allow')) as best
  from s join v on s.dom = v.dom and s.fetched >= v.b and s.fetched < v.u group by all)
select c.page_id, c.host, c.fetched, best.dom as domain, best.lst as list, coalesce(best.lst <> 'block', true) as allowed
from c left join m using (page_id, fetched)"""
