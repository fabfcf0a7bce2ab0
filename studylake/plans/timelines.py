"""Queries on what held at a time, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeline
from ..sources import views


def grade_before(spark, d):
    """Each review beside the user's last error: when it was, and how much it cost."""
    e = views.table(spark, d, "events")
    errors = e.filter("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("error"), "value")
    rows = timeline.as_of(e.filter("event_type <> 'error'").select("event_id", "user_id", "ts"), errors, ["user_id"], "ts", ["error", "value"])
    return rows.select("event_id", F.col("last_error").alias("error"), F.col("last_value").alias("value"))


def price_of_the_day(spark, d):
    """Each order beside its customer's last larger one, of at most a hundred days before."""
    o = views.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.unix_date(F.to_date("o_orderdate")).alias("day"), F.col("o_totalprice").alias("price"))
    large = o.filter("price > 200000").select("o_custkey", "day", "price")
    return timeline.as_of(o.select("o_orderkey", "o_custkey", "day"), large, ["o_custkey"], "day", ["price"], 100).select("o_orderkey", F.col("last_price").alias("price"))


def queries() -> dict:
    return {"grade_before": grade_before, "price_of_the_day": price_of_the_day}


SQL = {
    "grade_before": """with x as (select user_id, ts, max(event_id) as error, max_by(value, event_id) as value from events where event_type = 'error' group by all)
        select e.event_id, x.error, x.value from (select * from events where event_type <> 'error') e asof left join x on e.user_id = x.user_id and e.ts >= x.ts""",
    "price_of_the_day": """with o as (select o_orderkey, o_custkey, date_diff('day', date '1970-01-01', cast(o_orderdate as date)) as day, o_totalprice as price from orders), x as (select o_custkey, day, max(price) as price from o where price > 200000 group by all)
        select o.o_orderkey, case when o.day - x.day <= 100 then x.price end as price from o asof left join x on o.o_custkey = x.o_custkey and o.day >= x.day""",
}
