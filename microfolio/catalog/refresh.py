"""Marts refreshed from landed files."""

import uuid

from pyspark.sql import functions as F

from ..session import stages_folder
from ..streaming.refresh import (
    appended, counted, landing_of, largest, merged_by_load, rebuilt, rebuilt_days, refresh_on_load, smallest, summed, truncated,
)
from . import service
from .base import query


def _folder(src) -> str:
    return f"{stages_folder(src.spark)}/refresh-{uuid.uuid4().hex}"


def _on_events(src, folder, refresh):
    landing, glob = landing_of(src.spark, f"{src.sf_dir}/events.parquet")
    refresh_on_load(src.spark, landing, src.table("events").schema, f"{folder}/progress", refresh, glob)


def movements(rows):
    day = F.col("ts").cast("date").alias("update_date")
    return rows.groupBy(day, "event_type").agg(F.count(F.lit(1)).alias("movements"), F.sum("event_id").alias("id_sum"))


@query(
    "r1_refresh_on_load",
    """SELECT CAST(ts AS DATE) AS update_date, event_type, count(*) AS movements, CAST(sum(event_id) AS BIGINT) AS id_sum
       FROM events GROUP BY 1, 2""",
)
def r1(src):
    folder = _folder(src)
    _on_events(src, folder, rebuilt_days(lambda: src.table("events"), "CAST(ts AS DATE)", movements, f"{folder}/mart"))
    return src.spark.read.parquet(f"{folder}/mart")


@query("r1_appended_history_box", f"WITH {service.P1} SELECT * FROM p1", service.P1_VIEWS)
def r1_appended(src):
    """An appending service mart, built from whole tables when events land."""
    folder = _folder(src)
    _on_events(src, folder, rebuilt(lambda: service.history_box(src), appended(f"{folder}/mart")))
    return src.spark.read.parquet(f"{folder}/mart")


@query("r1_truncated_arrears_summary", f"WITH {service.P6} SELECT * FROM p6", service.P6_VIEWS)
def r1_truncated(src):
    """A truncating service mart, built from whole tables when events land."""
    folder = _folder(src)
    _on_events(src, folder, rebuilt(lambda: service.arrears_summary(src), truncated(f"{folder}/mart")))
    return src.spark.read.parquet(f"{folder}/mart")


@query(
    "r1_merged_by_load",
    """SELECT CAST(ts AS DATE) AS update_date, event_type, count(*) AS movements, CAST(sum(event_id) AS BIGINT) AS id_sum,
              min(event_id) AS first_id, max(event_id) AS last_id, count(*) FILTER (user_id % 2 = 0) AS even_users
       FROM events GROUP BY 1, 2""",
)
def r1_merged(src):
    """Three loads that share their days, each taken up from its own rows; the mart of all of them is never read from raw rows again."""
    folder = _folder(src)
    events = src.table("events")
    refresh = merged_by_load(
        F.col("ts").cast("date"), {"event_type": F.col("event_type")},
        {
            "movements": counted(), "id_sum": summed("event_id"), "first_id": smallest("event_id"), "last_id": largest("event_id"),
            "even_users": counted(F.col("user_id") % 2 == 0),
        },
        f"{folder}/state", f"{folder}/mart",
    )
    for k in range(3):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k).write.mode("append").parquet(f"{folder}/landing")
        refresh_on_load(src.spark, f"{folder}/landing", events.schema, f"{folder}/progress", refresh)
    return src.spark.read.parquet(f"{folder}/mart")
