"""The streaming monitor's plan, run as a batch over all events."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrainframe.plans.registry import query
from terrainframe.streaming.monitor import run_quality
from terrainframe.tables import table


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS runs, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE value > 60) AS slow, round(avg(value), 6) AS mean_s FROM events GROUP BY 1, 2")
def run_quality_by_hour(spark, sf_dir):
    return run_quality(table(spark, sf_dir, "events")).withColumn("mean_s", F.round("mean_s", 6))
