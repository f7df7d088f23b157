"""Event queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adlens.catalogue import query
from adlens.plans.ads import t
from adlens.streaming.launches import launches


@query("launches_per_day", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def launches_per_day(spark: SparkSession, d: str) -> DataFrame:
    return launches(t(spark, d, "events")).select("day", "event_type", "n")
