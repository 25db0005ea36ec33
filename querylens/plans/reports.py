"""The ready-made reports and searches over the logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylens.operators.filters import has_table

#: The length of a time bucket and how its start is written.
BUCKETS = {"minute": "yyyy-MM-dd HH:mm", "hour": "yyyy-MM-dd HH:00", "day": "yyyy-MM-dd"}


def _times(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("query_count"),
        F.avg("query_time_sec").alias("avg_time"),
        F.max("query_time_sec").alias("max_time"),
        F.sum("query_time_sec").alias("total_time"),
    )


def top_queries(logs: DataFrame, limit: int = 10) -> DataFrame:
    """Fingerprints by the time they took in all."""
    found = _times(logs, "fingerprint_id", "sanitized_sql").orderBy(F.desc_nulls_last("total_time"), "fingerprint_id", "sanitized_sql").limit(limit)
    return found.select("fingerprint_id", F.col("sanitized_sql").alias("fingerprint"), F.col("query_count").alias("count"), "avg_time", "max_time", "total_time")


def pattern_frequency(logs: DataFrame) -> DataFrame:
    """Fingerprints by how often they ran."""
    found = _times(logs, "fingerprint_id", "sanitized_sql").orderBy(F.desc("query_count"), "fingerprint_id", "sanitized_sql")
    return found.select("fingerprint_id", F.col("sanitized_sql").alias("fingerprint"), F.col("query_count").alias("count"), "avg_time", "max_time", "total_time")


def slowest(logs: DataFrame, limit: int = 10, min_time: float = 0.0) -> DataFrame:
    found = logs.where(F.col("query_time_sec") >= min_time).orderBy(F.desc_nulls_last("query_time_sec"), "id").limit(limit)
    return found.select("sample_sql", "query_time_sec", "ts", "user", "host", "db")


def table_usage(logs: DataFrame) -> DataFrame:
    exploded = logs.select(F.explode("tables").alias("table_name"), "query_time_sec")
    return _times(exploded, "table_name").select("table_name", "query_count", "avg_time").orderBy(F.desc("query_count"), "table_name")


def timeline(logs: DataFrame, interval: str = "hour") -> DataFrame:
    bucket = F.date_format(F.date_trunc(interval, "ts"), BUCKETS[interval])
    return _times(logs.where("ts is not null").withColumn("time_bucket", bucket), "time_bucket").drop("total_time").orderBy("time_bucket")


def search_fingerprint(logs: DataFrame, text: str) -> DataFrame:
    """Fingerprints that contain a text, any case; the text is no pattern."""
    found = logs.where(F.contains(F.lower("sanitized_sql"), F.lit(text.lower())))
    newest = F.max_by("sample_sql", F.struct("ts", -F.col("id")))
    return found.groupBy(F.col("sanitized_sql").alias("fingerprint")).agg(newest.alias("sample_sql")).orderBy("fingerprint")


def search_table(logs: DataFrame, table: str) -> DataFrame:
    found = logs.where(has_table(table)).orderBy(F.desc_nulls_last("query_time_sec"), "id")
    return found.select("sample_sql", "query_time_sec", "ts")


def full_scans(logs: DataFrame, examined: int = 10_000, sent: int = 100) -> DataFrame:
    found = logs.where((F.col("rows_examined") > examined) & (F.col("rows_sent") < sent))
    return found.select("id", "sample_sql", "query_time_sec", "rows_examined", "rows_sent").orderBy(F.desc("rows_examined"), "id")


def by_user(logs: DataFrame) -> DataFrame:
    return _times(logs, "user").drop("total_time").orderBy(F.desc("query_count"), "user")


def by_fingerprint(logs: DataFrame, fingerprint_id: str) -> DataFrame:
    found = logs.where(F.col("fingerprint_id") == fingerprint_id)
    return found.select("id", "sample_sql", "query_time_sec", "ts").orderBy(F.desc_nulls_last("query_time_sec"), "id")
