"""Slow-log tables derived from the driver's ``events``, the same in Spark and
in DuckDB, so that every operator can be held against plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.functions.text import fingerprint_id
from querylens.operators.records import with_source

# The files table; one hash of the events (h3) isn't among them.
FILES = (
    ("h0", "/var/log/mysql/prod-db-01.slow.log", 1, 1000, 1),
    ("h1", "/var/log/mysql/prod-db-02.slow.log", 1, 2000, 2),
    ("h2", "/var/log/mysql/prod-db-02.slow.log", 2, 3000, 1),
)


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``slow_logs`` over the events table."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    id_, user = F.col("event_id"), F.col("user_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    db = F.when(user % 3 == 0, "shop").when(user % 3 == 1, "analytics").otherwise("")
    out = events.select(
        id_.alias("id"),
        text("h", id_ % 4).alias("file_hash"),
        text("select * from ", F.col("event_type"), "_", user, " where k = ?").alias("sanitized_sql"),
        text("select * from ", F.col("event_type"), "_", user, " where k = ", id_).alias("sample_sql"),
        text("u", user % 7).alias("user"),
        text("10.0.0.", user % 5).alias("host"),
        db.alias("db"),
        F.col("value").alias("query_time_sec"),
        (F.col("value") / 1000).alias("lock_time_sec"),
        (id_ % 200).alias("rows_sent"),
        (id_ * 7 % 20000).alias("rows_examined"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("ts").cast("timestamp_ntz").alias("created_at"),
        F.when(db == "", F.array(F.col("event_type"))).otherwise(F.array(text(db, ".", F.col("event_type")), F.col("event_type"))).alias("tables"),
        id_.alias("event_offset"),
    )
    return out.withColumn("fingerprint_id", fingerprint_id(F.col("sanitized_sql")))


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, "hash string, file_path string, generation int, file_size long, parse_count int")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_source(logs(spark, sf_dir), files(spark))


#: DuckDB: the same tables, for the head of a query.
WITH = f"""
logs as (select event_id as id, 'h' || (event_id % 4) as file_hash,
  'select * from ' || event_type || '_' || user_id || ' where k = ?' as sanitized_sql,
  'select * from ' || event_type || '_' || user_id || ' where k = ' || event_id as sample_sql,
  upper(substr(md5('select * from ' || event_type || '_' || user_id || ' where k = ?'), 17, 16)) as fingerprint_id,
  'u' || (user_id % 7) as "user", '10.0.0.' || (user_id % 5) as host,
  case user_id % 3 when 0 then 'shop' when 1 then 'analytics' else '' end as db,
  value as query_time_sec, value / 1000 as lock_time_sec, event_id % 200 as rows_sent, event_id * 7 % 20000 as rows_examined,
  ts, ts as created_at,
  case user_id % 3 when 0 then ['shop.' || event_type, event_type] when 1 then ['analytics.' || event_type, event_type] else [event_type] end as tables,
  event_id as event_offset from events),
files as (select hash, file_path, generation, file_size::bigint as file_size, parse_count from (values {", ".join(repr(f) for f in FILES)}) as f(hash, file_path, generation, file_size, parse_count)),
records as (select l.*, regexp_replace(regexp_replace(f.file_path, '^.*[/\\\\]', ''), '(\\.(log|slow|gz))+$', '', 'i') as source_host
  from logs l left join files f on l.file_hash = f.hash)
"""
