"""Structured Streaming over growing slow logs: entries without repeats, and
costs per time window with bounded lateness."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from querylens.ingest import enriched
from querylens.sources import slowlog
from querylens.sources.state import identity

#: How late an event may be.
LATENESS = "10 minutes"


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of the logs in ``folder``, as they are written."""
    slowlog.register(spark)
    events = spark.readStream.format("slowlog").load(folder)
    # a stream reads a file from its start: its first generation
    named = F.arrow_udf(_identities, "string")(F.col("path"))
    return enriched(events.withColumn("file_hash", named))


def _identities(paths):
    import pyarrow as pa

    return pa.array([identity(p.as_py(), 1) for p in paths], pa.string())


def with_event_time(stream: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """The watermark that what follows goes by.  It needs a time with a zone;
    entries are UTC."""
    return stream.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", lateness)


def without_replays(stream: DataFrame) -> DataFrame:
    """One entry per file, offset and content, remembered for as long as one may
    be late.  A file that was rotated begins at offset 0 again: what is new there
    differs from what stood at its offset, and stays."""
    return stream.dropDuplicatesWithinWatermark(["file_hash", "event_offset", "event_hash"])


def windowed_costs(stream: DataFrame, length: str = "1 hour", slide: str | None = None, by: Iterable[str] = ("fingerprint_id",)) -> DataFrame:
    """Calls and time per window (tumbling, or sliding by ``slide``) and group."""
    when = F.window("event_time", length, slide) if slide else F.window("event_time", length)
    grouped = stream.groupBy(when.alias("w"), *by)
    found = grouped.agg(F.count("*").alias("calls"), F.sum("query_time_sec").alias("total_time"), F.max("query_time_sec").alias("max_time"))
    return found.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "calls", "total_time", "max_time")


def sessions(stream: DataFrame, gap: str = "5 minutes", by: str = "user") -> DataFrame:
    """Bursts of entries of a user (or another column) without a longer gap."""
    grouped = stream.groupBy(F.session_window("event_time", gap).alias("w"), by)
    return grouped.agg(F.count("*").alias("calls"), F.sum("query_time_sec").alias("total_time")).select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "calls", "total_time")


def _record(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The slowest time so far of a fingerprint; told whenever it rises."""
    (best,) = state.get if state.exists else (-1.0,)
    for rows in batches:
        top = rows.sort_values(["query_time_sec", "event_offset"], ascending=[False, True]).head(1)
        if len(top) and float(top.query_time_sec.iloc[0]) > best:
            best = float(top.query_time_sec.iloc[0])
            yield pd.DataFrame({"fingerprint_id": [key[0]], "query_time_sec": [best], "sample_sql": [top.sample_sql.iloc[0]]})
    state.update((best,))


def new_records(stream: DataFrame) -> DataFrame:
    """An entry whenever a fingerprint is slower than ever before."""
    narrow = stream.select("fingerprint_id", "query_time_sec", "sample_sql", "event_offset")
    return narrow.groupBy("fingerprint_id").applyInPandasWithState(
        _record, "fingerprint_id string, query_time_sec double, sample_sql string", "best double", "append", GroupStateTimeout.NoTimeout
    )


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A sink that holds each entry exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
