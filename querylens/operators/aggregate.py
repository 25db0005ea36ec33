"""The flagship: cumulative cost per fingerprint, with keyset pages."""

from __future__ import annotations

import base64
import binascii
import datetime as dt
import json
import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylens.functions.text import text_hash
from querylens.operators.filters import between, excluding

#: The days of the default window, and the default and greatest page.
WINDOW_DAYS, LIMIT, MOST = 15, 200, 1000

CURSOR_ID = re.compile(r"[A-Za-z0-9_-]+")
HASH = re.compile(r"[a-f0-9]{16}")


@dataclass(frozen=True)
class Cursor:
    """The last row of a page."""

    execution_time_ms: float
    id: str

    def encode(self) -> str:
        ms = self.execution_time_ms
        number = int(ms) if math.isfinite(ms) and ms == int(ms) and abs(ms) < 1e21 else ms
        return base64.b64encode(json.dumps({"execution_time_ms": number, "id": self.id}, separators=(",", ":")).encode()).decode()

    @classmethod
    def decode(cls, text: str) -> Cursor | None:
        """A blank text is no cursor; ValueError if it can't be one."""
        if not text.strip():
            return None
        for altchars in (None, b"-_"):
            try:
                found = json.loads(base64.b64decode(text, altchars=altchars, validate=True))
                ms, id_ = found.get("execution_time_ms", 0), found.get("id", "")
            except (binascii.Error, ValueError, AttributeError):
                continue
            if isinstance(ms, (int, float)) and not isinstance(ms, bool) and isinstance(id_, str) and CURSOR_ID.fullmatch(id_):
                return cls(float(ms), id_)
        raise ValueError("invalid cursor")


def known_hashes(text: str) -> list[str]:
    """The distinct hashes of a comma list; ValueError if one can't be a hash."""
    found = dict.fromkeys(h for part in text.split(",") if (h := part.strip().lower()))
    if any(not HASH.fullmatch(h) for h in found):
        raise ValueError("invalid known_hashes")
    return list(found)


def latest(column: str, ts: str = "ts", tie: str = "id") -> Column:
    """The value of the newest row where it isn't null; of equally new rows the
    one with the smallest id.  Each column may be from another row."""
    return F.max_by(F.col(column), F.when(F.col(column).isNotNull() & F.col(ts).isNotNull(), F.struct(F.col(ts), (-F.col(tie)).alias("t"))))


def fingerprint_costs(records: DataFrame, min_execution_ms: float = 0.0, exclude: Sequence[str] = ()) -> DataFrame:
    """One row per fingerprint of ``records`` (with source), none of them in
    ``exclude`` (text hashes) or cheaper than ``min_execution_ms``."""
    text = lambda c: F.coalesce(latest(c), F.lit(""))
    hosts = F.array_sort(F.collect_set(F.when(F.col("source_host") != "", F.col("source_host"))))
    grouped = records.groupBy(F.col("fingerprint_id").alias("group_id")).agg(
        text("sanitized_sql").alias("text"),
        text("sample_sql").alias("raw_query"),
        text("db").alias("source"),
        (F.coalesce(F.sum("query_time_sec"), F.lit(0.0)) * 1000.0).alias("execution_time_ms"),
        F.count("*").alias("calls"),
        F.coalesce(latest("tables"), F.array().cast("array<string>")).alias("tables"),
        F.max("ts").alias("latest_ts"),
        *(latest(c).alias(c) for c in ("user", "host", "rows_sent", "rows_examined", "lock_time_sec")),
        hosts.alias("source_hosts"),
    )
    grouped = grouped.withColumnRenamed("group_id", "id").where(F.col("execution_time_ms") >= min_execution_ms)
    return excluding(grouped, text_hash(F.col("text")), exclude)


def fingerprint_count(logs: DataFrame, min_execution_ms: float = 0.0, exclude: Sequence[str] = ()) -> DataFrame:
    """How many rows :func:`fingerprint_costs` has, from three columns of the
    bare logs."""
    grouped = logs.groupBy("fingerprint_id").agg(
        F.coalesce(latest("sanitized_sql"), F.lit("")).alias("text"),
        (F.coalesce(F.sum("query_time_sec"), F.lit(0.0)) * 1000.0).alias("execution_time_ms"),
    )
    grouped = excluding(grouped.where(F.col("execution_time_ms") >= min_execution_ms), text_hash(F.col("text")), exclude)
    return grouped.agg(F.count("*").alias("total_count"))


def after(cursor: Cursor) -> Column:
    """Rows that come after a page's last one."""
    ms = F.lit(cursor.execution_time_ms)
    return (F.col("execution_time_ms") < ms) | ((F.col("execution_time_ms") == ms) & (F.col("id") > cursor.id))


def page(costs: DataFrame, limit: int, cursor: Cursor | None = None) -> DataFrame:
    """The next ``limit`` rows and one more, which tells if there are more."""
    if cursor:
        costs = costs.where(after(cursor))
    return costs.orderBy(F.desc("execution_time_ms"), "id").limit(limit + 1)


def window(logs: DataFrame, since: dt.datetime, until: dt.datetime, database: str = "") -> DataFrame:
    out = logs.where(between(since, until))
    return out.where(F.col("db") == database) if database else out
