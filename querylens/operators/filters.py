"""Record filters and orders as columns: values never become SQL text."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest list that is compared literally; longer ones become a join.
LITERALS = 500


@dataclass(frozen=True)
class RecordFilter:
    """What a listing is narrowed to; an empty or ``None`` part doesn't count.

    ``tables`` must all be among a record's tables.  Bounds on times are
    inclusive, the others are not.
    """

    users: Sequence[str] = ()
    hosts: Sequence[str] = ()
    dbs: Sequence[str] = ()
    source_hosts: Sequence[str] = ()
    tables: Sequence[str] = ()
    fingerprint_id: str = ""
    query_time_gt: float | None = None
    query_time_lt: float | None = None
    lock_time_gt: float | None = None
    lock_time_lt: float | None = None
    rows_examined_gt: int | None = None
    ts_from: dt.datetime | None = None
    ts_to: dt.datetime | None = None
    file_path: str = ""

    def conditions(self, files: DataFrame | None = None) -> list[Column]:
        """One condition for each part.  ``files`` is needed for a file path: it
        stands for the newest generation of that path."""
        out = []
        for name, values in (("user", self.users), ("host", self.hosts), ("db", self.dbs), ("source_host", self.source_hosts)):
            if values:
                out.append(F.col(name).isin([v.strip() for v in values]))
        out += [has_table(t.strip()) for t in self.tables]
        if self.fingerprint_id:
            out.append(F.col("fingerprint_id") == self.fingerprint_id)
        bounds = (
            ("query_time_sec", "__gt__", self.query_time_gt),
            ("query_time_sec", "__lt__", self.query_time_lt),
            ("lock_time_sec", "__gt__", self.lock_time_gt),
            ("lock_time_sec", "__lt__", self.lock_time_lt),
            ("rows_examined", "__gt__", self.rows_examined_gt),
        )
        out += [getattr(F.col(name), op)(F.lit(value)) for name, op, value in bounds if value is not None]
        if self.ts_from is not None:
            out.append(F.col("ts") >= timestamp(self.ts_from))
        if self.ts_to is not None:
            out.append(F.col("ts") <= timestamp(self.ts_to))
        if self.file_path:
            if files is None:
                raise ValueError("a filter by file path needs the files table")
            newest = newest_generation(files, self.file_path).select("hash").first()
            out.append(F.col("file_hash") == (newest.hash if newest else None))
        return out

    def apply(self, records: DataFrame, files: DataFrame | None = None) -> DataFrame:
        found = self.conditions(files)
        return records.where(reduce(and_, found)) if found else records


def timestamp(value: dt.datetime) -> Column:
    """A literal without a zone; one with a zone is taken to UTC."""
    if value.tzinfo is not None:
        value = value.astimezone(dt.UTC).replace(tzinfo=None)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def has_table(name: str) -> Column:
    """Whether a record touches a table, its name as is or in double quotes;
    false, not null, where the array holds nulls."""
    return F.exists("tables", lambda t: t.eqNullSafe(F.lit(name)) | t.eqNullSafe(F.lit(f'"{name}"')))


def between(since: dt.datetime, until: dt.datetime) -> Column:
    """An inclusive window; pushed down to the scan."""
    return (F.col("ts") >= timestamp(since)) & (F.col("ts") <= timestamp(until))


def not_empty(name: str) -> Column:
    return F.col(name).isNotNull() & (F.col(name) != "")


def newest_generation(files: DataFrame, path: str) -> DataFrame:
    """The state of a path's newest generation (no row if there is none)."""
    return files.where(F.col("file_path") == path).orderBy(F.desc("generation")).limit(1)


def excluding(df: DataFrame, key: Column, values: Sequence[str]) -> DataFrame:
    """Rows whose key isn't null and isn't among the values (without any, all
    rows).  A long list is an anti join against a table of it, broadcast by its
    size or not."""
    if not values:
        return df
    if len(values) <= LITERALS:
        return df.where(~key.isin(list(values)))
    listed = df.sparkSession.createDataFrame([(v,) for v in values], "excluded_key string")
    return df.where(key.isNotNull()).join(listed, key == F.col("excluded_key"), "left_anti")


#: Columns a listing may be ordered by.
ORDERS = frozenset(
    """
    id fingerprint_id sanitized_sql sample_sql user host db query_time_sec lock_time_sec rows_sent rows_examined ts
    created_at
    """.split()
)


def ordered(df: DataFrame, by: str = "id", direction: str = "asc", tie: str | None = "id") -> DataFrame:
    """Ordered by an allowed column (any other: id), ascending unless the
    direction is ``desc``; nulls come last either way.  ``tie`` makes the order total."""
    by = by if by in ORDERS else "id"
    column = F.col(by).desc_nulls_last() if direction == "desc" else F.col(by).asc_nulls_last()
    return df.orderBy(column, *([F.col(tie).asc_nulls_last()] if tie and tie != by else []))
