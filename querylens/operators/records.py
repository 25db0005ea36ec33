"""Records with their source, listings, single records and facets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querylens.functions.text import preview, source_host
from querylens.operators.filters import RecordFilter, not_empty, ordered

#: Columns of a single record.
FULL = (
    "id",
    "fingerprint_id",
    "sanitized_sql",
    "sample_sql",
    "user",
    "host",
    "db",
    "query_time_sec",
    "lock_time_sec",
    "rows_sent",
    "rows_examined",
    "ts",
    "created_at",
    "tables",
    "source_host",
)
#: Columns that a listing shows the start of, and those it leaves out.
CUT, LEFT_OUT = ("sanitized_sql", "sample_sql"), ("tables",)


def with_source(logs: DataFrame, files: DataFrame) -> DataFrame:
    """``logs`` with ``source_host`` of its file (null for an unknown file).

    The files table is small next to the logs, but how small is for the
    optimiser to see from its statistics: no broadcast is forced.
    """
    named = files.select(F.col("hash").alias("of_hash"), source_host(F.col("file_path")).alias("source_host"))
    return logs.join(named, F.col("file_hash") == F.col("of_hash"), "left").drop("of_hash")


def create_views(logs: DataFrame, files: DataFrame) -> None:
    """The names raw SQL reads: slow_logs, files, slow_logs_with_source."""
    logs.createOrReplaceTempView("slow_logs")
    files.createOrReplaceTempView("files")
    with_source(logs, files).createOrReplaceTempView("slow_logs_with_source")


def listing(
    records: DataFrame,
    narrowed: RecordFilter | None = None,
    files: DataFrame | None = None,
    by: str = "id",
    direction: str = "asc",
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """A page of records (with source), filtered and ordered."""
    found = narrowed.apply(records, files) if narrowed else records
    found = ordered(found, by, direction)
    if offset:
        found = found.offset(offset)
    if limit is not None:
        found = found.limit(limit)
    return found.select(*(preview(F.col(c)).alias(f"{c}_preview") if c in CUT else F.col(c) for c in FULL if c not in LEFT_OUT))


def record_by_id(records: DataFrame, id_: int) -> DataFrame:
    return records.where(F.col("id") == id_).select(*FULL)


def distinct_values(records: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column that aren't null or empty, in order."""
    return records.where(not_empty(column)).select(column).distinct().orderBy(column)


def distinct_tables(records: DataFrame) -> DataFrame:
    exploded = records.select(F.explode("tables").alias("table_name"))
    return distinct_values(exploded, "table_name")


def facets(records: DataFrame, columns: Sequence[str] = ("user", "db", "host", "source_host"), most: int | None = None) -> dict:
    """The values to filter by, of each column and of the tables, from one job:
    distinct (facet, value) pairs, in order.  With ``most``, at most so many of
    each, and ``truncated`` names the facets that have more."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns])
    tables = F.transform(F.coalesce("tables", F.array().cast("array<string>")), lambda t: F.struct(F.lit("tables").alias("facet"), t.alias("value")))
    rows = records.select(F.explode(F.concat(pairs, tables)).alias("p")).select("p.facet", "p.value").where(not_empty("value")).distinct()
    if most is not None:  # a rank under a limit, so that no task holds more of a facet
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("facet").orderBy("value"))).where(F.col("nth") <= most + 1).drop("nth")
    out: dict = {c: [] for c in (*columns, "tables")}
    for r in rows.orderBy("facet", "value").toLocalIterator():
        out[r.facet].append(r.value)
    if most is not None:
        more = [c for c, values in out.items() if len(values) > most]
        out = {c: values[:most] for c, values in out.items()} | ({"truncated": more} if more else {})
    return out
