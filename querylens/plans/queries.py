"""The driver's queries on the engine's operators, each with its SQL.

Doubles are rounded on both sides; arrays are joined to strings; every order
that a limit depends on is total.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querylens.functions.text import database_of_use, fingerprint_column, fingerprint_id, preview, rfc3339, source_host, text_hash, without_use
from querylens.operators import aggregate, asof, filters, maintenance
from querylens.operators import records as rec
from querylens.plans import adapter, reports

Query = Callable[[SparkSession, str], DataFrame]

SINCE, UNTIL = dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 24, 12)
WHERE = "ts >= timestamp '2024-01-03 00:00:00' and ts <= timestamp '2024-01-24 12:00:00'"
CURSOR = aggregate.Cursor(2_000_000.0, "8")
LEAST_MS = 1_000_000.0

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(sql: str, head: bool = True) -> Callable[[Query], Query]:
    """Register a query with its SQL, ``head``: on the adapter's tables."""

    def keep(f: Query) -> Query:
        name = f.__name__.lstrip("_")
        _queries[name] = f
        if sql:
            _oracles[name] = f"with {adapter.WITH} {sql}" if head and not sql.lstrip().lower().startswith("with") else sql.replace("with ", f"with {adapter.WITH}, ", 1) if head else sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shown(costs: DataFrame) -> DataFrame:
    """Costs with arrays as text and doubles rounded."""
    return costs.withColumns(
        {
            "tables": F.array_join("tables", ","),
            "source_hosts": F.array_join("source_hosts", ","),
            "execution_time_ms": F.round("execution_time_ms", 4),
            "lock_time_sec": F.round("lock_time_sec", 6),
        }
    )


def _costs_sql(where: str = WHERE) -> str:
    newest = lambda c: f"arg_max({c}, (ts, -id)) filter (where {c} is not null)"
    return f"""with aggregated as (select fingerprint_id as id, coalesce({newest('sanitized_sql')}, '') as text,
  coalesce({newest('sample_sql')}, '') as raw_query, coalesce({newest('db')}, '') as source,
  coalesce(sum(query_time_sec), 0) * 1000.0::double as ms, count(*) as calls,
  array_to_string(coalesce({newest('tables')}, []), ',') as tables, max(ts) as latest_ts,
  {newest('"user"')} as "user", {newest('host')} as host, {newest('rows_sent')} as rows_sent,
  {newest('rows_examined')} as rows_examined, round({newest('lock_time_sec')}, 6) as lock_time_sec,
  array_to_string(coalesce(list_sort(list(distinct source_host) filter (where source_host is not null and source_host <> '')), []), ',') as source_hosts
  from records where {where} group by fingerprint_id)
select id, text, raw_query, source, round(ms, 4) as execution_time_ms, calls, tables, latest_ts, "user", host, rows_sent, rows_examined, lock_time_sec, source_hosts from aggregated"""


def _windowed(spark: SparkSession, sf_dir: str, database: str = "") -> DataFrame:
    return aggregate.window(adapter.records(spark, sf_dir), SINCE, UNTIL, database)


# the flagship


@query(_costs_sql() + " order by ms desc, id limit 201")
def fingerprint_agg(spark, sf_dir):
    return _shown(aggregate.page(aggregate.fingerprint_costs(_windowed(spark, sf_dir)), 200))


@query(f"""with a as (select fingerprint_id, sum(query_time_sec) * 1000.0::double as ms from logs where {WHERE} group by 1)
select count(*) as total_count from a where ms >= {LEAST_MS}""")
def fingerprint_count(spark, sf_dir):
    logs = aggregate.window(adapter.logs(spark, sf_dir), SINCE, UNTIL)
    return aggregate.fingerprint_count(logs, LEAST_MS)


@query(_costs_sql() + f" where ms < {CURSOR.execution_time_ms} or (ms = {CURSOR.execution_time_ms} and id > '{CURSOR.id}') order by ms desc, id limit 51")
def fingerprint_page2(spark, sf_dir):
    return _shown(aggregate.page(aggregate.fingerprint_costs(_windowed(spark, sf_dir)), 50, CURSOR))


EXCLUDED = "select * from click_1 where k = ?", "select * from view_2 where k = ?", "select * from purchase_3 where k = ?"


@query(_costs_sql() + f""" where substr(sha256(text), 1, 16) not in ({", ".join(f"substr(sha256('{t}'), 1, 16)" for t in EXCLUDED)})""")
def known_hash_exclusion(spark, sf_dir):
    import hashlib

    known = [hashlib.sha256(t.encode()).hexdigest()[:16] for t in EXCLUDED]
    return _shown(aggregate.fingerprint_costs(_windowed(spark, sf_dir), exclude=known))


@query(_costs_sql() + f" where ms >= {LEAST_MS}")
def min_execution(spark, sf_dir):
    return _shown(aggregate.fingerprint_costs(_windowed(spark, sf_dir), LEAST_MS))


@query(_costs_sql(f"{WHERE} and db = 'shop'"))
def db_filter(spark, sf_dir):
    return _shown(aggregate.fingerprint_costs(_windowed(spark, sf_dir, "shop")))


# filters and listings

ROW = 'id, sample_sql, "user", host, db, source_host'


def _rows(df: DataFrame) -> DataFrame:
    return df.select("id", "sample_sql", "user", "host", "db", "source_host")


@query(f"""select {ROW} from records where "user" in ('u1', 'u2') and host in ('10.0.0.1', '10.0.0.4') and db in ('shop', '') and source_host in ('prod-db-01', 'prod-db-02')""")
def in_filters(spark, sf_dir):
    narrowed = filters.RecordFilter(users=[" u1", "u2 "], hosts=["10.0.0.1", "10.0.0.4"], dbs=["shop", ""], source_hosts=["prod-db-01", "prod-db-02"])
    return _rows(narrowed.apply(adapter.records(spark, sf_dir)))


@query(f"select {ROW} from records where query_time_sec > 20 and query_time_sec < 60 and lock_time_sec > 0.025 and lock_time_sec < 0.05 and rows_examined > 5000 and {WHERE}")
def range_filters(spark, sf_dir):
    narrowed = filters.RecordFilter(query_time_gt=20.0, query_time_lt=60.0, lock_time_gt=0.025, lock_time_lt=0.05, rows_examined_gt=5000, ts_from=SINCE, ts_to=UNTIL)
    return _rows(narrowed.apply(adapter.records(spark, sf_dir)))


@query(f"select {ROW} from records where list_contains(tables, 'shop.click') and list_contains(tables, 'click')")
def table_membership(spark, sf_dir):
    return _rows(filters.RecordFilter(tables=["shop.click", "click"]).apply(adapter.records(spark, sf_dir)))


@query(f"select {ROW} from records where file_hash = (select hash from files where file_path = '/var/log/mysql/prod-db-02.slow.log' order by generation desc limit 1)")
def latest_generation(spark, sf_dir):
    narrowed = filters.RecordFilter(file_path="/var/log/mysql/prod-db-02.slow.log")
    return _rows(narrowed.apply(adapter.records(spark, sf_dir), adapter.files(spark)))


@query("select * from files where file_path = '/var/log/mysql/prod-db-02.slow.log' order by generation desc limit 1")
def newest_file_state(spark, sf_dir):
    return filters.newest_generation(adapter.files(spark), "/var/log/mysql/prod-db-02.slow.log")


@query("select id, file_hash, source_host from records")
def source_join(spark, sf_dir):
    return adapter.records(spark, sf_dir).select("id", "file_hash", "source_host")


@query("""select id, fingerprint_id, substr(sanitized_sql, 1, 200) as sanitized_sql_preview, substr(sample_sql, 1, 200) as sample_sql_preview, "user", host, db,
query_time_sec, lock_time_sec, rows_sent, rows_examined, ts, created_at, source_host from records where db = 'shop' order by query_time_sec desc nulls last, id limit 40 offset 20""")
def record_list(spark, sf_dir):
    return rec.listing(adapter.records(spark, sf_dir), filters.RecordFilter(dbs=["shop"]), by="query_time_sec", direction="desc", limit=40, offset=20)


@query("""select id, fingerprint_id, sanitized_sql, sample_sql, "user", host, db, query_time_sec, lock_time_sec, rows_sent, rows_examined, ts, created_at,
array_to_string(tables, ',') as tables, source_host from records where id = 77""")
def record_by_id(spark, sf_dir):
    return rec.record_by_id(adapter.records(spark, sf_dir), 77).withColumn("tables", F.array_join("tables", ","))


@query("select count(*) as total_entries, min(ts) as oldest_entry, max(ts) as newest_entry, count(distinct sanitized_sql) as unique_fingerprints from logs")
def stats(spark, sf_dir):
    return maintenance.stats(adapter.logs(spark, sf_dir))


@query("""select count(*) as total_files, count(*) filter (where parse_count = 1) as unique_files, count(*) filter (where parse_count > 1) as duplicate_files,
coalesce(sum(file_size), 0)::bigint as total_bytes from files""")
def file_stats(spark, sf_dir):
    return maintenance.file_stats(adapter.files(spark))


@query("""select fingerprint_id, array_to_string(list_sort(list(distinct source_host) filter (where source_host is not null and source_host <> '')), ',') as source_hosts
from records group by fingerprint_id""")
def source_hosts_list(spark, sf_dir):
    costs = aggregate.fingerprint_costs(adapter.records(spark, sf_dir))
    # the SQL has null, not an empty text, where no host is known
    return costs.select(F.col("id").alias("fingerprint_id"), F.when(F.size("source_hosts") > 0, F.array_join("source_hosts", ",")).alias("source_hosts"))


def _facet(column: str) -> None:
    def run(spark, sf_dir):
        return rec.distinct_values(adapter.records(spark, sf_dir), column).withColumnRenamed(column, "value")

    run.__name__ = "facet_" + {"user": "users", "db": "dbs", "host": "hosts", "source_host": "source_hosts"}[column]
    query(f"""select distinct "{column}" as value from records where "{column}" is not null and "{column}" <> '' order by 1""")(run)


for _column in ("user", "db", "host", "source_host"):
    _facet(_column)


@query("select distinct t as table_name from (select unnest(tables) as t from logs) where t is not null and t <> '' order by 1")
def facet_tables(spark, sf_dir):
    return rec.distinct_tables(adapter.logs(spark, sf_dir))


# replays: a shifted copy repeats keys, every tenth row has none


def _replayed(spark, sf_dir):
    logs = adapter.logs(spark, sf_dir).select("id", "file_hash", "event_offset", "sample_sql")
    copy = logs.where(F.col("id") % 3 == 0).withColumn("id", F.col("id") + 1_000_000)
    bare = logs.where(F.col("id") % 10 == 0).withColumns({"id": F.col("id") + 2_000_000, "event_offset": F.lit(None).cast("long")})
    return logs.unionByName(copy).unionByName(bare)


@query("""with r as (select id, file_hash, event_offset, sample_sql from logs union all select id + 1000000, file_hash, event_offset, sample_sql from logs where id % 3 = 0
union all select id + 2000000, file_hash, null, sample_sql from logs where id % 10 = 0)
select * from r where file_hash is null or event_offset is null or id in (select max(id) from r where file_hash is not null and event_offset is not null group by file_hash, event_offset)""")
def dedupe(spark, sf_dir):
    return maintenance.without_replays(_replayed(spark, sf_dir))


# reports

# averages of cents have few decimals; cut where none of them is a tie
ROUNDED = "round(avg(query_time_sec), 8) as avg_time, round(max(query_time_sec), 4) as max_time"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 8 if c == "avg_time" else 4) for c in ("avg_time", "max_time", "total_time") if c in df.columns})


@query(f"""select fingerprint_id, sanitized_sql as fingerprint, count(*) as count, {ROUNDED}, round(sum(query_time_sec), 4) as total_time from logs
group by all order by sum(query_time_sec) desc, 1 limit 10""")
def top_queries(spark, sf_dir):
    return _rounded(reports.top_queries(adapter.logs(spark, sf_dir)))


@query(f"""select fingerprint_id, sanitized_sql as fingerprint, count(*) as count, {ROUNDED}, round(sum(query_time_sec), 4) as total_time from logs group by all order by 3 desc, 1""")
def pattern_frequency(spark, sf_dir):
    return _rounded(reports.pattern_frequency(adapter.logs(spark, sf_dir)))


@query("""select sample_sql, query_time_sec, ts, "user", host, db from logs where query_time_sec >= 5 order by query_time_sec desc, id limit 10""")
def slowest(spark, sf_dir):
    return reports.slowest(adapter.logs(spark, sf_dir), 10, 5.0)


@query("""select t as table_name, count(*) as query_count, round(avg(query_time_sec), 8) as avg_time from (select unnest(tables) as t, query_time_sec from logs) group by 1 order by 2 desc, 1""")
def table_usage(spark, sf_dir):
    return _rounded(reports.table_usage(adapter.logs(spark, sf_dir)))


def _timeline(interval: str, form: str) -> None:
    def run(spark, sf_dir):
        return _rounded(reports.timeline(adapter.logs(spark, sf_dir), interval))

    run.__name__ = f"timeline_{interval}"
    query(f"select strftime(ts, '{form}') as time_bucket, count(*) as query_count, {ROUNDED} from logs group by 1 order by 1")(run)


for _interval, _form in (("minute", "%Y-%m-%d %H:%M"), ("hour", "%Y-%m-%d %H:00"), ("day", "%Y-%m-%d")):
    _timeline(_interval, _form)


@query("""select sanitized_sql as fingerprint, arg_max(sample_sql, (ts, -id)) as sample_sql from logs where contains(lower(sanitized_sql), 'click_1') group by 1 order by 1""")
def search_fingerprint(spark, sf_dir):
    return reports.search_fingerprint(adapter.logs(spark, sf_dir), "CLICK_1")


@query("select sample_sql, query_time_sec, ts from logs where list_contains(tables, 'shop.click') order by query_time_sec desc, id")
def search_table(spark, sf_dir):
    return reports.search_table(adapter.logs(spark, sf_dir), "shop.click")


@query("select id, sample_sql, query_time_sec, rows_examined, rows_sent from logs where rows_examined > 10000 and rows_sent < 100 order by rows_examined desc, id")
def full_scans(spark, sf_dir):
    return reports.full_scans(adapter.logs(spark, sf_dir))


@query(f'select "user", count(*) as query_count, {ROUNDED} from logs group by 1 order by 2 desc, 1')
def by_user(spark, sf_dir):
    return _rounded(reports.by_user(adapter.logs(spark, sf_dir)))


@query("select id, sample_sql, query_time_sec, ts from logs where fingerprint_id = (select min(fingerprint_id) from logs) order by query_time_sec desc, id")
def by_fingerprint(spark, sf_dir):
    logs = adapter.logs(spark, sf_dir)
    return reports.by_fingerprint(logs, logs.agg(F.min("fingerprint_id")).first()[0])


# functions


@query(r"""select page_id, regexp_replace(regexp_replace(url, '^.*[/\\]', ''), '(\.(log|slow|gz))+$', '', 'i') as source_host from pages""", head=False)
def source_host_regex(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", source_host(F.col("url")).alias("source_host"))


@query("select doc_id, substr(sha256(text), 1, 16) as text_hash from documents", head=False)
def text_hashes(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text_hash(F.col("text")).alias("text_hash"))


@query("select doc_id, upper(substr(md5(text), 17, 16)) as fingerprint_id from documents", head=False)
def fingerprint_ids(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", fingerprint_id(F.col("text")).alias("fingerprint_id"))


@query("select id, sanitized_sql as fingerprint from logs")
def fingerprints(spark, sf_dir):
    return adapter.logs(spark, sf_dir).select("id", fingerprint_column(F.col("sample_sql")).alias("fingerprint"))


@query("select id, db as db, sample_sql as statement from logs")
def use_statements(spark, sf_dir):
    logs = adapter.logs(spark, sf_dir)
    sql = F.when(F.col("db") == "", F.col("sample_sql")).otherwise(F.concat(F.lit(" USE `"), "db", F.lit("` ; "), "sample_sql"))
    return logs.select("id", database_of_use(sql).alias("db"), without_use(sql).alias("statement"))


@query("select id, case when db = '' then '' else db || '.' end || split_part(split_part(sample_sql, ' ', 4), ' ', 1) as tables from logs")
def extracted_tables(spark, sf_dir):
    from querylens.cluster import ship_package
    from querylens.functions.tables import tables_column

    ship_package(spark)
    logs = adapter.logs(spark, sf_dir)
    return logs.select("id", F.array_join(tables_column(F.col("sample_sql"), F.col("db")), ",").alias("tables"))


@query("select doc_id, substr(text, 1, 200) as preview from documents", head=False)
def previews(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", preview(F.col("text")).alias("preview"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as at from events", head=False)
def rfc3339_times(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", rfc3339(F.col("ts")).alias("at"))


# joins without a syntax


@query("""select e.event_id, (select max(o.o_orderkey) from orders o where o.o_custkey = e.user_id and o.o_orderdate =
(select max(p.o_orderdate) from orders p where p.o_custkey = e.user_id and p.o_orderdate <= e.ts)) as o_orderkey from events e""", head=False)
def as_of_join(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    orders = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts")).agg(F.max("o_orderkey").alias("o_orderkey"))
    return asof.as_of_join(events, orders, ["user_id"], "ts", ["o_orderkey"]).select("event_id", "o_orderkey")


@query("""with s as (select s_suppkey, s_acctbal - 50 as low, s_acctbal + 50 as high from supplier)
select c.c_custkey, s.s_suppkey from customer c join s on c.c_acctbal between s.low and s.high""", head=False)
def range_join(spark, sf_dir):
    bands = _table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") - 50).alias("low"), (F.col("s_acctbal") + 50).alias("high"))
    points = _table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return asof.range_join(points, bands, "c_acctbal", "low", "high", 100.0).select("c_custkey", "s_suppkey")


# the delegated SQL surface, through Spark SQL over the driver's tables


def _sql(name: str, spark_sql: str, oracle: str | None = None) -> None:
    def run(spark, sf_dir):
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
            _table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(spark_sql)

    run.__name__ = name
    query(oracle or spark_sql, head=False)(run)


_sql("sql_inner_join_agg", """select n_name, count(*) as orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey group by n_name""")
_sql("sql_left_join", "select c_custkey, count(o_orderkey) as orders from customer left join orders on o_custkey = c_custkey group by c_custkey")
_sql("sql_full_join", """select coalesce(c_nationkey, s_nationkey) as nation, count(c_custkey) as customers, count(s_suppkey) as suppliers
from (select * from customer where c_acctbal > 5000) c full join (select * from supplier where s_acctbal > 3000) s on c_nationkey = s_nationkey and c_acctbal < s_acctbal group by 1""")
_sql("sql_semi_join", "select c_custkey from customer left semi join orders on o_custkey = c_custkey and o_totalprice > 200000", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
_sql("sql_anti_join", "select c_custkey from customer left anti join orders on o_custkey = c_custkey", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
_sql("sql_cross_join", "select r_name, n_name from region cross join nation")
_sql("sql_right_join", "select n_name, s_suppkey from supplier right join nation on s_nationkey = n_nationkey and s_acctbal > 5000")
_sql("sql_cube", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as qty, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)")
_sql("sql_rollup", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)")
_sql("sql_grouping_sets", "select c_mktsegment, c_nationkey, count(*) as n from customer group by grouping sets ((c_mktsegment), (c_nationkey), ())")
_sql("sql_filter_aggregate", "select event_type, count(*) filter (where value > 10) as large, count(distinct user_id) as users from events group by event_type")
_sql("sql_window_rank", """select * from (select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as bigint) as rn,
cast(rank() over (partition by o_custkey order by o_orderpriority) as bigint) as rk, cast(dense_rank() over (partition by o_custkey order by o_orderstatus) as bigint) as dr from orders) t where rn <= 3""")
_sql("sql_window_frames", """select event_id, lag(event_id) over (partition by user_id order by ts, event_id) as before, lead(event_id, 2) over (partition by user_id order by ts, event_id) as after,
round(sum(value) over (partition by user_id order by ts, event_id rows between 2 preceding and current row), 4) as moving,
first_value(event_id) over (partition by user_id order by ts, event_id) as first from events""")
_sql("sql_intersect", "select c_nationkey as k from customer intersect select s_nationkey from supplier")
_sql("sql_except_all", "select c_nationkey as k from customer except all select s_nationkey from supplier")
_sql("sql_union", "select c_nationkey as k from customer union select n_nationkey from nation union all select r_regionkey from region")
_sql("sql_recursive", "with recursive t(n, f) as (select 1L, 1L union all select n + 1, f * 2 from t where n < 20) select n, f from t", "with recursive t(n, f) as (select 1::bigint, 1::bigint union all select n + 1, f * 2 from t where n < 20) select n, f from t")
_sql("sql_percentile", "select l_returnflag, round(percentile_cont(0.5) within group (order by l_extendedprice), 4) as median from lineitem group by l_returnflag", "select l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) as median from lineitem group by l_returnflag")
_sql("sql_pivot", """select * from (select o_orderstatus, o_orderpriority, o_orderkey from orders) pivot (count(o_orderkey) for o_orderstatus in ('F' as f, 'O' as o, 'P' as p))""",
     "select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as f, count(*) filter (where o_orderstatus = 'O') as o, count(*) filter (where o_orderstatus = 'P') as p from orders group by 1")
_sql("sql_scalar_subquery", "select o_orderkey, o_totalprice from orders where o_totalprice > (select avg(o_totalprice) * 1.5 from orders)")
_sql("sql_correlated", "select o_orderkey from orders o where o_totalprice = (select max(o_totalprice) from orders p where p.o_custkey = o.o_custkey)")
_sql("sql_lateral_unnest", "select event_id, n from events lateral view explode(sequence(1, 1 + event_id % 3)) x as n", "select event_id, unnest(range(1, 2 + event_id % 3)) as n from events")
_sql("sql_json", "select event_id, cast(get_json_object(props, '$.k') as string) as k from events", "select event_id, json_extract_string(props, '$.k') as k from events")


@query("""with w as (select *, time_bucket(interval '1 hour', ts) as window_start from logs)
select window_start, fingerprint_id, count(*) as calls, round(sum(query_time_sec), 4) as total_time from w group by all""")
def tumbling_windows(spark, sf_dir):
    when = F.window("ts", "1 hour")
    found = adapter.logs(spark, sf_dir).groupBy(when.alias("w"), "fingerprint_id").agg(F.count("*").alias("calls"), F.round(F.sum("query_time_sec"), 4).alias("total_time"))
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "fingerprint_id", "calls", "total_time")


@query("""with g as (select *, case when ts - lag(ts) over (partition by "user" order by ts, id) < interval '30 minutes' then 0 else 1 end as fresh from logs),
s as (select *, sum(fresh) over (partition by "user" order by ts, id) as session from g)
select "user", min(ts) as session_start, count(*) as calls from s group by "user", session""")
def sessions(spark, sf_dir):
    grouped = adapter.logs(spark, sf_dir).groupBy("user", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("calls"))
    return grouped.select("user", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "calls")


@query("""with t as (select sanitized_sql, row_number() over (order by sum(query_time_sec) desc, sanitized_sql) as place from logs group by 1) select sanitized_sql, place from t where place <= 20""")
def ranked_statements(spark, sf_dir):
    costs = adapter.logs(spark, sf_dir).groupBy("sanitized_sql").agg(F.sum("query_time_sec").alias("s"))
    # only the top rows are numbered, in one small task
    top = costs.orderBy(F.desc("s"), "sanitized_sql").limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("s"), "sanitized_sql")).cast("long")).select("sanitized_sql", "place")


def _registered() -> None:
    """The queries of the other modules register when these are imported."""
    from querylens.plans import parsing  # noqa: F401


def queries() -> dict[str, Query]:
    _registered()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _registered()
    return dict(_oracles)
