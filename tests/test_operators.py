"""Ties, nulls, filters, pages and joins on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from querylens.operators import aggregate, asof, filters
from querylens.operators import records as rec
from querylens.schema import FILES, SLOW_LOGS

T0 = dt.datetime(2024, 1, 1)


def log(id_, fp="F1", ts=T0, **more):
    row = {
        "id": id_, "file_hash": "h1", "fingerprint_id": fp, "sanitized_sql": f"text {fp}", "sample_sql": f"sample {id_}", "user": "u", "host": "h", "db": "d",
        "query_time_sec": 1.0, "lock_time_sec": 0.1, "rows_sent": 1, "rows_examined": 10, "ts": ts, "created_at": T0, "tables": ["t"], "event_offset": id_, "event_hash": "x",
    }
    return tuple((row | more)[f.name] for f in SLOW_LOGS)


@pytest.fixture
def files(spark):
    states = [("h1", "/v/db-01.slow.log", 1), ("h2", "/v/db-02.log", 1), ("h3", "/v/db-02.log", 2)]
    return spark.createDataFrame([(h, p, g, 0, T0, T0, 1, T0, "", 0, "", 0, 0, 0) for h, p, g in states], FILES)


def records(spark, files, *rows):
    return rec.with_source(spark.createDataFrame(list(rows), SLOW_LOGS), files)


def test_ties_go_to_the_first_and_nulls_are_passed_over(spark, files):
    found = records(spark, files, log(1, rows_sent=None, tables=["a"]), log(2, rows_sent=5, tables=None), log(3, ts=T0 - dt.timedelta(1), user="old"), log(4, ts=None, user="never", query_time_sec=None))
    row = aggregate.fingerprint_costs(found).first()
    assert (row.raw_query, row.rows_sent, row.tables, row.user, row.calls, row.execution_time_ms, row.latest_ts) == ("sample 1", 5, ["a"], "u", 4, 3000.0, T0)


def test_empty_groups_are_filled(spark, files):
    row = aggregate.fingerprint_costs(records(spark, files, log(1, file_hash="none", db=None, tables=None, user=None, query_time_sec=None))).first()
    assert (row.source, row.tables, row.user, row.source_hosts, row.execution_time_ms) == ("", [], None, [], 0.0)


def test_unknown_file_has_no_source(spark, files):
    got = {r.id: r.source_host for r in records(spark, files, log(1), log(2, file_hash="gone"), log(3, file_hash=None)).collect()}
    assert got == {1: "db-01", 2: None, 3: None}


def test_pages_walk_all(spark, files):
    costs = aggregate.fingerprint_costs(records(spark, files, *[log(i, fp=f"F{i}", query_time_sec=float(i % 3)) for i in range(10)])).cache()
    seen, cursor = [], None
    while True:
        rows = aggregate.page(costs, 3, cursor).collect()
        seen += [r.id for r in rows[:3]]
        if len(rows) < 4:
            break
        cursor = aggregate.Cursor.decode(aggregate.Cursor(rows[2].execution_time_ms, rows[2].id).encode())
    assert seen == [r.id for r in costs.orderBy(F.desc("execution_time_ms"), "id").collect()] and len(seen) == 10


def test_cursors():
    assert aggregate.Cursor(5600.0, "AB").encode() == "eyJleGVjdXRpb25fdGltZV9tcyI6NTYwMCwiaWQiOiJBQiJ9"
    assert aggregate.Cursor.decode("  ") is None
    for bad in ("%%%", "e30=", "WzFd", "eyJpZCI6ImEgYiJ9"):
        with pytest.raises(ValueError):
            aggregate.Cursor.decode(bad)
    assert aggregate.known_hashes(" ABCDEF0123456789 ,,abcdef0123456789") == ["abcdef0123456789"]
    with pytest.raises(ValueError):
        aggregate.known_hashes("xyz")


def test_long_exclusions_join(spark, files):
    import hashlib

    found = records(spark, files, *[log(i, fp=f"F{i}") for i in range(5)])
    known = [hashlib.sha256(f"text F{i}".encode()).hexdigest()[:16] for i in (1, 3)] + [f"{i:016x}" for i in range(600)]
    for exclude in (known[:2], known):
        assert {r.id for r in aggregate.fingerprint_costs(found, exclude=exclude).collect()} == {"F0", "F2", "F4"}
        assert aggregate.fingerprint_count(found, exclude=exclude).first().total_count == 3


def test_filters(spark, files):
    found = records(spark, files, log(1, user="a'b"), log(2, tables=['"t2"', None]), log(3, file_hash="h3", rows_examined=99), log(4, file_hash="h2", tables=None))
    ids = lambda **k: {r.id for r in filters.RecordFilter(**k).apply(found, files).collect()}
    assert ids() == {1, 2, 3, 4}
    assert ids(users=[" a'b "]) == {1}
    assert ids(users=["x' OR '1'='1"]) == set()
    assert ids(tables=["t2"]) == {2} and ids(tables=["t"]) == {1, 3} and ids(tables=["t", "t2"]) == set()
    assert ids(file_path="/v/db-02.log") == {3} and ids(file_path="/no") == set()
    assert ids(rows_examined_gt=10) == {3} and ids(query_time_lt=1.0) == set()
    assert ids(ts_from=T0, ts_to=T0.replace(tzinfo=dt.UTC)) == {1, 2, 3, 4}
    with pytest.raises(ValueError):
        filters.RecordFilter(file_path="/x").conditions()


def test_orders_fall_back_and_nulls_come_last(spark, files):
    found = records(spark, files, log(1, query_time_sec=None), log(2, query_time_sec=1.0), log(3, query_time_sec=2.0))
    ids = lambda *a: [r.id for r in rec.listing(found, None, None, *a).collect()]
    assert ids("query_time_sec", "asc") == [2, 3, 1] and ids("query_time_sec", "desc") == [3, 2, 1]
    assert ids("id; drop table x", "sideways") == [1, 2, 3]
    assert [r.id for r in rec.listing(found, limit=1, offset=1).collect()] == [2]
    assert len(rec.listing(found).columns) == 14 and len(rec.record_by_id(found, 1).columns) == 15


def test_facets_in_one_pass(spark, files):
    found = records(spark, files, log(1, user="", db=None), log(2, user="b", tables=["x", None, ""]), log(3, user="a", tables=None))
    assert rec.facets(found) == {"user": ["a", "b"], "db": ["d"], "host": ["h"], "source_host": ["db-01"], "tables": ["t", "x"]}
    assert [r.table_name for r in rec.distinct_tables(found).collect()] == ["t", "x"]


def test_views_join_by_name(spark, files):
    rec.create_views(spark.createDataFrame([log(1)], SLOW_LOGS), files)
    assert spark.sql("select source_host, user from slow_logs_with_source").first() == ("db-01", "u")


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([log(i) for i in range(5)], SLOW_LOGS).write.parquet(str(tmp_path / "x"))
    narrow = aggregate.window(spark.read.schema(SLOW_LOGS).parquet(str(tmp_path / "x")), T0, T0, "d")
    plan = aggregate.fingerprint_count(narrow)._jdf.queryExecution().toString()
    scan = plan[plan.index("FileScan") :].split("\n")[0]
    assert "GreaterThanOrEqual(ts" in scan and "EqualTo(db,d)" in scan and "sample_sql" not in scan


def test_as_of_and_range_joins(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3), (None, 3, 4)], "k string, t int, i int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("b", 10, "z"), (None, 3, "n")], "k string, t int, v string")
    assert {r.i: r.v for r in asof.as_of_join(left, right, ["k"], "t", ["v"]).collect()} == {1: "y", 2: None, 3: None, 4: "n"}
    points = spark.createDataFrame([(float(i),) for i in range(10)], "p double")
    ranges = spark.createDataFrame([(0, 2.5, 4.0), (1, -7.0, 0.0), (2, 9.0, 8.0), (3, 0.0, 30.0)], "r int, low double, high double")
    got = {(r.r, r.p) for r in asof.range_join(points, ranges, "p", "low", "high", 2.0).collect()}
    assert got == {(r, float(p)) for p in range(10) for r, a, b in [(0, 2.5, 4.0), (1, -7.0, 0.0), (3, 0.0, 30.0)] if a <= p <= b}


def test_as_of_join_of_a_hot_key(spark):
    import random

    rng = random.Random(5)
    marks = [("hot", rng.randrange(5000), i) for i in range(400)] + [(f"k{i % 9}", rng.randrange(5000), i) for i in range(200)] + [("hot", None, -1)]
    rows = [(rng.choice(["hot", "hot", "k1", "k5", "none"]), rng.randrange(-5, 5005), i) for i in range(500)] + [("hot", None, 1000)]
    seen = {}
    marks = [m for m in marks if not (m[:2] in seen or seen.setdefault(m[:2], 1) is None)]  # one value a time
    left = spark.createDataFrame(rows, "k string, t int, i int")
    right = spark.createDataFrame(marks, "k string, t int, v int")
    want = {}
    for k, t, i in rows:
        before = [m for m in marks if m[0] == k and t is not None and m[1] is not None and m[1] <= t]
        want[i] = max(before, key=lambda m: m[1])[2] if before else None
    for ranges in (1, 2, 64):
        assert {r.i: r.v for r in asof.as_of_join(left, right, ["k"], "t", ["v"], ranges).collect()} == want


def test_wide_ranges_touch_few_buckets(spark):
    points = spark.createDataFrame([(i * 1.0,) for i in range(-50, 50)], "p double")
    bounds = [(0, -1e12, 1e12), (1, -3.0, 3.0), (2, 0.0, 0.0), (3, 10.5, 10.6), (4, -40.0, 20.0)]
    got = {(r.r, r.p) for r in asof.range_join(points, spark.createDataFrame(bounds, "r int, low double, high double"), "p", "low", "high", 1.0).collect()}
    assert got == {(r, float(p)) for p in range(-50, 50) for r, a, b in bounds if a <= p <= b}
    none = spark.createDataFrame([], "r int, low double, high double")
    assert asof.range_join(points, none, "p", "low", "high", 1.0).collect() == []


def test_null_keys_go_with_short_and_long_lists(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    for values in (["a"], ["a", *map(str, range(filters.LITERALS))]):
        assert [r.k for r in filters.excluding(df, F.col("k"), values).collect()] == ["b"]
    assert filters.excluding(df, F.col("k"), []).count() == 3


def test_facets_say_what_is_cut(spark, files):
    found = records(spark, files, *[log(i, user=f"u{i}") for i in range(5)])
    cut = rec.facets(found, most=2)
    assert cut["user"] == ["u0", "u1"] and cut["truncated"] == ["user"] and len(rec.facets(found)["user"]) == 5
