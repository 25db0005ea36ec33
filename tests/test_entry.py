"""The driver's contract: every query against its SQL at the smallest size."""

import math

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(str([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    found = duck.execute(entry.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in found.description], found.fetchall())


@pytest.mark.parametrize("name", ["dialect_newest", "source_hosts_list"])
def test_fingerprints_without_a_host(spark, tmp_path, name):
    """Of user 1 all events are of a file that isn't known."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view e as select * replace (case when event_id % 4 = 3 then 1 else 2 end as user_id, 'click' as event_type) from '{SF}/events.parquet'")
    con.execute(f"copy e to '{tmp_path}/events.parquet'")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    found = con.execute(entry.oracle_sql()[name])
    want = rows([d[0] for d in found.description], found.fetchall())
    assert rows(df.columns, df.collect()) == want and any("None" in r for r in want[1])


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "id" and df.count() > 0
