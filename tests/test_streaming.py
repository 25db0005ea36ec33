"""Streams over growing files."""

import datetime as dt

import pytest
from logfixtures import event

from querylens.streaming import tail

NOW = dt.datetime(2024, 5, 1, 12)


def drain(df, name, tmp_path, mode="append"):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c-{name}")).outputMode(mode).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return df.sparkSession.table(name).collect()


@pytest.fixture
def logs(tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    return folder


def write(path, *minutes, user="u"):
    with path.open("a") as f:
        for m in minutes:
            f.write(event(NOW + dt.timedelta(minutes=m), user=user, query_time=float(m + 1), sql=f"SELECT * FROM t WHERE a = {m}"))


def test_appends_come_once(spark, logs, tmp_path):
    write(logs / "a.log", 0, 1, 2)
    first = drain(tail.entries(spark, str(logs)), "one", tmp_path)
    assert [r.query_time_sec for r in first] == [1.0, 2.0]  # the last event may still be written
    write(logs / "a.log", 3, 4)
    path = str(tmp_path / "out")
    for _ in range(2):
        query = tail.to_parquet(tail.entries(spark, str(logs)), path, str(tmp_path / "check")).start()
        query.processAllAvailable()
        query.stop()
        write(logs / "a.log", 5)
    assert sorted(r.query_time_sec for r in spark.read.parquet(path).collect()) == [1.0, 2.0, 3.0, 4.0, 5.0]


def test_windows_and_lateness(spark, logs, tmp_path):
    write(logs / "a.log", 0, 5, 61, 62, 200, 300, 301)
    stream = tail.with_event_time(tail.entries(spark, str(logs)))
    costs = drain(tail.windowed_costs(tail.without_replays(stream)), "costs", tmp_path)
    assert [(r.window_start.hour, r.calls, r.total_time) for r in sorted(costs)] [:2] == [(12, 2, 7.0), (13, 2, 125.0)]


def test_sessions_and_records(spark, logs, tmp_path):
    write(logs / "a.log", 0, 2, 4, 100, 400, 900)
    stream = tail.with_event_time(tail.entries(spark, str(logs)))
    bursts = drain(tail.sessions(stream), "bursts", tmp_path)
    assert sorted((r.user, r.calls) for r in bursts)[-1] == ("u", 3)
    told = drain(tail.new_records(stream), "records", tmp_path, "append")
    assert [r.query_time_sec for r in told] == [401.0]
