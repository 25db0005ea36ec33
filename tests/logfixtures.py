"""Slow logs as text, made from small tables of what they hold."""

from __future__ import annotations

import datetime as dt

# The events whose fingerprints and costs are known.
#: file, age in days, user, host, ip, schema, query and lock time, rows sent and examined, database of USE, statement
CONTRACT = (
    ("shop-slow.log", 3, "app", "web1", "10.0.0.1", "shop", 2.5, 0.0001, 1, 100000, "shop", "SELECT * FROM orders WHERE customer_id = 7 AND status = 'paid'"),
    ("shop-slow.log", 3, "app", "web1", "10.0.0.1", "shop", 3.1, 0, 20, 500000, "", "SELECT * FROM orders WHERE customer_id = 99 AND status = 'pending'"),
    ("shop-slow.log", 4, "reporting", "web2", "10.0.0.2", "shop", 0.9, 0, 5, 5, "", "SELECT id, total FROM invoices WHERE created_at > '2024-01-01'"),
    ("analytics-slow.log", 5, "etl", "batch1", "10.0.0.9", "analytics", 5.0, 0.001, 1000, 2000000, "analytics", "SELECT country, count(*) FROM events GROUP BY country"),
)


def event(ts: dt.datetime, user="root", host="localhost", ip="", schema="", query_time=1.0, lock_time=0.0, sent=1, examined=10, use="", sql="SELECT 1") -> str:
    head = f"# Time: {ts:%Y-%m-%dT%H:%M:%S.%fZ}\n# User@Host: {user}[{user}] @ {host} [{ip}]  Id:     7\n"
    metrics = f"# {f'Schema: {schema}  ' if schema else ''}Query_time: {query_time}  Lock_time: {lock_time} Rows_sent: {sent}  Rows_examined: {examined}\n"
    return head + metrics + (f"use {use};\n" if use else "") + f"SET timestamp={int(ts.replace(tzinfo=dt.UTC).timestamp())};\n{sql};\n"


def write_contract(folder, now: dt.datetime) -> None:
    """The two files whose fingerprints and costs are known."""
    texts: dict[str, str] = {}
    for name, age, user, host, ip, schema, q, lock, sent, examined, use, sql in CONTRACT:
        made = event(now - dt.timedelta(days=age), user, host, ip, schema, q, lock, sent, examined, use, sql)
        texts[name] = texts.get(name, "") + made
    for name, text in texts.items():
        (folder / name).write_text(text)


def minimal(now: dt.datetime) -> str:
    return event(now, use="testdb", sql="SELECT * FROM users WHERE id = 1") + event(now + dt.timedelta(seconds=5), sql="SELECT * FROM orders WHERE total > 10")
