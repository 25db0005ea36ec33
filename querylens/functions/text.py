"""Text functions as Spark columns, all inside the JVM.

Patterns are written so that Python's ``re`` reads them the same way; loops
that could run over a whole statement are possessive, which keeps Java's
matcher from recursing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: A leading USE statement; group 1 is the database.
USE = r"(?i)^\s*use\s+`?(\w+)`?\s*;?\s*"
STRING = r"'(?:[^'\\]|\\.|'')*+'|\"(?:[^\"\\]|\\.|\"\")*+\""
COMMENT = r"--[^\n]*+|#[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/"

#: The fingerprint, step by step: (pattern, replacement with ``$1`` for a group).
FINGERPRINT = (
    # comments go; strings and quoted names are read whole, so that what looks
    # like a comment in one of them stays
    (rf"(?s)((?:{STRING}|`[^`]*+`|[^'\"`#/-]|-(?!-)|/(?!\*)|['\"`])++)|{COMMENT}", "$1 "),
    (rf"(?s){STRING}", "?"),
    (r"(?i)(?<![\w$.`])(?:0x[0-9a-f]++|x\?|[0-9]++(?:\.[0-9]*+)?(?:e[+-]?[0-9]++)?|\.[0-9]++(?:e[+-]?[0-9]++)?)(?![\w`])", "?"),
    (r"(?<=[=<>(,])(\s*+)[+-]\s*+\?", "$1?"),
    (r"\s++", " "),
    (r"(?i)\bin \(\x20?\?(?:\x20?,\x20?\?)*+\x20?\)", "in (?+)"),
    (r"(?i)\b(values?)\x20?\(\x20?\?(?:\x20?,\x20?\?)*+\x20?\)(?:\x20?,\x20?\(\x20?\?(?:\x20?,\x20?\?)*+\x20?\))*+", "$1 (?+)"),
    (r"\x20(?=[,;)])|(?<=\()\x20", ""),
    (r"^[\s;]++|[\s;]++$", ""),
)


def fingerprint(sql: str) -> str:
    """The normalised statement: comments dropped, literals as ``?``, lists of
    them as one ``(?+)``, white space single, lower case.

    These are this engine's own rules wherever public samples pin nothing.
    """
    for pattern, by in FINGERPRINT:
        sql = re.sub(pattern, lambda m, by=by: by.replace("$1", m[1] or "") if "$1" in by else by, sql)
    return sql.lower()


def fingerprint_column(sql: Column) -> Column:
    """:func:`fingerprint` on a column."""
    for pattern, by in FINGERPRINT:
        sql = F.regexp_replace(sql, pattern, by)
    return F.lower(sql)


def fingerprint_id(text: Column) -> Column:
    """The last eight bytes of the MD5 of a fingerprint, in upper-case hex."""
    return F.upper(F.substring(F.md5(text), 17, 16))


def text_hash(text: Column) -> Column:
    """The first eight bytes of the SHA-256 of a text, in lower-case hex."""
    return F.substring(F.sha2(text, 256), 1, 16)


def database_of_use(sql: Column) -> Column:
    """The database a leading USE statement names, else an empty string."""
    return F.regexp_extract(sql, USE, 1)


def without_use(sql: Column) -> Column:
    """The statement after a leading USE, trimmed; without one, unchanged."""
    return F.when(sql.rlike(USE), F.regexp_replace(F.regexp_replace(sql, USE, ""), r"^\s++|\s++$", "")).otherwise(sql)


def source_host(path: Column) -> Column:
    """A file's base name without its ``.log``, ``.slow`` and ``.gz`` endings."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"(?i)(\.(log|slow|gz))+$", "")


def event_hash(*columns: Column) -> Column:
    """A stable hash of an event's fields, joined by NUL; nulls count as empty."""
    return F.substring(F.sha2(F.concat_ws("\x00", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256), 1, 16)


def rfc3339(ts: Column) -> Column:
    """UTC time to the second, as served by the API."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def preview(text: Column) -> Column:
    return F.substring(text, 1, 200)


def register_sql_functions(spark: SparkSession) -> None:
    """Names that raw SQL may use, as SQL bodies that Catalyst inlines."""
    for body in (
        "list_contains(a array<string>, v string) returns boolean return exists(a, e -> e <=> v)",
        "sha256(t string) returns string return sha2(t, 256)",
        r"source_host(p string) returns string return regexp_replace(regexp_replace(p, r'^.*[/\\]', ''), r'(?i)(\.(log|slow|gz))+$', '')",
        "text_hash(t string) returns string return substring(sha2(t, 256), 1, 16)",
        "fingerprint_id(t string) returns string return upper(substring(md5(t), 17, 16))",
    ):
        spark.sql(f"create or replace temporary function {body}")
