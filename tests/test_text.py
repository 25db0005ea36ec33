"""Fingerprints, USE statements, source hosts and tables."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querylens.functions import text
from querylens.functions.tables import lex, tables_column, tables_of, tables_of_repeated

# Ids and texts that are known from outside.
GOLDEN = {
    "13980AA1698C3634": ("SELECT * FROM orders WHERE customer_id = 7 AND status = 'paid'", "select * from orders where customer_id = ? and status = ?"),
    "945052ADCBFE6486": ("SELECT country, count(*) FROM events GROUP BY country", "select country, count(*) from events group by country"),
    "77D5CE87BDEB0083": ("SELECT id, total FROM invoices WHERE created_at > '2024-01-01'", "select id, total from invoices where created_at > ?"),
}
FINGERPRINTS = (
    *GOLDEN.values(),
    ("select /* hi 'x */ a -- c\n from t1 where b in (1, 2,3) and c='it''s -- no' # z", "select a from t1 where b in (?+) and c=?"),
    ("INSERT INTO t (a,b) VALUES (1,'x'), (2, 'y');", "insert into t (a,b) values (?+)"),
    ("select `a b`, t.`1c` from x1.y2 where z=0xFF and q>=1.5e-3 and n = 'a\\'b'", "select `a b`, t.`1c` from x1.y2 where z=? and q>=? and n = ?"),
    ("select 'unterminated", "select 'unterminated"),
    ("a = -5 and b > +1.5 and c-1", "a = ? and b > ? and c-?"),
    ("  select\t1 ;; ", "select ?"),
    ("", ""),
    ("select \"a -- b\", '/* c */'", "select ?, ?"),
)
USES = (
    ("use crm; SELECT 2", "crm", "SELECT 2"),
    ("use crm SELECT 2", "crm", "SELECT 2"),
    ("UsE Crm ;\n  SELECT 2  ", "Crm", "SELECT 2"),
    ("use `crm_9`;SELECT 2", "crm_9", "SELECT 2"),
    ("\t use crm", "crm", ""),
    (" SELECT 2 ", "", " SELECT 2 "),
    ("SELECT 2; use crm;", "", "SELECT 2; use crm;"),
    ("user; SELECT 2", "", "user; SELECT 2"),
)
HOSTS = {
    "/logs/eu/node7.slow.log": "node7",
    "node7-slow.log": "node7-slow",
    "/logs/node7.log.gz": "node7",
    "node7": "node7",
    "D:\\logs\\node7.slow.log": "node7",
    "/logs/slow.log": "slow",
    "/logs/a.b.c.slow.log.gz": "a.b.c",
    "/logs/NODE7.Slow.LOG": "NODE7",
    "/logs/node7.log.1": "node7.log.1",
    "": "",
}
TABLES = (
    # names that WITH defines don't count, what their bodies read does
    ("WITH top AS (SELECT k FROM sales) SELECT * FROM top JOIN shops ON top.k = shops.k", "", "sales shops"),
    ("with p as (select 1 from q1), r as (select 1 from q2) select 1 from p join r join s", "", "q1 q2 s"),
    ("WITH RECURSIVE tree (a, b) AS (SELECT 1, 2 FROM seed) SELECT * FROM tree", "", "seed"),
    ("WITH top AS (SELECT 1) SELECT * FROM old.top", "", "old.top"),
    ("WITH top AS (SELECT 1 FROM m) SELECT 1 FROM top; SELECT 1 FROM top", "", "m top"),
    # qualified by the database unless they are
    ("SELECT a FROM crm.people WHERE b = 3", "crm", "crm.people"),
    ("SELECT a FROM people WHERE b = 3", "crm", "crm.people"),
    ("SELECT a FROM people", "", "people"),
    ("SELECT a FROM x.people JOIN visits USING (id)", "crm", "x.people crm.visits"),
    # nested, cut off and called
    ("SELECT a FROM crm.people) AS cut", "crm", "crm.people"),
    ("SELECT a FROM people WHERE id IN (SELECT pid FROM crm.visits)", "crm", "crm.people crm.visits"),
    ("SELECT a FROM (SELECT b FROM people) AS inner_ JOIN visits ON 1", "crm", "crm.people crm.visits"),
    ("SELECT FROM_DAYS(d) FROM calendar", "crm", "crm.calendar"),
    ("SELECT a FROM series(9)", "crm", ""),
    ("SELECT 9 FROM DUAL", "crm", ""),
    ("SELECT 9", "crm", ""),
    # writes
    ("INSERT INTO people (a, b) VALUES (1, 2)", "crm", "crm.people"),
    ("INSERT INTO archive SELECT a FROM people", "crm", "crm.archive crm.people"),
    ("UPDATE crm.people SET a = 1", "", "crm.people"),
    ("DELETE FROM people WHERE born < CURDATE()", "crm", "crm.people"),
    ("use crm; SELECT a FROM people", "crm", "crm.people"),
    # aliases, repeats, case
    ("SELECT a FROM people AS p JOIN visits AS v ON p.id = v.pid", "", "people visits"),
    ("SELECT a FROM people p, visits v", "", "people"),
    ("SELECT a FROM people p JOIN people q ON p.id = q.boss", "", "people"),
    ("SELECT a FROM people p JOIN visits v ON 1 LEFT JOIN towns t ON 2", "c", "c.people c.visits c.towns"),
    ("select a from PEOPLE join People on 1", "Crm", "Crm.PEOPLE Crm.People"),
    # quotes
    ("SELECT a FROM `peo ple` JOIN `x`.`y` ON 1", "", ["peo ple", "x.y"]),
    ('SELECT a FROM "People" WHERE b', "crm", "crm.People"),
    ("SELECT a FROM people WHERE b = ' FROM visits'", "", "people"),
    ("SELECT a FROM people WHERE b = 'it\\'s FROM visits", "", "people"),
    ("SELECT 1 FROM größe", "", "größe"),
    # known limits
    ("INSERT INTO t (c) VALUES (1) ON DUPLICATE KEY UPDATE c=1", "", "t c"),
    ("SELECT EXTRACT(YEAR FROM born) FROM people", "", "born people"),
)


def columns(spark, rows, schema, *made):
    return [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").select("i", *made).orderBy("i").drop("i").collect()]


def test_fingerprints_in_python_and_spark(spark):
    got = columns(spark, [(s,) for s, _ in FINGERPRINTS], "s string", text.fingerprint_column(F.col("s")))
    for (sql, want), (found,) in zip(FINGERPRINTS, got):
        assert text.fingerprint(sql) == want
        assert found == want


def test_golden_ids(spark):
    got = columns(spark, [(s,) for s, _ in GOLDEN.values()], "s string", text.fingerprint_id(text.fingerprint_column(F.col("s"))))
    assert [x for x, in got] == list(GOLDEN)


def test_long_statements_dont_recurse(spark):
    lists = "select * from t where a in (" + ",".join(str(i) for i in range(50_000)) + ") and b = '" + "x" * 200_000 + "'"
    values = "insert into t values " + ",".join(f"({i}, 'v{i}')" for i in range(20_000))
    got = columns(spark, [(lists,), (values,)], "s string", text.fingerprint_column(F.col("s")))
    assert got == [("select * from t where a in (?+) and b = ?",), ("insert into t values (?+)",)]


def test_use_statements(spark):
    got = columns(spark, [(s,) for s, _, _ in USES], "s string", text.database_of_use(F.col("s")), text.without_use(F.col("s")))
    assert got == [(db, rest) for _, db, rest in USES]


def test_source_hosts(spark):
    got = columns(spark, [(p,) for p in HOSTS], "p string", text.source_host(F.col("p")))
    assert [x for x, in got] == list(HOSTS.values())
    text.register_sql_functions(spark)
    assert spark.sql("select source_host('/logs/host.log.gz'), list_contains(array('a', null), 'a'), sha256('x') = text_hash('x')").first()[:2] == ("host", True)


@pytest.mark.parametrize(("sql", "db", "want"), TABLES)
def test_tables(sql, db, want):
    want = want if isinstance(want, list) else want.split()
    assert tables_of(sql, db) == list(tables_of_repeated(sql, db)) == want


@given(st.text(alphabet="from into`\"'\\\\ .,;()a1é_\n", max_size=60), st.text(alphabet="ab", max_size=2))
def test_literals_dont_matter(sql, db):
    assert tables_of(sql, db) == list(tables_of_repeated(sql, db))


def test_tables_column(spark):
    got = columns(spark, [(s, d) for s, d, _ in TABLES] + [(None, None)], "s string, d string", tables_column(F.col("s"), F.col("d")))
    assert [x for x, in got] == [w if isinstance(w, list) else w.split() for _, _, w in TABLES] + [[]]


def test_lexer_reads_on():
    assert [t for k, t in lex("a.`b c`(\"d\" 'e.f' 12g;") if k == "name"] == ["a", "b c", "d", "g"]
    assert lex("`never closed FROM t") == []


@given(st.text(), st.text(max_size=5))
def test_any_text_is_read(sql, db):
    assert isinstance(tables_of(sql, db), list)
    assert isinstance(text.fingerprint(sql), str)


def test_hashes_are_stable(spark):
    row = spark.sql("select 'a' as a, 1.5 as b, cast(null as string) as c").select(text.event_hash(F.col("a"), F.col("b"), F.col("c")), text.text_hash(F.lit("x"))).first()
    import hashlib

    assert row[0] == hashlib.sha256(b"a\x001.5\x00").hexdigest()[:16]
    assert row[1] == hashlib.sha256(b"x").hexdigest()[:16]
