"""The read-only HTTP service, on the standard library's server."""

from __future__ import annotations

import datetime as dt
import gzip
import hmac
import json
import math
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame

from querylens.operators import aggregate
from querylens.operators.filters import RecordFilter
from querylens.operators.maintenance import file_stats, stats
from querylens.operators.records import distinct_values, facets, listing, record_by_id, with_source
from querylens.plans import guard, reports
from querylens.sources.store import Store, StoreUnavailable

#: Version of the HTTP contract.
CONTRACT = "1.0.0"
DATABASE = re.compile(r"[A-Za-z0-9_.-]+")
# Origins that browsers may call from.
ORIGINS = (
    "http://localhost:3000",
    "http://localhost:5173",
    "http://localhost:4173",
    "http://127.0.0.1:5173",
    "http://127.0.0.1:4173",
)


class Refused(Exception):
    """An answer that isn't 200."""

    def __init__(self, status: int, code: str, message: str):
        super().__init__(message)
        self.status, self.code, self.message = status, code, message


def bad(message: str) -> Refused:
    return Refused(400, "invalid_param", message)


def instant(value) -> str:
    """A time in UTC to the second."""
    if isinstance(value, dt.datetime):
        if value.tzinfo:
            value = value.astimezone(dt.UTC)
        return value.strftime("%Y-%m-%dT%H:%M:%SZ")
    return ""


def plain(value):
    """A value of a result as JSON."""
    if isinstance(value, dt.datetime):
        return instant(value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).decode("utf-8", "replace")
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


@dataclass(frozen=True)
class QueryParameters:
    """What ``/sql/queries`` is asked for."""

    limit: int
    since: dt.datetime
    until: dt.datetime
    min_execution_ms: float = 0.0
    database: str = ""
    known: tuple[str, ...] = ()
    cursor: aggregate.Cursor | None = None

    @classmethod
    def read(cls, given: dict[str, str], now: dt.datetime) -> QueryParameters:
        blank = lambda name: given.get(name, "").strip()
        limit = aggregate.LIMIT
        if blank("limit"):
            if not re.fullmatch(r"[+-]?\d+", blank("limit")) or not 1 <= int(blank("limit")) <= aggregate.MOST:
                raise bad("Invalid limit parameter.")
            limit = int(blank("limit"))
        bounds = {"since": now - dt.timedelta(days=aggregate.WINDOW_DAYS), "until": now}
        for name in bounds:
            if blank(name):
                bounds[name] = rfc3339(blank(name), f"Invalid {name} parameter.")
        if bounds["since"] > bounds["until"]:
            raise bad("since must be before or equal to until.")
        least = 0.0
        if blank("min_execution_ms"):
            try:
                least = float(blank("min_execution_ms"))
            except ValueError:
                least = math.nan
            if not math.isfinite(least) or least < 0:
                raise bad("Invalid min_execution_ms parameter.")
        database = blank("database")
        if database and not DATABASE.fullmatch(database):
            raise bad("Invalid database parameter.")
        try:
            known = tuple(aggregate.known_hashes(given.get("known_hashes", "")))
        except ValueError:
            raise bad("Invalid known_hashes parameter.") from None
        try:
            cursor = aggregate.Cursor.decode(given.get("cursor", ""))
        except ValueError:
            raise bad("Invalid cursor parameter.") from None
        return cls(limit, bounds["since"], bounds["until"], least, database, known, cursor)


def rfc3339(text: str, message: str) -> dt.datetime:
    """UTC without a zone; the text must have one."""
    try:
        found = dt.datetime.fromisoformat(text.replace(" ", "+"))
    except ValueError:
        found = None
    if found is None or found.tzinfo is None or "T" not in text.upper():
        raise bad(message)
    return found.astimezone(dt.UTC).replace(tzinfo=None)


class Service:
    """The routes, without HTTP: methods give (status, body)."""

    def __init__(self, store: Store, token: str = "", auth: bool = True, execute: bool = True, clock: Callable[[], dt.datetime] | None = None):
        self.store, self.token, self.auth, self.may_execute = store, token, auth, execute
        self.clock = clock or (lambda: dt.datetime.now(dt.UTC).replace(tzinfo=None))

    def _snapshot(self):
        try:
            return self.store.snapshot()
        except StoreUnavailable:
            raise Refused(503, "db_unavailable", "Database is unavailable.") from None

    def _records(self, snapshot, **bounds) -> DataFrame:
        return with_source(self.store.logs(snapshot, **bounds), self.store.files(snapshot))

    def databases(self) -> dict:
        found = distinct_values(self.store.logs(self._snapshot()), "db").collect()
        return {"databases": [r.db for r in found if r.db.strip()]}

    def health(self) -> dict:
        """Always fine; databases as far as they can be read."""
        try:
            names = self.databases()["databases"]
        except Exception:
            names = []
        return {"status": "ok", "version": CONTRACT, "databases": names}

    def queries(self, given: dict[str, str]) -> dict:
        asked = QueryParameters.read(given, self.clock())
        snapshot = self._snapshot()  # one snapshot for the count and the page
        bounds = {"since": asked.since, "until": asked.until}
        bare = aggregate.window(self.store.logs(snapshot, **bounds), database=asked.database, **bounds)
        records = aggregate.window(self._records(snapshot, **bounds), database=asked.database, **bounds)
        total = aggregate.fingerprint_count(bare, asked.min_execution_ms, asked.known).first().total_count
        costs = aggregate.fingerprint_costs(records, asked.min_execution_ms, asked.known)
        rows = aggregate.page(costs, asked.limit, asked.cursor).collect()
        shown, more = rows[: asked.limit], len(rows) > asked.limit
        following = aggregate.Cursor(shown[-1].execution_time_ms, shown[-1].id).encode() if more else None
        return {"data": [plain(r.asDict()) for r in shown], "next_cursor": following, "has_more": more, "total_count": total}

    def execute(self, body: dict) -> dict:
        query, database, timeout = body.get("query", ""), body.get("database", ""), body.get("timeout_ms")
        if not isinstance(query, str) or not isinstance(database, str) or not (timeout is None or (isinstance(timeout, int) and not isinstance(timeout, bool))):
            raise bad("Invalid request body.")
        if not query.strip():
            raise bad("query is required.")
        if database and not DATABASE.fullmatch(database):
            raise bad("Invalid database parameter.")
        spark = self.store.spark
        try:
            guard.check(spark, query)
        except guard.UnsafeQuery:
            raise Refused(422, "unsafe_query", "Only a single read-only SELECT query is allowed.") from None
        if timeout is not None and timeout <= 0:
            raise bad("timeout_ms must be positive.")
        self.store.create_views(self._snapshot())
        try:
            found = guard.execute(spark, query, timeout or guard.TIMEOUT_MS)
        except guard.QueryTimeout:
            raise Refused(408, "query_timeout", "Query execution timed out.") from None
        except Exception:
            raise Refused(500, "internal_error", "Failed to execute query.") from None
        return {"columns": found.columns, "rows": plain(found.rows), "row_count": len(found.rows), "truncated": found.truncated, "execution_time_ms": found.milliseconds}

    # the documented reports

    def stats(self) -> dict:
        snapshot = self._snapshot()
        found = {**stats(self.store.logs(snapshot)).first().asDict(), **file_stats(self.store.files(snapshot)).first().asDict()}
        return {k: plain(v) for k, v in found.items() if v is not None}

    def facets(self) -> dict:
        return facets(self._records(self._snapshot()), most=guard.ROW_CAP)

    def records(self, given: dict[str, str]) -> dict:
        listed = lambda name: [v for v in given.get(name, "").split(",") if v.strip()]
        number = lambda name, kind: kind(given[name]) if given.get(name, "").strip() else None
        try:
            narrowed = RecordFilter(
                users=listed("user"),
                hosts=listed("host"),
                dbs=listed("db"),
                source_hosts=listed("source_host"),
                tables=listed("table"),
                fingerprint_id=given.get("fingerprint_id", ""),
                query_time_gt=number("query_time_gt", float),
                query_time_lt=number("query_time_lt", float),
                lock_time_gt=number("lock_time_gt", float),
                lock_time_lt=number("lock_time_lt", float),
                rows_examined_gt=number("rows_examined_gt", int),
                file_path=given.get("file_path", ""),
            )
            limit, offset = min(number("limit", int) or 100, aggregate.MOST), number("offset", int) or 0
        except ValueError:
            raise bad("Invalid filter parameter.") from None
        if limit < 1 or offset < 0:
            raise bad("Invalid limit parameter.")
        snapshot = self._snapshot()
        found = listing(self._records(snapshot), narrowed, self.store.files(snapshot), given.get("order_by", "id"), given.get("order_dir", "asc"))
        return table(found, limit, offset)

    def record(self, id_: str) -> dict:
        found = record_by_id(self._records(self._snapshot()), int(id_)).first() if id_.isdigit() else None
        if found is None:
            raise Refused(404, "not_found", "No such record.")
        return plain(found.asDict())

    def report(self, name: str, given: dict[str, str]) -> dict:
        logs = self.store.logs(self._snapshot())
        try:
            limit, least, offset = int(given.get("limit") or 10), float(given.get("min_time") or 0), int(given.get("offset") or 0)
        except ValueError:
            raise bad("Invalid limit parameter.") from None
        if not 1 <= limit <= aggregate.MOST or offset < 0 or not math.isfinite(least):
            raise bad("Invalid limit parameter.")
        interval = given.get("interval") or "hour"
        if interval not in reports.BUCKETS:
            raise bad("Invalid interval parameter.")
        found = {
            "top-queries": lambda: (reports.top_queries(logs, limit + offset + 1).drop("fingerprint_id"), limit),
            "slowest-queries": lambda: (reports.slowest(logs, limit + offset + 1, least), limit),
            "table-usage": lambda: (reports.table_usage(logs), aggregate.MOST),
            "timeline": lambda: (reports.timeline(logs, interval), guard.ROW_CAP),
            "full-scans": lambda: (reports.full_scans(logs), limit),
            "users": lambda: (reports.by_user(logs), aggregate.MOST),
        }.get(name)
        if not found:
            raise Refused(404, "not_found", "No such report.")
        return table(*found(), offset)

    def search(self, name: str, given: dict[str, str]) -> dict:
        logs, text = self.store.logs(self._snapshot()), given.get("q", "")
        if not text.strip():
            raise bad("q is required.")
        if name not in ("fingerprint", "table"):
            raise Refused(404, "not_found", "No such search.")
        offset = given.get("offset") or "0"
        if not offset.isdigit():
            raise bad("Invalid offset parameter.")
        found = reports.search_fingerprint(logs, text) if name == "fingerprint" else reports.search_table(logs, text)
        return table(found, aggregate.MOST, int(offset))

    def answer(self, method: str, path: str, given: dict[str, str], body: bytes, authorization: str) -> dict:
        """The body of a 200, or Refused."""
        if method == "GET" and path in ("/health", "/api/v1/health"):
            return self.health()
        if method == "GET" and path == "/api/v1/openapi.json":
            return openapi()
        route = path.removeprefix("/api/v1/").split("/") if path.startswith("/api/v1/") else [""]
        if self.auth and route[0] in ("sql", "reports", "search", "stats", "facets", "records"):
            kind, _, token = authorization.partition(" ")
            if kind != "Bearer" or not self.token or not hmac.compare_digest(token.strip().encode(), self.token.encode()):
                raise Refused(401, "unauthorized", "Missing or invalid bearer token.")
        match method, route:
            case "GET", ["sql", "queries"]:
                return self.queries(given)
            case "GET", ["sql", "databases"]:
                return self.databases()
            case "POST", ["sql", "execute"] if self.may_execute:
                try:
                    parsed = json.loads(body)
                except ValueError:
                    parsed = None
                if not isinstance(parsed, dict):
                    raise bad("Invalid request body.")
                return self.execute(parsed)
            case "GET", ["stats"]:
                return self.stats()
            case "GET", ["facets"]:
                return self.facets()
            case "GET", ["records"]:
                return self.records(given)
            case "GET", ["records", id_]:
                return self.record(id_)
            case "GET", ["reports", name]:
                return self.report(name, given)
            case "GET", ["search", name]:
                return self.search(name, given)
        raise Refused(404, "not_found", "No such route.")


def table(df: DataFrame, most: int, offset: int = 0) -> dict:
    """At most so many rows of an ordered DataFrame: columns, rows, their number,
    and whether there are more, which ``offset`` gets at."""
    rows = (df.offset(offset) if offset else df).limit(most + 1).collect()
    shown = [plain(tuple(r)) for r in rows[:most]]
    return {"columns": df.columns, "rows": shown, "count": len(shown), "truncated": len(rows) > most}


def openapi() -> dict:
    """The machine-readable description of the routes."""
    error = {"type": "object", "required": ["error", "message", "request_id"], "properties": {k: {"type": "string"} for k in ("error", "message", "request_id")}}
    text, number, whole = {"type": "string"}, {"type": "number"}, {"type": "integer"}
    texts = {"type": "array", "items": text}
    maybe = lambda kind: {**kind, "nullable": True}
    record = {
        "type": "object",
        "properties": {
            **{k: text for k in ("id", "text", "raw_query", "source", "latest_ts")},
            "execution_time_ms": number,
            "calls": whole,
            "tables": texts,
            "source_hosts": texts,
            **{k: maybe(text) for k in ("user", "host")},
            **{k: maybe(whole) for k in ("rows_sent", "rows_examined")},
            "lock_time_sec": maybe(number),
        },
    }
    record["required"] = list(record["properties"])
    page = {"type": "object", "required": ["data", "next_cursor", "has_more", "total_count"], "properties": {"data": {"type": "array", "items": record}, "next_cursor": maybe(text), "has_more": {"type": "boolean"}, "total_count": whole}}
    rows = {"type": "object", "required": ["columns", "rows", "row_count", "truncated", "execution_time_ms"], "properties": {"columns": texts, "rows": {"type": "array", "items": {"type": "array", "items": {}}}, "row_count": whole, "truncated": {"type": "boolean"}, "execution_time_ms": whole}}
    databases = {"type": "object", "required": ["databases"], "properties": {"databases": texts}}
    health = {"type": "object", "required": ["status", "version", "databases"], "properties": {"status": text, "version": text, "databases": texts}}

    def said(schema: dict, *errors: int) -> dict:
        content = lambda s: {"application/json": {"schema": s}}
        return {"200": {"description": "OK", "content": content(schema)}, **{str(e): {"description": "error", "content": content({"$ref": "#/components/schemas/Error"})} for e in errors}}

    asked = ("limit", "cursor", "since", "until", "min_execution_ms", "database", "known_hashes")
    request = {"type": "object", "required": ["query"], "properties": {"query": text, "database": text, "timeout_ms": whole}}
    secured = [{"bearer": []}]
    return {
        "openapi": "3.0.3",
        "info": {"title": "Slow-query analytics", "version": CONTRACT},
        "paths": {
            "/health": {"get": {"responses": said(health)}},
            "/api/v1/health": {"get": {"responses": said(health)}},
            "/api/v1/openapi.json": {"get": {"responses": said({"type": "object"})}},
            "/api/v1/sql/queries": {"get": {"security": secured, "parameters": [{"name": n, "in": "query", "schema": text} for n in asked], "responses": said(page, 400, 401, 500, 503)}},
            "/api/v1/sql/databases": {"get": {"security": secured, "responses": said(databases, 401, 500, 503)}},
            "/api/v1/sql/execute": {"post": {"security": secured, "requestBody": {"content": {"application/json": {"schema": request}}}, "responses": said(rows, 400, 401, 404, 408, 422, 500, 503)}},
        },
        "components": {"schemas": {"Error": error, "Record": record}, "securitySchemes": {"bearer": {"type": "http", "scheme": "bearer"}}},
    }


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    """The HTTP side: ids, gzip, CORS and errors."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def log_message(self, *args) -> None:
            pass

        def _send(self, status: int, body: dict | None, request_id: str) -> None:
            data = b"" if body is None else json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("X-Request-Id", request_id)
            origin = self.headers.get("Origin", "")
            if origin in ORIGINS:
                self.send_header("Access-Control-Allow-Origin", origin)
                self.send_header("Access-Control-Allow-Credentials", "true")
                self.send_header("Access-Control-Expose-Headers", "Content-Length,Content-Type,X-Request-Id")
                if self.command == "OPTIONS":
                    self.send_header("Access-Control-Allow-Methods", "GET,POST,PUT,PATCH,DELETE,OPTIONS,HEAD")
                    self.send_header("Access-Control-Allow-Headers", "Origin,Content-Type,Accept,Authorization,X-Requested-With")
                    self.send_header("Access-Control-Max-Age", str(12 * 3600))
            if "gzip" in self.headers.get("Accept-Encoding", "") and data:
                data = gzip.compress(data)
                self.send_header("Content-Encoding", "gzip")
                self.send_header("Vary", "Accept-Encoding")
            if body is not None:
                self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(data)

        def _serve(self) -> None:
            request_id = str(uuid.uuid4())
            length = int(self.headers.get("Content-Length") or 0)
            body = self.rfile.read(length) if length else b""
            url = urlsplit(self.path)
            given = {k: v[0] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
            if self.command == "OPTIONS":
                allowed = self.headers.get("Origin", "") in ORIGINS
                return self._send(204 if allowed else 403, None, request_id)
            method = "GET" if self.command == "HEAD" else self.command
            try:
                self._send(200, service.answer(method, url.path, given, body, self.headers.get("Authorization", "")), request_id)
            except Refused as refused:
                self._send(refused.status, {"error": refused.code, "message": refused.message, "request_id": request_id}, request_id)
            except Exception:
                self._send(500, {"error": "internal_error", "message": "Failed to fetch query records.", "request_id": request_id}, request_id)

        do_GET = do_POST = do_PUT = do_PATCH = do_DELETE = do_OPTIONS = do_HEAD = _serve

    return Handler


def serve(service: Service, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server, not yet running; ``serve_forever`` runs it."""
    return ThreadingHTTPServer((host, port), handler(service))
