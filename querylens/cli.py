"""Command line: parse, stats, query, serve, version."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Sequence

from pyspark.sql import SparkSession

from querylens import config as settings
from querylens.functions.text import register_sql_functions
from querylens.ingest import Ingester, ParseResult
from querylens.operators.maintenance import file_stats, stats
from querylens.plans import guard
from querylens.sources.store import Store, StoreUnavailable

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="querylens", description="Slow-query log analytics on Spark")
    out.add_argument("--config", help="settings file")
    out.add_argument("--slow-log-dir", help="folder of slow logs")
    out.add_argument("--store-path", help="folder of the store")
    commands = out.add_subparsers(dest="command", required=True)
    parse = commands.add_parser("parse", help="parse new slow logs into the store")
    parse.add_argument("-f", "--file", help="parse a single file")
    parse.add_argument("-v", "--verbose", action="store_true")
    commands.add_parser("stats", help="statistics of the store")
    query = commands.add_parser("query", help="run a SQL query")
    query.add_argument("sql")
    serve = commands.add_parser("serve", help="serve the HTTP API")
    serve.add_argument("--port", type=int)
    serve.add_argument("--no-auth", action="store_true")
    commands.add_parser("version", help="print the version")
    return out


def session() -> SparkSession:
    return SparkSession.builder.appName("querylens").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def show_parse(result: ParseResult) -> None:
    print("\n=== Parse Results ===")
    for name, value in (
        ("Files processed", result.files_processed),
        ("Files skipped", result.files_skipped),
        ("Files failed", result.files_failed),
        ("Entries parsed", result.entries_parsed),
        ("Entries stored", result.entries_stored),
        ("Duration", f"{result.seconds:.3f}s"),
    ):
        print(f"{name + ':':<17}{value}")
    if result.errors:
        print(f"\nErrors ({len(result.errors)}):", *(f"  - {e}" for e in result.errors), sep="\n")


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(f"querylens {VERSION}")
        return 0
    chosen = settings.load(args.config, flags={"slow_log_dir": args.slow_log_dir, "store_path": args.store_path, "port": getattr(args, "port", None)})
    spark = spark or session()
    store = Store(spark, chosen.store_path)
    try:
        if args.command == "parse":
            began, ingester = time.monotonic(), Ingester(spark, store, chosen.file_patterns)
            show_parse(ingester.parse_file(args.file) if args.file else ingester.parse_directory(chosen.slow_log_dir))
            if args.verbose:
                print(f"\nTotal time: {time.monotonic() - began:.3f}s")
        elif args.command == "stats":
            for title, found in (("Slow Log Statistics", stats(store.logs())), ("File Statistics", file_stats(store.files()))):
                print(f"=== {title} ===", *(f"{k}: {v}" for k, v in found.first().asDict().items() if v is not None), "", sep="\n")
        elif args.command == "query":
            store.create_views()
            register_sql_functions(spark)
            found = guard.execute(spark, args.sql, guard.MOST_TIMEOUT_MS)
            print(f"\nColumns: {found.columns}", f"Rows ({len(found.rows)}{', cut' if found.truncated else ''}):", *(f"  {i}: {list(r)}" for i, r in enumerate(found.rows, 1)), sep="\n")
        else:
            from querylens.api import Service, serve

            if not chosen.api_key and not args.no_auth:
                print("an API key is required (QUERYLENS_API_KEY), or --no-auth", file=sys.stderr)
                return 1
            register_sql_functions(spark)
            server = serve(Service(store, chosen.api_key, auth=not args.no_auth), chosen.host, chosen.port)
            print(f"listening on {chosen.host}:{server.server_port}")
            server.serve_forever()
    except (FileNotFoundError, StoreUnavailable, guard.UnsafeQuery, guard.QueryTimeout) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
