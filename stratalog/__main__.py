"""python -m stratalog --data DIR COMMAND: the store from a shell."""

import argparse
import sys

from stratalog.errors import StoreError
from stratalog.functions.keys import check_key
from stratalog.operators.read import lines, rows_wanted
from stratalog.sources.store import Store
from stratalog.streaming.watch import as_lines


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stratalog")
    p.add_argument("--data", default="data/stratalog", help="the store's folder")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {"put": ["key", "value"], "get": ["key"], "delete": ["key"], "flush": [], "compact": [], "stats": [], "import": ["file"], "verify": [], "vacuum": []}.items():
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
    for name in ("scan", "export"):
        c = sub.add_parser(name)
        c.add_argument("--prefix", default="")
        c.add_argument("--limit", type=int)
    watcher = sub.add_parser("watch")
    watcher.add_argument("--prefix", default="")
    return p


def report(d: dict) -> str:
    return "\n".join(f"{k}: {str(v).lower() if isinstance(v, bool) else v}" for k, v in d.items())


def run(store: Store, args: argparse.Namespace) -> str:
    if args.command == "put":
        store.put(check_key(args.key), args.value)
        return "OK"
    if args.command == "delete":
        store.delete(check_key(args.key))
        return "OK"
    if args.command == "get":
        value = store.get(args.key)
        return "(not found)" if value is None else value
    if args.command == "scan":
        rows = store.scan(args.prefix, rows_wanted(args.limit, "cli"))
        return "\n".join(r["line"] for r in lines(rows).collect())
    if args.command == "watch":

        def show(events, k):
            for r in as_lines(events).orderBy("seq").toLocalIterator():
                print(r["line"], flush=True)

        store.feed(show, args.prefix).awaitTermination()
        return ""
    if args.command == "import":
        with open(args.file, encoding="utf-8") as f:
            return report(store.import_json(f.read()))
    if args.command == "export":
        return store.export_json(args.prefix, args.limit)
    if args.command == "verify":
        return f"layers: {store.verify()}"
    if args.command == "vacuum":
        return f"folders: {store.vacuum()}"
    return report({"flush": store.flush, "compact": store.compact, "stats": store.stats}[args.command]())


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("stratalog").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        print(run(Store(spark, args.data), args))
    except StoreError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
