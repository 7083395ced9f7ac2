"""python -m tesserae BUNDLE search|get|stats|export|serve|rpc: exit 0 if found, 1 if not, 2 for bad arguments."""

from __future__ import annotations

import argparse
import json
import sys

from tesserae.catalog import Catalog
from tesserae.functions.text import terminal_safe
from tesserae.operators.search import ARGUMENTS, ArgumentError
from tesserae.session import local_session


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tesserae", description=__doc__)
    out.add_argument("bundle")
    sub = out.add_subparsers(dest="command", required=True)
    one = sub.add_parser("search")
    for name in ARGUMENTS:
        one.add_argument(f"--{name.replace('_', '-')}", default="")
    one.add_argument("--limit", type=int, default=24)
    one.add_argument("--offset", type=int, default=0)
    sub.add_parser("get").add_argument("id")
    sub.add_parser("stats")
    sub.add_parser("export").add_argument("path")
    serve = sub.add_parser("serve")
    serve.add_argument("--port", type=int, default=8000)
    sub.add_parser("rpc")
    return out


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    catalog = Catalog(spark or local_session(), a.bundle)
    show = lambda value: print(terminal_safe(json.dumps(value, ensure_ascii=False, default=str)))
    try:
        if a.command == "search":
            found = catalog.search(**{k: getattr(a, k) for k in (*ARGUMENTS, "limit", "offset")})
            show(found)
            return 0 if found["total"] else 1
        if a.command == "get":
            found = catalog.get(a.id)
            show(found)
            return 0 if found else 1
        if a.command == "stats":
            show(catalog.stats())
        elif a.command == "export":
            from tesserae.sources.sinks import write_csv

            write_csv(catalog.export(), a.path)
        elif a.command == "serve":
            from tesserae.adapters import serve

            serve(catalog, a.port)
        else:
            from tesserae.adapters import rpc

            rpc(catalog, sys.stdin.buffer, sys.stdout.buffer)
    except ArgumentError as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
