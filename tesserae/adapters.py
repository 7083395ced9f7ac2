"""Thin transports over the catalog: HTTP for reading, and line-delimited JSON-RPC 2.0."""

from __future__ import annotations

import json
import threading
import time
from collections import defaultdict, deque
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, unquote, urlsplit

from tesserae import vocab
from tesserae.operators.search import ARGUMENTS, ArgumentError

PATH_CHARS, FIELDS, LINE_BYTES = 8192, 13, 256 * 1024
VERSION = "2025-06-18"


class Limiter:
    """At most so many admitted calls of a client in a sliding window."""

    def __init__(self, most: int = vocab.RATE_CALLS, seconds: float = vocab.RATE_SECONDS, clock=time.monotonic):
        self.most, self.seconds, self.clock = most, seconds, clock
        self.calls: dict[str, deque] = defaultdict(deque)
        self.lock = threading.Lock()

    def admit(self, client: str) -> bool:
        with self.lock:
            now, mine = self.clock(), self.calls[client]
            while mine and now - mine[0] >= self.seconds:
                mine.popleft()
            if len(mine) >= self.most:
                return False
            mine.append(now)
            return True


def arguments_of(pairs: list[tuple[str, str]]) -> dict:
    """Search arguments from a query string; numbers are digits, nothing is given twice."""
    if len(pairs) > FIELDS or len({k for k, _ in pairs}) < len(pairs):
        raise ArgumentError("arguments: too many, or one twice")
    out: dict = {}
    for key, value in pairs:
        if key in ("limit", "offset"):
            if not (value.isascii() and value.isdigit() and len(value) <= 6):
                raise ArgumentError(f"{key}: digits are needed")
            out[key] = int(value)
        else:
            out[key] = value
    return out


def answer(catalog, target: str) -> tuple[int, object]:
    """Status and body of a GET."""
    url = urlsplit(target)
    try:
        if len(target) > PATH_CHARS:
            return 414, {"error": "too long"}
        if url.path == "/api/search":
            return 200, catalog.search(**arguments_of(parse_qsl(url.query, keep_blank_values=True)))
        if url.path == "/api/stats" and not url.query:
            return 200, catalog.stats()
        if url.path.startswith("/api/items/") and not url.query:
            found = catalog.get(unquote(url.path.removeprefix("/api/items/")))
            return (200, found) if found else (404, {"error": "not found"})
    except ArgumentError as e:
        return 400, {"error": str(e)}
    return 404, {"error": "not found"}


def make_server(catalog, port: int, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    limiter = Limiter()
    names = {f"{h}:{port}" for h in (host, "localhost", "127.0.0.1")}

    class Handler(BaseHTTPRequestHandler):
        timeout = 10

        def reply(self, status: int, body: object) -> None:
            data = json.dumps(body, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            for key, value in {"Content-Type": "application/json; charset=utf-8", "Content-Length": str(len(data)), "X-Content-Type-Options": "nosniff", "Content-Security-Policy": "default-src 'none'", "Cache-Control": "no-store"}.items():
                self.send_header(key, value)
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(data)

        def do_GET(self) -> None:
            origin = self.headers.get("Origin")
            own = {f"{host}:{self.server.server_port}", f"localhost:{self.server.server_port}"} | names
            if self.headers.get("Host") not in own or (origin and origin.removeprefix("http://") not in own):
                return self.reply(403, {"error": "not this host"})
            if not limiter.admit(self.client_address[0]):
                return self.reply(429, {"error": "too many calls"})
            self.reply(*answer(catalog, self.path))

        do_HEAD = do_GET

        def refuse(self) -> None:
            self.reply(405, {"error": "reading only"})

        do_POST = do_PUT = do_PATCH = do_DELETE = refuse

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def serve(catalog, port: int) -> None:
    with make_server(catalog, port) as server:
        server.serve_forever()


TOOLS = [
    {"name": "search", "description": "Search the catalog.", "inputSchema": {"type": "object", "properties": {n: {"type": "string"} for n in ARGUMENTS} | {"limit": {"type": "integer"}, "offset": {"type": "integer"}}, "additionalProperties": False}},
    {"name": "get", "description": "One record by id or alias.", "inputSchema": {"type": "object", "properties": {"id": {"type": "string"}}, "required": ["id"], "additionalProperties": False}},
    {"name": "stats", "description": "Counts of the catalog.", "inputSchema": {"type": "object", "properties": {}, "additionalProperties": False}},
]


class Session:
    """One client's JSON-RPC state."""

    def __init__(self, catalog):
        self.catalog, self.ready = catalog, False

    def handle(self, line: bytes) -> dict | None:
        def refused(code: int, message: str, ident=None) -> dict:
            return {"jsonrpc": "2.0", "id": ident, "error": {"code": code, "message": message}}

        def once(pairs: list) -> dict:
            if len(dict(pairs)) < len(pairs):
                raise ValueError("a key is given twice")
            return dict(pairs)

        def no(text: str):
            raise ValueError(f"{text} is no JSON")

        try:
            call = json.loads(line, object_pairs_hook=once, parse_constant=no)
        except (ValueError, RecursionError):
            return refused(-32700, "no JSON")
        if not isinstance(call, dict) or call.get("jsonrpc") != "2.0" or not isinstance(call.get("method"), str) or call.keys() - {"jsonrpc", "id", "method", "params"}:
            return refused(-32600, "no call")
        ident, method, params = call.get("id"), call["method"], call.get("params", {})
        if "id" not in call:
            self.ready |= method == "notifications/initialized"
            return None
        if isinstance(ident, bool) or not isinstance(ident, (str, int)) or not isinstance(params, dict):
            return refused(-32600, "no call")
        done = lambda result: {"jsonrpc": "2.0", "id": ident, "result": result}
        if method == "initialize":
            return done({"protocolVersion": VERSION, "capabilities": {"tools": {}}, "serverInfo": {"name": "tesserae", "version": "0.1.0"}})
        if method == "ping":
            return done({})
        if not self.ready:
            return refused(-32002, "not initialised", ident)
        if method == "tools/list":
            return done({"tools": TOOLS})
        if method != "tools/call":
            return refused(-32601, "no such method", ident)
        try:
            value = self.tool(params.get("name"), params.get("arguments", {}))
        except ArgumentError as e:
            return done({"isError": True, "content": [{"type": "text", "text": str(e)}]})
        return done({"content": [{"type": "text", "text": json.dumps(value, ensure_ascii=False, default=str)}]})

    def tool(self, name, arguments):
        if not isinstance(arguments, dict):
            raise ArgumentError("arguments: an object is needed")
        if name == "search":
            return self.catalog.search(**arguments) if not arguments.keys() - ARGUMENTS.keys() - {"limit", "offset"} else self.catalog.search(unknown="")
        if name == "get" and arguments.keys() == {"id"}:
            return self.catalog.get(arguments["id"])
        if name == "stats" and not arguments:
            return self.catalog.stats()
        raise ArgumentError("no such tool, or not its arguments")


def rpc(catalog, source, sink) -> None:
    """Answers calls line by line; what is left of an oversized line is skipped."""
    session = Session(catalog)
    while line := source.readline(LINE_BYTES + 1):
        if len(line) > LINE_BYTES:
            while line and not line.endswith(b"\n"):
                line = source.readline(LINE_BYTES)
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "too long"}}
        elif not line.strip():
            continue
        else:
            reply = session.handle(line)
        if reply is not None:
            sink.write(json.dumps(reply, ensure_ascii=False).encode() + b"\n")
            sink.flush()
