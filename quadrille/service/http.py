"""The engine over HTTP, with nothing but the standard library: queries by GET and POST, pages by their next link, descriptions.

Requests run in threads; what they compute runs in Spark. An update is a query to ``/sparql`` like any other.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, quote, unquote, urlsplit

from ..errors import BadToken, DeleteInsertConflict, SparqlSyntaxError, UnknownGraph, UnsupportedSPARQL
from ..sinks import results
from . import describe
from .engine import Engine

#: Exceptions of a request -> status.
STATUS = {UnknownGraph: 404, BadToken: 400, SparqlSyntaxError: 400, UnsupportedSPARQL: 400, DeleteInsertConflict: 409, KeyError: 422, ValueError: 400}
LONGEST = 1 << 22


class Handler(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"
    engine: Engine

    # ---- answers

    def answer(self, status: int, text: str, media: str = "text/plain", **headers: str) -> None:
        data = text.encode()
        self.send_response(status)
        for name, value in {"Content-Type": f"{media}; charset=utf-8", "Content-Length": str(len(data)), "Access-Control-Allow-Origin": "*", **headers}.items():
            self.send_header(name, value)
        self.end_headers()
        if self.command != "HEAD":
            self.wfile.write(data)

    def log_message(self, *_: object) -> None:
        """Requests aren't logged here."""

    def base(self) -> str:
        return self.engine.public_url or f"http://{self.headers.get('Host', 'localhost')}"

    def sparql(self, query: str, graph: str, token: str | None) -> None:
        accept = self.headers.get("Accept")
        page = self.engine.page(query, graph, token or None)
        self.answer(200, results.render(page, accept, self.base()), results.negotiate(accept))

    # ---- routes

    def do_GET(self) -> None:
        self.guarded(self.get)

    def do_POST(self) -> None:
        self.guarded(self.post)

    def do_OPTIONS(self) -> None:
        self.answer(204, "", **{"Access-Control-Allow-Methods": "GET, POST, OPTIONS", "Access-Control-Allow-Headers": "*"})

    def guarded(self, route) -> None:
        try:
            route()
        except Exception as e:  # told to the client, whatever it is
            status = next((s for kind, s in STATUS.items() if isinstance(e, kind)), 500)
            self.answer(status, json.dumps({"detail": str(e) or type(e).__name__}), "application/json")

    def get(self) -> None:
        url = urlsplit(self.path)
        path, wanted = url.path.rstrip("/"), self.headers.get("Accept")
        if path == "":
            self.answer(200, f"{self.engine.name}: a SPARQL endpoint\n")
        elif path == "/sparql":
            given = {k: v[0] for k, v in parse_qs(url.query).items()}
            self.sparql(given["query"], given["default-graph-uri"], given.get("next"))
        elif path == "/.well-known/void":
            self.answer(307, "", Location="/void/")
        elif path == "/void":
            self.answer(200, *describe.written(self.engine.describe_all(self.base()), wanted))
        elif path.startswith("/void/"):
            name = unquote(path.removeprefix("/void/"))
            uri = next((g.uri for g in self.engine.info.values() if g.name == name), name)
            self.answer(200, *describe.written(self.engine.describe(uri), wanted))
        else:
            self.answer(404, json.dumps({"detail": "no such page"}), "application/json")

    def post(self) -> None:
        length = int(self.headers.get("Content-Length") or 0)
        if length > LONGEST:
            raise ValueError("the request is too long")
        body = self.rfile.read(length).decode()
        if urlsplit(self.path).path.rstrip("/") != "/sparql":
            self.answer(404, json.dumps({"detail": "no such page"}), "application/json")
            return
        kind = (self.headers.get("Content-Type") or "").split(";")[0].strip()
        if kind == "application/x-www-form-urlencoded":
            given = {k: v[0] for k, v in parse_qs(body).items()}
            self.sparql(given["query"], given["default-graph-uri"], given.get("next"))
        else:
            given = json.loads(body)
            self.sparql(given["query"], given["defaultGraph"], given.get("next"))


def server(engine: Engine, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that isn't running yet: ``serve_forever()`` starts it, ``server_port`` tells its port."""
    return ThreadingHTTPServer((host, port), type("EngineHandler", (Handler,), {"engine": engine}))


def next_link(base: str, query: str, graph: str, token: str) -> str:
    """The address of a query's next page."""
    return f"{base}/sparql?query={quote(query)}&default-graph-uri={quote(graph)}&next={quote(token)}"
