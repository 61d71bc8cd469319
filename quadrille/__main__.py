"""python -m quadrille: load N-Triples, query, update, describe and compact a store."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .service import describe, http
from .service.config import load_config
from .service.engine import Engine
from .sinks import results
from .sources import ntriples


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quadrille", description=__doc__)
    p.add_argument("--store", required=True, help="folder of the graphs")
    sub = p.add_subparsers(dest="command", required=True)
    load = sub.add_parser("load", help="replace a graph by a file's triples")
    load.add_argument("graph")
    load.add_argument("file")
    load.add_argument("--format", default="nt", choices=["nt"])
    for name, what in (("query", "run a query page by page"), ("update", "run an update")):
        q = sub.add_parser(name, help=what)
        q.add_argument("graph")
        q.add_argument("text", nargs="?", help="SPARQL, or - for standard input")
        q.add_argument("--file")
        if name == "query":
            q.add_argument("--format", default="json", choices=["json", "w3c/json", "w3c/xml"])
            q.add_argument("--limit", type=int, help="rows in all")
            q.add_argument("--page", type=int, default=2000, help="rows in a page")
    for name, what in (("describe", "the graph's VoID description"), ("index", "compute statistics and compact")):
        g = sub.add_parser(name, help=what)
        g.add_argument("graph")
        if name == "describe":
            g.add_argument("--format", default="nt", choices=["nt", "turtle", "xml", "json-ld"])
    serve = sub.add_parser("serve", help="answer over HTTP until interrupted")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8000)
    serve.add_argument("--config", help="a YAML file that describes the dataset")
    a = p.parse_args(argv)
    engine = Engine(SparkSession.builder.getOrCreate(), a.store)
    if a.command == "load":
        triples, dropped = ntriples.read(engine.spark, a.file)
        engine.load(a.graph, triples)
        print(f"{engine.statistics(a.graph).first()['triples']} triples, {dropped.first()[0]} lines dropped", file=sys.stderr)
    elif a.command == "index":
        engine.store.create(a.graph).compact().analyze()
    elif a.command == "describe":
        sys.stdout.write(describe.written(engine.describe(a.graph), a.format)[0])
    elif a.command == "serve":
        http.server(load_config(engine.spark, a.config, a.store) if a.config else engine, a.host, a.port).serve_forever()
    else:
        text = open(a.file).read() if a.file else sys.stdin.read() if a.text in (None, "-") else a.text
        if a.command == "update":
            print(engine.update(text, a.graph))
            return 0
        left = a.limit
        kind = {"json": results.JSON, "w3c/json": results.W3C_JSON, "w3c/xml": results.W3C_XML}[a.format]
        for page in engine.iter_pages(text, a.graph, max_results=a.page):
            if left is not None:
                page.bindings = page.bindings[:left]
                left -= len(page.bindings)
            print(results.render(page, kind))
            if left == 0:
                break
    return 0


if __name__ == "__main__":
    sys.exit(main())
