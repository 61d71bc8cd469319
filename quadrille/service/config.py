"""A dataset described by a YAML file: graphs with their backends and limits."""

from __future__ import annotations

import math
import uuid

import yaml
from pyspark.sql import SparkSession

from ..sources import ntriples  # noqa: F401  registers its backend
from ..sources.base import import_backend, open_source, register
from ..sources.store import Store
from .engine import Engine, GraphInfo

register("store", lambda spark, c: None, ())  # graphs of the store itself


def load_config(spark: SparkSession, path: str, store: str | None = None) -> Engine:
    """The engine that the file describes. Wrong declarations are SyntaxErrors."""
    with open(path) as f:
        config = yaml.safe_load(f)
    for b in config.get("backends") or []:
        if not {"name", "path", "connector", "required"} <= set(b):
            raise SyntaxError("a backend needs name, path, connector and required")
        import_backend(b["name"], b["path"], b["connector"], b["required"])
    if "graphs" not in config:
        raise SyntaxError("no graphs are declared")

    def limit(value: object) -> float:
        return math.inf if value == "inf" else float(value)

    root = config.get("store") or store
    if root is None:
        raise SyntaxError("no store is declared")
    engine = Engine(spark, Store(spark, root), stateless=config.get("stateless", True), name=config["name"], public_url=config.get("public_url"))
    engine.maintainer, engine.default_query, engine.analytics = config.get("maintainer"), config.get("default_query"), config.get("google_analytics")
    if "long_description" in config:
        with open(config["long_description"]) as f:
            engine.description = f.read()
    quantum, most = limit(config.get("quota", 75)), limit(config.get("max_results", "inf"))
    for g in config["graphs"]:
        if "uri" not in g:
            raise SyntaxError(f"a graph has no uri: {g}")
        name = g.get("name") or str(uuid.uuid4())
        engine.info[g["uri"]] = GraphInfo(g["uri"], name, g.get("description", f"Unnamed RDF graph with id {name}"), limit(g.get("quota", quantum)), limit(g.get("max_results", most)), g.get("queries") or [])
        if g.get("backend", "store") == "store":
            engine.store.create(g["uri"])
        else:
            engine.store.attach(g["uri"], open_source(spark, g))
    return engine
