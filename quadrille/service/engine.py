"""The engine's interface: queries, pages, updates and descriptions of a dataset."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import UnknownGraph
from ..operators.update import UpdateExecutor
from ..plans.planner import Planner
from ..plans.sparql import is_update, parse_query, parse_update
from ..sources.files import shared_dir
from ..sources.store import Snapshot, Store, StoredGraph
from ..streaming.paging import Page, Pager, ResultCache, TokenStore
from . import describe


@dataclass
class GraphInfo:
    """A graph's settings: its quantum in milliseconds and page size, infinite if there is no limit."""

    uri: str
    name: str = ""
    description: str = ""
    quantum: float = math.inf
    max_results: float = math.inf
    queries: list[dict] = field(default_factory=list)


class Engine:
    """SPARQL over the graphs of a store. ``compat`` takes a repeated variable in a pattern from its last place, without comparing."""

    def __init__(self, spark: SparkSession, store: Store | str, *, stateless: bool = True, compat: bool = False, cache: str | None = None, name: str = "dataset", public_url: str | None = None):
        self.spark, self.compat, self.name, self.public_url = spark, compat, name, public_url
        self.maintainer: str | None = None
        self.description = self.default_query = self.analytics = None
        self.store = Store(spark, store) if isinstance(store, str) else store
        self.info: dict[str, GraphInfo] = {}
        where = cache or f"{shared_dir(spark)}/results"
        self.pager = Pager(ResultCache(spark, where), self._pinned, stateless, TokenStore())

    # ---- queries

    def _graph(self, uri: str) -> None:
        if uri not in self.store.names():
            raise UnknownGraph(uri)

    def _planned(self, query: str, graph: str | None, snapshot: Snapshot) -> tuple[DataFrame, Planner]:
        q = parse_query(query)
        default = q.default or ((graph,) if graph and not q.named else ())
        planner = Planner(snapshot, default, q.named or None, self.compat)
        return planner.query(q), planner

    def query(self, query: str, graph: str | None = None, as_of: object | None = None) -> DataFrame:
        """The whole result, lazily: a column of term texts for each variable, null where unbound."""
        return self._planned(query, graph, Snapshot(self.store, as_of))[0]

    def explain(self, query: str, graph: str | None = None) -> list[dict]:
        """The patterns in the order in which they are joined, with their estimated numbers of triples."""
        return self._planned(query, graph, Snapshot(self.store))[1].cardinalities

    def _pinned(self, query: str, graph: str, versions: dict | None) -> tuple[DataFrame, dict, dict]:
        snapshot = Snapshot(self.store, versions=versions)
        df, planner = self._planned(query, graph, snapshot)
        return df, dict(snapshot.versions), {"cardinalities": planner.cardinalities}

    def page(self, query: str, graph: str, next: str | None = None, quantum: float | None = None, max_results: int | None = None) -> Page:
        """A page of a query's result; limits default to the graph's. An update runs whole and gives an empty last page."""
        self._graph(graph)
        info = self.info.get(graph, GraphInfo(graph))
        if next is None and is_update(query):
            self.update(query, graph)
            return Page([], None, [])
        quantum = info.quantum if quantum is None else quantum
        most = info.max_results if max_results is None else max_results
        return self.pager.page(query, graph, next, None if math.isinf(quantum) else quantum, None if math.isinf(most) else int(most))

    def iter_pages(self, query: str, graph: str, **limits) -> Iterator[Page]:
        """All pages in order."""
        token = None
        while True:
            page = self.page(query, graph, token, **limits)
            yield page
            token = page.next
            if token is None:
                return

    def page_frames(self, query: str, graph: str, max_results: int) -> Iterator[DataFrame]:
        """All pages in order, as DataFrames: no row passes through the driver."""
        self._graph(graph)
        return self.pager.frames(query, graph, max_results)

    def paged(self, query: str, graph: str, max_results: int) -> DataFrame:
        """All pages as one DataFrame, with the number of each row's page in the column ``page?``: for results of many pages."""
        self._graph(graph)
        return self.pager.paged(query, graph, max_results)

    # ---- updates

    def update(self, update: str, graph: str) -> dict[str, int]:
        """Run one update; the new versions of the graphs it changed."""
        return UpdateExecutor(self.store).run(parse_update(update), graph)

    def load(self, uri: str, triples: DataFrame, info: GraphInfo | None = None) -> StoredGraph:
        """Make the graph hold exactly these triples, with statistics."""
        g = self.store.create(uri).replace(triples)
        g.analyze()
        self.info[uri] = info or self.info.get(uri) or GraphInfo(uri, uri)
        return g

    # ---- descriptions

    def statistics(self, uri: str, approximate: bool = False) -> DataFrame:
        """One row: triples, and distinct subjects, predicates and objects."""
        self._graph(uri)
        distinct = F.approx_count_distinct if approximate else F.count_distinct
        return self.store.source(uri).scan().agg(F.count("*").alias("triples"), distinct("s").alias("subjects"), distinct("p").alias("predicates"), distinct("o").alias("objects"))

    def _facts(self, uri: str) -> tuple[GraphInfo, dict[str, int]]:
        return self.info.get(uri, GraphInfo(uri, uri)), self.statistics(uri).first().asDict()

    def describe(self, uri: str) -> list[tuple[str, str, str]]:
        """The graph's VoID description as triples; ``describe.written`` puts them into RDF formats."""
        return describe.graph_triples(uri, *self._facts(uri))

    def describe_all(self, endpoint: str) -> list[tuple[str, str, str]]:
        """The endpoint's service description, with all graphs."""
        graphs = [(uri, self.info.get(uri, GraphInfo(uri, uri)).name, self.describe(uri)) for uri in self.store.names()]
        return describe.service_triples(endpoint, self.name, self.maintainer, graphs)

    def json_ld(self, uri: str, url: str) -> dict:
        """The graph as a schema.org dataset."""
        return describe.schema_org(uri, url, *self._facts(uri))
