"""From algebra to DataFrames: pattern order, joins, unions, filters and projection.

Columns are variables; a null is unbound. Joins are equi-joins. Where a shared variable is bound in some rows only (of
a union), both sides are split by which of these variables a row binds, and each pair of parts has an equi-join over what
both bind; the optimizer drops the branches of a union that can't be in a part.
"""

from __future__ import annotations

import functools
import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UnsupportedSPARQL
from ..functions.expressions import condition, uses
from .algebra import BGP, Call, Filter, Graph, Join, Pattern, Query, Union, variables_of, visible

#: A conjunction with so many uses of variables is split into filters.
MOST_SPLIT = 6
#: Rows that a task of a join should make.
MADE = 10_000_000


@dataclass
class Rows:
    """Solution mappings: the DataFrame, the variables that every row binds, and sets of variables whose values few rows
    share (none: nothing is known). These only guide plans: a predicate is taken to have few values for a subject."""

    df: DataFrame
    always: frozenset[str]
    keys: tuple[frozenset[str], ...] = ()


class Planner:
    """``catalog`` gives the sources: ``catalog.source(uri)`` (None if unknown), ``catalog.names()``, ``catalog.spark``."""

    def __init__(self, catalog, default: tuple[str, ...], named: tuple[str, ...] | None = None, compat: bool = False):
        self.catalog, self.default, self.named, self.compat = catalog, default, named, compat
        self.cardinalities: list[dict] = []

    # ---- scans

    def graph_names(self) -> list[str]:
        return [n for n in self.catalog.names() if self.named is None or n in self.named]

    def triples(self, graph: str | None, s: str | None, p: str | None, o: str | None) -> DataFrame:
        """Triples of a graph, or of the merge of the default graphs."""
        uris = self.default if graph is None else (graph,) if graph in self.graph_names() else ()
        sources = [x for x in (self.catalog.source(u) for u in uris) if x is not None]
        if not sources:
            return self.catalog.spark.createDataFrame([], "s string, p string, o string")
        parts = [x.scan(s, p, o) for x in sources]
        df = functools.reduce(DataFrame.unionByName, parts)
        return df if len(parts) == 1 else df.dropDuplicates(["s", "p", "o"])  # a merge is a set again

    def estimate(self, graph: str | None, pattern: Pattern) -> float:
        bound = [None if x.startswith("?") else x for x in (pattern.s, pattern.p, pattern.o)]
        uris = self.default if graph is None else self.graph_names() if graph.startswith("?") else (graph,)
        return sum(x.estimate(*bound) for x in (self.catalog.source(u) for u in uris) if x is not None)

    def scan(self, graph: str | None, pattern: Pattern) -> Rows:
        bound = [None if x.startswith("?") else x for x in (pattern.s, pattern.p, pattern.o)]
        if graph is not None and graph.startswith("?"):
            parts = [self.triples(g, *bound).withColumn("g", F.lit(g)) for g in self.graph_names()]
            df = functools.reduce(DataFrame.unionByName, parts) if parts else self.triples(None, *bound).withColumn("g", F.lit("")).limit(0)
            places = [*zip("spo", (pattern.s, pattern.p, pattern.o), strict=True), ("g", graph)]
        else:
            df = self.triples(graph, *bound)
            places = list(zip("spo", (pattern.s, pattern.p, pattern.o), strict=True))
        where: dict[str, str] = {}
        for column, x in places:
            if x.startswith("?"):
                if x[1:] in where and not self.compat:
                    df = df.where(F.col(column) == F.col(where[x[1:]]))
                    continue
                where[x[1:]] = column  # with compat the last position wins and nothing is compared
        out = df.select(*(F.col(c).alias(v) for v, c in where.items())) if where else df.select(F.lit(1).alias("?")).drop("?")
        names = frozenset({x[1:] for x in (pattern.s, graph or "") if x.startswith("?")})
        return Rows(out, frozenset(where), (frozenset(where),) if pattern.p.startswith("?") else (names, frozenset(where)))

    # ---- joins

    def unit(self) -> Rows:
        """One mapping that binds nothing."""
        return Rows(self.catalog.spark.range(1).drop("id"), frozenset(), (frozenset(),))

    def dealt(self, left: DataFrame, right: DataFrame, shared: list[str]) -> DataFrame:
        """An equi-join of which each row may have many partners on the other side. If it makes many rows, tasks get even
        parts of them: a key with many pairs is cut into cells, by the left rows' hashes and the right rows' hashes, and
        each row goes to all cells that it takes part in."""
        counted = [df.groupBy(*shared).agg(F.count("*").cast("double").alias(n)) for df, n in ((left, "l?"), (right, "r?"))]
        pairs = counted[0].join(counted[1], shared).withColumn("n?", F.col("l?") * F.col("r?"))
        made = pairs.agg(F.sum("n?")).first()[0] or 0.0
        if made <= MADE:
            return left.join(right, shared)
        cells = F.ceil(F.col("n?") / (MADE / 8))  # a task has several, which evens them out
        across = F.least(cells, F.greatest(F.round(F.sqrt(cells * F.col("l?") / F.col("r?"))), F.lit(1))).cast("long")
        large = F.broadcast(pairs.where(F.col("n?") > MADE / 8).select(*shared, across.alias("l?"), F.ceil(cells / across).alias("r?")))
        n = max(math.ceil(made / MADE), int(self.catalog.spark.conf.get("spark.sql.shuffle.partitions")))  # with fewer Spark would deal anew
        sides = []
        for df, own, other in ((left, "l?", "r?"), (right, "r?", "l?")):
            here = F.pmod(F.xxhash64(*df.columns), F.coalesce(own, F.lit(1)))
            there = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1)).cast("long") - 1))
            cut = df.join(large, shared, "left").select(*df.columns, here.cast("long").alias(f"{own}cell"), there.alias(f"{other}cell"))
            sides.append(cut.repartition(n, *shared, "l?cell", "r?cell"))
        return sides[0].join(sides[1].hint("merge"), [*shared, "l?cell", "r?cell"]).drop("l?cell", "r?cell")

    def join(self, left: Rows, right: Rows) -> Rows:
        shared = [c for c in left.df.columns if c in right.df.columns]
        sure = [c for c in shared if c in left.always and c in right.always]
        one, other = (any(k <= frozenset(shared) for k in x.keys) for x in (left, right))  # whether a side has few rows for a row of the other
        keys = (left.keys if other else ()) + (right.keys if one else ()) or tuple(k | m for k in left.keys for m in right.keys)
        if not shared:
            return Rows(left.df.crossJoin(right.df), left.always | right.always, keys)
        if len(sure) == len(shared):
            many = left.keys and right.keys and not one and not other
            return Rows(self.dealt(left.df, right.df, shared) if many else left.df.join(right.df, shared), left.always | right.always, keys)
        parts = []
        for mask in itertools.product(*([True] if c in left.always else [True, False] for c in shared)):
            for other in itertools.product(*([True] if c in right.always else [True, False] for c in shared)):
                l, r = left.df, right.df  # rows that bind just these of the shared variables
                for c, here, there in zip(shared, mask, other, strict=True):
                    l = l.where(F.col(c).isNotNull() if here else F.col(c).isNull()) if c not in left.always else l
                    r = r.where(F.col(c).isNotNull() if there else F.col(c).isNull()) if c not in right.always else r
                keys = [c for c, here, there in zip(shared, mask, other, strict=True) if here and there]
                l = l.drop(*(c for c, here, there in zip(shared, mask, other, strict=True) if there and not here))
                r = r.drop(*(c for c, there in zip(shared, other, strict=True) if not there))
                r = r.select(*(c for c in r.columns if c in keys or c not in l.columns))
                parts.append(l.join(r, keys) if keys else l.crossJoin(r))
        columns = list(dict.fromkeys([*left.df.columns, *right.df.columns]))
        whole = functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
        return Rows(whole.select(*columns), left.always | right.always)

    def stars(self, patterns: list[tuple[str | None, Pattern]]) -> list[tuple[str | None, tuple[Pattern, ...]]]:
        """Patterns in groups that one scan answers: those with one subject whose predicates a source keeps in one row."""
        groups: dict[object, list[Pattern]] = {}
        for i, (g, p) in enumerate(patterns):
            key: object = i
            uris = self.default if g is None else () if g.startswith("?") or g not in self.graph_names() else (g,)
            sources = [x for x in (self.catalog.source(u) for u in uris) if x is not None]
            if len(sources) == 1 and hasattr(sources[0], "row_of") and not p.p.startswith("?") and not self.compat:
                row = sources[0].row_of(p.p)
                key = i if row is None else (g, p.s, row)
            groups.setdefault((g, key), []).append(p)
        return [(g, tuple(ps)) for (g, _), ps in groups.items()]

    def star(self, graph: str | None, patterns: tuple[Pattern, ...]) -> Rows:
        source = self.catalog.source(self.default[0] if graph is None else graph)
        s = patterns[0].s
        df = source.star(None if s.startswith("?") else s, [(p.p, None if p.o.startswith("?") else p.o) for p in patterns])
        where: dict[str, str] = {}
        for column, x in (("s", s), *((f"o{i}", p.o) for i, p in enumerate(patterns))):
            if x.startswith("?"):
                if x[1:] in where:
                    df = df.where(F.col(column) == F.col(where[x[1:]]))
                where.setdefault(x[1:], column)
        out = df.select(*(F.col(c).alias(v) for v, c in where.items())) if where else df.select(F.lit(1).alias("?")).drop("?")
        return Rows(out, frozenset(where), (frozenset([s[1:]] if s.startswith("?") else []), frozenset(where)))

    def order(self, patterns: list[tuple[str | None, Pattern]]) -> list[tuple[str | None, tuple[Pattern, ...]]]:
        """Fewest triples first, then always the smallest group that shares a variable with those before."""
        sized = []
        for g in {g for g, _ in patterns}:
            uris = self.default if g is None else self.graph_names() if g.startswith("?") else (g,)
            for source in (self.catalog.source(u) for u in uris):
                if hasattr(source, "prepare"):  # one look-up for all patterns
                    source.prepare(None if p.p.startswith("?") else p.p for h, p in patterns if h == g)
        for g, ps in self.stars(patterns):
            numbers = [self.estimate(g, p) for p in ps]
            sized.append((min(numbers), len(sized), g, ps))
            self.cardinalities += [{"pattern": {"subject": p.s, "predicate": p.p, "object": p.o, "graph": g}, "cardinality": n} for p, n in zip(ps, numbers, strict=True)]
        rest, out, seen = sorted(sized, key=lambda x: x[:2]), [], set()
        while rest:
            pick = next((x for x in rest if not out or seen & self._names(x[2], x[3])), rest[0])
            rest.remove(pick)
            out.append((pick[2], pick[3]))
            seen |= self._names(pick[2], pick[3])
        return out

    @staticmethod
    def _names(graph: str | None, ps: tuple[Pattern, ...]) -> set[str]:
        return {v for p in ps for v in p.variables} | ({graph[1:]} if graph and graph.startswith("?") else set())

    def bgp(self, patterns: list[tuple[str | None, Pattern]]) -> Rows:
        rows = None
        for g, ps in self.order(patterns):
            scanned = self.scan(g, ps[0]) if len(ps) == 1 else self.star(g, ps)
            rows = scanned if rows is None else self.join(rows, scanned)
        return rows or self.unit()

    # ---- plans

    def flatten(self, node: object, graph: str | None) -> list[tuple[str | None, Pattern]] | None:
        """The patterns of a plan that is only basic graph patterns and GRAPHs of them, joined; else None."""
        if isinstance(node, BGP):
            return [(graph, p) for p in node.patterns]
        if isinstance(node, Graph):
            return self.flatten(node.child, node.name) if not (isinstance(node.child, BGP) and not node.child.patterns) else None
        if isinstance(node, Join):
            left, right = self.flatten(node.left, graph), self.flatten(node.right, graph)
            return None if left is None or right is None else left + right
        return None

    def plan(self, node: object, graph: str | None = None) -> Rows:
        patterns = self.flatten(node, graph)
        if patterns is not None:
            return self.bgp(patterns)
        if isinstance(node, Graph):
            if node.name.startswith("?") and isinstance(node.child, BGP):  # GRAPH ?g {}: every graph
                names = self.graph_names()
                return Rows(self.catalog.spark.createDataFrame([(n,) for n in names], f"`{node.name[1:]}` string"), frozenset([node.name[1:]]))
            if isinstance(node.child, BGP):  # GRAPH <iri> {}: one mapping if there is such a graph
                return self.unit() if node.name in self.graph_names() else Rows(self.unit().df.limit(0), frozenset())
            return self.plan(node.child, node.name)
        if isinstance(node, Union):
            left, right = self.plan(node.left, graph), self.plan(node.right, graph)
            return Rows(left.df.unionByName(right.df, allowMissingColumns=True), left.always & right.always)
        if isinstance(node, Join):
            return self.join(self.plan(node.left, graph), self.plan(node.right, graph))
        if isinstance(node, Filter):
            rows = self.plan(node.child, graph)
            return self.filtered(rows, node.condition, graph)
        raise UnsupportedSPARQL(type(node).__name__)

    def existing(self, node: object, graph: str | None, wanted: frozenset[str], outer: Rows | None = None) -> Rows:
        """The wanted variables' values in a plan's solutions, however many solutions have them: patterns that share all
        they tell with another one become semi joins, and values that no later step needs go as soon as they can.
        What is left over of a cycle starts from ``outer``, the rows that the values are wanted for."""
        patterns = self.flatten(node, graph)
        if isinstance(node, Union):
            left, right = (self.existing(x, graph, wanted) for x in (node.left, node.right))
            return Rows(left.df.unionByName(right.df, allowMissingColumns=True), left.always & right.always)
        if not patterns:
            return self.plan(node, graph)
        edges = [self.scan(g, ps[0]) if len(ps) == 1 else self.star(g, ps) for g, ps in self.order(patterns)]

        def needed(i: int) -> list[str]:
            others = wanted.union(*(x.df.columns for j, x in enumerate(edges) if j != i))
            return [c for c in edges[i].df.columns if c in others]

        def reduce() -> None:
            while pair := next(((i, j) for i in range(len(edges)) for j in range(len(edges)) if i != j and not (outer is not None and edges[i] is outer) and set(needed(i)) <= set(edges[j].df.columns)), None):
                i, j = pair
                names, into = needed(i), edges[j]
                if names:
                    df = into.df.join(edges[i].df.select(*names).distinct(), names, "left_semi")
                else:
                    df = into.df.crossJoin(edges[i].df.limit(1).select(F.lit(1).alias("?"))).drop("?")
                edges[j] = Rows(df, into.always, into.keys)
                edges.pop(i)

        reduce()
        if len(edges) > 1 and outer is not None:
            some = [c for c in outer.df.columns if c in wanted and any(c in x.df.columns for x in edges)]
            if some and all(c in outer.always for c in some):
                outer = Rows(outer.df.select(*some).distinct(), frozenset(some), (frozenset(some),))
                edges.insert(0, outer)
        while len(edges) > 1:
            at = next((i for i in range(1, len(edges)) if set(edges[i].df.columns) & set(edges[0].df.columns)), 1)
            parts = []
            for i in (0, at):
                names = needed(i)
                parts.append(Rows(edges[i].df.select(*names).distinct(), frozenset(names), tuple(k for k in edges[i].keys if k <= set(names)) or (frozenset(names),)))
            edges.pop(at)
            edges[0] = self.join(*parts)
            reduce()
        return edges[0]

    def filtered(self, rows: Rows, test: object, graph: str | None) -> Rows:
        """Rows whose condition is true. EXISTS becomes a column that a semi join fills."""
        columns = rows.df.columns

        state = {"df": rows.df, "n": 0}

        def exists(pattern: object) -> Column:
            inner = self.existing(pattern, graph, frozenset(columns), rows)
            shared = [c for c in inner.df.columns if c in rows.df.columns]
            flag = f"exists?{state['n']}"
            state["n"] += 1
            if not shared:
                n = inner.df.limit(1).agg((F.count("*") > 0).alias(flag))  # one row
                state["df"] = state["df"].crossJoin(n)
            elif all(c in rows.always and c in inner.always for c in shared):
                state["df"] = state["df"].join(inner.df.select(*shared).distinct().withColumn(flag, F.lit(True)), shared, "left")
            else:
                raise UnsupportedSPARQL("EXISTS over variables that may be unbound")
            return F.coalesce(F.col(flag), F.lit(False))

        parts, tests = [test], []
        small = len(uses(test)) <= MOST_SPLIT
        while parts:  # the parts of a conjunction are filters of their own, unless they would take the same terms apart often
            x = parts.pop()
            if small and isinstance(x, Call) and x.name == "&&":
                parts += reversed(x.args)
            else:
                tests.append(condition(x, {c: F.col(c) for c in columns}, exists))
        df = state["df"]
        for kept in tests:
            df = df.where(kept)
        return Rows(df.select(columns), rows.always)

    def query(self, q: Query) -> DataFrame:
        rows = self.plan(q.where)
        names = list(q.variables) if q.variables is not None else visible(list(dict.fromkeys([*variables_of(q.where)])))
        return rows.df.select(*(F.col(n) if n in rows.df.columns else F.lit(None).cast("string").alias(n) for n in names))
