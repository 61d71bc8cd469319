"""Graphs with immutable snapshots on plain Parquet.

A graph is a folder. ``commits/N.json`` names version N: its time and the folder of its triples, either a whole base or
a delta of (s, p, o, op). A version exists once its commit file does, and creating that file fails if another writer has
made the same version, so commits are atomic and the second of two writers gets a conflict (on file systems that rename or
link without overwriting, such as HDFS and local disks). A change of several graphs is one transaction: each graph gets a
commit that names it, and the single file ``transactions/ID.json`` then makes all of them count or none. A commit of an
undecided transaction isn't seen; a writer that meets an old one decides against it. Reading version N takes the last base up to N and, by key,
the last operation of the deltas since. Bases are sorted by predicate, subject and object, so that scans with constants
skip row groups.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadToken, DeleteInsertConflict
from .base import SCHEMA, matching
from .files import Files

#: Deltas after which a commit writes a new base.
MOST_DELTAS = 8
#: Seconds that a transaction may stay undecided before another writer decides against it.
PATIENCE = 60.0
KEY = ["s", "p", "o"]


class StoredGraph:
    """One graph of a store at one version."""

    def __init__(self, store: Store, uri: str, version: int | None = None):
        self.store, self.uri = store, uri
        self.path = f"{store.root}/{hashlib.sha256(uri.encode()).hexdigest()[:24]}"
        self.log = store.commits(self.path)
        self.version = len(self.log) if version is None else version
        self._stats: dict[tuple, float] = {}
        self._analyzed: str | None = None

    # ---- reading

    def _parts(self) -> tuple[str | None, list[tuple[int, str]]]:
        """Folder of the base, and (version, folder) of the deltas since."""
        base, deltas = None, []
        for n, c in enumerate(self.log[: self.version], 1):
            if c["kind"] == "base":
                base, deltas = c["data"], []
            elif c["kind"] == "delta":  # else nothing came of it
                deltas.append((n, c["data"]))
        return base, deltas

    def scan(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        spark, where = self.store.spark, matching(s, p, o)
        base, deltas = self._parts()
        rows = spark.read.schema(SCHEMA).parquet(f"{self.path}/{base}").where(where) if base else spark.createDataFrame([], SCHEMA)
        if not deltas:
            return rows
        ops = None
        for n, folder in deltas:
            d = spark.read.schema(f"{SCHEMA}, op string").parquet(f"{self.path}/{folder}").where(where).withColumn("v", F.lit(n))
            ops = d if ops is None else ops.unionByName(d)
        last = ops.groupBy(*KEY).agg(F.max_by("op", "v").alias("op"))
        return rows.join(last, KEY, "left_anti").unionByName(last.where("op = '+'").select(*KEY))

    def as_of(self, when: dt.datetime | float | int) -> StoredGraph:
        """The graph at a version number, or as it was at a time."""
        if isinstance(when, int):
            return StoredGraph(self.store, self.uri, min(when, len(self.log)))
        t = when.timestamp() if isinstance(when, dt.datetime) else when
        return StoredGraph(self.store, self.uri, sum(c["t"] <= t for c in self.log))

    # ---- statistics

    def statistics(self) -> DataFrame:
        """p, triples, subjects, objects for each predicate; exact, so a snapshot's may be kept."""
        return self.scan().groupBy("p").agg(F.count("*").alias("triples"), F.count_distinct("s").alias("subjects"), F.count_distinct("o").alias("objects"))

    def analyze(self) -> None:
        """Compute and keep this version's statistics (a row for each predicate)."""
        self.statistics().coalesce(1).write.mode("overwrite").parquet(f"{self.path}/stats/{self.version}")
        self._stats, self._analyzed = {}, None

    def _statistics(self) -> DataFrame | None:
        """Statistics of the nearest analyzed version up to this one: they guide the order of joins."""
        if self._analyzed is None:
            have = [int(x) for x in self.store.files.listing(f"{self.path}/stats") if x.isdigit() and int(x) <= self.version]
            self._analyzed = f"{self.path}/stats/{max(have)}" if have else ""
        return self.store.spark.read.parquet(self._analyzed) if self._analyzed else None

    def prepare(self, predicates: Iterable[str]) -> None:
        """Look up the statistics of these predicates at once; None stands for all of them together."""
        wanted = [p for p in dict.fromkeys(predicates) if (p, False, False) not in self._stats]
        table = self._statistics() if wanted else None
        if table is None:
            return
        # expected triples with subject and object free or bound, values spread evenly within a predicate
        forms = {(s, o): F.col("triples") / (F.col("subjects") if s else F.lit(1)) / (F.col("objects") if o else F.lit(1)) for s in (False, True) for o in (False, True)}
        named = [p for p in wanted if p is not None]
        rows = [(r["p"], r) for r in table.where(F.col("p").isin(named)).select("p", *(f.alias(f"{s}{o}") for (s, o), f in forms.items())).collect()] if named else []
        if None in wanted:
            rows.append((None, table.agg(*(F.sum(f).alias(f"{s}{o}") for (s, o), f in forms.items())).first()))
        found = dict(rows)
        for p in wanted:
            for s, o in forms:
                self._stats[p, s, o] = (found[p][f"{s}{o}"] or 0.0) if p in found else 0.0

    def estimate(self, s: str | None = None, p: str | None = None, o: str | None = None) -> float:
        """Expected triples."""
        self.prepare([p])
        known = self._stats.get((p, s is not None, o is not None))
        if known is None:
            from .base import shape_rank

            return float(10 ** shape_rank(s, p, o))
        return max(known, 1.0) if known else 0.0

    # ---- writing

    def _commit(self, df: DataFrame, kind: str, transaction: str | None = None) -> StoredGraph:
        data = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{data}")
        n = self.version + 1
        entry = {"t": dt.datetime.now(dt.timezone.utc).timestamp(), "kind": kind, "data": data} | ({"transaction": transaction} if transaction else {})
        if not self.store.files.create(f"{self.path}/commits/{n:012d}.json", json.dumps(entry)):
            self.store.settle(f"{self.path}/commits/{n:012d}.json")
            self.store.files.delete(f"{self.path}/{data}")
            raise DeleteInsertConflict(f"version {n} of {self.uri} was committed by another writer")
        return StoredGraph(self.store, self.uri, None if transaction is None else n)

    def replace(self, triples: DataFrame) -> StoredGraph:
        """A new version that holds exactly these triples."""
        return self._commit(triples.select(*KEY).dropDuplicates().repartitionByRange("p", "s", "o").sortWithinPartitions("p", "s", "o"), "base")

    @staticmethod
    def _changes(delete: DataFrame | None, insert: DataFrame | None) -> DataFrame | None:
        parts = [df.select(*KEY, F.lit(op).alias("op")) for df, op in ((delete, "-"), (insert, "+")) if df is not None]
        ops = parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else None
        return None if ops is None else ops.groupBy(*KEY).agg(F.min("op").alias("op"))  # '+' sorts before '-': insertions come last

    def apply(self, delete: DataFrame | None, insert: DataFrame | None) -> StoredGraph:
        """A new version: first all deletions, then all insertions. Absent triples are not deleted, present ones not added again."""
        ops = self._changes(delete, insert)
        return self if ops is None else self._commit(ops, "delta").compacted()

    def compacted(self) -> StoredGraph:
        """This version, with its deltas folded into a base if they are many. If another writer is faster, that is left to it."""
        if len(self._parts()[1]) <= MOST_DELTAS:
            return self
        try:
            return self.compact()
        except DeleteInsertConflict:
            return self

    def compact(self) -> StoredGraph:
        """The same triples as one base."""
        return self.replace(self.scan())


class Store:
    """A folder of graphs, the catalog of the planner. Graphs that other sources hold can be attached."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self.attached: dict[str, object] = {}
        self.attached_versions: dict[str, str] = {}
        self._texts: dict[str, str] = {}  # commits and names never change once written

    def _text(self, path: str) -> str:
        if path not in self._texts:
            self._texts[path] = self.files.read(path)
        return self._texts[path]

    def commits(self, path: str) -> list[dict]:
        """A graph's decided commits in order; those of transactions that failed changed nothing."""
        out = []
        for name in sorted(x for x in self.files.listing(f"{path}/commits") if x.endswith(".json")):
            c = json.loads(self._text(f"{path}/commits/{name}"))
            if "transaction" in c:
                decision = self._decision(c["transaction"])
                if decision is None:
                    break
                c = c if decision else {**c, "kind": "nothing"}
            out.append(c)
        return out

    # ---- transactions

    def _decision(self, transaction: str) -> bool | None:
        path = f"{self.root}/transactions/{transaction}.json"
        return json.loads(self._text(path)) if path in self._texts or self.files.exists(path) else None

    def decide(self, transaction: str, done: bool) -> bool:
        """Whether the transaction counts: as asked for, or as another writer decided before."""
        self.files.create(f"{self.root}/transactions/{transaction}.json", json.dumps(done))
        return bool(self._decision(transaction))

    def settle(self, commit: str) -> None:
        """Decide against the transaction of a commit that is in the way, once it is old."""
        c = json.loads(self._text(commit))
        if "transaction" in c and self._decision(c["transaction"]) is None and dt.datetime.now(dt.timezone.utc).timestamp() - c["t"] > PATIENCE:
            self.decide(c["transaction"], False)

    def apply_all(self, changes: dict[StoredGraph, tuple[DataFrame | None, DataFrame | None]]) -> dict[str, int]:
        """Apply deletions and insertions to several graphs, to all or to none; the new versions by uri."""
        parts = [(g, StoredGraph._changes(*x)) for g, x in changes.items()]
        parts = [(g, x) for g, x in parts if x is not None]
        if len(parts) < 2:
            return {g.uri: g._commit(x, "delta").compacted().version for g, x in parts}
        transaction = uuid.uuid4().hex
        try:
            for g, x in parts:
                g._commit(x, "delta", transaction)
        except BaseException:
            self.decide(transaction, False)
            raise
        if not self.decide(transaction, True):
            raise DeleteInsertConflict("another writer decided against a transaction that took too long")
        return {g.uri: StoredGraph(self, g.uri).compacted().version for g, _ in parts}

    def create(self, uri: str) -> StoredGraph:
        g = StoredGraph(self, uri)
        if not self.files.exists(f"{g.path}/uri"):
            self.files.create(f"{g.path}/uri", uri)
        return g

    def attach(self, uri: str, source: object, version: str | None = None) -> None:
        """Serve another source's triples as a graph. Its content counts as unchanged as long as ``version`` is the same; without one, until it is attached anew."""
        self.attached[uri] = source
        self.attached_versions[uri] = version or uuid.uuid4().hex

    def stored(self) -> list[str]:
        return [self._text(f"{self.root}/{x}/uri").strip() for x in sorted(self.files.listing(self.root)) if self.files.exists(f"{self.root}/{x}/uri")]

    def names(self) -> list[str]:
        return [*self.attached, *self.stored()]

    def source(self, uri: str):
        if uri in self.attached:
            return self.attached[uri]
        g = StoredGraph(self, uri)
        return g if self.files.exists(f"{g.path}/uri") else None


class Snapshot:
    """A store with every graph pinned to the version it has now (or at a time): all scans of a request see the same triples."""

    def __init__(self, store, as_of: dt.datetime | float | None = None, versions: dict[str, int | str] | None = None):
        self.store, self.spark, self.as_of = store, store.spark, as_of
        self.versions = dict(versions or {})
        self._open: dict[str, object] = {}

    def names(self) -> list[str]:
        return self.store.names()

    def source(self, uri: str):
        if uri not in self._open:
            g = self.store.source(uri)
            if isinstance(g, StoredGraph):
                g = StoredGraph(g.store, uri, self.versions[uri]) if uri in self.versions else g.as_of(self.as_of) if self.as_of is not None else g
                self.versions[uri] = g.version
            elif uri in self.store.attached:
                now = self.store.attached_versions[uri]
                if self.versions.setdefault(uri, now) != now:
                    raise BadToken(f"{uri} was attached anew since the first page")
            self._open[uri] = g
        return self._open[uri]
