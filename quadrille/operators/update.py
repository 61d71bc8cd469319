"""Updates: INSERT DATA, DELETE DATA and DELETE/INSERT ... WHERE, each one new version of every graph it touches."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DeleteInsertConflict, UnsupportedSPARQL
from ..plans.algebra import DeleteData, InsertData, Modify, Quad
from ..plans.planner import Planner
from ..sources.store import Snapshot, Store, StoredGraph

QUADS = "s string, p string, o string, g string"


def as_frame(spark: SparkSession, quads: tuple[Quad, ...], default: str) -> DataFrame:
    return spark.createDataFrame([(s, p, o, g or default) for s, p, o, g in quads], QUADS)


def apply_templates(mappings: DataFrame, templates: tuple[Quad, ...], default: str) -> DataFrame:
    """Distinct quads: every template with the variables of every mapping put in; those that stay incomplete are left out."""
    spark = mappings.sparkSession

    def cell(x: str) -> object:
        if not x.startswith("?"):
            return F.lit(x)
        return F.col(x[1:]) if x[1:] in mappings.columns else F.lit(None).cast("string")

    parts = [mappings.select(cell(s).alias("s"), cell(p).alias("p"), cell(o).alias("o"), cell(g or default).alias("g")) for s, p, o, g in templates]
    if not parts:
        return spark.createDataFrame([], QUADS)
    out = functools.reduce(DataFrame.unionByName, parts).na.drop()
    # a subject can't be a literal, a predicate only an IRI
    return out.where(~F.col("s").startswith('"') & ~F.col("p").startswith('"') & ~F.col("p").startswith("_:")).dropDuplicates()


def missing(catalog, quads: DataFrame) -> DataFrame:
    """The quads that their graphs don't have; a graph that doesn't exist has none."""
    out = []
    for uri in catalog.names():
        source = catalog.source(uri)
        here = quads.where(F.col("g") == uri)
        out.append(here.join(source.scan(), ["s", "p", "o"], "left_anti").select("s", "p", "o", "g"))
    known = catalog.names()
    out.append(quads.where(~F.col("g").isin(known)) if known else quads)
    return functools.reduce(DataFrame.unionByName, out)


class UpdateExecutor:
    """Runs updates on a store's graphs. Quads of unknown graphs are skipped, attached graphs are read-only."""

    def __init__(self, store: Store):
        self.store = store

    def _graphs(self, snapshot: Snapshot) -> dict[str, StoredGraph]:
        return {u: snapshot.source(u) for u in self.store.stored()}

    def commit(self, snapshot: Snapshot, delete: DataFrame | None, insert: DataFrame | None) -> dict[str, int]:
        """New versions (uri -> version) of the stored graphs that the quads name: deletions first, then insertions."""
        frames = [x for x in (delete, insert) if x is not None]
        if not frames:
            return {}
        graphs = self._graphs(snapshot)
        named = {r["g"] for r in functools.reduce(DataFrame.unionByName, [f.select("g") for f in frames]).distinct().where(F.col("g").isin(list(graphs))).collect()}
        return self.store.apply_all({graphs[uri]: tuple(None if f is None else f.where(F.col("g") == uri) for f in (delete, insert)) for uri in sorted(named)})

    def if_exists(self, snapshot: Snapshot, quads: DataFrame) -> None:
        """Nothing if all quads are there, else DeleteInsertConflict."""
        if not missing(snapshot, quads).isEmpty():
            raise DeleteInsertConflict("quads to delete are missing")

    def sequence(self, expected: tuple[Quad, ...], delete: tuple[Quad, ...], insert: tuple[Quad, ...], default: str) -> dict[str, int]:
        """IF EXISTS, then DELETE, then INSERT, as one commit on the snapshot that was checked."""
        spark, snapshot = self.store.spark, Snapshot(self.store)
        self.if_exists(snapshot, as_frame(spark, expected, default))
        return self.commit(snapshot, as_frame(spark, delete, default), as_frame(spark, insert, default))

    def run(self, update: InsertData | DeleteData | Modify, default: str) -> dict[str, int]:
        spark, snapshot = self.store.spark, Snapshot(self.store)
        if isinstance(update, InsertData):
            return self.commit(snapshot, None, as_frame(spark, update.quads, default))
        if isinstance(update, DeleteData):
            return self.commit(snapshot, as_frame(spark, update.quads, default), None)
        if isinstance(update, Modify):
            # all mappings come from the old snapshot, whatever is written; they are computed and written once, so that
            # RAND(), UUID() and NOW() give deletions, insertions and all graphs the same values
            planner = Planner(snapshot, update.default or (default,), update.named or None)
            mappings = planner.plan(update.where).df
            used = {x[1:] for quad in (*update.delete, *update.insert) for x in quad if x is not None and x.startswith("?")}
            kept = [c for c in mappings.columns if c in used]
            where = f"{self.store.root}/mappings/{uuid.uuid4().hex}"
            # numbered names, as a variable's may differ from another's by case only
            mappings.select(*(F.col(c).alias(f"v{i}") for i, c in enumerate(kept)), F.lit(1).alias("one")).write.parquet(where)
            try:
                written = spark.read.parquet(where)
                written = written.select(*(F.col(f"v{i}").alias(c) for i, c in enumerate(kept))) if kept else written.select("one")
                delete = apply_templates(written, update.delete, default) if update.delete else None
                insert = apply_templates(written, update.insert, default) if update.insert else None
                return self.commit(snapshot, delete, insert)
            finally:
                self.store.files.delete(where)
        raise UnsupportedSPARQL(type(update).__name__)
