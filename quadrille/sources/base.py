"""What the planner asks of a source of triples, and the registry of kinds of sources."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "s string, p string, o string"


class TripleSource(Protocol):
    """A set of triples (s, p, o): a graph."""

    def scan(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        """The triples with the given terms, as distinct rows (s, p, o)."""

    def estimate(self, s: str | None = None, p: str | None = None, o: str | None = None) -> float:
        """About how many triples a scan gives."""


def matching(s: str | None, p: str | None, o: str | None) -> Column:
    """The filter of an access path: an equality for each bound position, which reaches the Parquet reader."""
    out = F.lit(True)
    for name, term in (("s", s), ("p", p), ("o", o)):
        if term is not None:
            out = out & (F.col(name) == term)
    return out


def shape_rank(s: str | None, p: str | None, o: str | None) -> int:
    """The usual order of access paths by selectivity, for sources without statistics: 1 for spo up to 8 for ???."""
    kind = "".join(c if x is not None else "?" for c, x in zip("spo", (s, p, o), strict=True))
    return ["spo", "s?o", "?po", "sp?", "??o", "s??", "?p?", "???"].index(kind) + 1


class FrameSource:
    """A graph held as a DataFrame (s, p, o); rows may repeat unless ``distinct``."""

    def __init__(self, df: DataFrame, distinct: bool = False):
        self.df = df if distinct else df.dropDuplicates(["s", "p", "o"])

    def scan(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        return self.df.where(matching(s, p, o)).select("s", "p", "o")

    def estimate(self, s: str | None = None, p: str | None = None, o: str | None = None) -> float:
        return float(10 ** shape_rank(s, p, o))


class VersionedSource:
    """Triples with validity columns insert_t and delete_t (null: still valid), as of a time."""

    def __init__(self, df: DataFrame, as_of: object | None = None):
        at = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
        self.df = df.where((F.col("insert_t") <= at) & (F.col("delete_t").isNull() | (at < F.col("delete_t")))).select("s", "p", "o").dropDuplicates()

    scan, estimate = FrameSource.scan, FrameSource.estimate


class MvccGraph:
    """A graph as a log of timed insertions and deletions, which keeps every state that it ever had.

    Rows (s, p, o, op, t) are only ever appended. A triple is valid from an insertion to the next deletion of the same
    triple; insertions of what is valid and deletions of what isn't change nothing. At one time, insertions come last.
    """

    LOG = f"{SCHEMA}, op string, t timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, triples: DataFrame, op: str, at: object | None) -> None:
        t = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
        triples.select("s", "p", "o", F.lit(op).alias("op"), t.alias("t")).dropDuplicates(["s", "p", "o"]).write.mode("append").parquet(self.path)

    def insert(self, triples: DataFrame, at: object | None = None) -> None:
        self._append(triples, "+", at)

    def delete(self, triples: DataFrame, at: object | None = None) -> None:
        self._append(triples, "-", at)

    def log(self) -> DataFrame:
        return self.spark.read.schema(self.LOG).parquet(self.path)

    def intervals(self) -> DataFrame:
        """s, p, o, insert_t, delete_t (null: still valid): one row for each time a triple was valid without a break."""
        by = Window.partitionBy("s", "p", "o").orderBy("t")
        # one operation for each triple and time, then only those that change its state
        ops = self.log().groupBy("s", "p", "o", "t").agg(F.min("op").alias("op"))
        ops = ops.withColumn("before", F.lag("op", 1, "-").over(by)).where("op <> before")
        return ops.withColumn("delete_t", F.lead("t").over(by)).where("op = '+'").select("s", "p", "o", F.col("t").alias("insert_t"), "delete_t")

    def as_of(self, at: object) -> FrameSource:
        """The state at a time: each triple's last operation up to then, found without a window."""
        return FrameSource(self._state(F.lit(at).cast("timestamp")), distinct=True)

    def _state(self, at: Column, where: Column | None = None) -> DataFrame:
        rows = self.log() if where is None else self.log().where(where)
        last = rows.where(F.col("t") <= at).groupBy("s", "p", "o").agg(F.max(F.struct("t", (F.col("op") == "+").alias("in")))["in"].alias("in"))
        return last.where("in").select("s", "p", "o")

    def scan(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        return self._state(F.current_timestamp(), matching(s, p, o))

    estimate = FrameSource.estimate


class DictionarySource:
    """Triples of ids with a dictionary (id, value): constants are looked up first, results are decoded by three joins."""

    def __init__(self, triples: DataFrame, dictionary: DataFrame):
        self.triples, self.dictionary = triples, dictionary

    @staticmethod
    def encode(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(triples of ids, dictionary). Ids are 64-bit hashes, checked to name one value each."""
        ids = triples.select(*(F.xxhash64(c).alias(c) for c in "spo"))
        values = triples.select(F.explode(F.array("s", "p", "o")).alias("value")).distinct().select(F.xxhash64("value").alias("id"), "value")
        if not values.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            raise ValueError("two terms share a hash: use another seed")
        return ids.distinct(), values

    def scan(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        out = self.triples
        for name, term in (("s", s), ("p", p), ("o", o)):
            if term is not None:  # an unknown term has an id that no triple has
                out = out.where(F.col(name) == F.xxhash64(F.lit(term)))
        for name, term in (("s", s), ("p", p), ("o", o)):
            if term is not None:
                out = out.withColumn(name, F.lit(term))
            else:
                names = self.dictionary.select(F.col("id").alias(name), F.col("value").alias(f"{name}_"))
                out = out.join(names, name).drop(name).withColumnRenamed(f"{name}_", name)
        return out.select("s", "p", "o")

    def estimate(self, s: str | None = None, p: str | None = None, o: str | None = None) -> float:
        return float(10 ** shape_rank(s, p, o))


# ---- registry

Factory = Callable[[SparkSession, dict], TripleSource]
_BACKENDS: dict[str, tuple[Factory, tuple[str, ...]]] = {}


def register(name: str, factory: Factory, required: tuple[str, ...] = ()) -> None:
    _BACKENDS[name] = (factory, tuple(required))


def import_backend(name: str, path: str, attribute: str, required: list[str]) -> None:
    """Register a factory (or class) found by its module path."""
    register(name, getattr(importlib.import_module(path), attribute), tuple(required))


def open_source(spark: SparkSession, config: dict) -> TripleSource:
    """The source that a graph's settings describe; a missing parameter is a SyntaxError."""
    name = config.get("backend")
    if name not in _BACKENDS:
        raise SyntaxError(f"no backend named {name!r}")
    factory, required = _BACKENDS[name]
    if missing := [r for r in required if r not in config]:
        raise SyntaxError(f"backend {name!r} needs {', '.join(missing)}")
    return factory(spark, config)


def _parquet(spark: SparkSession, c: dict) -> TripleSource:
    return FrameSource(spark.read.parquet(c["path"]), distinct=bool(c.get("distinct")))


def _dictionary(spark: SparkSession, c: dict) -> TripleSource:
    return DictionarySource(spark.read.parquet(c["triples"]), spark.read.parquet(c["dictionary"]))


def _versioned(spark: SparkSession, c: dict) -> TripleSource:
    return VersionedSource(spark.read.parquet(c["path"]), c.get("as_of"))


def _jdbc(spark: SparkSession, c: dict) -> TripleSource:
    """Any table with three text columns that a JDBC driver on the class path reads."""
    df = spark.read.jdbc(c["url"], c["table"], properties=c.get("properties", {}))
    names = c.get("columns", ["subject", "predicate", "object"])
    return FrameSource(df.select(*(F.col(n).alias(x) for n, x in zip(names, "spo", strict=True))))


register("parquet", _parquet, ("path",))
register("dictionary", _dictionary, ("triples", "dictionary"))
register("versioned", _versioned, ("path",))
register("mvcc", lambda spark, c: MvccGraph(spark, c["path"]).as_of(c["as_of"]) if c.get("as_of") else MvccGraph(spark, c["path"]), ("path",))
register("jdbc", _jdbc, ("url", "table"))
