"""Pages of a query's results, with continuation tokens.

The first call pins the versions of all graphs, orders the result by all of its columns and writes it once, each row
with its partition and its place there; a small file says how many rows came before each partition. A page is a range of
places, so the pages together are the whole bag. If
writing isn't done within the quantum, the page is empty and the token lets the caller come back; the job goes on in its
own job group. Tokens are self-contained (stateless) or ids of tokens kept here (stateful). A result that was evicted
is computed again from the same versions: the order is total up to equal rows, so the position still holds.
"""

from __future__ import annotations

import base64
import hashlib
import json
import threading
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BadToken
from ..sources.files import Files


#: Rows of a page whose caller sets no limit: what a page holds passes through the driver.
MOST_ROWS = 10_000


@dataclass
class Page:
    bindings: list[dict[str, str]]
    next: str | None
    variables: list[str]
    stats: dict = field(default_factory=dict)

    @property
    def has_next(self) -> bool:
        return self.next is not None


def encode(token: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps(token, sort_keys=True).encode()).decode()


def decode(text: str) -> dict:
    try:
        token = json.loads(base64.urlsafe_b64decode(text.encode()))
        return token if {"query", "graph", "versions", "served", "vars"} <= set(token) else _bad()
    except (ValueError, TypeError) as e:
        raise BadToken(str(e)) from e


def _bad() -> dict:
    raise BadToken("not a continuation token")


class TokenStore:
    """Tokens kept by id, for clients that shouldn't carry state."""

    def __init__(self) -> None:
        self._tokens: dict[str, str] = {}

    def save(self, token: str) -> str:
        key = str(uuid.uuid4())
        self._tokens[key] = token
        return key

    def get(self, key: str) -> str:
        if key not in self._tokens:
            raise BadToken("unknown token id")
        return self._tokens[key]

    def delete(self, key: str) -> None:
        self._tokens.pop(key, None)


#: Columns of a written result beside the variables, and the number of a row's page; no variable has such a name.
PART, PLACE, PAGE = "part?", "place?", "page?"


class ResultCache:
    """Ordered results in files, the least recently used ones evicted beyond ``most``."""

    def __init__(self, spark, root: str, most: int = 64):
        self.spark, self.root, self.most, self.files = spark, root.rstrip("/"), most, Files(spark)
        self.used: dict[str, float] = {}
        self.frames: dict[str, DataFrame] = {}
        self.places: dict[str, list[list[int]]] = {}
        self.jobs: dict[str, threading.Thread] = {}
        self.failed: dict[str, BaseException] = {}
        self.lock = threading.Lock()

    def path(self, key: str) -> str:
        return f"{self.root}/{key}"

    def ready(self, key: str) -> bool:
        return self.files.exists(f"{self.path(key)}/places.json")

    def write(self, key: str, df: DataFrame) -> None:
        """Rows in order of all columns, nulls first, with their partition and place in it, and the table of partitions."""
        columns = [F.col(c) for c in df.columns]
        ordered = df.orderBy(*(c.asc_nulls_first() for c in columns)) if columns else df
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        ordered.select(F.spark_partition_id().alias(PART), place.alias(PLACE), *columns).write.mode("overwrite").parquet(f"{self.path(key)}/rows")
        sizes = self.spark.read.parquet(f"{self.path(key)}/rows").groupBy(PART).agg(F.count("*").alias("n")).orderBy(PART).collect()  # a row for each partition
        self.files.create(f"{self.path(key)}/places.json", json.dumps([[r[PART], r["n"]] for r in sizes]))

    def start(self, key: str, make) -> None:
        """Have the result written in the background, unless that is done or under way."""
        with self.lock:
            self.used[key] = time.time()
            if self.ready(key) or (key in self.jobs and self.jobs[key].is_alive()):
                return
            for old in sorted(self.used, key=self.used.get)[: max(0, len(self.used) - self.most)]:
                self.forget(old)
                self.files.delete(self.path(old))
                del self.used[old]
            self.failed.pop(key, None)
            self.forget(key)

            def work() -> None:
                try:
                    self.spark.sparkContext.setJobGroup(key, "query result", interruptOnCancel=True)
                    self.write(key, make())
                except BaseException as e:  # told to the caller that waits
                    self.failed[key] = e

            self.jobs[key] = InheritableThread(target=work, daemon=True)
            self.jobs[key].start()

    def wait(self, key: str, seconds: float | None) -> bool:
        self.jobs[key].join(seconds) if key in self.jobs else None
        if key in self.failed:
            raise self.failed.pop(key)
        return self.ready(key)

    def cancel(self, key: str) -> None:
        self.spark.sparkContext.cancelJobGroup(key)

    def forget(self, key: str) -> None:
        self.frames.pop(key, None)
        self.places.pop(key, None)

    def size(self, key: str) -> int:
        if key not in self.places:
            self.places[key] = json.loads(self.files.read(f"{self.path(key)}/places.json"))
        return sum(n for _, n in self.places[key])

    def frame(self, key: str, start: int, count: int) -> DataFrame:
        """The rows from place ``start`` on, as a DataFrame; its condition on partitions and places reaches the reader."""
        self.used[key] = time.time()
        if key not in self.frames:
            self.frames[key] = self.spark.read.parquet(f"{self.path(key)}/rows")
        end, at = min(start + count, self.size(key)), 0
        wanted = F.lit(False)
        first = last = None
        for part, n in self.places[key]:
            a, b = max(start - at, 0), min(end - at, n)
            if a < b and (a > 0 or b < n):  # a part of the partition
                wanted = wanted | ((F.col(PART) == part) & (F.col(PLACE) >= a) & (F.col(PLACE) < b))
            elif a < b:
                first, last = part if first is None else first, part
            at += n
        if first is not None:
            wanted = wanted | F.col(PART).between(first, last)
        return self.frames[key].where(wanted)

    def paged(self, key: str, count: int) -> DataFrame:
        """All rows with the number of their page, from 0: one plan, however many pages there are."""
        self.used[key] = time.time()
        rows, size = self.spark.read.parquet(f"{self.path(key)}/rows"), self.size(key)
        before, at = [0] * (1 + max((part for part, _ in self.places[key]), default=0)), 0
        for part, n in self.places[key]:
            before[part], at = at, at + n
        page = F.floor((F.element_at(F.array(*(F.lit(n).cast("long") for n in before)), F.col(PART) + 1) + F.col(PLACE)) / count)
        return rows.withColumn(PAGE, page).where(F.col(PAGE) < -(-size // count))

    def read(self, key: str, start: int, count: int) -> list[dict]:
        return [r.asDict() for r in self.frame(key, start, count).orderBy(PART, PLACE).drop(PART, PLACE).collect()]


class Pager:
    """``run(query, graph, versions)`` gives (DataFrame, versions, statistics) for a query on pinned versions."""

    def __init__(self, cache: ResultCache, run, stateless: bool = True, tokens: TokenStore | None = None):
        self.cache, self.run, self.stateless, self.tokens = cache, run, stateless, tokens or TokenStore()

    @staticmethod
    def _key(token: dict) -> str:
        return hashlib.sha256(json.dumps([token["query"], token["graph"], token["versions"]], sort_keys=True).encode()).hexdigest()

    def page(self, query: str, graph: str, next_token: str | None = None, quantum: float | None = None, max_results: int | None = None) -> Page:
        """The next page: at most ``max_results`` rows (MOST_ROWS without a limit); with a quantum (milliseconds), maybe none yet."""
        began = time.time()
        if next_token is None:
            token = {"query": query, "graph": graph, "versions": None, "served": 0, "vars": None}
        else:
            token = decode(next_token if self.stateless else self.tokens.get(next_token))
            if (query and query != token["query"]) or (graph and graph != token["graph"]):
                raise BadToken("the token belongs to another query")
        key = self._key(token) if token["versions"] is not None else None
        stats: dict = {}
        if key is None or not self.cache.ready(key):  # a result that is written needs no plan
            df, token["versions"], stats = self.run(token["query"], token["graph"], token["versions"])
            token["vars"], key = list(df.columns), self._key(token)
            self.cache.start(key, lambda: df)
        stats["import"] = (time.time() - began) * 1000
        bindings: list[dict[str, str]] = []
        more = True
        if self.cache.wait(key, None if quantum is None else max(0.0, quantum / 1000 - (time.time() - began))):
            rows = self.cache.read(key, token["served"], MOST_ROWS if max_results is None else max_results)
            bindings = [{f"?{k}": v for k, v in r.items() if v is not None} for r in rows]
            token["served"] += len(bindings)
            more = token["served"] < self.cache.size(key)
        exported = time.time()
        text = None
        if more:
            text = encode(token)
            if not self.stateless:
                text = self.tokens.save(text)
        if next_token is not None and not self.stateless:
            self.tokens.delete(next_token)
        stats["export"] = (time.time() - exported) * 1000
        return Page(bindings, text, token["vars"], stats)

    def frames(self, query: str, graph: str, max_results: int) -> Iterator[DataFrame]:
        """All pages as DataFrames of the variables, without bringing any row to the driver."""
        df, versions, _ = self.run(query, graph, None)
        key = self._key({"query": query, "graph": graph, "versions": versions})
        self.cache.start(key, lambda: df)
        self.cache.wait(key, None)
        for start in range(0, max(self.cache.size(key), 1), max_results):
            yield self.cache.frame(key, start, max_results).select(df.columns)

    def paged(self, query: str, graph: str, max_results: int) -> DataFrame:
        """The pages of ``frames`` as one DataFrame: the variables and the number of the page."""
        df, versions, _ = self.run(query, graph, None)
        key = self._key({"query": query, "graph": graph, "versions": versions})
        self.cache.start(key, lambda: df)
        self.cache.wait(key, None)
        return self.cache.paged(key, max_results).select(*df.columns, PAGE)
