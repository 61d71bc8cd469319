"""A graph over relational tables: each column is a predicate, each row a subject. Nothing is copied.

A scan with a constant predicate reads only that column and the key. Constants are turned back into column values, so
that they reach the table's reader.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from .base import shape_rank


@dataclass
class TableMap:
    """``keys`` make the subject ``base/name/k1-k2...``; ``columns`` are predicates; ``links`` map foreign keys to tables.

    ``rows`` is estimated from the size that Spark knows of the table's files, unless it is given."""

    name: str
    df: DataFrame
    keys: list[str]
    columns: list[str]
    links: dict[str, str] = field(default_factory=dict)
    rows: float = 0.0
    unique: bool = False  # whether the keys name one row


    def __post_init__(self) -> None:
        if not self.rows:
            self.rows = max(1.0, float(str(self.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / (16 * len(self.df.columns)))

    def once(self, rows: DataFrame, names: list[str]) -> DataFrame:
        """The rows' columns that a scan needs; where rows may repeat, each once, as triples form a set."""
        wanted = list(dict.fromkeys([*self.keys, *names]))
        return rows if self.unique else rows.select(*wanted).distinct()


class RelationalSource:
    def __init__(self, base: str, tables: list[TableMap]):
        self.base, self.tables = base.rstrip("/"), {t.name: t for t in tables}
        self.of = {f"{self.base}/v#{c}": (t, c) for t in tables for c in t.columns}

    def subject(self, t: TableMap) -> Column:
        return F.concat(F.lit(f"{self.base}/{t.name}/"), F.concat_ws("-", *(F.col(k).cast("string") if dict(t.df.dtypes)[k] != "timestamp_ntz" else F.date_format(k, "yyyyMMdd") for k in t.keys)))

    def object(self, t: TableMap, c: str) -> Column:
        if c in t.links:
            return F.concat(F.lit(f"{self.base}/{t.links[c]}/"), F.col(c).cast("string"))
        if dict(t.df.dtypes)[c] in ("int", "bigint", "smallint"):
            return T.typed_literal(F.col(c).cast("string"), T.XSD + "integer")
        return T.plain_literal(F.col(c))

    def _is_object(self, t: TableMap, c: str, term: str) -> Column:
        """Whether the column's value gives the term, as a comparison of the column itself."""
        kind, lex, datatype, lang = T.parse(term)
        if c in t.links:
            prefix = f"{self.base}/{t.links[c]}/"
            return F.col(c) == int(term[len(prefix) :]) if term.startswith(prefix) and term[len(prefix) :].isdigit() else F.lit(False)
        if dict(t.df.dtypes)[c] in ("int", "bigint", "smallint"):
            return F.col(c) == int(lex) if datatype == T.XSD + "integer" and lex.lstrip("-").isdigit() and str(int(lex)) == lex else F.lit(False)
        return F.col(c) == lex if kind == "literal" and not datatype and not lang else F.lit(False)

    def _rows(self, t: TableMap, s: str | None) -> DataFrame | None:
        if s is None:
            return t.df
        prefix = f"{self.base}/{t.name}/"
        if not s.startswith(prefix):
            return None
        if len(t.keys) == 1 and dict(t.df.dtypes)[t.keys[0]] in ("int", "bigint"):
            key = s[len(prefix) :]
            return t.df.where(F.col(t.keys[0]) == int(key)) if key.isdigit() and str(int(key)) == key else None
        return t.df.where(self.subject(t) == s)

    def scan(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        wanted = [self.of[p]] if p in self.of else list(self.of.values()) if p is None else []
        parts = []
        if p is None and o is None:  # all columns of a row at once: each table is read once
            for t in self.tables.values():
                rows = self._rows(t, s)
                if rows is not None:
                    cells = F.array(*(F.struct(F.lit(f"{self.base}/v#{c}").alias("p"), self.object(t, c).alias("o")) for c in t.columns))
                    parts.append(t.once(rows, t.columns).select(self.subject(t).alias("s"), F.explode(cells).alias("x")).select("s", "x.p", "x.o").where("o is not null"))
        else:
            for t, c in wanted:
                rows = self._rows(t, s)
                if rows is not None:
                    rows = rows.where(F.col(c).isNotNull() if o is None else self._is_object(t, c, o))
                    parts.append(t.once(rows, [c]).select(self.subject(t).alias("s"), F.lit(f"{self.base}/v#{c}").alias("p"), self.object(t, c).alias("o")))
        if not parts:
            return next(iter(self.tables.values())).df.sparkSession.createDataFrame([], "s string, p string, o string")
        return functools.reduce(DataFrame.unionByName, parts)

    def row_of(self, p: str) -> str | None:
        """What has at most one value of ``p`` and of all other predicates with the same answer for each subject: the table, if its keys are unique."""
        t = self.of[p][0] if p in self.of else None
        return t.name if t is not None and t.unique else None

    def star(self, s: str | None, pairs: list[tuple[str, str | None]]) -> DataFrame:
        """s, o0, o1, ...: all subjects with all the predicates (and objects, where given), by one scan of their table and without a join."""
        t = self.of[pairs[0][0]][0]
        rows = self._rows(t, s)
        if rows is None:
            rows = t.df.limit(0)
        for p, o in pairs:
            c = self.of[p][1]
            rows = rows.where(F.col(c).isNotNull() if o is None else self._is_object(t, c, o))
        return rows.select(self.subject(t).alias("s"), *(self.object(t, self.of[p][1]).alias(f"o{i}") for i, (p, _) in enumerate(pairs)))

    def estimate(self, s: str | None = None, p: str | None = None, o: str | None = None) -> float:
        size = self.of[p][0].rows if p in self.of else 0.0 if p is not None else sum(t.rows * len(t.columns) for t in self.tables.values())
        return size / (1 if s is None else max(size, 1)) / (1 if o is None else 50) if p is not None else size / 10 ** (8 - shape_rank(s, p, o))
