"""Exact deduplication by a 128-bit content hash, with bytes compared inside each group of equal hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, text_of


def _md5(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", hash_of: Callable[[Column], Column] = _md5) -> DataFrame:
    """One row per input row: the id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal only if their bytes are: rows are aggregated by (hash, text), so every group of equal hashes is
    compared byte by byte and a hash collision makes two groups. The aggregate combines before the exchange, so a hot
    text travels once per task. Rows then find their group by the 16-byte hash alone; only rows of colliding hashes
    (found exactly, normally none) are joined on the text as well.

    A null text is an empty one. Null ids never win unless a group has no other; then ``keep_id`` is null and they are
    kept. Repeated rows (same id and text) count in ``group_size`` and share ``kept``. An empty table gives no rows.
    Extra columns are ignored, whatever their names.
    """
    best = {"max": F.max, "min": F.min}[keep]
    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("t")).withColumn("h", hash_of(F.col("t")))
    classes = rows.groupBy("h", "t").agg(best("id").alias("keep_id"), F.count("*").alias("group_size"))
    hashes = cut(classes.groupBy("h").agg(F.count("*").alias("texts"), F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size")))
    narrow = rows.select("id", "h", F.sha2("t", 256).alias("sha"))
    out = narrow.join(hashes.where("texts = 1"), "h")
    if not hashes.where("texts > 1").isEmpty():
        twice = hashes.where("texts > 1").select("h")
        mixed = rows.join(twice, "h", "left_semi").alias("r").join(classes.join(twice, "h", "left_semi").alias("c"), ["h", "t"])
        out = out.select("id", "sha", "keep_id", "group_size").unionByName(mixed.select("id", F.sha2("t", 256).alias("sha"), "keep_id", "group_size"))
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows that stay, one per distinct text (null: empty), with all columns of ``docs``.

    The whole row rides in the aggregate by (hash, text), so no join back is needed. Among rows that tie on the id the
    other columns decide, so the choice doesn't depend on the order of rows.
    """
    if keep != "max":
        raise ValueError("only keep='max' is offered for rows")
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    order = F.struct(docs[id_col].isNotNull().alias("a"), docs[id_col].alias("b"), *(docs[c].alias(f"c{i}") for i, c in enumerate(rest)))
    rows = docs.select(text_of(docs, text_col).alias("t"), docs[text_col].isNull().alias("n"), order.alias("o"))
    won = rows.groupBy(_md5(F.col("t")).alias("h"), "t").agg(F.max("o").alias("o"), F.min("n").alias("n"))
    value = {id_col: F.col("o.b"), text_col: F.when(~F.col("n"), F.col("t"))} | {c: F.col(f"o.c{i}") for i, c in enumerate(rest)}
    return won.select(*(value[c].alias(c) for c in docs.columns))
