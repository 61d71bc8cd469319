"""Whole results as text, row by row, in the JVM: for results that are written as files and not page by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T


def _term(c: Column) -> Column:
    """A term as W3C JSON has it; fields that don't apply are null, and to_json leaves them out."""
    literal = c.startswith('"')
    tag, kind = T.language(c), T.datatype(c)
    given = literal & (tag == "") & ~c.endswith('"')  # a datatype that the text names
    return F.when(
        c.isNotNull(),
        F.struct(
            F.when(literal, "literal").when(c.startswith("_:"), "bnode").otherwise("uri").alias("type"),
            T.lexical(c).alias("value"),
            F.when(literal & (tag != ""), tag).alias("xml:lang"),
            F.when(given, kind).alias("datatype"),
        ),
    )


def w3c_json(df: DataFrame) -> DataFrame:
    """Each solution as a binding object of W3C JSON, in a column ``value``; unbound variables are left out."""
    return df.select(F.to_json(F.struct(*(_term(F.col(c)).alias(c) for c in df.columns))).alias("value"))


def raw_json(df: DataFrame) -> DataFrame:
    """Each solution as an object of variables and terms, in a column ``value``."""
    return df.select(F.to_json(F.struct(*(F.col(c).alias(f"?{c}") for c in df.columns))).alias("value"))


def _escaped(c: Column, quotes: bool = False) -> Column:
    for there, here in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"),) if quotes else ())):
        c = F.replace(c, F.lit(there), F.lit(here))
    return c


def w3c_xml(df: DataFrame) -> DataFrame:
    """Each solution as a result element of W3C XML, in a column ``value``."""

    def binding(name: str) -> Column:
        c = F.col(name)
        t = _term(c)
        mark = F.when(t["xml:lang"].isNotNull(), F.concat(F.lit(' xml:lang="'), t["xml:lang"], F.lit('"'))).when(t["datatype"].isNotNull(), F.concat(F.lit(' datatype="'), _escaped(t["datatype"], True), F.lit('"'))).otherwise("")
        made = F.concat(F.lit(f'<binding name="{name}"><'), t["type"], mark, F.lit(">"), _escaped(F.when(t["type"] == "bnode", F.substring(t["value"], 3, 1 << 30)).otherwise(t["value"])), F.lit("</"), t["type"], F.lit("></binding>"))
        return F.when(c.isNotNull(), made).otherwise("")

    return df.select(F.concat(F.lit("<result>"), *(binding(c) for c in df.columns), F.lit("</result>")).alias("value"))


def skolemized(df: DataFrame, url: str) -> DataFrame:
    """Blank nodes as IRIs below the url."""
    return df.select(*(F.when(F.col(c).startswith("_:"), F.concat(F.lit(f"{url}/bnode#"), F.substring(F.col(c), 3, 1 << 30))).otherwise(F.col(c)).alias(c) for c in df.columns))
