"""N-Triples text, read line by line by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from .base import FrameSource, register

_UCHAR = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}"
_IRI = rf'<((?:[^<>"{{}}|^`\\\x00-\x20]|{_UCHAR})*+)>'
_BNODE = r"(_:[^\s.<>\"]+(?:\.+[^\s.<>\"]+)*)"
_STRING = rf'"((?:[^"\\\n\r]++|\\[tbnrf"\'\\]|{_UCHAR})*+)"'
_LINE = rf"^\s*(?:{_IRI}|{_BNODE})\s*{_IRI}\s*(?:{_IRI}|{_BNODE}|{_STRING}(@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^{_IRI})?)\s*\.\s*(?:#.*)?$"
#: The pieces of a text from left to right: pairs of surrogates, code points, single escapes, and runs without escapes.
_PIECES = r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"
#: Escapes that name no character: lone surrogates and numbers beyond the last code point.
_NOTHING = r"^(?:\\u[dD][89a-fA-F][0-9A-Fa-f]{2}|\\U(?:0000[dD][89a-fA-F]..|00[2-9A-Fa-f].{5}|001[1-9A-Fa-f].{4}|(?!00).{8}))$"
# The escapes of one letter.
_LETTERS = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _pieces(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(_PIECES), F.lit(0))


def unescaped(c: Column) -> Column:
    """The text that the escapes stand for, each read once and from left to right; null if one names no character."""

    def one(x: Column) -> Column:
        letter = F.substring(x, 2, 1)
        out = F.when(~x.startswith("\\"), x).when(x.rlike(_NOTHING), None)
        out = out.when(letter == "u", F.decode(F.unhex(F.replace(x, F.lit("\\u"), F.lit(""))), "UTF-16BE"))
        out = out.when(letter == "U", F.decode(F.unhex(F.substring(x, 3, 8)), "UTF-32"))
        for name, value in _LETTERS.items():
            out = out.when(letter == name, F.lit(value))
        return out

    # array_join leaves nulls out: a piece without a character makes the whole null
    made = F.transform(_pieces(c), one)
    whole = F.when(~F.exists(made, F.isnull), F.array_join(made, ""))
    return F.when(c.contains("\\"), whole).otherwise(c)


def parse(lines: DataFrame) -> DataFrame:
    """s, p, o and ``valid`` of each line of a text DataFrame; empty lines and comments are left out.

    Plain literals that look like numbers or booleans are typed. Escapes become characters, of which quotes, backslashes
    and control characters are escaped again as everywhere in the engine, so equal literals have equal texts.
    """
    v = F.col("value")
    names = ["s_iri", "s_node", "p_iri", "o_iri", "o_node", "text", "suffix", "type"]
    rows = lines.where(~v.rlike(r"^\s*(#.*)?$")).select(v.rlike(_LINE).alias("match"), *(F.regexp_extract(v, _LINE, i).alias(n) for i, n in enumerate(names, 1)))
    rows = rows.select("match", "s_node", "o_node", F.col("suffix").startswith("@").alias("tagged"), "suffix", *(unescaped(F.col(n)).alias(n) for n in ("s_iri", "p_iri", "o_iri", "text", "type")))
    quoted = T.plain_literal(F.col("text"))
    literal = F.when(F.col("tagged"), F.concat(quoted, "suffix")).when(F.col("suffix") != "", F.concat(quoted, F.lit("^^<"), F.col("type"), F.lit(">"))).otherwise(T.retyped(F.col("text"), quoted))
    s = F.when(F.col("s_node") != "", F.col("s_node")).otherwise(F.col("s_iri"))
    o = F.when(F.col("o_node") != "", F.col("o_node")).when(F.coalesce(F.col("o_iri"), F.lit("x")) != "", F.col("o_iri")).otherwise(literal)
    rows = rows.select("match", s.alias("s"), F.col("p_iri").alias("p"), o.alias("o"))
    known = F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull()
    return rows.select("s", "p", "o", (F.col("match") & known).alias("valid"))


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(distinct triples, invalid lines counted as one row ``dropped``)."""
    parsed = parse(spark.read.text(path))
    return parsed.where("valid").select("s", "p", "o").dropDuplicates(), parsed.agg(F.count_if(~F.col("valid")).alias("dropped"))


def written(df: DataFrame) -> DataFrame:
    """Triples (s, p, o) as lines of N-Triples, in a column ``value``."""

    def shown(name: str) -> Column:
        c = F.col(name)
        return F.when(c.startswith('"') | c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))

    return df.select(F.concat_ws(" ", shown("s"), shown("p"), shown("o"), F.lit(".")).alias("value"))


def write(df: DataFrame, path: str) -> None:
    """Triples (s, p, o) as N-Triples files."""
    written(df).write.text(path)


register("ntriples", lambda spark, c: FrameSource(read(spark, c["file"])[0], distinct=True), ("file",))
