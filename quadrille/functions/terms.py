"""RDF terms as text, and the expressions that take them apart.

A term is one string: a bare IRI, ``_:id`` for a blank node, or a literal in N3 form: ``"text"``, ``"text"@lang`` or
``"text"^^<datatype>``, with quotes, backslashes and control characters escaped in the text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
#: Datatypes of numbers, by how they promote.
INTEGERS = [XSD + n for n in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte")]
DECIMALS = [XSD + "decimal"]
DOUBLES = [XSD + "double", XSD + "float"]
TIMES = [XSD + "dateTime", XSD + "date"]

# Plain literals that look like these are typed when data or patterns are read; signs don't match.
RETYPED = [
    ("integer", r"[0-9]+"),
    ("decimal", r"[0-9]+\.[0-9]*|\.[0-9]+"),
    ("double", r"[0-9]+\.[0-9]*[eE][+-]?[0-9]+|\.[0-9]+[eE][+-]?[0-9]+|[0-9]+[eE][+-]?[0-9]+"),
    ("boolean", r"true|false"),
]

_LITERAL = r'(?s)^"(.*)"(?:@([A-Za-z0-9-]+)|\^\^<?([^>"]*)>?)?$'
_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def escape(text: str) -> str:
    return "".join(_ESCAPES.get(c, c) for c in text)


def unescape(text: str) -> str:
    plain = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}

    def one(m: re.Match) -> str:
        e = m[1]
        return chr(int(e[1:], 16)) if e[0] in "uU" and len(e) > 1 else plain.get(e, e)

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text, flags=re.S)


def literal(text: str, datatype: str | None = None, lang: str | None = None, retype: bool = False) -> str:
    """The literal's text form; ``retype`` types a plain one by its looks."""
    if retype and not datatype and not lang:
        datatype = next((XSD + name for name, p in RETYPED if re.fullmatch(p, text)), None)
    return f'"{escape(text)}"' + (f"@{lang}" if lang else f"^^<{datatype}>" if datatype else "")


def parse(term: str) -> tuple[str, str, str | None, str | None]:
    """(kind, lexical form, datatype, language) of a term's text."""
    if m := re.match(_LITERAL, term):
        return "literal", unescape(m[1]), m[3], m[2]
    return ("bnode" if term.startswith("_:") else "iri"), term, None, None


def is_variable(x: object) -> bool:
    return isinstance(x, str) and x.startswith("?")


# ---- on columns


def kind(c: Column) -> Column:
    return F.when(c.startswith('"'), "literal").when(c.startswith("_:"), "bnode").when(c.isNotNull(), "iri")


def lexical(c: Column) -> Column:
    """The text of a literal, unescaped; other terms as they are."""
    raw = F.regexp_extract(c, _LITERAL, 1)
    plain = raw
    for there, here in (("\\\\", "\u0000"), ('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\u0000", "\\")):
        plain = F.replace(plain, F.lit(there), F.lit(here))
    return F.when(c.startswith('"'), F.when(raw.contains("\\"), plain).otherwise(raw)).otherwise(c)


def datatype(c: Column) -> Column:
    """The datatype's IRI; null for what isn't a literal."""
    given, tagged = F.regexp_extract(c, _LITERAL, 3), F.regexp_extract(c, _LITERAL, 2)
    return F.when(c.startswith('"'), F.when(given != "", given).when(tagged != "", RDF + "langString").otherwise(XSD + "string"))


def language(c: Column) -> Column:
    """The language tag, empty without one; null for what isn't a literal."""
    return F.when(c.startswith('"'), F.regexp_extract(c, _LITERAL, 2))


def escaped(c: Column) -> Column:
    for there, here in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(there), F.lit(here))
    return c


def plain_literal(text: Column) -> Column:
    return F.concat(F.lit('"'), escaped(text), F.lit('"'))


def typed_literal(text: Column, datatype: str) -> Column:
    return F.concat(F.lit('"'), escaped(text), F.lit(f'"^^<{datatype}>'))


def retyped(text: Column, raw: Column) -> Column:
    """``raw``, or the typed literal that its plain ``text`` looks like."""
    out = F.when(F.lit(False), raw)
    for name, p in RETYPED:
        out = out.when(text.rlike(f"^(?:{p})$"), typed_literal(text, XSD + name))
    return out.otherwise(raw)
