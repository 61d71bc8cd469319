"""SPARQL expressions as columns. An error is a null: FILTER drops the row, and &&, || and ! follow SPARQL's table of errors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import UnsupportedSPARQL
from ..plans.algebra import Call, Term, Var
from . import terms as T

def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


class Value:
    """A term known only at run time, by its text; null is an error (or unbound).

    Subclasses know their type when the query is planned, and give their parts without building and taking apart text:
    ``cat`` is boolean, number, text, iri or time, here None.
    """

    cat: str | None = None

    def __init__(self, term: Column | None = None):
        self._term = term

    @property
    def term(self) -> Column:
        return self._term

    def kind(self) -> Column:
        return T.kind(self.term)

    def lex(self) -> Column:
        return T.lexical(self.term)

    def dt(self) -> Column:
        return T.datatype(self.term)

    def lang(self) -> Column:
        return T.language(self.term)

    def boolean(self) -> Column:
        return F.when(self.dt() == T.XSD + "boolean", F.when(self.lex().isin("true", "1"), True).when(self.lex().isin("false", "0"), False))

    def exact(self) -> Column:
        """As a decimal, if the datatype is exact."""
        return F.when(self.dt().isin(*T.INTEGERS, *T.DECIMALS), self.lex().try_cast("decimal(38,12)"))

    def number(self) -> Column:
        """As a double, whatever the numeric datatype."""
        text = F.when(self.lex() == "INF", "Infinity").when(self.lex() == "-INF", "-Infinity").otherwise(self.lex())
        return F.when(self.dt().isin(*T.INTEGERS, *T.DECIMALS, *T.DOUBLES), text.try_cast("double"))

    def rank(self) -> Column:
        """How a number promotes: 0 integer, 1 decimal, 2 double; null for no number."""
        return F.when(self.dt().isin(*T.INTEGERS), 0).when(self.dt().isin(*T.DECIMALS), 1).when(self.dt().isin(*T.DOUBLES), 2)

    def time(self) -> Column:
        return F.when(self.dt().isin(*T.TIMES), self.lex().try_cast("timestamp"))

    def string(self) -> Column:
        """The text of a literal that is a string, tagged or not."""
        return F.when(self.dt().isin(T.XSD + "string", T.RDF + "langString"), self.lex())

    def effective(self) -> Column:
        n = self.number()
        return F.coalesce(self.boolean(), F.when(n.isNotNull(), (n != 0) & ~F.isnan(n)), F.length(self.string()) > 0)


class Decoded(Value):
    """A term taken apart once: a struct of (term, lex, dt, lang)."""

    def __init__(self, parts: Column):
        super().__init__(parts["term"])
        self.parts = parts

    @staticmethod
    def struct(term: Column) -> Column:
        return F.struct(term.alias("term"), T.lexical(term).alias("lex"), T.datatype(term).alias("dt"), T.language(term).alias("lang"))

    def lex(self) -> Column:
        return self.parts["lex"]

    def dt(self) -> Column:
        return self.parts["dt"]

    def lang(self) -> Column:
        return self.parts["lang"]


class _Typed(Value):
    """A value of a type known beforehand: what it isn't is null."""

    def boolean(self) -> Column:
        return _null("boolean")

    def exact(self) -> Column:
        return _null("decimal(38,12)")

    def number(self) -> Column:
        return _null("double")

    def rank(self) -> Column:
        return _null("int")

    def time(self) -> Column:
        return _null("timestamp")

    def string(self) -> Column:
        return _null("string")

    def lang(self) -> Column:
        return F.when(self.term.isNotNull(), "")


class _Boolean(_Typed):
    cat = "boolean"

    def __init__(self, col: Column):
        self.col = col

    @property
    def term(self) -> Column:
        return F.when(self.col.isNotNull(), F.concat(F.lit('"'), self.col.cast("string"), F.lit(f'"^^<{T.XSD}boolean>')))

    def lex(self) -> Column:
        return self.col.cast("string")

    def dt(self) -> Column:
        return F.when(self.col.isNotNull(), T.XSD + "boolean")

    def boolean(self) -> Column:
        return self.col

    def effective(self) -> Column:
        return self.col


class _Number(_Typed):
    """Three expressions side by side: rank, exact value (null from a double on) and double value."""

    cat = "number"

    def __init__(self, rank: Column, exact: Column, double: Column):
        self._rank, self._exact, self._double = rank, exact, double

    @property
    def term(self) -> Column:
        lex = self.lex()
        return F.when(self._rank == 0, T.typed_literal(lex, T.XSD + "integer")).when(self._rank == 1, T.typed_literal(lex, T.XSD + "decimal")).when(self._rank == 2, T.typed_literal(lex, T.XSD + "double"))

    def lex(self) -> Column:
        plain = F.regexp_replace(self._exact.cast("string"), r"0+$", "")
        return F.when(self._rank == 0, F.regexp_replace(plain, r"\.$", "")).when(self._rank == 1, F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)).otherwise(self._double.cast("string"))

    def dt(self) -> Column:
        return F.when(self._rank == 0, T.XSD + "integer").when(self._rank == 1, T.XSD + "decimal").when(self._rank == 2, T.XSD + "double")

    def rank(self) -> Column:
        return self._rank

    def exact(self) -> Column:
        return self._exact

    def number(self) -> Column:
        return self._double

    def effective(self) -> Column:
        return (self._double != 0) & ~F.isnan(self._double)


class _Text(_Typed):
    """A string, with a language tag or an empty one."""

    cat = "text"

    def __init__(self, col: Column, tag: Column | None = None):
        self.col, self.tag = col, tag

    @property
    def term(self) -> Column:
        plain = T.plain_literal(self.col)
        return plain if self.tag is None else F.when(self.tag != "", F.concat(plain, F.lit("@"), self.tag)).otherwise(plain)

    def lex(self) -> Column:
        return self.col

    def dt(self) -> Column:
        given = F.lit(T.XSD + "string") if self.tag is None else F.when(self.tag != "", T.RDF + "langString").otherwise(T.XSD + "string")
        return F.when(self.col.isNotNull(), given)

    def lang(self) -> Column:
        return F.when(self.col.isNotNull(), F.lit("") if self.tag is None else self.tag)

    def string(self) -> Column:
        return self.col

    def effective(self) -> Column:
        return F.length(self.col) > 0


class _Iri(_Typed):
    cat = "iri"

    def __init__(self, col: Column):
        self._term = col

    def kind(self) -> Column:
        return F.when(self._term.isNotNull(), "iri")

    def lex(self) -> Column:
        return self._term

    def dt(self) -> Column:
        return _null("string")

    def lang(self) -> Column:
        return _null("string")

    def effective(self) -> Column:
        return _null("boolean")


def _boolean(c: Column) -> Value:
    return _Boolean(c)


def _string(c: Column) -> Value:
    return _Text(c)


def _integer(c: Column) -> Value:
    return _Number(F.when(c.isNotNull(), 0), c.cast("decimal(38,12)"), c.cast("double"))


def _iri(c: Column) -> Value:
    return _Iri(c)


def _like(source: Value, c: Column) -> Value:
    """A string with the language tag of ``source``."""
    if isinstance(source, _Text):
        return _Text(c, source.tag)
    return _Text(c, source.lang())


def _constant(text: str) -> Value:
    kind, lex, datatype, lang = T.parse(text)
    if kind == "iri":
        return _Iri(F.lit(text))
    if kind != "literal":
        return Value(F.lit(text))
    if lang or datatype in (None, T.XSD + "string"):
        return _Text(F.lit(lex), F.lit(lang) if lang else None)
    if datatype in (T.XSD + "integer", T.XSD + "decimal", T.XSD + "double"):
        rank = [T.XSD + "integer", T.XSD + "decimal", T.XSD + "double"].index(datatype)
        try:
            double = float(lex)
        except ValueError:
            return Value(F.lit(text))
        return _Number(F.lit(rank), F.lit(lex).try_cast("decimal(38,12)") if rank < 2 else _null("decimal(38,12)"), F.lit(double))
    if datatype == T.XSD + "boolean" and lex in ("true", "false", "1", "0"):
        return _Boolean(F.lit(lex in ("true", "1")))
    return Value(F.lit(text))


def _pairs(a: Value, b: Value) -> list[tuple[Column, Column]]:
    """The values by which two terms can be compared, for the types that both can have."""
    out = []
    for cat, parts in (("number", ("exact", "number")), ("boolean", ("boolean",)), ("time", ("time",))):
        if a.cat in (None, cat) and b.cat in (None, cat):
            out += [(getattr(a, p)(), getattr(b, p)()) for p in parts]
    return out


def equal(a: Value, b: Value) -> Column:
    """a = b: by value for numbers, booleans, times and strings; else the same term, an error for other unequal literals."""
    if a.cat and b.cat and a.cat != b.cat:
        return F.when(a.term.isNotNull() & b.term.isNotNull(), False) if "iri" in (a.cat, b.cat) or "text" not in (a.cat, b.cat) else _null("boolean")
    if "iri" in (a.cat, b.cat):
        return a.term == b.term
    out = F.when(F.lit(False), _null("boolean"))
    for x, y in _pairs(a, b):
        out = out.when(x.isNotNull() & y.isNotNull(), x == y)
    if a.cat in (None, "text") and b.cat in (None, "text"):
        x, y = a.string(), b.string()
        out = out.when(x.isNotNull() & y.isNotNull(), (x == y) & (F.lower(a.lang()) == F.lower(b.lang())))
    if a.cat is None and b.cat is None:
        out = out.when(a.term == b.term, True)
    for x in (a, b):  # a term that isn't a literal equals no literal
        if x.cat is None:
            out = out.when((x.kind() != "literal") & a.term.isNotNull() & b.term.isNotNull(), False)
    return out


def less(a: Value, b: Value, strict: bool) -> Column:
    op: Callable[[Column, Column], Column] = (lambda x, y: x < y) if strict else (lambda x, y: x <= y)
    out = F.when(F.lit(False), _null("boolean"))
    for x, y in _pairs(a, b):
        out = out.when(x.isNotNull() & y.isNotNull(), op(x, y))
    if a.cat in (None, "text") and b.cat in (None, "text"):  # untagged strings
        x, y = a.string(), b.string()
        out = out.when(x.isNotNull() & y.isNotNull() & (a.lang() == "") & (b.lang() == ""), op(x, y))
    return out


def _arithmetic(op: str, a: Value, b: Value) -> Value:
    exact = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op]
    rank = F.when(a.rank().isNotNull() & b.rank().isNotNull(), F.greatest(a.rank(), b.rank(), *([F.lit(1)] if op == "/" else [])))
    x, y = a.number(), b.number()
    double = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y)}[op]()
    return _Number(rank, exact(a.exact(), b.exact()).cast("decimal(38,12)"), double)


def _rounded(name: str, a: Value) -> Value:
    e, d = a.exact(), a.number()
    exact = {"ABS": lambda: F.abs(e), "CEIL": lambda: F.ceil(e), "FLOOR": lambda: F.floor(e), "ROUND": lambda: F.floor(e + F.lit(0.5).cast("decimal(2,1)"))}[name]()
    double = {"ABS": lambda: F.abs(d), "CEIL": lambda: F.ceil(d), "FLOOR": lambda: F.floor(d), "ROUND": lambda: F.floor(d + 0.5)}[name]()
    return _Number(a.rank(), exact.cast("decimal(38,12)"), double.cast("double"))


def _zone(a: Value) -> Column:
    return F.regexp_extract(a.lex(), r"(Z|[+-][0-9]{2}:[0-9]{2})$", 1)


#: Uses of variables from which on their terms are taken apart once, before the condition, and not at each use.
MANY_USES = 2


def uses(e: object) -> list[str]:
    """The variables of an expression, as often as they are used."""
    if isinstance(e, Var):
        return [e.name]
    return [v for x in e.args for v in uses(x)] if isinstance(e, Call) and e.name != "BOUND" else []


def condition(e: object, variables: dict[str, Column], exists: Callable[[object], Column] | None = None) -> Column:
    """Whether a FILTER keeps a row: true, false, or null for an error.

    Small conditions are plain columns, which Catalyst can push down. In large ones the variables' terms are taken apart
    into a struct first, and the condition is a function of that struct: its size stays in proportion to the text's.
    """
    names = [n for n in dict.fromkeys(uses(e)) if n in variables]
    if len(uses(e)) < MANY_USES or not names:
        return compile_expression(e, variables, exists).effective()
    parts = F.struct(*(Decoded.struct(variables[n]).alias(f"v{i}") for i, n in enumerate(names)))

    def inside(x: Column) -> Column:
        return compile_expression(e, {**variables, **{n: Decoded(x[f"v{i}"]) for i, n in enumerate(names)}}, exists).effective()

    return F.element_at(F.transform(F.array(parts), inside), 1)


def compile_expression(e: object, variables: dict[str, Column | Value], exists: Callable[[object], Column] | None = None, base: str = "") -> Value:
    """The value of an expression over rows whose variables are the given columns of term texts. A variable that isn't there is unbound."""

    def go(x: object) -> Value:
        return compile_expression(x, variables, exists, base)

    if isinstance(e, Var):
        v = variables.get(e.name, _null("string"))
        return v if isinstance(v, Value) else Value(v)
    if isinstance(e, Term):
        return _constant(e.text)
    if not isinstance(e, Call):
        raise UnsupportedSPARQL(f"expression {e!r}")
    name, args = e.name, e.args
    if name == "EXISTS":
        if exists is None:
            raise UnsupportedSPARQL("EXISTS here")
        return _boolean(exists(e.extra))
    if name == "BOUND":
        if not isinstance(args[0], Var):
            raise UnsupportedSPARQL("BOUND takes a variable")
        return _boolean(go(args[0]).term.isNotNull())
    if name == "&&":
        return _boolean(go(args[0]).effective() & go(args[1]).effective())
    if name == "||":
        return _boolean(go(args[0]).effective() | go(args[1]).effective())
    if name == "!":
        return _boolean(~go(args[0]).effective())
    if name == "IN":
        first, found = go(args[0]), F.lit(False)
        for x in args[1:]:
            found = found | equal(first, go(x))
        return _boolean(found)
    if name == "IF":
        cond, yes, no = (go(x) for x in args)
        return Value(F.when(cond.effective(), yes.term).when(~cond.effective(), no.term))
    if name == "COALESCE":
        return Value(F.coalesce(*(go(x).term for x in args)) if args else F.lit(None).cast("string"))
    if name == "CAST":
        return _cast(args[0].text, go(args[1]))
    v = [go(x) for x in args]
    if name in ("=", "!="):
        c = equal(*v)
        return _boolean(c if name == "=" else ~c)
    if name in ("<", "<=", ">", ">="):
        a, b = v if name[0] == "<" else v[::-1]
        return _boolean(less(a, b, len(name) == 1))
    if name in "+-*/":
        return _arithmetic(name, *v)
    if name in ("NEG", "POS"):
        sign = -1 if name == "NEG" else 1
        return _Number(v[0].rank(), (v[0].exact() * sign).cast("decimal(38,12)"), v[0].number() * sign)
    if name in ("ABS", "CEIL", "FLOOR", "ROUND"):
        return _rounded(name, v[0])
    if name == "SAMETERM":
        return _boolean(v[0].term == v[1].term)
    if name in ("ISIRI", "ISURI", "ISBLANK", "ISLITERAL"):
        return _boolean(v[0].kind() == {"ISBLANK": "bnode", "ISLITERAL": "literal"}.get(name, "iri"))
    if name == "ISNUMERIC":
        return _boolean(F.when(v[0].term.isNotNull(), v[0].number().isNotNull()))
    if name == "STR":
        return _string(F.when(v[0].kind() != "bnode", v[0].lex()) if v[0].cat is None else v[0].lex())
    if name == "LANG":
        return _string(v[0].lang())
    if name == "DATATYPE":
        return _iri(v[0].dt())
    if name in ("IRI", "URI"):
        text = F.coalesce(v[0].string(), F.when(v[0].kind() == "iri", v[0].term))
        return _iri(F.when(text.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), text).otherwise(F.concat(F.lit(base), text)))
    if name == "BNODE":
        return Value(F.concat(F.lit("_:"), v[0].string() if v else F.replace(F.uuid(), F.lit("-"), F.lit(""))))
    if name == "STRDT":
        return Value(F.concat(T.plain_literal(v[0].string()), F.lit("^^<"), v[1].term, F.lit(">")))
    if name == "STRLANG":
        return Value(F.concat(T.plain_literal(v[0].string()), F.lit("@"), v[1].string()))
    if name == "STRLEN":
        return _integer(F.length(v[0].string()))
    if name in ("UCASE", "LCASE"):
        return _like(v[0], (F.upper if name == "UCASE" else F.lower)(v[0].string()))
    if name == "ENCODE_FOR_URI":
        out = F.url_encode(v[0].string())
        for there, here in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
            out = F.replace(out, F.lit(there), F.lit(here))
        return _string(out)
    if name == "SUBSTR":
        start = v[1].number().cast("int")
        length = v[2].number().cast("int") if len(v) > 2 else F.length(v[0].string())
        end = start + length  # places before the first count
        first = F.greatest(start, F.lit(1))
        return _like(v[0], F.substring(v[0].string(), first, F.greatest(end - first, F.lit(0))))
    if name in ("CONTAINS", "STRSTARTS", "STRENDS"):
        return _boolean({"CONTAINS": F.contains, "STRSTARTS": F.startswith, "STRENDS": F.endswith}[name](v[0].string(), v[1].string()))
    if name in ("STRBEFORE", "STRAFTER"):
        s, x = v[0].string(), v[1].string()
        at = F.position(x, s)
        found = F.substring(s, F.lit(1), at - 1) if name == "STRBEFORE" else F.substring(s, at + F.length(x), F.length(s))
        tag = _like(v[0], found).lang() if v[0].cat is None or v[0].tag is not None else F.lit("")
        return _Text(F.when(at > 0, found).when(at == 0, ""), F.when(at > 0, tag).otherwise(""))
    if name == "CONCAT":
        parts, tags = [x.string() for x in v], [x.lang() for x in v]
        same = F.lit(bool(tags))
        for t in tags:
            same = same & (t == tags[0])
        return _Text(F.concat(*parts) if parts else F.lit(""), F.when(same, tags[0]).otherwise("") if tags else None)
    if name in ("REGEX", "REPLACE"):
        pattern, flags = v[1].string(), v[-1].string() if len(v) == (3 if name == "REGEX" else 4) else None
        if flags is not None:
            inline = F.regexp_replace(flags, "[^smix]", "")
            pattern = F.when(flags.contains("q"), F.concat(F.lit("\\Q"), pattern, F.lit("\\E"))).otherwise(pattern)
            pattern = F.when(inline != "", F.concat(F.lit("(?"), inline, F.lit(")"), pattern)).otherwise(pattern)
        if name == "REGEX":
            return _boolean(F.rlike(v[0].string(), pattern))
        return _like(v[0], F.regexp_replace(v[0].string(), pattern, v[2].string()))
    if name == "LANGMATCHES":
        tag, range_ = F.lower(v[0].string()), F.lower(v[1].string())
        return _boolean(F.when(range_ == "*", tag != "").otherwise((tag == range_) | F.startswith(tag, F.concat(range_, F.lit("-")))))
    if name in ("YEAR", "MONTH", "DAY", "HOURS", "MINUTES"):
        part = {"YEAR": r"^(-?[0-9]{4,})-", "MONTH": r"^-?[0-9]{4,}-([0-9]{2})", "DAY": r"^-?[0-9]{4,}-[0-9]{2}-([0-9]{2})", "HOURS": r"T([0-9]{2}):", "MINUTES": r"T[0-9]{2}:([0-9]{2})"}[name]
        text = F.regexp_extract(v[0].lex(), part, 1)  # as written, whatever the zone
        return _integer(F.when(v[0].time().isNotNull() & (text != ""), text.try_cast("int")))
    if name == "SECONDS":
        text = F.regexp_extract(v[0].lex(), r"T[0-9]{2}:[0-9]{2}:([0-9]{2}(?:\.[0-9]+)?)", 1)
        n = F.when(v[0].time().isNotNull() & (text != ""), text).try_cast("decimal(38,12)")
        return _Number(F.when(n.isNotNull(), 1), n, n.cast("double"))
    if name == "TZ":
        return _string(F.when(v[0].time().isNotNull(), _zone(v[0])))
    if name == "TIMEZONE":
        z = F.when(v[0].time().isNotNull(), _zone(v[0]))
        hours, minutes = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
        text = F.concat(F.when(z.startswith("-"), "-").otherwise(""), F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
        text = F.when((z == "Z") | ((hours == 0) & (minutes == 0)), "PT0S").when(z != "", text)
        return Value(T.typed_literal(text, T.XSD + "dayTimeDuration"))
    if name in ("MD5", "SHA1"):
        return _string((F.md5 if name == "MD5" else F.sha1)(v[0].string()))
    if name in ("SHA256", "SHA384", "SHA512"):
        return _string(F.sha2(v[0].string(), int(name[3:])))
    if name == "NOW":
        return Value(T.typed_literal(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), T.XSD + "dateTime"))
    if name == "RAND":
        r = F.rand()
        return _Number(F.lit(2), _null("decimal(38,12)"), r)
    if name == "UUID":
        return _iri(F.concat(F.lit("urn:uuid:"), F.uuid()))
    if name == "STRUUID":
        return _string(F.uuid())
    raise UnsupportedSPARQL(name)


def _cast(to: str, v: Value) -> Value:
    """A cast to an XML Schema type."""
    if to == T.XSD + "string":
        return _string(F.when(v.kind() != "bnode", v.lex()))
    n, text, flag = v.number(), v.string(), v.boolean().cast("int")
    if to == T.XSD + "boolean":
        return _boolean(F.coalesce(v.boolean(), F.when(n.isNotNull(), (n != 0) & ~F.isnan(n)), F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)))
    if to == T.XSD + "integer":
        e = v.exact()
        whole = F.when(e < 0, F.ceil(e)).otherwise(F.floor(e)).cast("decimal(38,12)")
        x = F.coalesce(flag.cast("decimal(38,12)"), whole, F.when(~F.isnan(n), n.try_cast("bigint")).cast("decimal(38,12)"), F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("decimal(38,12)")))
        return _Number(F.when(x.isNotNull(), 0), x, x.cast("double"))
    if to == T.XSD + "decimal":
        x = F.coalesce(flag.cast("decimal(38,12)"), v.exact(), n.try_cast("decimal(38,12)"), text.try_cast("decimal(38,12)"))
        return _Number(F.when(x.isNotNull(), 1), x, x.cast("double"))
    if to in T.DOUBLES:
        x = F.coalesce(flag.cast("double"), n, text.try_cast("double"))
        return _Number(F.when(x.isNotNull(), 2), _null("decimal(38,12)"), x)
    if to in T.TIMES:
        lex = F.coalesce(text, F.when(v.time().isNotNull(), v.lex()))
        return Value(F.when(lex.try_cast("timestamp").isNotNull(), T.typed_literal(lex, to)))
    raise UnsupportedSPARQL(f"cast to {to}")
