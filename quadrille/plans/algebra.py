"""Logical plans of queries and updates."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Pattern:
    """A triple pattern; a value starting with ? is a variable, others are terms."""

    s: str
    p: str
    o: str

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(x[1:] for x in (self.s, self.p, self.o) if x.startswith("?")))

    @property
    def kind(self) -> str:
        """Which positions are bound: spo, sp?, s?o, ?po, s??, ?p?, ??o or ???."""
        return "".join("?" if x.startswith("?") else c for c, x in zip("spo", (self.s, self.p, self.o), strict=True))


@dataclass(frozen=True)
class BGP:
    patterns: tuple[Pattern, ...] = ()


@dataclass(frozen=True)
class Join:
    left: object
    right: object


@dataclass(frozen=True)
class Union:
    left: object
    right: object


@dataclass(frozen=True)
class Filter:
    condition: object
    child: object


@dataclass(frozen=True)
class Graph:
    """``child`` over the graph named by a term or variable."""

    name: str
    child: object


@dataclass(frozen=True)
class Query:
    """``variables`` is None for SELECT *."""

    variables: tuple[str, ...] | None
    where: object
    default: tuple[str, ...] = ()
    named: tuple[str, ...] = ()


Quad = tuple[str, str, str, "str | None"]


@dataclass(frozen=True)
class InsertData:
    quads: tuple[Quad, ...]


@dataclass(frozen=True)
class DeleteData:
    quads: tuple[Quad, ...]


@dataclass(frozen=True)
class Modify:
    delete: tuple[Quad, ...]
    insert: tuple[Quad, ...]
    where: object
    default: tuple[str, ...] = ()
    named: tuple[str, ...] = ()


# ---- expressions


@dataclass(frozen=True)
class Term:
    """A constant."""

    text: str


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Call:
    """An operator or function; ``extra`` holds the pattern of EXISTS."""

    name: str
    args: tuple = field(default=())
    extra: object = None


def variables_of(node: object) -> list[str]:
    """Variables in scope of a plan, in order of appearance."""
    if isinstance(node, BGP):
        found = [v for p in node.patterns for v in p.variables]
    elif isinstance(node, Join | Union):
        found = variables_of(node.left) + variables_of(node.right)
    elif isinstance(node, Graph):
        found = variables_of(node.child) + ([node.name[1:]] if node.name.startswith("?") else [])
    elif isinstance(node, Filter):
        found = variables_of(node.child)
    else:
        raise TypeError(node)
    return list(dict.fromkeys(found))


def visible(names: list[str]) -> list[str]:
    """Without those that stand for blank nodes of the query."""
    return [n for n in names if not n.startswith("_b")]
