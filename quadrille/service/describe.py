"""Descriptions of graphs and of the whole service with the VoID and SPARQL service description vocabularies.

A description is a list of triples (s, p, o) of term texts. It has two sources: counts, computed from the graph's
triples, and settings, looked up in tables that say by which property a setting is told.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from xml.sax.saxutils import escape as xml_text
from xml.sax.saxutils import quoteattr

from ..functions.terms import RDF, XSD, literal, parse

# Namespaces of the vocabularies.
PREFIXES = {
    "rdf": RDF, "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": XSD, "void": "http://rdfs.org/ns/void#", "dcterms": "http://purl.org/dc/terms/",
    "foaf": "http://xmlns.com/foaf/0.1/", "sd": "http://www.w3.org/ns/sparql-service-description#", "hydra": "http://www.w3.org/ns/hydra/core#", "formats": "http://www.w3.org/ns/formats/", "q": "urn:quadrille:",
}
#: Count -> the property that tells it.
COUNTED = {"triples": "void:triples", "subjects": "void:distinctSubjects", "predicates": "void:properties", "objects": "void:distinctObjects"}
#: Result formats that the service writes.
FORMATS = ("formats:SPARQL_Results_JSON", "formats:SPARQL_Results_XML")

Triple = tuple[str, str, str]


def iri(name: str) -> str:
    """The IRI that a prefixed name stands for."""
    prefix, _, local = name.partition(":")
    return PREFIXES[prefix] + local


def _about(subject: str, facts: Iterable[tuple[str, str | None]]) -> list[Triple]:
    return [(subject, iri(p), o) for p, o in facts if o is not None]


def _number(x: float) -> str:
    return literal("Infinity", XSD + "double") if math.isinf(x) else literal(str(int(x)), XSD + "integer")


def _text(x: str | None) -> str | None:
    return literal(x) if x else None


def graph_triples(uri: str, info, counts: dict[str, int]) -> list[Triple]:
    """What is known of one graph. info: its settings; counts: as in COUNTED."""
    out = _about(uri, [(COUNTED[k], _number(n)) for k, n in counts.items()])
    out += _about(uri, [("rdf:type", iri("void:Dataset")), ("dcterms:title", _text(info.name)), ("dcterms:description", _text(info.description)), ("foaf:homepage", uri)])
    out += _about(uri, [("hydra:itemsPerPage", _number(info.max_results)), ("q:quantum", _number(info.quantum)), ("sd:endpoint", uri), ("hydra:entrypoint", uri)])
    out += _about(uri, [("void:feature", iri(f)) for f in FORMATS])
    for i, example in enumerate(info.queries):
        node = f"_:{_slug(uri)}q{i}"
        out += [(uri, iri("q:exampleQuery"), node), *_about(node, [("rdfs:label", literal(example["name"])), ("rdf:value", literal(example["value"]))])]
    return out


def service_triples(endpoint: str, name: str | None, maintainer: str | None, graphs: list[tuple[str, str, list[Triple]]]) -> list[Triple]:
    """The service and, for each of its graphs (uri, name, its triples), a named graph of its collection."""
    collection = "_:graphs"
    out = _about(endpoint, [("rdf:type", iri("sd:Service")), ("foaf:homepage", endpoint), ("dcterms:title", _text(name)), ("dcterms:maintainer", _text(maintainer)), ("sd:availableGraphs", collection)])
    out += _about(collection, [("rdf:type", iri("sd:GraphCollection"))])
    for i, (uri, title, triples) in enumerate(graphs):
        node = f"_:graph{i}"
        out += [(collection, iri("sd:namedGraph"), node), *_about(node, [("rdf:type", iri("sd:NamedGraph")), ("sd:name", uri), ("sd:graph", uri), ("rdfs:label", _text(title))]), *triples]
    return out


def _slug(uri: str) -> str:
    return "".join(c if c.isalnum() and c.isascii() else "x" for c in uri)


def schema_org(uri: str, url: str, info, counts: dict[str, int]) -> dict:
    """A graph as a schema.org dataset in JSON-LD, with its VoID counts and limits."""
    told = {COUNTED[k]: n for k, n in counts.items()}
    limits = {k: "inf" if math.isinf(x) else x for k, x in (("timeQuota", info.quantum), ("maxResults", info.max_results))}
    return {"@context": {"schema": "http://schema.org/", "void": PREFIXES["void"]}, "@id": uri, "@type": "http://schema.org/Dataset", "schema:url": url, "schema:name": info.name, "schema:description": info.description} | told | limits


# ---- RDF formats


def _short(term: str) -> str:
    """A term in Turtle."""
    kind, lex, datatype, lang = parse(term)
    if kind == "bnode":
        return term
    if kind == "literal":
        text = term if datatype is None else term[: term.rindex("^^")]
        return f"{text}^^{_short(datatype)}" if datatype else text
    for prefix, space in PREFIXES.items():
        local = term[len(space) :]
        if term.startswith(space) and local and local.replace("_", "a").isalnum():
            return f"{prefix}:{local}"
    return f"<{term}>"


def turtle(triples: Iterable[Triple]) -> str:
    """Turtle, subject by subject in the order in which they come."""
    by: dict[str, list[tuple[str, str]]] = {}
    for s, p, o in triples:
        if (p, o) not in by.setdefault(s, []):
            by[s].append((p, o))
    head = "".join(f"@prefix {k}: <{v}> .\n" for k, v in PREFIXES.items())
    return head + "".join(f"\n{_short(s)} " + " ;\n    ".join(f"{'a' if p == RDF + 'type' else _short(p)} {_short(o)}" for p, o in facts) + " .\n" for s, facts in by.items())


def rdf_xml(triples: Iterable[Triple]) -> str:
    spaces = " ".join(f"xmlns:{k}={quoteattr(v)}" for k, v in PREFIXES.items())
    out = [f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF {spaces}>']
    for s, p, o in dict.fromkeys(triples):
        about = f'rdf:nodeID="{s[2:]}"' if s.startswith("_:") else f"rdf:about={quoteattr(s)}"
        kind, lex, datatype, lang = parse(o)
        tag = _short(p)
        if kind == "literal":
            mark = f' xml:lang="{lang}"' if lang else f" rdf:datatype={quoteattr(datatype)}" if datatype else ""
            inner = f"<{tag}{mark}>{xml_text(lex)}</{tag}>"
        else:
            inner = f'<{tag} rdf:nodeID="{o[2:]}"/>' if kind == "bnode" else f"<{tag} rdf:resource={quoteattr(o)}/>"
        out.append(f"  <rdf:Description {about}>{inner}</rdf:Description>")
    return "\n".join([*out, "</rdf:RDF>\n"])


def json_ld(triples: Iterable[Triple]) -> str:
    nodes: dict[str, dict] = {}
    for s, p, o in dict.fromkeys(triples):
        kind, lex, datatype, lang = parse(o)
        value = {"@id": o} if kind != "literal" else {"@value": lex} | ({"@type": datatype} if datatype else {}) | ({"@language": lang} if lang else {})
        node = nodes.setdefault(s, {"@id": s})
        if p == RDF + "type":
            node.setdefault("@type", []).append(o)
        else:
            node.setdefault(p, []).append(value)
    return json.dumps(list(nodes.values()))


def n_triples(triples: Iterable[Triple]) -> str:
    from ..sinks.results import ntriples

    return "".join(ntriples(triples))


#: Media type -> (names by which a format is asked for, writer).
WRITERS = {
    "text/turtle": (("turtle", "ttl", "n3", "text/n3"), turtle),
    "application/n-triples": (("nt", "ntriples", "text/plain"), n_triples),
    "application/rdf+xml": (("xml", "pretty-xml", "application/xml"), rdf_xml),
    "application/ld+json": (("json-ld", "jsonld", "application/json"), json_ld),
}


def written(triples: Iterable[Triple], wanted: str | None = None) -> tuple[str, str]:
    """(text, media type) in the first format of an Accept header, or by name, that there is; Turtle if there is none."""
    for part in (wanted or "").split(","):
        name = part.split(";")[0].strip().lower()
        for media, (names, write) in WRITERS.items():
            if name == media or name in names:
                return write(triples), media
    return turtle(triples), "text/turtle"
