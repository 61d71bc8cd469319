"""Pages of solution mappings as JSON, W3C JSON, W3C XML; triples as N-Triples."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree as ET

from ..functions.terms import parse
from ..streaming.paging import Page

JSON, W3C_JSON, W3C_XML, NTRIPLES = "application/json", "application/sparql-results+json", "application/sparql-results+xml", "application/n-triples"


def analyze(term: str) -> tuple[str, str, str | None, str | None]:
    """(value, uri or literal, "datatype" or "xml:lang", its value)."""
    kind, lex, datatype, lang = parse(term)
    if kind != "literal":
        return term, "bnode" if kind == "bnode" else "uri", None, None
    return lex, "literal", "xml:lang" if lang else "datatype" if datatype else None, lang or datatype


def skolemized(binding: dict[str, str], url: str | None) -> dict[str, str]:
    """Blank nodes as IRIs below the url, if one is given."""
    return {k: f"{url}/bnode#{v[2:]}" if url and v.startswith("_:") else v for k, v in binding.items()}


def raw_json(page: Page, url: str | None = None) -> str:
    return json.dumps({"bindings": [skolemized(b, url) for b in page.bindings], "pageSize": len(page.bindings), "hasNext": page.has_next, "next": page.next, "stats": page.stats})


def _object(term: str) -> dict:
    value, kind, name, extra = analyze(term)
    return {"type": kind, "value": value} | ({name: extra} if name else {})


def w3c_json(page: Page, url: str | None = None) -> str:
    """Variables come from the query, so an empty page has them too."""
    head = {"vars": page.variables, "pageSize": len(page.bindings), "hasNext": page.has_next, "stats": page.stats} | ({"next": page.next} if page.next else {})
    rows = [{k[1:]: _object(v) for k, v in skolemized(b, url).items()} for b in page.bindings]
    return json.dumps({"head": head, "results": {"bindings": rows}})


def w3c_xml(page: Page, url: str | None = None) -> str:
    root = ET.Element("sparql", xmlns="http://www.w3.org/2005/sparql-results#")
    head = ET.SubElement(root, "head")
    for v in page.variables:
        ET.SubElement(head, "variable", name=v)
    if page.next:
        ET.SubElement(head, "link", href=page.next)
    results = ET.SubElement(root, "results")
    for b in page.bindings:
        result = ET.SubElement(results, "result")
        for k, v in skolemized(b, url).items():
            value, kind, name, extra = analyze(v)
            node = ET.SubElement(ET.SubElement(result, "binding", name=k[1:]), kind)
            node.text = value
            if name:
                node.set(name, extra)
    return '<?xml version="1.0"?>\n' + ET.tostring(root, encoding="unicode")


def ntriples(triples: Iterable[tuple[str, str, str]]) -> Iterator[str]:
    def shown(t: str) -> str:
        return t if t.startswith(('"', "_:")) else f"<{t}>"

    for s, p, o in triples:
        yield f"{shown(s)} {shown(p)} {shown(o)} .\n"


def negotiate(accept: str | None) -> str:
    """The first media type asked for that a page can have; raw JSON if none is."""
    for part in (accept or "").split(","):
        kind = part.split(";")[0].strip()
        if kind in (JSON, W3C_JSON, W3C_XML):
            return kind
        if kind in ("application/xml", "text/xml"):
            return W3C_XML
    return JSON


def render(page: Page, accept: str | None = None, url: str | None = None) -> str:
    return {JSON: raw_json, W3C_JSON: w3c_json, W3C_XML: w3c_xml}[negotiate(accept)](page, url)
