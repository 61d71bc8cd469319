import json
import math
from collections import Counter
from xml.etree import ElementTree as ET

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quadrille.errors import BadToken, DeleteInsertConflict, SparqlSyntaxError, UnknownGraph, UnsupportedSPARQL
from quadrille.functions import terms as T
from quadrille.operators.update import UpdateExecutor
from quadrille.plans.algebra import BGP, Call, DeleteData, Filter, Graph, InsertData, Join, Modify, Pattern, Term, Union, Var
from quadrille.plans.sparql import parse_query, parse_update
from quadrille.service import describe, http
from quadrille.service.config import load_config
from quadrille.service.engine import Engine, GraphInfo
from quadrille.sinks import results
from quadrille.sources import ntriples
from quadrille.sources.base import SCHEMA, FrameSource, MvccGraph, shape_rank
from quadrille.sources import store as store_module
from quadrille.sources.store import Snapshot, Store, StoredGraph
from quadrille.streaming.paging import Page

G = "http://g"
TRIPLES = [
    ("http://a", "http://p", "http://b"), ("http://a", "http://p", "http://c"), ("http://b", "http://p", "http://c"), ("http://c", "http://q", '"x"'), ("http://a", "http://q", '"5"^^<http://www.w3.org/2001/XMLSchema#integer>'),
    ("http://b", "http://q", '"5.0"^^<http://www.w3.org/2001/XMLSchema#decimal>'), ("http://d", "http://p", "http://d"), ("_:n", "http://q", '"Bär"@de'), ("http://d", "http://q", '"say \\"hi\\""'),
]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")), cache=str(tmp_path_factory.mktemp("cache")))
    e.load(G, spark.createDataFrame(TRIPLES, SCHEMA), GraphInfo(G, "graph", "about", 5000, 3, [{"name": "all", "value": "SELECT * WHERE { ?s ?p ?o }"}]))
    return e


def rows(df):
    return Counter(tuple(r) for r in df.collect())


# ---- parser


def test_parser_shapes():
    q = parse_query("PREFIX x: <http://x/> SELECT ?s WHERE { ?s a x:T ; x:p 'v'@en, 5 . FILTER(?s != x:y) GRAPH ?g { ?s x:q [] } }")
    assert isinstance(q.where, Filter) and isinstance(q.where.child, Join) and isinstance(q.where.child.right, Graph)
    assert q.where.child.left == BGP((Pattern("?s", T.RDF + "type", "http://x/T"), Pattern("?s", "http://x/p", '"v"@en'), Pattern("?s", "http://x/p", '"5"^^<http://www.w3.org/2001/XMLSchema#integer>')))
    assert q.where.condition == Call("!=", (Var("s"), Term("http://x/y")))
    assert isinstance(parse_query("SELECT * { { ?a ?b ?c } UNION { ?d ?e ?f } UNION { ?x ?y ?z } }").where, Union)
    assert isinstance(parse_update("INSERT DATA { <a:b> <a:c> 'x' }"), InsertData)
    assert isinstance(parse_update("DELETE DATA { <a:b> <a:c> _:x }"), DeleteData)
    m = parse_update("WITH <http://g> DELETE { ?a ?b ?c } INSERT { GRAPH <http://h> { ?a ?b 1 } } WHERE { ?a ?b ?c }")
    assert isinstance(m, Modify) and m.delete[0][3] == "http://g" and m.insert[0][3] == "http://h" and m.default == ("http://g",)


def test_patterns_retype_and_filters_do_not():
    q = parse_query('SELECT * { ?s <http://p> "232" FILTER(?s = "232") }')
    assert q.where.child.patterns[0].o == '"232"^^<http://www.w3.org/2001/XMLSchema#integer>' and q.where.condition.args[1] == Term('"232"')
    assert T.literal("-5", retype=True) == '"-5"' and T.literal("1.5", retype=True).endswith("decimal>") and T.literal("1e3", retype=True).endswith("double>") and T.literal("true", retype=True).endswith("boolean>")


@pytest.mark.parametrize("text", ["SELECT DISTINCT ?s { ?s ?p ?o }", "SELECT * { OPTIONAL { ?s ?p ?o } }", "ASK { ?s ?p ?o }", "SELECT * { ?s <a:b>/<a:c> ?o }", "SELECT * { ?s ?p ?o } LIMIT 1", "SELECT (1 AS ?x) { ?s ?p ?o }"])
def test_unsupported(text):
    with pytest.raises(UnsupportedSPARQL):
        parse_query(text)


@pytest.mark.parametrize("text", ["SELECT * { ?s ?p }", "SELECT { ?s ?p ?o }", "SELECT * { ?s x:p ?o }", "nonsense", "SELECT * { ?s ?p ?o", "SELECT * { FILTER(STRLEN(?a, ?b)) }"])
def test_syntax_errors(text):
    with pytest.raises((SparqlSyntaxError, UnsupportedSPARQL)):
        parse_query(text)


# ---- scans, joins, unions


@pytest.mark.parametrize(
    ("pattern", "expected"),
    [("<http://a> <http://p> <http://b>", 1), ("<http://a> <http://p> ?o", 2), ("<http://a> ?p <http://b>", 1), ("?s <http://p> <http://c>", 2), ("<http://a> ?p ?o", 3), ("?s <http://p> ?o", 4), ("?s ?p <http://c>", 2), ("?s ?p ?o", 9), ("?s <http://p> ?s", 1), ("<http://z> ?p ?o", 0)],
)
def test_access_paths(engine, pattern, expected):
    assert len(engine.query(f"SELECT * {{ {pattern} }}", G).collect()) == expected


def test_repeated_variable_compat(engine):
    e = Engine(engine.spark, engine.store, compat=True)
    assert rows(e.query("SELECT * { ?s <http://p> ?s }", G)) == Counter({("http://b",): 1, ("http://c",): 2, ("http://d",): 1})


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("SELECT ?a ?c { ?a <http://p> ?b . ?b <http://p> ?c }", {("http://a", "http://c"): 1, ("http://d", "http://d"): 1}),
        ("SELECT ?a { ?a <http://q> 'x' . ?z <http://q> 5 }", {("http://c",): 1}),
        ("SELECT ?s ?v ?w { { ?s <http://q> ?v } UNION { ?s <http://p> <http://c> . ?w <http://q> 'x' } FILTER(?s = <http://b>) }", {("http://b", '"5.0"^^<http://www.w3.org/2001/XMLSchema#decimal>', None): 1, ("http://b", None, "http://c"): 1}),
        ("SELECT ?x ?y { { ?x <http://p> <http://b> } UNION { ?y <http://q> 'x' } { ?y <http://p> ?z } UNION { ?x <http://p> ?z } }", None),
        ("SELECT ?s { ?s <http://q> ?v FILTER(?v = 5) }", {("http://a",): 1, ("http://b",): 1}),
        ("SELECT ?s { ?s <http://q> ?v FILTER(?v > 4.5 && ?v * 2 <= 10) }", {("http://a",): 1, ("http://b",): 1}),
        ("SELECT ?s { ?s <http://q> ?v FILTER(isBlank(?s) && LANGMATCHES(LANG(?v), 'DE') && STRLEN(?v) = 3 && UCASE(?v) = 'BÄR'@de) }", {("_:n",): 1}),
        ("SELECT ?s { ?s <http://q> ?v FILTER(STR(?v) = 'say \"hi\"') }", {("http://d",): 1}),
        ("SELECT ?s { ?s <http://q> ?v FILTER(!(?v < 3)) }", {("http://a",): 1, ("http://b",): 1}),
        ("SELECT ?s { ?s <http://q> ?v FILTER(?v != 'x') }", {("http://d",): 1, ("_:n",): 1}),
        ("SELECT ?s { ?s <http://q> ?v FILTER NOT EXISTS { ?s <http://p> ?o } }", {("http://c",): 1, ("_:n",): 1}),
        ("SELECT ?g ?s { GRAPH ?g { ?s <http://p> <http://b> } }", {(G, "http://a"): 1}),
        ("SELECT ?s { GRAPH <http://none> { ?s ?p ?o } }", {}),
    ],
)
def test_queries(engine, query, expected):
    got = rows(engine.query(query, G))
    if expected is None:  # a join in which each side may leave the shared variables unbound: by definition
        p = [(s, o) for s, q, o in TRIPLES if q == "http://p"]
        left = [{"x": s} for s, o in p if o == "http://b"] + [{"y": "http://c"}]
        right = [{"y": s} for s, _ in p] + [{"x": s} for s, _ in p]
        expected = Counter(((a | b).get("x"), (a | b).get("y")) for a in left for b in right if all(a[k] == b[k] for k in a.keys() & b.keys()))
    assert got == Counter(expected)


EXPRESSIONS = [
    ("STRBEFORE('abc', 'b') = 'a' && STRAFTER('abc', 'b') = 'c' && STRAFTER('abc', 'z') = ''", True), ("CONCAT('a', 'b') = 'ab' && SUBSTR('hello', 2) = 'ello' && SUBSTR('hello', 2, 3) = 'ell'", True),
    ("REPLACE('aXbx', 'x', '-', 'i') = 'a-b-' && REGEX('Hello', '^h', 'i')", True), ("ENCODE_FOR_URI('a b~*') = 'a%20b~%2A'", True), ("ROUND(-2.5) = -2 && ROUND(2.5) = 3 && CEIL(1.2) = 2 && FLOOR(-1.2) = -2 && ABS(-3) = 3", True),
    ("10 = 5 * 2 && 7 / 2 = 3.5 && 1 + 2.5 = 3.5 && 2e0 * 3 = 6", True), ("1 / 0 = 1", False), ("'5' = 5", False), ("'a' < 'b' && 'a'@en != 'a'@fr", True), ("IF(1 < 2, 'y', 'n') = 'y' && COALESCE(?nope, 'z') = 'z'", True),
    ("'2020-03-04T05:06:07Z'^^xsd:dateTime < '2020-03-04T06:06:07Z'^^xsd:dateTime", True), ("YEAR('2020-03-04T05:06:07.5Z'^^xsd:dateTime) = 2020 && HOURS('2020-03-04T05:06:07.5Z'^^xsd:dateTime) = 5 && SECONDS('2020-03-04T05:06:07.5Z'^^xsd:dateTime) = 7.5", True),
    ("TZ('2020-03-04T05:06:07-05:00'^^xsd:dateTime) = '-05:00' && STR(TIMEZONE('2020-03-04T05:06:07-05:00'^^xsd:dateTime)) = '-PT5H'", True), ("MD5('abc') = '900150983cd24fb0d6963f7d28e17f72' && STRLEN(SHA1('abc')) = 40 && STRLEN(SHA512('a')) = 128", True),
    ("xsd:integer('7') + 1 = 8 && xsd:boolean('true') && xsd:string(5) = '5' && xsd:double('1.5') = 1.5 && xsd:decimal('2.5') = 2.5", True), ("DATATYPE(1 / 2) = xsd:decimal && STR(1 / 2) = '0.5' && STR(1 + 1) = '2' && DATATYPE('a') = xsd:string", True),
    ("sameTerm('a', 'a') && isIRI(IRI('http://x')) && isNumeric(5) && !isNumeric('5') && isLiteral(STRDT('a', <http://t>)) && LANG(STRLANG('a', 'en')) = 'en'", True), ("3 IN (1, 2, 3) && 4 NOT IN (1, 2)", True), ("?nope = 1 || true", True), ("?nope = 1 && true", False), ("!?nope", False), ("BOUND(?nope)", False),
    ("isBlank(BNODE()) && STRLEN(STRUUID()) = 36 && isIRI(UUID()) && RAND() < 1 && NOW() > '2000-01-01T00:00:00Z'^^xsd:dateTime", True), ("'' || 'x'", True), ("'' && 'x'", False), ("0 || 1", True), ("-(-3) = +3", True),
]


def test_expressions(engine):
    wrong = [e for e, keep in EXPRESSIONS if (len(engine.query(f"SELECT ?s {{ ?s <http://q> 'x' FILTER({e}) }}", G).collect()) == 1) != keep]
    assert not wrong


@given(st.permutations([0, 1, 2]), st.lists(st.tuples(*(st.sampled_from(["http://1", "http://2", "http://3"]) for _ in range(3))), max_size=12))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_bgp_by_definition(spark, tmp_path_factory, order, triples):
    """A graph pattern's result is the same in any order of its patterns, and equals the definition's."""
    store = Store(spark, str(tmp_path_factory.mktemp("s")))
    store.attach(G, FrameSource(spark.createDataFrame(triples, SCHEMA)))
    patterns = ["?a ?p ?b", "?b <http://1> ?c", "?c ?p <http://2>"]
    text = " . ".join(patterns[i] for i in order)
    t = set(triples)
    expected = Counter((a, p, b, c) for a, p, b in t for b2, one, c in t if b2 == b and one == "http://1" for c2, p2, two in t if c2 == c and p2 == p and two == "http://2")
    assert rows(Engine(spark, store).query(f"SELECT ?a ?p ?b ?c {{ {text} }}", G)) == expected


def test_estimates_order_patterns(engine):
    assert [shape_rank(*x) for x in (("a", "b", "c"), ("a", None, "c"), (None, "b", "c"), ("a", "b", None), (None, None, "c"), ("a", None, None), (None, "b", None), (None, None, None))] == list(range(1, 9))
    source = engine.store.source(G)
    assert source.estimate() == 9 and source.estimate(p="http://p") == 4 and source.estimate(p="http://none") == 0 and source.estimate(s="http://a", p="http://p") == pytest.approx(4 / 3)
    assert len(engine.explain("SELECT * { ?s ?p ?o . ?s <http://q> 'x' }", G)) == 2


# ---- updates


@pytest.fixture
def fresh(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"), cache=str(tmp_path / "c"))
    e.load(G, spark.createDataFrame(TRIPLES[:3], SCHEMA))
    return e


def graph(e, uri=G):
    return {tuple(r) for r in e.query("SELECT ?s ?p ?o { ?s ?p ?o }", uri).collect()}


def test_data_updates_are_set_operations(fresh):
    """Added twice is added once, removed twice is removed once; other graphs and absent ones stay as they are."""
    before = graph(fresh)
    fresh.store.create("http://second")
    facts = [("urn:dish:soup", "urn:costs", '"4.5"^^<http://www.w3.org/2001/XMLSchema#decimal>'), ("urn:dish:soup", "urn:called", '"Suppe"@de'), ("urn:dish:soup", "urn:with", "_:bread"), ("urn:dish:soup", "urn:note", '"a \\"hot\\" one\\n"')]
    body = r"""<urn:dish:soup> <urn:costs> 4.5 ; <urn:called> 'Suppe'@de ; <urn:with> _:bread ; <urn:note> 'a "hot" one\n'"""
    for _ in range(2):
        fresh.update(f"INSERT DATA {{ {body} GRAPH <http://absent> {{ {body} }} GRAPH <http://second> {{ <urn:x> <urn:y> <urn:z> }} }}", G)
        assert graph(fresh) == before | set(facts) and fresh.query("SELECT * { ?s ?p ?o }", G).count() == len(before) + len(facts)
    assert graph(fresh, "http://second") == {("urn:x", "urn:y", "urn:z")} and "http://absent" not in fresh.store.names()
    for _ in range(2):
        fresh.update("DELETE DATA { <urn:dish:soup> <urn:costs> 4.5 . <urn:dish:soup> <urn:called> 'Suppe'@fr . <urn:none> <urn:none> <urn:none> }", G)
        assert graph(fresh) == before | set(facts[1:])


def test_modify_reads_the_old_snapshot(fresh):
    fresh.update("DELETE { ?s <http://p> ?o } INSERT { ?o <http://p> ?s } WHERE { ?s <http://p> ?o }", G)
    assert graph(fresh) == {(o, p, s) for s, p, o in TRIPLES[:3]}
    fresh.update("DELETE WHERE { <http://c> ?p ?o }", G)
    assert graph(fresh) == {("http://b", "http://p", "http://a")}
    fresh.update("INSERT { ?o <http://p> ?s . 'x' <http://p> ?s } WHERE { ?s ?p ?o }", G)  # a literal is no subject
    assert ("http://a", "http://p", "http://b") in graph(fresh) and len(graph(fresh)) == 2


def test_versions_conflicts_and_compaction(fresh):
    first = fresh.store.source(G)
    stale = fresh.store.source(G)
    fresh.update("DELETE DATA { <http://a> <http://p> <http://b> }", G)
    second = fresh.store.source(G)
    fresh.update("INSERT DATA { <http://a> <http://p> <http://b> }", G)
    assert len(first.scan().collect()) == 3 and len(second.scan().collect()) == 2 and len(graph(fresh)) == 3
    assert len(fresh.store.source(G).as_of(second.version).scan().collect()) == 2
    with pytest.raises(DeleteInsertConflict):
        stale.apply(None, fresh.spark.createDataFrame(TRIPLES[3:4], SCHEMA))
    run = UpdateExecutor(fresh.store)
    run.sequence((("http://a", "http://p", "http://b", None),), (("http://a", "http://p", "http://b", None),), (("http://a", "http://p", "http://new", None),), G)
    with pytest.raises(DeleteInsertConflict):
        run.sequence((("http://a", "http://p", "http://b", None),), (), (("http://x", "http://y", "http://z", None),), G)
    expected = graph(fresh)
    for i in range(10):  # enough deltas for a new base
        fresh.update(f"INSERT DATA {{ <http://i> <http://i> <http://{i}> }}", G)
    assert graph(fresh) == expected | {("http://i", "http://i", f"http://{i}") for i in range(10)}
    assert sum(c["kind"] == "base" for c in fresh.store.source(G).log) >= 2


def test_several_graphs_change_together_or_not_at_all(fresh, monkeypatch):
    """A conflict on the second graph leaves the first as it was; values of RAND and UUID are the same everywhere."""
    fresh.store.create("http://h")
    both = f"INSERT {{ GRAPH <{G}> {{ ?s <urn:id> ?id }} GRAPH <http://h> {{ ?s <urn:id> ?id }} }}"
    snapshot = Snapshot(fresh.store)
    stale = {uri: snapshot.source(uri) for uri in (G, "http://h")}
    fresh.update("INSERT DATA { GRAPH <http://h> { <urn:a> <urn:b> <urn:c> } }", G)  # the other writer
    before = {uri: graph(fresh, uri) for uri in (G, "http://h")}
    more = fresh.spark.createDataFrame([("urn:n", "urn:n", "urn:n")], SCHEMA)
    with pytest.raises(DeleteInsertConflict):
        fresh.store.apply_all({g: (None, more) for g in stale.values()})
    assert {uri: graph(fresh, uri) for uri in (G, "http://h")} == before
    assert set(fresh.store.apply_all({fresh.store.source(uri): (None, more) for uri in (G, "http://h")})) == {G, "http://h"}
    assert all(graph(fresh, uri) == before[uri] | {("urn:n", "urn:n", "urn:n")} for uri in before)
    assert fresh.store.source(G).as_of(1).scan().count() == 3
    # a writer that died after its first commit: unseen, in the way for a while, then decided against
    dead = fresh.store.source(G)._commit(StoredGraph._changes(None, fresh.spark.createDataFrame(TRIPLES[3:5], SCHEMA)), "delta", "dead")
    assert ("http://c", "http://q", '"x"') not in graph(fresh) and dead.version == fresh.store.source(G).version + 1
    update = "INSERT DATA { <urn:m> <urn:m> <urn:m> }"
    with pytest.raises(DeleteInsertConflict):
        fresh.update(update, G)
    monkeypatch.setattr(store_module, "PATIENCE", 0.0)
    with pytest.raises(DeleteInsertConflict):
        fresh.update(update, G)
    assert fresh.store.decide("dead", True) is False
    fresh.update(update, G)
    assert ("urn:m", "urn:m", "urn:m") in graph(fresh) and ("http://c", "http://q", '"x"') not in graph(fresh)
    fresh.update(both.replace("?id }", "?id . ?s <urn:at> ?o }") + " WHERE { ?s ?p ?o . ?o <http://p> ?id }", G)
    assert {t for t in graph(fresh) if t[1] == "urn:id"} == {t for t in graph(fresh, "http://h") if t[1] == "urn:id"} != set()


def test_concurrent_writers(fresh):
    """Of writers on one version one wins; commits are seen whole; a compaction that comes too late fails nobody."""
    from concurrent.futures import ThreadPoolExecutor

    files = fresh.store.files
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: files.create(f"{fresh.store.root}/one", f"text {i} " * 1000), range(16)))
        assert sum(won) == 1 and files.read(f"{fresh.store.root}/one") == f"text {won.index(True)} " * 1000 and files.listing(fresh.store.root).count("one") == 1

        def write(i):
            try:
                return fresh.store.source(G).apply(None, fresh.spark.createDataFrame([(f"urn:{i}", "urn:p", "urn:o")], SCHEMA)).version
            except DeleteInsertConflict:
                return None

        versions = [v for v in pool.map(write, range(6)) if v]
    assert versions and len(versions) == len(set(versions)) and sum(p == "urn:p" for _, p, _ in graph(fresh)) == len(versions)
    late = fresh.store.source(G)
    fresh.update("INSERT DATA { <urn:y> <urn:y> <urn:y> }", G)
    with pytest.raises(DeleteInsertConflict):
        late.compact()
    late.log = late.log + [{"kind": "delta", "data": "x"}] * 20
    late.version += 20
    late.store, late.compact = late.store, lambda: (_ for _ in ()).throw(DeleteInsertConflict("later"))
    assert late.compacted() is late


def test_statistics_of_many_predicates(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"), cache=str(tmp_path / "c"))
    e.load(G, spark.range(30_000).selectExpr("concat('urn:s', id) as s", "concat('urn:p', id % 15000) as p", "concat('urn:o', id % 7) as o"))
    source = e.store.source(G)
    assert source.estimate(p="urn:p14999") == 2 and source.estimate(p="urn:p3", s="urn:s3") == 1 and source.estimate(p="urn:none") == 0 and source.estimate() == 30_000


def test_one_operation_only():
    with pytest.raises(UnsupportedSPARQL):
        parse_update("INSERT DATA { <a:a> <a:b> <a:c> } ; INSERT DATA { <a:a> <a:b> <a:d> }")
    with pytest.raises(SparqlSyntaxError):
        parse_update("INSERT DATA { ?x <a:b> <a:c> }")


# ---- pages


@pytest.mark.parametrize("size", [1, 2, 3, 4, 9, 100])
@pytest.mark.parametrize("stateless", [True, False])
def test_pages_are_the_bag(engine, tmp_path, size, stateless):
    e = Engine(engine.spark, engine.store, stateless=stateless, cache=str(tmp_path))
    query = "SELECT ?s ?v { { ?s <http://p> ?o } UNION { ?s <http://p> ?o } UNION { ?s <http://q> ?v } }"
    pages = list(e.iter_pages(query, G, max_results=size))
    got = Counter((b.get("?s"), b.get("?v")) for p in pages for b in p.bindings)
    assert got == rows(e.query(query, G)) and all(len(p.bindings) <= size for p in pages) and len(pages) == math.ceil(13 / size)
    assert pages[-1].next is None and "cardinalities" in pages[0].stats


def test_pages_see_one_snapshot_and_survive_eviction(fresh):
    query = "SELECT * { ?s ?p ?o }"
    one = fresh.page(query, G, max_results=2)
    fresh.update("DELETE WHERE { ?s ?p ?o }", G)
    fresh.pager.cache.files.delete(fresh.pager.cache.root)
    two = fresh.page(query, G, one.next, max_results=2)
    assert {(b["?s"], b["?p"], b["?o"]) for b in one.bindings + two.bindings} == set(TRIPLES[:3]) and two.next is None


def test_tokens_and_quantum(fresh):
    page = fresh.page("SELECT * { ?s ?p ?o }", G, quantum=0)
    while page.has_next:
        page = fresh.page("SELECT * { ?s ?p ?o }", G, page.next, quantum=200)
    assert len(page.bindings) == 3
    with pytest.raises(BadToken):
        fresh.page("SELECT * { ?s ?p ?o }", G, "nonsense")
    token = fresh.page("SELECT * { ?s ?p ?o }", G, max_results=1).next
    with pytest.raises(BadToken):
        fresh.page("SELECT ?s { ?s ?p ?o }", G, token)
    with pytest.raises(UnknownGraph):
        fresh.page("SELECT * { ?s ?p ?o }", "http://none")
    assert fresh.page("INSERT DATA { <http://z> <http://z> <http://z> }", G).next is None and len(graph(fresh)) == 4


def test_attached_sources_have_versions(fresh):
    """A result over another source is used again only as long as that source is the same."""
    query = "SELECT * { ?s ?p ?o }"
    for n, version in ((1, None), (2, None), (2, "v"), (2, "v")):
        fresh.store.attach("http://other", FrameSource(fresh.spark.createDataFrame(TRIPLES[:n], SCHEMA)), version)
        assert len(fresh.page(query, "http://other").bindings) == n
    token = fresh.page(query, "http://other", max_results=1).next
    assert len(Engine(fresh.spark, fresh.store, cache=fresh.pager.cache.root).page(query, "http://other", token).bindings) == 1
    fresh.pager.cache.files.delete(fresh.pager.cache.root)
    fresh.store.attach("http://other", FrameSource(fresh.spark.createDataFrame(TRIPLES[:3], SCHEMA)))
    with pytest.raises(BadToken):
        fresh.page(query, "http://other", token)


# ---- results, descriptions, loading


def test_formats():
    page = Page([{"?s": "_:n", "?v": '"Bär"@de'}, {"?s": "http://a", "?v": '"5"^^<http://t>'}], "tok", ["s", "v"], {"import": 1})
    assert json.loads(results.raw_json(page, "http://u"))["bindings"][0]["?s"] == "http://u/bnode#n"
    w = json.loads(results.w3c_json(page))
    assert w["head"]["vars"] == ["s", "v"] and w["results"]["bindings"][0]["v"] == {"type": "literal", "value": "Bär", "xml:lang": "de"} and w["results"]["bindings"][1]["v"]["datatype"] == "http://t"
    x = ET.fromstring(results.w3c_xml(page).split("\n", 1)[1])
    assert [n.tag.split("}")[1] for n in x] == ["head", "results"] and x[0][-1].get("href") == "tok"
    assert json.loads(results.w3c_json(Page([], None, ["s"])))["head"]["vars"] == ["s"] and "<results" in results.w3c_xml(Page([], None, ["s"]))
    assert results.negotiate("text/html, application/sparql-results+xml;q=0.9") == results.W3C_XML and results.negotiate(None) == results.JSON
    assert list(results.ntriples([("http://a", "http://b", '"c"')])) == ['<http://a> <http://b> "c" .\n']


def test_descriptions(engine, spark):
    d = dict(((s, p), o) for s, p, o in engine.describe(G))
    assert T.parse(d[G, "http://rdfs.org/ns/void#triples"])[1] == "9" and T.parse(d[G, "http://rdfs.org/ns/void#properties"])[1] == "2"
    whole = engine.describe_all("http://e")
    named = {o for s, p, o in whole if p.endswith("#namedGraph")}
    assert len(named) == 1 and {(p.rpartition("#")[2], o) for s, p, o in whole if s in named} >= {("name", G), ("graph", G)} and engine.json_ld(G, "http://u")["void:distinctSubjects"] == 5
    # every format holds the same triples
    text, media = describe.written(whole, "application/n-triples")
    parsed = ntriples.parse(spark.createDataFrame([(x,) for x in text.splitlines()], "value string")).collect()
    assert media == "application/n-triples" and all(r["valid"] for r in parsed) and {(r["s"], r["p"], r["o"]) for r in parsed} == set(whole)
    nodes = json.loads(describe.written(whole, "json-ld")[0])
    assert sum(len(v) for n in nodes for k, v in n.items() if k != "@id") == len(set(whole))
    xml = ET.fromstring(describe.written(whole, "application/rdf+xml, */*")[0].split("\n", 1)[1])
    assert len(xml) == len(set(whole)) and all(len(x) == 1 for x in xml)
    turtle, media = describe.written(whole, None)
    assert media == "text/turtle" and turtle.count(" ;\n") + turtle.count(" .\n") - len(describe.PREFIXES) == len(set(whole)) and "void:triples" in turtle


def test_http(engine):
    """The routes of a running server, by the standard library's client."""
    import threading
    from urllib.error import HTTPError
    from urllib.parse import urlencode
    from urllib.request import Request, urlopen

    s = http.server(engine)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{s.server_port}"

    def get(path, accept=None, data=None, kind="application/json"):
        with urlopen(Request(base + path, data, {"Accept": accept or "*/*", "Content-Type": kind}), timeout=120) as r:
            return r.headers["Content-Type"].split(";")[0], r.read().decode()

    query = "SELECT * { ?s <http://p> ?o }"
    rows_, token = [], None
    while True:  # pages of three by their tokens
        given = {"query": query, "default-graph-uri": G} | ({"next": token} if token else {})
        media, text = get("/sparql?" + urlencode(given))
        page = json.loads(text)
        rows_ += page["bindings"]
        token = page["next"]
        if not token:
            break
    assert len(rows_) == 4 and media == "application/json"
    body = json.dumps({"query": query, "defaultGraph": G}).encode()
    assert json.loads(get("/sparql", results.W3C_JSON, body)[1])["head"]["vars"] == ["s", "o"]
    assert get("/sparql", results.W3C_XML, urlencode({"query": query, "default-graph-uri": G}).encode(), "application/x-www-form-urlencoded")[0] == results.W3C_XML
    assert "void:Dataset" in get("/void/")[1] == get("/.well-known/void/")[1] and get("/void/graph", "application/n-triples")[0] == "application/n-triples" and engine.name in get("/")[1]
    for path, status in (("/sparql?query=x&default-graph-uri=" + G, 400), ("/sparql?query=x", 422), ("/void/none", 404), ("/other", 404), ("/sparql?" + urlencode({"query": query, "default-graph-uri": "http://none"}), 404), ("/sparql?" + urlencode({"query": query, "default-graph-uri": G, "next": "zzz"}), 400)):
        with pytest.raises(HTTPError) as e:
            get(path)
        assert e.value.code == status, path
    s.shutdown()
    s.server_close()


def test_jdbc(spark):
    """A table behind JDBC, in the database that comes with Spark; constants reach the database."""
    from quadrille.sources.base import open_source

    where = {"backend": "jdbc", "url": "jdbc:derby:memory:triples;create=true", "table": "TRIPLES", "properties": {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}, "columns": ["S", "P", "O"]}
    spark.createDataFrame(TRIPLES[:3], "S string, P string, O string").write.option("createTableColumnTypes", "S varchar(100), P varchar(100), O varchar(100)").jdbc(where["url"], "TRIPLES", "overwrite", where["properties"])
    source = open_source(spark, where)
    assert {tuple(r) for r in source.scan().collect()} == set(TRIPLES[:3]) and source.scan(s="http://a", o="http://c").count() == 1
    assert "PushedFilters: [*IsNotNull(S), *EqualTo(S,http://a)]" in source.scan(s="http://a")._jdf.queryExecution().toString()


def test_mvcc_writes(spark, tmp_path):
    """Insertions and deletions with times, against a replay of them."""
    g = MvccGraph(spark, str(tmp_path / "m"))
    frame = lambda ts: spark.createDataFrame(ts, SCHEMA)
    steps = [("+", TRIPLES[:3], "2020-01-01"), ("-", TRIPLES[1:2], "2020-02-01"), ("+", TRIPLES[1:4], "2020-03-01"), ("+", TRIPLES[:1], "2020-03-01"), ("-", [*TRIPLES[:1], ("http://no", "http://no", "http://no")], "2020-04-01"), ("+", TRIPLES[:1], "2020-05-01")]
    for op, triples, at in steps:
        (g.insert if op == "+" else g.delete)(frame(triples), at)
    for at in ("2019-12-31", "2020-01-01", "2020-02-01", "2020-02-15", "2020-03-01", "2020-04-30", "2020-05-01"):
        state = set()
        for op, triples, when in steps:
            if when <= at:
                state = state | set(triples) if op == "+" else state - set(triples)
        assert {tuple(r) for r in g.as_of(at).scan().collect()} == state
    spans = {tuple(map(str, r)) for r in g.intervals().where("o = 'http://b'").select("insert_t", "delete_t").collect()}
    assert spans == {("2020-01-01 00:00:00", "2020-04-01 00:00:00"), ("2020-05-01 00:00:00", "None")}
    assert g.intervals().where("s = 'http://no'").isEmpty() and {tuple(r) for r in g.scan().collect()} == set(TRIPLES[:4])


def test_ntriples(spark, tmp_path):
    (tmp_path / "in.nt").write_text(
        '<http://a> <http://p> "5" .\n# note\n\n<http://a> <http://p> "5" .\n_:x <http://p> "a\\"b\\u00e9"@en .\n<http://a> <http://p> _:x .\nbroken line\n<http://a> <http://p> "1.5"^^<http://t> . # end\n<http://a> <http://q> <http://b>.\n<http://a> "no" <http://b> .\n'
    )
    triples, dropped = ntriples.read(spark, str(tmp_path / "in.nt"))
    assert {tuple(r) for r in triples.collect()} == {
        ("http://a", "http://p", '"5"^^<http://www.w3.org/2001/XMLSchema#integer>'), ("_:x", "http://p", '"a\\"bé"@en'), ("http://a", "http://p", "_:x"), ("http://a", "http://p", '"1.5"^^<http://t>'), ("http://a", "http://q", "http://b"),
    }
    assert dropped.first()[0] == 2
    ntriples.write(triples, str(tmp_path / "out"))
    again, none = ntriples.read(spark, str(tmp_path / "out"))
    assert rows(again) == rows(triples) and none.first()[0] == 0


def test_escapes_from_left_to_right(spark):
    cases = {
        r'"x\\u0041y"': r'"x\\u0041y"', r'"\u0041\U0001F600"': '"A\U0001f600"', r'"\uD83D\uDE00"': '"\U0001f600"', r'"a\u0022b\u005Cn"': r'"a\"b\\n"', r'"\t\b\f\'"': '"\\t\b\f\'"',
        r'"\\\\u00e9"@fr': r'"\\\\u00e9"@fr', r'"\u0035"': '"5"^^<http://www.w3.org/2001/XMLSchema#integer>', r"<http://x/\u00e9>": "http://x/é", r'"a\u000Ab"^^<http://t/\u0041>': r'"a\nb"^^<http://t/A>',
        r'"\uD83D"': None, r'"\U00110000"': None, r'"\x"': None, r'"\u12"': None, '"a" "b"': None, "<a b>": None, r'"\UFFFFFFFF"': None, r'"\u0000"': '"\x00"', '""': '""', "_:a.b": "_:a.b", "_:a..": None,
    }
    lines = spark.createDataFrame([(f"<http://a> <http://p> {x} .",) for x in cases], "value string").coalesce(1)
    assert {x: (r["o"] if r["valid"] else None) for x, r in zip(cases, ntriples.parse(lines).collect(), strict=True)} == cases
    one = ntriples.parse(spark.createDataFrame([("<http://a><http://p>\"x\"@en-GB.",)], "value string")).first()
    assert one["valid"] and one["o"] == '"x"@en-GB'


def test_long_literals(spark):
    for text in ("x" * 300_000, '\\"a' * 100_000, "\\n" * 100_000):
        row = ntriples.parse(spark.createDataFrame([(f'<http://a> <http://p> "{text}"@en . # c "q"',)], "value string")).first()
        assert row["valid"] and row["o"] == f'"{text}"@en'


def test_config(spark, tmp_path):
    (tmp_path / "in.nt").write_text("<http://a> <http://p> <http://b> .\n")
    config = tmp_path / "c.yaml"
    config.write_text(f"name: test\nstore: {tmp_path}/store\nquota: 75\nmax_results: 500\ngraphs:\n- uri: http://nt\n  name: nt\n  backend: ntriples\n  file: {tmp_path}/in.nt\n- uri: http://own\n  max_results: inf\n")
    e = load_config(spark, str(config))
    assert e.info["http://nt"].max_results == 500 and math.isinf(e.info["http://own"].max_results) and e.info["http://nt"].quantum == 75
    assert e.query("SELECT * { ?s ?p ?o }", "http://nt").count() == 1 and e.query("SELECT * { ?s ?p ?o }", "http://own").count() == 0
    for bad in ("graphs: [{uri: http://x, backend: parquet}]", "graphs: [{name: x}]", "backends: [{name: x}]\ngraphs: []", "{}"):
        config.write_text(f"name: test\nstore: {tmp_path}/store\n{bad}\n" if bad != "{}" else f"name: test\nstore: {tmp_path}/store\n")
        with pytest.raises(SyntaxError):
            load_config(spark, str(config))


def test_cli(spark, tmp_path, capsys):
    from quadrille.__main__ import main

    (tmp_path / "in.nt").write_text("<http://a> <http://p> <http://b> .\n<http://a> <http://p> <http://c> .\n")
    store = ["--store", str(tmp_path / "s")]
    assert main([*store, "load", G, str(tmp_path / "in.nt")]) == 0
    assert main([*store, "query", G, "SELECT * { ?s ?p ?o }", "--page", "1"]) == 0
    out = capsys.readouterr().out.strip().splitlines()
    assert [len(json.loads(x)["bindings"]) for x in out] == [1, 1]
    assert main([*store, "update", G, "INSERT DATA { <http://a> <http://p> <http://d> }"]) == 0 and main([*store, "index", G]) == 0
    capsys.readouterr()
    assert main([*store, "describe", G]) == 0 and '"3"' in capsys.readouterr().out


# ---- joins at scale


def test_join_of_one_value_is_dealt_out(spark, tmp_path, monkeypatch):
    """All pairs of rows with one object: each once, and no task makes most of them."""
    from pyspark.sql import functions as F

    monkeypatch.setattr("quadrille.plans.planner.MADE", 500, raising=False)
    triples = [(f"http://{p}{i}", f"http://{p}", f"http://n{min(i % 9, 1)}") for p, n in (("a", 90), ("b", 60)) for i in range(n)]
    e = Engine(spark, str(tmp_path / "store"), cache=str(tmp_path / "cache"))
    e.load(G, spark.createDataFrame(triples, SCHEMA))
    df = e.query("SELECT ?a ?b { ?a <http://a> ?n . ?b <http://b> ?n }", G)
    assert rows(df) == Counter((s, t) for s, p, o in triples for t, q, u in triples if (p, q) == ("http://a", "http://b") and o == u)
    made = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert max(made) < sum(made) / 2


def test_pages_as_one_frame(spark, engine):
    """Each row's page is the one that the pages themselves say, and the plan doesn't grow with their number."""
    text = "SELECT ?s ?o { { ?s ?p ?o } UNION { ?s <http://p> ?o } }"
    for most in (1, 2, 5, 100):
        pages = [Counter((b["?s"], b["?o"]) for b in page.bindings) for page in engine.iter_pages(text, G, quantum=math.inf, max_results=most)]
        got = engine.paged(text, G, most)
        for i, page in enumerate(pages):
            assert Counter((r["s"], r["o"]) for r in got.where(f"`page?` = {i}").collect()) == page
        assert got.count() == sum(page.total() for page in pages) == 13
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert engine.paged("SELECT ?s { ?s <http://none> ?o }", G, 3).count() == 0


@pytest.mark.parametrize(
    ("inner", "holds"),
    [
        ("?s <http://p> ?k . ?c <http://q> ?k . ?c <http://r> 'x'", lambda t, s, z: any((c, "http://r", '"x"') in t and (s, "http://p", k) in t for c, q, k in t if q == "http://q")),
        ("?s <http://p> ?k . ?z <http://q> ?k", lambda t, s, z: any((s, "http://p", k) in t for c, q, k in t if c == z and q == "http://q")),
        ("?c <http://q> ?k . ?d <http://p> ?k", lambda t, s, z: True),
        ("?c <http://q> ?k . ?d <http://none> ?k", lambda t, s, z: False),
        ("?c <http://none> ?k . ?s <http://p> ?m", lambda t, s, z: False),
        ("?c <http://q> ?k . ?d <http://p> ?l . ?s <http://p> ?m", lambda t, s, z: True),
        ("?s <http://p> ?k . ?c <http://q> ?k . ?c <http://to> ?d . ?d <http://q> ?l . ?s <http://also> ?l", lambda t, s, z: any((s, "http://p", k) in t and (c, "http://to", d) in t and (d, "http://q", l) in t and (s, "http://also", l) in t for c, q, k in t if q == "http://q" for d, r, l in t if r == "http://q")),
        ("{ ?s <http://p> ?k . ?c <http://q> ?k . ?c <http://r> 'x' } UNION { ?s <http://also> ?k . ?c <http://q> ?k . ?c <http://r> 'y' }", lambda t, s, z: any(((s, "http://p", k) in t and (c, "http://r", '"x"') in t) or ((s, "http://also", k) in t and (c, "http://r", '"y"') in t) for c, q, k in t if q == "http://q")),
    ],
)
def test_exists_by_definition(spark, inner, holds):
    from quadrille.plans.planner import Planner

    t = [(f"http://s{i}", "http://p", f"http://k{i % 5}") for i in range(10)] + [(f"http://c{i}", "http://q", f"http://k{i % 4}") for i in range(8)]
    t += [(f"http://c{i}", "http://r", '"x"' if i in (1, 5, 6) else '"y"') for i in range(8)] + [(f"http://c{i}", "http://to", f"http://c{i * 3 % 8}") for i in range(8)]
    t += [(f"http://s{i}", "http://also", f"http://k{i * i % 5}") for i in range(10)] + [(f"http://s{i}", "http://z", f"http://c{i % 8}") for i in range(10)]
    source = FrameSource(spark.createDataFrame(t, SCHEMA).coalesce(1), distinct=True)
    catalog = type("Catalog", (), {"spark": spark, "names": lambda self: [G], "source": lambda self, uri: source})()
    q = parse_query("SELECT ?s ?z { ?s <http://z> ?z FILTER EXISTS { " + inner + " } }")
    assert rows(Planner(catalog, (G,)).query(q)) == Counter((s, z) for s, p, z in t if p == "http://z" and holds(set(t), s, z))


def test_exists_makes_no_pairs(spark, small):
    """Patterns of an EXISTS that share a value with many rows meet in a semi join; the inner join is that of the outer rows with distinct subjects."""
    from quadrille import queries

    plan = queries.QUERIES["filter_exists"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") <= 1 and "Join LeftSemi" in plan
