"""The engine's queries over the driver's tables, lifted to graphs, and the relational SQL that each must equal.

Graph http://bench/g holds all tables, http://bench/geo only region, nation, customer and supplier, http://bench/trade
only part, orders and lineitem.
"""

from __future__ import annotations

import atexit
import json
import threading
import uuid
from collections.abc import Callable
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import terms as T
from .operators.update import UpdateExecutor
from .service import http
from .service.engine import Engine, GraphInfo
from .sinks import columns
from .sources import ntriples
from .sources.base import SCHEMA, DictionarySource, FrameSource, MvccGraph, VersionedSource
from .sources.files import Files, shared_dir
from .sources.relational import RelationalSource, TableMap
from .sources.store import Store
from .streaming.paging import PAGE

BASE = "http://bench"
ALL, GEO, TRADE = f"{BASE}/g", f"{BASE}/geo", f"{BASE}/trade"
#: table -> (key columns, literal columns, links).
TABLES: dict[str, tuple[list[str], list[str], dict[str, str]]] = {
    "region": (["r_regionkey"], ["r_name"], {}),
    "nation": (["n_nationkey"], ["n_name"], {"n_regionkey": "region"}),
    "customer": (["c_custkey"], ["c_name", "c_mktsegment"], {"c_nationkey": "nation"}),
    "supplier": (["s_suppkey"], ["s_name"], {"s_nationkey": "nation"}),
    "part": (["p_partkey"], ["p_name", "p_brand", "p_type", "p_size"], {}),
    "orders": (["o_orderkey"], ["o_orderstatus", "o_orderpriority"], {"o_custkey": "customer"}),
    "lineitem": (["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], ["l_linenumber", "l_returnflag", "l_linestatus"], {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
}
PREFIX = f"PREFIX v: <{BASE}/v#> PREFIX b: <{BASE}/> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> "
INT = '"^^<http://www.w3.org/2001/XMLSchema#integer>'


def lifted(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = tuple(TABLES)) -> RelationalSource:
    maps = []
    for n in names:
        keys, columns_, links = TABLES[n]
        df = spark.read.parquet(f"{sf_dir}/{n}.parquet")
        maps.append(TableMap(n, df, keys, [*columns_, *links], links, unique=n != "lineitem"))  # its rows may repeat
    return RelationalSource(BASE, maps)


def workspace(spark: SparkSession) -> str:
    """A folder of its own for what a query writes, until the process ends."""
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            Files(spark).delete(root)
        except Exception:  # the session may be gone already
            pass

    atexit.register(remove)
    return root


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    store = Store(spark, workspace(spark))
    store.attach(ALL, lifted(spark, sf_dir))
    store.attach(GEO, lifted(spark, sf_dir, ("region", "nation", "customer", "supplier")))
    store.attach(TRADE, lifted(spark, sf_dir, ("part", "orders", "lineitem")))
    return Engine(spark, store)


def sparql(text: str, graph: str = ALL, compat: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        e.compat = compat
        return e.query(PREFIX + text, graph)

    return run


def _iri(table: str, key: str) -> str:
    return f"'{BASE}/{table}/' || {key}"


def _q(column: str) -> str:
    return f"'\"' || {column} || '\"'"


def _i(column: str) -> str:
    return f"'\"' || {column} || '{INT}'"


def _line(t: str = "") -> str:
    return f"'{BASE}/lineitem/' || {t}l_orderkey || '-' || {t}l_linenumber || '-' || {t}l_partkey || '-' || {t}l_suppkey || '-' || strftime({t}l_shipdate, '%Y%m%d')"


def _triples(table: str) -> str:
    """All triples of a table, in SQL."""
    keys, columns_, links = TABLES[table]
    subject = _line() if table == "lineitem" else _iri(table, keys[0])
    out = []
    for c in columns_:
        o = _i(c) if c in ("p_size", "l_linenumber") else _q(c)
        out.append(f"SELECT {subject} AS s, '{BASE}/v#{c}' AS p, {o} AS o FROM {table}")
    out += [f"SELECT {subject} AS s, '{BASE}/v#{c}' AS p, {_iri(t, c)} AS o FROM {table}" for c, t in links.items()]
    return " UNION ".join(out)


def _everything(tables: tuple[str, ...] = tuple(TABLES)) -> str:
    return " UNION ".join(_triples(t) for t in tables)


# name -> (SPARQL, graph, SQL)
SELECTS: dict[str, tuple[str, str, str]] = {
    "scan_spo": ("SELECT ?x WHERE { b:nation\\/3 v:n_regionkey b:region\\/3 . ?x v:r_name ?n }", ALL, f"SELECT {_iri('region', 'r_regionkey')} AS x FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 3 AND n_regionkey = 3)"),
    "scan_sp": ("SELECT * WHERE { b:customer\\/7 v:c_name ?o }", ALL, f"SELECT {_q('c_name')} AS o FROM customer WHERE c_custkey = 7"),
    "scan_so": ("SELECT * WHERE { b:customer\\/23 ?p b:nation\\/23 }", ALL, f"SELECT '{BASE}/v#c_nationkey' AS p FROM customer WHERE c_custkey = 23 AND c_nationkey = 23"),
    "scan_po": ('SELECT * WHERE { ?s v:c_mktsegment "BUILDING" }', ALL, f"SELECT {_iri('customer', 'c_custkey')} AS s FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "scan_s": ("SELECT * WHERE { b:orders\\/10 ?p ?o }", ALL, f"SELECT p, o FROM ({_triples('orders')}) WHERE s = '{BASE}/orders/10'"),
    "scan_p": ("SELECT * WHERE { ?s v:o_custkey ?o }", ALL, f"SELECT {_iri('orders', 'o_orderkey')} AS s, {_iri('customer', 'o_custkey')} AS o FROM orders"),
    "scan_o": ("SELECT * WHERE { ?s ?p b:nation\\/5 }", ALL, f"SELECT s, p FROM ({_everything(('customer', 'supplier'))}) WHERE o = '{BASE}/nation/5'"),
    "scan_all": ("SELECT * WHERE { ?s ?p ?o }", GEO, f"SELECT s, p, o FROM ({_everything(('region', 'nation', 'customer', 'supplier'))})"),
    "bgp_star": (
        'SELECT * WHERE { ?x v:p_brand ?brand . ?x v:p_type ?type . ?x v:p_size ?size . ?x v:p_name ?name }',
        ALL,
        f"SELECT {_iri('part', 'p_partkey')} AS x, {_q('p_brand')} AS brand, {_q('p_type')} AS type, {_i('p_size')} AS size, {_q('p_name')} AS name FROM part",
    ),
    "bgp_chain": (
        "SELECT ?n ?r WHERE { ?x v:n_name ?n . ?x v:n_regionkey ?y . ?y v:r_name ?r }",
        ALL,
        f"SELECT {_q('n_name')} AS n, {_q('r_name')} AS r FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "bgp_snowflake": (
        'SELECT ?o ?c ?n ?r WHERE { ?o v:o_custkey ?cu . ?cu v:c_name ?c . ?cu v:c_nationkey ?na . ?na v:n_name ?n . ?na v:n_regionkey ?re . ?re v:r_name ?r . ?o v:o_orderstatus "F" . ?l v:l_orderkey ?o . ?l v:l_returnflag "R" }',
        ALL,
        f"""SELECT {_iri('orders', 'o_orderkey')} AS o, {_q('c_name')} AS c, {_q('n_name')} AS n, {_q('r_name')} AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
            JOIN region ON n_regionkey = r_regionkey JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'""",
    ),
    "bgp_cartesian": ("SELECT * WHERE { ?a v:r_name ?b . ?c v:n_name ?d }", ALL, f"SELECT {_iri('region', 'r_regionkey')} AS a, {_q('r_name')} AS b, {_iri('nation', 'n_nationkey')} AS c, {_q('n_name')} AS d FROM region, nation"),
    "bgp_existence": (
        'SELECT * WHERE { ?s v:o_orderstatus "F" . ?s v:o_orderpriority "1-URGENT" . ?s v:o_custkey b:customer\\/7 }',
        ALL,
        f"SELECT {_iri('orders', 'o_orderkey')} AS s FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_custkey = 7",
    ),
    "join_object": (
        "SELECT ?a ?b WHERE { ?a v:c_nationkey ?n . ?b v:s_nationkey ?n }",
        ALL,
        f"SELECT {_iri('customer', 'c_custkey')} AS a, {_iri('supplier', 's_suppkey')} AS b FROM customer JOIN supplier ON c_nationkey = s_nationkey",
    ),
    "unknown_graph": ("SELECT ?s ?n WHERE { { ?s v:r_name ?n } UNION { GRAPH <http://nowhere> { ?s ?p ?n } } }", ALL, f"SELECT {_iri('region', 'r_regionkey')} AS s, {_q('r_name')} AS n FROM region"),
    "filter_strings": (
        'SELECT ?s WHERE { ?s v:p_name ?n . ?s v:p_brand ?b . FILTER(STRSTARTS(?b, "Brand#") && !STRENDS(?b, "9") && STRAFTER(?b, "#") < "35" && CONCAT(?b, "!") != "Brand#22!" && REPLACE(?b, "[0-9]", "") = "Brand#" && ENCODE_FOR_URI(?b) != "Brand%2323" && isIRI(IRI(CONCAT("http://x/", STR(?n)))) && LANGMATCHES(LANG(STRLANG(?n, "en-GB")), "en") && sameTerm(?n, ?n) && DATATYPE(STRDT(?n, xsd:token)) = xsd:token && COALESCE(?none, ?b) = ?b && STRLEN(SHA1(?n)) = 40) }',
        ALL,
        f"SELECT {_iri('part', 'p_partkey')} AS s FROM part WHERE p_brand NOT LIKE '%9' AND substring(p_brand, 7) < '35' AND p_brand NOT IN ('Brand#22', 'Brand#23')",
    ),
    "filter_casts": (
        'SELECT ?s ?z WHERE { ?s v:p_size ?z . FILTER(xsd:integer(STR(?z)) + 1 = 8 || xsd:double(?z) > 45.5 || xsd:string(?z) = "3" || xsd:decimal(?z) / 2 = 5.5 || (xsd:boolean(?z - 20) = false) || xsd:float("1.5") * ?z = 18) }',
        ALL,
        f"SELECT {_iri('part', 'p_partkey')} AS s, {_i('p_size')} AS z FROM part WHERE p_size IN (7, 3, 11, 20, 12) OR p_size > 45.5",
    ),
    "filter_made": (
        'SELECT ?s WHERE { ?s v:n_name ?n . FILTER(isIRI(UUID()) && STRLEN(STRUUID()) = 36 && RAND() < 1 && RAND() >= 0 && isBlank(BNODE()) && NOW() > "2020-01-01T00:00:00Z"^^xsd:dateTime && YEAR(NOW()) > 2019) }',
        ALL,
        f"SELECT {_iri('nation', 'n_nationkey')} AS s FROM nation",
    ),
    "union_bag": (
        "SELECT * WHERE { { ?s v:n_name ?n . ?s v:n_regionkey b:region\\/1 } UNION { ?s v:n_name ?n } }",
        ALL,
        f"SELECT {_iri('nation', 'n_nationkey')} AS s, {_q('n_name')} AS n FROM nation WHERE n_regionkey = 1 UNION ALL SELECT {_iri('nation', 'n_nationkey')}, {_q('n_name')} FROM nation",
    ),
    "union_hetero": (
        "SELECT ?s ?n ?m WHERE { { ?s v:n_name ?n } UNION { ?s v:r_name ?m } }",
        ALL,
        f"SELECT {_iri('nation', 'n_nationkey')} AS s, {_q('n_name')} AS n, NULL::VARCHAR AS m FROM nation UNION ALL SELECT {_iri('region', 'r_regionkey')}, NULL, {_q('r_name')} FROM region",
    ),
    "union_join": (
        "SELECT ?a ?s ?y WHERE { { ?s v:n_name ?a . ?s v:n_regionkey ?y } UNION { ?t v:r_name ?a } ?y v:r_name ?z }",
        ALL,
        f"""SELECT {_q('n_name')} AS a, {_iri('nation', 'n_nationkey')} AS s, {_iri('region', 'n_regionkey')} AS y FROM nation JOIN region ON n_regionkey = r_regionkey
            UNION ALL SELECT {_q('x.r_name')}, NULL, {_iri('region', 'y.r_regionkey')} FROM region x, region y""",
    ),
    "filter_eq": ('SELECT * WHERE { ?s v:c_mktsegment ?m . FILTER(?m = "BUILDING") }', ALL, f"SELECT {_iri('customer', 'c_custkey')} AS s, {_q('c_mktsegment')} AS m FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "filter_and_or": (
        'SELECT ?s WHERE { ?s v:p_size ?z . ?s v:p_brand ?b . FILTER(?z > 10 && (?z <= 20 || ?b != "Brand#13") && !(?z = 15)) }',
        ALL,
        f"SELECT {_iri('part', 'p_partkey')} AS s FROM part WHERE p_size > 10 AND (p_size <= 20 OR p_brand <> 'Brand#13') AND p_size <> 15",
    ),
    "filter_arith": ("SELECT ?s ?z WHERE { ?s v:p_size ?z . FILTER((?z * 2 + 1) / 2 - 0.5 = 7 || 10 = ?z + 5 - 2) }", ALL, f"SELECT {_iri('part', 'p_partkey')} AS s, {_i('p_size')} AS z FROM part WHERE p_size = 7 OR p_size = 7"),
    "filter_builtin": (
        'SELECT ?s ?n WHERE { ?s v:p_name ?n . ?s v:p_size ?z . FILTER(isLiteral(?n) && isIRI(?s) && isNumeric(?z) && STRLEN(?n) > 8 && CONTAINS(LCASE(STR(?n)), "a") && REGEX(?n, "^[a-z#0-9 ]+$", "i") && DATATYPE(?z) = xsd:integer && LANG(?n) = "" && BOUND(?z) && ABS(?z - 25) < 20 && ROUND(?z / 4) != 3 && SUBSTR(?n, 2, 1) != "x" && STRBEFORE(?n, "zzz") = "" && ?z IN (1, 2, 3, 5, 8, 13, 21, 34) && IF(?z > 20, true, ?z < 15)) }',
        ALL,
        f"""SELECT {_iri('part', 'p_partkey')} AS s, {_q('p_name')} AS n FROM part WHERE length(p_name) > 8 AND contains(lower(p_name), 'a') AND regexp_matches(p_name, '^[A-Za-z#0-9 ]+$') AND abs(p_size - 25) < 20
            AND floor(p_size / 4.0 + 0.5) <> 3 AND substring(p_name, 2, 1) <> 'x' AND p_size IN (1, 2, 3, 5, 8, 13, 21, 34) AND (p_size > 20 OR p_size < 15)""",
    ),
    "filter_hash": ('SELECT ?n ?m WHERE { ?x v:r_name ?n . ?x v:r_name ?m . FILTER(MD5(?n) = MD5(STR(?m)) && SHA256(?n) > "0" && UCASE(?n) = ?n) }', ALL, f"SELECT {_q('r_name')} AS n, {_q('r_name')} AS m FROM region WHERE upper(r_name) = r_name"),
    "filter_error": ('SELECT ?s WHERE { ?s v:c_name ?n . FILTER(?n > 5 || ?unbound = 1 || ?n = "Customer#000000003") }', ALL, f"SELECT {_iri('customer', 'c_custkey')} AS s FROM customer WHERE c_name = 'Customer#000000003'"),
    "filter_exists": (
        'SELECT ?s WHERE { ?s v:s_name ?n . FILTER EXISTS { ?c v:c_mktsegment "BUILDING" . ?s v:s_nationkey ?k . ?c v:c_nationkey ?k } }',
        ALL,
        f"SELECT {_iri('supplier', 's_suppkey')} AS s FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    ),
    "graph_join": (
        f"SELECT ?o ?c WHERE {{ GRAPH <{TRADE}> {{ ?o v:o_custkey ?x . ?o v:o_orderstatus \"P\" }} GRAPH <{GEO}> {{ ?x v:c_name ?c }} }}",
        ALL,
        f"SELECT {_iri('orders', 'o_orderkey')} AS o, {_q('c_name')} AS c FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'",
    ),
    "graph_var": (f"SELECT ?g ?s WHERE {{ GRAPH ?g {{ ?s v:r_name ?n }} }}", ALL, f"SELECT g, {_iri('region', 'r_regionkey')} AS s FROM region, (VALUES ('{ALL}'), ('{GEO}')) t(g)"),
    "from_merge": (f"SELECT ?s ?n FROM <{GEO}> FROM <{ALL}> WHERE {{ ?s v:n_name ?n . ?s v:n_regionkey b:region\\/2 }}", ALL, f"SELECT {_iri('nation', 'n_nationkey')} AS s, {_q('n_name')} AS n FROM nation WHERE n_regionkey = 2"),
    "from_named": (f"SELECT ?g ?s FROM NAMED <{GEO}> WHERE {{ GRAPH ?g {{ ?s v:r_name ?n }} }}", ALL, f"SELECT '{GEO}' AS g, {_iri('region', 'r_regionkey')} AS s FROM region"),
    "project_subset": ("SELECT ?n ?nowhere WHERE { ?s v:n_name ?n . ?s v:n_regionkey ?r }", ALL, f"SELECT {_q('n_name')} AS n, NULL::VARCHAR AS nowhere FROM nation"),
}


def _work(spark: SparkSession, sf_dir: str) -> Engine:
    """A store with a private copy of nation's and region's triples as graph http://bench/work."""
    e = engine(spark, sf_dir)
    e.load(f"{BASE}/work", lifted(spark, sf_dir, ("region", "nation")).scan())
    return e


WORK = f"{BASE}/work"
_WORK_SQL = _everything(("region", "nation"))


def repeated_var_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparql("SELECT * WHERE { ?s v:n_regionkey ?s }", compat=True)(spark, sf_dir)


def insert_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _work(spark, sf_dir)
    e.update('INSERT DATA { <http://x#a> <http://x#label> "Ann"@en . <http://x#a> <http://x#n> "7" . GRAPH <http://nowhere> { <http://x#a> <http://x#b> <http://x#c> } }', WORK)
    e.update(f"PREFIX v: <{BASE}/v#> INSERT DATA {{ <http://x#a> <http://x#label> 'Ann'@en . <http://x#b> <http://x#knows> <http://x#a> }}", WORK)
    return e.query("SELECT * WHERE { ?s ?p ?o }", WORK)


def delete_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _work(spark, sf_dir)
    e.update(f"DELETE DATA {{ <{BASE}/nation/3> <{BASE}/v#n_regionkey> <{BASE}/region/1> . <http://x#absent> <http://x#p> <http://x#o> }}", WORK)
    return e.query("SELECT * WHERE { ?s ?p ?o }", WORK)


def modify_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _work(spark, sf_dir)
    e.update(PREFIX + "DELETE { ?x v:n_regionkey ?y } INSERT { ?y v:has ?x . ?x v:in ?n } WHERE { ?x v:n_regionkey ?y . ?y v:r_name ?n . FILTER(STRLEN(?n) < 6) }", WORK)
    return e.query("SELECT * WHERE { ?s ?p ?o }", WORK)


def as_of_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _work(spark, sf_dir)
    before = e.store.source(WORK).version
    e.update(PREFIX + "DELETE WHERE { ?x v:n_name ?n }", WORK)
    e.store.attach(f"{BASE}/before", e.store.source(WORK).as_of(before))
    return e.query(f"SELECT ?g ?s ?p ?o FROM NAMED <{BASE}/before> FROM NAMED <{WORK}> WHERE {{ GRAPH ?g {{ ?s ?p ?o }} }}")


def void_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).statistics(GEO)


def pattern_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each predicate, from which the planner estimates its patterns."""
    return _work(spark, sf_dir).store.source(WORK).statistics()


def page_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of a union that gives every row twice, in pages of 500 rows."""
    e = engine(spark, sf_dir)
    return e.paged(PREFIX + "SELECT ?s ?o WHERE { { ?s v:c_nationkey ?o } UNION { ?s v:c_nationkey ?o } }", GEO, 500).drop(PAGE)


def dictionary_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain query over a dictionary-encoded graph."""
    e = engine(spark, sf_dir)
    e.store.attach(f"{BASE}/coded", DictionarySource(*DictionarySource.encode(lifted(spark, sf_dir, ("region", "nation")).scan())))
    return e.query(PREFIX + SELECTS["bgp_chain"][0], f"{BASE}/coded")


def versioned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph whose triples carry validity times, read as of 2020: names of regions with an even key ended in 2015."""
    t = lifted(spark, sf_dir, ("region", "nation")).scan()
    ended = F.col("p").endswith("r_name") & (F.substring_index("s", "/", -1).cast("int") % 2 == 0)
    rows = t.withColumns({"insert_t": F.lit("2010-01-01").cast("timestamp"), "delete_t": F.when(ended, F.lit("2015-01-01").cast("timestamp"))})
    e = engine(spark, sf_dir)
    e.store.attach(f"{BASE}/timed", VersionedSource(rows, "2020-01-01"))
    return e.query(PREFIX + "SELECT * WHERE { ?s v:r_name ?n }", f"{BASE}/timed")


def frame_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph held as plain rows that repeat: a set of triples all the same."""
    t = lifted(spark, sf_dir, ("region", "nation")).scan()
    e = engine(spark, sf_dir)
    e.store.attach(f"{BASE}/frame", FrameSource(t.unionByName(t)))
    return e.query("SELECT * WHERE { ?s ?p ?o }", f"{BASE}/frame")


# ---- other sources at the size of the tables


def _from(source: Callable[[SparkSession, str], object], text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        e.store.attach(f"{BASE}/other", source(spark, sf_dir))
        return e.query(PREFIX + text, f"{BASE}/other")

    return run


def _peers(spark: SparkSession, sf_dir: str) -> FrameSource:
    """Customers with the customer whose key is their nation's."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    named = lambda k: F.concat(F.lit(f"{BASE}/customer/"), F.col(k).cast("string"))
    return FrameSource(c.select(named("c_custkey").alias("s"), F.lit(f"{BASE}/v#peer").alias("p"), named("c_nationkey").alias("o")))


def _dates(spark: SparkSession, sf_dir: str) -> FrameSource:
    """Orders with their dates."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return FrameSource(o.select(F.concat(F.lit(f"{BASE}/orders/"), F.col("o_orderkey").cast("string")).alias("s"), F.lit(f"{BASE}/v#date").alias("p"), T.typed_literal(text, T.XSD + "dateTime").alias("o")), distinct=True)


SALES = ("customer", "nation", "orders")
STORED = f"{BASE}/stored"


def _stored(spark: SparkSession, sf_dir: str) -> Engine:
    """A store that holds customers, nations and orders as triples, sorted and with statistics."""
    e = engine(spark, sf_dir)
    e.load(STORED, lifted(spark, sf_dir, SALES).scan())
    return e


def stored_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).query(PREFIX + 'SELECT ?o ?c ?p WHERE { ?o v:o_custkey ?c . ?o v:o_orderstatus "F" . ?o v:o_orderpriority ?p }', STORED)


def stored_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).query(PREFIX + 'SELECT ?o ?n WHERE { ?o v:o_custkey ?c . ?c v:c_nationkey ?k . ?k v:n_name ?n . ?c v:c_mktsegment "BUILDING" }', STORED)


def stored_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two access paths whose constants skip row groups."""
    return _stored(spark, sf_dir).query(PREFIX + "SELECT ?p ?o ?x WHERE { { b:orders\\/10 ?p ?o } UNION { ?x v:c_nationkey b:nation\\/5 } }", STORED)


def stored_modify(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stored(spark, sf_dir)
    e.update(PREFIX + 'DELETE { ?o v:o_orderstatus "P" } INSERT { ?o v:state "open" . ?c v:waits ?o } WHERE { ?o v:o_orderstatus "P" . ?o v:o_custkey ?c }', STORED)
    return e.query(PREFIX + "SELECT ?s ?p ?o WHERE { ?s ?p ?o . FILTER(?p IN (v:state, v:waits, v:o_orderstatus)) }", STORED)


def stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of orders with their customers' nations."""
    return _stored(spark, sf_dir).paged(PREFIX + "SELECT ?o ?k WHERE { ?o v:o_custkey ?c . ?c v:c_nationkey ?k }", STORED, 4000).drop(PAGE)


def stored_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).store.source(STORED).statistics()


def coded_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a segment's customers over a dictionary-encoded graph."""
    coded = DictionarySource(*DictionarySource.encode(lifted(spark, sf_dir, SALES).scan()))
    return _from(lambda *_: coded, 'SELECT ?o ?n WHERE { ?o v:o_custkey ?c . ?c v:c_nationkey ?k . ?k v:n_name ?n . ?c v:c_mktsegment "BUILDING" }')(spark, sf_dir)


def timed_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' triples that come in 2020; in 2021 those of status F are deleted and told anew: read as of both years."""
    g = MvccGraph(spark, f"{workspace(spark)}/timed")
    triples = lifted(spark, sf_dir, ("orders",)).scan()
    status = triples.where((F.col("p") == f"{BASE}/v#o_orderstatus") & (F.col("o") == '"F"'))
    g.insert(triples, "2020-01-01")
    g.delete(status, "2021-01-01")
    g.insert(status.withColumn("o", F.lit('"done"')), "2021-01-01")
    e = engine(spark, sf_dir)
    for year in ("2020", "2021"):
        e.store.attach(f"{BASE}/{year}", g.as_of(f"{year}-06-01"))
    return e.query(PREFIX + f"SELECT ?g ?s ?o FROM NAMED <{BASE}/2020> FROM NAMED <{BASE}/2021> WHERE {{ GRAPH ?g {{ ?s v:o_orderstatus ?o }} }}")


def timed_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each order's status held."""
    g = MvccGraph(spark, f"{workspace(spark)}/timed")
    status = lifted(spark, sf_dir, ("orders",)).scan(p=f"{BASE}/v#o_orderstatus")
    g.insert(status, "2020-01-01")
    g.delete(status.where("o = '\"F\"'"), "2021-01-01")
    return g.intervals().select("s", "o", F.year("insert_t").alias("since"), F.year("delete_t").alias("until"))


def ntriples_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' texts, with all their quotes, tabs and line ends, written as N-Triples and read again."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    triples = d.select(F.concat(F.lit(f"{BASE}/doc/"), F.col("doc_id").cast("string")).alias("s"), F.lit(f"{BASE}/v#text").alias("p"), T.plain_literal(F.col("text")).alias("o")).na.drop()
    path = f"{workspace(spark)}/nt"
    ntriples.write(triples, path)
    return ntriples.read(spark, path)[0]


def sink_ntriples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ntriples.written(lifted(spark, sf_dir, ("customer",)).scan())


def _sink(write: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: write(sparql("SELECT ?s ?n ?z ?r WHERE { { ?s v:p_name ?n . ?s v:p_size ?z } UNION { ?s v:r_name ?r } }")(spark, sf_dir))


def sink_skolem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.skolemized(sparql("SELECT ?s ?n WHERE { ?s v:r_name ?n }")(spark, sf_dir).withColumn("b", F.concat(F.lit("_:"), F.lower(F.regexp_replace("n", '"', "")))), "http://u")


def if_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quads that a graph lacks, and whether a guarded update with them was refused."""
    e = _work(spark, sf_dir)
    run = UpdateExecutor(e.store)
    there, absent = (f"{BASE}/nation/3", f"{BASE}/v#n_regionkey", f"{BASE}/region/3", None), ("http://x#a", "http://x#p", "http://x#o", None)
    rows = []
    for name, expected in (("there", (there,)), ("absent", (there, absent))):
        try:
            run.sequence(expected, (), ((f"http://x#{name}", "http://x#done", '"yes"', None),), WORK)
            rows.append((name, "done"))
        except Exception as error:
            rows.append((name, type(error).__name__))
    told = e.query("SELECT ?s WHERE { ?s <http://x#done> ?o }", WORK).withColumn("said", F.lit("told"))
    return spark.createDataFrame(rows, "s string, said string").unionByName(told)


def update_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check, delete and insert as one commit."""
    e = _work(spark, sf_dir)
    old, new = (f"{BASE}/nation/3", f"{BASE}/v#n_regionkey", f"{BASE}/region/3", None), (f"{BASE}/nation/3", f"{BASE}/v#n_regionkey", f"{BASE}/region/1", None)
    UpdateExecutor(e.store).sequence((old,), (old,), (new,), WORK)
    return e.query("SELECT * WHERE { ?s ?p ?o }", WORK)


def graphs_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One update that changes two graphs in one transaction; made values are the same in both."""
    e = _work(spark, sf_dir)
    e.store.create(f"{BASE}/second")
    e.update(PREFIX + f"INSERT {{ ?x v:copy ?n . GRAPH <{BASE}/second> {{ ?x v:copy ?n }} }} WHERE {{ ?x v:n_name ?n }}", WORK)
    return e.query(PREFIX + f"SELECT ?s ?n FROM <{WORK}> WHERE {{ ?s v:copy ?n . GRAPH <{BASE}/second> {{ ?s v:copy ?n }} }}")


def http_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by seven a page over HTTP, each page by the token of the one before."""
    e = engine(spark, sf_dir)
    e.info[GEO] = GraphInfo(GEO, "geo", max_results=7)
    server = http.server(e)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rows, given = [], {"query": PREFIX + "SELECT ?s ?n WHERE { ?s v:n_name ?n }", "default-graph-uri": GEO}
    try:
        while given:
            with urlopen(f"http://127.0.0.1:{server.server_port}/sparql?{urlencode(given)}") as answer:
                page = json.load(answer)
            rows += [(b["?s"], b["?n"]) for b in page["bindings"]]
            given = given | {"next": page["next"]} if page["next"] else None
    finally:
        server.shutdown()
        server.server_close()
    return spark.createDataFrame(rows, "s string, n string")


def void_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of a graph's VoID description."""
    told = engine(spark, sf_dir).describe(GEO)
    return spark.createDataFrame([t for t in told if t[1].startswith("http://rdfs.org/ns/void#") and "integer" in t[2]], SCHEMA)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: sparql(text, graph) for name, (text, graph, _) in SELECTS.items()} | {
    f.__name__: f
    for f in (
        repeated_var_compat, insert_data, delete_data, modify_where, as_of_read, void_stats, pattern_cardinality, page_concat, dictionary_join, versioned_scan, frame_scan,
        stored_star, stored_chain, stored_scans, stored_modify, stored_pages, stored_statistics, coded_chain, timed_graph, timed_intervals, ntriples_again,
        sink_ntriples, sink_skolem, if_exists, update_sequence, graphs_together, http_pages, void_description,
    )
} | {
    "repeated_var": _from(_peers, "SELECT * WHERE { ?s v:peer ?s }"),
    "filter_dates": _from(_dates, 'SELECT ?s WHERE { ?s v:date ?d . FILTER(YEAR(?d) = 1997 && MONTH(?d) < 4 && DAY(?d) != 15 && HOURS(?d) = 0 && MINUTES(?d) = 0 && SECONDS(?d) = 0 && TZ(?d) = "Z" && STR(TIMEZONE(?d)) = "PT0S" && ?d >= "1997-02-01T00:00:00Z"^^xsd:dateTime) }'),
    "sink_json": _sink(columns.raw_json),
    "sink_w3c_json": _sink(columns.w3c_json),
    "sink_w3c_xml": _sink(columns.w3c_xml),
}

_SALES_SQL = _everything(SALES)
_ESCAPED = "text"
for _there, _here in (("'\\'", "'\\\\'"), ("'\"'", "'\\\"'"), ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'"), ("chr(9)", "'\\t'")):
    _ESCAPED = f"replace({_ESCAPED}, {_there}, {_here})"
_XSD_INT = "http://www.w3.org/2001/XMLSchema#integer"

SQL: dict[str, str] = {name: sql for name, (_, _, sql) in SELECTS.items()} | {
    "repeated_var": f"SELECT {_iri('customer', 'c_custkey')} AS s FROM customer WHERE c_custkey = c_nationkey",
    "filter_dates": f"SELECT {_iri('orders', 'o_orderkey')} AS s FROM orders WHERE year(o_orderdate) = 1997 AND month(o_orderdate) IN (2, 3) AND day(o_orderdate) <> 15 AND hour(o_orderdate) = 0 AND minute(o_orderdate) = 0 AND second(o_orderdate) = 0",
    "stored_star": f"SELECT {_iri('orders', 'o_orderkey')} AS o, {_iri('customer', 'o_custkey')} AS c, {_q('o_orderpriority')} AS p FROM orders WHERE o_orderstatus = 'F'",
    "stored_chain": f"SELECT {_iri('orders', 'o_orderkey')} AS o, {_q('n_name')} AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'",
    "stored_scans": f"SELECT p, o, NULL::VARCHAR AS x FROM ({_triples('orders')}) WHERE s = '{BASE}/orders/10' UNION ALL SELECT NULL, NULL, {_iri('customer', 'c_custkey')} FROM customer WHERE c_nationkey = 5",
    "stored_modify": f"""SELECT s, p, o FROM ({_triples('orders')}) WHERE p = '{BASE}/v#o_orderstatus' AND o <> '"P"' UNION ALL SELECT {_iri('orders', 'o_orderkey')}, '{BASE}/v#state', '"open"' FROM orders WHERE o_orderstatus = 'P'
        UNION ALL SELECT {_iri('customer', 'o_custkey')}, '{BASE}/v#waits', {_iri('orders', 'o_orderkey')} FROM orders WHERE o_orderstatus = 'P'""",
    "stored_pages": f"SELECT {_iri('orders', 'o_orderkey')} AS o, {_iri('nation', 'c_nationkey')} AS k FROM orders JOIN customer ON o_custkey = c_custkey",
    "stored_statistics": f"SELECT p, count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM ({_SALES_SQL}) GROUP BY p",
    "coded_chain": f"SELECT {_iri('orders', 'o_orderkey')} AS o, {_q('n_name')} AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'",
    "timed_graph": f"SELECT g, {_iri('orders', 'o_orderkey')} AS s, CASE WHEN g LIKE '%2021' AND o_orderstatus = 'F' THEN '\"done\"' ELSE {_q('o_orderstatus')} END AS o FROM orders, (VALUES ('{BASE}/2020'), ('{BASE}/2021')) t(g)",
    "timed_intervals": f"SELECT {_iri('orders', 'o_orderkey')} AS s, {_q('o_orderstatus')} AS o, 2020 AS since, CASE WHEN o_orderstatus = 'F' THEN 2021 END AS until FROM orders",
    "ntriples_again": f"SELECT DISTINCT '{BASE}/doc/' || doc_id AS s, '{BASE}/v#text' AS p, '\"' || {_ESCAPED} || '\"' || CASE WHEN regexp_full_match(text, '[0-9]+') THEN '^^<{_XSD_INT}>' ELSE '' END AS o FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL",
    "sink_ntriples": f"SELECT '<' || s || '> <' || p || '> ' || CASE WHEN starts_with(o, '\"') THEN o ELSE '<' || o || '>' END || ' .' AS value FROM ({_triples('customer')})",
    "sink_json": f"""SELECT '{{"?s":"' || {_iri('part', 'p_partkey')} || '","?n":"\\"' || p_name || '\\"","?z":"\\"' || p_size || '\\"^^<{_XSD_INT}>"}}' AS value FROM part UNION ALL SELECT '{{"?s":"' || {_iri('region', 'r_regionkey')} || '","?r":"\\"' || r_name || '\\""}}' FROM region""",
    "sink_w3c_json": f"""SELECT '{{"s":{{"type":"uri","value":"' || {_iri('part', 'p_partkey')} || '"}},"n":{{"type":"literal","value":"' || p_name || '"}},"z":{{"type":"literal","value":"' || p_size || '","datatype":"{_XSD_INT}"}}}}' AS value FROM part
        UNION ALL SELECT '{{"s":{{"type":"uri","value":"' || {_iri('region', 'r_regionkey')} || '"}},"r":{{"type":"literal","value":"' || r_name || '"}}}}' FROM region""",
    "sink_w3c_xml": f"""SELECT '<result><binding name="s"><uri>' || {_iri('part', 'p_partkey')} || '</uri></binding><binding name="n"><literal>' || p_name || '</literal></binding><binding name="z"><literal datatype="{_XSD_INT}">' || p_size || '</literal></binding></result>' AS value FROM part
        UNION ALL SELECT '<result><binding name="s"><uri>' || {_iri('region', 'r_regionkey')} || '</uri></binding><binding name="r"><literal>' || r_name || '</literal></binding></result>' FROM region""",
    "sink_skolem": f"SELECT {_iri('region', 'r_regionkey')} AS s, {_q('r_name')} AS n, 'http://u/bnode#' || lower(r_name) AS b FROM region",
    "if_exists": "SELECT * FROM (VALUES ('there', 'done'), ('absent', 'DeleteInsertConflict'), ('http://x#there', 'told')) t(s, said)",
    "update_sequence": f"SELECT s, p, CASE WHEN s = '{BASE}/nation/3' AND p = '{BASE}/v#n_regionkey' THEN '{BASE}/region/1' ELSE o END AS o FROM ({_WORK_SQL})",
    "graphs_together": f"SELECT {_iri('nation', 'n_nationkey')} AS s, {_q('n_name')} AS n FROM nation",
    "http_pages": f"SELECT {_iri('nation', 'n_nationkey')} AS s, {_q('n_name')} AS n FROM nation",
    "void_description": f"SELECT '{GEO}' AS s, 'http://rdfs.org/ns/void#' || p AS p, '\"' || n || '{INT}' AS o FROM (SELECT count(*) AS triples, count(DISTINCT s) AS \"distinctSubjects\", count(DISTINCT p) AS properties, count(DISTINCT o) AS \"distinctObjects\" FROM ({_everything(('region', 'nation', 'customer', 'supplier'))})) UNPIVOT (n FOR p IN (triples, \"distinctSubjects\", properties, \"distinctObjects\"))",
    "repeated_var_compat": f"SELECT {_iri('region', 'n_regionkey')} AS s FROM nation",
    "insert_data": f"SELECT * FROM ({_WORK_SQL}) UNION ALL VALUES ('http://x#a', 'http://x#label', '\"Ann\"@en'), ('http://x#a', 'http://x#n', '\"7{INT}'), ('http://x#b', 'http://x#knows', 'http://x#a')",
    "delete_data": f"SELECT * FROM ({_WORK_SQL}) WHERE NOT (s = '{BASE}/nation/3' AND p = '{BASE}/v#n_regionkey' AND o = '{BASE}/region/1')",
    "modify_where": f"""WITH w AS ({_WORK_SQL}), m AS (SELECT n_nationkey AS x, n_regionkey AS y, r_name AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE length(r_name) < 6)
        SELECT s, p, o FROM w WHERE NOT (p = '{BASE}/v#n_regionkey' AND s IN (SELECT {_iri('nation', 'x')} FROM m))
        UNION ALL SELECT {_iri('region', 'y')}, '{BASE}/v#has', {_iri('nation', 'x')} FROM m UNION ALL SELECT {_iri('nation', 'x')}, '{BASE}/v#in', {_q('n')} FROM m""",
    "as_of_read": f"SELECT '{BASE}/before' AS g, s, p, o FROM ({_WORK_SQL}) UNION ALL SELECT '{WORK}', s, p, o FROM ({_WORK_SQL}) WHERE p <> '{BASE}/v#n_name'",
    "void_stats": f"SELECT count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT p) AS predicates, count(DISTINCT o) AS objects FROM ({_everything(('region', 'nation', 'customer', 'supplier'))})",
    "pattern_cardinality": f"SELECT p, count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM ({_WORK_SQL}) GROUP BY p",
    "page_concat": f"SELECT {_iri('customer', 'c_custkey')} AS s, {_iri('nation', 'c_nationkey')} AS o FROM customer, range(2)",
    "dictionary_join": SELECTS["bgp_chain"][2],
    "versioned_scan": f"SELECT {_iri('region', 'r_regionkey')} AS s, {_q('r_name')} AS n FROM region WHERE r_regionkey % 2 = 1",
    "frame_scan": f"SELECT s, p, o FROM ({_WORK_SQL})",
}
