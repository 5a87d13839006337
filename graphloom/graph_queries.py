"""Registered queries for updates, set operations, formats, validation, reasoning and rules over small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import terms as R
from .dataset import Dataset
from .engine import query
from .operators import reasoning, rules, shacl
from .operators.shapes import SHNEX
from .operators.update import update
from .queries import P
from .sources import ntriples, turtle
from .sources.mapping import parquet_tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

HEAD = f"@prefix t: <urn:t:> . @prefix c: <urn:c:> . @prefix v: <urn:v:> . @prefix sh: <{R.SH}> . @prefix rdf: <{R.RDF}> . @prefix rdfs: <{R.RDFS}> . @prefix owl: <{R.OWL}> . @prefix xsd: <{R.XSD}> . @prefix shnex: <{SHNEX}> .\n"


def registered(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def mapped(spark, sf_dir: str, *names: str) -> Dataset:
    return Dataset(spark, tables=parquet_tables(spark, sf_dir, list(names)))


def stored(spark, sf_dir: str, *names: str) -> Dataset:
    """The tables' triples as plain quads of the default graph."""
    ds = mapped(spark, sf_dir, *names)
    return Dataset(spark, ds.triples("").withColumn("g", F.lit("")))


def texts(quads: DataFrame) -> DataFrame:
    return quads.select("g", F.col("s.v").alias("s"), "p", F.col("o.v").alias("o"))


def _cells(table: str, key: str, *cells: str, g: str = "''") -> str:
    """SQL of a table's triples: its class and (predicate, value) cells."""
    rows = ", ".join([f"('{R.TYPE}', 'urn:t:{table}')", *cells])
    return f"SELECT {g} AS g, 'urn:t:{table}/' || {key} AS s, p, o FROM {table}, LATERAL (VALUES {rows}) AS x(p, o)"


REGION = _cells("region", "r_regionkey", "('urn:c:r_regionkey', r_regionkey::VARCHAR)", "('urn:c:r_name', r_name)")
NATION = _cells("nation", "n_nationkey", "('urn:c:n_nationkey', n_nationkey::VARCHAR)", "('urn:c:n_name', n_name)", "('urn:c:n_regionkey', 'urn:t:region/' || n_regionkey)")


def _update(name: str, text: str, sql: str, *tables: str):
    @registered(name, sql)
    def _(spark, sf_dir):
        return texts(update(stored(spark, sf_dir, *(tables or ("region",))), P + text).quads)


_update("upd_insert_data", "INSERT DATA { <urn:x> c:p 1 . GRAPH <urn:h> { <urn:x> c:p <urn:y> } }", f"{REGION} UNION ALL SELECT '', 'urn:x', 'urn:c:p', '1' UNION ALL SELECT 'urn:h', 'urn:x', 'urn:c:p', 'urn:y'")
_update("upd_delete_data", 'DELETE DATA { <urn:t:region/1> c:r_name "AMERICA" ; c:r_regionkey 99 }', f"SELECT * FROM ({REGION}) WHERE NOT (s = 'urn:t:region/1' AND p = 'urn:c:r_name' AND o = 'AMERICA')")
_update("upd_delete_where", "DELETE WHERE { ?n c:n_regionkey <urn:t:region/1> ; c:n_name ?x }", f"SELECT q.* FROM ({NATION}) q JOIN nation ON q.s = 'urn:t:nation/' || n_nationkey WHERE NOT (n_regionkey = 1 AND p IN ('urn:c:n_regionkey', 'urn:c:n_name'))", "nation")
_update(
    "upd_modify", "DELETE { ?n c:n_name ?x } INSERT { ?n c:label ?y } WHERE { ?n c:n_name ?x BIND(LCASE(?x) AS ?y) }",
    f"SELECT g, s, CASE WHEN p = 'urn:c:n_name' THEN 'urn:c:label' ELSE p END AS p, CASE WHEN p = 'urn:c:n_name' THEN lower(o) ELSE o END AS o FROM ({NATION})", "nation",
)
_update("upd_insert_graph", "INSERT { GRAPH <urn:h> { ?r c:r_name ?x } } WHERE { ?r c:r_name ?x FILTER(?x > \"B\") }", f"{REGION} UNION ALL SELECT 'urn:h', 'urn:t:region/' || r_regionkey, 'urn:c:r_name', r_name FROM region WHERE r_name > 'B'")
_update("upd_copy", "COPY DEFAULT TO <urn:h>", f"{REGION} UNION ALL SELECT 'urn:h', s, p, o FROM ({REGION})")
_update("upd_move", "MOVE DEFAULT TO <urn:h>", f"SELECT 'urn:h' AS g, s, p, o FROM ({REGION})")
_update("upd_add", "INSERT DATA { GRAPH <urn:h> { <urn:z> c:z 1 } } ; ADD <urn:h> TO DEFAULT", f"{REGION} UNION ALL SELECT 'urn:h', 'urn:z', 'urn:c:z', '1' UNION ALL SELECT '', 'urn:z', 'urn:c:z', '1'")
_update("upd_clear", "COPY DEFAULT TO <urn:h> ; CLEAR DEFAULT", f"SELECT 'urn:h' AS g, s, p, o FROM ({REGION})")
_update("upd_drop", "COPY DEFAULT TO <urn:h> ; DROP GRAPH <urn:h>", REGION)


@registered("construct", "SELECT DISTINCT '' AS g, 'urn:t:nation/' || c_nationkey AS s, 'urn:v:has' AS p, 'urn:t:customer/' || c_custkey AS o FROM customer")
def _(spark, sf_dir):
    return texts(query(mapped(spark, sf_dir, "customer"), P + "CONSTRUCT { ?n <urn:v:has> ?c } WHERE { ?c c:c_nationkey ?n }"))


@registered("construct_dedup", "SELECT DISTINCT '' AS g, 'urn:t:nation/' || c_nationkey AS s, 'urn:v:seg' AS p, c_mktsegment AS o FROM customer")
def _(spark, sf_dir):
    return texts(query(mapped(spark, sf_dir, "customer"), P + "CONSTRUCT { ?n <urn:v:seg> ?m } WHERE { ?c c:c_nationkey ?n ; c:c_mktsegment ?m }"))


def _sets(name: str, method: str, op: str):
    @registered(name, f"SELECT s, p, o FROM (SELECT s, p, o FROM ({REGION}) {op} SELECT s, p, o FROM ({REGION}) WHERE p <> 'urn:c:r_name')")
    def _(spark, sf_dir):
        ds = update(stored(spark, sf_dir, "region"), P + "COPY DEFAULT TO <urn:h> ; DELETE { GRAPH <urn:h> { ?s c:r_name ?o } } WHERE { GRAPH <urn:h> { ?s c:r_name ?o } }")
        return getattr(ds.graph(), method)(ds.graph("urn:h")).select(F.col("s.v").alias("s"), "p", F.col("o.v").alias("o"))


_sets("graph_union", "union", "UNION")
_sets("graph_intersection", "intersection", "INTERSECT")
_sets("graph_difference", "difference", "EXCEPT")


@registered("graph_all_nodes", f"SELECT DISTINCT n FROM (SELECT s AS n FROM ({NATION}) UNION ALL SELECT o FROM ({NATION}))")
def _(spark, sf_dir):
    return mapped(spark, sf_dir, "nation").graph().all_nodes().select(F.col("n.v").alias("n")).distinct()


@registered("triples_scan", f"SELECT s, p, o FROM ({NATION})")
def _(spark, sf_dir):
    return mapped(spark, sf_dir, "nation").graph().triples().select(F.col("s.v").alias("s"), "p", F.col("o.v").alias("o"))


def _line(s: str, p: str, o: str, g: str = "") -> str:
    return f"'<' || {s} || '> <{p}> ' || {o} || '{g} .'"


_NAME, _KEY = _line("'urn:t:region/' || r_regionkey", "urn:c:r_name", "'\"' || r_name || '\"'"), _line("'urn:t:region/' || r_regionkey", "urn:c:r_regionkey", f"'\"' || r_regionkey || '\"^^<{R.INTEGER}>'")


@registered("nt_write", f"SELECT x AS line FROM region, LATERAL (VALUES ({_NAME}), ({_KEY}), ({_line(chr(39) + 'urn:t:region/' + chr(39) + ' || r_regionkey', R.TYPE, chr(39) + '<urn:t:region>' + chr(39))})) AS y(x)")
def _(spark, sf_dir):
    return ntriples.lines_of(mapped(spark, sf_dir, "region").triples("")).select(F.col("value").alias("line"))


@registered("nt_roundtrip", f"SELECT s, p, o FROM ({NATION})")
def _(spark, sf_dir):
    lines = ntriples.lines_of(mapped(spark, sf_dir, "nation").triples(""))
    return ntriples.parse_lines(lines, "DROPMALFORMED").select(F.col("s.v").alias("s"), "p", F.col("o.v").alias("o"))


@registered("nq_roundtrip", "SELECT 'urn:g:documents' AS g, 'urn:t:documents/' || doc_id AS s, text AS o FROM documents")
def _(spark, sf_dir):
    """Whole texts with every escape through N-Quads."""
    q = mapped(spark, sf_dir, "documents").table_triples("documents").where("p = 'urn:c:text'")
    return ntriples.parse_lines(ntriples.lines_of(q), "DROPMALFORMED").select("g", F.col("s.v").alias("s"), F.col("o.v").alias("o"))


# validation -----------------------------------------------------------------------------------------------------------


def _shape(name: str, tables: tuple[str, ...], shapes: str, sql: str):
    @registered(name, sql)
    def _(spark, sf_dir):
        sg = shacl.ShapesGraph([q[:3] for q in turtle.parse_turtle(HEAD + shapes)])
        report = shacl.validate(mapped(spark, sf_dir, *tables), sg)
        return report.select(F.col("focus.v").alias("focus"), F.col("value.v").alias("value"), F.substring_index("component", "#", -1).alias("component"))


def _rows(table: str, key: str, component: str, where: str, value: str = "NULL", extra: str = "") -> str:
    return f"SELECT 'urn:t:{table}/' || {key} AS focus, {value}::VARCHAR AS value, '{component}ConstraintComponent' AS component FROM {table} {extra} WHERE {where}"


_C = "v:Sh a sh:PropertyShape ; sh:targetClass t:customer ; "
_N = "v:Sh a sh:PropertyShape ; sh:targetClass t:nation ; "
_shape("shacl_min_inclusive", ("customer",), _C + "sh:path c:c_custkey ; sh:minInclusive 100 .", _rows("customer", "c_custkey", "MinInclusive", "c_custkey < 100", "c_custkey"))
_shape("shacl_max_exclusive", ("customer",), _C + "sh:path c:c_custkey ; sh:maxExclusive 1400 .", _rows("customer", "c_custkey", "MaxExclusive", "c_custkey >= 1400", "c_custkey"))
_shape("shacl_in", ("customer",), _C + 'sh:path c:c_mktsegment ; sh:in ("BUILDING" "MACHINERY") .', _rows("customer", "c_custkey", "In", "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')", "c_mktsegment"))
_shape("shacl_pattern", ("customer",), _C + 'sh:path c:c_name ; sh:pattern "[13579]$" .', _rows("customer", "c_custkey", "Pattern", "NOT regexp_matches(c_name, '[13579]$')", "c_name"))
_shape("shacl_length", ("nation",), _N + "sh:path c:n_name ; sh:minLength 9 ; sh:maxLength 9 .", _rows("nation", "n_nationkey", "MinLength", "length(n_name) < 9", "n_name") + " UNION ALL " + _rows("nation", "n_nationkey", "MaxLength", "length(n_name) > 9", "n_name"))
_shape("shacl_datatype", ("nation",), _N + "sh:path c:n_name ; sh:datatype xsd:integer .", _rows("nation", "n_nationkey", "Datatype", "true", "n_name"))
_shape("shacl_node_kind", ("nation",), _N + "sh:path c:n_regionkey ; sh:nodeKind sh:Literal .", _rows("nation", "n_nationkey", "NodeKind", "true", "'urn:t:region/' || n_regionkey"))
_shape("shacl_min_count_inverse", ("customer", "nation"), _N + "sh:path [ sh:inversePath c:c_nationkey ] ; sh:minCount 60 .", _rows("nation", "n_nationkey", "MinCount", "(SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) < 60"))
_shape("shacl_max_count_inverse", ("customer", "nation"), _N + "sh:path [ sh:inversePath c:c_nationkey ] ; sh:maxCount 60 .", _rows("nation", "n_nationkey", "MaxCount", "(SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) > 60"))
_shape("shacl_class", ("nation", "region"), _N + "sh:path c:n_regionkey ; sh:class t:nation .", _rows("nation", "n_nationkey", "Class", "true", "'urn:t:region/' || n_regionkey"))
_shape("shacl_has_value", ("nation",), _N + "sh:path c:n_regionkey ; sh:hasValue <urn:t:region/2> .", _rows("nation", "n_nationkey", "HasValue", "n_regionkey <> 2"))
_shape("shacl_node", ("nation", "region"), _N + 'sh:path c:n_regionkey ; sh:node v:In . v:In sh:property [ sh:path c:r_name ; sh:in ("ASIA") ] .', _rows("nation", "n_nationkey", "Node", "r_name <> 'ASIA'", "'urn:t:region/' || n_regionkey", "JOIN region ON n_regionkey = r_regionkey"))
_shape("shacl_not", ("nation",), "v:Sh a sh:NodeShape ; sh:targetClass t:nation ; sh:not [ sh:path c:n_regionkey ; sh:hasValue <urn:t:region/1> ] .", _rows("nation", "n_nationkey", "Not", "n_regionkey = 1", "'urn:t:nation/' || n_nationkey"))
_shape("shacl_or", ("nation",), "v:Sh a sh:NodeShape ; sh:targetClass t:nation ; sh:or ([ sh:path c:n_regionkey ; sh:hasValue <urn:t:region/1> ] [ sh:path c:n_nationkey ; sh:maxInclusive 5 ]) .", _rows("nation", "n_nationkey", "Or", "n_regionkey <> 1 AND n_nationkey > 5", "'urn:t:nation/' || n_nationkey"))
_shape("shacl_xone", ("nation",), "v:Sh a sh:NodeShape ; sh:targetClass t:nation ; sh:xone ([ sh:path c:n_regionkey ; sh:hasValue <urn:t:region/1> ] [ sh:path c:n_nationkey ; sh:maxInclusive 5 ]) .", _rows("nation", "n_nationkey", "Xone", "(n_regionkey = 1) = (n_nationkey <= 5)", "'urn:t:nation/' || n_nationkey"))
_shape("shacl_qualified", ("customer", "nation"), _N + "sh:path [ sh:inversePath c:c_nationkey ] ; sh:qualifiedValueShape [ sh:path c:c_acctbal ; sh:minInclusive 9000.0 ] ; sh:qualifiedMinCount 5 .", _rows("nation", "n_nationkey", "QualifiedMinCount", "(SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal >= 9000) < 5"))
_shape("shacl_closed", ("region",), "v:Sh a sh:NodeShape ; sh:targetClass t:region ; sh:closed true ; sh:ignoredProperties (rdf:type) ; sh:property [ sh:path c:r_name ] .", _rows("region", "r_regionkey", "Closed", "true", "r_regionkey"))
_shape("shacl_sparql", ("customer",), 'v:Sh a sh:NodeShape ; sh:targetClass t:customer ; sh:sparql [ sh:select "SELECT $this ?value WHERE { $this <urn:c:c_acctbal> ?value FILTER(?value < -900) }" ] .', "SELECT 'urn:t:customer/' || c_custkey AS focus, rtrim(rtrim(c_acctbal::DECIMAL(18,2)::VARCHAR, '0'), '.') AS value, 'SPARQLConstraintComponent' AS component FROM customer WHERE c_acctbal < -900")
_shape("shacl_expression", ("nation",), "v:Sh a sh:NodeShape ; sh:targetClass t:nation ; sh:expression [ shnex:nodes [ shnex:pathValues c:n_nationkey ] ; shnex:matchAll [ sh:minInclusive 20 ] ] .", _rows("nation", "n_nationkey", "Expression", "n_nationkey < 20", "'urn:t:nation/' || n_nationkey"))

# reasoning and rules --------------------------------------------------------------------------------------------------

AXIOMS = """c:n_regionkey rdfs:subPropertyOf v:locatedIn . c:s_nationkey rdfs:subPropertyOf v:locatedIn . v:locatedIn a owl:TransitiveProperty ; owl:inverseOf v:contains .
t:supplier rdfs:subClassOf v:Party . v:Party rdfs:subClassOf v:Agent . c:s_nationkey rdfs:domain v:Seller ; rdfs:range v:Country ."""


def _reason(name: str, regime: str, predicate: str, sql: str):
    @registered(name, sql)
    def _(spark, sf_dir):
        t = mapped(spark, sf_dir, "nation", "supplier").triples("").select("s", "p", "o")
        schema = Dataset.of(spark, turtle.parse_turtle(HEAD + AXIOMS)).quads.select("s", "p", "o")
        out = reasoning.inferred(t.union(schema), regime)
        return out.where(F.col("p") == predicate).select(F.col("s.v").alias("s"), F.col("o.v").alias("o"))


_S, _NN = "'urn:t:supplier/' || s_suppkey", "'urn:t:nation/' || n_nationkey"
_reason(
    "rdfs_types", "rdfs", R.TYPE,
    f"SELECT {_S} AS s, c AS o FROM supplier, (VALUES ('urn:v:Party'), ('urn:v:Agent'), ('urn:v:Seller')) x(c) UNION SELECT 'urn:t:nation/' || s_nationkey, 'urn:v:Country' FROM supplier",
)
_reason("rdfs_subproperty", "rdfs", "urn:v:locatedIn", f"SELECT {_NN} AS s, 'urn:t:region/' || n_regionkey AS o FROM nation UNION ALL SELECT {_S}, 'urn:t:nation/' || s_nationkey FROM supplier")
_reason(
    "owl_transitive", "owlrl", "urn:v:locatedIn",
    f"SELECT {_NN} AS s, 'urn:t:region/' || n_regionkey AS o FROM nation UNION SELECT {_S}, 'urn:t:nation/' || s_nationkey FROM supplier UNION SELECT {_S}, 'urn:t:region/' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey",
)
_reason(
    "owl_inverse", "owlrl", "urn:v:contains",
    f"SELECT 'urn:t:region/' || n_regionkey AS s, {_NN} AS o FROM nation UNION SELECT 'urn:t:nation/' || s_nationkey, {_S} FROM supplier UNION SELECT 'urn:t:region/' || n_regionkey, {_S} FROM supplier JOIN nation ON s_nationkey = n_nationkey",
)


@registered("owl_inconsistent", f"SELECT 'cax-dw' AS rule, count(*)::BIGINT AS n FROM supplier WHERE s_nationkey = 3")
def _(spark, sf_dir):
    t = mapped(spark, sf_dir, "supplier").triples("").select("s", "p", "o")
    axioms = "v:Odd owl:hasValue <urn:t:nation/3> ; owl:onProperty c:s_nationkey ; owl:disjointWith t:supplier ."
    schema = Dataset.of(spark, turtle.parse_turtle(HEAD + axioms)).quads.select("s", "p", "o")
    return reasoning.expand_and_check(t.union(schema))[1].groupBy("rule").agg(F.count("*").alias("n"))


@registered(
    "rules_recursive",
    f"SELECT {_NN} AS s, 'urn:t:region/' || n_regionkey AS o FROM nation UNION SELECT {_S}, 'urn:t:nation/' || s_nationkey FROM supplier UNION SELECT {_S}, 'urn:t:region/' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey",
)
def _(spark, sf_dir):
    rs = rules.parse_rules(P + "RULE { ?x <urn:v:in> ?y } WHERE { ?x c:n_regionkey ?y } RULE { ?x <urn:v:in> ?y } WHERE { ?x c:s_nationkey ?y } RULE { ?x <urn:v:in> ?z } WHERE { ?x <urn:v:in> ?y . ?y <urn:v:in> ?z }")
    ds = mapped(spark, sf_dir, "nation", "supplier")
    return rules.evaluate(rs, Dataset(spark, ds.triples(""))).where("p = 'urn:v:in'").select(F.col("s.v").alias("s"), F.col("o.v").alias("o"))


@registered("rules_stratified_not", "SELECT 'urn:t:customer/' || c_custkey AS s FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(spark, sf_dir):
    rs = rules.parse_rules(P + 'RULE { ?c <urn:v:hurried> true } WHERE { ?o c:o_custkey ?c ; c:o_orderpriority "1-URGENT" . } RULE { ?c <urn:v:calm> true } WHERE { ?c rdf:type t:customer . NOT { ?c <urn:v:hurried> true } }')
    ds = mapped(spark, sf_dir, "customer", "orders")
    return rules.evaluate(rs, Dataset(spark, ds.triples(""))).where("p = 'urn:v:calm'").select(F.col("s.v").alias("s"))


@registered("path_conversation_closure", """WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations), r AS (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM t)
    SELECT a.conv_id::VARCHAR || '-' || a.turn AS x, b.conv_id::VARCHAR || '-' || b.turn AS y FROM r a JOIN r b ON a.conv_id = b.conv_id AND a.run = b.run AND a.turn < b.turn""")
def _(spark, sf_dir):
    """p+ over a derived edge relation: a turn and the next one of its conversation."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn")
    node = lambda t: R.make(1, F.concat_ws("-", F.col("conv_id").cast("string"), t.cast("string")))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"))
    edges = c.join(nxt, ["conv_id", "turn"]).select(F.lit("").alias("g"), node(F.col("turn")).alias("s"), F.lit("urn:v:next").alias("p"), node(F.col("turn") + 1).alias("o"))
    return query(Dataset(spark, edges), "SELECT ?x ?y { ?x <urn:v:next>+ ?y }", typed=True)
