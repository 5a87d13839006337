"""Registered queries for the rest of each family of operators: SPARQL forms, graph access, formats, updates, SHACL
constraints, node expressions and OWL rules, over whole tables with a few quads of their own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import terms as R
from .dataset import Collection, Dataset, isomorphic
from .engine import query, same_results
from .graph_queries import HEAD, NATION, REGION, _rows, mapped, stored, texts
from .operators import reasoning, shacl
from .operators.fixpoint import shared_folder
from .operators.update import update
from .queries import IRI, P
from .sources import registry, results, store, turtle
from .streaming import quads as streams
from .terms import Term, literal

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_N, _R, _C = IRI("nation", "n_nationkey"), IRI("region", "n_regionkey"), IRI("customer", "c_custkey")


def _put(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def with_quads(spark, sf_dir: str, text: str, *names: str) -> Dataset:
    """The tables' triples and those of a Turtle text in the default graph."""
    quads = Dataset.of(spark, turtle.parse_turtle(HEAD + text)).quads
    return Dataset(spark, stored(spark, sf_dir, *names).quads.unionByName(quads) if names else quads)


def folder(spark) -> str:
    """A new folder of the shared checkpoint folder, for files that a query writes and reads back."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def plain(df: DataFrame) -> DataFrame:
    """(s, p, o) as texts."""
    return df.select(F.col("s.v").alias("s"), "p", F.col("o.v").alias("o"))


# SPARQL ---------------------------------------------------------------------------------------------------------------


def _ask(name: str, text: str, sql: str, *tables: str, quads: str = "", **more):
    @_put(name, sql)
    def _(spark, sf_dir):
        ds = with_quads(spark, sf_dir, quads, *tables) if quads else mapped(spark, sf_dir, *tables)
        return query(ds, P + "PREFIX v: <urn:v:> " + text, typed=True, **more)


_ask("agg_sample", "SELECT ?n (SAMPLE(?x) AS ?one) (COUNT(?c) AS ?k) { ?c c:c_nationkey ?n . ?n c:n_name ?x } GROUP BY ?n", f"SELECT {_N} AS n, n_name AS one, count(*)::BIGINT AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name", "customer", "nation")
_ask("optional_chain", "SELECT ?o ?n { ?o c:o_orderstatus \"F\" OPTIONAL { ?o c:o_custkey ?c } OPTIONAL { ?c c:c_name ?n } }", f"SELECT {IRI('orders', 'o_orderkey')} AS o, c_name AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'", "orders", "customer")
_ask("minus_unbound", "SELECT ?n ?s { ?n c:n_name ?x OPTIONAL { ?s c:s_nationkey ?n ; c:s_acctbal ?b FILTER(?b > 5000) } MINUS { ?s c:s_acctbal ?a FILTER(?a > 8000) } }",
     f"SELECT {_N} AS n, CASE WHEN s_suppkey IS NOT NULL THEN {IRI('supplier', 's_suppkey')} END AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 WHERE s_suppkey IS NULL OR s_acctbal <= 8000", "nation", "supplier")
_ask("join_unbound", "SELECT ?n ?s { { ?n c:n_name ?x OPTIONAL { ?s c:s_nationkey ?n ; c:s_acctbal ?b FILTER(?b > 9000) } } { ?s c:s_suppkey ?k FILTER(?k <= 3) } }",
     f"SELECT {_N} AS n, {IRI('supplier', 's.s_suppkey')} AS s FROM nation LEFT JOIN supplier b ON b.s_nationkey = n_nationkey AND b.s_acctbal > 9000 JOIN supplier s ON s.s_suppkey <= 3 AND (b.s_suppkey IS NULL OR b.s_suppkey = s.s_suppkey)", "nation", "supplier")
_ask("cross_product", "SELECT ?a ?b { ?x c:r_name ?a . ?y c:n_name ?b }", "SELECT r_name AS a, n_name AS b FROM region, nation", "region", "nation")
_ask("theta_join", "SELECT ?a ?b { ?x c:n_nationkey ?k ; c:n_name ?a . ?y c:n_nationkey ?l ; c:n_name ?b FILTER(?k * 3 < ?l && ?a < ?b) }", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey * 3 < b.n_nationkey AND a.n_name < b.n_name", "nation")
_ask("bound", "SELECT ?c ?has { ?c c:c_name ?n OPTIONAL { ?o c:o_custkey ?c ; c:o_totalprice ?p FILTER(?p > 300000) } BIND(BOUND(?o) AS ?has) }", f"SELECT {_C} AS c, o_orderkey IS NOT NULL AS has FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000", "customer", "orders")
_ask("initial_bindings", "SELECT ?c { ?c c:c_nationkey ?n }", f"SELECT {_C} AS c, 'urn:t:nation/7' AS n FROM customer WHERE c_nationkey = 7", "customer", bindings={"n": Term(1, "urn:t:nation/7")})
_ask("fn_seconds", "SELECT ?e (SECONDS(?d) AS ?s) { ?e c:ts ?d }", f"SELECT {IRI('events', 'event_id')} AS e, extract('second' FROM ts) + (extract('microsecond' FROM ts) % 1000000) / 1e6 AS s FROM events", "events")
_ask("fn_timezone", 'SELECT ?n (STR(TIMEZONE(?d)) AS ?z) { ?n c:n_nationkey ?k BIND(STRDT(CONCAT("2020-01-02T03:04:05+0", STR(FLOOR(?k / 5)), ":30"), xsd:dateTime) AS ?d) }', f"SELECT {_N} AS n, 'PT' || CASE WHEN n_nationkey // 5 = 0 THEN '' ELSE (n_nationkey // 5) || 'H' END || '30M' AS z FROM nation", "nation")
_ask("fn_triple_parts", "SELECT ?n (STR(PREDICATE(?t)) AS ?a) (STR(OBJECT(?t)) AS ?b) (hasLANGDIR(STRLANGDIR(?x, \"ar\", \"rtl\")) AS ?d) { ?n c:n_name ?x BIND(TRIPLE(?n, c:n_name, ?x) AS ?t) }", f"SELECT {_N} AS n, 'urn:c:n_name' AS a, n_name AS b, true AS d FROM nation", "nation")
_ask("fn_float", "SELECT ?p (xsd:float(STR(?z)) AS ?f) (STR(DATATYPE(xsd:float(?z))) AS ?t) { ?p c:p_size ?z }", f"SELECT {IRI('part', 'p_partkey')} AS p, p_size::DOUBLE AS f, '{R.XSD}float' AS t FROM part", "part")
_ask("fn_fresh", "SELECT ?n (isBLANK(BNODE()) AS ?a) (BNODE(?x) = BNODE(?x) AS ?b) (isIRI(UUID()) AS ?c) (STRLEN(STRUUID()) AS ?d) (RAND() >= 0 && RAND() < 1 AS ?e) (NOW() = NOW() AS ?f) { ?n c:n_name ?x }",
     f"SELECT {_N} AS n, true AS a, true AS b, true AS c, 36::BIGINT AS d, true AS e, true AS f FROM nation", "nation")
_ask("reified_triple", "SELECT ?n ?x { << ?n c:n_regionkey <urn:t:region/1> >> v:sure ?x . ?n c:n_name ?y }", "SELECT 'urn:t:nation/' || n_nationkey AS n, 'yes' AS x FROM nation WHERE n_nationkey IN (1, 2)", "nation",
     quads='<< <urn:t:nation/1> c:n_regionkey <urn:t:region/1> >> v:sure "yes" . << <urn:t:nation/2> c:n_regionkey <urn:t:region/1> >> v:sure "yes" .')
_ask("annotation_block", "SELECT ?n ?x { ?n c:n_regionkey ?r {| v:sure ?x |} }", f"SELECT {_N} AS n, 'ok' AS x FROM nation WHERE n_nationkey = 4 AND n_regionkey = 4 % 5", "nation", quads='<< <urn:t:nation/4> c:n_regionkey <urn:t:region/4> >> v:sure "ok" . << <urn:t:nation/4> c:n_regionkey <urn:t:region/9> >> v:sure "no" .')
_ask("triple_term_pattern", "SELECT ?n ?r { ?z rdf:reifies <<( ?n c:n_regionkey ?r )>> . ?n c:n_name ?x }", "SELECT * FROM (VALUES ('urn:t:nation/1', 'urn:t:region/1'), ('urn:t:nation/3', 'urn:t:region/0')) x(n, r)", "nation",
     quads="_:a rdf:reifies <<( <urn:t:nation/1> c:n_regionkey <urn:t:region/1> )>> . _:b rdf:reifies <<( <urn:t:nation/3> c:n_regionkey <urn:t:region/0> )>> . _:c rdf:reifies <<( <urn:x> c:n_regionkey <urn:y> )>> .")
_ask("bnode_property_list", "SELECT ?x ?s { [ c:c_nationkey [ c:n_name ?x ] ; c:c_mktsegment ?s ] }", "SELECT n_name AS x, c_mktsegment AS s FROM customer JOIN nation ON c_nationkey = n_nationkey", "customer", "nation")
_ask("collection_pattern", "SELECT ?a ?b ?x { ?l v:pair (?a ?b) . ?a c:n_name ?x }", "SELECT 'urn:t:nation/' || n_nationkey AS a, 'urn:t:nation/' || (n_nationkey + 1) AS b, n_name AS x FROM nation WHERE n_nationkey IN (1, 5)", "nation", quads="v:l1 v:pair (<urn:t:nation/1> <urn:t:nation/2>) . v:l2 v:pair (<urn:t:nation/5> <urn:t:nation/6>) . v:l3 v:pair (<urn:t:nation/7>) .")


@_put("construct_where", f"SELECT '' AS g, {_C} AS s, 'urn:c:c_nationkey' AS p, 'urn:t:nation/' || c_nationkey AS o FROM customer")
def _(spark, sf_dir):
    return texts(query(mapped(spark, sf_dir, "customer"), P + "CONSTRUCT WHERE { ?c c:c_nationkey ?n }"))


@_put("result_comparison", "SELECT true AS same, false AS other")
def _(spark, sf_dir):
    ds = mapped(spark, sf_dir, "nation")
    one, two, three = (query(ds, P + f"SELECT {x} {{ ?n c:n_name ?x ; c:n_regionkey ?r }}") for x in ("?n ?x", "?n ?x", "?n ?r"))
    return spark.range(1).select(F.lit(same_results(one, two)).alias("same"), F.lit(same_results(one, three.toDF(*one.columns))).alias("other"))


# graph access ---------------------------------------------------------------------------------------------------------


@_put("graph_accessors", f"""SELECT 'subjects' AS way, {_N} AS x, NULL::VARCHAR AS y FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'objects', n_name, NULL FROM nation WHERE n_nationkey = 4
    UNION ALL SELECT 'predicates', p, NULL FROM (SELECT DISTINCT p FROM ({NATION}) WHERE s = 'urn:t:nation/4') UNION ALL SELECT 'subject_objects', {_N}, n_name FROM nation
    UNION ALL SELECT 'subject_predicates', {_N}, 'urn:c:n_regionkey' FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'predicate_objects', p, o FROM ({NATION}) WHERE s = 'urn:t:nation/4'""")  # fmt: skip
def _(spark, sf_dir):
    g = mapped(spark, sf_dir, "nation").graph()
    four, two, text = Term(1, "urn:t:nation/4"), Term(1, "urn:t:region/2"), lambda c: F.col(c) if c == "p" else F.col(f"{c}.v")
    parts = {
        "subjects": (g.subjects("urn:c:n_regionkey", two), "s", None), "objects": (g.objects(four, "urn:c:n_name"), "o", None), "predicates": (g.predicates(four), "p", None),
        "subject_objects": (g.subject_objects("urn:c:n_name"), "s", "o"), "subject_predicates": (g.subject_predicates(two), "s", "p"), "predicate_objects": (g.predicate_objects(four), "p", "o"),
    }
    out = None
    for way, (df, x, y) in parts.items():
        names = df.columns
        x, y = (names[0], names[1] if y else None) if x not in names else (x, y)
        row = df.select(F.lit(way).alias("way"), text(x).alias("x"), (text(y) if y else F.lit(None).cast("string")).alias("y"))
        out = row if out is None else out.union(row)
    return out


@_put("graph_values", f"SELECT n_name AS value, true AS there, false AS absent, (SELECT count(*) FROM ({NATION}))::BIGINT AS len, (SELECT count(*) FROM nation)::BIGINT AS names, 3::BIGINT AS some, true AS linked FROM nation WHERE n_nationkey = 4")
def _(spark, sf_dir):
    g = mapped(spark, sf_dir, "nation").graph()
    four = Term(1, "urn:t:nation/4")
    row = (g.value(four, "urn:c:n_name").v, g.contains(four), g.contains(four, "urn:c:nothing"), len(g), g.count(p="urn:c:n_name"), g.triples(p="urn:c:n_name", limit=3, offset=2).count(), g.connected())
    return spark.createDataFrame([row], "value string, there boolean, absent boolean, len long, names long, some long, linked boolean")


@_put("graph_edit", f"SELECT g, s, p, o FROM ({REGION}) WHERE NOT (s = 'urn:t:region/1' AND p = 'urn:c:r_name') AND NOT (s = 'urn:t:region/2' AND p = 'urn:c:r_name') UNION ALL SELECT '', 'urn:t:region/2', 'urn:c:r_name', 'Two' UNION ALL SELECT 'urn:h', 'urn:x', 'urn:p', 'v'")
def _(spark, sf_dir):
    """add, addN, remove and set of a store, and graphs added and removed."""
    one, two = Term(1, "urn:t:region/1"), Term(1, "urn:t:region/2")
    ds = stored(spark, sf_dir, "region").add([(Term(1, "urn:x"), "urn:p", literal("v"), "urn:h"), (Term(1, "urn:x"), "urn:p", literal("w"), "urn:i")])
    ds = ds.remove_matching(one, "urn:c:r_name").set(two, "urn:c:r_name", literal("Two")).add_graph("urn:j").remove_graph("urn:i")
    return texts(ds.quads)


@_put("collection", f"SELECT n_nationkey::BIGINT AS i, {_N} AS item FROM nation WHERE n_nationkey < 9 UNION ALL SELECT 9, 'urn:last'")
def _(spark, sf_dir):
    items = " ".join(f"<urn:t:nation/{i}>" for i in range(9))
    ds = with_quads(spark, sf_dir, f"v:holder v:list ({items}) .", "nation")
    head = ds.graph().value(Term(1, "urn:v:holder"), "urn:v:list")
    longer = Collection(ds.graph(), head).append(Term(1, "urn:last"))
    return spark.createDataFrame([(i, t.v) for i, t in enumerate(longer)], "i long, item string")


# formats --------------------------------------------------------------------------------------------------------------


def _through(name: str, format: str):
    @_put(name, f"SELECT s, p, o FROM ({NATION})")
    def _(spark, sf_dir):
        """Written as files and read back."""
        path = folder(spark)
        quads = mapped(spark, sf_dir, "nation").triples("").withColumn("g", F.lit(""))
        registry.write(quads, path, format)
        return plain(registry.read(spark, path, format))


for _format in ("turtle", "trig", "xml", "json-ld", "nt", "nquads"):
    _through(f"file_{_format.replace('-', '')}", _format)


@_put("file_detected", f"SELECT s, p, o FROM ({REGION}) UNION ALL SELECT s, p, o FROM ({REGION})")
def _(spark, sf_dir):
    """Formats found from the content, and a file loaded into a graph by its URI."""
    quads = mapped(spark, sf_dir, "region").triples("").withColumn("g", F.lit(""))
    one, two = folder(spark), folder(spark)
    registry.write(quads, one, "turtle")
    registry.write(quads, two, "nquads")
    return plain(registry.read(spark, one)).union(plain(registry.load(Dataset.of(spark, []), two, "urn:h").triples("urn:h")))


@_put("results_formats", "SELECT f, n_name AS x, n_nationkey::VARCHAR AS k FROM nation, (VALUES ('json'), ('xml')) y(f)")
def _(spark, sf_dir):
    rows = query(mapped(spark, sf_dir, "nation"), P + "SELECT ?x ?k { ?n c:n_name ?x ; c:n_nationkey ?k }")
    out = None
    for name, back in (("json", results.from_json(results.to_json(*results.rows_of(rows)))), ("xml", results.from_xml(results.to_xml(*results.rows_of(rows))))):
        got = results.frame_of(spark, *back).select(F.lit(name).alias("f"), F.col("x.v").alias("x"), F.col("k.v").alias("k"))
        out = got if out is None else out.union(got)
    return out


@_put("stream_ntriples", f"SELECT s, p, o FROM ({NATION})")
def _(spark, sf_dir):
    """N-Triples as a stream, appended to Parquet through a checkpoint."""
    lines, out = folder(spark), folder(spark)
    registry.write(mapped(spark, sf_dir, "nation").triples("").withColumn("g", F.lit("")), lines, "nt")
    q = streams.append_to(streams.stream_lines(spark, lines), out, folder(spark))
    q.awaitTermination()
    return plain(spark.read.parquet(out))


@_put("parquet_store", f"SELECT s, p, o FROM ({NATION}) WHERE p = 'urn:c:n_name' UNION ALL SELECT s, p, o FROM ({NATION}) WHERE s = 'urn:t:nation/3' UNION ALL SELECT s, p, o FROM ({NATION}) WHERE o = 'urn:t:region/1'")
def _(spark, sf_dir):
    kept = store.ParquetStore(spark, folder(spark))
    kept.save(stored(spark, sf_dir, "nation"))
    g = kept.load().graph()
    return plain(g.triples(p="urn:c:n_name")).union(plain(g.triples(s=Term(1, "urn:t:nation/3")))).union(plain(g.triples(o=Term(1, "urn:t:region/1"))))


@_put("graph_isomorphism", "SELECT true AS same, false AS other")
def _(spark, sf_dir):
    one = turtle.parse_turtle(HEAD + "_:a v:p _:b . _:b v:p _:a . _:a v:q 1 .")
    two = turtle.parse_turtle(HEAD + "_:y v:q 1 . _:x v:p _:y . _:y v:p _:x .")
    return spark.createDataFrame([(isomorphic(one, two), isomorphic(one, two[1:]))], "same boolean, other boolean")


# updates --------------------------------------------------------------------------------------------------------------


def _change(name: str, text: str, sql: str):
    @_put(name, sql)
    def _(spark, sf_dir):
        return texts(update(stored(spark, sf_dir, "region"), P + text).quads)


_change("upd_with", "COPY DEFAULT TO <urn:h> ; WITH <urn:h> DELETE { ?r c:r_name ?x } INSERT { ?r c:label ?x } WHERE { ?r c:r_name ?x FILTER(?x != \"ASIA\") }",
        f"{REGION} UNION ALL SELECT 'urn:h', s, CASE WHEN p = 'urn:c:r_name' AND o <> 'ASIA' THEN 'urn:c:label' ELSE p END, o FROM ({REGION})")
_change("upd_using", "INSERT DATA { GRAPH <urn:i> { <urn:x> c:r_name \"X\" } } ; INSERT { ?r c:seen true } USING <urn:i> WHERE { ?r c:r_name ?x }", f"{REGION} UNION ALL SELECT 'urn:i', 'urn:x', 'urn:c:r_name', 'X' UNION ALL SELECT '', 'urn:x', 'urn:c:seen', 'true'")
_change("upd_using_named", "INSERT DATA { GRAPH <urn:i> { <urn:x> c:r_name \"X\" } GRAPH <urn:j> { <urn:y> c:r_name \"Y\" } } ; INSERT { ?r c:from ?g } USING NAMED <urn:j> WHERE { GRAPH ?g { ?r c:r_name ?x } }",
        f"{REGION} UNION ALL SELECT 'urn:i', 'urn:x', 'urn:c:r_name', 'X' UNION ALL SELECT 'urn:j', 'urn:y', 'urn:c:r_name', 'Y' UNION ALL SELECT '', 'urn:y', 'urn:c:from', 'urn:j'")
_change("upd_create", "CREATE GRAPH <urn:new> ; INSERT { GRAPH <urn:new> { ?r c:r_name ?x } } WHERE { ?r c:r_name ?x }", f"{REGION} UNION ALL SELECT 'urn:new', s, p, o FROM ({REGION}) WHERE p = 'urn:c:r_name'")


@_put("upd_load", f"{REGION} UNION ALL SELECT 'urn:h', s, p, o FROM ({NATION})")
def _(spark, sf_dir):
    path = folder(spark)
    registry.write(mapped(spark, sf_dir, "nation").triples("").withColumn("g", F.lit("")), path, "turtle")
    ds = stored(spark, sf_dir, "region")
    ds.loader = registry.load
    return texts(update(ds, P + f"LOAD <{path}> INTO GRAPH <urn:h>").quads)


# SHACL ----------------------------------------------------------------------------------------------------------------


def _check(name: str, tables: tuple[str, ...], shapes: str, sql: str, quads: str = ""):
    @_put(name, sql)
    def _(spark, sf_dir):
        sg = shacl.ShapesGraph([q[:3] for q in turtle.parse_turtle(HEAD + shapes)])
        ds = with_quads(spark, sf_dir, quads, *tables) if quads else mapped(spark, sf_dir, *tables)
        report = shacl.validate(ds, sg)
        value = F.when(F.col("value.k") != 0, F.col("value.v"))
        return report.select(F.col("focus.v").alias("focus"), value.alias("value"), F.regexp_replace(F.substring_index(F.substring_index("component", "#", -1), ":", -1), "ConstraintComponent", "").alias("component"))


def _bad(table: str, key: str, component: str, where: str, value: str = "NULL", extra: str = "") -> str:
    return _rows(table, key, component, where, value, extra).replace("ConstraintComponent", "")


def _fixed(*rows: tuple) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL::VARCHAR" if x is None else f"'{x}'" for x in r) + ")" for r in rows) + ") x(focus, value, component)"


_CS, _NS, _NO = "v:Sh a sh:PropertyShape ; sh:targetClass t:customer ; ", "v:Sh a sh:PropertyShape ; sh:targetClass t:nation ; ", "v:Sh a sh:NodeShape ; sh:targetClass t:nation ; "
_check("shacl_ranges", ("customer",), _CS + "sh:path c:c_custkey ; sh:minExclusive 100 ; sh:maxInclusive 1300 .", _bad("customer", "c_custkey", "MinExclusive", "c_custkey <= 100", "c_custkey") + " UNION ALL " + _bad("customer", "c_custkey", "MaxInclusive", "c_custkey > 1300", "c_custkey"))
_check("shacl_pairs", ("part",), "v:Sh a sh:PropertyShape ; sh:targetClass t:part ; sh:path c:p_partkey ; sh:lessThan c:p_size . v:Si a sh:PropertyShape ; sh:targetClass t:part ; sh:path c:p_partkey ; sh:lessThanOrEquals c:p_size . v:Sj a sh:PropertyShape ; sh:targetClass t:part ; sh:path c:p_size ; sh:disjoint c:p_partkey .",
       " UNION ALL ".join([_bad("part", "p_partkey", "LessThan", "p_partkey >= p_size", "p_partkey"), _bad("part", "p_partkey", "LessThanOrEquals", "p_partkey > p_size", "p_partkey"), _bad("part", "p_partkey", "Disjoint", "p_partkey = p_size", "p_size")]))
_check("shacl_sets", ("labels",), "v:Sh a sh:PropertyShape ; sh:targetClass t:labels ; sh:path c:quality ; sh:equals c:toxic . v:Si a sh:PropertyShape ; sh:targetClass t:labels ; sh:path c:quality ; sh:subsetOf c:toxic .",
       "SELECT 'urn:t:labels/' || doc_id AS focus, v::VARCHAR AS value, 'Equals' AS component FROM labels, LATERAL (VALUES (quality), (toxic)) x(v) WHERE quality <> toxic UNION ALL " + _bad("labels", "doc_id", "SubsetOf", "quality <> toxic", "quality"))
_check("shacl_languages", ("nation",), _NS + 'sh:path v:label ; sh:languageIn ("en" "fr") ; sh:uniqueLang true .', _fixed(("urn:t:nation/1", "uno", "LanguageIn"), ("urn:t:nation/2", None, "UniqueLang")), quads='<urn:t:nation/1> v:label "one"@en, "uno"@it . <urn:t:nation/2> v:label "a"@en, "b"@en, "c"@fr-CA .')
_check("shacl_and", ("nation",), _NO + "sh:and ([ sh:path c:n_nationkey ; sh:minInclusive 5 ] [ sh:path c:n_regionkey ; sh:hasValue <urn:t:region/1> ]) .", _bad("nation", "n_nationkey", "And", "n_nationkey < 5 OR n_regionkey <> 1", _N))
_check("shacl_kind_lists", ("nation", "region"), _NS + "sh:path c:n_regionkey ; sh:nodeKind (sh:Literal sh:BlankNode) ; sh:class (t:nation v:Other) . v:Si a sh:PropertyShape ; sh:targetClass t:nation ; sh:path c:n_name ; sh:datatype (xsd:integer xsd:decimal) .",
       " UNION ALL ".join([_bad("nation", "n_nationkey", "NodeKind", "true", _R), _bad("nation", "n_nationkey", "Class", "true", _R), _bad("nation", "n_nationkey", "Datatype", "true", "n_name")]))
_check("shacl_some_value", ("customer", "nation"), _NS + "sh:path [ sh:inversePath c:c_nationkey ] ; sh:someValue [ sh:path c:c_acctbal ; sh:minInclusive 9900.0 ] .", _bad("nation", "n_nationkey", "SomeValue", "NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal >= 9900)"))
_check("shacl_single_line", ("documents",), "v:Sh a sh:PropertyShape ; sh:targetClass t:documents ; sh:path c:text ; sh:singleLine true .", r"SELECT 'urn:t:documents/' || doc_id AS focus, text AS value, 'SingleLine' AS component FROM documents WHERE contains(text, chr(10)) OR contains(text, chr(13))")
_check("shacl_lists", ("nation",), _NS + "sh:path v:list ; sh:uniqueMembers true ; sh:minListLength 2 ; sh:maxListLength 3 ; sh:memberShape [ sh:maxExclusive 9 ] .",
       _fixed(("urn:t:nation/1", None, "UniqueMembers"), ("urn:t:nation/2", None, "MinListLength"), ("urn:t:nation/3", None, "MaxListLength"), ("urn:t:nation/4", None, "MemberShape")),
       quads="<urn:t:nation/1> v:list (1 1) . <urn:t:nation/2> v:list (1) . <urn:t:nation/3> v:list (1 2 3 4) . <urn:t:nation/4> v:list (1 10) . <urn:t:nation/5> v:list (1 2) .")
_check("shacl_closed_by_types", ("region",), "t:region a rdfs:Class, sh:NodeShape ; sh:property [ sh:path c:r_name ] . v:Sh a sh:NodeShape ; sh:targetClass t:region ; sh:closed sh:ByTypes .", _bad("region", "r_regionkey", "Closed", "true", "r_regionkey"))
_check("shacl_pair_paths", ("supplier", "nation"), "v:Sh a sh:PropertyShape ; sh:targetClass t:supplier ; sh:path c:s_suppkey ; sh:lessThan (c:s_nationkey c:n_nationkey) .", _bad("supplier", "s_suppkey", "LessThan", "s_suppkey >= s_nationkey", "s_suppkey"))
_check("shacl_component", ("customer",), 'v:CConstraintComponent a sh:ConstraintComponent ; sh:parameter [ sh:path v:least ] ; sh:validator [ sh:ask "ASK { FILTER(isNUMERIC($value) && $value >= $least) }" ] . v:Sh a sh:PropertyShape ; sh:targetClass t:customer ; sh:path c:c_custkey ; v:least 50 .', _bad("customer", "c_custkey", "C", "c_custkey < 50", "c_custkey"))
_check("shacl_overrides", ("nation",), _NS + "sh:path c:n_name ; sh:minLength 9 {| sh:deactivated true |} ; sh:maxLength 8 .", _bad("nation", "n_nationkey", "MaxLength", "length(n_name) > 8", "n_name"))
_check("shacl_values", ("nation",), "v:Sh a sh:PropertyShape ; sh:targetClass t:nation ; sh:path v:made ; sh:values [ shnex:concat ([ shnex:pathValues c:n_nationkey ] ( 7 )) ] ; sh:maxInclusive 10 .", _bad("nation", "n_nationkey", "MaxInclusive", "n_nationkey > 10", "n_nationkey"))

# node expressions -----------------------------------------------------------------------------------------------------

#: name: (expression over nations, SQL of (focus, i, value))
EXPRESSIONS: dict[str, tuple[str, str]] = {
    "list": ("( 3 1 )", "SELECT {n} AS focus, i::BIGINT AS i, v AS value FROM nation, (VALUES (0, '3'), (1, '1')) x(i, v)"),
    "empty": ("()", ""),
    "var": ('[ shnex:var "focusNode" ]', "SELECT {n}, 0, {n} FROM nation"),
    "concat": ("[ shnex:concat ( [ shnex:pathValues c:n_name ] ( 2 ) ) ]", "SELECT {n}, 0, n_name FROM nation UNION ALL SELECT {n}, 1, '2' FROM nation"),
    "distinct": ("[ shnex:distinct ( 2 1 2 ) ]", "SELECT {n}, i, v FROM nation, (VALUES (0, '2'), (1, '1')) x(i, v)"),
    "count": ("[ shnex:count [ shnex:pathValues [ sh:inversePath c:s_nationkey ] ] ]", "SELECT {n}, 0, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey)::VARCHAR FROM nation"),
    "sum": ("[ shnex:sum [ shnex:pathValues [ sh:inversePath c:s_nationkey ] ] ; shnex:flatMap [ shnex:pathValues c:s_suppkey ] ]", "SELECT {n}, 0, coalesce((SELECT sum(s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey), 0)::VARCHAR FROM nation"),
    "min": ("[ shnex:min [ shnex:pathValues ( [ sh:inversePath c:s_nationkey ] c:s_suppkey ) ] ]", "SELECT 'urn:t:nation/' || s_nationkey, 0, min(s_suppkey)::VARCHAR FROM supplier GROUP BY s_nationkey"),
    "max": ("[ shnex:max [ shnex:pathValues ( [ sh:inversePath c:s_nationkey ] c:s_suppkey ) ] ]", "SELECT 'urn:t:nation/' || s_nationkey, 0, max(s_suppkey)::VARCHAR FROM supplier GROUP BY s_nationkey"),
    "exists": ("[ shnex:exists [ shnex:pathValues [ sh:inversePath c:s_nationkey ] ] ]", "SELECT {n}, 0, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)::VARCHAR FROM nation"),
    "filter_shape": ("[ shnex:nodes [ shnex:pathValues c:n_nationkey ] ; shnex:filterShape [ sh:maxExclusive 10 ] ]", "SELECT {n}, 0, n_nationkey::VARCHAR FROM nation WHERE n_nationkey < 10"),
    "find_first": ("[ shnex:nodes ( 30 20 3 ) ; shnex:findFirst [ sh:maxExclusive 25 ] ]", "SELECT {n}, 0, '20' FROM nation"),
    "match_all": ("[ shnex:nodes [ shnex:pathValues c:n_nationkey ] ; shnex:matchAll [ sh:maxExclusive 10 ] ]", "SELECT {n}, 0, (n_nationkey < 10)::VARCHAR FROM nation"),
    "nodes_matching": ("[ shnex:count [ shnex:nodesMatching [ sh:path c:n_regionkey ; sh:hasValue <urn:t:region/1> ] ] ]", "SELECT {n}, 0, (SELECT count(*) FROM nation WHERE n_regionkey = 1)::VARCHAR FROM nation"),
    "instances_of": ("[ shnex:count [ shnex:instancesOf t:supplier ] ]", "SELECT {n}, 0, (SELECT count(*) FROM supplier)::VARCHAR FROM nation"),
    "intersection": ("[ shnex:intersection ( ( 3 1 2 ) ( 2 3 ) ) ]", "SELECT {n}, i, v FROM nation, (VALUES (0, '3'), (1, '2')) x(i, v)"),
    "flat_map": ("[ shnex:nodes [ shnex:pathValues c:n_regionkey ] ; shnex:flatMap [ shnex:pathValues c:r_name ] ]", "SELECT {n}, 0, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "remove": ("[ shnex:nodes ( 1 2 3 ) ; shnex:remove ( 2 ) ]", "SELECT {n}, i, v FROM nation, (VALUES (0, '1'), (1, '3')) x(i, v)"),
    "if_then_else": ("[ shnex:if [ shnex:nodes [ shnex:pathValues c:n_nationkey ] ; shnex:matchAll [ sh:maxExclusive 10 ] ] ; shnex:then 5 ; shnex:else 6 ]", "SELECT {n}, 0, CASE WHEN n_nationkey < 10 THEN '5' ELSE '6' END FROM nation"),
    "limit": ("[ shnex:nodes ( 9 8 7 ) ; shnex:limit 2 ]", "SELECT {n}, i, v FROM nation, (VALUES (0, '9'), (1, '8')) x(i, v)"),
    "offset": ("[ shnex:nodes ( 9 8 7 ) ; shnex:offset 2 ]", "SELECT {n}, 0, '7' FROM nation"),
    "order_by": ("[ shnex:nodes ( <urn:t:nation/2> <urn:t:nation/9> <urn:t:nation/4> ) ; shnex:orderBy [ shnex:pathValues c:n_nationkey ] ; shnex:desc true ]", "SELECT {n}, i, 'urn:t:nation/' || v FROM nation, (VALUES (0, 9), (1, 4), (2, 2)) x(i, v)"),
    "focus_node": ("[ shnex:pathValues c:n_name ; shnex:focusNode <urn:t:nation/3> ]", "SELECT {n}, 0, (SELECT n_name FROM nation WHERE n_nationkey = 3) FROM nation"),
}


@_put("node_expressions", " UNION ALL ".join(f"SELECT '{name}' AS name, * FROM ({sql.format(n=_N)}) x(focus, i, value)" for name, (_, sql) in EXPRESSIONS.items() if sql))
def _(spark, sf_dir):
    """Every node expression, evaluated for all nations."""
    text = " ".join(f"v:holder v:{name} {e} ." for name, (e, _) in EXPRESSIONS.items())
    quads = turtle.parse_turtle(HEAD + text)
    v = shacl.Validator(mapped(spark, sf_dir, "nation", "region", "supplier"), shacl.ShapesGraph([q[:3] for q in quads]))
    focus = mapped(spark, sf_dir, "nation").triples("", p="urn:c:n_name").select(F.col("s").alias("focus"))
    out = None
    for _, p, e, _ in [q for q in quads if q[1].startswith("urn:v:")]:
        got = v.expression(e, focus).select(F.lit(p.removeprefix("urn:v:")).alias("name"), F.col("focus.v").alias("focus"), F.col("i").cast("long").alias("i"), F.col("value.v").alias("value"))
        out = got if out is None else out.union(got)
    return out


# OWL 2 RL -------------------------------------------------------------------------------------------------------------

#: rule: (axioms, predicate, SQL of the (s, o) that it adds to nations, regions and suppliers)
_S = IRI("supplier", "s_suppkey")
RULES: dict[str, tuple[str, str, str]] = {
    "symmetric": ("c:s_nationkey rdfs:subPropertyOf v:near . v:near a owl:SymmetricProperty .", "urn:v:near", f"SELECT {_S}, 'urn:t:nation/' || s_nationkey FROM supplier UNION SELECT 'urn:t:nation/' || s_nationkey, {_S} FROM supplier"),
    "equivalent_property": ("c:n_name owl:equivalentProperty v:title .", "urn:v:title", f"SELECT {_N}, n_name FROM nation"),
    "chain": ("v:inRegion owl:propertyChainAxiom (c:s_nationkey c:n_regionkey) .", "urn:v:inRegion", f"SELECT {_S}, 'urn:t:region/' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "has_value": ("v:Asian owl:hasValue <urn:t:region/2> ; owl:onProperty c:n_regionkey . v:Odd owl:hasValue v:w ; owl:onProperty v:mark . t:region rdfs:subClassOf v:Odd .", "urn:v:mark", "SELECT 'urn:t:region/' || r_regionkey, 'urn:v:w' FROM region"),
}
CLASSES: dict[str, tuple[str, str, str]] = {
    "equivalent_class": ("t:nation owl:equivalentClass v:Land .", "urn:v:Land", f"SELECT {_N} FROM nation"),
    "has_value_2": ("", "urn:v:Asian", f"SELECT {_N} FROM nation WHERE n_regionkey = 2"),
    "some_values": ("v:Located owl:someValuesFrom t:region ; owl:onProperty c:n_regionkey . v:Any owl:someValuesFrom owl:Thing ; owl:onProperty c:s_nationkey .", "urn:v:Located", f"SELECT {_N} FROM nation"),
    "some_values_thing": ("", "urn:v:Any", f"SELECT {_S} FROM supplier"),
    "all_values": ("v:OnlyPlaces owl:allValuesFrom v:Place ; owl:onProperty c:n_regionkey . t:nation rdfs:subClassOf v:OnlyPlaces .", "urn:v:Place", "SELECT DISTINCT 'urn:t:region/' || n_regionkey FROM nation"),
    "intersection": ("v:Both owl:intersectionOf (t:nation v:Asian) .", "urn:v:Both", f"SELECT {_N} FROM nation WHERE n_regionkey = 2"),
    "intersection_2": ("v:Pair owl:intersectionOf (v:PartOne v:PartTwo) . t:region rdfs:subClassOf v:Pair .", "urn:v:PartTwo", "SELECT 'urn:t:region/' || r_regionkey FROM region"),
    "union": ("v:Either owl:unionOf (t:nation t:region) .", "urn:v:Either", f"SELECT {_N} FROM nation UNION ALL SELECT 'urn:t:region/' || r_regionkey FROM region"),
    "one_of": ("v:Few owl:oneOf (<urn:t:nation/1> <urn:t:nation/2>) .", "urn:v:Few", f"SELECT {_N} FROM nation WHERE n_nationkey IN (1, 2)"),
}
SAME: dict[str, tuple[str, str]] = {
    "functional": ("v:f a owl:FunctionalProperty . v:a v:f v:b1, v:b2 .", "SELECT 'urn:v:b1', 'urn:v:b2'"),
    "inverse_functional": ("v:i a owl:InverseFunctionalProperty . v:c1 v:i v:c . v:c2 v:i v:c .", "SELECT 'urn:v:c1', 'urn:v:c2'"),
    "key": ("v:K owl:hasKey (v:k1 v:k2) . v:d1 a v:K ; v:k1 1 ; v:k2 2 . v:d2 a v:K ; v:k1 1 ; v:k2 2 . v:d3 a v:K ; v:k1 1 ; v:k2 3 .", "SELECT 'urn:v:d1', 'urn:v:d2'"),
    "max_cardinality": ("v:M owl:maxCardinality 1 ; owl:onProperty v:m . v:e a v:M ; v:m v:e1, v:e2 .", "SELECT 'urn:v:e1', 'urn:v:e2'"),
    "max_qualified": ("v:Q owl:maxQualifiedCardinality 1 ; owl:onClass v:QC ; owl:onProperty v:q . v:g a v:Q ; v:q v:g1, v:g2, v:g3 . v:g1 a v:QC . v:g2 a v:QC .", "SELECT 'urn:v:g1', 'urn:v:g2'"),
    "transitive": ("v:h1 owl:sameAs v:h2 . v:h2 owl:sameAs v:h3 .", "SELECT * FROM (VALUES ('urn:v:h1', 'urn:v:h2'), ('urn:v:h2', 'urn:v:h3'), ('urn:v:h1', 'urn:v:h3')) x(a, b)"),
}
BAD: dict[str, str] = {
    "cls-nothing2": "v:n a owl:Nothing .", "prp-irp": "v:ir a owl:IrreflexiveProperty . v:x1 v:ir v:x1 .", "prp-asyp": "v:as a owl:AsymmetricProperty . v:x2 v:as v:x3 . v:x3 v:as v:x2 .",
    "prp-pdw": "v:p1 owl:propertyDisjointWith v:p2 . v:x4 v:p1 v:x5 ; v:p2 v:x5 .", "prp-adp": "[] a owl:AllDisjointProperties ; owl:members (v:r1 v:r2 v:r3) . v:x6 v:r1 v:x7 ; v:r3 v:x7 .",
    "cax-adc": "[] a owl:AllDisjointClasses ; owl:members (v:D1 v:D2) . v:x8 a v:D1, v:D2 .", "eq-diff1": "v:x9 owl:sameAs v:y9 . v:x9 owl:differentFrom v:y9 .", "cls-com": "v:C1 owl:complementOf v:C2 . v:y1 a v:C1, v:C2 .",
    "cls-maxc1": "v:M0 owl:maxCardinality 0 ; owl:onProperty v:m0 . v:y2 a v:M0 ; v:m0 1 .", "cls-maxqc1": "v:Q0 owl:maxQualifiedCardinality 0 ; owl:onClass v:QD ; owl:onProperty v:q0 . v:y3 a v:Q0 ; v:q0 v:y4 . v:y4 a v:QD .",
    "prp-npa1": "[] owl:sourceIndividual v:y5 ; owl:assertionProperty v:np ; owl:targetIndividual v:y6 . v:y5 v:np v:y6 .", "prp-npa2": "[] owl:sourceIndividual v:y7 ; owl:assertionProperty v:nv ; owl:targetValue 5 . v:y7 v:nv 5 .",
}


def _with_axioms(spark, sf_dir, axioms: str) -> DataFrame:
    return with_quads(spark, sf_dir, axioms, "nation", "region", "supplier").quads.select("s", "p", "o")


@_put("owl_property_rules", " UNION ALL ".join(f"SELECT '{p}' AS p, * FROM ({sql}) x(s, o)" for _, p, sql in RULES.values()))
def _(spark, sf_dir):
    out = reasoning.inferred(_with_axioms(spark, sf_dir, " ".join(a for a, _, _ in RULES.values())), "owlrl")
    return out.where(F.col("p").isin([p for _, p, _ in RULES.values()])).select("p", F.col("s.v").alias("s"), F.col("o.v").alias("o"))


@_put("owl_class_rules", " UNION ALL ".join(f"SELECT '{c}' AS c, * FROM ({sql}) x(s)" for _, c, sql in CLASSES.values()))
def _(spark, sf_dir):
    axioms = "v:Asian owl:hasValue <urn:t:region/2> ; owl:onProperty c:n_regionkey . " + " ".join(a for a, _, _ in CLASSES.values())
    out = reasoning.inferred(_with_axioms(spark, sf_dir, axioms), "owlrl").where(F.col("p") == R.TYPE)
    return out.where(F.col("o.v").isin([c for _, c, _ in CLASSES.values()])).select(F.col("o.v").alias("c"), F.col("s.v").alias("s"))


@_put("owl_equality_rules", f"""WITH e(a, b) AS ({' UNION ALL '.join(f'SELECT * FROM ({sql}) x(a, b)' for _, sql in SAME.values())}), pairs AS (SELECT a, b FROM e UNION SELECT b, a FROM e)
    SELECT '{R.OWL}sameAs' AS p, a AS s, b AS o FROM pairs UNION ALL SELECT 'urn:v:says', 'urn:v:b2', {_N} FROM nation UNION ALL SELECT 'urn:v:says', 'urn:v:b1', {_N} FROM nation UNION ALL SELECT 'urn:v:knows', {_N}, x FROM nation, (VALUES ('urn:v:c1'), ('urn:v:c2')) y(x)""")
def _(spark, sf_dir):
    """Equal individuals and what follows for their triples, in either place."""
    t = _with_axioms(spark, sf_dir, " ".join(a for a, _ in SAME.values()))
    name = t.where("p = 'urn:c:n_name'")
    iri = lambda v: F.lit(None).cast(R.TERM_DDL) if v is None else R.const(Term(1, v))
    t = t.union(name.select(iri("urn:v:b1").alias("s"), F.lit("urn:v:says").alias("p"), F.col("s").alias("o"))).union(name.select("s", F.lit("urn:v:knows").alias("p"), iri("urn:v:c1").alias("o")))
    out = reasoning.expand(t, "owlrl").where(F.col("p").isin(R.OWL + "sameAs", "urn:v:says", "urn:v:knows"))
    return plain(out.where("s != o or p != '" + R.OWL + "sameAs'")).select("p", "s", "o")


@_put("owl_inconsistencies", "SELECT * FROM (VALUES " + ", ".join(f"('{r}', 1::BIGINT)" for r in BAD) + ") x(rule, n)")
def _(spark, sf_dir):
    return reasoning.inconsistencies(_with_axioms(spark, sf_dir, " ".join(BAD.values()))).groupBy("rule").agg(F.count("*").alias("n"))
