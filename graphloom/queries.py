"""Registered queries over the mapped tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from . import terms as R
from .dataset import Dataset
from .engine import query
from .sources.mapping import parquet_tables

P = "PREFIX c: <urn:c:> PREFIX t: <urn:t:> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> PREFIX rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#>\n"
IRI = lambda table, key: f"'urn:t:{table}/' || {key}"

#: name: (SPARQL, SQL)
SELECTS: dict[str, tuple[str, str]] = {
    "flagship_revenue_by_nation": (
        """SELECT ?nation (COUNT(?o) AS ?orders) (SUM(?price) AS ?revenue) WHERE {
             ?o c:o_custkey ?cust ; c:o_totalprice ?price ; c:o_orderstatus "F" . ?cust c:c_nationkey ?n . ?n c:n_name ?nation .
           } GROUP BY ?nation ORDER BY DESC(?revenue) ?nation""",
        """SELECT n_name AS nation, count(*)::BIGINT AS orders, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS revenue
           FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY n_name""",
    ),
    "bgp_scan": ("SELECT ?n ?name WHERE { ?n c:n_name ?name }", f"SELECT {IRI('nation', 'n_nationkey')} AS n, n_name AS name FROM nation"),
    "bgp_star": (
        "SELECT ?c ?name ?bal ?seg WHERE { ?c c:c_name ?name ; c:c_acctbal ?bal ; c:c_mktsegment ?seg ; a t:customer }",
        f"SELECT {IRI('customer', 'c_custkey')} AS c, c_name AS name, c_acctbal::DECIMAL(18,2)::DOUBLE AS bal, c_mktsegment AS seg FROM customer",
    ),
    "bgp_chain": (
        "SELECT ?o ?r WHERE { ?o c:o_custkey/c:c_nationkey/c:n_regionkey ?x . ?x c:r_name ?r ; c:r_name ?r2 FILTER(?r = ?r2) }",
        f"SELECT {IRI('orders', 'o_orderkey')} AS o, r_name AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "bgp_constant_subject": (
        "SELECT ?p ?k WHERE { <urn:t:customer/7> c:c_name ?p . ?o c:o_custkey <urn:t:customer/7> ; c:o_orderkey ?k }",
        "SELECT c_name AS p, o_orderkey AS k FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey = 7",
    ),
    "bgp_repeated_variable": (
        "SELECT ?d ?x WHERE { ?d c:quality ?x ; c:toxic ?x }",
        f"SELECT {IRI('labels', 'doc_id')} AS d, quality::BIGINT AS x FROM labels WHERE quality = toxic",
    ),
    "bgp_var_predicate": (
        "SELECT ?s ?p ?v WHERE { ?s a t:region . ?s ?p ?o BIND(STR(?o) AS ?v) }",
        f"""SELECT {IRI('region', 'r_regionkey')} AS s, p, v FROM region, LATERAL (VALUES ('urn:c:r_regionkey', r_regionkey::VARCHAR), ('urn:c:r_name', r_name),
            ('http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'urn:t:region')) AS x(p, v)""",
    ),
    "bgp_type": ("SELECT ?s WHERE { ?s a t:supplier }", f"SELECT {IRI('supplier', 's_suppkey')} AS s FROM supplier"),
    "filter_num": (
        "SELECT ?p ?q WHERE { ?l c:l_quantity ?q ; c:l_extendedprice ?p FILTER(?q > 45 && ?p < 5000.5) }",
        "SELECT l_extendedprice::DECIMAL(18,2)::DOUBLE AS p, l_quantity AS q FROM lineitem WHERE l_quantity > 45 AND l_extendedprice::DECIMAL(18,2) < 5000.5",
    ),
    "filter_str": ('SELECT ?p ?b WHERE { ?p c:p_brand ?b FILTER(?b >= "Brand#3" && ?b != "Brand#31") }', f"SELECT {IRI('part', 'p_partkey')} AS p, p_brand AS b FROM part WHERE p_brand >= 'Brand#3' AND p_brand <> 'Brand#31'"),
    "filter_date": (
        'SELECT ?o ?d WHERE { ?o c:o_orderdate ?d FILTER(?d >= "1997-06-01T00:00:00"^^xsd:dateTime) }',
        f"SELECT {IRI('orders', 'o_orderkey')} AS o, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS d FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01'",
    ),
    "filter_in": ('SELECT ?o ?s WHERE { ?o c:o_orderpriority ?s FILTER(?s IN ("1-URGENT", "2-HIGH")) }', f"SELECT {IRI('orders', 'o_orderkey')} AS o, o_orderpriority AS s FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "filter_not_in": ("SELECT ?p ?z WHERE { ?p c:p_size ?z FILTER(?z NOT IN (1, 2, 3, 50)) }", f"SELECT {IRI('part', 'p_partkey')} AS p, p_size::BIGINT AS z FROM part WHERE p_size NOT IN (1, 2, 3, 50)"),
    "filter_regex": ('SELECT ?p WHERE { ?p c:p_type ?t FILTER(REGEX(?t, "^s.*l$", "i")) }', f"SELECT {IRI('part', 'p_partkey')} AS p FROM part WHERE regexp_matches(p_type, '^s.*l$', 'i')"),
    "filter_logic_error": (
        "SELECT ?e WHERE { ?e c:event_type ?t ; c:value ?v FILTER(?t > 5 || ?v > 50) }",
        f"SELECT {IRI('events', 'event_id')} AS e FROM events WHERE value > 50",
    ),
    "filter_ebv": ("SELECT ?r WHERE { ?r c:r_regionkey ?k FILTER(?k) }", f"SELECT {IRI('region', 'r_regionkey')} AS r FROM region WHERE r_regionkey <> 0"),
    "arithmetic": (
        "SELECT ?k (?q * 2 + 1 AS ?a) (?p / 4 AS ?b) (-?q AS ?n) (?p - ?q AS ?m) WHERE { ?l c:l_quantity ?q ; c:l_linenumber ?k ; c:l_tax ?p }",
        "SELECT l_linenumber::BIGINT AS k, l_quantity * 2 + 1 AS a, l_tax / 4 AS b, -l_quantity AS n, l_tax - l_quantity AS m FROM lineitem",
    ),
    "optional": (
        "SELECT ?c ?o WHERE { ?c c:c_name ?n OPTIONAL { ?o c:o_custkey ?c } }",
        f"SELECT {IRI('customer', 'c_custkey')} AS c, CASE WHEN o_orderkey IS NOT NULL THEN {IRI('orders', 'o_orderkey')} END AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey",
    ),
    "optional_filter": (
        "SELECT ?c ?k WHERE { ?c c:c_acctbal ?b OPTIONAL { ?o c:o_custkey ?c ; c:o_totalprice ?p ; c:o_orderpriority ?k FILTER(?p > 200000 && ?b > 0) } }",
        f"SELECT {IRI('customer', 'c_custkey')} AS c, o_orderpriority AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 AND c_acctbal > 0",
    ),
    "optional_nested": (
        "SELECT ?n ?s ?p WHERE { ?n c:n_name ?x OPTIONAL { ?s c:s_nationkey ?n ; c:s_acctbal ?b FILTER(?b > 5000) OPTIONAL { ?s c:s_name ?p FILTER(?b > 8000) } } }",
        f"""SELECT {IRI('nation', 'n_nationkey')} AS n, CASE WHEN s_suppkey IS NOT NULL THEN {IRI('supplier', 's_suppkey')} END AS s, CASE WHEN s_acctbal > 8000 THEN s_name END AS p
            FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000""",
    ),
    "bound_unbound": (
        "SELECT ?c WHERE { ?c c:c_name ?n OPTIONAL { ?o c:o_custkey ?c ; c:o_orderpriority \"1-URGENT\" } FILTER(!BOUND(?o)) }",
        f"SELECT {IRI('customer', 'c_custkey')} AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    ),
    "union_bag": (
        "SELECT ?n WHERE { { ?x c:c_nationkey ?k . ?k c:n_name ?n } UNION { ?x c:s_nationkey ?k . ?k c:n_name ?n } }",
        "SELECT n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    ),
    "union_mixed_types": (
        "SELECT ?x WHERE { { ?n c:n_name ?x } UNION { ?n c:n_regionkey ?x } UNION { ?r c:r_regionkey ?x } }",
        f"SELECT n_name AS x FROM nation UNION ALL SELECT {IRI('region', 'n_regionkey')} FROM nation UNION ALL SELECT r_regionkey::VARCHAR FROM region",
    ),
    "minus": (
        "SELECT ?c WHERE { ?c c:c_name ?n MINUS { ?o c:o_custkey ?c ; c:o_orderstatus \"F\" } }",
        f"SELECT {IRI('customer', 'c_custkey')} AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    ),
    "minus_disjoint": ("SELECT ?r WHERE { ?r c:r_name ?n MINUS { ?x c:n_name ?y } }", f"SELECT {IRI('region', 'r_regionkey')} AS r FROM region"),
    "exists": (
        "SELECT ?c WHERE { ?c c:c_name ?n FILTER EXISTS { ?o c:o_custkey ?c ; c:o_totalprice ?p FILTER(?p > 250000) } }",
        f"SELECT {IRI('customer', 'c_custkey')} AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)",
    ),
    "exists_correlated_filter": (
        "SELECT ?c WHERE { ?c c:c_acctbal ?b FILTER EXISTS { ?o c:o_custkey ?c ; c:o_totalprice ?p FILTER(?p > ?b * 30) } }",
        f"SELECT {IRI('customer', 'c_custkey')} AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice::DECIMAL(18,2) > c_acctbal::DECIMAL(18,2) * 30)",
    ),
    "not_exists": (
        "SELECT ?s WHERE { ?s c:s_name ?n FILTER NOT EXISTS { ?l c:l_suppkey ?s ; c:l_returnflag \"R\" ; c:l_quantity ?q FILTER(?q > 49) } }",
        f"SELECT {IRI('supplier', 's_suppkey')} AS s FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity > 49)",
    ),
    "exists_or": (
        "SELECT ?c WHERE { ?c c:c_acctbal ?b FILTER(?b > 9000 || EXISTS { ?o c:o_custkey ?c ; c:o_orderpriority \"1-URGENT\" }) }",
        f"SELECT {IRI('customer', 'c_custkey')} AS c FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    ),
    "exists_in_bind": (
        "SELECT ?r ?x WHERE { ?r c:r_name ?n BIND(IF(EXISTS { ?k c:n_regionkey ?r ; c:n_name \"NATION_1\" }, 1, 2) AS ?x) }",
        f"SELECT {IRI('region', 'r_regionkey')} AS r, CASE WHEN EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND n_name = 'NATION_1') THEN 1 ELSE 2 END::BIGINT AS x FROM region",
    ),
    "bind": ('SELECT ?p ?x WHERE { ?p c:p_name ?n ; c:p_size ?z BIND(CONCAT(UCASE(?n), "/", STR(?z)) AS ?x) }', f"SELECT {IRI('part', 'p_partkey')} AS p, upper(p_name) || '/' || p_size AS x FROM part"),
    "values": (
        'SELECT ?n ?x WHERE { VALUES (?r ?x) { ("ASIA" 1) ("EUROPE" 2) ("NOWHERE" 3) } ?k c:r_name ?r . ?n c:n_regionkey ?k }',
        f"SELECT {IRI('nation', 'n_nationkey')} AS n, x::BIGINT AS x FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (VALUES ('ASIA', 1), ('EUROPE', 2)) v(r, x) ON r = r_name",
    ),
    "values_undef": (
        'SELECT ?n ?s WHERE { ?o c:o_orderstatus ?s ; c:o_orderpriority ?n } VALUES (?s ?n) { ("F" UNDEF) (UNDEF "5-LOW") }',
        "SELECT o_orderpriority AS n, o_orderstatus AS s FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderpriority, o_orderstatus FROM orders WHERE o_orderpriority = '5-LOW'",
    ),
    "subselect": (
        "SELECT ?name ?m WHERE { { SELECT ?c (MAX(?p) AS ?m) WHERE { ?o c:o_custkey ?c ; c:o_totalprice ?p } GROUP BY ?c } ?c c:c_name ?name FILTER(?m > 300000) }",
        "SELECT c_name AS name, m::DOUBLE AS m FROM (SELECT o_custkey, max(o_totalprice::DECIMAL(18,2)) AS m FROM orders GROUP BY o_custkey) JOIN customer ON o_custkey = c_custkey WHERE m > 300000",
    ),
    "subselect_limit": (
        "SELECT ?c ?n WHERE { { SELECT ?c WHERE { ?c c:c_acctbal ?b } ORDER BY DESC(?b) ?c LIMIT 5 } ?c c:c_name ?n }",
        f"SELECT {IRI('customer', 'c_custkey')} AS c, c_name AS n FROM customer ORDER BY c_acctbal DESC, {IRI('customer', 'c_custkey')} LIMIT 5",
    ),
    "graph_named": (
        "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s a ?t } FILTER(?g IN (<urn:g:region>, <urn:g:nation>)) } GROUP BY ?g",
        "SELECT 'urn:g:region' AS g, count(*)::BIGINT AS n FROM region UNION ALL SELECT 'urn:g:nation', count(*)::BIGINT FROM nation",
    ),
    "graph_constant": ("SELECT ?x WHERE { GRAPH <urn:g:nation> { ?n c:n_name ?x } }", "SELECT n_name AS x FROM nation"),
    "from_named": (
        "SELECT ?x FROM <urn:g:region> WHERE { ?s c:r_name ?x } ",
        "SELECT r_name AS x FROM region",
    ),
    "agg_count": ("SELECT ?f (COUNT(*) AS ?n) (COUNT(?q) AS ?m) WHERE { ?l c:l_returnflag ?f ; c:l_quantity ?q } GROUP BY ?f", "SELECT l_returnflag AS f, count(*)::BIGINT AS n, count(l_quantity)::BIGINT AS m FROM lineitem GROUP BY 1"),
    "agg_count_distinct": ("SELECT (COUNT(DISTINCT ?c) AS ?n) (COUNT(DISTINCT ?s) AS ?k) WHERE { ?o c:o_custkey ?c ; c:o_orderstatus ?s }", "SELECT count(DISTINCT o_custkey)::BIGINT AS n, count(DISTINCT o_orderstatus)::BIGINT AS k FROM orders"),
    "agg_count_distinct_star": ("SELECT (COUNT(DISTINCT *) AS ?n) WHERE { ?o c:o_orderstatus ?s ; c:o_orderpriority ?p }", "SELECT count(*)::BIGINT AS n FROM orders"),
    "agg_sum": ("SELECT ?f (SUM(?p) AS ?s) (SUM(?k) AS ?i) WHERE { ?l c:l_returnflag ?f ; c:l_extendedprice ?p ; c:l_linenumber ?k } GROUP BY ?f", "SELECT l_returnflag AS f, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS s, sum(l_linenumber)::BIGINT AS i FROM lineitem GROUP BY 1"),
    "agg_avg": ("SELECT ?s (AVG(?p) AS ?a) WHERE { ?o c:o_orderstatus ?s ; c:o_totalprice ?p } GROUP BY ?s", "SELECT o_orderstatus AS s, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) AS a FROM orders GROUP BY 1"),
    "agg_min_max": ("SELECT ?b (MIN(?p) AS ?lo) (MAX(?p) AS ?hi) (MIN(?n) AS ?first) WHERE { ?x c:p_brand ?b ; c:p_retailprice ?p ; c:p_name ?n } GROUP BY ?b", "SELECT p_brand AS b, min(p_retailprice::DECIMAL(18,2))::DOUBLE AS lo, max(p_retailprice::DECIMAL(18,2))::DOUBLE AS hi, min(p_name) AS first FROM part GROUP BY 1"),
    "agg_group_concat": (
        'SELECT ?r (GROUP_CONCAT(?n; SEPARATOR=",") AS ?all) WHERE { ?x c:n_regionkey ?k ; c:n_name ?n . ?k c:r_name ?r } GROUP BY ?r',
        "SELECT r_name AS r, string_agg(n_name, ',' ORDER BY n_name) AS \"all\" FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "agg_distinct": ("SELECT (SUM(DISTINCT ?z) AS ?s) (AVG(DISTINCT ?z) AS ?a) WHERE { ?p c:p_size ?z }", "SELECT sum(DISTINCT p_size)::BIGINT AS s, sum(DISTINCT p_size)::DOUBLE / count(DISTINCT p_size) AS a FROM part"),
    "group_expr": ("SELECT ?y (COUNT(*) AS ?n) WHERE { ?o c:o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT year(o_orderdate)::BIGINT AS y, count(*)::BIGINT AS n FROM orders GROUP BY 1"),
    "group_two_keys": ("SELECT ?f ?s (SUM(?q) AS ?t) WHERE { ?l c:l_returnflag ?f ; c:l_linestatus ?s ; c:l_linenumber ?q } GROUP BY ?f ?s", "SELECT l_returnflag AS f, l_linestatus AS s, sum(l_linenumber)::BIGINT AS t FROM lineitem GROUP BY 1, 2"),
    "having": ("SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o c:o_custkey ?c } GROUP BY ?c HAVING(COUNT(?o) > 15 && ?n < 25)", f"SELECT {IRI('customer', 'o_custkey')} AS c, count(*)::BIGINT AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15 AND count(*) < 25"),
    "implicit_group": ("SELECT (COUNT(*) AS ?n) (SUM(?z) AS ?s) WHERE { ?p c:p_size ?z FILTER(?z > 1000) }", "SELECT 0::BIGINT AS n, 0::BIGINT AS s"),
    "agg_expression": ("SELECT ?f (ROUND(SUM(?p) * 1000 / COUNT(*)) AS ?x) (IF(COUNT(*) > 15000, \"many\", \"few\") AS ?w) WHERE { ?l c:l_returnflag ?f ; c:l_linenumber ?p } GROUP BY ?f", "SELECT l_returnflag AS f, round(sum(l_linenumber) * 1000 / count(*)) AS x, CASE WHEN count(*) > 15000 THEN 'many' ELSE 'few' END AS w FROM lineitem GROUP BY 1"),
    "order_topk": ("SELECT ?o ?p WHERE { ?o c:o_totalprice ?p } ORDER BY DESC(?p) ?o LIMIT 10", f"SELECT {IRI('orders', 'o_orderkey')} AS o, o_totalprice::DECIMAL(18,2)::DOUBLE AS p FROM orders ORDER BY o_totalprice DESC, 1 LIMIT 10"),
    "order_aggregate": ("SELECT ?s WHERE { ?o c:o_orderpriority ?s ; c:o_totalprice ?p } GROUP BY ?s ORDER BY DESC(SUM(?p)) LIMIT 2", "SELECT o_orderpriority AS s FROM orders GROUP BY 1 ORDER BY sum(o_totalprice::DECIMAL(18,2)) DESC LIMIT 2"),
    "distinct": ("SELECT DISTINCT ?b ?z WHERE { ?p c:p_brand ?b ; c:p_size ?z }", "SELECT DISTINCT p_brand AS b, p_size::BIGINT AS z FROM part"),
    "reduced": ("SELECT REDUCED ?r WHERE { ?n c:n_regionkey ?r }", f"SELECT {IRI('region', 'n_regionkey')} AS r FROM nation"),
    "distinct_ordered": ("SELECT DISTINCT ?s WHERE { ?o c:o_orderstatus ?s ; c:o_totalprice ?p } ORDER BY ?p LIMIT 3", "SELECT o_orderstatus AS s FROM orders GROUP BY 1 ORDER BY min(o_totalprice) LIMIT 3"),
    "offset_limit": ("SELECT ?n WHERE { ?x c:n_name ?n } ORDER BY ?n LIMIT 7 OFFSET 5", "SELECT n_name AS n FROM nation ORDER BY 1 LIMIT 7 OFFSET 5"),
    "ask": ('ASK { ?c c:c_mktsegment "BUILDING" ; c:c_acctbal ?b FILTER(?b > 9990) }', "SELECT count(*) > 0 AS ask FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9990"),
    "fn_string": (
        'SELECT ?p (STRLEN(?n) AS ?a) (SUBSTR(?n, 2, 4) AS ?b) (UCASE(?n) AS ?c) (LCASE(?t) AS ?d) (STRBEFORE(?n, "_") AS ?e) (STRAFTER(?n, "_") AS ?f) (CONCAT(?n, "-", ?t) AS ?g) (REPLACE(?n, "[0-9]+", "#") AS ?h) (ENCODE_FOR_URI(?t) AS ?i) WHERE { ?p c:p_name ?n ; c:p_type ?t }',
        f"""SELECT {IRI('part', 'p_partkey')} AS p, length(p_name)::BIGINT AS a, substr(p_name, 2, 4) AS b, upper(p_name) AS c, lower(p_type) AS d,
            CASE WHEN contains(p_name, '_') THEN split_part(p_name, '_', 1) ELSE '' END AS e, CASE WHEN contains(p_name, '_') THEN substr(p_name, strpos(p_name, '_') + 1) ELSE '' END AS f,
            p_name || '-' || p_type AS g, regexp_replace(p_name, '[0-9]+', '#', 'g') AS h, url_encode(p_type) AS i FROM part""",
    ),
    "fn_string_tests": (
        'SELECT ?p (STRSTARTS(?n, "part") AS ?a) (STRENDS(?n, "7") AS ?b) (CONTAINS(?n, "1") AS ?c) (LANG(?n) AS ?d) (STR(DATATYPE(?n)) AS ?e) (isLITERAL(?n) AS ?f) (isIRI(?p) AS ?g) (isBLANK(?p) AS ?h) (isNUMERIC(?z) AS ?i) WHERE { ?p c:p_name ?n ; c:p_size ?z }',
        f"SELECT {IRI('part', 'p_partkey')} AS p, starts_with(p_name, 'part') AS a, ends_with(p_name, '7') AS b, contains(p_name, '1') AS c, '' AS d, '{R.STRING}' AS e, true AS f, true AS g, false AS h, true AS i FROM part",
    ),
    "fn_hash": ("SELECT ?d (MD5(?t) AS ?a) (SHA1(?t) AS ?b) (SHA256(?t) AS ?c) WHERE { ?d c:lang ?l ; c:text ?t }", f"SELECT {IRI('documents', 'doc_id')} AS d, md5(text) AS a, sha1(text) AS b, sha256(text) AS c FROM documents"),
    "fn_date": (
        "SELECT ?e (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?k) (HOURS(?d) AS ?h) (MINUTES(?d) AS ?i) (TZ(?d) AS ?z) WHERE { ?e c:ts ?d }",
        f"SELECT {IRI('events', 'event_id')} AS e, year(ts)::BIGINT AS y, month(ts)::BIGINT AS m, day(ts)::BIGINT AS k, hour(ts)::BIGINT AS h, minute(ts)::BIGINT AS i, '' AS z FROM events",
    ),
    "fn_num": (
        "SELECT ?k (ABS(?q - 25) AS ?a) (CEIL(?x) AS ?b) (FLOOR(?x) AS ?c) (ROUND(?x) AS ?d) WHERE { ?l c:l_linenumber ?k ; c:l_quantity ?q ; c:l_extendedprice ?x }",
        "SELECT l_linenumber::BIGINT AS k, abs(l_quantity - 25) AS a, ceil(l_extendedprice::DECIMAL(18,2))::DOUBLE AS b, floor(l_extendedprice::DECIMAL(18,2))::DOUBLE AS c, round(l_extendedprice::DECIMAL(18,2), 0)::DOUBLE AS d FROM lineitem",
    ),
    "fn_cond": (
        'SELECT ?c (IF(?b > 0, "plus", "minus") AS ?x) (COALESCE(?zz, ?n, "none") AS ?y) (sameTerm(?n, ?n) AS ?z) WHERE { ?c c:c_acctbal ?b ; c:c_name ?n }',
        f"SELECT {IRI('customer', 'c_custkey')} AS c, CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END AS x, c_name AS y, true AS z FROM customer",
    ),
    "fn_term": (
        'SELECT ?n (STR(IRI(CONCAT("urn:x:", ?s))) AS ?a) (LANG(STRLANG(?s, "EN")) AS ?b) (STR(DATATYPE(STRDT(?s, xsd:token))) AS ?c) (LANGMATCHES("en-GB", "EN") AS ?d) (STR(SUBJECT(TRIPLE(?n, c:n_name, ?s))) AS ?e) (isTRIPLE(TRIPLE(?n, c:n_name, ?s)) AS ?f) (LANGDIR(STRLANGDIR(?s, "ar", "rtl")) AS ?g) (hasLANG(?s) AS ?h) WHERE { ?n c:n_name ?s }',
        f"SELECT {IRI('nation', 'n_nationkey')} AS n, 'urn:x:' || n_name AS a, 'en' AS b, '{R.XSD}token' AS c, true AS d, {IRI('nation', 'n_nationkey')} AS e, true AS f, 'rtl' AS g, false AS h FROM nation",
    ),
    "casts": (
        "SELECT ?p (xsd:integer(?x) AS ?a) (xsd:double(?z) AS ?b) (xsd:string(?z) AS ?c) (xsd:boolean(?z) AS ?d) (xsd:integer(?n) AS ?e) (xsd:decimal(STR(?z)) AS ?f) WHERE { ?p c:p_retailprice ?x ; c:p_size ?z ; c:p_name ?n }",
        f"SELECT {IRI('part', 'p_partkey')} AS p, trunc(p_retailprice::DECIMAL(18,2))::BIGINT AS a, p_size::DOUBLE AS b, p_size::VARCHAR AS c, p_size <> 0 AS d, NULL::BIGINT AS e, p_size::DOUBLE AS f FROM part",
    ),
    "path_seq_inv": ("SELECT ?r ?c WHERE { ?r ^c:n_regionkey/^c:s_nationkey/c:s_name ?c }", f"SELECT {IRI('region', 'n_regionkey')} AS r, s_name AS c FROM nation JOIN supplier ON s_nationkey = n_nationkey"),
    "path_alt": ("SELECT ?x ?n WHERE { ?x c:c_nationkey|c:s_nationkey ?n }", f"SELECT {IRI('customer', 'c_custkey')} AS x, {IRI('nation', 'c_nationkey')} AS n FROM customer UNION ALL SELECT {IRI('supplier', 's_suppkey')}, {IRI('nation', 's_nationkey')} FROM supplier"),
    "path_neg": ("SELECT ?s ?v WHERE { ?s a t:nation . ?s !(c:n_name|rdf:type|c:n_nationkey) ?v }", f"SELECT {IRI('nation', 'n_nationkey')} AS s, {IRI('region', 'n_regionkey')} AS v FROM nation"),
    "path_opt": ("SELECT ?x WHERE { <urn:t:nation/3> c:n_regionkey? ?x }", f"SELECT 'urn:t:nation/3' AS x UNION SELECT {IRI('region', 'n_regionkey')} FROM nation WHERE n_nationkey = 3"),
    "path_plus": ("SELECT ?y WHERE { <urn:t:supplier/3> (c:s_nationkey|c:n_regionkey)+ ?y }", f"SELECT {IRI('nation', 's_nationkey')} AS y FROM supplier WHERE s_suppkey = 3 UNION SELECT {IRI('region', 'n_regionkey')} FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 3"),
    "path_plus_pairs": (
        "SELECT ?x (COUNT(?y) AS ?n) WHERE { ?x (c:o_custkey|c:c_nationkey|c:n_regionkey)+ ?y . ?x a t:customer } GROUP BY ?x",
        f"SELECT {IRI('customer', 'c_custkey')} AS x, 2::BIGINT AS n FROM customer",
    ),
    "path_star": ("SELECT ?x WHERE { ?x (c:s_nationkey|c:n_regionkey)* <urn:t:region/2> }", f"SELECT 'urn:t:region/2' AS x UNION SELECT {IRI('nation', 'n_nationkey')} FROM nation WHERE n_regionkey = 2 UNION SELECT {IRI('supplier', 's_suppkey')} FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2"),
    "path_plus_cyclic": (
        "SELECT (COUNT(?y) AS ?n) WHERE { <urn:t:nation/1> (c:n_regionkey/^c:n_regionkey)+ ?y }",
        "SELECT count(DISTINCT b.n_nationkey)::BIGINT AS n FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_nationkey = 1",
    ),
    "lineitem_rows": (
        "SELECT ?f (COUNT(?l) AS ?n) WHERE { ?l c:l_returnflag ?f ; c:l_orderkey ?o . ?o c:o_orderpriority \"1-URGENT\" } GROUP BY ?f",
        "SELECT l_returnflag AS f, count(*)::BIGINT AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1",
    ),
    "pricing_summary": (
        """SELECT ?f ?s (SUM(?q) AS ?sum_qty) (SUM(?p) AS ?sum_price) (COUNT(*) AS ?n) WHERE { ?l c:l_returnflag ?f ; c:l_linestatus ?s ; c:l_quantity ?q ; c:l_extendedprice ?p ; c:l_shipdate ?d
             FILTER(?d <= "1998-09-02T00:00:00"^^xsd:dateTime) } GROUP BY ?f ?s ORDER BY ?f ?s""",
        """SELECT l_returnflag AS f, l_linestatus AS s, sum(l_quantity) AS sum_qty, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS sum_price, count(*)::BIGINT AS n
           FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
    ),
}


def dataset(spark, sf_dir: str) -> Dataset:
    return Dataset(spark, tables=parquet_tables(spark, sf_dir))


def _runner(text: str):
    return lambda spark, sf_dir: query(dataset(spark, sf_dir), P + text, typed=True)


QUERIES = {name: _runner(text) for name, (text, _) in SELECTS.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in SELECTS.items()}
