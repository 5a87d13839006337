"""Every registered query of the graph engine against its SQL on the smallest tables, and plans worth keeping."""

import duckdb
import pytest

from graphloom import family_queries, graph_queries, queries
from graphloom.engine import query

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
EVERY = queries.QUERIES | graph_queries.QUERIES | family_queries.QUERIES
SQL = queries.ORACLE_SQL | graph_queries.ORACLE_SQL | family_queries.ORACLE_SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(rows):
    return sorted(repr(tuple(float(x) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", [n for n in EVERY if n in SQL])
def test_against_sql(spark, duck, name):
    df = EVERY[name](spark, SF)
    got = duck.execute(SQL[name])
    cols = [d[0] for d in got.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    rows = [tuple(r[cols.index(c)] for c in order) for r in got.fetchall()]
    assert normal(tuple(r[c] for c in order) for r in df.collect()) == normal(rows)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_star_is_one_scan_with_pushed_filters(spark):
    p = plan(EVERY["flagship_revenue_by_nation"](spark, SF))
    assert p.count("FileScan") == 3 and "EqualTo(o_orderstatus,F)" in p and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double>" in p


def test_constants_reach_the_scan(spark):
    ds = queries.dataset(spark, SF)
    p = plan(query(ds, queries.P + "SELECT ?n { <urn:t:customer/7> c:c_name ?n }"))
    assert "EqualTo(c_custkey,7)" in p and "c_acctbal" not in p
    p = plan(query(ds, queries.P + 'SELECT ?o { ?o c:o_orderdate ?d FILTER(?d >= "1997-01-01T00:00:00"^^xsd:dateTime) }'))
    assert "GreaterThanOrEqual(o_orderdate" in p
    p = plan(query(ds, queries.P + "SELECT ?n { ?o c:o_custkey <urn:t:customer/7> ; c:o_totalprice ?n }"))
    assert "EqualTo(o_custkey,7)" in p


def test_money_and_optional_filters_reach_the_scan(spark):
    assert "GreaterThanOrEqual(o_totalprice,249999.99)" in plan(EVERY["exists"](spark, SF))
    assert "GreaterThan(l_quantity,45.0)" in plan(EVERY["filter_num"](spark, SF)) and "LessThanOrEqual(l_extendedprice" in plan(EVERY["filter_num"](spark, SF))
    p = plan(query(queries.dataset(spark, SF), queries.P + "SELECT ?c ?k { ?c c:c_name ?n OPTIONAL { ?l c:o_custkey ?c ; c:o_orderkey ?k FILTER(?k > 1000) } }"))
    assert "GreaterThan(o_orderkey,1000)" in p


def test_exists_and_minus_are_semi_and_anti_joins(spark):
    assert "LeftSemi" in plan(EVERY["exists"](spark, SF)) and "LeftAnti" in plan(EVERY["minus"](spark, SF)) and "LeftAnti" in plan(EVERY["not_exists"](spark, SF))


def test_top_k_is_not_a_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(EVERY["order_topk"](spark, SF))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 25 and set(SQL) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_conversation_closure_covers_every_conversation(spark, duck):
    """Brute force over tables whose ids go beyond those of the smallest ones."""
    big = SF.replace("sf0.001", "sf0.01")
    have = set(duck.execute(f"SELECT conv_id, turn FROM '{big}/conversations.parquet'").fetchall())
    want = set()
    for conv, turn in have:
        to = turn + 1
        while (conv, to) in have:
            want.add((f"{conv}-{turn}", f"{conv}-{to}"))
            to += 1
    got = [(r.x, r.y) for r in EVERY["path_conversation_closure"](spark, big).collect()]
    assert max(conv for conv, _ in have) >= 40 and len(got) == len(want) and set(got) == want


def test_a_repeated_variable_joins_its_columns(spark, duck, tmp_path):
    """The registered query over lines whose two columns share values."""
    for t in TABLES:
        if t != "lineitem":
            (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    duck.execute(f"COPY (SELECT * REPLACE (CASE WHEN l_quantity > 25 THEN l_returnflag ELSE l_linestatus END AS l_linestatus) FROM lineitem) TO '{tmp_path}/lineitem.parquet'")
    n = duck.execute(f"SELECT count(*) FROM '{tmp_path}/lineitem.parquet' WHERE l_returnflag = l_linestatus").fetchone()[0]
    assert n > 0 and EVERY["bgp_repeated_variable"](spark, str(tmp_path)).count() == n


class Seen(Exception):
    pass


@pytest.mark.parametrize(
    ("name", "module", "call", "tables"),
    [(n, "reasoning", "inferred", ("nation", "supplier")) for n in ("rdfs_types", "rdfs_subproperty", "owl_transitive", "owl_inverse")]
    + [("owl_inconsistent", "reasoning", "expand_and_check", ("supplier",)), ("rules_recursive", "rules", "evaluate", ("nation", "supplier")), ("rules_stratified_not", "rules", "evaluate", ("customer", "orders"))],
)
def test_reasoning_and_rules_get_all_triples(spark, monkeypatch, name, module, call, tables):
    def stop(*given):
        raise Seen(given)

    monkeypatch.setattr(getattr(graph_queries, module), call, stop)
    with pytest.raises(Seen) as seen:
        EVERY[name](spark, SF)
    given = seen.value.args[0]
    got = given[1].triples("") if module == "rules" else given[0]
    want = graph_queries.mapped(spark, SF, *tables).triples("")
    assert want.select("s", "p", "o").exceptAll(got.select("s", "p", "o")).isEmpty()
