"""Joins, OPTIONAL and MINUS over variables that either side may leave unbound, against brute force."""

import random

import pytest

from graphloom.dataset import Dataset
from graphloom.engine import query
from graphloom.sources.mapping import parquet_tables

pytestmark = pytest.mark.usefixtures("interpreted")
SF = "/root/testdata/sf0.001"


def table(rng, names, n, unbound):
    return [{v: rng.choice("pqr") if v not in unbound or rng.random() < 0.6 else None for v in names} for _ in range(n)]


def values(names, rows):
    cells = " ".join("(" + " ".join("UNDEF" if r[v] is None else f'"{r[v]}"' for v in names) + ")" for r in rows)
    return f"VALUES ({' '.join('?' + v for v in names)}) {{ {cells} }}"


def compatible(a, b):
    return all(a[v] is None or b[v] is None or a[v] == b[v] for v in a.keys() & b.keys())


def merged(a, b):
    return {v: a.get(v) if a.get(v) is not None else b.get(v) for v in a | b}


def shown(rows, names):
    return sorted([tuple(r.get(v) for v in names) for r in rows], key=repr)


@pytest.mark.parametrize("seed", range(6))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    shared = ["x", "y", "z"][: 1 + seed % 3]
    left = table(rng, [*shared, "a"], 7, shared if seed != 4 else shared[:1])
    right = table(rng, [*shared, "b"], 6, shared if seed % 2 else [])
    ds = Dataset.of(spark, [])
    names = [*shared, "a", "b"]
    ask = lambda text: sorted([tuple(None if v is None else v if isinstance(v, str) else v["v"] for v in r) for r in query(ds, f"SELECT {' '.join('?' + n for n in names)} {{ {text} }}").collect()], key=repr)
    one, two = values([*shared, "a"], left), values([*shared, "b"], right)
    pairs = [(a, b) for a in left for b in right if compatible(a, b)]
    assert ask(f"{one} {two}") == shown([merged(a, b) for a, b in pairs], names)
    lone = [a for a in left if not any(compatible(a, b) for b in right)]
    assert ask(f"{one} OPTIONAL {{ {two} }}") == shown([merged(a, b) for a, b in pairs] + lone, names)
    good = [(a, b) for a, b in pairs if merged(a, b)["x"] not in (None, b["b"])]
    rest = [a for a in left if not any(a is g for g, _ in good)]
    assert ask(f"{one} OPTIONAL {{ {two} FILTER(?x != ?b) }}") == shown([merged(a, b) for a, b in good] + rest, names)
    kept = [a for a in left if not any(compatible(a, b) and any(a[v] is not None and b[v] is not None for v in shared) for b in right)]
    assert ask(f"{one} MINUS {{ {two} }}") == shown(kept, names)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * { ?o c:o_orderstatus ?st OPTIONAL { ?o c:o_custkey ?c } MINUS { ?c c:c_mktsegment 'BUILDING' } }",
        "SELECT * { ?o c:o_orderstatus ?st OPTIONAL { ?o c:o_custkey ?c } MINUS { ?c c:c_name ?n } }",
    ],
)
def test_minus_has_no_nested_loop(spark, text):
    ds = Dataset(spark, tables=parquet_tables(spark, SF, ["orders", "customer"]))
    plan = query(ds, "PREFIX c: <urn:c:> " + text)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_products_see_only_rows_that_bind_nothing_in_common(spark):
    ds = Dataset(spark, tables=parquet_tables(spark, SF, ["orders", "customer"]))
    text = "PREFIX c: <urn:c:> SELECT * { ?o c:o_orderstatus ?st OPTIONAL { ?o c:o_custkey ?c } OPTIONAL { ?c c:c_name ?n } }"
    got = query(ds, text)
    logical = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in logical and "Or" not in [w for line in logical.splitlines() if "Join" in line for w in line.split()]
    assert got.count() == spark.read.parquet(f"{SF}/orders.parquet").count()
