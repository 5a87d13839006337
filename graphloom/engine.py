"""Queries and updates over a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import terms as R
from .dataset import Dataset
from .functions.values import Val, as_term, lexical, text_of
from .plans.compiler import Compiler, Rel, col
from .plans.parser import Query, parse_query
from .terms import Term


def query(ds: Dataset, text: str, bindings: dict[str, Term] | None = None, typed: bool = False, base: str = "") -> DataFrame:
    """SELECT: a column per variable (terms, or native values with typed). ASK: one boolean, ask. CONSTRUCT: g, s, p, o."""
    q = parse_query(text, base, tuple(sorted(ds.namespaces.by.items())))
    c = Compiler(ds.restricted(q.from_, q.from_named), q.base)
    if bindings:
        given = ("values", tuple(bindings), (tuple(bindings.values()),))
        q = Query(**{**q.__dict__, "where": ("join", given, q.where)})
        if not q.star and q.form == "SELECT":
            q.items = q.items + [(n, None) for n in bindings if n not in {i for i, _ in q.items} and not q.group]
    if q.form == "ASK":
        rel = c.compile(q.where)
        return rel.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("ask"))
    if q.form == "CONSTRUCT":
        rel = c.solve(Query(**{**q.__dict__, "form": "SELECT", "star": True}))
        return instantiate(rel, [(None, *t) for t in q.template]).distinct()
    rel = c.solve(q)
    return rel.df.select(*[(native(rel.val(v)) if typed else as_term(rel.val(v))).alias(v) for v in rel.vars])


def native(v: Val) -> Column:
    """A value in a plain column type: decimals as doubles, dates and IRIs as text."""
    if v.kind in ("int", "bool", "str", "iri"):
        return v.col
    if v.kind in ("dec", "dbl", "flt"):
        return v.col.cast("double")
    return text_of(v) if v.kind == "term" else lexical(v)


def instantiate(rel: Rel, template: list[tuple], stable: bool = False) -> DataFrame:
    """Quads of a template for each solution; ill-formed ones are left out, blank nodes are new in each solution.
    stable: named by the solution, so that the same solution gives the same nodes again."""
    df, fresh = rel.df, any(isinstance(n, Term) and n.k == 0 for t in template for n in _flat(t[1:]))
    if fresh:
        name = F.md5(F.to_json(F.struct(*[as_term(rel.val(v)).alias(f"c{i}") for i, v in enumerate(sorted(rel.vars))], F.lit(0).alias("c")))) if stable else F.replace(F.expr("uuid()"), F.lit("-"))
        df = df.withColumn("solution", name)

    def cell(n) -> Column:
        if isinstance(n, Term):
            return R.make(0, F.concat(F.lit("c"), F.col("solution"), F.lit("x" + n.v.lstrip(".")))) if n.k == 0 else R.const(n)
        if n[0] == "fixed":
            return R.const(n[1])
        if n[0] == "tt":
            p = cell(n[2])
            return R.triple_column(cell(n[1]), F.when(p["k"] == 1, p["v"]), cell(n[3]))
        return as_term(rel.val(n[1])) if n[1] in rel.vars else F.lit(None).cast(R.TERM)

    quads = []
    for g, s, p, o in template:
        graph = F.lit(g if isinstance(g, str) else "") if g is None or isinstance(g, str) else cell(g)["v"]
        if isinstance(g, tuple):
            graph = F.coalesce(F.when(cell(g)["k"] == 1, cell(g)["v"]), F.lit(""))
        pc = cell(p)
        quads.append(F.struct(graph.alias("g"), cell(s).alias("s"), F.when(pc["k"] == 1, pc["v"]).alias("p"), cell(o).alias("o")))
    if not quads:
        return rel.df.sparkSession.createDataFrame([], R.QUADS)
    out = df.select(F.explode(F.array(*quads)).alias("q")).select("q.*")
    return out.where("s is not null and s.k != 2 and p is not null and o is not null")


def _flat(nodes):
    for n in nodes:
        if isinstance(n, tuple) and n[0] == "tt":
            yield from _flat(n[1:])
        else:
            yield n


def same_results(a: DataFrame, b: DataFrame) -> bool:
    """Bag equality of SELECT results: numbers by value, blank nodes as one placeholder."""

    def canonical(df):
        def term(r):
            if r is None:
                return None
            t = R.from_row(r)
            v = t.value()
            return ("bnode",) if t.k == 0 else ("num", float(v)) if t.k == 2 and t.dt in R.NUMERIC and not isinstance(v, str) else (t.k, t.v, t.dt, t.lang, t.dir)

        names = sorted(df.columns)
        return sorted(repr([term(r[n]) for n in names]) for r in df.collect()), names

    return canonical(a) == canonical(b)
