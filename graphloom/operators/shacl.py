"""SHACL validation: every constraint is a plan from focus and value nodes to violations.

Focus nodes are a DataFrame (focus), values (focus, value). A constraint gives the rows that violate it; logical
constraints are set algebra over the nodes that fail a shape. The report is the union of all of them.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import terms as R
from ..dataset import Dataset
from ..functions.values import TERM_REP, Val, instant, less
from ..plans.compiler import Compiler, Rel, col, column_name
from ..plans.parser import Parser, Query, SparqlError
from ..terms import SH, Term
from .fixpoint import closure, written
from .reasoning import list_members
from .shapes import IRI, SHNEX, ShapesGraph, path_text

REPORT = ["focus", "path", "value", "shape", "component", "severity", "messages"]
#: Node kinds by the kinds of terms they allow.
KINDS = {"IRI": (1,), "BlankNode": (0,), "Literal": (2,), "BlankNodeOrIRI": (0, 1), "BlankNodeOrLiteral": (0, 2), "IRIOrLiteral": (1, 2), "TripleTerm": (3,)}
_WELL_FORMED = {
    R.BOOLEAN: r"^(true|false|1|0)$", R.DECIMAL: r"^[+-]?(\d+(\.\d*)?|\.\d+)$", R.DOUBLE: r"^([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN)$",
    R.FLOAT: r"^([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN)$",
}



class Validator:
    def __init__(self, data: Dataset, shapes: ShapesGraph):
        self.data, self.shapes, self.spark = data, shapes, data.spark
        self.compiler = Compiler(data)
        self.stack: list[Term] = []

    # relations of the data graph
    @cached_property
    def triples(self) -> DataFrame:
        return self.data.triples("").select("s", "p", "o")

    @cached_property
    def sub_class(self) -> DataFrame:
        e = self.triples.where(F.col("p") == R.RDFS + "subClassOf").select("s", "o")
        return written(closure(e).toDF("c", "d"))

    @cached_property
    def types(self) -> DataFrame:
        """(n, c): every node's classes and their superclasses."""
        t = self.triples.where(F.col("p") == R.TYPE).select(F.col("s").alias("n"), F.col("o").alias("c"))
        up = t.join(self.sub_class, "c").select("n", F.col("d").alias("c"))
        return written(t.union(up).distinct())

    def terms(self, items: list[Term], name: str = "t") -> DataFrame:
        return self.spark.createDataFrame([((t.k, t.v, t.dt, t.lang, t.dir),) for t in items], f"{name} {R.TERM_DDL}")

    def empty(self, *names: str) -> DataFrame:
        return self.spark.createDataFrame([], ", ".join(f"{n} {R.TERM_DDL}" for n in names))

    def along(self, path: tuple, nodes: DataFrame | None = None, a: str = "focus", b: str = "value") -> DataFrame:
        """Distinct (a, b) along a path, from given nodes (a)."""
        rel = self.compiler.compile_path(("var", "a"), path, ("var", "b")).lifted("a").lifted("b")
        out = rel.df.select(col("a").alias(a), col("b").alias(b))
        return (out if nodes is None else out.join(nodes.select(a).distinct(), a, "left_semi")).distinct()

    # focus and values
    def focus(self, shape: Term) -> DataFrame:
        sg, parts = self.shapes, []
        nodes = [t for t in sg.all(shape, "targetNode") if not self._is_expression(t)]
        if nodes:
            parts.append(self.terms(nodes, "focus"))
        for t in sg.all(shape, "targetNode"):
            if self._is_expression(t):
                parts.append(self.expression(t, self.terms([IRI(SH + "this")], "focus")).select(F.col("value").alias("focus")))
        classes = sg.all(shape, "targetClass") + ([shape] if sg.implicit_class(shape) else [])
        if classes:
            parts.append(self.types.join(self.terms(classes, "c"), "c", "left_semi").select(F.col("n").alias("focus")))
        for p in sg.all(shape, "targetSubjectsOf"):
            parts.append(self.triples.where(F.col("p") == p.v).select(F.col("s").alias("focus")))
        for p in sg.all(shape, "targetObjectsOf"):
            parts.append(self.triples.where(F.col("p") == p.v).select(F.col("o").alias("focus")))
        for inner in sg.all(shape, "targetWhere"):
            nodes = self.triples.select(F.col("s").alias("focus")).union(self.triples.select(F.col("o").alias("focus"))).distinct()
            parts.append(nodes.join(self.failing(inner, nodes), "focus", "left_anti"))
        for t in sg.all(shape, "target"):
            if select := sg.one(t, "select"):
                rel = self.select(sg.prologue(t) + select.v, None)
                name = "this" if "this" in rel.vars else next(iter(rel.vars))
                parts.append(rel.lifted(name).df.select(col(name).alias("focus")))
        parts.append(self.triples.where(F.col("p") == SH + "shape").where(F.col("o") == R.const(shape)).select(F.col("s").alias("focus")))
        out = parts[0]
        for x in parts[1:]:
            out = out.union(x)
        return out.distinct()

    def values(self, shape: Term, focus: DataFrame) -> DataFrame:
        sg = self.shapes
        path = sg.one(shape, "path")
        made = sg.one(shape, "values")
        if made is not None:
            return self.made_values(made, focus)
        if path is None:
            return focus.select("focus", F.col("focus").alias("value"))
        return self.along(sg.path(path), focus)

    def made_values(self, made: Term, focus: DataFrame) -> DataFrame:
        """sh:values: a query, an expression of one, or a node expression for each focus node."""
        sg = self.shapes
        if q := sg.one(made, "select"):
            rel = self.select(sg.prologue(made) + q.v, self.seed(focus))
            name = next((n for n in ("value", "result") if n in rel.vars), [v for v in rel.vars if v != "this"][0])
            return rel.lifted(name).lifted("this").df.select(col("this").alias("focus"), col(name).alias("value")).where("value is not null").distinct()
        if e := sg.one(made, "sparqlExpr"):
            parser = Parser(sg.prologue(made), prefixes=R.PREFIXES)
            parser.prologue()
            inner = Parser(e.v, prefixes=parser.prefixes)
            rel = self.compiler.extend(self.seed(focus), "value", inner.expression()).lifted("value")
            return rel.df.select(col("this").alias("focus"), col("value").alias("value")).where("value is not null").distinct()
        return self.expression(made, focus).select("focus", "value").distinct()

    # validation
    def validate(self) -> DataFrame:
        parts = []
        for shape in self.shapes.shapes():
            if not self.deactivated(shape):
                parts += self.check(shape, written(self.focus(shape)))
        out = parts[0] if parts else self.report(self.empty("focus", "value"), IRI(SH + "none"), "none")
        for x in parts[1:]:
            out = out.unionByName(x)
        return out.distinct()

    def deactivated(self, shape: Term) -> bool:
        return any(t.v in ("true", "1") for t in self.shapes.all(shape, "deactivated"))

    def check(self, shape: Term, focus: DataFrame) -> list[DataFrame]:
        """Report rows of a shape for given focus nodes."""
        if self.deactivated(shape):
            return []
        if shape in self.stack:
            raise ValueError(f"recursive shape {shape.n3}")
        self.stack.append(shape)
        try:
            fv = self.values(shape, focus)
            out = []
            for name, handler in CONSTRAINTS.items():
                for arg in self.shapes.all(shape, name):
                    if (off := self.shapes.override(shape, SH + name, arg, "deactivated")) is not None and off.v in ("true", "1"):
                        continue
                    got = handler(self, shape, arg, fv, focus)
                    severity = self.shapes.override(shape, SH + name, arg, "severity")
                    message = self.shapes.override(shape, SH + name, arg, "message")
                    for component, rows, *more in got:
                        out.append(rows if set(REPORT) <= set(rows.columns) else self.report(rows, shape, component, severity, message, *more))
            return out + self.custom(shape, fv, focus)
        finally:
            self.stack.pop()

    def failing(self, shape: Term, nodes: DataFrame) -> DataFrame:
        """The nodes (focus) that don't conform to a shape; every result counts, whatever its severity."""
        nodes = nodes.select("focus").distinct()
        parts = self.check(shape, nodes)
        if not parts:
            return nodes.limit(0)
        roots = []
        for p in parts:
            roots.append(p.select(F.coalesce(F.col("root"), F.col("focus")).alias("focus")) if "root" in p.columns else p.select("focus"))
        out = roots[0]
        for x in roots[1:]:
            out = out.union(x)
        return out.distinct()

    def report(self, rows: DataFrame, shape: Term, component: str, severity: Term | None = None, message: Term | None = None, text: Column | None = None) -> DataFrame:
        sg = self.shapes
        path = sg.one(shape, "path")
        shown = R.const(path) if path is not None and path.k == 1 else R.make(2, F.lit(path_text(sg.path(path))), R.STRING) if path is not None else F.lit(None).cast(R.TERM)
        level = severity or sg.one(shape, "severity") or IRI(SH + "Violation")
        words = [message] if message else sg.all(shape, "message")
        said = F.array(*[F.lit(w.v) for w in words]) if words else F.array(text if text is not None else F.lit(_default_message(component)))
        get = lambda c, other: F.coalesce(F.col(c), other) if c in rows.columns else other
        value = F.col("value") if "value" in rows.columns else F.lit(None).cast(R.TERM)
        cols = [F.col("focus"), get("path", shown).alias("path"), value.alias("value"), R.const(shape).alias("shape"), F.lit(SH + component if ":" not in component else component).alias("component"), F.lit(level.v).alias("severity"), said.alias("messages")]
        return rows.select(*cols, *(["root"] if "root" in rows.columns else []))

    # queries in shapes
    def seed(self, focus: DataFrame, more: dict[str, Term] | None = None, value: bool = False) -> Rel:
        cols = [F.col("focus").alias(column_name("this"))] + ([F.col("value").alias(column_name("value"))] if value else [])
        names = ["this"] + (["value"] if value else [])
        for n, t in (more or {}).items():
            cols.append(R.const(t).alias(column_name(n)))
            names.append(n)
        return Rel(focus.select(*cols).distinct(), dict.fromkeys(names, TERM_REP), frozenset(names))

    def select(self, text: str, seed: Rel | None) -> Rel:
        q: Query = Parser(text, prefixes=R.PREFIXES).query()
        rel = self.compiler.compile_seeded(q.where, seed) if seed is not None else None
        if seed is not None and not q.star:
            q.items = [i for i in q.items if i[0] != "this"] + [("this", None)] if "this" in seed.vars else q.items
            q.items = [(n, e) for n, e in q.items if not (e is not None and n in seed.vars)]
        return self.compiler.solve(q, rel)

    def ask(self, text: str, seed: Rel) -> Rel:
        """The seed rows for which an ASK query has a solution."""
        q = Parser(text, prefixes=R.PREFIXES).query()
        return self.compiler._semi(seed, q.where, negated=False)

    # custom components
    def custom(self, shape: Term, fv: DataFrame, focus: DataFrame) -> list[DataFrame]:
        sg, out = self.shapes, []
        for c in sg.components():
            parameters = [(sg.one(p, "path"), any(t.v == "true" for t in sg.all(p, "optional"))) for p in sg.all(c, "parameter")]
            must = [p for p, optional in parameters if not optional]
            if not must or not all(sg.all(shape, p.v) for p in must):
                continue
            for first in sg.all(shape, must[0].v):
                given = {re.split(r"[#/:]", must[0].v)[-1]: first}
                for p, _ in parameters:
                    if p != must[0] and (x := sg.one(shape, p.v)):
                        given[re.split(r"[#/:]", p.v)[-1]] = x
                given |= {"currentShape": shape} if shape.k == 1 else {}
                path = sg.one(shape, "path")
                own = sg.one(c, "propertyValidator" if path is not None else "nodeValidator") or sg.one(c, "validator")
                if own is None:
                    continue
                message = next(iter(sg.all(own, "message") or sg.all(c, "message")), None)
                if message is not None:
                    message = Term(2, re.sub(r"\{[?$](\w+)\}", lambda m, g=given: g[m[1]].v if m[1] in g else m[0], message.v), message.dt, message.lang)
                if q := sg.one(own, "ask"):
                    seed = self.seed(fv, given, value=True)
                    good = self.ask(sg.prologue(own) + q.v, seed).df.select(col("this").alias("focus"), col("value").alias("value"))
                    rows = fv.select("focus", "value").join(good, ["focus", "value"], "left_anti")
                else:
                    q = sg.one(own, "select")
                    text = q.v.replace("$PATH", path_text(sg.path(path))) if path is not None else q.v
                    rows = self._selected(sg.prologue(own) + text, self.seed(focus, given), path is None)
                out.append(self.report(rows, shape, c.v, None, message))
        return out

    def _selected(self, text: str, seed: Rel, node_shape: bool) -> DataFrame:
        rel = self.select(text, seed)
        for v in ("this", "value", "path"):
            rel = rel.lifted(v) if v in rel.vars else rel
        value = col("value") if "value" in rel.vars else col("this") if node_shape else F.lit(None).cast(R.TERM)
        cols = [col("this").alias("focus"), value.alias("value")] + ([col("path").alias("path")] if "path" in rel.vars else [])
        return rel.df.select(*cols)

    # node expressions
    def _is_expression(self, t: Term) -> bool:
        return t.k == 0 and any(p.startswith((SHNEX, SH)) for p in self.shapes.by.get(t, {}))

    def expression(self, e: Term, focus: DataFrame) -> DataFrame:
        from .node_expressions import evaluate_expression

        return evaluate_expression(self, e, focus)


def _default_message(component: str) -> str:
    name = component.removeprefix(SH).removesuffix("ConstraintComponent")
    return f"Value does not conform to {name[:1].lower() + name[1:]}"


# constraints ----------------------------------------------------------------------------------------------------------

CONSTRAINTS: dict = {}


def constraint(*names):
    def put(f):
        for n in names:
            CONSTRAINTS[n] = f
        return f

    return put


def _bad(fv: DataFrame, ok: Column) -> DataFrame:
    """Values for which a test isn't true; an error violates too."""
    return fv.where(~F.coalesce(ok, F.lit(False)))


def _value() -> Val:
    return Val("term", F.col("value"))


def _counts(fv: DataFrame, focus: DataFrame) -> DataFrame:
    n = fv.groupBy("focus").agg(F.count("value").alias("n"))
    return focus.join(n, "focus", "left").select("focus", F.coalesce("n", F.lit(0)).alias("n"))


@constraint("minCount")
def _(v, shape, arg, fv, focus):
    return [("MinCountConstraintComponent", _counts(fv, focus).where(F.col("n") < int(arg.v)).select("focus"))]


@constraint("maxCount")
def _(v, shape, arg, fv, focus):
    return [("MaxCountConstraintComponent", fv.groupBy("focus").agg(F.count("value").alias("n")).where(F.col("n") > int(arg.v)).select("focus"))]


@constraint("class")
def _(v, shape, arg, fv, focus):
    good = v.types.join(v.terms(v.shapes.listed(arg), "c"), "c", "left_semi").select(F.col("n").alias("value")).distinct()
    return [("ClassConstraintComponent", fv.join(good, "value", "left_anti").select("focus", "value"))]


def well_formed(c: Column, dt: str) -> Column:
    ok = (c["k"] == 2) & (c["dt"] == dt)
    if dt in R.INTEGER_BOUNDS:
        lo, hi = R.INTEGER_BOUNDS[dt]
        n = F.when(c["v"].rlike(r"^[+-]?\d+$"), c["v"].try_cast("decimal(38,0)"))
        ok = ok & c["v"].rlike(r"^[+-]?\d+$") & F.coalesce((F.lit(True) if lo is None else n >= lo) & (F.lit(True) if hi is None else n <= hi), F.lit(lo is None and hi is None))
    elif dt in _WELL_FORMED:
        ok = ok & c["v"].rlike(_WELL_FORMED[dt])
    elif dt in (R.DATETIME, R.DATE, R.TIME):
        ok = ok & instant(Val("term", c)).isNotNull()
    elif dt == R.LANG_STRING:
        ok = ok & (c["lang"] != "")
    return ok


@constraint("datatype")
def _(v, shape, arg, fv, focus):
    ok = F.lit(False)
    for t in v.shapes.listed(arg):
        ok = ok | well_formed(F.col("value"), t.v)
    return [("DatatypeConstraintComponent", _bad(fv, ok))]


@constraint("nodeKind")
def _(v, shape, arg, fv, focus):
    kinds = {k for t in v.shapes.listed(arg) for k in KINDS[t.v.removeprefix(SH)]}
    return [("NodeKindConstraintComponent", _bad(fv, F.col("value.k").isin(*kinds)))]


def _range(name, component, test):
    @constraint(name)
    def _(v, shape, arg, fv, focus):
        bound, value = Val("term", R.const(arg)), _value()
        same_zone = F.lit(True)
        if arg.dt == R.DATETIME:  # with and without an offset can't be compared
            zoned = bool(re.search(r"(Z|[+-]\d\d:\d\d)$", arg.v))
            same_zone = F.col("value.v").rlike(r"(Z|[+-]\d\d:\d\d)$") == F.lit(zoned)
        return [(component, _bad(fv, test(value, bound) & same_zone))]


_range("minExclusive", "MinExclusiveConstraintComponent", lambda v, b: less(b, v, False))
_range("minInclusive", "MinInclusiveConstraintComponent", lambda v, b: less(b, v, True))
_range("maxExclusive", "MaxExclusiveConstraintComponent", lambda v, b: less(v, b, False))
_range("maxInclusive", "MaxInclusiveConstraintComponent", lambda v, b: less(v, b, True))


def _text() -> Column:
    return F.when(F.col("value.k").isin(1, 2), F.col("value.v"))


@constraint("minLength")
def _(v, shape, arg, fv, focus):
    return [("MinLengthConstraintComponent", _bad(fv, F.length(_text()) >= int(arg.v)))]


@constraint("maxLength")
def _(v, shape, arg, fv, focus):
    return [("MaxLengthConstraintComponent", _bad(fv, F.length(_text()) <= int(arg.v)))]


@constraint("pattern")
def _(v, shape, arg, fv, focus):
    flags = v.shapes.one(shape, "flags")
    keep = "".join(c for c in (flags.v if flags else "") if c in "ismx")
    return [("PatternConstraintComponent", _bad(fv, _text().rlike((f"(?{keep})" if keep else "") + arg.v)))]


@constraint("languageIn")
def _(v, shape, arg, fv, focus):
    ok = F.lit(False)
    for t in v.shapes.items(arg):
        ok = ok | (F.col("value.lang") == t.v.lower()) | F.col("value.lang").startswith(t.v.lower() + "-")
    return [("LanguageInConstraintComponent", _bad(fv, ok))]


@constraint("uniqueLang")
def _(v, shape, arg, fv, focus):
    if arg.v not in ("true", "1"):
        return []
    twice = fv.where("value.lang != ''").groupBy("focus", F.col("value.lang").alias("lang")).agg(F.count("*").alias("n")).where("n > 1")
    return [("UniqueLangConstraintComponent", twice.select("focus", "lang"), F.concat(F.lit("More than one value with language "), F.col("lang")))]


@constraint("singleLine")
def _(v, shape, arg, fv, focus):
    return [] if arg.v not in ("true", "1") else [("SingleLineConstraintComponent", _bad(fv, ~_text().rlike(r"[\n\r]")))]


def _other(v, arg, focus) -> DataFrame:
    return v.along(v.shapes.path(arg), focus).select("focus", F.col("value").alias("other"))


@constraint("equals")
def _(v, shape, arg, fv, focus):
    other = _other(v, arg, focus).select("focus", F.col("other").alias("value"))
    return [("EqualsConstraintComponent", fv.select("focus", "value").join(other, ["focus", "value"], "left_anti").union(other.join(fv, ["focus", "value"], "left_anti").select("focus", "value")))]


@constraint("disjoint")
def _(v, shape, arg, fv, focus):
    other = _other(v, arg, focus).select("focus", F.col("other").alias("value"))
    return [("DisjointConstraintComponent", fv.join(other, ["focus", "value"], "left_semi").select("focus", "value"))]


@constraint("subsetOf")
def _(v, shape, arg, fv, focus):
    other = _other(v, arg, focus).select("focus", F.col("other").alias("value"))
    return [("SubsetOfConstraintComponent", fv.join(other, ["focus", "value"], "left_anti").select("focus", "value"))]


def _ordered(or_equal):
    def f(v, shape, arg, fv, focus):
        pairs = fv.join(_other(v, arg, focus), "focus")
        test = less(_value(), Val("term", F.col("other")), or_equal)
        name = "LessThanOrEqualsConstraintComponent" if or_equal else "LessThanConstraintComponent"
        return [(name, _bad(pairs, test).select("focus", "value").distinct())]

    return f


CONSTRAINTS["lessThan"] = _ordered(False)
CONSTRAINTS["lessThanOrEquals"] = _ordered(True)


def _nodes(fv: DataFrame) -> DataFrame:
    return fv.select(F.col("value").alias("focus")).distinct()


def _failing_values(v, inner: Term, fv: DataFrame) -> DataFrame:
    return v.failing(inner, _nodes(fv)).select(F.col("focus").alias("value"))


def _shape_test(component):
    return lambda v, shape, arg, fv, focus: [(component, fv.join(_failing_values(v, arg, fv), "value", "left_semi").select("focus", "value"))]


CONSTRAINTS["node"] = _shape_test("NodeConstraintComponent")
CONSTRAINTS["nodeByExpression"] = _shape_test("NodeByExpressionConstraintComponent")


@constraint("not")
def _(v, shape, arg, fv, focus):
    return [("NotConstraintComponent", fv.join(_failing_values(v, arg, fv), "value", "left_anti").select("focus", "value"))]


@constraint("and")
def _(v, shape, arg, fv, focus):
    bad = None
    for x in v.shapes.items(arg):
        f = _failing_values(v, x, fv)
        bad = f if bad is None else bad.union(f)
    return [] if bad is None else [("AndConstraintComponent", fv.join(bad.distinct(), "value", "left_semi").select("focus", "value"))]


@constraint("or")
def _(v, shape, arg, fv, focus):
    rows = fv.select("focus", "value")
    for x in v.shapes.items(arg):
        rows = rows.join(_failing_values(v, x, fv), "value", "left_semi").select("focus", "value")
    return [("OrConstraintComponent", rows)]


@constraint("xone")
def _(v, shape, arg, fv, focus):
    items = v.shapes.items(arg)
    fails = None
    for x in items:
        f = _failing_values(v, x, fv)
        fails = f if fails is None else fails.union(f)
    n = fails.groupBy("value").agg(F.count("*").alias("n"))
    return [("XoneConstraintComponent", fv.join(n, "value", "left").where(F.lit(len(items)) - F.coalesce("n", F.lit(0)) != 1).select("focus", "value"))]


@constraint("property")
def _(v, shape, arg, fv, focus):
    """Results are those of the property shape; in nested checks they count for the outer focus node."""
    out = []
    for rows in v.check(arg, _nodes(fv)):
        inner = rows.withColumn("at", F.coalesce(F.col("root"), F.col("focus")) if "root" in rows.columns else F.col("focus")).drop("root")
        outer = fv.select(F.col("focus").alias("root"), F.col("value").alias("at"))
        out.append(("PropertyConstraintComponent", inner.join(outer, "at").select(*REPORT, "root")))
    return out


@constraint("qualifiedValueShape")
def _(v, shape, arg, fv, focus):
    sg = v.shapes
    good = fv.join(_failing_values(v, arg, fv), "value", "left_anti").select("focus", "value")
    if any(t.v == "true" for t in sg.all(shape, "qualifiedValueShapesDisjoint")):
        parents = [s for s, ps in sg.by.items() if shape in ps.get(SH + "property", [])]
        siblings = {q for s in parents for p in sg.all(s, "property") if p != shape for q in sg.all(p, "qualifiedValueShape")} - {arg}
        for q in sorted(siblings):
            good = good.join(_failing_values(v, q, fv), "value", "left_semi").select("focus", "value")
    n = _counts(good, focus)
    out = []
    for name, test in (("qualifiedMinCount", lambda k: F.col("n") < k), ("qualifiedMaxCount", lambda k: F.col("n") > k)):
        for t in sg.all(shape, name):
            out.append((name[0].upper() + name[1:] + "ConstraintComponent", n.where(test(int(t.v))).select("focus")))
    return out


@constraint("someValue")
def _(v, shape, arg, fv, focus):
    good = fv.join(_failing_values(v, arg, fv), "value", "left_anti").select("focus").distinct()
    return [("SomeValueConstraintComponent", focus.join(good, "focus", "left_anti").select("focus"))]


@constraint("hasValue")
def _(v, shape, arg, fv, focus):
    have = fv.where(F.col("value") == R.const(arg)).select("focus").distinct()
    return [("HasValueConstraintComponent", focus.join(have, "focus", "left_anti").select("focus"))]


@constraint("in")
def _(v, shape, arg, fv, focus):
    return [("InConstraintComponent", fv.join(v.terms(v.shapes.items(arg), "value"), "value", "left_anti").select("focus", "value"))]


@constraint("closed")
def _(v, shape, arg, fv, focus):
    sg = v.shapes
    own = lambda s: {p.v for x in sg.all(s, "property") for p in sg.all(x, "path") if p.k == 1}
    ignored = {t.v for head in sg.all(shape, "ignoredProperties") for t in sg.items(head)}
    at = _nodes(fv).select(F.col("focus").alias("s"))
    used = v.triples.join(at, "s", "left_semi")
    if arg.v == SH + "ByTypes":
        table = [(c, p) for s in sg.by for c in ([s] if sg.implicit_class(s) else []) + sg.all(s, "targetClass") for p in own(s)]
        allowed = v.spark.createDataFrame([((c.k, c.v, c.dt, c.lang, c.dir), p) for c, p in table], f"c {R.TERM_DDL}, p string")
        allowed = v.types.join(allowed, "c").select(F.col("n").alias("s"), "p").distinct()
        used = used.join(allowed, ["s", "p"], "left_anti").where(~F.col("p").isin(*(own(shape) | ignored | {R.TYPE})))
    elif arg.v in ("true", "1"):
        allowed = own(shape) | ignored
        used = used.where(~F.col("p").isin(*allowed)) if allowed else used
    else:
        return []
    hit = used.select(F.col("s").alias("at"), R.make(1, F.col("p")).alias("path"), F.col("o").alias("found"))
    rows = fv.select("focus", F.col("value").alias("at")).join(hit, "at").select("focus", "path", F.col("found").alias("value"))
    return [("ClosedConstraintComponent", rows)]


def _lists(v, fv) -> DataFrame:
    """(value, i, item, last) of values that are lists; rdf:nil has none."""
    return written(list_members(v.triples, fv.select(F.col("value").alias("head")).distinct()).withColumnRenamed("head", "value"))


@constraint("uniqueMembers")
def _(v, shape, arg, fv, focus):
    if arg.v not in ("true", "1"):
        return []
    twice = _lists(v, fv).groupBy("value", "item").agg(F.count("*").alias("n")).where("n > 1").select("value").distinct()
    return [("UniqueMembersConstraintComponent", fv.join(twice, "value", "left_semi").select("focus", "value"))]


@constraint("memberShape")
def _(v, shape, arg, fv, focus):
    items = _lists(v, fv)
    bad = v.failing(arg, items.select(F.col("item").alias("focus"))).select(F.col("focus").alias("item"))
    hit = items.join(bad, "item", "left_semi").select("value").distinct()
    return [("MemberShapeConstraintComponent", fv.join(hit, "value", "left_semi").select("focus", "value"))]


def _list_length(name, test):
    @constraint(name)
    def _(v, shape, arg, fv, focus):
        n = _lists(v, fv).groupBy("value").agg((F.max("last") + 1).alias("n"))
        sized = fv.join(n, "value", "left").withColumn("n", F.when(F.col("value") == R.const(IRI(R.NIL)), 0).otherwise(F.col("n")))
        return [(name[0].upper() + name[1:] + "ConstraintComponent", _bad(sized, test(F.col("n"), int(arg.v))).select("focus", "value"))]


_list_length("minListLength", lambda n, k: n >= k)
_list_length("maxListLength", lambda n, k: n <= k)


@constraint("reifierShape")
def _(v, shape, arg, fv, focus):
    path = v.shapes.one(shape, "path")
    if path is None or path.k != 1:
        return []
    reified = v.triples.where(F.col("p") == R.REIFIES).select(F.col("s").alias("reifier"), F.col("o").alias("tt"))
    of = fv.withColumn("tt", R.triple_column(F.col("focus"), F.lit(path.v), F.col("value"))).join(reified, "tt")
    bad = v.failing(arg, of.select(F.col("reifier").alias("focus"))).select(F.col("focus").alias("reifier"))
    return [("ReifierShapeConstraintComponent", of.join(bad, "reifier", "left_semi").select("focus", "value"))]


@constraint("reificationRequired")
def _(v, shape, arg, fv, focus):
    path = v.shapes.one(shape, "path")
    if path is None or path.k != 1 or arg.v not in ("true", "1"):
        return []
    reified = v.triples.where(F.col("p") == R.REIFIES).select(F.col("o").alias("tt")).distinct()
    rows = fv.withColumn("tt", R.triple_column(F.col("focus"), F.lit(path.v), F.col("value"))).join(reified, "tt", "left_anti")
    return [("ReifierShapeConstraintComponent", rows.select("focus", "value"))]


@constraint("expression")
def _(v, shape, arg, fv, focus):
    got = v.expression(arg, _nodes(fv))
    true = got.groupBy("focus").agg(F.min(F.col("value") == R.const(Term(2, "true", R.BOOLEAN))).alias("ok")).where("ok").select(F.col("focus").alias("value"))
    return [("ExpressionConstraintComponent", fv.join(true, "value", "left_anti").select("focus", "value"))]


@constraint("sparql")
def _(v, shape, arg, fv, focus):
    sg = v.shapes
    if any(t.v == "true" for t in sg.all(arg, "deactivated")):
        return []
    q = sg.one(arg, "select")
    path = sg.one(shape, "path")
    text = q.v.replace("$PATH", path_text(sg.path(path))) if path is not None else q.v
    message = sg.one(arg, "message")
    try:
        rows = v._selected(sg.prologue(arg) + text, v.seed(focus, {"currentShape": shape} if shape.k == 1 else None), path is None)
    except SparqlError as e:  # a query that can't run violates for every focus node
        rows, message = focus.select("focus"), Term(2, f"query failed: {e}", R.STRING)
    said = F.lit(message.v) if message else None
    if message is not None and "{" in message.v:
        said = F.lit(message.v)
        for name, c in (("this", "focus"), ("value", "value")):
            if c in rows.columns:
                for sign in "?$":
                    said = F.replace(said, F.lit("{" + sign + name + "}"), F.coalesce(F.col(c)["v"], F.lit("")))
    return [("SPARQLConstraintComponent", rows, *([said] if said is not None else []))]


def validate(data: Dataset, shapes: Dataset | ShapesGraph) -> DataFrame:
    """Violations as rows of focus, path, value, shape, component, severity and messages."""
    if isinstance(shapes, Dataset):
        shapes = ShapesGraph([(R.from_row(r.s), r.p, R.from_row(r.o)) for r in shapes.triples("").collect()])
    out = Validator(data, shapes).validate()
    return out.select(*REPORT)


def conforms(report: DataFrame) -> bool:
    return report.where(~F.col("severity").isin(SH + "Debug", SH + "Trace")).isEmpty()


__all__ = ["CONSTRAINTS", "Validator", "conforms", "validate"]
