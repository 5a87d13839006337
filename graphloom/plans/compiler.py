"""Algebra to DataFrames.

A pattern becomes a Rel: a DataFrame with a column per variable, how each column holds its terms, and which variables
are never unbound. Joins on variables that are always bound are plain equi-joins on native columns where both sides
hold them alike; triples of one subject over a mapped table become one scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import terms as R
from ..dataset import GRAPH, Dataset
from ..functions.expressions import Scope, evaluate
from ..functions.values import NUMBERS, TERM_REP, Rep, Val, as_term, as_term_rep, boolean, constant, equal, key_equals, lexical, number, numeric_term, of_rep, sort_columns, string_of, text_of
from ..operators.fixpoint import closure, written
from ..sources.mapping import TABLE
from ..terms import Term
from .parser import Query, SparqlError, children, expr_vars, inner_vars, node_vars, pattern_vars

IRI_REP = Rep("iri")


def column_name(var: str) -> str:
    """Spark's names ignore case, SPARQL's don't."""
    return "v_" + re.sub(r"[A-Z~.`]", lambda m: f"~{ord(m[0]):x}", var)


def col(var: str) -> Column:
    return F.col(f"`{column_name(var)}`")


@dataclass
class Rel:
    df: DataFrame
    vars: dict[str, Rep]
    definite: frozenset = frozenset()
    weight: int = 0  # constants in its patterns: the more, the earlier it joins
    is_unit: bool = False  # one row without variables

    def val(self, v: str) -> Val:
        return of_rep(self.vars[v], col(v))

    def lifted(self, v: str, rep: Rep = TERM_REP) -> "Rel":
        """The same with v held as a term, or as IRI text."""
        if self.vars[v] == rep:
            return self
        new = as_term_rep(self.vars[v], col(v)) if rep.kind == "term" else self.val(v).col
        return replace(self, df=self.df.withColumn(column_name(v), new), vars=self.vars | {v: rep})

    def only(self, vars: list[str]) -> "Rel":
        return replace(self, df=self.df.select(*[col(v) for v in vars]), vars={v: self.vars[v] for v in vars}, definite=self.definite & set(vars))


def stored(v: Val) -> tuple[Rep, Column]:
    if v.rep is not None and v.key is not None:
        return v.rep, v.key
    return (IRI_REP if v.kind == "iri" else Rep(v.kind)), v.col


def aligned(a: Rel, b: Rel, shared: list[str]) -> tuple[Rel, Rel]:
    """Both hold the shared variables alike."""
    for v in shared:
        if a.vars[v] != b.vars[v]:
            rep = IRI_REP if a.vars[v].kind == b.vars[v].kind == "iri" else TERM_REP
            a, b = a.lifted(v, rep), b.lifted(v, rep)
    return a, b


class Compiler:
    def __init__(self, dataset: Dataset, base: str = ""):
        self.ds, self.base, self.spark = dataset, base, dataset.spark
        self.now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        self.graph: str | tuple = ""  # '' default, an IRI, ("var", name)
        self.fresh = 0
        #: constants that a filter right above a basic graph pattern compares its variables with
        self.bounds: dict[str, list[tuple[str, float]]] = {}

    def hidden(self) -> str:
        self.fresh += 1
        return f".h{self.fresh}"

    def unit(self) -> Rel:
        return Rel(self.spark.range(1).select(F.lit(1).alias("unit")), {}, is_unit=True)

    def empty(self, vars) -> Rel:
        vars = sorted(vars)
        cols = ", ".join(f"`{column_name(v)}` {R.TERM_DDL}" for v in vars) or "unit int"
        return Rel(self.spark.createDataFrame([], cols), dict.fromkeys(vars, TERM_REP), frozenset(vars))

    def scope(self, rel: Rel) -> Scope:
        return Scope({v: rel.val(v) for v in rel.vars}, self.base, now=self.now)

    # patterns
    def compile(self, p: tuple) -> Rel:
        return getattr(self, "_" + p[0])(*p[1:])

    def _group(self, p) -> Rel:
        return self.compile(p)

    def _join(self, a, b) -> Rel:
        left = self.compile(a)
        if b[0] == "path" and b[2][0] in ("plus", "star") and not isinstance(self.graph, tuple):
            s, p, o = b[1:]
            if not isinstance(s, Term) and not isinstance(o, Term):
                # the walk starts from what the rest of the pattern leaves
                for end in (s, o):
                    if end[1] in left.definite:
                        return self.join(left, self._closure(p[0], s, p[1], o, (left, end[1], end is o and s != o)))
        return self.join(left, self.compile(b))

    def _select(self, q: Query) -> Rel:
        return self.solve(q)

    def _union(self, a, b) -> Rel:
        return self.union(self.compile(a), self.compile(b))

    def union(self, a: Rel, b: Rel) -> Rel:
        a, b = aligned(a, b, [v for v in a.vars if v in b.vars])
        names = [*a.vars, *(v for v in b.vars if v not in a.vars)]
        reps = a.vars | b.vars
        fill = lambda r: r.df.select(*[col(v) if v in r.vars else F.lit(None).cast(_spark_type(a if v in a.vars else b, v)).alias(column_name(v)) for v in names] or [F.lit(1).alias("unit")])
        return Rel(fill(a).union(fill(b)), {v: reps[v] for v in names}, a.definite & b.definite)

    def _filter(self, e, p) -> Rel:
        base = p
        while base[0] in ("filter", "bind"):
            base = base[2] if base[0] == "filter" else base[1]
        before = self.bounds
        if base[0] == "bgp":
            self.bounds = before | _bounds(e)
        try:
            rel = self.compile(p)
        finally:
            self.bounds = before
        return self.filter(rel, e)

    def filter(self, rel: Rel, e: tuple) -> Rel:
        if e[0] == "op" and e[1] == "&&":
            return self.filter(self.filter(rel, e[2]), e[3])
        if e[0] == "not" and e[1][0] == "exists":
            e = ("exists", e[1][1], not e[1][2])
        if e[0] == "exists":
            return self._semi(rel, e[1], e[2])
        rel, e = self._with_existence(rel, e)
        out = replace(rel, df=rel.df.where(boolean(evaluate(e, self.scope(rel)))))
        return replace(out, definite=out.definite | self._strict(e) & set(rel.vars))

    def _strict(self, e: tuple) -> frozenset:
        """Variables that must be bound for e to be true."""
        if e[0] == "op" and e[1] in ("=", "<", ">", "<=", ">=", "!="):
            return frozenset(x[1] for x in e[2:] if x[0] == "var")
        if e[0] == "call" and e[1] == "BOUND":
            return frozenset({e[2][0][1]})
        return frozenset()

    def _with_existence(self, rel: Rel, e: tuple) -> tuple[Rel, tuple]:
        """EXISTS inside an expression becomes a column."""
        if e[0] == "exists":
            inner, use = self._seeded(rel, e[1])
            flag = self.hidden()
            found = inner.only(use).df.distinct().withColumn(column_name(flag), F.lit(True)) if use else inner.df.limit(1).select(F.lit(True).alias(column_name(flag)))
            renamed = found.select(*[col(v).alias("r" + column_name(v)) for v in use], col(flag))
            base = rel
            for v in use:
                base = base.lifted(v, inner.vars[v])
            cond = _all([col(v).eqNullSafe(F.col(f"`r{column_name(v)}`")) for v in use]) if use else F.lit(True)
            df = base.df.join(renamed, cond, "left").drop(*["r" + column_name(v) for v in use])
            there = F.coalesce(col(flag), F.lit(False))
            return Rel(df, base.vars, base.definite), ("val", Val("bool", ~there if e[2] else there))
        parts = children(e)
        if not parts or not any(_has_exists(c) for c in parts):
            return rel, e
        if e[0] == "in":
            done = []
            for c in parts:
                rel, c = self._with_existence(rel, c)
                done.append(c)
            return rel, ("in", done[0], tuple(done[1:]), e[3])
        if e[0] in ("call", "cast"):
            done = []
            for c in e[2]:
                rel, c = self._with_existence(rel, c)
                done.append(c)
            return rel, (e[0], e[1], tuple(done))
        if e[0] == "op":
            rel, a = self._with_existence(rel, e[2])
            rel, b = self._with_existence(rel, e[3])
            return rel, ("op", e[1], a, b)
        rel, a = self._with_existence(rel, e[1])
        return rel, (e[0], a)

    def _seeded(self, rel: Rel, p: tuple) -> tuple[Rel, list[str]]:
        """The pattern joined with the distinct outer bindings that it mentions, so that its filters see them."""
        use = sorted(v for v in inner_vars(p) if v in rel.vars)
        seed = rel.only(use)
        seed = replace(seed, df=seed.df.distinct()) if use else None

        return (self.compile_seeded(p, seed) if seed is not None else self.compile(p)), use

    def compile_seeded(self, p: tuple, seed: Rel) -> Rel:
        """A pattern evaluated for given solutions: they join where evaluation starts, so what follows sees them."""
        kind = p[0]
        if kind == "filter":
            return self.filter(self.compile_seeded(p[2], seed), p[1])
        if kind == "group":
            return self.compile_seeded(p[1], seed)
        if kind == "bind":
            return self.extend(self.compile_seeded(p[1], seed), p[2], p[3])
        if kind == "join":
            return self.join(self.compile_seeded(p[1], seed), self.compile(p[2]))
        if kind == "optional":
            return self.optional(self.compile_seeded(p[1], seed), p[2])
        if kind == "minus":
            return self.minus(self.compile_seeded(p[1], seed), p[2])
        if kind == "union":
            return self.union(self.compile_seeded(p[1], seed), self.compile_seeded(p[2], seed))
        return self.join(seed, self.compile(p))

    def _semi(self, rel: Rel, p: tuple, negated: bool) -> Rel:
        bound = pattern_vars(p)
        use = {v for v in inner_vars(p) if v in rel.vars}
        how = "left_anti" if negated else "left_semi"
        if use <= bound and use <= rel.definite:
            inner = self.compile(p)
            shared = sorted(use)
            if all(v in inner.definite for v in shared):
                if not shared:
                    return self._keep_if(rel, inner, negated)
                a, b = aligned(rel, inner, shared)
                right = b.df.select(*[col(v).alias("r" + column_name(v)) for v in shared])
                return replace(a, df=a.df.join(right, _all([col(v) == F.col(f"`r{column_name(v)}`") for v in shared]), how))
        inner, names = self._seeded(rel, p)
        if not names:
            return self._keep_if(rel, inner, negated)
        for v in names:
            rel = rel.lifted(v, inner.vars[v])
        right = inner.df.select(*[col(v).alias("r" + column_name(v)) for v in names]).distinct()
        return replace(rel, df=rel.df.join(right, _all([col(v).eqNullSafe(F.col(f"`r{column_name(v)}`")) for v in names]), how))

    def _keep_if(self, rel: Rel, inner: Rel, negated: bool) -> Rel:
        there = inner.df.limit(1).select(F.lit(True).alias("there"))
        return replace(rel, df=rel.df.join(F.broadcast(there), F.lit(True), "left_anti" if negated else "left_semi"))

    def _bind(self, p, var, e) -> Rel:
        rel = self.compile(p)
        return self.extend(rel, var, e)

    def extend(self, rel: Rel, var: str, e: tuple) -> Rel:
        rel, e = self._with_existence(rel, e)
        rep, c = stored(evaluate(e, self.scope(rel)))
        sure = e[0] == "term" or e[0] == "var" and e[1] in rel.definite
        return replace(rel, df=rel.df.withColumn(column_name(var), c), vars=rel.vars | {var: rep}, definite=rel.definite | ({var} if sure else set()))

    def _values(self, names, rows) -> Rel:
        reps, cols = {}, []
        for i, n in enumerate(names):
            kinds = {constant(r[i]).kind for r in rows if r[i] is not None}
            kind = kinds.pop() if len(kinds) == 1 else "term"
            reps[n] = Rep(kind) if kind in ("str", "int", "iri", "bool") else TERM_REP
            cols.append(f"`{column_name(n)}` " + {"str": "string", "int": "bigint", "iri": "string", "bool": "boolean"}.get(kind, R.TERM_DDL))

        def cell(n, t):
            if t is None:
                return None
            kind = reps[n].kind
            return (t.k, t.v, t.dt, t.lang, t.dir) if kind == "term" else t.v if kind in ("str", "iri") else t.value()

        if not names:
            return Rel(self.spark.range(len(rows)).select(F.lit(1).alias("unit")), {})
        df = self.spark.createDataFrame([tuple(cell(n, t) for n, t in zip(names, r, strict=True)) for r in rows], ", ".join(cols))
        return Rel(df, reps, frozenset(n for i, n in enumerate(names) if all(r[i] is not None for r in rows)), weight=3)

    def _graph(self, g, p) -> Rel:
        outer = self.graph
        self.graph = g.v if isinstance(g, Term) else g
        try:
            rel = self.compile(p)
            if not isinstance(g, Term) and g[1] not in rel.vars:
                names = Rel(self.ds.graph_names().select(F.col("g").alias(column_name(g[1]))), {g[1]: IRI_REP}, frozenset({g[1]}))
                rel = self.join(rel, names)
            return rel
        finally:
            self.graph = outer

    # joins
    def join(self, a: Rel, b: Rel) -> Rel:
        for x, y in ((a, b), (b, a)):
            if not x.vars and x.is_unit:
                return y
            if not x.vars:
                return replace(y, df=y.df.crossJoin(x.df.select()))
        shared = [v for v in a.vars if v in b.vars]
        a, b = aligned(a, b, shared)
        sure = [v for v in shared if v in a.definite and v in b.definite]
        loose = [v for v in shared if v not in sure]
        vars = a.vars | b.vars
        definite = a.definite | b.definite
        if not shared:
            return Rel(a.df.crossJoin(b.df), vars, definite, a.weight + b.weight)
        if not loose:
            return Rel(a.df.join(b.df, [column_name(v) for v in shared]), vars, definite, a.weight + b.weight)
        if sure:
            return Rel(self._compatible(a.df, b, shared, sure), vars, definite)
        out = [self._ordered(df, vars) for df in self._meetings(a, b, shared)]
        return Rel(reduce(DataFrame.union, out), vars, definite)

    def _masks(self, rel: Rel, shared: list[str]) -> list[int]:
        """Which of the shared variables a row may bind, as bits."""
        return [m for m in range(1 << len(shared)) if all(m >> i & 1 for i, v in enumerate(shared) if v in rel.definite)]

    def _beside(self, b: Rel, shared: list[str]) -> DataFrame:
        """The right side with its shared variables renamed, and the bits of those that a row binds."""
        right = b.df.select(*[col(v).alias(("r" if v in shared else "") + column_name(v)) for v in b.vars])
        return right.withColumn("rbits", _bits([F.col(f"`r{column_name(v)}`") for v in shared]))

    def _meetings(self, a: Rel, b: Rel, shared: list[str], extra: Column | None = None) -> list[DataFrame]:
        """The compatible pairs of rows where no variable is sure to be bound on both sides.

        Pairs that bind a variable in common meet by equality on all such variables: each row goes once for each set of
        variables that the other side may bind. Pairs that bind none in common are all solutions, so they are a product.
        """
        left, right = a.df.withColumn("lbits", _bits([col(v) for v in shared])), self._beside(b, shared)
        masks_a, masks_b = self._masks(a, shared), self._masks(b, shared)
        r = {v: F.col(f"`r{column_name(v)}`") for v in shared}
        some = F.lit(True) if extra is None else extra
        both = F.col("lbits").bitwiseAND(F.col("lother")), F.col("rbits").bitwiseAND(F.col("rother"))
        here = left.withColumn("lother", F.explode(F.array(*[F.lit(m) for m in masks_b]))).where(both[0] != 0)
        there = right.withColumn("rother", F.explode(F.array(*[F.lit(m) for m in masks_a]))).where(both[1] != 0)
        key = lambda bits, i, c: F.when(bits.bitwiseAND(1 << i) != 0, c)
        cond = [F.col("lbits") == F.col("rother"), F.col("lother") == F.col("rbits"), *[key(both[0], i, col(v)).eqNullSafe(key(both[1], i, r[v])) for i, v in enumerate(shared)]]
        out = [here.join(there, _all(cond) & some)]
        for m in masks_a:
            if any(not m & k for k in masks_b):
                out.append(left.where(F.col("lbits") == m).join(right.where(F.col("rbits").bitwiseAND(m) == 0), some, "cross" if extra is None else "inner"))
        return [df.withColumns({column_name(v): F.coalesce(col(v), r[v]) for v in shared}).drop("lbits", "rbits", "lother", "rother", *["r" + column_name(v) for v in shared]) for df in out]

    def _unmet(self, a: Rel, b: Rel, shared: list[str], common: bool, extra: Column | None = None) -> DataFrame:
        """The rows of the left side without a compatible row on the right (common: one that binds a variable in common)."""
        left, right = a.df.withColumn("lbits", _bits([col(v) for v in shared])), self._beside(b, shared)
        masks_a = self._masks(a, shared)
        for m in self._masks(b, shared):
            side = right.where(F.col("rbits") == m)
            bound = [v for i, v in enumerate(shared) if m >> i & 1]
            sets = sorted({m & k for k in masks_a} - {0})
            if sets:  # a copy for each set of variables that both sides may bind, the others null
                copies = side.withColumn("rother", F.explode(F.array(*[F.lit(k) for k in sets])))
                copies = copies.withColumns({"k" + column_name(v): F.when(F.col("rother").bitwiseAND(1 << i) != 0, F.col(f"`r{column_name(v)}`")) for i, v in enumerate(shared) if v in bound})
                copies = copies.select(*[F.col(f"`k{column_name(v)}`") for v in bound]).distinct() if extra is None else copies
                cond = _all([col(v).eqNullSafe(F.col(f"`k{column_name(v)}`")) for v in bound])
                left = left.join(copies, cond if extra is None else cond & extra, "left_anti")
            if not common and any(not m & k for k in masks_a):
                there = F.broadcast(side.limit(1).select(F.lit(True).alias("there"))) if extra is None else side
                cond = F.col("lbits").bitwiseAND(m) == 0
                left = left.join(there, cond if extra is None else cond & extra, "left_anti")
        return left.drop("lbits")

    def _ordered(self, df: DataFrame, vars) -> DataFrame:
        return df.select(*[col(v) for v in vars])

    def _compatible(self, left: DataFrame, b: Rel, shared, sure, how: str = "inner", extra: Column | None = None) -> DataFrame:
        right = b.df.select(*[col(v).alias(("r" if v in shared else "") + column_name(v)) for v in b.vars])
        r = {v: F.col(f"`r{column_name(v)}`") for v in shared}
        cond = [col(v) == r[v] for v in sure] + [col(v).isNull() | r[v].isNull() | (col(v) == r[v]) for v in shared if v not in sure]
        if extra is not None:
            cond.append(extra)
        out = left.join(right, _all(cond) if cond else F.lit(True), how)
        merged = {column_name(v): F.coalesce(col(v), r[v]) for v in shared if v not in sure}
        return (out.withColumns(merged) if merged else out).drop(*["r" + column_name(v) for v in shared])

    def _optional(self, a, b) -> Rel:
        return self.optional(self.compile(a), b)

    def optional(self, left: Rel, b: tuple) -> Rel:
        filters = []
        while b[0] in ("filter", "group") and (b[0] == "group" or not _has_exists(b[1])):
            if b[0] == "filter":
                filters.append(b[1])
                b = b[2]
            else:
                b = b[1]
        right = self.compile(b)
        shared = [v for v in left.vars if v in right.vars]
        left, right = aligned(left, right, shared)
        sure = [v for v in shared if v in left.definite and v in right.definite]
        extra = None
        if filters:
            seen = {v: left.val(v) for v in left.vars}
            for v in right.vars:
                if v not in seen:
                    seen[v] = right.val(v)
                elif v not in left.definite:
                    seen[v] = of_rep(right.vars[v], F.coalesce(col(v), F.col(f"`r{column_name(v)}`")))
            scope = Scope(seen, self.base, now=self.now)
            extra = _all([boolean(evaluate(x, scope)) for f in filters for x in _conjuncts(f)])
        vars = left.vars | right.vars
        if shared and not sure:
            none = self._unmet(left, right, shared, False, extra)
            none = none.select(*[col(v) if v in left.vars else F.lit(None).cast(right.df.schema[column_name(v)].dataType).alias(column_name(v)) for v in vars])
            return Rel(reduce(DataFrame.union, [none, *(self._ordered(df, vars) for df in self._meetings(left, right, shared, extra))]), vars, left.definite)
        df = self._compatible(left.df, right, shared, sure, "left", extra)
        df = df.drop("unit") if left.vars or right.vars else df
        return Rel(df, vars, left.definite)

    def _minus(self, a, b) -> Rel:
        return self.minus(self.compile(a), b)

    def minus(self, left: Rel, b: tuple) -> Rel:
        right = self.compile(b)
        shared = [v for v in left.vars if v in right.vars]
        if not shared:
            return left
        left, right = aligned(left, right, shared)
        r = {v: F.col(f"`r{column_name(v)}`") for v in shared}
        sure = [v for v in shared if v in left.definite and v in right.definite]
        cond = [col(v) == r[v] for v in sure] + [col(v).isNull() | r[v].isNull() | (col(v) == r[v]) for v in shared if v not in sure]
        if not sure:
            return replace(left, df=self._unmet(left, right, shared, True))
        return replace(left, df=left.df.join(right.df.select(*[col(v).alias("r" + column_name(v)) for v in shared]), _all(cond), "left_anti"))

    # basic graph patterns
    def _bgp(self, triples) -> Rel:
        triples, opened = self._open_triple_terms(list(triples))
        if not triples:
            return self.unit()
        native = self.ds.quads is None and not isinstance(self.graph, tuple)
        stars: dict[tuple, list] = {}
        rels: list[Rel] = []
        known = {}  # subject node to table
        for s, p, o in triples:
            if native and isinstance(p, Term):
                if p.v == R.TYPE and isinstance(o, Term) and o.k == 1 and o.v.startswith(TABLE) and o.v[len(TABLE) :] in self.ds._tables_in(self.graph):
                    stars.setdefault((_key(s), o.v[len(TABLE) :]), []).append((s, None, None))
                    continue
                tables = self.ds.predicate_tables(p.v, self.graph)
                if len(tables) == 1:
                    known[_key(s)] = tables[0][0].name
                    stars.setdefault((_key(s), tables[0][0].name), []).append((s, tables[0][1], o))
                    continue
            rels.append(self._scan(s, p, o))
        rels += [self._star(self.ds.tables[name], parts) for (_, name), parts in stars.items()]
        # the most selective first, then whatever is connected
        rels.sort(key=lambda r: -r.weight)
        out = rels.pop(0)
        while rels:
            i = next((i for i, r in enumerate(rels) if set(r.vars) & set(out.vars)), 0)
            out = self.join(out, rels.pop(i))
        for var, parts in opened:
            out = self._opened(out, var, parts)
        return out

    def _open_triple_terms(self, triples):
        """Triple terms with variables become variables of their own, opened afterwards."""
        opened = []

        def flat(n):
            if isinstance(n, Term) or n[0] == "var":
                return n
            s, p, o = (flat(x) for x in n[1:])
            if isinstance(s, Term) and isinstance(p, Term) and isinstance(o, Term):
                return R.triple_term(s, p.v, o)
            name = self.hidden()
            opened.append((name, (s, p, o)))
            return ("var", name)

        return [tuple(flat(n) for n in t) for t in triples], opened[::-1]

    def _opened(self, rel: Rel, var: str, parts) -> Rel:
        rel = rel.lifted(var)
        cells = R.parts_column(col(var))
        rel = replace(rel, df=rel.df.where(col(var)["k"] == 3))
        for n, c, is_iri in zip(parts, (cells["s"], cells["p"], cells["o"]), (False, True, False), strict=True):
            term = R.make(1, c) if is_iri else c
            if isinstance(n, Term):
                rel = replace(rel, df=rel.df.where(term == R.const(n)))
            elif n[1] in rel.vars:
                rel = rel.lifted(n[1])
                rel = replace(rel, df=rel.df.where(col(n[1]) == term))
            else:
                rel = Rel(rel.df.withColumn(column_name(n[1]), term), rel.vars | {n[1]: TERM_REP}, rel.definite | {n[1]})
        return rel

    def _scan(self, s, p, o) -> Rel:
        """One pattern over the triples as they are."""
        g = None if isinstance(self.graph, tuple) else self.graph
        fixed = lambda n: n if isinstance(n, Term) else None
        if isinstance(s, Term) and s.k == 2:
            return self.empty(node_vars(p) | node_vars(o))
        t = self.ds.triples(g, fixed(s), p.v if isinstance(p, Term) else None, fixed(o))
        cells = [(s, TERM_REP, F.col("s")), (p, IRI_REP, F.col("p")), (o, TERM_REP, F.col("o"))]
        if g is None:
            cells.append((self.graph, IRI_REP, F.col("g")))
        weight = sum(isinstance(n, Term) for n in (s, o)) * 2 + isinstance(p, Term)
        return self._picked(t, cells, weight)

    def _picked(self, df: DataFrame, cells, weight: int) -> Rel:
        reps, cols = {}, {}
        for n, rep, c in cells:
            if isinstance(n, Term) or n is None:
                continue
            if n[1] in reps:  # the same variable twice
                a, b = of_rep(reps[n[1]], cols[n[1]]), of_rep(rep, c)
                df = df.where(cols[n[1]] == c if reps[n[1]] == rep else as_term(a) == as_term(b))
            else:
                reps[n[1]], cols[n[1]] = rep, c
        return Rel(df.select(*[c.alias(column_name(v)) for v, c in cols.items()] or [F.lit(1).alias("unit")]), reps, frozenset(reps), max(weight, 1))

    def _star(self, table, parts) -> Rel:
        """All patterns of one subject over a mapped table: one scan."""
        df, (rep, subject) = table.df, table.subject
        s = parts[0][0]
        weight = 1
        cells = [(s, rep, subject)]
        if isinstance(s, Term):
            df = df.where(key_equals(rep, subject, s) if rep.kind == "iri" else as_term_rep(rep, subject) == R.const(s))
            weight += 4
        for _, c, o in parts:
            if c is None:
                continue
            r, value = table.object(c)
            if isinstance(o, Term):
                df = df.where(_is_term(r, value, o))
                weight += 2
            else:
                df = df.where(F.col(c).isNotNull())
                cells.append((o, r, value))
                if c in table.money:  # the exact test is on a cast; a slightly wider one on the column reaches the scan
                    for op, x in self.bounds.get(o[1], ()):
                        df = df.where(F.col(c) >= F.lit(x - 0.01)) if op in (">", ">=", "=") else df
                        df = df.where(F.col(c) <= F.lit(x + 0.01)) if op in ("<", "<=", "=") else df
        return self._picked(df, cells, weight)

    # paths
    def _path(self, s, p, o) -> Rel:
        return self.compile_path(s, p, o)

    def compile_path(self, s, p, o) -> Rel:
        kind = p[0]
        if kind == "link":
            return self._bgp(((s, Term(1, p[1]), o),))
        if kind == "inv":
            return self.compile_path(o, p[1], s)
        if kind == "seq":
            mid = ("var", self.hidden())
            if p[1][0] == p[2][0] == "link":
                return self._bgp(((s, Term(1, p[1][1]), mid), (mid, Term(1, p[2][1]), o)))
            return self.join(self.compile_path(s, p[1], mid), self.compile_path(mid, p[2], o))
        if kind == "alt":
            return self.union(self.compile_path(s, p[1], o), self.compile_path(s, p[2], o))
        if kind == "neg":
            return self._negated(s, p[1], p[2], o)
        return self._closure(kind, s, p[1], o)

    def _negated(self, s, forward, back, o) -> Rel:
        out = None
        for names, a, b in ((forward, s, o), (back, o, s)):
            if not names and (back if names is forward else forward):
                continue
            v = self.hidden()
            rel = self._scan(a, ("var", v), b)
            rel = replace(rel, df=rel.df.where(~col(v).isin(*names)) if names else rel.df)
            out = rel if out is None else self.union(out, rel)
        return out

    def _closure(self, kind, s, p, o, given: tuple[Rel, str, bool] | None = None) -> Rel:
        """p+, p* and p?: distinct pairs; a constant end, or the values given for one, seed the walk."""
        x, y = self.hidden(), self.hidden()
        edges = self.compile_path(("var", x), p, ("var", y))
        if edges.vars[x] != edges.vars[y]:
            rep = IRI_REP if edges.vars[x].kind == edges.vars[y].kind == "iri" else TERM_REP
            edges = edges.lifted(x, rep).lifted(y, rep)
        rep = edges.vars[x]
        if given and given[0].vars[given[1]] != rep:
            rep = IRI_REP if given[0].vars[given[1]].kind == rep.kind == "iri" else TERM_REP
            edges = edges.lifted(x, rep).lifted(y, rep)
        g = [self.graph[1]] if isinstance(self.graph, tuple) else []
        pairs = edges.df.select(*[col(v).alias("g") for v in g], col(x).alias("s"), col(y).alias("o")).distinct()
        flip = isinstance(o, Term) and not isinstance(s, Term) or bool(given and given[2])
        if flip:
            pairs, s, o = pairs.select(*["g"] * len(g), F.col("o").alias("s"), F.col("s").alias("o")), o, s
        if kind != "opt":
            seeds = pairs.where(_is_term(rep, F.col("s"), s)).select("s").distinct() if isinstance(s, Term) else None
            if given:
                seeds = written(given[0].lifted(given[1], rep).df.select(col(given[1]).alias("s")).distinct())
            pairs = closure(pairs, seeds)
        elif isinstance(s, Term):
            pairs = pairs.where(_is_term(rep, F.col("s"), s))
        if kind != "plus":
            if given:
                same = seeds.select("s", F.col("s").alias("o"))
            elif isinstance(s, Term):
                me = self._as_rep(s, rep)
                if me is None:
                    pairs, rep = pairs.withColumn("s", as_term_rep(rep, F.col("s"))).withColumn("o", as_term_rep(rep, F.col("o"))), TERM_REP
                    me = R.const(s)
                same = self.ds.graph_names().select("g", me.alias("s"), me.alias("o")) if g else self.spark.range(1).select(me.alias("s"), me.alias("o"))
            else:
                pairs, rep = pairs.withColumn("s", as_term_rep(rep, F.col("s"))).withColumn("o", as_term_rep(rep, F.col("o"))), TERM_REP
                t = self.ds.triples(None if g else self.graph)
                n = t.select(*["g"] * len(g), F.col("s").alias("n")).union(t.select(*["g"] * len(g), F.col("o").alias("n")))
                same = n.select(*["g"] * len(g), F.col("n").alias("s"), F.col("n").alias("o"))
            pairs = pairs.union(same).distinct()
        if isinstance(o, Term):
            pairs = pairs.where(_is_term(rep, F.col("o"), o))
        cells = [(s, rep, F.col("s")), (o, rep, F.col("o"))] + ([(self.graph, IRI_REP, F.col("g"))] if g else [])
        return self._picked(pairs, cells, 1)

    def _as_rep(self, t: Term, rep: Rep) -> Column | None:
        if rep.kind == "term":
            return R.const(t)
        if rep.kind == "iri" and t.k == 1 and t.v.startswith(rep.prefix):
            rest = t.v[len(rep.prefix) :]
            if rep.key != "int":
                return F.lit(rest)
            if rest.isdigit():
                return F.lit(int(rest)).cast("bigint")
        return None

    # queries
    def solve(self, q: Query, rel: Rel | None = None) -> Rel:
        """The solutions of a SELECT; rel: those of its pattern, if they are there already."""
        rel = rel or self.compile(q.where)
        if q.values:
            rel = self.join(rel, self._values(*q.values[1:]))
        items, order, having = q.items, q.order, q.having
        from .parser import has_aggregate

        if q.group or having or any(e and has_aggregate(e) for _, e in items) or any(has_aggregate(e) for e, _ in order):
            rel, items, having, order = self._grouped(q, rel)
            for h in having:
                rel = self.filter(rel, h)
        names = sorted(v for v in rel.vars if not v.startswith(".")) if q.star else [n for n, _ in items]
        for n, e in items:
            if e is not None:
                rel = self.extend(rel, n, e)
        for n in names:
            if n not in rel.vars:
                rel = replace(rel, df=rel.df.withColumn(column_name(n), F.lit(None).cast(R.TERM)), vars=rel.vars | {n: TERM_REP})
        if q.distinct:
            loose = {v for e, _ in order for v in expr_vars(e)} - set(names)
            if loose:  # a row stands where its least sort key puts it
                keys = []
                for i, (e, up) in enumerate(order):
                    rel = self.extend(rel, f".o{i}", e)
                    keys.append(col(f".o{i}"))
                agg = [(F.min if up else F.max)(k).alias(column_name(f".o{i}")) for i, (k, (_, up)) in enumerate(zip(keys, order, strict=True))]
                rel = replace(rel, df=rel.df.groupBy(*[col(n) for n in names]).agg(*agg))
                order = [(("var", f".o{i}"), up) for i, (_, up) in enumerate(order)]
            else:
                rel = rel.only(names)
                rel = replace(rel, df=rel.df.distinct())
        if order:
            keys = []
            for e, up in order:
                rel, e = self._with_existence(rel, e)
                keys += [c.asc_nulls_first() if up else c.desc_nulls_last() for c in sort_columns(evaluate(e, self.scope(rel)))]
            rel = replace(rel, df=rel.df.orderBy(*keys))
        if q.offset:
            rel = replace(rel, df=rel.df.offset(q.offset))
        if q.limit is not None:
            rel = replace(rel, df=rel.df.limit(q.limit))
        return rel.only(names) if names else rel

    def _grouped(self, q: Query, rel: Rel):
        keys: list[str] = []
        swaps: list[tuple[tuple, tuple]] = []
        for e, name in q.group:
            if e[0] == "var" and name is None:
                if e[1] in rel.vars:
                    keys.append(e[1])
            else:
                name = name or self.hidden()
                rel = self.extend(rel, name, e)
                swaps.append((e, ("var", name)))
                keys.append(name)
        found: list[tuple] = []

        def collect(e):
            if e[0] == "agg":
                if e not in found:
                    found.append(e)
            else:
                for c in children(e):
                    collect(c)

        for e in [*(e for _, e in q.items if e), *q.having, *(e for e, _ in q.order)]:
            collect(e)
        names = {e: self.hidden() for e in found}
        aggregates, reps = [], {}
        for e in found:
            if e[3] is not None:
                rel, inner = self._with_existence(rel, e[3])
            else:
                inner = None
            v = self._aggregate(e, inner, rel)
            reps[names[e]], c = stored(v)
            aggregates.append(c.alias(column_name(names[e])))
        # keys that Spark would compare by value and SPARQL by term are held as they are: native columns are canonical
        df = rel.df.groupBy(*[col(k) for k in keys]).agg(*aggregates) if aggregates else rel.df.select(*[col(k) for k in keys]).distinct()
        out = Rel(df, {k: rel.vars[k] for k in keys} | reps, frozenset(k for k in keys if k in rel.definite) | frozenset(names[e] for e in found if e[1] == "COUNT"))

        def swapped(e):
            for a, b in swaps:
                if e == a:
                    return b
            if e[0] == "agg":
                return ("var", names[e])
            if e[0] in ("call", "cast"):
                return (e[0], e[1], tuple(map(swapped, e[2])))
            if e[0] == "op":
                return ("op", e[1], swapped(e[2]), swapped(e[3]))
            if e[0] in ("not", "neg"):
                return (e[0], swapped(e[1]))
            if e[0] == "in":
                return ("in", swapped(e[1]), tuple(map(swapped, e[2])), e[3])
            return e

        return out, [(n, swapped(e) if e else None) for n, e in q.items], [self._aliased(swapped(h), q, swapped) for h in q.having], [(swapped(e), up) for e, up in q.order]

    def _aliased(self, e, q, swapped):
        """HAVING may use the aliases of the projection."""
        alias = {n: swapped(x) for n, x in q.items if x}
        if e[0] == "var" and e[1] in alias:
            return alias[e[1]]
        if e[0] in ("call", "cast"):
            return (e[0], e[1], tuple(self._aliased(x, q, swapped) for x in e[2]))
        if e[0] == "op":
            return ("op", e[1], self._aliased(e[2], q, swapped), self._aliased(e[3], q, swapped))
        if e[0] in ("not", "neg"):
            return (e[0], self._aliased(e[1], q, swapped))
        if e[0] == "in":
            return ("in", self._aliased(e[1], q, swapped), tuple(self._aliased(x, q, swapped) for x in e[2]), e[3])
        return e

    def _aggregate(self, e: tuple, inner, rel: Rel) -> Val:
        _, name, distinct, _, sep = e
        if inner is None:
            if not distinct:
                return Val("int", F.count(F.lit(1)))
            every = F.struct(*[col(v) for v in sorted(rel.vars) if not v.startswith(".")])
            return Val("int", F.count_distinct(every))
        v = evaluate(inner, self.scope(rel))
        sure = inner[0] == "var" and inner[1] in rel.definite
        if name == "COUNT":
            c = v.col if v.key is None else v.key
            return Val("int", F.count_distinct(c) if distinct else F.count(c))
        if name == "SAMPLE":
            return Val(v.kind, F.first(v.col, ignorenulls=True))
        if name in ("MIN", "MAX"):
            pick = F.min if name == "MIN" else F.max
            if v.kind not in ("term",):
                return Val(v.kind, pick(v.col))
            keys = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(sort_columns(v))])
            return Val("term", pick(F.when(v.col.isNotNull(), F.struct(keys.alias("k"), v.col.alias("t"))))["t"])
        if name == "GROUP_CONCAT":
            text = text_of(v)
            gather = F.collect_set(text) if distinct else F.collect_list(text)
            return Val("str", F.array_join(F.sort_array(gather), sep))
        whole = F.lit(True) if sure and v.kind != "term" else F.count(v.col) == F.count(F.lit(1))
        if v.kind in NUMBERS:
            wide = v.col if v.kind != "dec" else v.col.cast("decimal(38,10)") if not _is_narrow(v) else v.col
            total = F.sum_distinct(wide) if distinct else F.sum(wide)
            n = F.count_distinct(v.col) if distinct else F.count(v.col)
            if name == "SUM":
                zero = F.lit(0).cast("bigint") if v.kind == "int" else F.lit(0)
                return Val(v.kind, F.when(whole, F.coalesce(total, zero)))
            mean = F.try_divide(total.cast("double"), n)
            return Val("dec" if v.kind in ("int", "dec") else v.kind, F.when(whole, F.coalesce(mean, F.lit(0.0))))
        if v.kind != "term":
            return Val("int", F.when(F.count(v.col) == 0, F.lit(0)).cast("bigint"))
        rank, dec, dbl = number(v)
        all_numbers = F.count(rank) == F.count(F.lit(1))
        top = F.max(rank)
        if distinct:
            cells = F.collect_set(F.when(rank.isNotNull(), F.struct(v.col.alias("t"), dec.alias("d"), dbl.alias("x"))))
            sum_dec = F.aggregate(cells, F.lit(0).cast("decimal(38,10)"), lambda a, c: (a + F.coalesce(c["d"], F.lit(0))).cast("decimal(38,10)"))
            sum_dbl, n = F.aggregate(cells, F.lit(0.0), lambda a, c: a + c["x"]), F.size(cells)
        else:
            sum_dec, sum_dbl, n = F.sum(dec).cast("decimal(38,10)"), F.sum(dbl), F.count(rank)
        empty = F.count(F.lit(1)) == 0
        if name == "SUM":
            out = numeric_term(F.when(all_numbers, F.coalesce(top, F.lit(1))), F.coalesce(sum_dec, F.lit(0)), sum_dbl)
        else:
            mean_dec = F.try_divide(sum_dec, n.cast("decimal(20,0)")).cast("decimal(38,10)")
            rank2 = F.when(empty, 1).when(all_numbers, F.greatest(top, F.lit(2)))
            out = numeric_term(rank2, F.coalesce(mean_dec, F.lit(0)), F.try_divide(sum_dbl, n))
        return Val("term", out)


def _conjuncts(e: tuple) -> list[tuple]:
    return _conjuncts(e[2]) + _conjuncts(e[3]) if e[0] == "op" and e[1] == "&&" else [e]


def _bounds(e: tuple) -> dict[str, list[tuple[str, float]]]:
    """variable: [(sign, number)] of the comparisons with constants that a condition implies."""
    out: dict[str, list[tuple[str, float]]] = {}
    turned = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "=": "="}
    for c in _conjuncts(e):
        if c[0] != "op" or c[1] not in turned:
            continue
        for sign, a, b in ((c[1], c[2], c[3]), (turned[c[1]], c[3], c[2])):
            if a[0] == "var" and b[0] == "term" and b[1].dt in R.NUMERIC and not isinstance(b[1].value(), str):
                out.setdefault(a[1], []).append((sign, float(b[1].value())))
    return out


def _is_narrow(v: Val) -> bool:
    return v.rep is None and v.const is None


def _spark_type(rel: Rel, v: str):
    return rel.df.schema[column_name(v)].dataType


def _key(n) -> tuple:
    return ("t", n.n3) if isinstance(n, Term) else n


def _bits(cols: list[Column]) -> Column:
    """A bit for each column that isn't null."""
    return reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(cols)])


def _all(conds) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def _has_exists(e: tuple) -> bool:
    return e[0] == "exists" or any(map(_has_exists, children(e)))


def _is_term(rep: Rep, c: Column, t: Term) -> Column:
    """Whether a column of a representation holds a given term."""
    if rep.kind == "term":
        return c == R.const(t)
    if rep.kind == "iri":
        return key_equals(rep, c, t)
    if rep.kind == "row":
        return as_term_rep(rep, c) == R.const(t)
    v = constant(t)
    if rep.kind == "dt" and t.dt == R.DATETIME:
        return lexical(Val("dt", c)) == t.v
    if v.kind != rep.kind or t.k != 2:
        return F.lit(False)
    if rep.kind == "int" and str(v.const.value()) != t.v:
        return F.lit(False)
    return equal(Val(rep.kind, c), v)
