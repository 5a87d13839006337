"""RDFS and OWL 2 RL: rules as joins in a semi-naive fixpoint, the schema as small relations, inconsistency checks.

A graph is a DataFrame of (s, p, o). Every rule is a function of the triples new in a round and all triples; joins with
schema relations (subclass, domain, ...) are against closures that are computed before the instance rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import terms as R
from ..terms import Term
from .fixpoint import closure, components, fixpoint, written

O, RS = R.OWL, R.RDFS
SCHEMA = {
    "sub_class": RS + "subClassOf", "sub_property": RS + "subPropertyOf", "domain": RS + "domain", "range": RS + "range", "inverse": O + "inverseOf",
    "same_property": O + "equivalentProperty", "same_class": O + "equivalentClass", "has_value": O + "hasValue", "on_property": O + "onProperty",
    "some": O + "someValuesFrom", "all": O + "allValuesFrom", "max": O + "maxCardinality", "max_q": O + "maxQualifiedCardinality", "on_class": O + "onClass",
    "intersection": O + "intersectionOf", "union": O + "unionOf", "one_of": O + "oneOf", "chain": O + "propertyChainAxiom", "key": O + "hasKey",
    "disjoint": O + "disjointWith", "disjoint_property": O + "propertyDisjointWith", "complement": O + "complementOf", "members": O + "members",
}
SAME = O + "sameAs"


def _iri(c: Column) -> Column:
    """The text of IRI terms, else null."""
    return F.when(c["k"] == 1, c["v"])


def _of(t: DataFrame, p: str, s: str = "s", o: str = "o") -> DataFrame:
    return t.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))


def _typed(t: DataFrame, c: str) -> DataFrame:
    return t.where((F.col("p") == R.TYPE) & (F.col("o") == R.const(Term(1, c)))).select("s")


def _triples(df: DataFrame, s, p, o) -> DataFrame:
    col = lambda x: F.col(x) if isinstance(x, str) else x
    return df.select(col(s).alias("s"), col(p).alias("p"), col(o).alias("o")).where("s.k != 2 and p is not null")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def list_members(t: DataFrame, heads: DataFrame) -> DataFrame:
    """(head, i, item, last) of the RDF lists that start at heads(head); cyclic lists are walked once around."""
    cells = _of(t, R.REST, "cell", "rest").join(_of(t, R.FIRST, "cell", "item"), "cell")
    cells = written(cells)
    start = heads.select("head", F.col("head").alias("at"), F.lit(0).alias("i"))

    def step(new, total):
        nxt = new.join(cells, new["at"] == cells["cell"]).select("head", F.col("rest").alias("at"), (F.col("i") + 1).alias("i"))
        been = total.select("head", "at").distinct()
        return nxt.join(been, ["head", "at"], "left_anti")

    walked = fixpoint(start, step, None)  # a cell is met once
    items = walked.join(cells, walked["at"] == cells["cell"]).select("head", "i", "item")
    size = items.groupBy("head").agg(F.max("i").alias("last"))
    return items.join(size, "head")


def _closed(edges: DataFrame) -> DataFrame:
    """Transitive closure of (s, o) without s = o made by cycles being lost."""
    return closure(edges.select("s", "o"))


class Schema:
    """Schema relations of a graph, closed and small beside the data."""

    def __init__(self, t: DataFrame, owl: bool):
        sub_c, sub_p = _of(t, SCHEMA["sub_class"]), _of(t, SCHEMA["sub_property"])
        if owl:
            for kind, into in (("same_class", "c"), ("same_property", "p")):
                eq = _of(t, SCHEMA[kind])
                both = eq.union(eq.select(F.col("o").alias("s"), F.col("s").alias("o")))
                if into == "c":
                    sub_c = sub_c.union(both)
                else:
                    sub_p = sub_p.union(both)
        self.sub_class = _closed(sub_c).where("s != o").toDF("c", "d")
        self.sub_property = _closed(sub_p).where("s != o").select(_iri(F.col("s")).alias("sp"), _iri(F.col("o")).alias("tp")).where("sp is not null and tp is not null")
        self.domain = _of(t, SCHEMA["domain"], "x", "c").select(_iri(F.col("x")).alias("dp"), "c")
        self.range = _of(t, SCHEMA["range"], "x", "c").select(_iri(F.col("x")).alias("rp"), "c")
        if owl:
            self._owl(t)

    def _owl(self, t: DataFrame) -> None:
        prop = lambda name: written(_typed(t, O + name).select(_iri(F.col("s")).alias("xp")).where("xp is not null"))
        self.symmetric, self.transitive = prop("SymmetricProperty"), prop("TransitiveProperty")
        self.functional, self.inverse_functional = prop("FunctionalProperty"), prop("InverseFunctionalProperty")
        inv = _of(t, SCHEMA["inverse"])
        self.inverse = written(inv.union(inv.select("o", "s")).select(_iri(F.col("s")).alias("ip"), _iri(F.col("o")).alias("iq")).distinct())
        on = _of(t, SCHEMA["on_property"], "r", "x").select("r", _iri(F.col("x")).alias("op"))
        restriction = lambda kind: written(_of(t, SCHEMA[kind], "r", "y").join(on, "r"))
        self.has_value, self.some, self.all = restriction("has_value"), restriction("some"), restriction("all")
        one = lambda kind, n: restriction(kind).where((F.col("y.k") == 2) & (F.col("y.v") == n)).select("r", "op")
        self.max1, self.max0 = one("max", "1"), one("max", "0")
        on_class = _of(t, SCHEMA["on_class"], "r", "oc")
        self.max1q, self.max0q = one("max_q", "1").join(on_class, "r"), one("max_q", "0").join(on_class, "r")
        heads = {k: _of(t, SCHEMA[k], "c", "head") for k in ("intersection", "union", "one_of", "chain", "key", "members")}
        every = written(_union([h.select("head") for h in heads.values()]).distinct())
        members = written(list_members(t, every))
        self.lists = {k: written(h.join(members, "head")) for k, h in heads.items()}
        self.has = {k: not v.isEmpty() for k, v in self.lists.items()}
        self.has |= {k: not getattr(self, k).isEmpty() for k in ("symmetric", "transitive", "functional", "inverse_functional", "inverse", "has_value", "some", "all", "max1", "max1q")}


# rules ----------------------------------------------------------------------------------------------------------------


def _property_rules(t: DataFrame, sc: Schema) -> list[DataFrame]:
    """rdfs2, rdfs3, rdfs7 and rdfs9 on triples."""
    types = t.where(F.col("p") == R.TYPE)
    return [
        _triples(t.join(sc.domain, F.col("p") == F.col("dp")), "s", F.lit(R.TYPE), "c"),
        _triples(t.where("o.k != 2").join(sc.range, F.col("p") == F.col("rp")), "o", F.lit(R.TYPE), "c"),
        _triples(t.join(sc.sub_property, F.col("p") == F.col("sp")), "s", "tp", "o"),
        _triples(types.join(sc.sub_class, F.col("o") == F.col("c")), "s", F.lit(R.TYPE), "d"),
    ]


def _pairs(new: DataFrame, total: DataFrame, join) -> list[DataFrame]:
    """A rule with two instance atoms: new with all, and all with new."""
    return [join(new, total), join(total, new)]


def _owl_rules(new: DataFrame, total: DataFrame, sc: Schema) -> list[DataFrame]:
    out = []
    typ = lambda t: t.where(F.col("p") == R.TYPE).select(F.col("s").alias("x"), F.col("o").alias("c"))
    if sc.has["symmetric"]:
        out.append(_triples(new.join(sc.symmetric, F.col("p") == F.col("xp")), "o", "p", "s"))
    if sc.has["inverse"]:
        out.append(_triples(new.join(sc.inverse, F.col("p") == F.col("ip")), "o", "iq", "s"))
    if sc.has["transitive"]:

        def hop(a, b):
            a = a.join(sc.transitive, F.col("p") == F.col("xp")).select(F.col("s").alias("x"), F.col("p").alias("q"), F.col("o").alias("m"))
            b = b.select(F.col("s").alias("m2"), F.col("p").alias("q2"), F.col("o").alias("z"))
            return _triples(a.join(b, (F.col("m") == F.col("m2")) & (F.col("q") == F.col("q2"))), "x", "q", "z")

        out += _pairs(new, total, hop)
    if sc.has["has_value"]:
        out.append(_triples(typ(new).join(sc.has_value, F.col("c") == F.col("r")), "x", "op", "y"))
        out.append(_triples(new.join(sc.has_value, (F.col("p") == F.col("op")) & (F.col("o") == F.col("y"))), "s", F.lit(R.TYPE), "r"))
    if sc.has["some"]:
        out.append(_triples(new.join(sc.some.where(F.col("y") == R.const(Term(1, O + "Thing"))), F.col("p") == F.col("op")), "s", F.lit(R.TYPE), "r"))

        def some(edges, types):
            e = edges.join(sc.some, F.col("p") == F.col("op"))
            k = typ(types).withColumnsRenamed({"x": "kx", "c": "kc"})
            return _triples(e.join(k, (F.col("o") == F.col("kx")) & (F.col("y") == F.col("kc"))), "s", F.lit(R.TYPE), "r")

        out += _pairs(new, total, some)
    if sc.has["all"]:

        def all_values(edges, types):
            k = typ(types).join(sc.all, F.col("c") == F.col("r")).select(F.col("x").alias("kx"), F.col("op").alias("kp"), F.col("y").alias("ky"))
            return _triples(edges.where("o.k != 2").join(k, (F.col("s") == F.col("kx")) & (F.col("p") == F.col("kp"))), "o", F.lit(R.TYPE), "ky")

        out += _pairs(new, total, all_values)
    if sc.has["intersection"]:
        lists = sc.lists["intersection"]
        out.append(_triples(typ(new).join(lists.select(F.col("c").alias("ic"), "item"), F.col("c") == F.col("ic")), "x", F.lit(R.TYPE), "item"))
        hit = typ(new).join(lists.select("item", F.col("c").alias("ic")), F.col("c") == F.col("item")).select("x", "ic").distinct()
        full = typ(total).distinct().join(lists.select(F.col("item"), F.col("c").alias("ic"), "i", "last"), F.col("c") == F.col("item"))
        whole = full.groupBy("x", "ic").agg(F.count_distinct("i").alias("n"), F.first("last").alias("last")).where("n = last + 1")
        out.append(_triples(whole.join(hit, ["x", "ic"], "left_semi"), "x", F.lit(R.TYPE), "ic"))
    if sc.has["union"]:
        out.append(_triples(typ(new).join(sc.lists["union"].select("item", F.col("c").alias("uc")), F.col("c") == F.col("item")), "x", F.lit(R.TYPE), "uc"))
    if sc.has["chain"]:
        out += _chains(new, total, sc)
    out += _same_as(new, total, sc)
    return out


def _chains(new: DataFrame, total: DataFrame, sc: Schema) -> list[DataFrame]:
    """prp-spo2: walk each chain property by property."""
    lists = sc.lists["chain"].select(F.col("c").alias("cp"), "head", "i", _iri(F.col("item")).alias("q"), "last")
    first = lists.where("i = 0")
    at = total.join(first, F.col("p") == F.col("q")).select("head", "cp", "last", F.col("s").alias("x"), F.col("o").alias("m"), F.lit(0).alias("k"))
    longest = lists.agg(F.max("last")).first()[0] or 0
    parts = []
    for k in range(1, longest + 1):
        nxt = lists.where(F.col("i") == k).select(F.col("head").alias("h2"), F.col("q").alias("q2"))
        t = total.select(F.col("s").alias("s2"), F.col("p").alias("p2"), F.col("o").alias("o2"))
        at = at.join(nxt, F.col("head") == F.col("h2")).join(t, (F.col("p2") == F.col("q2")) & (F.col("m") == F.col("s2"))).select("head", "cp", "last", "x", F.col("o2").alias("m"), F.lit(k).alias("k"))
        parts.append(_triples(at.where("last = k"), "x", _iri(F.col("cp")), "m"))
    return parts


def _same_as(new: DataFrame, total: DataFrame, sc: Schema) -> list[DataFrame]:
    """Rules that make sameAs links; within a group each member is linked with the least (eq rules close the rest)."""
    out = []

    def star(df: DataFrame, group: list[str], member: str) -> DataFrame:
        least = df.groupBy(*group).agg(F.min(member).alias("least"))
        return _triples(df.join(least, group).where(F.col(member) != F.col("least")), "least", F.lit(SAME), member)

    if sc.has["functional"]:
        out.append(star(total.where("o.k != 2").join(sc.functional, F.col("p") == F.col("xp")), ["s", "p"], "o"))
    if sc.has["inverse_functional"]:
        out.append(star(total.join(sc.inverse_functional, F.col("p") == F.col("xp")), ["o", "p"], "s"))
    typ = total.where(F.col("p") == R.TYPE).select(F.col("s").alias("x"), F.col("o").alias("c"))
    if sc.has["max1"]:
        u = typ.join(sc.max1, F.col("c") == F.col("r")).select("x", "op").distinct()
        out.append(star(total.where("o.k != 2").join(u, (F.col("s") == F.col("x")) & (F.col("p") == F.col("op"))), ["s", "p"], "o"))
    if sc.has["max1q"]:
        u = typ.join(sc.max1q, F.col("c") == F.col("r")).select("x", "op", "oc").distinct()
        e = total.where("o.k != 2").join(u, (F.col("s") == F.col("x")) & (F.col("p") == F.col("op")))
        k = typ.select(F.col("x").alias("kx"), F.col("c").alias("kc"))
        thing = F.col("oc") == R.const(Term(1, O + "Thing"))
        out.append(star(e.where(thing), ["s", "p", "oc"], "o"))
        out.append(star(e.where(~thing).join(k, (F.col("o") == F.col("kx")) & (F.col("oc") == F.col("kc")), "left_semi"), ["s", "p", "oc"], "o"))
    if sc.has["key"]:
        keys = sc.lists["key"].select(F.col("c").alias("kc"), "head", "i", _iri(F.col("item")).alias("kp"), "last")
        held = typ.join(keys, F.col("c") == F.col("kc")).select(F.col("x").alias("hx"), "head", "i", "kp", "last")
        vals = held.join(total, (F.col("hx") == F.col("s")) & (F.col("kp") == F.col("p"))).select("hx", "head", "i", "last", "o")
        other = vals.select(F.col("hx").alias("hy"), F.col("head").alias("h2"), F.col("i").alias("i2"), F.col("o").alias("o2"))
        both = vals.join(other, (F.col("head") == F.col("h2")) & (F.col("i") == F.col("i2")) & (F.col("o") == F.col("o2"))).where("hx < hy")
        agree = both.groupBy("hx", "hy", "head").agg(F.count_distinct("i").alias("n"), F.first("last").alias("last")).where("n = last + 1")
        out.append(_triples(agree, "hx", F.lit(SAME), "hy"))
    return out


def _equality(t: DataFrame) -> DataFrame:
    """sameAs closed over its classes, and every triple with each member of its subject's and object's classes."""
    same = _of(t, SAME, "a", "b").where("a.k != 2 and b.k != 2 and a != b")
    if same.isEmpty():
        return t.limit(0)
    key = lambda c: F.to_json(c)
    names = same.select(F.col("a").alias("t")).union(same.select(F.col("b").alias("t"))).distinct().select(key(F.col("t")).alias("n"), "t")
    comp = components(same.select(key(F.col("a")).alias("a"), key(F.col("b")).alias("b")))
    cls = written(comp.join(names, "n").select("t", "component"))
    a, b = cls.select(F.col("t").alias("x"), "component"), cls.select(F.col("t").alias("y"), "component")
    pairs = written(a.join(b, "component").where("x != y").select("x", "y"))
    links = _triples(pairs, "x", F.lit(SAME), "y")
    rest = t.where(F.col("p") != SAME)
    by_s = _triples(rest.join(pairs, F.col("s") == F.col("x")), "y", "p", "o")
    wide = rest.union(by_s)
    by_o = _triples(wide.join(pairs, F.col("o") == F.col("x")), "s", "p", "y")
    return links.union(by_s).union(by_o)


def expand(t: DataFrame, regime: str = "rdfs", emit_schema: bool = False) -> DataFrame:
    """(s, p, o) of t and what follows from it: regime 'rdfs' or 'owlrl'.

    With emit_schema the closed subClassOf and subPropertyOf triples are among the results.
    """
    if regime not in ("rdfs", "owlrl"):
        raise ValueError(f"unknown regime {regime}")
    owl = regime == "owlrl"
    t = written(t.select("s", "p", "o").distinct())
    sc = Schema(t, owl)
    seed = t
    if owl:
        lists = sc.lists["one_of"]
        seed = seed.union(_triples(lists, "item", F.lit(R.TYPE), "c")) if sc.has["one_of"] else seed

    def step(new, total):
        parts = _property_rules(new, sc)
        if owl:
            parts += _owl_rules(new, total, sc)
            parts.append(_equality(total))
        return _union(parts).distinct()

    out = fixpoint(seed, step)
    if emit_schema:
        up = lambda c: R.make(1, F.col(c))
        out = out.union(_triples(sc.sub_class, "c", F.lit(SCHEMA["sub_class"]), "d")).union(_triples(sc.sub_property, up("sp"), F.lit(SCHEMA["sub_property"]), up("tp"))).distinct()
    return out


def inferred(t: DataFrame, regime: str = "rdfs") -> DataFrame:
    """Only the triples that t doesn't hold already."""
    return expand(t, regime).join(t.select("s", "p", "o"), ["s", "p", "o"], "left_anti").select("s", "p", "o")


# inconsistencies ------------------------------------------------------------------------------------------------------


def inconsistencies(t: DataFrame) -> DataFrame:
    """(rule, message) for everything in an expanded graph that contradicts its axioms."""
    sc_on = _of(t, SCHEMA["on_property"], "r", "x").select("r", _iri(F.col("x")).alias("op"))
    typ = t.where(F.col("p") == R.TYPE).select(F.col("s").alias("x"), F.col("o").alias("c")).distinct()
    prop = lambda name: _typed(t, O + name).select(_iri(F.col("s")).alias("xp"))
    n3 = lambda c: R.n3(F.col(c) if isinstance(c, str) else c, depth=1)
    found = []

    def report(df: DataFrame, rule: str, *words) -> None:
        parts = [n3(w[1:]) if isinstance(w, str) and w.startswith("$") else F.col(w[1:]) if isinstance(w, str) and w.startswith("@") else F.lit(w) for w in words]
        found.append(df.select(F.lit(rule).alias("rule"), F.concat_ws(" ", *parts).alias("message")).distinct())

    report(typ.where(F.col("c") == R.const(Term(1, O + "Nothing"))), "cls-nothing2", "$x", "is of type owl:Nothing")
    report(t.join(prop("IrreflexiveProperty"), F.col("p") == F.col("xp")).where("s = o"), "prp-irp", "$s", "is related to itself by", "@p")
    back = t.select(F.col("s").alias("o2"), F.col("p").alias("p2"), F.col("o").alias("s2"))
    asym = t.join(prop("AsymmetricProperty"), F.col("p") == F.col("xp")).join(back, (F.col("s") == F.col("s2")) & (F.col("o") == F.col("o2")) & (F.col("p") == F.col("p2"))).where("s <= o")
    report(asym, "prp-asyp", "$s", "and", "$o", "are related both ways by", "@p")

    def disjoint_properties(pairs: DataFrame, rule: str) -> None:
        other = t.select(F.col("s").alias("s2"), F.col("p").alias("p2"), F.col("o").alias("o2"))
        hit = t.join(pairs, F.col("p") == F.col("dp")).join(other, (F.col("s") == F.col("s2")) & (F.col("o") == F.col("o2")) & (F.col("p2") == F.col("dq")))
        report(hit, rule, "$s", "and", "$o", "are related by the disjoint", "@dp", "and", "@dq")

    def disjoint_classes(pairs: DataFrame, rule: str) -> None:
        other = typ.select(F.col("x").alias("x2"), F.col("c").alias("c2"))
        hit = typ.join(pairs, F.col("c") == F.col("dc")).join(other, (F.col("x") == F.col("x2")) & (F.col("c2") == F.col("dd")))
        report(hit, rule, "$x", "is in the disjoint", "$dc", "and", "$dd")

    disjoint_properties(_of(t, SCHEMA["disjoint_property"], "a", "b").select(_iri(F.col("a")).alias("dp"), _iri(F.col("b")).alias("dq")), "prp-pdw")
    disjoint_classes(_of(t, SCHEMA["disjoint"], "dc", "dd"), "cax-dw")
    disjoint_classes(_of(t, SCHEMA["complement"], "dc", "dd"), "cls-com")
    heads = _of(t, SCHEMA["members"], "axiom", "head")
    if not heads.isEmpty():
        m = written(list_members(t, heads.select("head").distinct()).join(heads, "head").select("axiom", "i", "item"))
        a, b = m.select("axiom", "i", F.col("item").alias("a")), m.select("axiom", F.col("i").alias("j"), F.col("item").alias("b"))
        pairs = a.join(b, "axiom").where("i < j")
        props, classes = _typed(t, O + "AllDisjointProperties").select(F.col("s").alias("axiom")), _typed(t, O + "AllDisjointClasses").select(F.col("s").alias("axiom"))
        disjoint_properties(pairs.join(props, "axiom").select(_iri(F.col("a")).alias("dp"), _iri(F.col("b")).alias("dq")), "prp-adp")
        disjoint_classes(pairs.join(classes, "axiom").select(F.col("a").alias("dc"), F.col("b").alias("dd")), "cax-adc")
    diff = _of(t, O + "differentFrom", "a", "b")
    report(_of(t, SAME, "a", "b").join(diff.union(diff.select("b", "a").toDF("a", "b")).distinct(), ["a", "b"]).where("a <= b"), "eq-diff1", "$a", "is both the same as and different from", "$b")
    zero = lambda kind: _of(t, SCHEMA[kind], "r", "y").where("y.k = 2 and y.v = '0'").join(sc_on, "r")
    e = t.select(F.col("s").alias("es"), F.col("p").alias("ep"), F.col("o").alias("eo"))
    some = lambda z: typ.join(z, F.col("c") == F.col("r")).join(e, (F.col("x") == F.col("es")) & (F.col("op") == F.col("ep")))
    report(some(zero("max")), "cls-maxc1", "$x", "has a value of", "@op", "which it can't have")
    q = some(zero("max_q").join(_of(t, SCHEMA["on_class"], "r", "oc"), "r"))
    kt = typ.select(F.col("x").alias("kx"), F.col("c").alias("kc"))
    thing = F.col("oc") == R.const(Term(1, O + "Thing"))
    report(q.where(~thing).join(kt, (F.col("eo") == F.col("kx")) & (F.col("oc") == F.col("kc")), "left_semi"), "cls-maxqc1", "$x", "has a value of", "@op", "in", "$oc")
    report(q.where(thing), "cls-maxqc2", "$x", "has a value of", "@op", "which it can't have")
    npa = _of(t, O + "sourceIndividual", "n", "ns").join(_of(t, O + "assertionProperty", "n", "np"), "n").select("n", "ns", _iri(F.col("np")).alias("np"))
    for rule, p in (("prp-npa1", O + "targetIndividual"), ("prp-npa2", O + "targetValue")):
        hit = npa.join(_of(t, p, "n", "no"), "n").join(e, (F.col("ns") == F.col("es")) & (F.col("np") == F.col("ep")) & (F.col("no") == F.col("eo")))
        report(hit, rule, "$ns", "has", "@np", "$no", "against a negative assertion")
    return _union(found)


def expand_and_check(t: DataFrame, regime: str = "owlrl") -> tuple[DataFrame, DataFrame]:
    out = written(expand(t, regime))
    return out, inconsistencies(out)
