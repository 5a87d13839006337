"""A rule language over triples: DATA { ... } and RULE { head } WHERE { body }, with FILTER, BIND and NOT in bodies.

Rules are ordered into strata so that nothing is negated before it is complete; each stratum is a semi-naive fixpoint
in which every round joins one body triple with the triples of the round before.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import Dataset, quads_frame
from ..engine import instantiate
from ..plans.compiler import Compiler
from ..plans.parser import Parser, SparqlError, expr_vars, node_vars, pattern_vars
from ..terms import Term
from .fixpoint import fixpoint, written

NEW = "urn:x:new"


@dataclass
class Rule:
    head: list[tuple]
    body: list[tuple]  # ("triple", s, p, o) ("filter", e) ("bind", var, e) ("not", elements)


@dataclass
class RuleSet:
    data: list[tuple] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    base: str = ""


class RuleParser(Parser):
    def rule_set(self) -> RuleSet:
        out = RuleSet()
        while self.kind != "end":
            if self.at("PREFIX", "BASE", "VERSION"):
                self.prologue()
            elif self.take("DATA"):
                for t in self._template():
                    if any(node_vars(n) for n in t):
                        raise SparqlError("DATA takes no variables")
                    out.data.append(t)
            elif self.take("RULE"):
                head = self._template()
                self.need("WHERE")
                self.labels = {}
                out.rules.append(Rule(head, self.body()))
            else:
                raise SparqlError(f"unexpected {self.tok!r}")
        out.base = self.base
        return out

    def body(self) -> list[tuple]:
        self.need("{")
        out: list[tuple] = []
        while not self.take("}"):
            if self.take("FILTER"):
                out.append(("filter", self._constraint()))
            elif self.take("BIND"):
                self.need("(")
                e = self.expression()
                self.need("AS")
                out.append(("bind", self.var(), e))
                self.need(")")
            elif self.take("NOT"):
                out.append(("not", self.body()))
            elif self.take("."):
                continue
            else:
                triples: list = []
                self._same_subject(triples, paths=False)
                out += [("triple", *t) for t in triples]
                if not self.at("}", "FILTER", "BIND", "NOT"):
                    self.need(".")
        return out


def parse_rules(text: str, base: str = "") -> RuleSet:
    return RuleParser(text, base).rule_set()


def check_well_formed(rs: RuleSet) -> None:
    """Head variables are bound by the body, BIND makes new variables, filters and expressions use bound ones."""
    for rule in rs.rules:
        bound: set[str] = set()
        for e in rule.body:
            if e[0] == "triple":
                bound |= set().union(*map(node_vars, e[1:]))
            elif e[0] == "bind":
                if e[1] in bound:
                    raise SparqlError(f"BIND to ?{e[1]}, which is bound")
                if loose := expr_vars(e[2]) - bound:
                    raise SparqlError(f"?{sorted(loose)[0]} is not bound before BIND")
                bound.add(e[1])
            elif e[0] == "filter" and (loose := expr_vars(e[1]) - bound):
                raise SparqlError(f"?{sorted(loose)[0]} is not bound before FILTER")
        for t in rule.head:
            if loose := set().union(*map(node_vars, t)) - bound:
                raise SparqlError(f"?{sorted(loose)[0]} of a head is not bound")


def _triples(body: list[tuple], negated: bool = False):
    for e in body:
        if e[0] == "triple":
            yield e[1:], negated
        elif e[0] == "not":
            yield from _triples(e[1], True)


def _might_match(pattern: tuple, head: tuple) -> bool:
    return all(a == b or not isinstance(a, Term) or not isinstance(b, Term) or b.k == 0 for a, b in zip(pattern, head, strict=True))


def stratify(rs: RuleSet) -> list[list[int]]:
    """Rules by stratum; a rule that depends on its own negation is an error."""
    n = len(rs.rules)
    needs = [[(j, neg) for pattern, neg in _triples(r.body) for j, other in enumerate(rs.rules) if any(_might_match(pattern, h) for h in other.head)] for r in rs.rules]
    level = [0] * n
    for _ in range(n + 1):
        before = list(level)
        for i in range(n):
            for j, neg in needs[i]:
                level[i] = max(level[i], level[j] + neg)
        if level == before:
            break
        if max(level) > n:
            break
    if any(x > n for x in level) or level != before:
        raise SparqlError("a rule depends on its own negation")
    return [[i for i in range(n) if level[i] == k] for k in sorted(set(level))]


def _pattern(body: list[tuple], new: int | None = None) -> tuple:
    """A body in the query algebra; the new-th triple reads the triples of the last round."""
    out: tuple = ("bgp", ())
    for i, e in enumerate(body):
        if e[0] == "triple":
            part = ("bgp", (e[1:],))
            if i == new:
                part = ("graph", Term(1, NEW), part)
            out = part if out == ("bgp", ()) else ("bgp", out[1] + part[1]) if out[0] == part[0] == "bgp" else ("join", out, part)
        elif e[0] == "filter":
            out = ("filter", e[1], out)
        elif e[0] == "bind":
            out = ("bind", out, e[1], e[2])
        else:
            out = ("filter", ("exists", _pattern(e[1]), True), out)
    return out


def evaluate(rs: RuleSet, data: Dataset, max_rounds: int = 1000) -> DataFrame:
    """(s, p, o) that follow from the data and are not in it."""
    check_well_formed(rs)
    spark = data.spark
    given = data.triples("").select("s", "p", "o")
    start = given
    if rs.data:
        start = start.union(quads_frame(spark, [(s, p.v, o) for s, p, o in rs.data]).select("s", "p", "o"))
    total = written(start.distinct())

    def conclusions(quads: DataFrame, rule: Rule, new: int | None) -> DataFrame:
        c = Compiler(Dataset(spark, quads), rs.base)
        rel = c.compile(_pattern(rule.body, new))
        used = sorted(set().union(set(), *(node_vars(n) for t in rule.head for n in t)) | (pattern_vars(_pattern(rule.body)) if _has_blank(rule.head) else set()))
        rel = rel.only([v for v in used if v in rel.vars]) if used else rel
        return instantiate(rel, [(None, *t) for t in rule.head], stable=True).select("s", "p", "o")

    for stratum in stratify(rs):
        rules = [rs.rules[i] for i in stratum]
        as_quads = lambda t, g="": t.select(F.lit(g).alias("g"), "s", "p", "o")
        first = total
        for r in rules:
            first = first.union(conclusions(as_quads(total), r, None))

        def step(new, every, rules=rules, as_quads=as_quads):
            quads = as_quads(every).union(as_quads(new, NEW))
            parts = [conclusions(quads, r, i) for r in rules for i, e in enumerate(r.body) if e[0] == "triple"]
            out = parts[0] if parts else new.limit(0)
            for p in parts[1:]:
                out = out.union(p)
            return out

        total = fixpoint(first, step, max_rounds)
    return total.join(given, ["s", "p", "o"], "left_anti").select("s", "p", "o").distinct()


def _has_blank(head: list[tuple]) -> bool:
    return any(isinstance(n, Term) and n.k == 0 for t in head for n in t)
